"""Textual checks of SMILES strings as column expressions; no chemistry backend is needed."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that occur in SMILES: element letters, digits, bonds, brackets, charges, stereo marks (fixed values).
ALPHABET = "A-IK-PR-Za-ik-pr-vy0-9@+\\-\\[\\]()=#$/\\\\%.:*~"
BRACKET_ATOM = "\\[[^\\[\\]]*\\]"
RING_NUMBER = "%\\(\\d+\\)|%\\d\\d|\\d"


def has_foreign_character(c: Column) -> Column:
    return ~c.rlike(f"^[{ALPHABET}]*\\z")


def unbalanced(c: Column) -> Column:
    """Round or square brackets that don't pair; a bracket atom has no round ones."""
    bare = F.regexp_replace(c, BRACKET_ATOM, "")
    marks = F.regexp_replace(F.regexp_replace(bare, "%\\(\\d+\\)", ""), "[^()]", "")
    depth = F.aggregate(
        F.split(marks, ""),
        F.lit(0),
        lambda a, x: F.when(a < 0, a).when(x == "(", a + 1).when(x == ")", a - 1).otherwise(a),
    )
    return bare.rlike("[\\[\\]]") | (depth != 0) | c.rlike("\\[[^\\[\\]]*[()][^\\[\\]]*\\]")


def unpaired_ring(c: Column) -> Column:
    """Some ring number outside bracket atoms stands an odd number of times."""
    bare = F.regexp_replace(c, BRACKET_ATOM, "")
    found = F.regexp_extract_all(bare, F.lit(f"({RING_NUMBER})"), F.lit(0))
    rings = F.transform(found, lambda x: F.regexp_replace(x, "[%()]", "").cast("int"))
    # A number opens a ring where it isn't open, and closes it where it is.
    turned = lambda a, x: F.when(F.array_contains(a, x), F.array_remove(a, x)).otherwise(F.array_append(a, x))
    return F.size(F.aggregate(rings, F.array().cast("array<int>"), turned)) > 0


def fault(c: Column) -> Column:
    """Why a text can't be SMILES; null if nothing speaks against it."""
    return (
        F.when(has_foreign_character(c), "foreign character")
        .when(unbalanced(c), "unbalanced brackets")
        .when(unpaired_ring(c), "unpaired ring number")
    )


_KNOWN = np.zeros(128, bool)
_KNOWN[[i for i in range(128) if re.fullmatch(f"[{ALPHABET}]", chr(i))]] = True
_BRACKETS, _RINGS = re.compile(BRACKET_ATOM), re.compile(RING_NUMBER)


def faults(texts: list[str]) -> list[str | None]:
    """fault of many texts at once, for Arrow batches: sums over all their characters."""
    if not texts:
        return []
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(n), sizes)
    begin = np.cumsum(sizes) - sizes

    def depths(step: np.ndarray) -> np.ndarray:
        """Running sum of the steps within each text."""
        run = np.concatenate([[0], np.cumsum(step)])
        return run[1:] - run[begin][owner]

    hit = lambda where: np.bincount(owner[where], minlength=n) > 0
    foreign = hit(~_KNOWN[np.minimum(codes, 127)] | (codes > 127))
    square = (codes == 91).astype(np.int64) - (codes == 93)
    depth = depths(square)
    atom = (depth > 0) | (codes == 93)
    broken = hit((depth < 0) | (depth > 1)) | (np.bincount(owner, square, n) != 0)
    round_ = (codes == 40).astype(np.int64) - (codes == 41)
    broken |= hit((round_ != 0) & atom)
    round_[atom] = 0
    broken |= hit(depths(round_) < 0) | (np.bincount(owner, round_, n) != 0)
    digit = np.flatnonzero((codes >= 48) & (codes <= 57) & ~atom)
    odd = (np.bincount(owner[digit] * 10 + codes[digit] - 48, minlength=n * 10).reshape(n, 10) % 2 == 1).any(1)
    for i in np.flatnonzero(hit(codes == 37) & ~foreign & ~broken).tolist():  # numbers of two digits and more
        found = [int(x.strip("%()")) for x in _RINGS.findall(_BRACKETS.sub("", texts[i]))]
        odd[i] = any(found.count(x) % 2 for x in set(found))
    return ["foreign character" if f else "unbalanced brackets" if b else "unpaired ring number" if o else None for f, b, o in zip(foreign.tolist(), broken.tolist(), odd.tolist())]


def atom_count(c: Column) -> Column:
    """Heavy atoms by pattern: bracket atoms, two-letter halogens, organic-subset letters."""
    atoms = F.regexp_count(c, F.lit("\\[[^\\]]*\\]|Cl|Br|[BCNOPSFIbcnops]"))
    return atoms - F.regexp_count(c, F.lit("\\[[0-9]*H[0-9]*[+-]?[0-9]*\\]"))

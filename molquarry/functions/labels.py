"""Names, prefixes, tags and group keys as column expressions or plain values."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a fold model is called.
MODEL_NAME = "^([A-Za-z]+)_seed(\\d+)_fold(\\d+)$"


def model_parts(name: Column) -> Column:
    """backend, seed and fold of a fold model's name; null for any other text."""
    fit = name.rlike(MODEL_NAME)
    part = lambda i: F.regexp_extract(name, MODEL_NAME, i)
    return F.when(fit, F.struct(part(1).alias("backend"), part(2).cast("long").alias("seed"), part(3).cast("long").alias("fold")))


def require_model_names(df: DataFrame, col: str) -> DataFrame:
    """df itself, or a ValueError with the first names that aren't fold models'."""
    bad = df.filter(~F.coalesce(F.col(col).rlike(MODEL_NAME), F.lit(False))).select(col).limit(5).collect()
    if bad:
        raise ValueError(f"not <BACKEND>_seed<N>_fold<N>: {[r[0] for r in bad]}")
    return df


def upper_label(prefix: Column) -> Column:
    """The part before the first underscore in capitals."""
    return F.upper(F.substring_index(prefix, "_", 1))


def without_task(name: Column) -> Column:
    """A file stem without the number of the task that wrote it and what follows."""
    return F.regexp_replace(name, "_task\\d+.*$", "")


def code_name(code: Column, names: dict[str, str]) -> Column:
    """The name of the code before the first underscore, itself if it has none."""
    head = F.substring_index(code, "_", 1)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[head], head) if names else head


def pretty(strategy: Column) -> Column:
    """best_5 to Best-5."""
    return F.concat(F.upper(F.substring(strategy, 1, 1)), F.replace(F.substring(strategy, 2, 1_000), F.lit("_"), F.lit("-")))


def target_label(score: Column) -> Column:
    return F.concat(F.lit("TARGET - SCORE: "), F.format_number(score, 1))


def node_role(node: Column, target: Column, leaves: Column) -> Column:
    return F.when(node == target, "target").when(F.array_contains(leaves, node), "building block").otherwise("intermediate")


def legend(col: str, value: Column) -> Column:
    """`col: value`, numbers with three digits, null as n/a."""
    number = value.cast("string").try_cast("double")
    return F.concat(F.lit(f"{col}: "), F.coalesce(F.when(number.isNotNull() & value.cast("string").contains("."), F.format_number(number, 3)).otherwise(value.cast("string")), F.lit("n/a")))


def cell(mean: Column, spread: Column | None = None, decimals: int = 3) -> Column:
    """mean or mean±spread as a table cell; --- where the mean is missing, spread 0 where it is."""
    x = F.nanvl(mean.cast("double"), F.lit(None))
    text = F.format_number(x, decimals)
    if spread is not None:
        text = F.concat(text, F.lit("±"), F.format_number(F.coalesce(F.nanvl(spread.cast("double"), F.lit(None)), F.lit(0.0)), decimals))
    return F.coalesce(text, F.lit("---"))


# Fragment texts -------------------------------------------------------------------------------------------------------

#: What tells a fragment's part: its attachment tags (fixed values).
TAG_ONE, TAG_TWO = "[*:1]", "[*:2]"


def fragment_parts(prediction: Column, strict: bool = True) -> Column:
    """warhead, linker and e3 of a dotted fragment text, by tags: 1 only, both, 2 only.

    Strict: null unless there is exactly one of each and nothing else. Otherwise the last of each counts and parts
    may be missing.
    """
    parts = F.filter(F.split(prediction, "\\."), lambda x: x != "")
    one, two = (lambda x: x.contains(TAG_ONE)), (lambda x: x.contains(TAG_TWO))
    own = {"warhead": F.filter(parts, lambda x: one(x) & ~two(x)), "linker": F.filter(parts, lambda x: one(x) & two(x)), "e3": F.filter(parts, lambda x: ~one(x) & two(x))}
    if strict:
        exact = (F.size(parts) == 3) & (F.size(own["warhead"]) == 1) & (F.size(own["linker"]) == 1) & (F.size(own["e3"]) == 1)
        return F.when(exact, F.struct(*(x[0].alias(n) for n, x in own.items())))
    return F.struct(*(F.try_element_at(x, F.lit(-1)).alias(n) for n, x in own.items()))


def without_tags(c: Column) -> Column:
    """Attachment points become hydrogens."""
    return F.regexp_replace(F.regexp_replace(c, "\\[\\*(:\\d+)?\\]", "[H]"), "\\*", "[H]")


# Group keys -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GroupKey:
    """mode: single, product (all parts equal) or union (any part shared)."""

    name: str
    columns: tuple[str, ...]
    mode: str


def group_key(spec: str, columns: list[str]) -> GroupKey:
    """NAME=COL, NAME=A&B (product) or NAME=A+B (union); both marks in one key are an error."""
    name, eq, text = spec.partition("=")
    if not eq:
        name = text = spec
    if "&" in text and "+" in text:
        raise ValueError(f"{spec}: a key is a product or a union, not both")
    mark = "&" if "&" in text else "+" if "+" in text else None
    parts = tuple(x.strip() for x in (text.split(mark) if mark else [text]))
    missing = [x for x in parts if x not in columns]
    if missing:
        raise ValueError(f"{spec}: no columns {missing} in {columns}")
    return GroupKey(name.strip(), parts, {"&": "product", "+": "union", None: "single"}[mark])


def key_combinations(names: list[str], pairs_only: bool = False) -> list[GroupKey]:
    """All products and unions of two (or more) keys."""
    sizes = (2,) if pairs_only else range(2, len(names) + 1)
    return [GroupKey(m.join(c), c, mode) for k in sizes for c in combinations(names, k) for m, mode in (("&", "product"), ("+", "union"))]


def product_key(*cols: str) -> Column:
    """Values joined by ||; null if any is null."""
    return F.when(~F.greatest(*(F.col(c).isNull() for c in cols)) if len(cols) > 1 else F.col(cols[0]).isNotNull(), F.concat_ws("||", *cols))


# Parallel parameter lists -------------------------------------------------------------------------------------------------


def list_count(**lists: list) -> int:
    """The length of the longest list, 1 at least."""
    return max([1, *(len(x) for x in lists.values() if x)])


def at_index(values: list | None, i: int, default: object) -> object:
    got = values[i] if values and i < len(values) else None
    return default if got is None else got


def shared_value(values: list | None, name: str, default: object) -> object:
    """The one value that a list repeats; different ones are an error."""
    there = {v for v in values or [] if v is not None}
    if len(there) > 1:
        raise ValueError(f"{name} has different values: {sorted(map(str, there))}")
    return next(iter(there), default)

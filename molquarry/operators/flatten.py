"""Deeply nested JSON columns to flat tables that keep parent and child together (problem 5).

A batch of texts is decoded once; from there on it works level by level on Arrow arrays: every level is a
list array, its offsets give parent indices and positions, and keys and paths reach the children by take.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.runtime import Scratch

#: kind: [(fields that lead from an element to the list of its children, kind of the children)]
ROUTE_GRAMMAR = {
    "precursor": [],
    "step": [(("reactants",), "reactant"), (("conditions", "reagents"), "reagent")],
    "reactant": [(("made_by",), "step")],
    "reagent": [],
}
#: column: kind of its elements
ROUTE_ROOTS = {"precursors": "precursor", "synthesis_steps": "step"}

#: kind: {field: the names that lead from an element to it}. An element that is a text is its first field.
ROUTE_FIELDS = {
    "precursor": {"precursor_smiles": ("precursor_smiles",), "in_stock": ("in_stock",), "stock_source": ("stock_source",)},
    "step": {"step_number": ("step_number",), "product": ("product",), "template_code": ("template_code",), "probability": ("probability",), "temperature": ("conditions", "temperature")},
    "reactant": {"smiles": ("smiles",), "in_stock": ("in_stock",)},
    "reagent": {"name": ("name",), "equiv": ("equiv",)},
}
_OUT = pa.schema([("key", pa.int64()), ("child", pa.string()), ("path", pa.string()), ("parent_path", pa.string()), ("pos", pa.int32()), ("fields", pa.list_(pa.string()))])
_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def _parsed(text: str) -> object:
    """What JSON writes, its nesting held in a list: for texts too deep for a decoder that calls itself. ValueError if it isn't JSON."""
    at, end = _BLANK.match(text, 0).end(), len(text)
    open_: list = []  # containers not yet closed; of an object also the name that waits for its value
    names: list = []

    def fail() -> None:
        raise ValueError(f"no JSON at {at}")

    def name() -> None:
        nonlocal at
        if at >= end or text[at] != '"':
            fail()
        got, at = scanstring(text, at + 1)
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] != ":":
            fail()
        names[-1], at = got, _BLANK.match(text, at + 1).end()

    while True:
        c = text[at : at + 1]
        if c in ("[", "{"):
            value: object = [] if c == "[" else {}
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                open_.append(value), names.append(None)
                if c == "{":
                    name()
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
        else:
            m = _PLAIN.match(text, at)
            if not m:
                fail()
            value, at = json.loads(m.group()), m.end()
        while True:  # the value is whole: it goes where it belongs, and so does what it closes
            at = _BLANK.match(text, at).end()
            if not open_:
                if at < end:
                    fail()
                return value
            if isinstance(open_[-1], list):
                open_[-1].append(value)
            else:
                open_[-1][names[-1]] = value
            c = text[at : at + 1]
            if c == ",":
                at = _BLANK.match(text, at + 1).end()
                if isinstance(open_[-1], dict):
                    name()
                break
            if c != ("]" if isinstance(open_[-1], list) else "}"):
                fail()
            value, at = open_.pop(), at + 1
            names.pop()


def _decoded(text: str | None) -> object:
    """What a text holds, also if encoded more than once; None for null, blank and cut-off text."""
    got: object = text
    while isinstance(got, str):
        if not got.strip():
            return None
        try:
            got = json.loads(got)
        except RecursionError:
            try:
                got = _parsed(got)
            except ValueError:
                return None
        except ValueError:
            return None
    return got


def _text(x: object) -> str | None:
    """A scalar's text; a list's, joined by commas; anything else as JSON."""
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, list):
        return ",".join(_text(e) or "" for e in x)
    return json.dumps(x)


def _listed(x: object) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _reach(x: object, names: tuple[str, ...]) -> object:
    for n in names:
        x = x.get(n) if isinstance(x, dict) else None
    return x


def flatten_batch(keys: pa.Array, columns: dict[str, list], grammar: dict, roots: dict, fields: dict, kinds: tuple | None) -> Iterator[pa.RecordBatch]:
    level = []  # (kind, key, parent path, own prefix, a list of children for each)
    for column, kind in roots.items():
        n = len(keys)
        level.append((kind, keys, pa.array([""] * n), pa.array([column] * n), [_listed(_decoded(x)) for x in columns[column]]))
    while level:
        following: dict[str, list] = {}
        for kind, key, parent_path, prefix, children in level:
            sizes = np.fromiter(map(len, children), np.int32, len(children))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.arange(offsets[-1], dtype=np.int32)))
            parent = pc.list_parent_indices(lists)
            pos = pa.array((np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)).astype(np.int32))
            elements = list(chain.from_iterable(children))
            there = np.fromiter((x is not None for x in elements), bool, len(elements))
            if not there.any():
                continue
            keep = pa.array(np.flatnonzero(there))
            parent, pos = parent.take(keep), pos.take(keep)
            elements = [x for x in elements if x is not None]
            key, above = key.take(parent), parent_path.take(parent)
            path = pc.binary_join_element_wise(prefix.take(parent), pc.cast(pos, pa.string()), "[")
            path = pc.binary_join_element_wise(path, "]", "")
            if kinds is None or kind in kinds:
                own = fields.get(kind, {}) if fields else {}
                found = [[x if isinstance(x, str) and not n else _text(_reach(x, names)) for x in elements] for n, names in enumerate(own.values())]
                texts = pa.array([v for row in zip(*found) for v in row] if found else [], pa.string())
                offsets = pa.array(np.arange(len(elements) + 1, dtype=np.int32) * len(own))
                yield pa.RecordBatch.from_arrays([key, pa.array([kind] * len(key)), path, above, pos, pa.ListArray.from_arrays(offsets, texts)], schema=_OUT)
            for names, below in grammar[kind]:
                found = [_listed(_reach(x, names)) for x in elements]
                if any(found):
                    following.setdefault(below, []).append((below, key, path, pc.binary_join_element_wise(path, ".".join(names), "."), found))
        level = [x for own in following.values() for x in own]


def flatten_nested(df: DataFrame, key: str, grammar: dict = ROUTE_GRAMMAR, roots: dict[str, str] = ROUTE_ROOTS, fields: dict | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each non-null element at any depth: key, child (its kind), path, parent_path, pos, fields.

    fields holds the texts of the fields asked for, by kind and in their order; an element that is a text is its
    first field. kinds leaves only rows of those kinds. Null, blank and cut-off texts give no rows; text encoded
    twice is decoded twice; a lone element stands at position 0; nulls count as positions. Positions begin at 0.
    Nesting may be of any depth. Rows with a null key keep it. Equal rows give equal results, each its own.
    """
    names = list(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flatten_batch(b.column(0), {n: b.column(i + 1).to_pylist() for i, n in enumerate(names)}, grammar, roots, fields or {}, kinds)

    wanted = df.select(F.col(key).cast("long").alias("key"), *(F.col(n).cast("string").alias(n) for n in names))
    return wanted.mapInArrow(run, "key long, child string, path string, parent_path string, pos int, fields array<string>").withColumnRenamed("key", key)


def child_table(df: DataFrame, key: str, kind: str, grammar: dict = ROUTE_GRAMMAR, roots: dict[str, str] = ROUTE_ROOTS, fields: dict = ROUTE_FIELDS) -> DataFrame:
    """The table of one kind: key, path, parent_path, pos and its fields as text columns."""
    below = {kind}
    while True:  # kinds that can't lead to this one needn't be gone into
        more = below | {k for k, ways in grammar.items() for _, to in ways if to in below}
        if more == below:
            break
        below = more
    own = {k: [(names, to) for names, to in ways if to in below] for k, ways in grammar.items()}
    rows = flatten_nested(df, key, own, {c: k for c, k in roots.items() if k in below}, {kind: fields[kind]}, (kind,))
    return rows.select(key, "path", "parent_path", "pos", *(F.col("fields")[i].alias(n) for i, n in enumerate(fields[kind])))


def child_tables(df: DataFrame, key: str, scratch: Scratch, grammar: dict = ROUTE_GRAMMAR, roots: dict[str, str] = ROUTE_ROOTS, fields: dict = ROUTE_FIELDS) -> dict[str, DataFrame]:
    """All kinds' tables from one decoding, written by kind so that reading one kind reads no other."""
    every = scratch.keep(flatten_nested(df, key, grammar, roots, fields), "child")
    return {kind: every.filter(F.col("child") == kind).select(key, "path", "parent_path", "pos", *(F.col("fields")[i].alias(n) for i, n in enumerate(own))) for kind, own in fields.items()}

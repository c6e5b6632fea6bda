"""Records that differ only in formatting (problem 4).

A record is a tree: fields, entries of a field, values of an entry. Leaves are normalised, a node's digest is made
of its children's digests, sorted where order carries no meaning; equal root digests make a group, and the
normalised trees are compared in full before copies are reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.text import INVISIBLE, without_blanks
from molquarry.runtime import SALTS, Scratch, replicated

#: Marks around a structure text that belong to no structure (fixed values).
_AROUND = "\"'`´‘’“”,;:.|"


def structure_node(c: Column) -> Column:
    """Components of a structure text in sorted order. Letter case and notation marks stay."""
    bare = F.regexp_replace(without_blanks(F.coalesce(c, F.lit(""))), f"^[{_AROUND}]+|[{_AROUND}]+$", "")
    bare = F.regexp_replace(bare, "^\\((.*)\\)$", "$1")
    return F.array_sort(F.filter(F.split(bare, "\\."), lambda x: x != ""))


def code_node(c: Column) -> Column:
    """A code's letters and digits in lower case, without a label before it."""
    low = F.lower(F.coalesce(c, F.lit("")))
    low = F.regexp_replace(low, f"^[^\\p{{L}}\\p{{N}}]*\\p{{L}}[\\p{{L}}_ -]*[{INVISIBLE}]*[:=]", "")
    return F.array(F.regexp_replace(low, "[^\\p{L}\\p{N}]+", ""))


def entries_node(c: Column) -> Column:
    """name=value entries in sorted order; numbers by value, other values by their letters and digits."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[{INVISIBLE}&&[^\\n ]]+", " ")

    def entry(x: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(x, "^([^:=]*)[:=]", 1), "[^\\p{L}\\p{N}]+", "")
        value = F.regexp_replace(F.regexp_replace(x, "^[^:=]*[:=]", ""), "^[^\\p{L}\\p{N}.+-]+|[^\\p{L}\\p{N}]+$", "")
        number = F.when(value.rlike("^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)(e[+-]?\\d+)?$"), value.try_cast("double").cast("string"))
        return F.concat_ws("=", name, F.coalesce(number, F.regexp_replace(value, "[^\\p{L}\\p{N}]+|(?<!\\d)\\.|\\.(?!\\d)", "")))

    return F.array_sort(F.transform(F.filter(F.split(low, "[;|\\n]|,(?![0-9])"), lambda x: x.rlike("[\\p{L}\\p{N}]")), entry))


@dataclass(frozen=True)
class RecordShape:
    """Identifier column, and each field's node builder; other columns don't count."""

    key: str
    fields: dict


COMPOUND = RecordShape("compound_id", {"smiles": structure_node, "target": code_node, "e3_ligase": code_node, "activity": entries_node, "reference": code_node})
STOCK = RecordShape("id", {"smiles": structure_node, "inchi_key": code_node})


def digests(df: DataFrame, shape: RecordShape) -> DataFrame:
    """id, tree (the normalised record), digest (of its root), made from the leaves up."""
    nodes = df.select(F.col(shape.key).cast("long").alias("id"), *(make(F.col(name).cast("string")).alias(f"f{i}") for i, (name, make) in enumerate(shape.fields.items())))
    names = [f"f{i}" for i in range(len(shape.fields))]
    fields = [F.md5(F.concat_ws("|", F.lit(str(i)), F.transform(n, lambda x: F.md5(x)))) for i, n in enumerate(names)]
    return nodes.select("id", F.to_json(F.struct(*names)).alias("tree"), F.md5(F.concat_ws("|", *fields)).alias("digest"))


def records(df: DataFrame, shape: RecordShape) -> DataFrame:
    """keep_id, n_copies: one row for each record, n_copies counting the rows that write it, itself among them.

    keep_id is the smallest identifier. Null and blank fields are alike. Rows that are blank all over are one
    record. Repeated rows count each.
    """
    return digests(df, shape).groupBy("digest", "tree").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")).select("keep_id", "n_copies")


def copies(df: DataFrame, shape: RecordShape) -> DataFrame:
    """keep_id, copy_id: each row but the one with the smallest identifier, for every record that stands more than once.

    Rows without identifier can't be named and are left out. A group of any size is spread over salted keys.
    """
    scratch = Scratch(df.sparkSession)
    made = scratch.keep(digests(df.filter(F.col(shape.key).isNotNull()), shape))  # trees are made once
    groups = scratch.keep(made.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("keep_id")).filter("n > 1").drop("n"))
    groups = groups.join(made.select(F.col("id").alias("keep_id"), "digest", F.col("tree").alias("kept")), ["keep_id", "digest"]).distinct()
    pairs = scratch.keep(made.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(replicated(groups), ["digest", "_salt"]).select("digest", "tree", "kept", "id", "keep_id"))
    scratch.drop(but=1)
    same = pairs.filter("tree = kept and id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
    # Of equal digests but unequal trees, the trees decide.
    other = pairs.filter("tree <> kept").select("digest", "tree", "id")
    first = other.groupBy("digest", "tree").agg(F.min("id").alias("keep_id"))
    rest = other.join(first, ["digest", "tree"]).filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
    return same.unionByName(rest)

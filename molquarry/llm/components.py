"""Connected components two ways, both as joins of tables: nothing of the graph reaches the driver but counts.

``min_labels`` (problem 2) propagates minimum labels along edges, jumps pointers and contracts the edges by the
new labels; ``hook_and_shortcut`` (problem 6) keeps a parent table, hooks roots onto smaller ones and halves paths.
Every round ends in a written table of the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.runtime import Scratch


def simple_edges(df: DataFrame, left: str, right: str) -> DataFrame:
    """Each undirected edge once as (a, b) with a < b; without null ends and self pairs."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter((a != b) & a.isNotNull() & b.isNotNull()).distinct()


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges(a, b); label is the smallest node of its component.

    A round gives every node the first label around it, lets pointers jump to the labels' labels until none moves,
    and replaces the edges' ends by their labels; edges within a label vanish. No edge left means that no label
    changes any more. What is first is told by a hash that each round has of its own: only nodes ahead of all their
    neighbours keep their label, with d neighbours one in d + 1, so in the mean half of them at most are left
    whatever the numbering, and rounds grow with the logarithm. Last, each component takes its smallest node.
    Empty edges give no rows.
    """
    spark = edges.sparkSession
    scratch, rounds = Scratch(spark), []
    edges = scratch.keep(edges)
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x")).select("x.*")
        first = lambda c: F.xxhash64(F.col(c), F.lit(len(rounds)))  # noqa: B023, E731
        ahead = (first("u") < first("v")) | ((first("u") == first("v")) & (F.col("u") < F.col("v")))
        labels = ends.groupBy("v").agg(F.min_by("u", first("u")).alias("u")).select("v", F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("l"))
        labels = scratch.keep(labels)
        while True:  # pointers double until none moves, so that a chain of any length falls to its end
            to = labels.select(F.col("v").alias("l"), F.col("l").alias("up"))
            labels = scratch.keep(labels.join(to, "l").select("v", F.col("up").alias("l"), (F.col("up") != F.col("l")).alias("moved")))
            if labels.filter("moved").isEmpty():
                break
            labels = labels.select("v", "l")
        labels = labels.select("v", "l")
        rounds.append(labels)
        la = labels.select(F.col("v").alias("a"), F.col("l").alias("la"))
        lb = labels.select(F.col("v").alias("b"), F.col("l").alias("lb"))
        edges = scratch.keep(simple_edges(edges.join(la, "a").join(lb, "b"), "la", "lb"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # From the last, smallest round back to the first: a label that was itself relabelled later follows.
    got = rounds.pop()
    while rounds:
        later = got.select(F.col("v").alias("l"), F.col("l").alias("up"))
        got = rounds.pop().join(later, "l", "left").select("v", F.coalesce("up", "l").alias("l"))
    got = scratch.keep(got)
    smallest = got.groupBy("l").agg(F.min("v").alias("label"))  # combined before the shuffle, however large a component is
    got = scratch.keep(got.join(smallest, "l").select(F.col("v").alias("node"), "label"))
    scratch.drop(but=1)
    return got


def hook_and_shortcut(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b); root is the smallest node of its component.

    The parent table begins with every node its own parent. A round hooks, over all edges between different
    parents, the larger parent onto the smallest parent seen, then replaces each parent by the parent's parent
    until that changes nothing. Empty edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    parents = scratch.keep(nodes.withColumn("p", F.col("v")))
    while True:
        pa, pb = (parents.select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        # Edges take over their ends' parents, so that they shrink as trees grow together.
        edges = scratch.keep(simple_edges(edges.join(pa, "a").join(pb, "b"), "pa", "pb"))
        if edges.isEmpty():
            break
        hooks = edges.groupBy(F.col("b").alias("p")).agg(F.min("a").alias("to"))
        parents = scratch.keep(parents.join(hooks, "p", "left").select("v", F.coalesce("to", "p").alias("p")))
        while True:
            up = parents.select(F.col("v").alias("p"), F.col("p").alias("up"))
            parents = scratch.keep(parents.join(up, "p").select("v", F.col("up").alias("p"), (F.col("up") != F.col("p")).alias("moved")))
            if parents.filter("moved").isEmpty():
                break
        parents = parents.select("v", "p")
    got = scratch.keep(parents)
    scratch.drop(but=1)
    return got.select(F.col("v").alias("node"), F.col("p").alias("root"))


def group_rows(rows: DataFrame, key: str, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(group_id, key): the smallest key linked directly or indirectly, for every non-null key of rows once.

    A pair counts only if both its ends are keys of rows. Rows with null keys have no group and are left out;
    repeated keys are one; null ends, self pairs and repeats of pairs change nothing.
    """
    keys = rows.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    edges = simple_edges(pairs, left, right)
    for end in "ab":
        edges = edges.join(keys.select(F.col(key).alias(end)), end, "left_semi")
    labels = min_labels(edges).withColumnRenamed("node", key)
    return keys.join(labels, key, "left").select(F.coalesce("label", key).alias("group_id"), key)

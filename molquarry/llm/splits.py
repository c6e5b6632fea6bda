"""Train, validation and test parts that never part linked rows (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molquarry.functions.text import strip_blanks
from molquarry.llm.components import hook_and_shortcut, simple_edges
from molquarry.runtime import Scratch

#: Bits of the subset-sum tables of one part that are kept together; beyond, tables are made again.
MAX_BITS = 1 << 29
#: Components of one size are numbered in so many buckets, none of which is sorted as a whole.
BUCKETS = 256


def closest_subset(sizes: dict[int, int], target: int, max_bits: int = MAX_BITS) -> dict[int, int]:
    """{size: how many} with a total as near to target as any choice gets; sizes is {size: how many there are}.

    Sums are bits of one integer; a size with many members is added in powers of two. Sizes of one fill up any
    gap and need no table. Tables that together would pass max_bits are not all kept: they are made again for each
    half of the pieces, so the choice stays the nearest and a table for each halving is held.
    """
    taken: dict[int, int] = {}
    pieces = []
    for size, many in sorted(sizes.items(), reverse=True):
        if size <= 1 or size > 2 * target:
            continue
        k, left = 1, min(many, 2 * target // size)
        while left:
            k = min(k, left)
            pieces.append((size, k))
            left, k = left - k, 2 * k
    ones = sizes.get(1, 0)
    mask, sums = (1 << (2 * target + 1)) - 1, 1
    for size, k in pieces:
        sums |= (sums << size * k) & mask
    low = sums & ((1 << (target + 1)) - 1)
    under = low.bit_length() - 1
    above = sums >> (target + 1)
    over = target + 1 + ((above & -above).bit_length() - 1) if above else None
    fill = min(ones, target - under)
    at = under
    if over is not None and over - target < target - under - fill:
        at, fill = over, 0
    if fill:
        taken[1] = taken.get(1, 0) + fill
    open_ = [(0, len(pieces), 1)]  # stretches of pieces, the last on top, with the sums before each
    while open_:
        low_, high, had = open_.pop()
        if high - low_ > 1 and (high - low_) * 2 * target > max_bits:
            middle, then = (low_ + high) // 2, had
            for size, k in pieces[low_:middle]:
                then |= (then << size * k) & mask
            open_ += [(low_, middle, had), (middle, high, then)]
            continue
        before = []
        for size, k in pieces[low_:high]:
            before.append(had)
            had |= (had << size * k) & mask
        for (size, k), had in zip(reversed(pieces[low_:high]), reversed(before)):
            if not had >> at & 1:
                taken[size], at = taken.get(size, 0) + k, at - size * k
    return {s: n for s, n in taken.items() if n}


def linked_components(df: DataFrame, key: str, links: list[str]) -> DataFrame:
    """(key, component): rows that share a non-null, non-blank value of any column of links, also through other rows.

    component is the smallest key of it. Outer blanks don't count. Rows of equal keys are one row; null keys are
    left out.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *(F.nullif(strip_blanks(F.col(c).cast("string")), F.lit("")).alias(f"k{i}") for i, c in enumerate(links)))
    scratch = Scratch(df.sparkSession)
    rows = scratch.keep(rows)  # values are trimmed once
    edges = None
    for i in range(len(links)):
        own = rows.filter(F.col(f"k{i}").isNotNull()).select("id", f"k{i}")
        first = own.groupBy(f"k{i}").agg(F.min("id").alias("first"))  # combined before the shuffle, however hot a value is
        linked = own.join(first, f"k{i}").select("id", "first")
        edges = linked if edges is None else edges.unionByName(linked)
    roots = hook_and_shortcut(simple_edges(edges, "id", "first"))
    return rows.select("id").distinct().join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(key), F.coalesce("root", "id").alias("component"))


def grouped_splits(df: DataFrame, key: str, links: list[str], shares: tuple[tuple[str, float], ...] = (("validation", 0.1), ("test", 0.1)), rest: str = "train") -> DataFrame:
    """(key, component, split) for every non-null key of df.

    Components go whole to one part; the totals of the parts come as near to their shares as subsets of the
    component sizes allow, what no part takes goes to `rest`. Of equal sizes, a hash of the component decides.
    Only the multiplicities of sizes come to the driver: no more than the square root of twice the rows.
    """
    members = Scratch(df.sparkSession).keep(linked_components(df, key, links))
    components = members.groupBy("component").agg(F.count("*").alias("size"))
    there = {r["size"]: r["n"] for r in components.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total, left, plan = sum(s * n for s, n in there.items()), dict(there), []
    upto: dict[int, int] = {}
    for name, share in shares:
        chosen = closest_subset(left, round(total * share))
        for s, n in chosen.items():
            low = upto.get(s, 0)
            plan.append((s, low, low + n, name))
            upto[s], left[s] = low + n, left[s] - n
    plan = df.sparkSession.createDataFrame(plan or [(-1, 0, 0, rest)], "size long, low long, high long, split string")
    numbered = components.withColumn("_h", F.xxhash64("component")).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    by_size = Window.partitionBy("size").orderBy("_b")
    offsets = numbered.groupBy("size", "_b").agg(F.count("*").alias("n")).withColumn("_o", F.sum("n").over(by_size) - F.col("n")).drop("n")
    within = Window.partitionBy("size", "_b").orderBy("_h", "component")
    numbered = numbered.withColumn("_r", F.row_number().over(within)).join(offsets, ["size", "_b"]).withColumn("_r", F.col("_r") + F.col("_o"))
    assigned = numbered.join(plan, (numbered["size"] == plan["size"]) & (F.col("_r") > F.col("low")) & (F.col("_r") <= F.col("high")), "left").select("component", F.coalesce("split", F.lit(rest)).alias("split"))
    return members.join(assigned, "component").select(key, "component", "split")

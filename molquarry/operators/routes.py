"""Route trees: literal cells to reactions, structural metrics, scores, layouts.

A route stays in its row as an array of reactions; metrics are higher-order expressions over it, so scoring a table
shuffles nothing and stays in the JVM.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from molquarry.functions import scores
from molquarry.functions.smiles import atom_count
from molquarry.functions.text import let, strip_blanks, truthy

REACTIONS = "array<struct<depth:int,product:string,reactants:array<string>,label:string>>"


@dataclass(frozen=True)
class ScoringConfig:
    """Column names, weights of the length, coupling and balance terms, and the anchors of empty routes."""

    resolved: str = "resolved"
    route: str = "route"
    weights: dict = field(default_factory=lambda: {"lls": 0.5, "coupling": 0.0, "balance": 0.5})
    neutral_balance: float = 0.5
    lls_max: float = 11.0
    ceiling: float = 1.0
    floor: float = 0.0


#: A quoted text whose escapes mean the same in Python and in JSON; marks of a text, a reaction, a level once they are read.
_QUOTED = """'[^'\\\\]*+(?:\\\\[\\\\'"nrtbf][^'\\\\]*+)*+'|"[^"\\\\]*+(?:\\\\[\\\\'"nrtbf][^"\\\\]*+)*+\""""
_LEVELS = "map<string,array<array<string>>>"


def _plain(c: Column) -> Column:
    """Whether a literal is a map of numbers to lists of lists of one or two quoted texts, so that it is JSON but for its quotes."""
    bare = F.regexp_replace(F.translate(c, "\x01\x02\x03", "???"), _QUOTED, "\x01")
    for pattern, mark in (("\\s++", ""), ("\\[\x01(?:,(?:\x01|None))?+,?\\],?", "\x02"), ("[0-9]++:\\[\x02*+\\],?", "\x03")):
        bare = F.regexp_replace(bare, pattern, mark)
    # A comma stands between elements or after the last: both are Python, and after the last it isn't JSON.
    return bare.rlike("^\\{\x03*+\\}$") & ~c.rlike(",\\s*+[\\]}]|[\\x00-\\x1f]")


@F.pandas_udf(StringType())
def _literal_json(texts: pd.Series) -> pd.Series:
    """Any other literal as JSON: tuples, adjacent texts, escapes. Null for what is no map of lists of reactions."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            got = ast.literal_eval(text.strip())
            if not isinstance(got, dict):
                return None
            text_of = lambda x: x if x is None or isinstance(x, str) else str(x)
            return json.dumps({str(k): [[text_of(x) for x in e] for e in v if isinstance(e, (list, tuple)) and e] for k, v in got.items() if isinstance(v, (list, tuple))})
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    return texts.map(one)


def parsed_literal(c: Column) -> Column:
    """The map of depth to [[reaction, label], ...] that a Python literal writes; null if blank or malformed.

    Plain literals are read in the JVM; only the others' texts are handed to Python's own literal parser.
    """
    options = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    none = F.contains(c, F.lit("None"))
    outside = F.regexp_count(F.regexp_replace(c, _QUOTED, ""), F.lit("None")) == F.regexp_count(c, F.lit("None"))
    plain = _plain(c) & F.when(none, outside).otherwise(True)
    written = F.when(plain, F.when(none, F.regexp_replace(c, "None(?=\\s*+\\])", "null")).otherwise(c))
    hard = F.when(~plain & (F.coalesce(strip_blanks(c), F.lit("")) != ""), c)
    return F.from_json(F.coalesce(written, _literal_json(hard)), _LEVELS, options)


def reactions(c: Column) -> Column:
    """All reactions of a parsed route in order of depth: split once at =>, reactants at dots, blanks dropped.

    Entries without => are left out. Null for a null map.
    """
    one = lambda depth, x: F.struct(
        depth.try_cast("int").alias("depth"),
        F.trim(F.regexp_extract(x[0], "(?s)^(.*?)=>", 1)).alias("product"),
        F.filter(F.transform(F.split(F.regexp_extract(x[0], "(?s)=>(.*)$", 1), "\\."), lambda r: F.trim(r)), lambda r: r != "").alias("reactants"),
        F.get(x, F.lit(1)).alias("label"),
    )
    steps = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(F.filter(e["value"], lambda x: F.coalesce(F.get(x, F.lit(0)).contains("=>"), F.lit(False))), lambda x: one(e["key"], x))))
    return steps.cast(REACTIONS)


def products(r: Column) -> Column:
    return F.array_distinct(F.transform(r, lambda x: x["product"]))


def reactants(r: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(r, lambda x: x["reactants"])))


def leaves(r: Column) -> Column:
    """Reactants that nothing makes."""
    return F.array_except(reactants(r), products(r))


def root(r: Column) -> Column:
    """The product that nothing uses; of several the least, so that runs agree. Null without one."""
    return F.array_min(F.array_except(products(r), reactants(r)))


def intermediates(r: Column) -> Column:
    return F.array_except(products(r), F.array(root(r)))


def children(r: Column) -> Column:
    """Map of each product to its first reaction's reactants."""
    names = products(r)
    return F.map_from_arrays(names, F.transform(names, lambda p: F.filter(r, lambda x: x["product"] == p)[0]["reactants"]))


def longest_line(r: Column, start: Column) -> Column:
    """Reactions on the longest way from start to a leaf; a node met again on its own way ends it.

    A level has each node once, however many ways lead there, so without a cycle the last level is as deep as the
    longest way. Levels that outnumber the reactions show a cycle; only then ways are followed one by one.
    """
    made = lambda nodes: F.filter(r, lambda x: F.array_contains(nodes, x["product"]))

    def deeper(state: Column, _: Column) -> Column:
        below = made(state["nodes"])
        nodes = F.array_distinct(F.flatten(F.transform(below, lambda x: x["reactants"])))
        return F.struct(nodes.alias("nodes"), (state["depth"] + F.least(F.size(below), F.lit(1))).alias("depth"))

    begin = F.struct(F.array(start).alias("nodes"), F.lit(0).alias("depth"))
    levels = F.aggregate(F.sequence(F.lit(1), F.size(r) + 1), begin, deeper, lambda state: state["depth"])
    return let(levels, lambda n: F.when(n <= F.size(r), n).otherwise(_longest_way(r, start)))


def _longest_way(r: Column, start: Column) -> Column:
    """longest_line by all ways at once, each an array of nodes: for routes that run into a cycle."""
    last = lambda way: F.element_at(way, -1)
    grows = lambda way: F.exists(r, lambda x: x["product"] == last(way)) & ~F.array_contains(F.slice(way, 1, F.size(way) - 1), last(way))
    below = lambda way: F.flatten(F.transform(F.filter(r, lambda x: x["product"] == last(way)), lambda x: x["reactants"]))

    def longer(state: Column, _: Column) -> Column:
        growing = F.filter(state["ways"], grows)
        ways = F.flatten(F.transform(growing, lambda way: F.transform(F.array_distinct(below(way)), lambda c: F.array_append(way, c))))
        return F.struct(ways.alias("ways"), (state["depth"] + F.least(F.size(growing), F.lit(1))).alias("depth"))

    begin = F.struct(F.array(F.array(start)).alias("ways"), F.lit(0).alias("depth"))
    return F.aggregate(F.sequence(F.lit(1), F.size(r)), begin, longer, lambda state: state["depth"])


def step_balance(counts: Column) -> Column:
    """Mean of the smaller over the larger count of all pairs; null for fewer than two usable counts."""

    def balance(c: Column) -> Column:
        pairs = F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda b: F.try_divide(F.least(a, b), F.greatest(a, b)))))
        return F.aggregate(F.array_compact(pairs), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))

    return let(counts, balance)


def heavy_atoms(c: Column) -> Column:
    """Atoms by pattern, one at least."""
    return F.greatest(atom_count(c), F.lit(1))


def fragment_balance(r: Column, neutral: float = 0.5) -> Column:
    """Mean step balance over the steps that join two or more; neutral without such steps."""
    joined = F.filter(r, lambda x: F.size(x["reactants"]) >= 2)
    each = F.filter(F.transform(joined, lambda x: step_balance(F.transform(x["reactants"], heavy_atoms))), lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.size(each)), F.lit(neutral))


def with_reactions(df: DataFrame, route: str) -> DataFrame:
    """df with `reactions`: of the literal cell, null for blank and malformed ones, [] for routes without a step."""
    return df.withColumn("reactions", reactions(parsed_literal(F.col(route))))


def score_routes(df: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """df with tier, synthesizability, struct_* and score_note; columns of these names are replaced.

    A route without any step counts as empty: the ceiling if resolved, the floor if not, metrics null. Text
    booleans are read as such, null as false. Malformed routes are empty ones, and their note says so.
    """
    own = ["tier", "synthesizability", "score_note", *(f"struct_{n}" for n in ("n_steps", "n_bb", "max_depth", "lls", "coupling_fraction", "avg_branching", "fragment_balance"))]
    df = with_reactions(df.drop(*own), config.route)
    r = F.col("reactions")
    n = F.size(r)
    there = r.isNotNull() & (n > 0)
    df = df.withColumn("struct_lls", F.when(there, F.coalesce(longest_line(r, root(r)), F.lit(0))))
    couplings = F.size(F.filter(r, lambda x: F.size(x["reactants"]) >= 2))
    branches = F.aggregate(F.transform(r, lambda x: F.size(x["reactants"])), F.lit(0), lambda a, x: a + x)
    df = df.withColumns({
        "struct_n_steps": F.when(there, n),
        "struct_n_bb": F.when(there, F.size(leaves(r))),
        "struct_max_depth": F.when(there, F.array_max(F.transform(r, lambda x: x["depth"]))),
        "struct_coupling_fraction": F.when(there, couplings / n),
        "struct_avg_branching": F.when(there, branches / n),
        "struct_fragment_balance": F.when(there, fragment_balance(r, config.neutral_balance)),
    })
    w = config.weights
    structural = scores.weighted_mean({"lls": scores.length_term(F.col("struct_lls"), config.lls_max), "coupling": F.col("struct_coupling_fraction"), "balance": F.col("struct_fragment_balance")}, w)
    solved = F.coalesce(truthy(F.col(config.resolved)), F.lit(False))
    tier = F.when(there, F.when(solved, "solved").otherwise("unresolved")).otherwise(F.when(solved, "purchasable").otherwise("unsolved"))
    notes = {"solved": "fully solved", "unresolved": "partial route", "purchasable": "purchasable as it is", "unsolved": "no route found"}
    df = df.withColumns({"tier": tier, "synthesizability": F.when(there, structural).when(solved, F.lit(config.ceiling)).otherwise(F.lit(config.floor))})
    note = F.create_map(*(F.lit(x) for kv in notes.items() for x in kv))[F.col("tier")]
    malformed = r.isNull() & (F.coalesce(strip_blanks(F.col(config.route)), F.lit("")) != "")
    return df.withColumn("score_note", F.when(malformed, F.concat(note, F.lit("; malformed route"))).otherwise(note))


def shaped_candidates(df: DataFrame, resolved: str = "resolved", steps: tuple[int, int] = (2, 4), blocks: tuple[int, int] = (2, 4)) -> DataFrame:
    """Scored, resolved routes with a target whose steps and building blocks are in the closed windows."""
    own = df.filter(truthy(F.col(resolved)) & (F.size("reactions") > 0) & root(F.col("reactions")).isNotNull())
    return own.filter(F.col("struct_n_steps").between(*steps) & F.col("struct_n_bb").between(*blocks))


def flat_reactions(df: DataFrame, key: str) -> DataFrame:
    """key, step (from 0), depth, product, reactants, label: one row a reaction."""
    return df.select(key, F.posexplode("reactions").alias("step", "_r")).select(key, "step", "_r.*")


def route_roles(df: DataFrame, key: str) -> DataFrame:
    """key, node, role: target, intermediate or building block."""
    r = F.col("reactions")
    node = F.explode(F.array_union(products(r), reactants(r)))
    return df.filter(F.size(r) > 0).select(key, root(r).alias("_t"), leaves(r).alias("_l"), node.alias("node")).select(
        key, "node", F.when(F.col("node") == F.col("_t"), "target").when(F.array_contains("_l", F.col("node")), "building block").otherwise("intermediate").alias("role")
    )


def tree_layout(df: DataFrame, key: str) -> DataFrame:
    """key, node, x (depth from the target), y: leaves in order, parents at the mean of their children."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, steps, target in zip(b[key], b["reactions"], b["_root"]):
                below: dict = {}
                for s in steps:
                    below.setdefault(s["product"], list(s["reactants"]))
                depth, queue = {target: 0}, [target]
                for node in queue:
                    for c in below.get(node, ()):
                        if c not in depth:
                            depth[c] = depth[node] + 1
                            queue.append(c)
                place: dict = {}
                stack, row = [(target, False)], 0
                entered = set()
                while stack:
                    node, done = stack.pop()
                    own = [c for c in below.get(node, ()) if depth.get(c, 0) == depth[node] + 1]
                    if done:
                        place[node] = sum(place[c] for c in own) / len(own)
                    elif node not in entered:
                        entered.add(node)
                        if own:
                            stack.append((node, True))
                            stack += [(c, False) for c in reversed(own)]
                        else:
                            place[node], row = float(row), row + 1
                out += [(k, n, d, place.get(n)) for n, d in depth.items()]
            yield pd.DataFrame(out, columns=[key, "node", "x", "y"])

    kind = dict(df.dtypes)[key]
    own = df.filter(F.size("reactions") > 0).select(key, "reactions", root(F.col("reactions")).alias("_root")).filter("_root is not null")
    return own.mapInPandas(run, f"{key} {kind}, node string, x int, y double")


# Route records -------------------------------------------------------------------------------------------------------------


def solved_flag(in_stock: Column) -> Column:
    """Whether all of an array of stock flags are true; true for none, null flags are false."""
    return F.forall(in_stock, lambda x: F.coalesce(x, F.lit(False)))


def available_share(weights: Column, in_stock: Column) -> Column:
    """An aggregate: weight in stock over all weight, 0 where there is no weight."""
    return F.coalesce(F.try_divide(F.sum(F.when(in_stock, weights).otherwise(0)), F.sum(weights)), F.lit(0.0))


def record_report(df: DataFrame, solved: str, metrics: list[str]) -> DataFrame:
    """solved, metric and n, mean, population std, min, median, p90, p95, max: one row for each of both groups and metric."""
    long = df.select(F.col(solved).alias("solved"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("_s")).select("solved", "_s.*")
    p = lambda q: F.percentile("x", q)
    return long.groupBy("solved", "metric").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max("x").alias("max"),
    )

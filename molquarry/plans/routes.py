"""Queries of route trees and route records on the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.chem.backend import TextBackend
from molquarry.functions import scores
from molquarry.functions import smiles as S
from molquarry.operators import routes as RT
from molquarry.operators.flatten import child_table
from molquarry.plans.problems import _ELEMENTS
from molquarry.plans.stats import rounded
from molquarry.runtime import table
from molquarry.sources.sinks import route_table

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


#: Reactions of all routes in SQL: the literal turned to JSON, depths and steps unnested.
_RX = """cells AS (
  SELECT row_id, resolved, CASE WHEN regexp_full_match(trim(route), '(?s)\\{.*\\}') THEN try_cast(regexp_replace(replace(route, '''', '"'), '([{,] ?)([0-9]+):', '\\1"\\2":', 'g') AS JSON) END AS j FROM routes_scored
), depths AS (SELECT row_id, unnest(json_keys(j)) AS depth, j FROM cells WHERE j IS NOT NULL),
steps AS (SELECT row_id, depth::INT AS depth, unnest(from_json(json_extract(j, '$."' || depth || '"'), '["JSON"]')) AS x FROM depths),
rx AS (SELECT row_id, depth, trim(split_part(x->>0, '=>', 1)) AS product, list_filter(list_transform(string_split(trim(substr(x->>0, position('=>' IN x->>0) + 2)), '.'), lambda r: trim(r)), lambda r: r <> '') AS reactants, x->>1 AS label FROM steps WHERE (x->>0) LIKE '%=>%')"""
_METRICS = f"""{_RX}, made AS (SELECT row_id, list_distinct(list(product)) AS products FROM rx GROUP BY 1),
used AS (SELECT row_id, list_distinct(flatten(list(reactants))) AS reactants FROM rx GROUP BY 1),
base AS (SELECT row_id, count(*)::INT AS n_steps, max(depth)::INT AS max_depth, avg((len(reactants) >= 2)::INT) AS coupling, avg(len(reactants)) AS branching FROM rx GROUP BY 1),
sets AS (SELECT row_id, list_min(list_filter(products, lambda p: NOT list_contains(reactants, p))) AS root, len(list_filter(reactants, lambda r: NOT list_contains(products, r)))::INT AS n_bb FROM made JOIN used USING (row_id))"""


@query(f"WITH {_RX} SELECT row_id, depth, product, array_to_string(reactants, '.') AS reactants, label FROM rx")
def route_reactions(s, d):
    own = RT.flat_reactions(RT.with_reactions(table(s, d, "routes_scored").select("row_id", "route"), "route"), "row_id")
    return own.select("row_id", "depth", "product", F.array_join("reactants", ".").alias("reactants"), "label")


@query(f"WITH {_METRICS} SELECT row_id, n_steps, n_bb, max_depth, round(coupling, 6) AS coupling, round(branching, 6) AS branching FROM base JOIN sets USING (row_id)")
def route_shapes(s, d):
    own = RT.score_routes(table(s, d, "routes_scored").select("row_id", "resolved", "route")).filter("struct_n_steps is not null")
    return rounded(own.select("row_id", F.col("struct_n_steps").alias("n_steps"), F.col("struct_n_bb").alias("n_bb"), F.col("struct_max_depth").alias("max_depth"), F.col("struct_coupling_fraction").alias("coupling"), F.col("struct_avg_branching").alias("branching")))


@query(f"WITH RECURSIVE {_METRICS}, walk(row_id, node, n) AS (SELECT row_id, root, 0 FROM sets UNION ALL SELECT walk.row_id, unnest(rx.reactants), n + 1 FROM walk JOIN rx ON walk.row_id = rx.row_id AND walk.node = rx.product WHERE n < 40) SELECT row_id, max(n)::INT AS lls FROM walk GROUP BY 1")
def route_lines(s, d):
    own = RT.score_routes(table(s, d, "routes_scored").select("row_id", "resolved", "route")).filter("struct_lls is not null")
    return own.select("row_id", F.col("struct_lls").alias("lls"))


_SCORED = f"""{_METRICS}, walk(row_id, node, n) AS (SELECT row_id, root, 0 FROM sets UNION SELECT walk.row_id, unnest(rx.reactants), n + 1 FROM walk JOIN rx ON walk.row_id = rx.row_id AND walk.node = rx.product WHERE n < 40),
lines AS (SELECT row_id, max(n)::INT AS lls FROM walk GROUP BY 1),
counts AS (SELECT row_id, list_transform(reactants, lambda r: {{atoms}}) AS c FROM rx WHERE len(reactants) >= 2),
ratios AS (SELECT row_id, list_avg(flatten(list_transform(range(1, len(c) + 1), lambda i: list_transform(c[i + 1:], lambda b: least(c[i], b)::DOUBLE / greatest(c[i], b))))) AS x FROM counts),
balances AS (SELECT row_id, coalesce(avg(x), 0.5) AS balance FROM (SELECT DISTINCT row_id FROM rx) LEFT JOIN ratios USING (row_id) GROUP BY 1),
truth AS (SELECT row_id, smiles, resolved, root, coalesce(lower(trim(resolved)) IN ('true', '1', '1.0', 'yes', 't'), false) AS solved, n_steps, n_bb, max_depth, lls, coupling, branching, balance, trim(coalesce(route, '')) <> '' AND j IS NULL AS malformed
  FROM routes_scored LEFT JOIN (SELECT row_id, j FROM cells) USING (row_id) LEFT JOIN base USING (row_id) LEFT JOIN sets USING (row_id) LEFT JOIN lines USING (row_id) LEFT JOIN balances USING (row_id))"""
_ATOMS = "greatest(len(regexp_extract_all(r, '\\[[^\\]]*\\]|Cl|Br|[BCNOPSFIbcnops]')) - len(regexp_extract_all(r, '\\[[0-9]*H[0-9]*[+-]?[0-9]*\\]')), 1)"


_SCORED = "WITH RECURSIVE " + _SCORED.replace("{atoms}", _ATOMS)


@query(f"WITH {_RX}, counts AS (SELECT row_id, list_transform(reactants, lambda r: {_ATOMS}) AS c FROM rx WHERE len(reactants) >= 2), ratios AS (SELECT row_id, list_avg(flatten(list_transform(range(1, len(c) + 1), lambda i: list_transform(c[i + 1:], lambda b: least(c[i], b)::DOUBLE / greatest(c[i], b))))) AS x FROM counts) SELECT row_id, round(coalesce(avg(x), 0.5), 6) AS balance FROM (SELECT DISTINCT row_id FROM rx) LEFT JOIN ratios USING (row_id) GROUP BY 1")
def route_balance(s, d):
    own = RT.score_routes(table(s, d, "routes_scored").select("row_id", "resolved", "route")).filter("struct_n_steps is not null")
    return rounded(own.select("row_id", F.col("struct_fragment_balance").alias("balance")))


@query(f"WITH {_RX}, n AS (SELECT row_id, count(*) AS n FROM rx GROUP BY 1) SELECT CASE WHEN n.n IS NOT NULL THEN CASE WHEN t THEN 'solved' ELSE 'unresolved' END WHEN t THEN 'purchasable' ELSE 'unsolved' END AS tier, count(*) AS n FROM (SELECT row_id, coalesce(lower(trim(resolved)) IN ('true', '1', '1.0', 'yes', 't'), false) AS t FROM routes_scored) LEFT JOIN n USING (row_id) GROUP BY 1")
def route_tiers(s, d):
    return RT.score_routes(table(s, d, "routes_scored").select("row_id", "resolved", "route")).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"{_SCORED} SELECT row_id, smiles, resolved, n_steps AS struct_n_steps, n_bb AS struct_n_bb, max_depth AS struct_max_depth, lls AS struct_lls, round(coupling, 6) AS struct_coupling_fraction, round(branching, 6) AS struct_avg_branching, round(balance, 6) AS struct_fragment_balance, CASE WHEN n_steps IS NOT NULL THEN CASE WHEN solved THEN 'solved' ELSE 'unresolved' END WHEN solved THEN 'purchasable' ELSE 'unsolved' END AS tier, round(CASE WHEN n_steps IS NOT NULL THEN 0.5 * greatest(0, 1 - (greatest(lls, 1) - 1) / 10.0) + 0.5 * balance WHEN solved THEN 1.0 ELSE 0.0 END, 6) AS synthesizability, CASE WHEN n_steps IS NOT NULL THEN CASE WHEN solved THEN 'fully solved' ELSE 'partial route' END WHEN solved THEN 'purchasable as it is' ELSE 'no route found' END || CASE WHEN malformed THEN '; malformed route' ELSE '' END AS score_note FROM truth")
def route_scores(s, d):
    own = RT.score_routes(table(s, d, "routes_scored").select("row_id", "smiles", "resolved", "route"))
    return rounded(own.drop("reactions", "route"))


@query(f"WITH {_METRICS} SELECT rx.row_id, CASE WHEN node = root THEN 'target' ELSE 'building_block' END AS role, node AS smiles FROM (SELECT DISTINCT row_id, unnest(list_concat([product], reactants)) AS node FROM rx) rx JOIN sets USING (row_id) JOIN made USING (row_id) WHERE node = root OR NOT list_contains(products, node)")
def route_ends(s, d):
    return route_table(RT.with_reactions(table(s, d, "routes_scored").select("row_id", "route"), "route"), "row_id")


@query()
def route_layouts(s, d):
    return RT.tree_layout(RT.with_reactions(table(s, d, "routes_scored").select("row_id", "route"), "route"), "row_id")


@query(f"{_SCORED} SELECT row_id, smiles, n_steps AS struct_n_steps, n_bb AS struct_n_bb FROM truth WHERE solved AND root IS NOT NULL AND n_steps BETWEEN 2 AND 4 AND n_bb BETWEEN 2 AND 4")
def shaped_routes(s, d):
    own = RT.score_routes(table(s, d, "routes_scored").select("row_id", "smiles", "resolved", "route"))
    return RT.shaped_candidates(own).select("row_id", "smiles", "struct_n_steps", "struct_n_bb")


_TERM = {"linear": "greatest(least(1 - (lls - 1) / 10.0, 1), 0)", "log": "greatest(least(1 - ln(greatest(lls, 1)) / ln(11), 1), 0)", "coupling": "coupling", "balance": "balance", "branching": "greatest(least(branching - 1, 1), 0)", "convergence": "(1 - lls / n_steps::DOUBLE)"}
_DESIGNED = ", ".join(f"round(({' + '.join(f'{w} * ' + _TERM[kind if t == 'depth' else t] for t, w in own.items())}) / {sum(own.values())}, 6) AS {n}" for n, (kind, own) in scores.DESIGNS.items())


@query(f"{_SCORED} SELECT row_id, {_DESIGNED} FROM truth WHERE lls IS NOT NULL")
def design_scores(s, d):
    own = RT.score_routes(table(s, d, "routes_scored").select("row_id", "resolved", "route")).filter("struct_lls is not null")
    made = scores.design_variants(F.col("struct_lls"), F.col("struct_n_steps"), F.col("struct_coupling_fraction"), F.col("struct_avg_branching"), F.col("struct_fragment_balance"))
    return rounded(own.select("row_id", *(c.alias(n) for n, c in made.items())))


_PRECURSORS = f"""{_ELEMENTS}, held AS (SELECT record_id, CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' WHEN json_type(x) = 'OBJECT' THEN x->>'$.precursor_smiles' END AS r, coalesce(lower(CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.in_stock' END) = 'true', false) AS f FROM items WHERE child = 'precursor'),
kept AS (SELECT record_id, f, {_ATOMS.replace("(r,", "(coalesce(r, ''),")} AS a FROM held),
available AS (SELECT record_id, count(*) AS n_precursors, round(coalesce(sum(CASE WHEN f THEN a ELSE 0 END)::DOUBLE / nullif(sum(a), 0), 0), 6) AS available, bool_and(f) AS solved FROM kept GROUP BY 1)"""
_SPREAD = "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS max"


@query(f"{_PRECURSORS} SELECT record_id, n_precursors, available, solved FROM available")
def record_availability(s, d):
    """Of each record: number of precursors, share in stock by atoms, whether all are in stock."""
    own = child_table(table(s, d, "route_records"), "record_id", "precursor")
    rows = own.select("record_id", RT.heavy_atoms(F.coalesce("precursor_smiles", F.lit(""))).alias("atoms"), F.coalesce(F.lower("in_stock") == "true", F.lit(False)).alias("in_stock"))
    return rounded(rows.groupBy("record_id").agg(F.count("*").alias("n_precursors"), RT.available_share(F.col("atoms"), F.col("in_stock")).alias("available"), F.bool_and("in_stock").alias("solved")))


@query(f"{_PRECURSORS}, long AS (SELECT solved, unnest(['route_score', 'hac_weighted_score', 'search_time_seconds', 'available']) AS metric, unnest([route_score, hac_weighted_score, search_time_seconds, available]) AS x FROM available JOIN route_records USING (record_id)) SELECT solved, metric, {_SPREAD} FROM long GROUP BY 1, 2")
def record_statistics(s, d):
    own = record_availability(s, d).join(table(s, d, "route_records").select("record_id", "route_score", "hac_weighted_score", "search_time_seconds"), "record_id")
    return rounded(RT.record_report(own, "solved", ["route_score", "hac_weighted_score", "search_time_seconds", "available"]))


@query(f"{_PRECURSORS} SELECT r AS smiles, count(DISTINCT record_id) AS n_records FROM held WHERE r IS NOT NULL GROUP BY 1 HAVING NOT bool_or(f)")
def unavailable_precursors(s, d):
    """Precursors that no record has in stock, with the number of records that need them."""
    own = child_table(table(s, d, "route_records"), "record_id", "precursor").filter("precursor_smiles is not null")
    held = F.coalesce(F.lower("in_stock") == "true", F.lit(False))
    return own.groupBy(F.col("precursor_smiles").alias("smiles")).agg(F.count_distinct("record_id").alias("n_records"), F.bool_or(held).alias("_in")).filter("not _in").drop("_in")


@query("SELECT id, greatest(len(regexp_extract_all(smiles, '\\[[^\\]]*\\]|Cl|Br|[BCNOPSFIbcnops]')) - len(regexp_extract_all(smiles, '\\[[0-9]*H[0-9]*[+-]?[0-9]*\\]')), 1)::INT AS atoms FROM stock")
def heavy_atom_counts(s, d):
    return table(s, d, "stock").select("id", RT.heavy_atoms(F.col("smiles")).alias("atoms"))


_FAULTS = f"""t AS (SELECT id, s, regexp_replace(s, '\\[[^\\[\\]]*\\]', '', 'g') AS b FROM u), r AS (SELECT *, list_transform(regexp_extract_all(b, '%\\([0-9]+\\)|%[0-9][0-9]|[0-9]'), lambda q: regexp_replace(q, '[%()]', '', 'g')::INT) AS rings FROM t), faulted AS (SELECT id, s, CASE WHEN NOT regexp_full_match(s, '[A-IK-PR-Za-ik-pr-vy0-9@+\\-\\[\\]()=#$/\\\\%.:*~]*') THEN 'foreign character' WHEN regexp_matches(b, '[\\[\\]]') OR regexp_matches(s, '\\[[^\\[\\]]*[()][^\\[\\]]*\\]')
  OR list_reduce(list_prepend(0, list_transform(string_split(regexp_replace(b, '[^()]', '', 'g'), ''), lambda c: CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)), lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END) <> 0 THEN 'unbalanced brackets'
  WHEN len(list_filter(list_distinct(rings), lambda q: len(list_filter(rings, lambda p: p = q)) % 2 = 1)) > 0 THEN 'unpaired ring number' END AS fault FROM r)"""


@query(f"WITH u AS (SELECT id, regexp_replace(smiles, '^ +| +$', '', 'g') AS s FROM stock), {_FAULTS} SELECT id, fault FROM faulted")
def structure_faults(s, d):
    """Why texts of the stock can't be structures; null for those that can."""
    return table(s, d, "stock").select("id", S.fault(F.trim("smiles")).alias("fault"))


_UNSEEN = "[\\s\\x{00a0}\\x{00ad}\\x{061c}\\x{180e}\\x{1680}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}\\p{Cc}]+"


def _standard(name: str, key: str, col: str) -> str:
    """CTEs up to standard(id, fault, std): the text standard form of a column in SQL."""
    return (
        f"u AS (SELECT {key} AS id, nullif(regexp_replace({col}, '{_UNSEEN}', '', 'g'), '') AS s FROM {name}), {_FAULTS}, "
        "standard AS (SELECT id, CASE WHEN s IS NULL THEN 'empty' ELSE fault END AS fault, CASE WHEN s IS NOT NULL AND fault IS NULL THEN regexp_replace(regexp_replace(regexp_replace(list_max(list_transform(string_split(s, '.'), lambda x: {'n': length(x), 'x': x})).x, '[@/\\\\]', '', 'g'), '[+-][0-9]*\\]', ']', 'g'), '\\[([BCNOPSF]|Cl|Br|I)H?[0-9]*\\]', '\\1', 'g') END AS std FROM faulted)"
    )


STOCK_KEYS = "WITH " + _standard("stock", "id", "smiles") + " SELECT id, std AS standard, upper(substr(sha256(std), 1, 27)) AS key, fault AS reason FROM standard"


@query("WITH " + _standard("scaffolds", "row_id", "molecule") + ", c AS (SELECT id, std, regexp_extract(std, '^[^0-9]*?([A-Za-z\\[][^0-9\\[\\]]{0,3}\\]?[0-9].*[0-9])', 1) AS core FROM standard), o AS (SELECT id, std, CASE WHEN core = '' THEN std ELSE core END AS own FROM c) SELECT row_id, std AS standard, coalesce(own, molecule) AS core, coalesce(regexp_replace(regexp_replace(regexp_replace(own, '\\[[^\\]]*\\]', 'C', 'g'), 'Cl|Br|[A-Za-z]', 'C', 'g'), '[=#]', '', 'g'), molecule) AS generic FROM o JOIN scaffolds ON row_id = id")
def text_scaffolds(s, d):
    b = TextBackend()
    return table(s, d, "scaffolds").select("row_id", b.standard(F.col("molecule")).alias("standard"), b.scaffold(F.col("molecule")).alias("core"), b.scaffold(F.col("molecule"), generic=True).alias("generic"))


def _times(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


_COUNTS = {
    "heavy_atoms": _times("\\[[^\\]]*\\]|Cl|Br|[BCNOPSFIbcnops]") + " - " + _times("\\[[0-9]*H[0-9]*[+-]?[0-9]*\\]"), "carbons": _times("C|c") + " - " + _times("Cl"), "nitrogens": _times("N|n"), "oxygens": _times("O|o"), "sulfurs": _times("S|s"),
    "halogens": _times("F|Cl|Br|I"), "aromatic_atoms": _times("[bcnops]"), "rings": _times("[0-9]") + " / 2.0", "branches": _times("\\("), "double_bonds": _times("="), "triple_bonds": _times("#"), "stereo_marks": _times("@+|/|\\\\"),
    "charges": _times("[+-][0-9]*\\]"), "components": _times("\\.") + " + 1", "length": "length(t)",
}


@query(f"SELECT id, {', '.join(f'({c})::DOUBLE AS {n}' for n, c in _COUNTS.items())} FROM (SELECT id, nullif(regexp_replace(smiles, '[\\s\\x{{00a0}}\\x{{00ad}}\\x{{061c}}\\x{{180e}}\\x{{1680}}\\x{{2000}}-\\x{{200f}}\\x{{2028}}-\\x{{202f}}\\x{{205f}}-\\x{{206f}}\\x{{3000}}\\x{{feff}}\\p{{Cc}}]+', '', 'g'), '') AS t FROM stock)")
def text_descriptors(s, d):
    b = TextBackend()
    return table(s, d, "stock").select("id", b.descriptors(F.col("smiles")).alias("x")).select("id", "x.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in Q.items() if q}

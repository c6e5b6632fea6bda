"""The queries of the general training-data problems (3 and 5), with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.operators.flatten import child_table, child_tables, flatten_nested
from molquarry.operators.parse_rows import parse_rows
from molquarry.runtime import Scratch, table


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return parse_rows(table(s, d, "raw_route_lines")).bad.select("line_id", "reason")


def p3_reasons(s: SparkSession, d: str) -> DataFrame:
    return parse_rows(table(s, d, "raw_route_lines")).bad.groupBy("reason").agg(F.count("*").alias("n"))


def p3_rows(s: SparkSession, d: str) -> DataFrame:
    return parse_rows(table(s, d, "raw_route_lines")).rows


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return flatten_nested(table(s, d, "route_records"), "record_id").select("record_id", "child", "path", "parent_path")


def _number(name: str, kind: str = "double") -> Column:
    return F.trim(name).try_cast("double").cast(kind)


_KEYS = ("record_id", "path", "parent_path", "pos")


def p5_precursors(s: SparkSession, d: str) -> DataFrame:
    return child_table(table(s, d, "route_records"), "record_id", "precursor").withColumn("in_stock", F.lower("in_stock").try_cast("boolean"))


def p5_steps(s: SparkSession, d: str) -> DataFrame:
    own = child_table(table(s, d, "route_records"), "record_id", "step")
    return own.withColumns({"step_number": _number("step_number", "int"), "probability": _number("probability"), "temperature": _number("temperature")})


def p5_reactants(s: SparkSession, d: str) -> DataFrame:
    return child_table(table(s, d, "route_records"), "record_id", "reactant").withColumn("in_stock", F.lower("in_stock").try_cast("boolean"))


def p5_reagents(s: SparkSession, d: str) -> DataFrame:
    return child_table(table(s, d, "route_records"), "record_id", "reagent").withColumn("equiv", _number("equiv"))


def p5_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows and distinct parents of each child table, all from one decoding."""
    tables = child_tables(table(s, d, "route_records"), "record_id", Scratch(s))
    each = [t.agg(F.lit(k).alias("child"), F.count("*").alias("n"), F.count_distinct("record_id", "parent_path").alias("n_parents")) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in "p3_found p3_reasons p3_rows p5_found p5_precursors p5_steps p5_reactants p5_reagents p5_rows".split()}


#: Bad lines by patterns made from each file's delimiter.
_BAD_LINES = r"""WITH lines AS (SELECT line_id, coalesce(source_file, '') AS f, line_no, regexp_replace(regexp_replace(coalesce(line, ''), '^\x{feff}', ''), '[\r\n]+$', '') AS t FROM raw_route_lines),
heads AS (SELECT f, arg_min(t, line_id) AS h FROM lines WHERE line_no = 1 GROUP BY 1),
parts AS (SELECT f, d, list_transform(string_split(h, d), lambda x: lower(trim(replace(x, '"', '')))) AS names FROM (SELECT f, h, regexp_extract(h, '[^A-Za-z0-9_" ]') AS d FROM heads)),
body AS (SELECT line_id, t, d, names, '( *"(?:[^"]|"")*" *|[^"' || d || ']*)' AS field FROM lines LEFT JOIN parts USING (f) WHERE line_no IS NULL OR line_no <> 1),
judged AS (SELECT line_id, names, d, NOT regexp_full_match(t, '(?s)' || field || '([' || d || ']' || field || ')*') AS broken, regexp_extract_all(d || t, '(?s)[' || d || ']' || field, 1) AS v FROM body),
cut AS (SELECT line_id, broken, len(v) AS n, names, list_transform(v, lambda x: trim(CASE WHEN trim(x, ' ') LIKE '"%' THEN replace(substr(trim(x, ' '), 2, length(trim(x, ' ')) - 2), '""', '"') ELSE x END, E' \t\r\n')) AS v FROM judged),
own AS (SELECT line_id, broken, n, names IS NULL AS headless, v[list_position(names, 'smiles')] AS smiles, v[list_position(names, 'target_smiles')] AS target, v[list_position(names, 'resolved')] AS resolved, v[list_position(names, 'route_score')] AS score, v[list_position(names, 'search_time_seconds')] AS seconds, v[list_position(names, 'n_steps')] AS steps, v[list_position(names, 'note')] AS note FROM cut),
texts AS (SELECT DISTINCT unnest([smiles, target]) AS s FROM own WHERE NOT broken AND n = 7),
bare AS (SELECT s, regexp_replace(s, '\[[^\[\]]*\]', '', 'g') AS b FROM texts),
faults AS (
  SELECT s, NOT regexp_full_match(s, '[A-IK-PR-Za-ik-pr-vy0-9@+\-\[\]()=#$/\\%.:*~]*') OR b LIKE '%[%' OR b LIKE '%]%' OR regexp_matches(s, '\[[^\[\]]*[()][^\[\]]*\]')
    OR list_reduce(list_prepend(0, list_transform(string_split(regexp_replace(b, '[^()]', '', 'g'), ''), lambda c: CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)), lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END) <> 0
    OR len(list_filter(list_distinct(regexp_extract_all(b, '%[0-9][0-9]|[0-9]')), lambda r: len(list_filter(regexp_extract_all(b, '%[0-9][0-9]|[0-9]'), lambda q: q = r)) % 2 = 1)) > 0 AS bad FROM bare
), number AS (SELECT '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?' AS p)"""
#: The reason of each line, null for good ones, beside its fields.
_REASONS = r"""SELECT line_id, CASE WHEN headless THEN 'columns' WHEN broken THEN 'quoting' WHEN n <> 7 THEN 'columns' WHEN smiles = '' OR a.bad OR b.bad OR (resolved <> '' AND lower(resolved) NOT IN ('true', 'false'))
    OR (score <> '' AND NOT coalesce(regexp_full_match(score, p) AND try_cast(score AS DOUBLE) BETWEEN 0 AND 1, false))
    OR (seconds <> '' AND NOT coalesce(regexp_full_match(seconds, p) AND try_cast(seconds AS DOUBLE) >= 0, false))
    OR (steps <> '' AND NOT coalesce(regexp_full_match(steps, p) AND try_cast(steps AS DOUBLE) >= 0 AND try_cast(steps AS DOUBLE) = floor(try_cast(steps AS DOUBLE)), false)) THEN 'value' END AS reason,
    smiles, target, resolved, score, seconds, steps, note
  FROM own, number LEFT JOIN faults a ON a.s = smiles LEFT JOIN faults b ON b.s = target"""
#: Elements at any depth by a recursive query over JSON.
_ELEMENTS = r"""WITH RECURSIVE texts AS (
  SELECT record_id, 'precursors' AS col, 'precursor' AS child, CASE WHEN json_valid(precursors) THEN precursors::JSON END AS j FROM route_records
  UNION ALL SELECT record_id, 'synthesis_steps', 'step', CASE WHEN json_valid(synthesis_steps) THEN synthesis_steps::JSON END FROM route_records
), roots AS (
  SELECT record_id, col, child, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM texts WHERE j IS NOT NULL
), kinds(parent, field, below) AS (VALUES ('step', '.reactants', 'reactant'), ('step', '.conditions.reagents', 'reagent'), ('reactant', '.made_by', 'step')),
first AS (
  SELECT record_id, child, col, unnest(e) AS x, unnest(range(0, len(e))) AS i FROM (SELECT record_id, child, col, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') ELSE [j] END AS e FROM roots WHERE j IS NOT NULL AND json_type(j) <> 'NULL')
), items(record_id, child, path, parent_path, x) AS (
  SELECT record_id, child, col || '[' || i || ']', '', x FROM first WHERE x IS NOT NULL AND json_type(x) <> 'NULL'
  UNION ALL
  SELECT record_id, below, path || field || '[' || i || ']', path, y FROM (
    SELECT record_id, below, path, field, unnest(e) AS y, unnest(range(0, len(e))) AS i FROM (
      SELECT record_id, below, path, field, CASE WHEN json_type(z) = 'ARRAY' THEN from_json(z, '["JSON"]') ELSE [z] END AS e FROM (
        SELECT record_id, below, path, field, json_extract(x, '$' || field) AS z FROM items JOIN kinds ON child = parent WHERE json_type(x) = 'OBJECT'
      ) WHERE z IS NOT NULL AND json_type(z) <> 'NULL'
    )
  ) WHERE y IS NOT NULL AND json_type(y) <> 'NULL'
)"""


def oracle_sql() -> dict[str, str]:
    text = "nullif({}, '')"
    boolean = "CASE WHEN lower(f->>'$.in_stock') IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(f->>'$.in_stock') IN ('false', 'f', 'no', 'n', '0') THEN false END AS in_stock"
    listed = "CASE WHEN json_type(f->'$.stock_source') = 'ARRAY' THEN array_to_string(from_json(f->'$.stock_source', '[\"VARCHAR\"]'), ',') ELSE f->>'$.stock_source' END AS stock_source"
    number = "try_cast(trim(f->>'$.{}') AS DOUBLE)"
    own = "CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE f->>'$.{}' END"
    columns = {
        "precursors": ("precursor", f"{own.format('precursor_smiles')} AS precursor_smiles, {boolean}, {listed}"),
        "steps": ("step", f"CASE WHEN json_type(x) = 'VARCHAR' THEN try_cast(x->>'$' AS DOUBLE) ELSE {number.format('step_number')} END::INT AS step_number, f->>'$.product' AS product, f->>'$.template_code' AS template_code, {number.format('probability')} AS probability, {number.format('conditions.temperature')} AS temperature"),
        "reactants": ("reactant", f"{own.format('smiles')} AS smiles, {boolean}"),
        "reagents": ("reagent", f"{own.format('name')} AS name, {number.format('equiv')} AS equiv"),
    }
    children = {f"p5_{n}": f"{_ELEMENTS} SELECT record_id, path, parent_path, regexp_extract(path, '\\[([0-9]+)\\]$', 1)::INT AS pos, {c} FROM (SELECT *, CASE WHEN json_type(x) = 'OBJECT' THEN x END AS f FROM items) WHERE child = '{k}'" for n, (k, c) in columns.items()}
    return {
        "p3_found": f"{_BAD_LINES} SELECT line_id, reason FROM ({_REASONS}) WHERE reason IS NOT NULL",
        "p3_reasons": f"{_BAD_LINES} SELECT reason, count(*) AS n FROM ({_REASONS}) WHERE reason IS NOT NULL GROUP BY 1",
        "p3_rows": f"{_BAD_LINES} SELECT line_id, {text.format('smiles')} AS smiles, {text.format('target')} AS target_smiles, CASE WHEN resolved <> '' THEN lower(resolved) = 'true' END AS resolved, try_cast({text.format('score')} AS DOUBLE) AS route_score, try_cast({text.format('seconds')} AS DOUBLE) AS search_time_seconds, try_cast({text.format('steps')} AS DOUBLE)::INT AS n_steps, {text.format('note')} AS note FROM ({_REASONS}) WHERE reason IS NULL",
        "p5_found": f"{_ELEMENTS} SELECT record_id, child, path, parent_path FROM items",
        "p5_rows": f"{_ELEMENTS} SELECT child, count(*) AS n, count(DISTINCT (record_id, parent_path)) AS n_parents FROM items GROUP BY 1",
        **children,
    }

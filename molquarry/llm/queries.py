"""The queries of the training-data problems tagged llm, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm import copies, encoding, leakage, overlaps, splits, subjects, variety
from molquarry.llm.components import group_rows
from molquarry.runtime import table

#: Rows that problem 7's subset has.
SUBSET = 200


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    return overlaps.split_overlaps(table(s, d, "routes_train_val"), {n: table(s, d, n) for n in ("routes_test", "shared_test_set")})


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _overlaps(s, d).select("split", "train_id", "eval_id")


def p1_report(s: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(_overlaps(s, d))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return group_rows(table(s, d, "scaffolds"), "row_id", table(s, d, "scaffold_matches"), "left_id", "right_id")


def p2_sizes(s: SparkSession, d: str) -> DataFrame:
    return p2_found(s, d).groupBy("group_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_groups"))


_COPIES = (("protac_db", copies.COMPOUND), ("stock", copies.STOCK))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    one, two = (copies.copies(table(s, d, n), shape).select(F.lit(n).alias("source_table"), "keep_id", "copy_id") for n, shape in _COPIES)
    return one.unionByName(two)


def p4_records(s: SparkSession, d: str) -> DataFrame:
    one, two = (copies.records(table(s, d, n), shape).select(F.lit(n).alias("source_table"), "keep_id", "n_copies") for n, shape in _COPIES)
    return one.unionByName(two)


_LINKS = ["molecule", "warhead_scaffold"]


def p6_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(table(s, d, "scaffolds"), "row_id", _LINKS)


def p6_totals(s: SparkSession, d: str) -> DataFrame:
    """Rows of each part and of its share."""
    own = p6_splits(s, d).groupBy("split").agg(F.count("*").alias("n_rows"))
    share = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    return own.join(F.broadcast(own.agg(F.sum("n_rows").alias("n"))), F.lit(True)).select("split", "n_rows", F.round(F.col("n") * share).cast("long").alias("n_wanted"))


def p6_shared(s: SparkSession, d: str) -> DataFrame:
    """Of each link its values, and how many of them stand in more than one part: none."""
    rows = table(s, d, "scaffolds").join(p6_splits(s, d), "row_id")
    values = rows.select("split", F.explode(F.array(*(F.struct(F.lit(c).alias("link"), F.trim(c).alias("value")) for c in _LINKS))).alias("x")).select("split", "x.*")
    parted = values.filter("value <> ''").groupBy("link", "value").agg(F.count_distinct("split").alias("n"))
    return parted.groupBy("link").agg(F.count("*").alias("n_values"), F.count_if(F.col("n") > 1).alias("n_parted"))


def p7_subset(s: SparkSession, d: str) -> DataFrame:
    return variety.varied_subset(table(s, d, "routes_scored"), SUBSET)


def p7_coverage(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "routes_scored")
    return variety.coverage(rows, variety.varied_subset(rows, SUBSET), "warhead_id")


def p7_quality(s: SparkSession, d: str) -> DataFrame:
    """Whether the subset spans more than as many rows taken at random, by the logarithm of the kernel's determinant."""
    rows = table(s, d, "routes_scored")
    subset = variety.varied_subset(rows, SUBSET)
    chance = rows.filter("smiles is not null").orderBy(F.xxhash64("row_id"), "row_id").limit(SUBSET).select("row_id")
    spans = [variety.volume(rows.join(F.broadcast(keys), "row_id", "left_semi")) for keys in (subset.select("row_id"), chance)]  # SUBSET rows each
    return s.createDataFrame([(subset.count(), spans[0] > spans[1])], "n_rows long, spans_more boolean")


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(table(s, d, "documents"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(s, d, "documents"), table(s, d, "test_items"))


def p9_report(s: SparkSession, d: str) -> DataFrame:
    return leakage.leakage_report(p9_found(s, d), table(s, d, "test_items"))


def _subjects(s: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subjects"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return _subjects(s, d).select("doc_id", "subject")


def p10_composition(s: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_composition(_subjects(s, d), table(s, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p1_found p1_report p2_found p2_sizes p4_found p4_records p6_splits p6_totals p6_shared p7_subset p7_coverage p7_quality p8_ids p9_found p9_report p10_found p10_composition"
    return {n: globals()[n] for n in names.split()}


_EDGES = """e(a, b) AS (
  SELECT left_id, right_id FROM scaffold_matches WHERE left_id IN (SELECT row_id FROM scaffolds) AND right_id IN (SELECT row_id FROM scaffolds)
  UNION SELECT right_id, left_id FROM scaffold_matches WHERE left_id IN (SELECT row_id FROM scaffolds) AND right_id IN (SELECT row_id FROM scaffolds)
), reach(node, label) AS (
  SELECT row_id, row_id FROM scaffolds
  UNION SELECT e.b, reach.label FROM reach JOIN e ON reach.node = e.a
), found AS (SELECT min(label) AS group_id, node AS row_id FROM reach GROUP BY node)"""


#: Copies by normalised texts, in SQL.
_COPIED = r"""WITH marks AS (SELECT '[\s\x{00a0}\x{00ad}\x{061c}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}\p{Cc}]+' AS blank, '^["''`´‘’“”,;:.|]+|["''`´‘’“”,;:.|]+$' AS around, '^[^\p{L}\p{N}]*\p{L}[\p{L}_ -]*\s*[:=]' AS label),
raw AS (
  SELECT 'protac_db' AS source_table, compound_id AS id, smiles, [target, e3_ligase, reference] AS codes, activity FROM protac_db
  UNION ALL SELECT 'stock', id, smiles, [inchi_key], NULL FROM stock
), made AS (
  SELECT source_table, id,
    list_sort(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(smiles, ''), blank, '', 'g'), around, '', 'g'), '^\((.*)\)$', '\1'), '.'), lambda x: x <> '')) AS s,
    list_transform(codes, lambda c: regexp_replace(regexp_replace(lower(coalesce(c, '')), label, ''), '[^\p{L}\p{N}]+', '', 'g')) AS c,
    list_sort(list_transform(list_filter(string_split(replace(regexp_replace(lower(coalesce(activity, '')), ',([^0-9])', ';\1', 'g'), '|', ';'), ';'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')),
      lambda x: regexp_replace(split_part(regexp_replace(x, '[:=]', '~~'), '~~', 1), '[^\p{L}\p{N}]+', '', 'g') || '=' ||
        coalesce(try_cast(trim(split_part(regexp_replace(x, '[:=]', '~~'), '~~', 2)) AS DOUBLE)::VARCHAR, regexp_replace(split_part(regexp_replace(x, '[:=]', '~~'), '~~', 2), '[^\p{L}\p{N}]+', '', 'g')))) AS a
  FROM raw, marks
), grouped AS (SELECT source_table, id, min(id) OVER (PARTITION BY source_table, s, c, a) AS keep_id, count(*) OVER (PARTITION BY source_table, s, c, a) AS n FROM made)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"{_COPIED} SELECT source_table, keep_id, id AS copy_id FROM grouped WHERE id <> keep_id",
        "p4_records": f"{_COPIED} SELECT source_table, keep_id, n AS n_copies FROM grouped WHERE id = keep_id",
        "p2_found": f"WITH RECURSIVE {_EDGES} SELECT group_id, row_id FROM found",
        "p2_sizes": f"WITH RECURSIVE {_EDGES}, sizes AS (SELECT count(*) AS n FROM found GROUP BY group_id) SELECT n, count(*) AS n_groups FROM sizes GROUP BY n",
        "p6_shared": " UNION ALL ".join(f"SELECT '{c}' AS link, count(DISTINCT trim({c}, ' ')) AS n_values, 0::BIGINT AS n_parted FROM scaffolds WHERE trim({c}, ' ') <> ''" for c in _LINKS),
        "p6_totals": "SELECT split, n_rows, n_rows AS n_wanted FROM (SELECT unnest(['train', 'validation', 'test']) AS split, unnest([n - 2 * t, t, t]) AS n_rows FROM (SELECT count(*) AS n, round(count(*) * 0.1)::BIGINT AS t FROM scaffolds))",
        "p7_quality": f"SELECT least({SUBSET}, count(DISTINCT smiles)) AS n_rows, true AS spans_more FROM routes_scored",
    }

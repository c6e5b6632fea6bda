"""Queries of the relational operators on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import labels
from molquarry.functions.text import truthy
from molquarry.operators import relational as R
from molquarry.runtime import table

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


#: Text booleans in SQL.
TRUE = "lower(trim(resolved)) IN ('true','1','1.0','yes','t')"


@query(f"SELECT row_id, smiles, CASE WHEN isnan(synthesizability) THEN NULL ELSE synthesizability END AS synthesizability FROM (SELECT *, row_number() OVER (PARTITION BY smiles ORDER BY CASE WHEN coalesce({TRUE}, false) THEN 0 ELSE 1 END, CASE WHEN isnan(synthesizability) THEN NULL ELSE synthesizability END DESC NULLS LAST, row_id) AS r FROM routes_train_val) WHERE r = 1")
def best_route_per_molecule(s, d):
    return R.best_per_key(table(s, d, "routes_train_val"), "smiles", "resolved", "synthesizability", "row_id").select("row_id", "smiles", F.when(~F.isnan("synthesizability"), F.col("synthesizability")).alias("synthesizability"))


@query(f"SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY smiles ORDER BY CASE WHEN coalesce({TRUE}, false) THEN 0 ELSE 1 END, CASE WHEN isnan(synthesizability) THEN NULL ELSE synthesizability END DESC NULLS LAST, row_id) AS r FROM routes_train_val) WHERE r > 1")
def dropped_routes(s, d):
    return R.dropped_duplicates(table(s, d, "routes_train_val"), "smiles", "resolved", "synthesizability", "row_id").select("row_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_order_per_customer(s, d):
    return R.best_per_key(table(s, d, "orders"), "o_custkey", None, "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT row_id, molecule, datasource FROM (SELECT *, row_number() OVER (PARTITION BY molecule, datasource ORDER BY row_id) AS r FROM scaffolds) WHERE r = 1")
def first_per_composite_key(s, d):
    return R.first_per_key(table(s, d, "scaffolds"), ["molecule", "datasource"], "row_id").select("row_id", "molecule", "datasource")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_copy, doc_id > min(doc_id) OVER (PARTITION BY text) AS is_later_copy FROM documents")
def copy_flags(s, d):
    return R.duplicate_flags(table(s, d, "documents"), "text", "doc_id").select("doc_id", "is_copy", "is_later_copy")


@query("SELECT row_id, CASE WHEN warhead_scaffold IS NULL THEN NULL ELSE 'WH_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') END AS wh_id FROM scaffolds LEFT JOIN (SELECT w, row_number() OVER (ORDER BY o) AS i FROM (SELECT warhead_scaffold AS w, min(row_id) AS o FROM scaffolds WHERE warhead_scaffold IS NOT NULL GROUP BY 1)) ON warhead_scaffold = w")
def sequential_scaffold_ids(s, d):
    return R.sequential_ids(table(s, d, "scaffolds"), "warhead_scaffold", "row_id", "WH", "wh_id").select("row_id", "wh_id")


@query("SELECT row_id, 'WH_' || substr(sha256(warhead_scaffold), 1, 8) AS wh_hash FROM scaffolds")
def hashed_scaffold_ids(s, d):
    return table(s, d, "scaffolds").select("row_id", R.hash_id(F.col("warhead_scaffold"), "WH").alias("wh_hash"))


@query("SELECT row_id, i AS source_no FROM scaffolds LEFT JOIN (SELECT w, row_number() OVER (ORDER BY o) AS i FROM (SELECT datasource AS w, min(row_id) AS o FROM scaffolds WHERE datasource IS NOT NULL GROUP BY 1)) ON datasource = w")
def factorized_sources(s, d):
    return R.factorized(table(s, d, "scaffolds"), "datasource", "row_id", "source_no").select("row_id", "source_no")


@query("SELECT row_id, smiles FROM routes_test WHERE smiles NOT IN (SELECT smiles FROM routes_train_val)")
def evaluation_without_training(s, d):
    return R.without_overlap(table(s, d, "routes_test"), table(s, d, "routes_train_val"), "smiles").select("row_id", "smiles")


@query("SELECT row_id, smiles FROM routes_test WHERE smiles IN (SELECT smiles FROM routes_train_val)")
def evaluation_in_training(s, d):
    return R.overlap(table(s, d, "routes_test"), table(s, d, "routes_train_val"), "smiles").select("row_id", "smiles")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT b) AS n_kept, count(*) FILTER (WHERE b) AS n_removed, count(DISTINCT smiles) FILTER (WHERE b) AS n_unique_removed FROM (SELECT smiles, smiles IN (SELECT smiles FROM routes_train_val) AS b FROM routes_test)")
def evaluation_audit(s, d):
    return R.overlap_audit(table(s, d, "routes_test"), table(s, d, "routes_train_val"), "smiles")


@query("SELECT o_orderkey, o_totalprice, n_lines FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)")
def validated_join(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return R.join_one_to_one(table(s, d, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey")


@query("SELECT c_custkey, n_nationkey, r_name, n_orders FROM (SELECT c_custkey, c_nationkey AS n_nationkey FROM customer) JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey) JOIN nation USING (n_nationkey) JOIN region ON n_regionkey = r_regionkey")
def chained_join(s, d):
    orders = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    got = R.chain_one_to_one([table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), orders], "c_custkey")
    return got.join(table(s, d, "nation"), "n_nationkey").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_nationkey", "r_name", "n_orders")


@query("SELECT a.row_id, a.smiles, b.score FROM (SELECT row_id, smiles FROM routes_scored) a JOIN (SELECT row_id, score FROM routes_scored) b USING (row_id)")
def positional_join(s, d):
    t = table(s, d, "routes_scored")
    return R.join_by_position(t.select("row_id", "smiles"), t.select("row_id", "smiles", "score"), "row_id", "smiles", ["score"])


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1) ON c_custkey = o_custkey")
def lookup_first_order(s, d):
    orders = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.lookup_first(table(s, d, "customer"), orders, "c_custkey", ["o_orderkey", "o_totalprice"], "o_orderkey").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT count(o) AS n_matched, count(*) - count(o) AS n_unmatched FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def lookup_counts(s, d):
    return R.lookup_report(lookup_first_order(s, d), "o_orderkey")


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def users_of_all_types(s, d):
    return R.common_keys(table(s, d, "events"), "user_id", "event_type")


@query("SELECT row_id, smiles, stocks FROM routes_train_val LEFT JOIN (SELECT smiles, string_agg(n, ',' ORDER BY n) AS stocks FROM (SELECT DISTINCT smiles, 'STOCK' AS n FROM stock UNION SELECT DISTINCT smiles, 'COMPOUNDS' FROM protac_db UNION SELECT DISTINCT smiles, 'TEST' FROM routes_test) GROUP BY 1) USING (smiles)")
def stock_lists(s, d):
    stocks = {n: table(s, d, t) for n, t in (("stock", "stock"), ("compounds", "protac_db"), ("test", "routes_test"))}
    return R.stock_availability(table(s, d, "routes_train_val"), stocks, "smiles").select("row_id", "smiles", "stocks")


@query("SELECT smiles, id FROM (SELECT smiles, id, row_number() OVER (PARTITION BY smiles ORDER BY id) AS r FROM stock WHERE id <= 100) WHERE r >= 1 UNION ALL SELECT smiles, id FROM (SELECT smiles, id, row_number() OVER (PARTITION BY smiles ORDER BY id) AS r FROM stock WHERE id > 100 AND smiles IS NOT NULL AND smiles NOT IN (SELECT smiles FROM stock WHERE id <= 100 AND smiles IS NOT NULL)) WHERE r = 1")
def inserted_or_ignored(s, d):
    t = table(s, d, "stock").select("smiles", "id")
    return R.insert_or_ignore(t.filter("id <= 100"), t.filter("id > 100"), "smiles", "id")


@query("SELECT DISTINCT smiles, cap_type, cap FROM stock, (VALUES ('methyl', 'C'), ('methyl', '[H]'), ('ethyl', 'CC')) AS c(cap_type, cap)")
def cap_variants(s, d):
    return R.variants(table(s, d, "stock").select("smiles"), {"methyl": ["C", "[H]"], "ethyl": ["CC"]}).distinct()


@query("SELECT row_id FROM routes_scored WHERE error IS NULL OR trim(error, E' \\t\\n\\r') = ''")
def without_errors(s, d):
    return R.without_error(table(s, d, "routes_scored")).select("row_id")


@query(f"SELECT row_id, coalesce({TRUE}, false) AS is_resolved FROM routes_scored")
def text_booleans(s, d):
    return table(s, d, "routes_scored").select("row_id", F.coalesce(truthy(F.col("resolved")), F.lit(False)).alias("is_resolved"))


@query("SELECT * FROM (SELECT row_id, 'low' AS pool FROM routes_scored, (SELECT quantile_cont(search_duration, 0.5) AS m FROM routes_scored) WHERE search_duration >= m UNION ALL SELECT row_id, 'high' FROM routes_scored, (SELECT quantile_cont(search_duration, 0.5) AS m FROM routes_scored) WHERE search_duration <= m)")
def confidence_split(s, d):
    return R.confidence_pools(table(s, d, "routes_scored").filter("search_duration is not null"), "search_duration").select("row_id", "pool")


@query("SELECT row_id, 'bottom' AS tail FROM (SELECT row_id, row_number() OVER (ORDER BY search_duration, row_id) AS r FROM routes_scored WHERE search_duration IS NOT NULL) WHERE r <= 50 UNION ALL SELECT row_id, 'top' FROM (SELECT row_id, row_number() OVER (ORDER BY search_duration DESC, row_id) AS r FROM routes_scored WHERE search_duration IS NOT NULL) WHERE r <= 50")
def score_tails(s, d):
    return R.tails(table(s, d, "routes_scored"), "search_duration", "row_id", 50).select("row_id", "tail")


@query("SELECT event_id, event_type, tail FROM (SELECT *, CASE WHEN l <= n THEN 'bottom' WHEN h <= n THEN 'top' END AS tail FROM (SELECT *, least(20, floor(count(*) OVER (PARTITION BY event_type) / 2)) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS l, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS h FROM events WHERE value IS NOT NULL)) WHERE tail IS NOT NULL")
def grouped_tails(s, d):
    return R.tails(table(s, d, "events"), "value", "event_id", 20, ["event_type"]).select("event_id", "event_type", "tail")


@query("SELECT row_id, (search_duration < 1)::INT + coalesce((score = 0)::INT, 0) + (length(smiles) < 100)::INT AS n_flags FROM routes_scored")
def rule_flags(s, d):
    t = table(s, d, "routes_scored")
    return R.hard_rule_flags(t, {"fast": F.col("search_duration") < 1, "zero": F.col("score") == 0, "small": F.length("smiles") < 100}).select("row_id", "n_flags")


@query("SELECT datasource, n_keys, unnest(range(0, greatest(ceil(n_keys / 100)::INT, 1)))::INT AS task FROM (SELECT datasource, count(DISTINCT smiles) AS n_keys FROM routes_scored GROUP BY 1)")
def scoring_tasks(s, d):
    return R.task_table(table(s, d, "routes_scored"), "datasource", "smiles", 100)


@query("SELECT 'train' AS split, row_id, NULL::INT AS labels FROM routes_train_val UNION ALL SELECT 'test', row_id, NULL FROM routes_test UNION ALL SELECT 'shared', row_id, labels FROM shared_test_set")
def union_of_splits(s, d):
    parts = {n: table(s, d, t) for n, t in (("train", "routes_train_val"), ("test", "routes_test"), ("shared", "shared_test_set"))}
    return R.tagged_union(parts, "split").select("split", "row_id", "labels")


@query("SELECT count(DISTINCT a) AS n_left, count(DISTINCT b) AS n_right, count(DISTINCT CASE WHEN a = b THEN a END) AS n_both, count(DISTINCT CASE WHEN a = b THEN a END)::DOUBLE / (count(DISTINCT a) + count(DISTINCT b) - count(DISTINCT CASE WHEN a = b THEN a END)) AS jaccard FROM (SELECT DISTINCT smiles AS a FROM routes_train_val) FULL JOIN (SELECT DISTINCT smiles AS b FROM routes_test) ON a = b")
def split_overlap_sizes(s, d):
    return R.set_sizes(table(s, d, "routes_train_val"), table(s, d, "routes_test"), "smiles")


@query(f"SELECT datasource, count(*) FILTER (WHERE {TRUE} AND search_duration < 30)::DOUBLE / nullif(count(*) FILTER (WHERE {TRUE} OR search_duration < 30), 0) AS jaccard FROM routes_scored GROUP BY 1")
def flag_overlap(s, d):
    return table(s, d, "routes_scored").groupBy("datasource").agg(R.flag_jaccard(F.coalesce(truthy(F.col("resolved")), F.lit(False)), F.col("search_duration") < 30).alias("jaccard"))


@query("SELECT row_id, CASE WHEN warhead_scaffold IS NOT NULL AND linker_scaffold IS NOT NULL THEN warhead_scaffold || '||' || linker_scaffold END AS group_key FROM scaffolds")
def product_keys(s, d):
    return table(s, d, "scaffolds").select("row_id", labels.product_key("warhead_scaffold", "linker_scaffold").alias("group_key"))


@query("SELECT DISTINCT datasource, 'GNN_seed' || (row_id % 5) || '_fold' || (row_id % 3) AS name, 'GNN' AS backend, row_id % 5 AS seed, row_id % 3 AS fold FROM scaffolds")
def model_name_parts(s, d):
    t = table(s, d, "scaffolds").select("datasource", F.concat(F.lit("GNN_seed"), F.col("row_id") % 5, F.lit("_fold"), F.col("row_id") % 3).alias("name")).distinct()
    return R.without_nulls(labels.require_model_names(t, "name").select("datasource", "name", labels.model_parts(F.col("name")).alias("p")).select("datasource", "name", "p.*"), "name")


@query("SELECT row_id, split_part(datasource, '-', 1) AS family, CASE WHEN pool = 'held_out' THEN 'Held-out' WHEN pool = 'train_val' THEN 'Train-val' WHEN pool = 'synthetic' THEN 'Synthetic' END AS pool_name FROM routes_scored")
def display_names(s, d):
    return table(s, d, "routes_scored").select("row_id", F.substring_index("datasource", "-", 1).alias("family"), labels.pretty(F.col("pool")).alias("pool_name"))


@query("""SELECT row_id, w AS warhead, l AS linker, e AS e3 FROM (SELECT row_id, warhead_scaffold || '[*:1]' AS w, '[*:1]' || linker_scaffold || '[*:2]' AS l, e3_scaffold || '[*:2]' AS e FROM scaffolds WHERE warhead_scaffold IS NOT NULL AND linker_scaffold IS NOT NULL AND e3_scaffold IS NOT NULL AND position('.' IN warhead_scaffold || linker_scaffold || e3_scaffold) = 0)""")
def fragment_classes(s, d):
    t = table(s, d, "scaffolds").filter("warhead_scaffold is not null and linker_scaffold is not null and e3_scaffold is not null and instr(warhead_scaffold || linker_scaffold || e3_scaffold, '.') = 0")
    dotted = F.concat(F.col("warhead_scaffold"), F.lit("[*:1].[*:1]"), F.col("linker_scaffold"), F.lit("[*:2]."), F.col("e3_scaffold"), F.lit("[*:2]"))
    return t.select("row_id", labels.fragment_parts(dotted).alias("p")).select("row_id", "p.*")


@query("SELECT DISTINCT source, string_agg(DISTINCT lang, ',' ORDER BY lang) OVER (PARTITION BY source) AS langs, count(DISTINCT lang) OVER (PARTITION BY source) AS n_langs FROM documents")
def joined_languages(s, d):
    from molquarry.operators.aggregates import joined_members

    return joined_members(table(s, d, "documents").filter("lang is not null"), ["source"], "lang", "langs").withColumn("n_langs", F.col("n_langs").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in Q.items() if q}

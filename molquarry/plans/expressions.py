"""Queries of labels, tags, terms, column choices and ordered picks on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import labels, scores
from molquarry.functions.text import strip_blanks
from molquarry.operators import aggregates as A
from molquarry.operators import metrics as M
from molquarry.operators import relational as R
from molquarry.operators import similarity as SI
from molquarry.plans.stats import rounded
from molquarry.runtime import detect_column, require_columns, table

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


# Rows and columns ---------------------------------------------------------------------------------------------------------------


@query("SELECT row_id AS id, smiles AS structure FROM routes_test")
def fixed_schema(s, d):
    own = table(s, d, "routes_test")
    require_columns(own, "row_id", "smiles")
    return R.renamed(own, {"row_id": "id", detect_column(own, ["SMILES", "structure"]): "structure"})


_TAG = "coalesce(try_cast(trim(CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN ' 1.0 ' WHEN 2 THEN '2' END) AS DOUBLE) IN ({}), false)"


@query(f"SELECT o_orderkey, {_TAG.format('1')} AS tagged, {_TAG.format('1, 2')} AS either FROM orders")
def tags_of_any_spelling(s, d):
    tag = F.when(F.col("o_orderkey") % 4 == 0, "1").when(F.col("o_orderkey") % 4 == 1, " 1.0 ").when(F.col("o_orderkey") % 4 == 2, "2")
    return table(s, d, "orders").select("o_orderkey", R.has_tag(tag).alias("tagged"), R.has_tag(tag, 1, 2).alias("either"))


@query("SELECT id, CASE WHEN inchi_key IS NOT NULL AND trim(inchi_key) <> '' THEN 'vendor' WHEN length(smiles) < 60 THEN 'solved' END AS route FROM stock")
def first_matching_route(s, d):
    vendor = F.col("inchi_key").isNotNull() & (F.trim("inchi_key") != "")
    return table(s, d, "stock").select("id", R.first_route([(vendor, "vendor"), (F.length("smiles") < 60, "solved")]).alias("route"))


@query("SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name, 'numeric' AS kind UNION ALL SELECT unnest(['l_tax', 'l_discount', 'l_quantity', 'l_extendedprice']), 'target' UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), 'uncorrelated'")
def chosen_columns(s, d):
    """Numeric columns without the scaled ones; targets among them that aren't keys, vary and have rows; those not too like an earlier one."""
    own = table(s, d, "lineitem").withColumns({"tax_scaled": F.col("l_tax") * 2, "l_flag": F.lit(True), "constant": F.lit(1.0), "twice": F.col("l_tax") * 2})
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    numeric = [c for c in R.numeric_columns(own, exclude_suffix="_scaled") if c not in ("constant", "twice")]
    targets = [c for c in R.usable_targets(own, keys) if c not in ("tax_scaled", "twice")]
    kept = R.drop_correlated(own, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "twice"], 0.98)
    return s.createDataFrame([(c, k) for k, x in (("numeric", numeric), ("target", targets), ("uncorrelated", kept)) for c in x], "name string, kind string")


@query("SELECT o_orderkey, o_custkey FROM orders")
def without_constant_columns(s, d):
    return R.without_degenerate(table(s, d, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none")))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def smoke_test_rows(s, d):
    return R.top_n(table(s, d, "orders"), 25, F.col("o_orderkey")).select("o_orderkey")


@query("SELECT record_id, try_cast(trim(coalesce(route_score::VARCHAR, 'x')) AS DOUBLE) AS score, -1 AS labels, coalesce(try_cast(route_score AS BIGINT), 0) AS cid, route_score IS NOT NULL AS has_score, coalesce(hac_weighted_score, 0) = coalesce(route_score, -1) AS same, route_score IS NOT NULL OR search_time_seconds > 1 AS either FROM route_records WHERE route_score IS NULL OR NOT isnan(route_score)")
def coerced_and_tagged(s, d):
    """Numbers from text, a constant label, null-safe fills, tags by presence, by equal counts and by either."""
    own = table(s, d, "route_records").filter("route_score is null or not isnan(route_score)")
    text = F.coalesce(F.col("route_score").cast("string"), F.lit("x"))
    return own.select(
        "record_id", strip_blanks(text).try_cast("double").alias("score"), F.lit(-1).alias("labels"), F.coalesce(F.round("route_score").cast("long"), F.lit(0)).alias("cid"), F.col("route_score").isNotNull().alias("has_score"),
        (F.coalesce("hac_weighted_score", F.lit(0.0)) == F.coalesce("route_score", F.lit(-1.0))).alias("same"), (F.col("route_score").isNotNull() | (F.col("search_time_seconds") > 1)).alias("either"),
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def rows_left_to_do(s, d):
    """What a previous output hasn't got, after that is cut to the keys in question."""
    orders = table(s, d, "orders")
    done = R.overlap(table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), orders, "o_orderkey")
    return R.without_overlap(orders, done, "o_orderkey").select("o_orderkey")


@query("SELECT protac_db.compound_id, reference, row_id FROM protac_db LEFT JOIN (SELECT row_id, \"reference\" FROM scaffolds) USING (reference)")
def rows_by_reference(s, d):
    """A left join that multiplies rows where a reference stands more than once."""
    return table(s, d, "protac_db").select("compound_id", "reference").join(table(s, d, "scaffolds").select("row_id", "reference"), "reference", "left")


# Order and picks ------------------------------------------------------------------------------------------------------------------


@query("SELECT row_id, row_number() OVER (ORDER BY search_duration, row_id) AS place FROM routes_scored WHERE search_duration IS NOT NULL ORDER BY search_duration, row_id LIMIT 100")
def stable_order(s, d):
    top = R.top_n(table(s, d, "routes_scored").filter("search_duration is not null"), 100, F.col("search_duration"), F.col("row_id")).select("row_id").collect()
    return s.createDataFrame([(r[0], i) for i, r in enumerate(top, 1)], "row_id long, place long")


_PAIRS = "SELECT * FROM (SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_discount']) AS \"left\", unnest(['l_extendedprice', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS \"right\", unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_quantity, l_tax), corr(l_extendedprice, l_discount), corr(l_extendedprice, l_tax), corr(l_discount, l_tax)]) AS r FROM lineitem)"
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"SELECT \"left\", \"right\", round(r, 6) AS r FROM ({_PAIRS}) WHERE abs(r) >= 0.001")
def strong_pairs(s, d):
    """Pairs of columns by |r|, from a limit on."""
    own = M.correlations(table(s, d, "lineitem"), _MEASURES)
    return rounded(M.strongest_pairs(own, 0.001))


@query(f"SELECT \"right\" AS column, row_number() OVER (ORDER BY abs(r) DESC, \"right\") AS place, round(r, 6) AS r FROM ({_PAIRS}) WHERE \"left\" = 'l_quantity'")
def columns_by_target(s, d):
    got = M.target_correlations(M.correlations(table(s, d, "lineitem"), _MEASURES), "l_quantity").collect()
    return rounded(s.createDataFrame([(r["column"], i, r["r"]) for i, r in enumerate(got, 1)], "column string, place long, r double"))


@query("SELECT 200::BIGINT AS n, 200::BIGINT AS n_distinct, true AS repeats_itself, true AS within")
def seeded_samples(s, d):
    """A sample without replacement is the same whatever the partitions, and another for another seed."""
    own = table(s, d, "routes_scored").select("row_id")
    one, again, other = R.seeded_sample(own, 200, "row_id", 1), R.seeded_sample(own.repartition(7), 200, "row_id", 1), R.seeded_sample(own, 200, "row_id", 2)
    both = one.join(again, "row_id").agg(F.count("*").alias("b"))
    differs = one.join(other, "row_id").agg((F.count("*") < 200).alias("o"))
    whole = one.join(own, "row_id", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_distinct"))
    return whole.join(F.broadcast(both), F.lit(True)).join(F.broadcast(differs), F.lit(True)).select("n", "n_distinct", ((F.col("b") == 200) & F.col("o")).alias("repeats_itself"), (F.col("n") == 200).alias("within"))


@query("SELECT count(DISTINCT smiles) AS n_keys, count(DISTINCT smiles) AS n_in_tasks, 4::BIGINT AS n_tasks FROM routes_scored")
def tasks_share_all_keys(s, d):
    """Distinct keys dealt to four tasks: each key to one, none lost."""
    own = table(s, d, "routes_scored")
    dealt = R.tagged_union({str(t): R.round_robin_chunk(own, "smiles", t, 4) for t in range(4)}, "task")
    return dealt.agg(F.count_distinct("smiles").alias("n_keys"), F.count("*").alias("n_in_tasks"), F.count_distinct("task").alias("n_tasks"))


@query("SELECT unnest([1, 2, 3, 4]) AS place, unnest(['b', 'a', 'c', 'd']) AS label")
def labels_in_preferred_order(s, d):
    return s.createDataFrame(list(enumerate(R.preferred_order(["a", "c", "b", "d"], ["x", "b", "a"]), 1)), "place int, label string")


@query("SELECT smiles FROM routes_test UNION SELECT smiles FROM shared_test_set")
def union_of_distinct(s, d):
    return R.distinct_union(table(s, d, "routes_test").select("smiles"), table(s, d, "shared_test_set").select("smiles"))


_TOP = "SELECT o_orderkey FROM orders ORDER BY {} DESC, o_orderkey LIMIT (SELECT greatest(1, (count(*) / 10)::INT) FROM orders)"


@query(f"WITH a AS ({_TOP.format('o_totalprice')}), b AS ({_TOP.format('o_totalprice + (o_orderkey % 97) * 1000')}), n AS (SELECT count(*) AS k FROM a), m AS (SELECT count(*) AS x FROM a JOIN b USING (o_orderkey)) SELECT round(x / (2.0 * k - x), 6) AS top_jaccard, (SELECT round(corr(o_totalprice, o_totalprice + (o_orderkey % 97) * 1000), 6) FROM orders) AS pearson, (SELECT round(avg((o_orderkey % 97) * 1000), 4) FROM orders) AS mean_diff FROM n, m")
def top_tenths(s, d):
    """Agreement of two scores: shared part of their top tenths, correlation, mean difference."""
    own = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("a")).withColumn("b", F.col("a") + (F.col("o_orderkey") % 97) * 1000)
    got = M.agreement(own, "a", "b", "o_orderkey", 150000.0)
    return got.select(F.round("top_jaccard", 6).alias("top_jaccard"), F.round("pearson", 6).alias("pearson"), F.round("mean_diff", 4).alias("mean_diff"))


# Labels and terms -----------------------------------------------------------------------------------------------------------------


@query("SELECT row_id, upper(split_part(datasource, '-', 1)) AS label, regexp_replace(coalesce(warhead_id, 'x') || '_task' || row_id || '_old', '_task[0-9]+.*$', '') AS stem, CASE split_part(coalesce(warhead_id, 'x'), '_', 1) WHEN 'WH' THEN 'warhead' ELSE split_part(coalesce(warhead_id, 'x'), '_', 1) END AS kind, CASE WHEN row_id % 2 = 0 THEN 'Best-5' ELSE 'Uniform' END AS strategy, 'TARGET - SCORE: ' || printf('%.1f', row_id / 2.0) AS target, 'n: ' || row_id AS legend, concat_ws('|', 'methyl', coalesce(e3_ligase_ligand_id, 'none')) AS caps FROM routes_scored")
def display_texts(s, d):
    code = F.coalesce("warhead_id", F.lit("x"))
    return table(s, d, "routes_scored").select(
        "row_id", labels.upper_label(F.translate("datasource", "-", "_")).alias("label"), labels.without_task(F.concat(code, F.lit("_task"), F.col("row_id"), F.lit("_old"))).alias("stem"), labels.code_name(code, {"WH": "warhead"}).alias("kind"),
        labels.pretty(F.when(F.col("row_id") % 2 == 0, "best_5").otherwise("uniform")).alias("strategy"), F.replace(labels.target_label(F.col("row_id") / 2), F.lit(","), F.lit("")).alias("target"), labels.legend("n", F.col("row_id")).alias("legend"), F.concat_ws("|", F.lit("methyl"), F.coalesce("e3_ligase_ligand_id", F.lit("none"))).alias("caps"),
    )


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-l_discount)), 6) AS sigmoid, round(1 - (l_quantity - 1) / 9, 6) AS ease, round(1 - (l_linenumber - 1) / 4, 6) AS simple, CASE WHEN l_linenumber <> 3 THEN round(least(l_extendedprice, 10000), 4) END AS bounded FROM lineitem")
def rescaled_values(s, d):
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("inf"))).otherwise(F.col("l_extendedprice").cast("double"))
    own = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scores.sigmoid(F.col("l_discount").cast("double")).alias("sigmoid"), scores.accessibility(F.col("l_quantity").cast("double")).alias("ease"), scores.complexity(F.col("l_linenumber")).alias("simple"), F.round(scores.bounded(x), 4).alias("bounded"))
    return rounded(own)


@query("SELECT row_id, replace(replace(warhead_scaffold || '[*:1]*', '[*:1]', '[H]'), '*', '[H]') AS bare FROM scaffolds WHERE warhead_scaffold IS NULL OR position('*' IN warhead_scaffold) = 0")
def structures_without_tags(s, d):
    own = table(s, d, "scaffolds").filter("warhead_scaffold is null or instr(warhead_scaffold, '*') = 0")
    return own.select("row_id", labels.without_tags(F.concat("warhead_scaffold", F.lit("[*:1]*"))).alias("bare"))


@query("SELECT * FROM (VALUES ('pair', 'product', 'molecule,datasource'), ('either', 'union', 'molecule,datasource'), ('molecule', 'single', 'molecule'), ('molecule&linker', 'product', 'molecule,linker'), ('molecule+linker', 'union', 'molecule,linker'), ('bad', 'error', '')) AS t(name, mode, columns)")
def group_key_grammar(s, d):
    own = table(s, d, "scaffolds").columns
    keys = [labels.group_key(x, own) for x in ("pair=molecule&datasource", "either=molecule+datasource", "molecule")] + labels.key_combinations(["molecule", "linker"])
    rows = [(k.name, k.mode, ",".join(k.columns)) for k in keys]
    try:
        labels.group_key("bad=molecule&datasource+reference", own)
    except ValueError:
        rows.append(("bad", "error", ""))
    return s.createDataFrame(rows, "name string, mode string, columns string")


@query("SELECT * FROM (VALUES (0, 3, 'http://a', 8001, 'v1'), (1, 3, 'http://b', 8000, 'v1'), (2, 3, 'http://localhost', 8000, 'v1')) AS t(i, n, host, port, version)")
def parallel_parameters(s, d):
    """As many sets of parameters as the longest list has; short lists take defaults, one shared value must be the same everywhere."""
    hosts, ports, versions = ["http://a", "http://b"], [8001, None, None], ["v1", "v1"]
    n = labels.list_count(hosts=hosts, ports=ports)
    rows = [(i, n, labels.at_index(hosts, i, "http://localhost"), labels.at_index(ports, i, 8000), labels.shared_value(versions, "version", "v0")) for i in range(n)]
    return s.createDataFrame(rows, "i int, n int, host string, port int, version string")


_LETTERS = "list_distinct(regexp_extract_all(smiles, '[A-Za-z]'))"


@query(f"SELECT a.id, round(1 - len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS distance FROM (SELECT id, {_LETTERS} AS t FROM stock) a, (SELECT {_LETTERS} AS t FROM stock WHERE id = (SELECT min(id) FROM stock)) b")
def distances_to_first(s, d):
    tokens = F.array_distinct(F.regexp_extract_all("smiles", F.lit("([A-Za-z])"), F.lit(1)))
    own = table(s, d, "stock").select("id", tokens.alias("t"))
    first = R.top_n(own, 1, F.col("id")).select(F.col("t").alias("u"))
    return rounded(own.join(F.broadcast(first), F.lit(True)).select("id", SI.tanimoto_distance(F.col("t"), F.col("u")).alias("distance")))


@query(f"SELECT id, round(CASE WHEN f = 1 OR c = 1 THEN 1 - (f = 1 AND c = 1)::INT ELSE 1 END, 6)::DOUBLE AS distance, NOT (f = 1 AND c = 1 AND len(smiles) > 0) AS novel FROM (SELECT id, smiles, (smiles LIKE '%F%')::INT AS f, (smiles LIKE '%Cl%')::INT AS c FROM stock WHERE smiles IS NOT NULL)")
def presence_distances(s, d):
    """Distance of one-place presence vectors, and novelty of a one-token set against the tokens used."""
    own = table(s, d, "stock").filter("smiles is not null").select("id", F.col("smiles").contains("F").cast("int").alias("f"), F.col("smiles").contains("Cl").cast("int").alias("c"))
    distance = SI.presence_distance(F.array("f"), F.array("c"))
    used = F.array(F.when(F.col("f") == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))))
    return own.select("id", distance.cast("double").alias("distance"), SI.is_novel(F.when(F.col("c") == 1, F.array(F.lit("x"))).otherwise(F.array(F.lit("z"))), used).alias("novel"))


@query("SELECT a.label, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT a.label, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) a GROUP BY 1")
def distances_within(s, d):
    """Mean, least and largest pair distance inside each label, by blocks of vectors."""
    return rounded(SI.within_distances(table(s, d, "embeddings"), "label", "vec_id", "embedding"))


# Evaluation -----------------------------------------------------------------------------------------------------------------------


_BY_FOLD = "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'GNN' ELSE 'MLP' END AS model, o_custkey % 2 AS seed, o_custkey % 3 AS fold, avg(o_totalprice) AS rmse, stddev_samp(o_totalprice) AS spread FROM orders GROUP BY 1, 2, 3"


def _by_fold(s, d):
    price = F.col("o_totalprice").cast("double")
    return table(s, d, "orders").groupBy(F.when(F.col("o_orderkey") % 2 == 0, "GNN").otherwise("MLP").alias("model"), (F.col("o_custkey") % 2).alias("seed"), (F.col("o_custkey") % 3).alias("fold")).agg(F.avg(price).alias("rmse"), F.stddev_samp(price).alias("spread"))


@query(f"SELECT seed, fold, dense_rank() OVER (ORDER BY seed, fold) AS cv_cycle, round(max(rmse) FILTER (WHERE model = 'GNN'), 4) AS \"GNN_rmse\", round(max(rmse) FILTER (WHERE model = 'MLP'), 4) AS \"MLP_rmse\" FROM ({_BY_FOLD}) GROUP BY 1, 2")
def cross_validation_frame(s, d):
    _, wide = A.fold_frames(_by_fold(s, d), ["rmse"])
    return rounded(wide.withColumn("cv_cycle", F.col("cv_cycle").cast("long")), 4)


@query(f"SELECT model, metric, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, count(*) AS n FROM (SELECT model, 'rmse' AS metric, rmse AS v FROM ({_BY_FOLD}) UNION ALL SELECT model, 'spread', spread FROM ({_BY_FOLD})) GROUP BY 1, 2")
def cross_validation_summary(s, d):
    long, _ = A.fold_frames(_by_fold(s, d), ["rmse", "spread"])
    return rounded(A.fold_summary(long, ["model", "metric"], "value"), 4)


@query(f"SELECT model, round(avg(rmse), 4) AS cv_mean, round(stddev_samp(rmse), 4) AS cv_std, (SELECT round(avg(o_totalprice), 4) FROM orders WHERE o_orderstatus = 'F') AS held_out FROM ({_BY_FOLD}) GROUP BY 1")
def remaining_metrics(s, d):
    """Cross-validated mean and spread of a metric beside its held-out value."""
    cv = A.fold_summary(_by_fold(s, d), ["model"], "rmse").select("model", F.col("mean").alias("cv_mean"), F.col("std").alias("cv_std"))
    held = table(s, d, "orders").filter("o_orderstatus = 'F'").agg(F.avg(F.col("o_totalprice").cast("double")).alias("held_out"))
    return rounded(cv.join(F.broadcast(held), F.lit(True)), 4)


@query("WITH v AS (SELECT 'n' AS name, l_linenumber::VARCHAR AS x FROM lineitem UNION ALL SELECT 'mode', l_linestatus FROM lineitem), m AS (SELECT name, x, count(*) AS k, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, x) AS r FROM v GROUP BY 1, 2) SELECT name, n, numeric, median, q25, q75, CASE WHEN NOT numeric THEN x END AS mode, CASE WHEN NOT numeric THEN k END AS n_mode FROM (SELECT name, count(*) AS n, count(try_cast(x AS DOUBLE)) = count(*) AS numeric, quantile_cont(try_cast(x AS DOUBLE), 0.5) AS median, quantile_cont(try_cast(x AS DOUBLE), 0.25) AS q25, quantile_cont(try_cast(x AS DOUBLE), 0.75) AS q75 FROM v GROUP BY 1) JOIN m USING (name) WHERE r = 1")
def chosen_parameters(s, d):
    """Median and quartiles of number parameters, the commonest value of the others."""
    own = table(s, d, "lineitem").select(F.explode(F.array(F.struct(F.lit("n").alias("name"), F.col("l_linenumber").cast("string").alias("x")), F.struct(F.lit("mode").alias("name"), F.col("l_linestatus").alias("x")))).alias("p")).select("p.*")
    return A.selection_summary(own, "name", "x")


@query("SELECT o_orderpriority AS study, count(*) AS n_trials, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 4) AS pct_pruned, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean, round(stddev_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS std FROM orders GROUP BY 1")
def studies(s, d):
    own = table(s, d, "orders").select(F.col("o_orderpriority").alias("study"), F.col("o_totalprice").cast("double").alias("value"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "P", "PRUNED").otherwise("FAIL").alias("state"))
    return rounded(A.study_summary(own, ["study"], "value", "state"), 4)


@query("SELECT o_orderkey, seed, fold, CASE WHEN seed IS NULL THEN 1 + (SELECT count(*) FROM (SELECT DISTINCT o_custkey % 2, o_custkey % 3 FROM orders)) ELSE block END AS block FROM (SELECT o_orderkey, o_custkey % 2 AS seed, o_custkey % 3 AS fold, dense_rank() OVER (ORDER BY o_custkey % 2, o_custkey % 3) AS block FROM orders UNION ALL SELECT l_orderkey, NULL, NULL, NULL FROM lineitem WHERE l_linenumber = 7)")
def folds_and_held_out(s, d):
    """Folds numbered in visiting order, the held-out rows as the last block."""
    own = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2).alias("seed"), (F.col("o_custkey") % 3).alias("fold"))
    held = table(s, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.numbered_folds(own, held).select("o_orderkey", "seed", "fold", F.col("block").cast("long").alias("block"))


_CLASS = "SELECT l_returnflag AS target, count(*) FILTER (WHERE t AND q) AS tp, count(*) FILTER (WHERE NOT t AND q) AS fp, count(*) FILTER (WHERE NOT t AND NOT q) AS tn, count(*) FILTER (WHERE t AND NOT q) AS fn FROM (SELECT l_returnflag, l_quantity / 50.0 >= 0.7 AS t, l_discount * 10 >= 0.7 AS q FROM lineitem) GROUP BY 1"


@query(f"SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, round(avg(tp::DOUBLE / (tp + fp)), 6) AS precision, round(avg(tp::DOUBLE / (tp + fn)), 6) AS recall, sum(tp + fp + tn + fn)::BIGINT AS n_samples, (SELECT round(sqrt(avg((l_quantity / 50.0 - l_discount * 10) ^ 2)), 6) FROM lineitem) AS rmse FROM ({_CLASS})")
def averaged_targets(s, d):
    """Rates averaged over targets, counts summed, and the regression side in the same flat row with the number of rows."""
    own = table(s, d, "lineitem").select(F.col("l_returnflag").alias("target"), (F.col("l_quantity") / 50.0).cast("double").alias("y"), (F.col("l_discount") * 10).cast("double").alias("p"))
    return rounded(M.all_metrics(own, "y", "p", "target", 0.7).select("tp", "fp", "tn", "fn", "precision", "recall", "n_samples", "rmse"))


@query("SELECT o_orderstatus, round(0.5 * rmse + 0.5 * (0.75 * (1 - coalesce(r, -1)) + 0.25 * 2), 6) AS objective FROM (SELECT o_orderstatus, avg(o_totalprice) / 1e6 AS rmse, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE corr(o_totalprice, o_custkey) END AS r FROM orders GROUP BY 1)")
def search_objective(s, d):
    """Error and rank correlation weighed; an undefined correlation counts -1."""
    own = table(s, d, "orders").groupBy("o_orderstatus").agg((F.avg(F.col("o_totalprice").cast("double")) / 1e6).alias("rmse"), F.corr(F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")).alias("r"))
    r = F.when(F.col("o_orderstatus") != "P", F.col("r"))
    return rounded(own.select("o_orderstatus", M.hpo_objective(F.col("rmse"), r, F.lit(None).cast("double"), 0.5, 0.25).alias("objective")))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(b / (a - 1)), 6) AS aleatoric_std, round(sqrt(b / (a - 1) / v), 6) AS epistemic_std, round(sqrt(b / (a - 1) + b / (a - 1) / v), 6) AS total_std FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS v, l_linenumber + 1.5 AS a, l_tax + 0.1 AS b FROM lineitem)")
def evidential_views(s, d):
    made = M.evidential_spreads(F.col("l_quantity").cast("double"), F.col("l_linenumber") + 1.5, F.col("l_tax").cast("double") + 0.1)
    return rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in made.items())))


@query("WITH m AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), z AS (SELECT l_returnflag, abs(l_quantity - m) AS z FROM lineitem JOIN m USING (l_returnflag)), g AS (SELECT l_returnflag, count(*) AS n, avg(z) AS a, var_pop(z) AS v FROM z GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * a) AS s, sum(n * a * a) AS q FROM g) SELECT round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 4) AS w, k AS n_groups, round((SELECT max(v) / min(v) FROM m), 6) AS variance_ratio, (SELECT max(v) / min(v) FROM m) <= 9 AS parametric FROM t")
def equal_variances(s, d):
    got = M.levene(table(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "q", "l_returnflag")
    return got.select(F.round("w", 4).alias("w"), "n_groups", F.round("variance_ratio", 6).alias("variance_ratio"), M.may_use_parametric(F.lit(0.01), F.col("variance_ratio")).alias("parametric"))


@query("SELECT 1.0 AS same, NULL::DOUBLE AS none")
def means_of_what_there_is(s, d):
    """A mean of nothing is null, not an error."""
    own = s.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    return own.agg(F.avg("a").alias("same"), F.avg("b").alias("none"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in Q.items() if q}

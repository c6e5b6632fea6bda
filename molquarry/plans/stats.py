"""Queries of aggregates, windows and metrics on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import scores
from molquarry.operators import aggregates as A
from molquarry.operators import metrics as M
from molquarry.runtime import table
from molquarry.streaming import scores as ST

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, as the SQL rounds them."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


_STATS = "round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max"
_CLEAN = "CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


@query("SELECT datasource AS value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM routes_scored), 6) AS share FROM routes_scored GROUP BY 1")
def source_counts(s, d):
    return rounded(A.value_counts(table(s, d, "routes_scored"), "datasource"))


@query(f"SELECT l_returnflag, count(l_extendedprice) AS count, {_STATS.format(x='l_extendedprice')} FROM lineitem GROUP BY 1")
def price_summary(s, d):
    return rounded(A.describe(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag"))


@query(f"SELECT datasource, count(x) AS count, {_STATS.format(x='x')} FROM (SELECT datasource, {_CLEAN.format(x='score')} AS x FROM routes_scored) GROUP BY 1")
def score_summary(s, d):
    return rounded(A.describe(table(s, d, "routes_scored"), "score", "datasource"))


@query("".join(f"{'UNION ALL ' if i else ''}SELECT '{c}' AS \"column\", count(x) AS count, count(*) - count(x) AS n_missing, round(100.0 * (count(*) - count(x)) / count(*), 6) AS pct_missing, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max FROM (SELECT CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END AS x FROM routes_scored) " for i, c in enumerate(("score", "search_duration", "struct_n_steps"))))
def column_summary(s, d):
    return rounded(A.describe_columns(table(s, d, "routes_scored"), ["score", "search_duration", "struct_n_steps"]))


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std, round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(max(o_totalprice), 6) AS max FROM orders GROUP BY 1")
def order_spread(s, d):
    return rounded(A.spread_report(table(s, d, "orders"), "o_totalprice", "o_orderstatus"))


@query("SELECT count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS q{int(100 * q):02d}" for q in A.SUMMARY_QUANTILES) + f" FROM (SELECT {_CLEAN.format(x='synthesizability')} AS x FROM routes_train_val)")
def score_quantiles(s, d):
    return rounded(A.quantile_summary(table(s, d, "routes_train_val"), "synthesizability"))


@query("SELECT bin::INT AS bin, count(x) AS n FROM range(10) r(bin) LEFT JOIN (SELECT least(floor(synthesizability * 10), 9) AS x FROM routes_train_val WHERE NOT isnan(synthesizability) AND synthesizability BETWEEN 0 AND 1) ON x = bin GROUP BY 1")
def score_histogram(s, d):
    return A.score_bins(table(s, d, "routes_train_val"), "synthesizability")


@query("SELECT bin::INT AS bin, low::DOUBLE AS low, high::DOUBLE AS high, count(x) AS n FROM (VALUES (0, 0, 10), (1, 10, 100), (2, 100, 1000)) b(bin, low, high) LEFT JOIN (SELECT search_duration AS x FROM routes_scored) ON (x >= low AND x < high) OR (bin = 2 AND x = high) GROUP BY 1, 2, 3")
def duration_histogram(s, d):
    return A.histogram(table(s, d, "routes_scored"), "search_duration", [0, 10, 100, 1000])


@query("SELECT l_orderkey, round(a, 12) AS availability, round(0.95 * a + 0.05 * (1 - n / 20.0), 12) AS score FROM (SELECT l_orderkey, count(*) AS n, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN p_size ELSE 0 END)::DOUBLE / nullif(sum(p_size), 0), 0) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)")
def order_availability(s, d):
    own = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("in_stock", F.col("l_returnflag") != "R")
    return rounded(A.weighted_availability(own, ["l_orderkey"], "p_size", "in_stock", F.count("*")), 12)


@query("SELECT s_nationkey, string_agg(DISTINCT s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR) AS suppliers, count(DISTINCT s_suppkey)::INT AS n_suppliers FROM supplier GROUP BY 1")
def supplier_lists(s, d):
    return A.joined_members(table(s, d, "supplier"), ["s_nationkey"], "s_suppkey", "suppliers")


@query("SELECT event_type, user_id % 7 AS weekday, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS pct FROM events GROUP BY 1, 2")
def percent_of_type(s, d):
    own = table(s, d, "events").withColumn("weekday", F.col("user_id") % 7)
    return rounded(A.percent_within(own, "event_type", "weekday"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\", count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1")
def pivoted_status(s, d):
    return A.pivot_counts(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


@query("SELECT row_id, 'warhead' AS component, warhead_scaffold AS scaffold FROM scaffolds UNION ALL SELECT row_id, 'linker', linker_scaffold FROM scaffolds UNION ALL SELECT row_id, 'e3', e3_scaffold FROM scaffolds")
def component_rows(s, d):
    return A.melted(table(s, d, "scaffolds"), ["row_id"], {"warhead": ["warhead_scaffold"], "linker": ["linker_scaffold"], "e3": ["e3_scaffold"]}, ["scaffold"])


@query("SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, max(n) AS largest, round(quantile_cont(n, 0.5), 6) AS median, count(*) FILTER (WHERE n = 1) AS n_singletons, max(n) * 5 <= sum(n) AS fits_a_fold FROM (SELECT warhead_scaffold, count(*) AS n FROM scaffolds WHERE warhead_scaffold IS NOT NULL GROUP BY 1)")
def scaffold_sizes(s, d):
    return rounded(A.group_sizes(table(s, d, "scaffolds"), "warhead_scaffold"))


@query("SELECT key, sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, sum(n - 1)::BIGINT AS n_repeats FROM (SELECT key, v, count(*) AS n FROM (SELECT unnest(['warhead_scaffold', 'linker_scaffold', 'e3_scaffold']) AS key, unnest([warhead_scaffold, linker_scaffold, e3_scaffold]) AS v FROM scaffolds) WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def scaffold_overview(s, d):
    return A.key_overview(table(s, d, "scaffolds"), ["warhead_scaffold", "linker_scaffold", "e3_scaffold"])


_ETA = "SELECT '{t}' AS target, '{k}' AS key, count(*) AS n, count(DISTINCT g) AS n_groups, round(sum((m - a) ^ 2) / sum((x - a) ^ 2), 6) AS eta2 FROM (SELECT x, g, avg(x) OVER (PARTITION BY g) AS m, avg(x) OVER () AS a FROM (SELECT {t}::DOUBLE AS x, {k}::VARCHAR AS g FROM lineitem JOIN part ON l_partkey = p_partkey))"


@query(" UNION ALL ".join(_ETA.format(t=t, k=k) for t in ("l_extendedprice", "l_discount") for k in ("p_brand", "p_type", "l_returnflag")))
def variance_explained(s, d):
    own = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(A.eta_squared(own, ["l_extendedprice", "l_discount"], ["p_brand", "p_type", "l_returnflag"]))


@query("SELECT 'l_orderkey' AS grouped_by, leaked_key, seed, fold, round(avg(seen::DOUBLE), 6) AS frac_seen FROM (SELECT leaked_key, seed, fold, CASE WHEN min(fold) OVER (PARTITION BY leaked_key, seed, v) <> max(fold) OVER (PARTITION BY leaked_key, seed, v) THEN 1 ELSE 0 END AS seen FROM (SELECT seed, ((l_orderkey + seed) % 5)::INT AS fold, unnest(['l_partkey', 'l_suppkey']) AS leaked_key, unnest([l_partkey, l_suppkey]) AS v FROM lineitem, (VALUES (0::BIGINT), (3::BIGINT)) q(seed))) GROUP BY 1, 2, 3, 4")
def fold_leakage(s, d):
    own = table(s, d, "lineitem")
    keyed = own.withColumn("row", F.struct("l_orderkey", "l_linenumber")).withColumn("row", F.to_json("row"))
    folds = own.select("l_orderkey").distinct().withColumn("seed", F.explode(F.array(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("fold", ((F.col("l_orderkey") + F.col("seed")) % 5).cast("int"))
    return rounded(A.leakage(keyed, folds, "l_orderkey", "l_orderkey", ["l_partkey", "l_suppkey"]))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1")
def fold_values(s, d):
    return rounded(A.fold_summary(table(s, d, "events"), ["event_type"], "value"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def best_of_each(s, d):
    return A.best_per_metric(table(s, d, "part"), "p_partkey", "p_brand", "p_retailprice", [])


_LEVELS = "SELECT count(*) AS n_levels, round(exp(-sum(p * ln(p))), 6) AS effective_levels, round(100 * max(p), 6) AS pct_at_mode, round(100 * sum(CASE WHEN v = top THEN p ELSE 0 END), 6) AS pct_at_max FROM (SELECT v, n / sum(n) OVER () AS p, max(v) OVER () AS top FROM (SELECT round(l_discount, 6) AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1))"


@query(_LEVELS)
def discount_levels(s, d):
    return rounded(A.term_levels(table(s, d, "lineitem"), "l_discount"))


@query("SELECT source, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS composition FROM (SELECT source, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def source_composition(s, d):
    return A.composition(table(s, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("none"))), "source", "lang")


@query("SELECT event_id, round(coalesce(min(v) OVER (PARTITION BY user_id ORDER BY event_id), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS best FROM (SELECT *, CASE WHEN event_type <> 'click' THEN value END AS v FROM events)")
def best_value_so_far(s, d):
    own = table(s, d, "events").withColumn("state", F.when(F.col("event_type") == "click", "PRUNED").otherwise("COMPLETE"))
    return rounded(A.best_so_far(own, ["user_id"], "event_id", "value", "state").select("event_id", "best"))


@query("SELECT p_partkey, round(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0, 6) AS size_rank, round((rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / count(*) OVER (), 6) AS price_rank FROM part")
def part_ranks(s, d):
    own = A.fractional_rank(A.average_ranks(table(s, d, "part"), "p_size", "size_rank"), "p_retailprice", "price_rank")
    return rounded(own.select("p_partkey", "size_rank", "price_rank"))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS balance, round(1 - (c_acctbal - min(c_acctbal) OVER (PARTITION BY c_mktsegment)) / (max(c_acctbal) OVER (PARTITION BY c_mktsegment) - min(c_acctbal) OVER (PARTITION BY c_mktsegment)), 6) AS in_segment FROM customer")
def scaled_balance(s, d):
    own = A.min_max(table(s, d, "customer"), "c_acctbal", "balance")
    return rounded(A.min_max(own, "c_acctbal", "in_segment", ["c_mktsegment"], invert=True).select("c_custkey", "balance", "in_segment"))


@query("SELECT x, round(count(*) FILTER (WHERE p_retailprice <= x)::DOUBLE / count(p_retailprice), 6) AS share FROM part, (SELECT unnest([900.0, 1000.0, 1200.0, 1500.0, 2000.0])::DOUBLE AS x) GROUP BY 1")
def price_ecdf(s, d):
    return rounded(A.ecdf(table(s, d, "part"), "p_retailprice", [900, 1000, 1200, 1500, 2000]))


@query("SELECT p_partkey, round((p_retailprice - m) / (1.4826 * mad), 6) AS robust_z FROM part, (SELECT quantile_cont(p_retailprice, 0.5) AS m FROM part), (SELECT quantile_cont(abs(p_retailprice - (SELECT quantile_cont(p_retailprice, 0.5) FROM part)), 0.5) AS mad FROM part)")
def robust_prices(s, d):
    return rounded(A.robust_z(table(s, d, "part"), "p_retailprice").select("p_partkey", "robust_z"))


@query("SELECT row_id, abs(search_duration - m) / (1.4826 * mad) > 3.5 AS is_outlier FROM routes_scored, (SELECT quantile_cont(search_duration, 0.5) AS m FROM routes_scored), (SELECT quantile_cont(abs(search_duration - (SELECT quantile_cont(search_duration, 0.5) FROM routes_scored)), 0.5) AS mad FROM routes_scored)")
def duration_outliers(s, d):
    return A.outlier_flags(table(s, d, "routes_scored"), "search_duration", heavy=1e9).select("row_id", "is_outlier")


@query("SELECT q AS quantile, round(t, 6) AS threshold, count(*) FILTER (WHERE o_totalprice > t) AS n_above FROM orders, (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS q, unnest((SELECT quantile_cont(o_totalprice, [0.5, 0.9, 0.99]) FROM orders)) AS t) GROUP BY 1, 2")
def threshold_counts(s, d):
    return rounded(A.threshold_sensitivity(table(s, d, "orders"), "o_totalprice", [0.5, 0.9, 0.99]))


@query("SELECT l_returnflag, round(0.5 * (1 - (1 - l_linenumber / 20.0)) + 0, 6) AS term, round(greatest(0, 1 - (greatest(l_linenumber, 1) - 1) / 10.0), 6) AS length_term, round(1 / (1 + exp(-l_discount)), 6) AS squashed, count(*) AS n FROM lineitem GROUP BY ALL")
def score_terms(s, d):
    own = table(s, d, "lineitem").select("l_returnflag", (0.5 * (1 - (1 - F.col("l_linenumber") / 20))).alias("term"), scores.length_term(F.col("l_linenumber")).alias("length_term"), scores.sigmoid(F.col("l_discount")).alias("squashed"))
    return rounded(own).groupBy("l_returnflag", "term", "length_term", "squashed").agg(F.count("*").alias("n"))


# Metrics: a prediction of line prices from quantity ----------------------------------------------------------------------------


def _predictions(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_shipdate", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1450.0).alias("p"), (F.col("l_tax") * 20000 + 500).alias("sd"))


_P = "(SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1450.0 AS p, l_tax * 20000 + 500 AS sd FROM lineitem)"


@query(f"SELECT l_returnflag, count(*) AS n, round(1 - sum((p - y) ^ 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((p - y) ^ 2)), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(quantile_cont(abs(p - y), 0.5), 6) AS medae, round(max(abs(p - y)), 6) AS max_error, round(1 - var_pop(p - y) / var_pop(y), 6) AS explained_variance, round(avg(p - y), 6) AS bias, round(corr(y, p), 6) AS pearson FROM {_P} GROUP BY 1")
def regression_report(s, d):
    return rounded(M.regression_metrics(_predictions(s, d), "y", "p", "l_returnflag"))


@query(f"SELECT l_returnflag, round(corr(a, b), 6) AS spearman FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1) / 2.0 AS b FROM {_P}) GROUP BY 1")
def rank_correlation(s, d):
    return rounded(M.spearman(_predictions(s, d), "y", "p", ["l_returnflag"]))


@query("WITH t AS (SELECT p_size AS x, length(p_name) AS y, row_number() OVER () AS i FROM part), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS c, (a.x = b.x)::INT AS tx, (a.y = b.y)::INT AS ty FROM t a JOIN t b ON a.i < b.i) SELECT round(sum(c) / sqrt((count(*) - sum(tx)) * (count(*) - sum(ty))::DOUBLE), 6) AS kendall FROM p")
def kendall_of_parts(s, d):
    return rounded(M.kendall(table(s, d, "part").withColumn("y", F.length("p_name")), "p_size", "y"))


@query("SELECT * FROM (SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_discount', 'l_discount', 'l_tax']) AS \"left\", unnest(['l_quantity', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS \"right\", unnest([1.0, round(corr(l_quantity, l_discount), 6), round(corr(l_quantity, l_tax), 6), 1.0, round(corr(l_discount, l_tax), 6), 1.0]) AS r FROM lineitem)")
def correlation_matrix(s, d):
    return rounded(M.correlations(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


_B = "SELECT l_returnflag, count(*) FILTER (WHERE t AND q)::DOUBLE AS tp, count(*) FILTER (WHERE NOT t AND q)::DOUBLE AS fp, count(*) FILTER (WHERE NOT t AND NOT q)::DOUBLE AS tn, count(*) FILTER (WHERE t AND NOT q)::DOUBLE AS fn FROM (SELECT l_returnflag, y >= 40000 AS t, p >= 40000 AS q FROM " + _P + ") GROUP BY 1"


@query(f"SELECT l_returnflag, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp + tn) / n, 6) AS accuracy, round(((tp + tn) / n - e) / (1 - e), 6) AS kappa, round((tp + fn) / n, 6) AS positive_rate, round((tp + fp) / n, 6) AS predicted_rate FROM (SELECT *, tp + fp + tn + fn AS n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (tp + fp + tn + fn) ^ 2 AS e FROM ({_B}))")
def classification_report(s, d):
    return rounded(M.binary_metrics(_predictions(s, d), "y", "p", 40000, "l_returnflag"))


@query(f"WITH g AS (SELECT l_returnflag AS f, p AS s, count(*) FILTER (WHERE y >= 40000)::DOUBLE AS a, count(*) FILTER (WHERE y < 40000)::DOUBLE AS b FROM {_P} GROUP BY 1, 2), r AS (SELECT *, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER (PARTITION BY f) AS ta, sum(b) OVER (PARTITION BY f) AS tb FROM g WINDOW w AS (PARTITION BY f ORDER BY s DESC)) SELECT f AS l_returnflag, round(sum(b * (tp - a / 2)) / max(ta * tb), 6) AS roc_auc, round(sum(a * tp / (tp + fp)) / max(ta), 6) AS pr_auc FROM r GROUP BY 1")
def ranking_report(s, d):
    return rounded(M.ranking_metrics(_predictions(s, d), "y", "p", 40000, ["l_returnflag"]))


@query("WITH c AS (SELECT o_totalprice AS v, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE AS b FROM orders GROUP BY 1) SELECT round(max(abs(sa / na - sb / nb)), 6) AS ks, max(na)::BIGINT AS n_true, max(nb)::BIGINT AS n_false FROM (SELECT sum(a) OVER (ORDER BY v) AS sa, sum(b) OVER (ORDER BY v) AS sb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c)")
def ks_of_orders(s, d):
    return rounded(M.ks_statistic(table(s, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F"))


@query("WITH c AS (SELECT o_orderpriority AS k, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE AS b FROM orders GROUP BY 1), t AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c) SELECT round(sum((a - (a + b) * na / (na + nb)) ^ 2 / ((a + b) * na / (na + nb)) + (b - (a + b) * nb / (na + nb)) ^ 2 / ((a + b) * nb / (na + nb))), 6) AS chi2, count(*) - 1 AS dof FROM t")
def chi_square_of_orders(s, d):
    return rounded(M.chi_square(table(s, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F"))


@query("SELECT unnest(['l_discount', 'l_tax']) AS term, unnest([round(covar_pop(l_discount * 0.6, l_discount * 0.6 + l_tax * 0.4) / var_pop(l_discount * 0.6 + l_tax * 0.4), 6), round(covar_pop(l_tax * 0.4, l_discount * 0.6 + l_tax * 0.4) / var_pop(l_discount * 0.6 + l_tax * 0.4), 6)]) AS share FROM lineitem")
def term_shares(s, d):
    return rounded(M.variance_shares(table(s, d, "lineitem"), {"l_discount": 0.6, "l_tax": 0.4}))


@query(f"SELECT l_returnflag, count(*) AS n, round(avg(sd), 6) AS mean_std, round(avg((abs(p - y) <= sd)::DOUBLE), 6) AS within_1, round(avg((abs(p - y) <= 2 * sd)::DOUBLE), 6) AS within_2, round(avg((abs(p - y) <= 3 * sd)::DOUBLE), 6) AS within_3, round(corr(sd, abs(p - y)), 6) AS std_error_r FROM {_P} GROUP BY 1")
def uncertainty_report(s, d):
    return rounded(M.uncertainty_metrics(_predictions(s, d), "y", "p", "sd", "l_returnflag"))


_CAL = "(SELECT least(floor(q * 10), 9)::INT AS bin, count(*) AS n, avg(q) AS confidence, avg((y >= 0.7)::DOUBLE) AS rate FROM (SELECT (l_extendedprice / 105000) AS y, least(greatest(l_quantity / 50.0, 1e-7), 1 - 1e-7) AS q FROM lineitem) GROUP BY 1)"


@query(f"SELECT bin, n, round(confidence, 6) AS confidence, round(rate, 6) AS rate FROM {_CAL}")
def calibration_bins(s, d):
    own = table(s, d, "lineitem").select((F.col("l_extendedprice") / 105000).alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return rounded(M.calibration(own, "y", "p"))


@query(f"SELECT round(sum(abs(confidence - rate) * n) / sum(n), 6) AS ece, round(max(abs(confidence - rate)), 6) AS mce FROM {_CAL}")
def calibration_error(s, d):
    own = table(s, d, "lineitem").select((F.col("l_extendedprice") / 105000).alias("y"), (F.col("l_quantity") / 50).alias("p"))
    return rounded(M.calibration_errors(M.calibration(own, "y", "p")))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_tax), 6) AS mean, round(skewness(l_tax), 4) AS skew, round(kurtosis(l_tax), 4) AS kurtosis FROM lineitem GROUP BY 1")
def tax_moments(s, d):
    return rounded(rounded(M.moments(table(s, d, "lineitem"), "l_tax", "l_returnflag")).withColumns({"skew": F.round("skew", 4), "kurtosis": F.round("kurtosis", 4)}))


@query("SELECT round(((sum(n * (m - a) ^ 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS f, sum(n)::BIGINT AS n, count(*) AS n_groups FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS w, (SELECT avg(o_totalprice) FROM orders) AS a FROM orders GROUP BY 1)")
def anova_of_orders(s, d):
    return rounded(M.anova(table(s, d, "orders"), "o_totalprice", "o_orderpriority"))


@query("SELECT user_id % 100 AS user_group, date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3")
def windowed_events(s, d):
    own = table(s, d, "events").withColumn("user_group", F.col("user_id") % 100)
    got = own.groupBy("user_group", F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(got.select("user_group", F.col("window.start").alias("window_start"), "event_type", "n", "mean"))


@query("SELECT w AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2")
def sliding_events(s, d):
    """Windows of two days that begin every day."""
    return rounded(ST.sliding_counts(table(s, d, "events"), "ts", "event_type", "value"))


@query("SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def user_sessions(s, d):
    return ST.sessions(table(s, d, "events"), "ts", "user_id", "6 hours")


@query("SELECT row_id, scored_at, loaded_at FROM routes_scored WHERE loaded_at > scored_at + INTERVAL 7 DAY")
def late_arrivals(s, d):
    """Rows that a watermark of a week may leave out."""
    return ST.late_rows(table(s, d, "routes_scored"), "scored_at", "loaded_at").select("row_id", "scored_at", "loaded_at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in Q.items() if q}

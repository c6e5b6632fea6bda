"""Queries of similarity, clustering, folds, picking, ensembles, models and scoring on the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.chem.backend import TextBackend, capped_variants
from molquarry.functions import labels
from molquarry.operators import ensembles as E
from molquarry.operators import metrics as M
from molquarry.operators import models as MO
from molquarry.operators import relational as R
from molquarry.operators import scoring as SC
from molquarry.operators import selection as SE
from molquarry.operators import similarity as SI
from molquarry.plans.routes import STOCK_KEYS
from molquarry.plans.stats import rounded
from molquarry.runtime import Scratch, table

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def _words(s, d):
    """Word sets of the stock's structure texts: their runs of letters."""
    return table(s, d, "stock").select("id", F.array_distinct(F.regexp_extract_all("smiles", F.lit("([A-Za-z]+[0-9]*)"), F.lit(1))).alias("tokens"))


_TOK = "t AS (SELECT id, list_distinct(regexp_extract_all(smiles, '[A-Za-z]+[0-9]*')) AS s FROM stock WHERE len(regexp_extract_all(smiles, '[A-Za-z]+[0-9]*')) > 0)"


@query(f"WITH {_TOK}, r AS (SELECT list_sort(s) AS s, min(id) AS id FROM t GROUP BY 1) SELECT * FROM (SELECT a.id AS \"left\", b.id AS \"right\", round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM r a JOIN r b ON a.id < b.id) WHERE jaccard >= 0.8 UNION ALL SELECT r.id, t.id, 1.0 FROM t JOIN r ON list_sort(t.s) = r.s WHERE t.id <> r.id")
def similar_stock(s, d):
    return rounded(SI.similar_sets(_words(s, d), "id", "tokens", 0.8))


_NEAR = f"""{_TOK}, r AS (SELECT list_sort(s) AS s, min(id) AS id FROM t GROUP BY 1),
pairs AS (SELECT a.id AS l, b.id AS o FROM r a JOIN r b ON a.id < b.id WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) >= 0.8 UNION ALL SELECT r.id, t.id FROM t JOIN r ON list_sort(t.s) = r.s WHERE t.id <> r.id),
near AS (SELECT k, list(DISTINCT o) AS o FROM (SELECT l AS k, o FROM pairs UNION ALL SELECT o, l FROM pairs) GROUP BY 1),
own AS MATERIALIZED (SELECT id, coalesce(o, []) AS o, row_number() OVER (ORDER BY {{order}}) AS i FROM stock LEFT JOIN near ON id = k),
walk(i, c) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT own.i, CASE WHEN list_has_any(c, own.o) THEN c ELSE list_append(c, own.id) END FROM walk JOIN own ON own.i = walk.i + 1),
picked AS (SELECT unnest(c) AS id FROM (SELECT c FROM walk ORDER BY i DESC LIMIT 1))"""


@query("WITH RECURSIVE " + _NEAR.format(order="-len(coalesce(o, [])), id") + ", first AS (SELECT k AS id, min_by(own.id, own.i) AS centre FROM (SELECT id AS k, unnest(o) AS n FROM own) JOIN picked ON picked.id = n JOIN own ON own.id = n GROUP BY 1) SELECT own.id, CASE WHEN picked.id IS NOT NULL THEN own.id ELSE centre END AS centre FROM own LEFT JOIN picked ON picked.id = own.id LEFT JOIN first ON first.id = own.id")
def stock_clusters(s, d):
    """Sphere exclusion on the similar pairs."""
    pairs = SI.similar_sets(_words(s, d), "id", "tokens", 0.8)
    return SE.sphere_exclusion(table(s, d, "stock").select("id"), pairs, "id")


@query("WITH RECURSIVE " + _NEAR.format(order="id") + " SELECT id FROM picked")
def stock_leaders(s, d):
    """Leaders by all similar pairs. A row with the set of an earlier one never is one: that row leads, or what is near it is near both."""
    scratch = Scratch(s)
    own = scratch.keep(SI.first_of_equal(_words(s, d), "id", "tokens"))
    got = SE.leaders(own.select("id"), SI.similar_sets(own, "id", "tokens", 0.8), "id")  # a written table: own can go
    scratch.drop()
    return got


@query("WITH RECURSIVE links AS (SELECT row_id, 'm' || molecule AS v FROM scaffolds WHERE molecule IS NOT NULL UNION ALL SELECT row_id, 'l' || linker_scaffold FROM scaffolds WHERE linker_scaffold IS NOT NULL), e AS (SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM links a JOIN links b USING (v) WHERE a.row_id <> b.row_id), reach(node, l) AS (SELECT row_id, row_id FROM scaffolds UNION SELECT e.b, reach.l FROM reach JOIN e ON node = a) SELECT node AS row_id, min(l) AS component FROM reach GROUP BY 1")
def linker_components(s, d):
    return SE.shared_components(table(s, d, "scaffolds"), "row_id", ["molecule", "linker_scaffold"])


_GROUPS = "SELECT warhead_scaffold AS g, count(*) AS n FROM scaffolds WHERE warhead_scaffold IS NOT NULL GROUP BY 1"


@query(f"SELECT unnest([0, 1])::BIGINT AS seed, count(*) AS n_groups, count(*) AS n_placed, sum(n)::BIGINT AS n_rows, 5::BIGINT AS n_folds, true AS balanced FROM ({_GROUPS})")
def scaffold_folds(s, d):
    """Of each seed's folds: groups, groups placed once, rows, folds, and whether no fold is larger than the smallest by more than the largest group."""
    own = table(s, d, "scaffolds")
    folds = SE.group_folds(own, "warhead_scaffold", "row_id", [0, 1])
    rows = own.groupBy("warhead_scaffold").agg(F.count("*").alias("n")).join(folds, "warhead_scaffold")
    sizes = rows.groupBy("seed", "fold").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("groups"), F.count_distinct("warhead_scaffold").alias("placed"))
    return sizes.groupBy("seed").agg(F.sum("groups").alias("n_groups"), F.sum("placed").alias("n_placed"), F.sum("n").alias("n_rows"), F.count_distinct("fold").alias("n_folds"), (F.max("n") - F.min("n") <= F.max("most")).alias("balanced"))


@query(f"SELECT count(*) AS n_groups, true AS whole_outer, true AS enough, true AS not_too_many FROM ({_GROUPS})")
def inner_parts(s, d):
    """Inner validation of one outer fold: every group has one part, and the inner part passes a fifth of the outer training rows by no more than a group."""
    own = table(s, d, "scaffolds")
    folds = SE.group_folds(own, "warhead_scaffold", "row_id", [0])
    parts = SE.inner_validation(own, folds, "warhead_scaffold", "row_id", 0, 1)
    sized = own.groupBy("warhead_scaffold").agg(F.count("*").alias("n")).join(parts, "warhead_scaffold").join(folds, "warhead_scaffold")
    of = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))
    quota = F.floor(0.2 * (of("inner_val") + of("inner_train")))
    return sized.agg(F.count("*").alias("n_groups"), F.bool_and((F.col("part") == "outer_val") == (F.col("fold") == 1)).alias("whole_outer"), (of("inner_val") >= quota).alias("enough"), (of("inner_val") - F.max("n") < quota).alias("not_too_many"))


@query("SELECT count(*) AS n_rows, 0::BIGINT AS n_split_groups, true AS share_reached, true AS not_passed_by_more_than_a_group FROM scaffolds")
def scaffold_split(s, d):
    """A test part of whole groups that reaches a fifth of the grouped rows."""
    own = table(s, d, "scaffolds").select("row_id", "warhead_scaffold")
    parted = SE.group_split(own, "warhead_scaffold", "row_id")
    groups = parted.groupBy("warhead_scaffold").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.count_if(F.col("part") == "test").alias("t"))
    known = F.col("warhead_scaffold").isNotNull()
    total, test = F.sum(F.when(known, F.col("n"))), F.sum("t")
    return groups.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("parts") > 1).alias("n_split_groups"), (test >= 0.2 * total).alias("share_reached"), (test - F.max(F.when(F.col("t") > 0, F.col("n"))) < 0.2 * total).alias("not_passed_by_more_than_a_group"))


@query(f"SELECT (SELECT count(*) FROM ({_GROUPS})) AS n_clusters, true AS within_target, true AS rest_would_not_fit")
def held_out_clusters(s, d):
    """Whole clusters up to 150 rows: none that is left out would still fit."""
    sizes = table(s, d, "scaffolds").filter("warhead_scaffold is not null").groupBy("warhead_scaffold").agg(F.count("*").alias("n"))
    taken = SE.filled_clusters(sizes, "warhead_scaffold", "n", 150)
    total = taken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    left = sizes.join(taken.select("warhead_scaffold"), "warhead_scaffold", "left_anti").agg(F.min("n").alias("least"))
    return sizes.agg(F.count("*").alias("n_clusters")).join(F.broadcast(total), F.lit(True)).join(F.broadcast(left), F.lit(True)).select("n_clusters", (F.col("total") <= 150).alias("within_target"), F.coalesce(F.col("total") + F.col("least") > 150, F.lit(True)).alias("rest_would_not_fit"))


@query("SELECT label, count(*) AS n, round(avg(embedding[1]), 5) AS first_mean, round(avg(embedding[64]), 5) AS last_mean FROM embeddings GROUP BY 1")
def embedding_centres(s, d):
    own = table(s, d, "embeddings")
    size = len(own.first()["embedding"])
    mid = SI.centroids(own, "label", "embedding", size)
    n = own.groupBy("label").agg(F.count("*").alias("n"))
    return rounded(mid.join(n, "label").select("label", "n", F.col("centroid")[0].alias("first_mean"), F.col("centroid")[63].alias("last_mean")), 5)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT vec_id AS r, e AS f FROM v WHERE vec_id % 50 = 0) SELECT vec_id, min(r) FILTER (WHERE sim >= best - 1e-12) AS nearest, round(max(sim), 6) AS similarity FROM (SELECT vec_id, r, sim, max(sim) OVER (PARTITION BY vec_id) AS best FROM (SELECT vec_id, r, list_cosine_similarity(e, f) AS sim FROM v, r)) GROUP BY 1")
def nearest_embeddings(s, d):
    own = table(s, d, "embeddings")
    return rounded(SI.nearest_reference(own, own.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id"))


_SPREADS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1), w AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM x GROUP BY 1)),
s AS (SELECT e.label, count(*) AS n, sum(list_distance(v, c)^2) AS w, avg(list_distance(v, c)) AS s, any_value(c) AS c FROM e JOIN m USING (label) GROUP BY 1)"""


@query(f"WITH {_SPREADS}, b AS (SELECT avg(r) AS d FROM (SELECT max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)) SELECT count(*) AS n_clusters, max(n) AS largest, round(avg(n), 4) AS mean_size, round((SELECT sum(s.n * list_distance(s.c, w.c)^2) FROM s, w) / (count(*) - 1) / (sum(s.w) / (sum(n) - count(*))), 4) AS calinski_harabasz, (SELECT round(d, 4) FROM b) AS davies_bouldin FROM s")
def embedding_clusters(s, d):
    own = table(s, d, "embeddings")
    return rounded(SE.cluster_quality(own, "label", "embedding", len(own.first()["embedding"])).drop("size_skew"), 4)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), walk(rank, vec_id, d, pick) AS (
  SELECT 1, e.vec_id, list_distance(e.v, o.v), o.vec_id FROM e, (SELECT * FROM e ORDER BY vec_id LIMIT 1) o
  UNION ALL SELECT w.rank + 1, w.vec_id, least(w.d, list_distance(e.v, n.v)), n.vec_id FROM walk w JOIN e ON e.vec_id = w.vec_id, (SELECT e.vec_id, e.v FROM (SELECT vec_id FROM walk ORDER BY d DESC, vec_id LIMIT 1) t JOIN e ON e.vec_id = t.vec_id) n WHERE w.rank < 25
) SELECT DISTINCT pick AS vec_id, rank::INT AS rank FROM walk""")
def farthest_embeddings(s, d):
    return SE.picked_rows(table(s, d, "embeddings"), "vec_id", "embedding", 25)


@query()
def central_embeddings(s, d):
    return SE.picked_rows(table(s, d, "embeddings"), "vec_id", "embedding", 12, "ward")


@query()
def varied_embeddings(s, d):
    own = table(s, d, "embeddings").select("vec_id", "embedding", F.slice("embedding", 1, 8).alias("head"))
    return rounded(SE.greedy_varied(own, "vec_id", 20, {"all": ("embedding", 0.7), "head": ("head", 0.3)}, seeds=[1, 2]))


# Ensembles: three predictors of order prices ----------------------------------------------------------------------------------


def _ensemble(s, d):
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"), "o_custkey")
    guesses = {"GNN_seed0_fold0": F.col("y") * 0.9 + 1000.0, "GNN_seed0_fold1": 150000.0 + (F.col("o_custkey") % 100) * 10, "MLP_seed0_fold0": F.col("y") * 0.5 + (F.col("row_id") % 1000) * 50.0}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), g.alias("y_pred")) for n, g in guesses.items()))).alias("p")
    return own.select("row_id", rows).select("row_id", "p.*"), own.select("row_id", F.col("y").alias("y_true"))


_GUESS = "(SELECT o_orderkey AS row_id, o_totalprice AS y_true, o_totalprice * 0.9 + 1000.0 AS a, 150000.0::DOUBLE + (o_custkey % 100) * 10 AS b, o_totalprice * 0.5 + (o_orderkey % 1000) * 50.0 AS c FROM orders)"


@query(f"SELECT row_id, round((a * 0.5 + b * 0.3 + c * 0.2), 4) AS y_pred, round(sqrt(((a - (a + b + c) / 3) ^ 2 + (b - (a + b + c) / 3) ^ 2 + (c - (a + b + c) / 3) ^ 2) / 3), 4) AS y_std, 3::BIGINT AS n_members FROM {_GUESS}")
def ensemble_means(s, d):
    predictions, _ = _ensemble(s, d)
    weights = s.createDataFrame([("GNN_seed0_fold0", 5.0), ("GNN_seed0_fold1", 3.0), ("MLP_seed0_fold0", 2.0)], "model string, weight double")
    return rounded(E.ensemble_predictions(predictions, E.normalised_weights(weights)), 4)


_TRIES = ", ".join(f"((ca + {i})^2 * aa + (cb + {j})^2 * bb + (cc + {k})^2 * c2 + 2 * (ca + {i}) * (cb + {j}) * ab + 2 * (ca + {i}) * (cc + {k}) * ac + 2 * (cb + {j}) * (cc + {k}) * bc) / (ca + cb + cc + 1)^2 / n AS m{x}" for x, (i, j, k) in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1))))
_GREEDY = f"""WITH RECURSIVE g AS MATERIALIZED (SELECT sum((a - y_true)^2) AS aa, sum((b - y_true)^2) AS bb, sum((c - y_true)^2) AS c2, sum((a - y_true) * (b - y_true)) AS ab, sum((a - y_true) * (c - y_true)) AS ac, sum((b - y_true) * (c - y_true)) AS bc, count(*)::DOUBLE AS n FROM {_GUESS} {{where}}),
walk(k, ca, cb, cc, mse) AS (
  SELECT 1, (aa <= bb AND aa <= c2)::INT, (bb < aa AND bb <= c2)::INT, (c2 < aa AND c2 < bb)::INT, least(aa, bb, c2) / n FROM g
  UNION ALL SELECT k + 1, ca + (m0 <= m1 AND m0 <= m2)::INT, cb + (m1 < m0 AND m1 <= m2)::INT, cc + (m2 < m0 AND m2 < m1)::INT, least(m0, m1, m2) FROM (SELECT *, {_TRIES} FROM walk, g WHERE k < 30)
), best AS (SELECT * FROM walk ORDER BY mse, k LIMIT 1)"""


@query(_GREEDY.format(where="") + " SELECT * FROM (SELECT unnest(['GNN_seed0_fold0', 'GNN_seed0_fold1', 'MLP_seed0_fold0']) AS model, unnest([ca / k, cb / k, cc / k]) AS weight FROM (SELECT round(ca / (ca + cb + cc), 6) AS ca, round(cb / (ca + cb + cc), 6) AS cb, round(cc / (ca + cb + cc), 6) AS cc, 1 AS k FROM best)) WHERE weight > 0")
def greedy_ensemble(s, d):
    predictions, truth = _ensemble(s, d)
    return rounded(E.greedy_selection(predictions, truth, 30))


_PLANS = {"best_single": "CASE WHEN ra <= rb AND ra <= rc THEN a WHEN rb <= rc THEN b ELSE c END", "uniform": "(a + b + c) / 3", "best_backend": "CASE WHEN (ra + rb) / 2 <= rc THEN (a + b) / 2 ELSE c END", "greedy": "(a * ca + b * cb + c * cc) / (ca + cb + cc)"}


@query(_GREEDY.format(where="WHERE row_id % 5 = 0") + ", r AS (SELECT sqrt(aa / n) AS ra, sqrt(bb / n) AS rb, sqrt(c2 / n) AS rc FROM g) " + " UNION ALL ".join(f"SELECT '{k}' AS strategy, round(sqrt(avg(({p} - y_true)^2)), 4) AS rmse, round(1 - sum(({p} - y_true)^2) / ((SELECT var_pop(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0) * count(*)), 6) AS r2 FROM {_GUESS}, r, best WHERE row_id % 5 <> 0" for k, p in _PLANS.items()))
def ensemble_strategies(s, d):
    predictions, truth = _ensemble(s, d)
    got = E.strategies(predictions, truth, truth.filter("row_id % 5 = 0"), 30)
    return got.select("strategy", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


_UNIT = f"(SELECT model, y_true / 500000 AS y, unnest AS p FROM (SELECT y_true, unnest(['GNN_seed0_fold0', 'GNN_seed0_fold1', 'MLP_seed0_fold0']) AS model, unnest([a, b, c]) / 500000 AS unnest FROM {_GUESS}))"
_LOSS = "least(greatest(p, 1e-7), 1 - 1e-7)"


@query(f"WITH m AS (SELECT model, avg((p - y)^2) AS mse, sqrt(avg((p - y)^2)) AS rmse, avg((p - y)^2) / var_pop(y) - 1 AS r2, avg(CASE WHEN y >= 0.3 THEN -ln({_LOSS}) ELSE -ln(1 - {_LOSS}) END) AS log_loss, avg((p - (y >= 0.3)::INT)^2) AS brier FROM {_UNIT} GROUP BY 1), r AS (SELECT model, y >= 0.3 AS t, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS k FROM {_UNIT}), a AS (SELECT model, -(sum(k) FILTER (WHERE t) - count(*) FILTER (WHERE t) * (count(*) FILTER (WHERE t) + 1) / 2.0) / (count(*) FILTER (WHERE t) * count(*) FILTER (WHERE NOT t)) AS auc FROM r GROUP BY 1) SELECT model, unnest(['rmse', 'mse', 'r2', 'auc', 'log_loss', 'brier']) AS metric, round(unnest([rmse, mse, r2, auc, log_loss, brier]), 6) AS value FROM m JOIN a USING (model)")
def selection_metrics(s, d):
    """Every metric that an ensemble may be selected by, of every member."""
    predictions, truth = _ensemble(s, d)
    own = predictions.join(truth, "row_id").select("model", (F.col("y_true") / 500000).alias("y"), (F.col("y_pred") / 500000).alias("p"))
    return rounded(reduce(DataFrame.unionByName, (E.selection_metric(own, "y", "p", m, 0.3, "model").withColumn("metric", F.lit(m)) for m in E.METRICS)))


@query(_GREEDY.format(where="").replace("WHERE k < 30", "WHERE k < 8") + " SELECT * FROM (SELECT unnest(['GNN_seed0_fold0', 'GNN_seed0_fold1', 'MLP_seed0_fold0']) AS model, unnest([round(ca / (ca + cb + cc), 6), round(cb / (ca + cb + cc), 6), round(cc / (ca + cb + cc), 6)]) AS weight FROM best) WHERE weight > 0")
def greedy_by_r2(s, d):
    """Selection under r2 by rounds over the rows: it must choose as that under squared error does."""
    predictions, truth = _ensemble(s, d)
    return rounded(E.greedy_by(predictions, truth, "r2", 8))


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)^2) AS s FROM e a, e b GROUP BY 1, 2, 3), d AS (SELECT vec_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p JOIN n ON n.label = other GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM d")
def label_silhouette(s, d):
    own = table(s, d, "embeddings")
    return rounded(SE.silhouette(own, "label", "embedding", len(own.first()["embedding"])))


@query("WITH RECURSIVE " + _NEAR.format(order="-len(coalesce(o, [])), id") + " SELECT 3::BIGINT AS n_cutoffs, (SELECT count(*) FROM picked) AS n_clusters_at_widest, true AS within_target, true AS tighter_when_narrower")
def held_out_sweep(s, d):
    """Clusters at three cutoffs, each with what it would hold out; the widest has as many clusters as stock_clusters."""
    keys, pairs = table(s, d, "stock").select("id"), SI.similar_sets(_words(s, d), "id", "tokens", 0.8)
    got = SE.cutoff_sweep(keys, pairs, "id", [0.05, 0.1, 0.2], 120)
    chosen = SE.adaptive_cutoff(got.select("cutoff", "n_held", "tightness"), 120)
    row = got.agg(F.count("*").alias("n_cutoffs"), F.max_by("n_clusters", "cutoff").alias("n_clusters_at_widest"), F.max("n_held").alias("most"), (F.max_by("tightness", "cutoff") <= F.min_by("tightness", "cutoff")).alias("tighter_when_narrower"))
    return row.join(F.broadcast(chosen.select("n_held")), F.lit(True)).select("n_cutoffs", "n_clusters_at_widest", ((F.col("most") <= 120) & (F.col("n_held") <= 120)).alias("within_target"), "tighter_when_narrower")


@query("SELECT count(*) AS n, 0::BIGINT AS n_moved, true AS centred FROM orders")
def normal_targets(s, d):
    """Prices brought to a normal distribution by their quantiles, and back again."""
    own = table(s, d, "orders").select(F.col("o_totalprice").cast("double").alias("y"))
    made = MO.QuantileNormal.fit(own, "y")
    there = own.select("y", made.forward(F.col("y")).alias("z"))
    return there.select("y", "z", made.inverse(F.col("z")).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("b") - F.col("y")) > 1e-6 * F.abs("y")).alias("n_moved"), ((F.abs(F.avg("z")) < 0.02) & (F.abs(F.stddev("z") - 1) < 0.05)).alias("centred"))


@query(f"SELECT unnest(['GNN_seed0_fold0', 'GNN_seed0_fold1', 'MLP_seed0_fold0']) AS model, unnest([round(sqrt(avg((a - y_true) ^ 2)), 4), round(sqrt(avg((b - y_true) ^ 2)), 4), round(sqrt(avg((c - y_true) ^ 2)), 4)]) AS rmse FROM {_GUESS}")
def member_errors(s, d):
    predictions, truth = _ensemble(s, d)
    return rounded(M.regression_metrics(predictions.join(truth, "row_id"), "y_true", "y_pred", "model").select("model", "rmse"), 4)


@query(f"SELECT 'GNN' AS backend, 0::BIGINT AS seed, 0::BIGINT AS fold, count(*) AS n FROM orders UNION ALL SELECT 'GNN', 0, 1, count(*) FROM orders UNION ALL SELECT 'MLP', 0, 0, count(*) FROM orders")
def members_by_backend(s, d):
    predictions, _ = _ensemble(s, d)
    return predictions.groupBy(labels.model_parts(F.col("model")).alias("p")).agg(F.count("*").alias("n")).select("p.*", "n")


# Scoring ------------------------------------------------------------------------------------------------------------------------


def length_scorer(texts: list[str]) -> np.ndarray:
    """Stands for a model: a hundredth of the text's length."""
    return np.asarray([0.01 * len(t) for t in texts])


_SCORABLE = "smiles IS NOT NULL AND trim(smiles) <> '' AND NOT regexp_matches(regexp_replace(smiles, '^[\\s\\x{00a0}\\x{3000}]+|[\\s\\x{00a0}\\x{3000}]+$', '', 'g'), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]') AND list_reduce(list_prepend(0, list_transform(string_split(regexp_replace(smiles, '[^()\\[\\]]', '', 'g'), ''), lambda c: CASE WHEN c IN ('(', '[') THEN 1 WHEN c IN (')', ']') THEN -1 ELSE 0 END)), lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END) = 0"


@query(f"SELECT row_id, CASE WHEN {_SCORABLE} THEN round(0.01 * length(smiles), 6) END AS score FROM routes_test")
def aligned_scores(s, d):
    return rounded(SC.score_table(table(s, d, "routes_test"), "smiles", {"score": length_scorer}, keep=["row_id"]))


@query(f"SELECT row_id, CASE WHEN {_SCORABLE} THEN round(0.01 * length(smiles), 6) END AS score, CASE WHEN {_SCORABLE} THEN 0.0 END AS spread FROM routes_test")
def member_scores(s, d):
    members = SC.Members(lambda name: length_scorer, 2)
    return rounded(SC.ensemble_scores(table(s, d, "routes_test"), "row_id", "smiles", members, {"GNN_seed0_fold0": 2.0, "MLP_seed0_fold0": 1.0}))


@query(STOCK_KEYS)
def stock_keys(s, d):
    """Standard text and key of the stock's structures, with the reason where there is none."""
    b = TextBackend()
    return table(s, d, "stock").select("id", b.standard(F.col("smiles")).alias("standard"), b.key(F.col("smiles")).alias("key"), b.reason(F.col("smiles")).alias("reason"))


@query("SELECT component, 'methyl' AS cap_type, 'C' AS cap, w || 'C' AS smiles FROM (SELECT DISTINCT warhead_scaffold AS w, warhead_scaffold || '[*:1]' AS component FROM scaffolds WHERE warhead_scaffold IS NOT NULL AND position('*' IN warhead_scaffold) = 0) UNION ALL SELECT component, 'hydrogen', '[H]', w || '[H]' FROM (SELECT DISTINCT warhead_scaffold AS w, warhead_scaffold || '[*:1]' AS component FROM scaffolds WHERE warhead_scaffold IS NOT NULL AND position('*' IN warhead_scaffold) = 0)")
def capped_scaffolds(s, d):
    own = table(s, d, "scaffolds").filter("instr(warhead_scaffold, '*') = 0").select(F.concat("warhead_scaffold", F.lit("[*:1]")).alias("component"))
    return capped_variants(own, "component", {"methyl": ["C"], "hydrogen": ["[H]"]}).drop("error")


@query("SELECT row_id FROM routes_scored WHERE warhead_id IS NOT NULL AND datasource = 'curated'")
def filtered_rows(s, d):
    return R.where_equal(R.without_nulls(table(s, d, "routes_scored"), "warhead_id"), datasource="curated").select("row_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in Q.items() if q}

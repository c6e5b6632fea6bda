"""The operators tagged llm against brute force, round trips and planted cases, with their edge cases."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.llm import copies, encoding, leakage, overlaps, splits, subjects, variety
from molquarry.llm import queries as llm_queries
from molquarry.llm.components import group_rows
from molquarry.llm.cosine_join import JoinPlan, near_texts, rarest_apart, slot_counts
from molquarry.llm.molecules import molecule_text
from molquarry.llm.words import batch_words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(text, n, rng):
    for _ in range(n):
        if not text:
            break
        i, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:i] + ("" if kind == 0 else rng.choice("CNOScn")) + text[i + (kind != 1) :]
    return text


# 1 ------------------------------------------------------------------------------------------------------------------------


def test_molecule_text():
    base = "CC(=O)c1ccc2nc(F)oc2c1N1CCC(CC1)C#N"
    for other in ("CC(=O)c5ccc6nc(F)oc6c5N5CCC(CC5)C#N", "CC(=O)c%11ccc%12nc(F)oc%12c%11N%11CCC(CC%11)C#N", " CC(=O)c1ccc2nc(F)oc2c1N1CCC(CC1)C#N.Cl |r|", base + "\tcpd-8907\n", base[:9] + "\r\n  " + base[9:], base[:5] + "​" + base[5:], "[Na+]." + base, base + ".OC(=O)C(F)(F)F\tbatch 10"):
        assert molecule_text(other) == base
    assert molecule_text("C[C@@H](F)/C=C/C") == "CC(F)C=CC" and molecule_text(None) == molecule_text("  ") == ""
    assert molecule_text("c1cc[nH]c1") == "c1cc[nH]c1"


@pytest.mark.parametrize("plan, seed", [(JoinPlan(), 5), (JoinPlan(gram=8), 5), (JoinPlan(), 6), (JoinPlan(edits=1, gram=12), 7)])
def test_near_texts_loses_nothing(spark, plan, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("CCCNOScn1()=F") for _ in range(rng.randrange(6, 14))) for _ in range(12)]
    base = ["".join(rng.choice(parts) for _ in range(rng.randrange(9, 16))) for _ in range(60)] + ["C" * 150, "CN" * 70]
    left = sorted({*base, *("".join(rng.choice(parts) for _ in range(2)) for _ in range(20)), "C", "CCO", "CCCCCC"})
    right = sorted({edited(t, rng.randrange(0, 6), rng) for t in base + left for _ in range(3)} | {"N", "CO"} - {""})
    a, b = (spark.createDataFrame(list(enumerate(x)), "id long, text string") for x in (left, right))
    got = {(r["left_id"], r["right_id"]): r["distance"] for r in near_texts(a, b, plan).collect()}
    full = {(i, j): distance(x, y) for (i, x), (j, y) in itertools.product(enumerate(left), enumerate(right)) if abs(len(x) - len(y)) <= 3}
    assert got == {k: d for k, d in full.items() if d <= plan.edits}


def test_slot_counts_come_to_the_driver_as_columns(spark):
    rng = random.Random(8)
    texts = spark.createDataFrame([("".join(rng.choices("CNOS=()1", k=400)),) for _ in range(1000)], "text string").repartition(4).localCheckpoint()
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")  # as on a cluster that doesn't set it
    tracemalloc.start()
    try:
        counts = slot_counts(texts, JoinPlan())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert counts.sum() == 1000 * 385 and (counts > 0).sum() > 200_000
    assert peak < 20_000_000


def test_rarest_apart():
    rng = np.random.default_rng(9)
    cost = rng.integers(0, 5, (30, 14)).astype(float)
    cost[:10, 11:] = np.inf
    for row, at in zip(cost, rarest_apart(cost, 3, 4)):
        least = min(row[list(c)].sum() for c in itertools.combinations(range(14), 4) if all(b - a >= 3 for a, b in zip(c, c[1:])))
        assert row[at].sum() == least and (np.diff(at) >= 3).all()


def test_near_texts_shuffle_few_grams(spark):
    rng = random.Random(10)
    parts = ["".join(rng.choices("CNOS=()1", k=6)) for _ in range(60)]
    ends = ["".join(rng.choices("CNOS=()1", k=40)) for _ in range(2)]
    left = [ends[0] + "".join(rng.choices(parts, k=9)) + ends[1] for _ in range(2000)]
    right = [edited(t, 3, rng) for t in left[:40]]
    a, b = (spark.createDataFrame(list(enumerate(x)), "id long, text string").localCheckpoint() for x in (left, right))
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteRecords() for i in range(got.size())}

    def written(act):
        last = max(stages(), default=-1)  # old stages are forgotten
        got = act()
        return got, sum(n for k, n in stages().items() if k > last)

    _, counts = written(lambda: slot_counts(a.unionByName(b), JoinPlan()))  # up to a row a slot and task
    got, rows = written(lambda: near_texts(a, b).collect())
    assert {(i, i) for i in range(40)} <= {(r["left_id"], r["right_id"]) for r in got}
    assert rows - counts < 20 * len(left)


def test_split_overlaps(spark):
    mol = "CS(=O)(=O)c1cc(C#N)ccc1c1nc(OCC)c2ccccc2n1CCNOCCOCCSCCSC#CCNNCCCc1cc(oc1)CCOC(=O)C1(CC1)OOCCOC(Cl)CC"
    schema = "row_id long, smiles string, datasource string, distance int, text string"
    train = spark.createDataFrame([(1, mol, "a", 0, "x"), (2, mol.replace("SCCS", "OCCS"), "a", 0, "x"), (3, None, "a", 0, "x"), (4, " ", None, 0, "x"), (None, mol, "a", 0, "x"), (5, mol, "a", 0, "x")], schema)
    test = spark.createDataFrame([(11, mol + ".Cl", None, 0, "x"), (12, "C" + mol[1:].replace("Br", ""), "b", 0, "x"), (13, "", "b", 0, "x"), (14, "C" * 5000, "b", 0, "x")], schema)
    got = {(r["split"], r["train_id"], r["eval_id"], r["distance"]) for r in overlaps.split_overlaps(train, {"t": test}).collect()}
    assert got == {("t", i, j, d) for j in (11, 12) for i, d in ((1, 0), (5, 0), (2, 1))}
    assert overlaps.split_overlaps(train.limit(0), {"t": test}).count() == 0
    report = overlaps.overlap_report(overlaps.split_overlaps(train, {"t": test})).collect()
    assert sum(r["n_pairs"] for r in report) == 6


# 2, 6 --------------------------------------------------------------------------------------------------------------------------


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_groups(spark, shape):
    rng = random.Random(1)
    nodes = list(range(1, 400))
    edges = {"chain": list(zip(nodes, nodes[1:])), "star": [(7, n) for n in nodes if n != 7], "random": [(rng.choice(nodes), rng.choice(nodes)) for _ in range(250)], "none": []}[shape]
    dirty = edges + [(b, a) for a, b in edges[:50]] + [(5, 5), (None, 3), (3, None), (3, 99_999)]
    rows = spark.createDataFrame([(n, "x") for n in [*nodes, nodes[0]]] + [(None, "y")], "row_id long, label string")
    pairs = spark.createDataFrame(dirty, "left_id long, right_id long").withColumn("row_id", F.lit(0))
    got = group_rows(rows, "row_id", pairs, "left_id", "right_id").collect()
    assert len(got) == len(nodes) and {r["row_id"]: r["group_id"] for r in got} == roots(nodes, edges)


def test_group_rows_empty(spark):
    empty = spark.createDataFrame([], "row_id long")
    assert group_rows(empty, "row_id", spark.createDataFrame([], "l long, r long"), "l", "r").count() == 0


def test_closest_subset():
    rng = random.Random(3)
    for _ in range(60):
        sizes = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(5)}
        target = rng.randrange(1, 80)
        every = {0}
        for s, n in sizes.items():
            every = {x + s * k for x in every for k in range(n + 1)}
        got = splits.closest_subset(sizes, target)
        assert all(0 < n <= sizes[s] for s, n in got.items())
        assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(x - target) for x in every)


@pytest.mark.parametrize("max_bits", [1, 300, 2000])
def test_closest_subset_beyond_the_bits_kept(max_bits):
    rng = random.Random(4)
    for _ in range(200):
        sizes = {rng.randrange(2, 40): rng.randrange(1, 6) for _ in range(6)}
        target = rng.randrange(1, 120)
        every = {0}
        for s, n in sizes.items():
            every = {x + s * k for x in every for k in range(n + 1)}
        got = splits.closest_subset(sizes, target, max_bits)
        assert all(0 < n <= sizes[s] for s, n in got.items())
        assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(x - target) for x in every)


def test_grouped_splits(spark, sf):
    df = spark.read.parquet(f"{sf}/scaffolds.parquet").withColumn("component", F.lit(0)).withColumn("split", F.lit("clash"))
    got = {r["row_id"]: (r["component"], r["split"]) for r in splits.grouped_splits(df, "row_id", ["molecule", "warhead_scaffold"]).collect()}
    rows, seen, edges = df.collect(), {}, []
    for r in rows:
        for c in ("molecule", "warhead_scaffold"):
            v = (r[c] or "").strip()
            if v:
                edges.append((r["row_id"], seen.setdefault((c, v), r["row_id"])))
    assert {k: c for k, (c, _) in got.items()} == roots([r["row_id"] for r in rows], edges)
    parts = {}
    for c, s in got.values():
        assert parts.setdefault(c, s) == s
    n = len(rows)
    count = {s: sum(x == s for _, x in got.values()) / n for s in ("train", "validation", "test")}
    assert abs(count["validation"] - 0.1) < 0.02 and abs(count["test"] - 0.1) < 0.02
    blank = spark.createDataFrame([(1, " ", None), (2, "", None), (3, None, None), (None, "a", "b")], "row_id long, molecule string, warhead_scaffold string")
    assert {r["component"] for r in splits.grouped_splits(blank, "row_id", ["molecule", "warhead_scaffold"]).collect()} == {1, 2, 3}
    assert splits.grouped_splits(blank.limit(0), "row_id", ["molecule", "warhead_scaffold"]).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------------------


def test_copies(spark):
    base = ("C[C@H](F)CN.Cl", "TGK-1", "LGX-2", "dc50=4.3; dmax=56; cell=ja-x", "RT-2019-1429")
    same = [
        ("Cl . C[C@H](F)​CN;;", "tgk 1", "(LGX-2)", "CELL: JA X | dmax: 56.0;dc50 : 4.30;", "ref: RT20191429"),
        ('"C[C@H](F)CN.Cl"', " Tgk-1.", "lgx2", "dmax=56, cell=ja-x, dc50=4.3", "RT–2019–1429"),
    ]
    other = [("C[C@@H](F)CN.Cl", *base[1:]), ("c[C@H](F)CN.Cl", *base[1:]), (base[0], "TGK-11", *base[2:]), (*base[:3], "dc50=43; dmax=56; cell=ja-x", base[4]), (*base[:3], "dc50=4.3; dmax=56", base[4]), (base[0], None, *base[2:]), (base[0], "  ", *base[2:])]
    rows = [(i + 1, *r, f"{i}") for i, r in enumerate([base, *same, *other])] + [(None, *base, "n"), (50, None, None, None, None, None, None), (51, "", " ", None, ";", "", None), (60, "C" * 100_000, *base[1:], None), (61, "C" * 100_000 + " ", *base[1:], None)]
    df = spark.createDataFrame(rows, "compound_id long, smiles string, target string, e3_ligase string, activity string, reference string, digest string")
    got = {(r["keep_id"], r["copy_id"]) for r in copies.copies(df, copies.COMPOUND).collect()}
    assert got == {(1, 2), (1, 3), (9, 10), (50, 51), (60, 61)}
    assert {r["keep_id"]: r["n_copies"] for r in copies.records(df, copies.COMPOUND).collect()}[1] == 4
    assert copies.copies(df.limit(0), copies.COMPOUND).count() == 0
    stock = spark.createDataFrame([(1, "CCO", "ABC-DE-N", 1), (2, "CCO", "inchikey: abc-de-n", 2), (3, "CCO", "ABC-DE-M", 3), (4, "CCO", None, 4), (5, "CCO", " ", 5)], "id long, smiles string, inchi_key string, tree int")
    assert {(r["keep_id"], r["copy_id"]) for r in copies.copies(stock, copies.STOCK).collect()} == {(1, 2), (4, 5)}


def test_copies_with_a_hot_group(spark):
    df = spark.range(1, 3001).select("id", F.when(F.col("id") % 3 == 0, F.lit(" CCO")).otherwise(F.concat(F.lit("C" * 3), F.repeat(F.lit("N"), (F.col("id") % 50).cast("int")))).alias("smiles"), F.lit(None).cast("string").alias("inchi_key"))
    got = copies.copies(df, copies.STOCK)
    assert got.filter("keep_id = 3").count() == 999 and got.count() == 3000 - copies.records(df, copies.STOCK).count()


# 7 --------------------------------------------------------------------------------------------------------------------------------


def test_greedy_determinant():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    picked = variety.greedy_determinant(x, 6)
    k = x @ x.T + 1e-3 * np.eye(40)
    chosen = []
    for _ in range(6):
        chosen.append(max((i for i in range(40) if i not in chosen), key=lambda i: np.linalg.slogdet(k[np.ix_([*chosen, i], [*chosen, i])])[1]))
    assert picked == chosen and variety.greedy_determinant(x, 100)[:6] == chosen


def test_varied_subset(spark, monkeypatch):
    rng = random.Random(0)
    series = ["".join(rng.choice("CNOScn1()=#F") for _ in range(60)) for _ in range(30)]
    rows = [(i, series[0] + "".join(rng.choice("CN") for _ in range(4)), "a") for i in range(400)] + [(1000 + i, s + "CC", "b") for i, s in enumerate(series[1:])] + [(2000, None, "c"), (2001, " ", "c"), (None, "CCO", "c"), (2002, series[0], "c"), (2003, series[0], "c")]
    df = spark.createDataFrame(rows, "row_id long, smiles string, rank string")
    ids = [r["row_id"] for r in variety.varied_subset(df, 30).collect()]
    assert len(ids) == len(set(ids)) == 30 and sum(1000 <= i < 2000 for i in ids) == 29
    monkeypatch.setattr(variety, "LAST_ROWS", 60)
    monkeypatch.setattr(variety, "PARTITION_ROWS", 120)
    assert sum(1000 <= r["row_id"] < 2000 for r in variety.varied_subset(df, 30).collect()) >= 27
    assert variety.varied_subset(df.limit(0), 5).count() == 0 and variety.varied_subset(df.filter("row_id > 1990"), 5).count() == 1


# 8 -----------------------------------------------------------------------------------------------------------------------------------

TEXTS = ["", "  lead  and trail  \n\n", "a\x00b  \x00\x00 x", "x\x1cy \x85 z  q", "aaaa" * 3000, "<|endoftext|> hi", "I'll we've don't 'S", "½²³ Ⅷ ١٢٣ é 𝔘𝔫𝔦", "　全角　テスト", "\t\t\n  \r\n x", "naïve café 😀👍", "CS(=O)(=O)c1cc(C#N)ccc1" * 20]


def test_encoding_is_the_library_encoding(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(encoding.VOCABULARY)
    own.encode_special_tokens = True
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(-i, t) for i, t in enumerate(TEXTS, 1)] + [(None, "null key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: list(r["ids"]) for r in encoding.encode_texts(df).collect()}
    assert got == {k: own.encode(t or "", add_special_tokens=False).ids for k, t in rows}
    assert encoding.encode_texts(df.limit(0)).count() == 0


def test_guesses_are_verified():
    v = encoding.Vocabulary()
    words = [" undeprotected", "xylophonist", " recrystallised", "0000000", "))))))", "ＡＢＣ", " antidisestablishmentarianism"]
    assert v.encoded(words) == [v.merged(w.encode()) for w in words]
    assert any(v.guess(w.encode()) != v.merged(w.encode()) for w in words)


# 9 ---------------------------------------------------------------------------------------------------------------------------------------


def test_words_fold_spelling():
    words, begin = batch_words(["<b>Ｉｔ</b> ｗａｓ, n​ot&nbsp;сlear!", "", "a < b", "c > d"])
    assert [words[a : b - 1] for a, b in zip(begin, begin[1:])] == [["it", "was", "not", "clear"], [], ["a", "b"], ["c", "d"]]


def test_leaks(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("ra", "sto", "ven", "lix", "dor", "qua", "tim")]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    item = make(50)
    fifth = [("xx" if i % 5 == 4 else w) for i, w in enumerate(item)]
    third = [("xx" if i % 3 == 2 else w) for i, w in enumerate(item)]
    spread = [x for i, w in enumerate(item) for x in ([w, "yy"] if i % 2 else [w])]
    inside = lambda x: " ".join(make(40) + x + make(40))
    docs = {1: inside(item), 2: inside(item[10:26]).upper(), 3: inside(item[10:25]), 4: inside(fifth), 5: inside(third), 6: inside(spread), 7: None, 8: "", 9: "  ", 10: inside(item)[::-1], 11: " ".join(make(30_000) + fifth), 12: ", ".join(item)}
    df = spark.createDataFrame([(k, t, k) for k, t in docs.items()] + [(None, inside(item), 0)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, " ".join(item), "s"), (8, None, "s"), (9, "one two", "s"), (None, " ".join(item), "s")], "item_id long, text string, suite string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, items).collect()}
    # Of document 6, 62 words in a row, a quarter more than the item's 50, hold 41 of them in order: 40 are enough.
    expected = {(k, 7) for k, t in docs.items() if t and holds_by_definition(re.findall("[a-z]+", t[-5000:].lower()), item)}
    assert got == expected == {(k, 7) for k in (1, 2, 4, 6, 11, 12)}
    assert leakage.leaks(df, items.limit(0)).count() == 0 and leakage.leaks(df.limit(0), items).count() == 0
    report = {r["item_id"]: r["n_documents"] for r in leakage.leakage_report(leakage.leaks(df, items), items).collect()}
    assert report[7] == 6 and report[9] == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def holds_by_definition(text, item):
    m = len(item)
    if any(text[i : i + 16] == item[j : j + 16] for j in range(m - 15) for i in range(len(text) - 15)):
        return True
    return m > 0 and any(5 * lcs(text[i : i + m * 5 // 4], item) >= 4 * m for i in range(len(text)))


def test_leaks_of_left_out_and_put_in_words(spark):
    """Passages at and beside the limit, words left out, put in and replaced at will, against the definition."""
    rng = random.Random(11)
    vocabulary = [f"w{i}x" for i in range(400)]
    items = {i: [rng.choice(vocabulary) for _ in range(m)] for i, m in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 20, 25, 33, 40, 61, 61, 61, 90], 1)}
    docs = {}
    for i, item in items.items():
        m = len(item)
        for extra in (0, 0, 0, 1):
            out = set(rng.sample(range(m), min(m, m // 5 + extra)))
            kept = [w for j, w in enumerate(item) if j not in out]
            for _ in range(rng.randrange(0, m * 5 // 4 - len(kept) + 2 + extra)):
                kept.insert(rng.randrange(len(kept) + 1), rng.choice(["foreign", rng.choice(vocabulary)]))
            docs[len(docs) + 1] = [rng.choice(vocabulary) for _ in range(rng.randrange(30))] + kept + ["tail"] * rng.randrange(3)
    # The reviewed case: every fifth word left out, a foreign one put into each second run of four.
    kept = [x for j, w in enumerate(items[15]) if j % 5 != 4 for x in ([w, "foreign"] if j % 10 == 1 else [w])]
    docs[len(docs) + 1] = kept
    expected = {(d, i) for d, text in docs.items() for i, item in items.items() if holds_by_definition(text, item)}
    assert (len(docs), 15) in expected and len(expected) < 0.5 * len(docs) * len(items)
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in docs.items()], "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, table).collect()} == expected


def test_seeds_that_any_passage_shares():
    """Every text that counts has the seeds it needs, however its words are left out and put in."""
    rng = random.Random(3)
    for n in [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 13, 16, 20, 29, 47, 61, 80]:
        assert leakage.shared_seeds(n) >= 1
        for _ in range(30):
            item = list(range(1, n + 1))
            kept = sorted(rng.sample(item, leakage.least_words(n)))
            while len(kept) < leakage.width(n) and rng.random() < 0.98:
                kept.insert(rng.randrange(len(kept) + 1), 10_000 + rng.randrange(5))
            a, b = (np.asarray(x, np.uint64) for x in (item, kept))
            short = (n == 1, n == 2)
            own = np.concatenate([k for k, span in leakage.seeds(a, short) if n > 2 or span == n])
            places = {p for k, span in leakage.seeds(b, short) for p in np.flatnonzero(np.isin(k, own)).tolist()}
            assert len(places) >= leakage.shared_seeds(n)


def test_leaks_lose_nothing_at_any_share_of_left_out_and_put_in_words(spark):
    """Dropped, inserted and replaced words at the rates that were once lost; items of 4 to 60 words; copies of a text."""
    rng = random.Random(5)
    items = {n: [f"w{rng.randrange(3000)}" for _ in range(n)] for n in (4, 5, 6, 10, 20, 40, 60)}
    docs = {}
    for out, put in ((0.2, 0.1), (0.2, 0.2), (0.2, 0.44), (0.1, 0.25), (0.15, 0.0)):
        for n, item in items.items():
            for _ in range(4):
                gone = set(rng.sample(range(n), int(n * out)))
                text = [w for j, w in enumerate(item) if j not in gone]
                for _ in range(int(n * put)):
                    text.insert(rng.randrange(len(text) + 1), f"w{rng.randrange(3000)}")
                docs[len(docs)] = [f"w{rng.randrange(3000)}" for _ in range(25)] + text
    expected = {(d, i) for d, text in docs.items() for i, item in items.items() if holds_by_definition(text, item)}
    assert len(expected) > 0.6 * len(docs)
    rows = [(k + c * 1000, " ".join(x)) for k, x in docs.items() for c in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, table).collect()} == {(d + c * 1000, i) for d, i in expected for c in range(3)}


# 10 ----------------------------------------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    rng = random.Random(4)
    lexicon = {"law": "claim tribunal licence clause royalty counsel statute appeal".split(), "sport": "match goal referee league trophy team coach season".split(), "cooking": "oven butter flour recipe sauce kettle whisk pastry".split()}
    common = "the report was shown near another office while people waited for some page".split()

    def sentence(s):
        words = rng.sample(common, 7) + rng.sample(lexicon[s], 4)
        rng.shuffle(words)
        return " ".join(words).capitalize() + "."

    rows, truth = [], {}
    for i in range(1, 241):
        a, b = rng.sample(sorted(lexicon), 2)
        plan = [a] * 8 if i % 3 else [a] * 5 + [b] * 3
        if i % 10 == 0:
            plan, b = [a] * 9 + [b], None
        lines = [sentence(s) for s in plan] + ["Page index | Printed view of the notes |", "WH_1 3.5 mg"]
        rows.append((i, "\n\n".join(lines), "mail", "WH_1", 0.0))
        truth[i] = set(plan) if i % 10 else {a}
    rows += [(900, None, None, None, 0.0), (901, "", "mail", None, 0.0), (902, "  ", None, "x", 0.0), (903, " ".join(sentence("law") for _ in range(2000)), None, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, component_id string, share double")
    wrong = {i: rng.choice(sorted(lexicon)) for i in range(1, 61) if i % 20 == 0}
    labels = spark.createDataFrame([(i, wrong.get(i, s)) for i in range(1, 61) for s in truth[i]] + [(5, None), (None, "law"), (5, "other")], "doc_id long, subject string")
    names = spark.createDataFrame([(s, s) for s in lexicon], "subject string, description string")
    got = {}
    for r in subjects.document_subjects(docs, labels, names).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert got.pop(903) == {"law"} and not {900, 901, 902} & set(got)
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.97 * len(truth)
    assert subjects.document_subjects(docs.limit(0), labels, names).count() == 0
    assert subjects.document_subjects(docs, labels.limit(0), names).count() == 0


def test_subjects_learn_the_same_however_rows_are_spread(spark):
    rng = random.Random(9)
    lexicon = {"law": "claim tribunal licence clause royalty counsel".split(), "sport": "match goal referee league trophy team".split()}
    fill = "the report was shown near another office while people waited".split()
    line = lambda s: " ".join(rng.sample(fill, 5) + rng.sample(lexicon[s], 5)).capitalize() + "."
    furniture = "Page index and printed view of notes"
    rows = [(i, "\n\n".join([line("law" if i % 2 else "sport") for _ in range(4)] + [furniture]), "mail", "a") for i in range(24)]
    once = line("law") + "\n\nThis note stands in one text alone"
    rows += [(100 + i, once, "mail", "a") for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, address string").withColumns({c: subjects.meta_slot(F.col(c)) for c in ("source", "address")})
    labels = spark.createDataFrame([(i, "law" if i % 2 else "sport") for i in range(24)], "doc_id long, subject string")
    spread = [subjects.learn(docs.repartitionByRange(n, "doc_id"), labels, ["law", "sport"], "doc_id", "text", ["source", "address"]) for n in (1, 40)]
    (one, a), (many, b) = spread
    assert one.furniture == many.furniture and len(many.furniture) == 1 and all(np.array_equal(x, y) for x, y in zip(a, b))
    assert np.array_equal(one.subject, many.subject) and one.weight == pytest.approx(many.weight) and (one.weight > 0).any()


def test_accuracies_are_learned():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 20_000)
    vote = lambda p: np.where(rng.random(len(y)) < p, y, rng.integers(0, 4, len(y)))
    table = np.stack([vote(0.95), np.full(len(y), -1), vote(0.6), vote(0.0), np.full(len(y), -1)], 1)
    patterns, counts = np.unique(table, axis=0, return_counts=True)
    post = subjects.accuracies(patterns, counts.astype(float), 4)
    right = {tuple(p): q.argmax() for p, q in zip(patterns, post)}
    assert np.mean([right[tuple(t)] == v for t, v in zip(table, y)]) > 0.94


# All ------------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(llm_queries.queries()))
def test_queries_run(name, spark, sf):
    assert llm_queries.queries()[name](spark, sf).count() >= 0


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "molquarry"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) molquarry\.llm", p.read_text(), re.M), p

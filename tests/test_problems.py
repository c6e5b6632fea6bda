import json

import pytest

from pyspark.sql import functions as F

from molquarry.operators.flatten import flatten_nested
from molquarry.operators.parse_rows import parse_rows

LINES = "line_id long, source_file string, line_no int, line string, line_extra string"
HEAD = "smiles,target_smiles,resolved,route_score,search_time_seconds,n_steps,note"


def lines(spark, rows, head=HEAD):
    return spark.createDataFrame([(1, "f", 1, head, "x"), *((i + 2, "f", i + 2, r, "x") for i, r in enumerate(rows))], LINES)


def reasons(spark, rows, head=HEAD):
    got = {r["line_id"]: r["reason"] for r in parse_rows(lines(spark, rows, head)).bad.collect()}
    return [got.get(i + 2) for i in range(len(rows))]


def test_reasons(spark):
    ok = 'CCO,CC(=O)O,True,0.5,1e1,3,"a ""b"", c"'
    cases = {
        ok: None, "﻿" + ok + "\r": None, "CCO,,,,,,": None, 'CCO,C,true, 0.5 ,0,0,"two\nlines"': None, '"CCO",C,true,1,2,3,x': None,
        'CCO,C,true,0.5,1,2,"open': "quoting", 'CC"O,C,true,0.5,1,2,x': "quoting", '"CCO"x,C,true,0.5,1,2,y': "quoting", 'a"b"c,d': "quoting",
        "CCO,C": "columns", "": "columns", "   ": "columns", None: "columns", "CCO,C,true,0.5,1,2,x,y": "columns",
        ",C,true,0.5,1,2,x": "value", "C(C,C,true,0.5,1,2,x": "value", "C)C(,C,true,0.5,1,2,x": "value", "C1CC,C,true,0.5,1,2,x": "value", "C[NH,C,true,0.5,1,2,x": "value",
        "C1CC1C%12CC%12,C,true,0.5,1,2,x": None, "С,C,true,0.5,1,2,x": "value", "CCO,C!,true,0.5,1,2,x": "value", "CCO,C,yes,0.5,1,2,x": "value",
        "CCO,C,true,1.1,1,2,x": "value", "CCO,C,true,-0.1,1,2,x": "value", "CCO,C,true,nan,1,2,x": "value", "CCO,C,true,5e-1,1,2,x": None, "CCO,C,true,0.5,inf,2,x": "value",
        "CCO,C,true,0.5,-1,2,x": "value", "CCO,C,true,0.5,1,2.5,x": "value", "CCO,C,true,0.5,1,-2,x": "value", "CCO,C,true,0.5,1,two,x": "value",
    }
    assert dict(zip(cases, reasons(spark, list(cases)))) == cases


def test_other_delimiters_and_order(spark):
    head = '﻿note;"smiles";target_smiles;resolved;route_score;search_time_seconds;n_steps\r'
    got = parse_rows(lines(spark, ['"a;b";CCO;C;FALSE;0.25;3.5;4'], head)).rows.first()
    assert got.asDict() == {"line_id": 2, "smiles": "CCO", "target_smiles": "C", "resolved": False, "route_score": 0.25, "search_time_seconds": 3.5, "n_steps": 4, "note": "a;b"}


def test_every_line_is_in_one_table(spark, sf):
    df = spark.read.parquet(f"{sf}/raw_route_lines.parquet")
    p = parse_rows(df)
    assert p.rows.select("line_id").unionByName(p.bad.select("line_id")).groupBy("line_id").count().filter("count <> 1").count() == 0
    assert p.rows.count() + p.bad.count() == df.filter("line_no <> 1").count()


def test_no_header_no_lines_very_long(spark):
    alone = spark.createDataFrame([(1, "g", 2, "CCO,C", None), (2, None, 5, "x", None)], LINES)
    assert {r["reason"] for r in parse_rows(alone).bad.collect()} == {"columns"}
    empty = parse_rows(spark.createDataFrame([], LINES))
    assert empty.rows.count() == 0 and empty.bad.count() == 0
    long = "C" * 200_000
    assert reasons(spark, [f"{long},C,true,0.5,1,2,x", f'{long},C,true,0.5,1,2,"' + '""' * 50_000 + '"']) == [None, None]


def walk(record, roots):
    """A plain recursive reading of what flatten_nested does."""
    out = []

    def visit(kind, x, path, above):
        for i, e in enumerate(x if isinstance(x, list) else [x]):
            if e is None:
                continue
            here = f"{path}[{i}]"
            out.append((kind, here, above))
            if not isinstance(e, dict):
                continue
            if kind == "step":
                if e.get("reactants") is not None:
                    visit("reactant", e["reactants"], f"{here}.reactants", here)
                c = e.get("conditions")
                if isinstance(c, dict) and c.get("reagents") is not None:
                    visit("reagent", c["reagents"], f"{here}.conditions.reagents", here)
            if kind == "reactant" and e.get("made_by") is not None:
                visit("step", e["made_by"], f"{here}.made_by", here)

    for col, kind in roots.items():
        x = record[col]
        while isinstance(x, str):
            try:
                x = json.loads(x) if x.strip() else None
            except ValueError:
                x = None
        if x is not None:
            visit(kind, x, col, "")
    return out


def test_flatten_against_recursion(spark, sf):
    df = spark.read.parquet(f"{sf}/route_records.parquet")
    got = {(r["record_id"], r["child"], r["path"], r["parent_path"]) for r in flatten_nested(df, "record_id").collect()}
    expected = {(r["record_id"], *x) for r in df.collect() for x in walk(r, {"precursors": "precursor", "synthesis_steps": "step"})}
    assert got == expected and got


def test_flatten_of_any_depth(spark):
    """Ten thousand levels, more than a decoder that calls itself can hold; and the same by the decoder where it can."""
    from molquarry.operators import flatten

    text = '[{"reactants": [{"smiles": "C", "made_by": ' * 5_000 + "null" + "}]}]" * 5_000
    df = spark.createDataFrame([(1, None, text), (2, None, text[:-1])], "record_id long, precursors string, synthesis_steps string")
    got = flatten_nested(df, "record_id").groupBy("record_id", "child").count().collect()
    assert {tuple(r) for r in got} == {(1, "step", 5_000), (1, "reactant", 5_000)}
    for t in ('{"a": [1, -2.5e3, true, null, {}], "b": {"c": "x\\n\\u00e9"}}', "[]", " [ [ ] , { } ] ", '"t"', "3"):
        assert flatten._parsed(t) == json.loads(t)
    for t in ("[1,]", '{"a" 1}', "[1", "{,}", "[1] 2", "", "tru"):
        with pytest.raises(ValueError):
            flatten._parsed(t)


def test_flatten_edges(spark):
    deep = "C"
    for _ in range(60):
        deep = [{"reactants": [{"smiles": "C", "made_by": deep}]}] if deep != "C" else [{"reactants": "C"}]
    rows = [(1, None, ""), (2, "[null, {}]", '{"reactants": ["A", null, {"smiles": "B"}]}'), (3, "[{", "[1,"), (4, json.dumps(json.dumps([{"a": 1}])), "   "), (5, "[]", json.dumps(deep)), (None, '"x"', '[{"reactants": "' + "C" * 300_000 + '"}]')]
    df = spark.createDataFrame(rows, "record_id long, precursors string, synthesis_steps string").withColumn("path", F.lit("clash"))
    got = flatten_nested(df, "record_id").collect()
    paths = {(r["record_id"], r["path"]) for r in got}
    assert (2, "precursors[1]") in paths and (2, "synthesis_steps[0].reactants[2]") in paths and (2, "synthesis_steps[0].reactants[1]") not in paths
    assert (4, "precursors[0]") in paths and not any(k in (1, 3) for k, _ in paths)
    assert sum(k == 5 for k, _ in paths) == 120
    assert flatten_nested(df.limit(0), "record_id").count() == 0


def test_round_brackets_inside_bracket_atoms(spark):
    from molquarry.functions import smiles as S

    df = spark.createDataFrame([("CC[C@@H(](N)C)O",), ("CC[C@@H](N)C",), ("C%(12)CC%(12)",), ("C(C))C(",)], "s string")
    assert [r[0] for r in df.select(S.fault(F.col("s"))).collect()] == ["unbalanced brackets", None, None, "unbalanced brackets"]


def test_faults_of_batches_are_those_of_columns(spark):
    import random

    from molquarry.functions import smiles as S

    rng = random.Random(4)
    texts = ["".join(rng.choice("CCNcn1122()()[]%3=@H(") for _ in range(rng.randrange(0, 12))) for _ in range(3000)] + ["", "C%12CC%12", "C%(3)C3", "C1CC%01", "é", "CX?", "C\n", "[C@@H(](N)C", "C]C[", "%", "C%1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", S.fault(F.col("s")).alias("f")).collect()
    got = S.faults(texts)
    assert [(texts[r["i"]], r["f"]) for r in rows] == [(texts[r["i"]], got[r["i"]]) for r in rows] and {None, "foreign character", "unbalanced brackets", "unpaired ring number"} == set(got)
    assert S.faults([]) == []

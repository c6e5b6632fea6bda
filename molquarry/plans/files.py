"""Queries of readers and sinks: tables go out through a sink into the shared folder and come back through a reader."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.chem.backend import DESCRIPTORS
from molquarry.functions import labels
from molquarry.operators import metrics as M
from molquarry.operators import relational as R
from molquarry.operators import routes as RT
from molquarry.plans.stats import rounded
from molquarry.runtime import checkpoint_dir, table
from molquarry.sources import readers as RD
from molquarry.sources import sinks as SK

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def _folder(s: SparkSession) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/files-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    """The path of a file that Python itself opens: configs and databases on a file system that all nodes mount."""
    got = "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path
    os.makedirs(os.path.dirname(got), exist_ok=True)
    return got


def _written(s: SparkSession, name: str, text: str) -> str:
    path = _local(f"{_folder(s)}/{name}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


_TEST = "SELECT row_id, datasource, warhead_id, resolved FROM routes_test"
_ROUTE_COLUMNS = ("row_id", "datasource", "warhead_id", "resolved")


def _delimited(s: SparkSession, d: str, sep: str) -> DataFrame:
    path = _folder(s)
    SK.write_delimited(table(s, d, "routes_test").select(*_ROUTE_COLUMNS, "synthesizability"), path, sep)
    got = RD.read_delimited(s, path, columns=list(_ROUTE_COLUMNS), candidates=RD.SEPARATORS, multiline=True)
    return got.withColumn("row_id", F.col("row_id").try_cast("long"))


@query(_TEST)
def delimited_by_semicolon(s, d):
    """Written with semicolons, read with the separator that the first line shows; the score column never leaves the scan."""
    return _delimited(s, d, ";")


@query(_TEST)
def delimited_by_tab(s, d):
    return _delimited(s, d, "\t")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def delimited_in_splits(s, d):
    """A typed delimited file that many tasks read by splits."""
    path = _folder(s)
    SK.write_delimited(table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), path)
    return rounded(RD.read_delimited(s, path, "o_orderkey long, o_custkey long, o_totalprice double"), 2)


@query("SELECT id::VARCHAR AS name, regexp_replace(smiles, '[\\s]+', '', 'g') AS smiles FROM stock WHERE smiles IS NOT NULL")
def names_after_structures(s, d):
    """Tab-separated structures with an extension block each, and names."""
    path = _folder(s)
    own = table(s, d, "stock").filter("smiles is not null").select(F.concat(F.regexp_replace("smiles", "\\s+", ""), F.lit(" |r|")).alias("smiles"), F.col("id").alias("name"))
    SK.write_delimited(own, path, "\t")
    return RD.read_cxsmiles(s, path).select("name", "smiles")


_RECORDS = "SELECT record_id, route_score FROM route_records"


@query(f"SELECT 'lines' AS form, * FROM ({_RECORDS}) UNION ALL SELECT 'array', * FROM ({_RECORDS} ORDER BY record_id LIMIT 20) UNION ALL SELECT 'object', * FROM ({_RECORDS} ORDER BY record_id LIMIT 1)")
def json_in_three_forms(s, d):
    """Lines, an array and a single object, each found out by the reader."""
    root, own = _folder(s), table(s, d, "route_records").select("record_id", "route_score")
    own.write.option("ignoreNullFields", False).json(f"{root}/lines")
    few = [r.asDict() for r in R.top_n(own, 20, F.col("record_id")).collect()]
    array, single = (_written(s, "records.json", json.dumps(x, indent=1)) for x in (few, few[0] if few else []))
    schema = "record_id long, route_score double"
    return R.tagged_union({"lines": RD.read_json_records(s, f"{root}/lines", schema), "array": RD.read_json_records(s, "file://" + array, schema), "object": RD.read_json_records(s, "file://" + single, schema)}, "form")


def _per_type(s: SparkSession, d: str, name: str) -> str:
    """A file for each event type."""
    root = _folder(s)
    for kind, own in SK.routed(table(s, d, "events").select("event_id", "event_type", F.round(F.col("value").cast("double"), 6).alias("value")), "event_type").items():
        SK.write_file(own, f"{root}/{name.format(kind)}")
    return root


@query("SELECT 'events_' || event_type || '.csv' AS source_file, count(*) AS n, round(sum(round(value, 6)), 3) AS total FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def files_with_their_names(s, d):
    got = RD.read_many(s, _per_type(s, d, "events_{}.csv") + "/*.csv", schema="event_id long, value double")
    return rounded(got.groupBy("source_file").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


_FOLD = "SELECT o_orderkey % 2 AS seed, o_orderkey % 3 AS fold, round(avg(o_totalprice), 4) AS rmse, count(*) AS n FROM orders GROUP BY 1, 2"


@query(_FOLD)
def keys_from_file_names(s, d):
    """trials_<seed>_<fold>.csv: seed and fold stand in the names only."""
    root = _folder(s)
    own = table(s, d, "orders").groupBy((F.col("o_orderkey") % 2).alias("seed"), (F.col("o_orderkey") % 3).alias("fold")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("rmse"), F.count("*").alias("n"))
    for r in own.collect():  # six files
        SK.write_file(s.createDataFrame([(r["rmse"], r["n"])], "rmse double, n long"), f"{root}/trials_{r['seed']}_{r['fold']}.csv")
    got = RD.read_many(s, f"{root}/*.csv", schema="rmse double, n long")
    return rounded(got.select(*(c.alias(k) for k, c in RD.name_keys(F.col("source_file"), "trials_(\\d+)_(\\d+)", {"seed": "long", "fold": "long"}).items()), "rmse", "n"), 4)


@query(f"SELECT * FROM ({_FOLD}) WHERE NOT (seed = 1 AND fold = 2)")
def fold_documents(s, d):
    """A JSON document a fold, one of them missing."""
    root = _folder(s)
    for r in keys_from_file_names(s, d).collect():
        if (r["seed"], r["fold"]) != (1, 2):
            SK.write_file(s.createDataFrame([(r["rmse"], r["n"])], "rmse double, n long"), f"{root}/gnn_seed{r['seed']}_fold{r['fold']}.json", "json")
    return RD.read_fold_scores(s, f"{root}/*.json", "rmse double, n long", "gnn_").select("seed", "fold", "rmse", "n")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'GNN' ELSE 'MLP' END AS model, o_orderkey % 3 AS fold, count(*) AS n FROM orders GROUP BY 1, 2")
def metrics_of_runs(s, d):
    root, own = _folder(s), table(s, d, "orders")
    for i, run in enumerate(("gnn_final", "mlp_final")):
        SK.write_file(own.filter(F.col("o_orderkey") % 2 == i).groupBy((F.col("o_orderkey") % 3).alias("fold")).agg(F.count("*").alias("n")), f"{root}/{run}/metrics.csv")
    return RD.read_runs(s, root, ["gnn_final", "mlp_final"]).select("model", F.col("fold").cast("long").alias("fold"), F.col("n").cast("long").alias("n"))


@query("SELECT id, inchi_key FROM (SELECT *, row_number() OVER (PARTITION BY inchi_key ORDER BY id) AS r FROM stock WHERE inchi_key IS NOT NULL) WHERE r = 1")
def stock_database(s, d):
    """A SQLite stock with a unique key, rows of a key that is there ignored; read back by ranges of row ids."""
    path = _local(f"{_folder(s)}/stock.db")
    SK.write_sqlite(table(s, d, "stock").filter("inchi_key is not null").select("id", "inchi_key").orderBy("id"), path, "stock", "inchi_key", ["id"])
    return RD.read_sqlite(s, path, "stock")


@query("SELECT DISTINCT smiles FROM protac_db WHERE smiles IS NOT NULL")
def known_structures(s, d):
    """Distinct values of the first column that is there, of several names in any letter case."""
    return RD.distinct_values(table(s, d, "protac_db").withColumnRenamed("smiles", "SMILES"), ["smiles", "structure"])


@query("SELECT id, length(smiles) AS n_chars FROM stock")
def cached_features(s, d):
    """Computed once under a name made of the parameters; a stored table of another row count is made anew."""
    own, path = table(s, d, "stock"), RD.feature_path(_folder(s), "fp", r=3, n=512)
    n = own.count()
    RD.load_or_compute(s, path, lambda: own.limit(1).select("id", F.length("smiles").alias("n_chars")), None)
    made = lambda: own.select("id", F.length("smiles").cast("long").alias("n_chars"))
    RD.load_or_compute(s, path, made, n)
    return RD.load_or_compute(s, path, lambda: own.limit(0), n)


_YAML = "columns: {resolved: solved}\nroute: cell\ntransforms: {lls_max: 21}\ncross_validation: {seeds: [1, 2], n_folds: 4}\nparams: {lr: 0.1, depth: 6}\n"


@dataclass(frozen=True)
class _Transforms:
    lls_max: float = 11.0
    floor: float = 0.0


@dataclass(frozen=True)
class _Config:
    route: str = "route"
    columns: dict = field(default_factory=dict)
    transforms: _Transforms = field(default_factory=_Transforms)


@query("SELECT * FROM (VALUES ('route', 'cell'), ('resolved', 'solved'), ('lls_max', '21'), ('floor', '0.0'), ('seeds', '1,2'), ('folds', '4'), ('fallback seeds', '42'), ('fallback folds', '5'), ('depth', '6'), ('lr', '0.1'), ('json route', 'own')) AS t(name, value)")
def config_values(s, d):
    """YAML and JSON to dataclasses: nested sections, unknown names, fallbacks; flat and nested parameter blocks."""

    @dataclass(frozen=True)
    class Params:
        lr: float = 1.0
        depth: int = 1

    path, flat = _written(s, "config.yaml", _YAML), _written(s, "config.json", '{"route": "own", "unknown": 1}')
    c, p = RD.load_config(_Config, path), RD.load_config(Params, path, "params")
    (seeds, folds), (other, five) = RD.cv_scheme(path), RD.cv_scheme(flat)
    rows = {"route": c.route, "resolved": c.columns["resolved"], **asdict(c.transforms), "seeds": ",".join(map(str, seeds)), "folds": folds, "fallback seeds": ",".join(map(str, other)), "fallback folds": five, "depth": p.depth, "lr": p.lr, "json route": RD.load_config(_Config, flat).route}
    return s.createDataFrame([(k, str(v)) for k, v in rows.items()], "name string, value string")


@query("SELECT synthesizability FROM routes_train_val WHERE synthesizability IS NOT NULL AND NOT isnan(synthesizability)")
def scores_alone(s, d):
    return RD.scores_only(table(s, d, "routes_train_val"), "synthesizability")


@query("SELECT DISTINCT smiles, CASE WHEN length(smiles) % 7 = 0 THEN 0 ELSE length(smiles) END::BIGINT AS cid FROM stock WHERE smiles IS NOT NULL")
def looked_up_in_batches(s, d):
    """A lookup that answers in order, knows nothing of some keys and fails at each batch's first try."""

    def fetch(keys: list[str], tried: set = set()) -> list:  # noqa: B006 - what was tried before
        if keys[0] not in tried:
            tried.add(keys[0])
            raise TimeoutError
        return [len(k) if len(k) % 7 else None for k in keys]

    return RD.batch_lookup(table(s, d, "stock"), "smiles", fetch, "cid", wait=0.0)


@query("SELECT * FROM (VALUES ('Chemical Vendors', 'true'), ('Names', 'false')) AS t(heading, has_information)")
def headings_found(s, d):
    """A section of a nested document by its heading, at any depth, and whether it holds anything."""
    document = {"Record": {"Section": [{"TOCHeading": "Names", "Information": []}, {"TOCHeading": "Sources", "Section": [{"TOCHeading": "Chemical Vendors", "Information": [{"Value": "x"}]}]}]}}
    rows = [(h, str(bool((RD.found_heading(document, h) or {}).get("Information"))).lower()) for h in ("Chemical Vendors", "Names")]
    return s.createDataFrame(rows, "heading string, has_information string")


@query("SELECT o_orderpriority AS \"Cutoff\", count(*) AS \"Clusters\" FROM orders GROUP BY 1")
def publication_columns(s, d):
    return R.renamed(table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("unused")), {"o_orderpriority": "Cutoff", "n": "Clusters"})


@query(f"SELECT unnest({list(DESCRIPTORS)!r}) AS name")
def descriptor_names(s, d):
    return s.createDataFrame([(n,) for n in DESCRIPTORS], "name string")


# Sinks ------------------------------------------------------------------------------------------------------------------------


@query("SELECT row_id, datasource FROM routes_test")
def appended_once(s, d):
    """Rows appended by key in two overlapping deliveries, the second twice."""
    path, own = _folder(s), table(s, d, "routes_test").select("row_id", "datasource")
    for part in (own.filter("row_id % 3 <> 0"), own, own):
        SK.append_new(part, path, "row_id")
    return s.read.parquet(path)


@query("SELECT 'orders' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM customer")
def star_of_tables(s, d):
    """Two tables under one root, sorted by their keys in place of indexes."""
    root, keys = _folder(s), {"orders": "o_orderkey", "customer": "c_custkey"}
    SK.write_star({n: table(s, d, n) for n in keys}, root, {n: [k] for n, k in keys.items()})
    one, two = (s.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(k).alias("total")) for n, k in keys.items())
    return one.unionByName(two)


_FIRST = "SELECT smiles, id FROM (SELECT smiles, id, row_number() OVER (PARTITION BY smiles ORDER BY id) AS r FROM stock WHERE smiles IS NOT NULL) WHERE r = 1"


@query(f"SELECT CASE WHEN id % 2 = 0 THEN 'vendor' ELSE 'solved' END AS route, smiles, id FROM (SELECT smiles, id, row_number() OVER (PARTITION BY smiles, id % 2 ORDER BY id) AS r FROM stock WHERE smiles IS NOT NULL AND id % 5 <> 4) WHERE r = 1")
def stored_by_route(s, d):
    """Rows routed by the first rule that holds, each route's table taking the first row of a key that it lacks, in two deliveries."""
    root, own = _folder(s), table(s, d, "stock").select("smiles", "id")
    route = R.first_route([(F.col("id") % 5 == 4, None), (F.col("id") % 2 == 0, "vendor"), (F.col("id") % 2 == 1, "solved")])
    half = F.lit(own.agg(F.percentile("id", 0.5)).first()[0])
    for part in (own.filter(F.col("id") <= half), own.filter(F.col("id") > half)):
        for name, rows in SK.routed(part.withColumn("route", route), "route").items():
            SK.store_stock(rows, f"{root}/{name}", "smiles", "id")
    return R.tagged_union({n: s.read.parquet(f"{root}/{n}") for n in ("vendor", "solved")}, "route").select("route", "smiles", "id")


def _parts(s: SparkSession, d: str, fmt: str) -> str:
    root, own = _folder(s), table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    for i in range(3):
        SK.write_file(own.filter(F.col("o_orderkey") % 3 == i), f"{root}/scores_task{i}.{fmt}", fmt)
    SK.write_file(own.limit(0), f"{root}/notes.{fmt}", fmt)
    return root


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def merged_parts(s, d):
    root = _parts(s, d, "csv")
    SK.merge_delimited(s, root, f"{root}/merged")
    return RD.read_delimited(s, f"{root}/merged/scores", "o_orderkey long, o_orderpriority string")


@query("SELECT o_orderkey, o_orderpriority FROM orders UNION ALL SELECT -1, 'array'")
def merged_documents(s, d):
    """Lines of JSON by task and one array."""
    root = _parts(s, d, "json")
    SK.write_file(s.createDataFrame([('[{"o_orderkey": -1, "o_orderpriority": "array"}]',)], "value string"), f"{root}/scores_task9.json", "text")
    SK.merge_json(s, root, f"{root}/merged")
    return RD.read_json_records(s, f"{root}/merged/scores", "o_orderkey long, o_orderpriority string")


def _lines(s: SparkSession, text: str) -> DataFrame:
    return s.createDataFrame(list(enumerate(text.splitlines())), "line_no long, line string")


_REGIONS = "SELECT r_regionkey, r_name FROM region ORDER BY 1"


@query(f"SELECT (row_number() OVER (ORDER BY o) - 1) AS line_no, line FROM (SELECT 0 AS o, '# regions' AS line UNION ALL SELECT 1, 'r_regionkey,r_name' UNION ALL SELECT 10 + r_regionkey, r_regionkey || ',' || r_name FROM region UNION ALL SELECT 1000, '' UNION ALL SELECT 1001, '# nations' UNION ALL SELECT 1002, 'n' UNION ALL SELECT 1003, count(*)::VARCHAR FROM nation)")
def report_in_sections(s, d):
    return _lines(s, SK.sectioned_report({"regions": table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "nations": table(s, d, "nation").agg(F.count("*").alias("n"))}))


@query("SELECT (row_number() OVER (ORDER BY o) - 1) AS line_no, line FROM (SELECT 0 AS o, '% Regions' AS line UNION ALL SELECT 1, '\\begin{tabular}{ll}' UNION ALL SELECT 2, '\\toprule' UNION ALL SELECT 3, 'r\\_regionkey & r\\_name \\\\' UNION ALL SELECT 4, '\\midrule' UNION ALL SELECT 10 + r_regionkey, r_regionkey || ' & ' || r_name || ' \\\\' FROM region UNION ALL SELECT 1000, '\\bottomrule' UNION ALL SELECT 1001, '\\end{tabular}')")
def latex_lines(s, d):
    return _lines(s, SK.latex_table(table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions"))


_CELL = "CASE WHEN m IS NULL THEN '---' ELSE printf('%.2f', m) END"


@query(f"SELECT l_returnflag, CASE WHEN m IS NULL THEN '---' ELSE printf('%.2f', m) || '±' || printf('%.2f', coalesce(s, 0.0)) END AS cell, {_CELL} AS plain FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN NULL ELSE avg(l_quantity) END AS m, CASE WHEN l_returnflag = 'A' THEN NULL ELSE stddev_samp(l_quantity) END AS s FROM lineitem GROUP BY 1)")
def table_cells(s, d):
    own = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_quantity").cast("double")).alias("m"), F.stddev_samp(F.col("l_quantity").cast("double")).alias("s"))
    m, sd = F.when(F.col("l_returnflag") != "R", F.col("m")).otherwise(float("nan")), F.when(F.col("l_returnflag") != "A", F.col("s")).otherwise(float("nan"))
    return own.select("l_returnflag", labels.cell(m, sd, 2).alias("cell"), labels.cell(m, None, 2).alias("plain"))


@query("SELECT coalesce(datasource, 'null') AS source, n, round(mean, 6) AS mean FROM (SELECT datasource, count(x) AS n, avg(x) AS mean FROM (SELECT datasource, CASE WHEN isnan(synthesizability) THEN NULL ELSE synthesizability END AS x FROM routes_train_val) GROUP BY 1) UNION ALL SELECT 'all', count(x), round(avg(x), 6) FROM (SELECT CASE WHEN isnan(synthesizability) THEN NULL ELSE synthesizability END AS x FROM routes_train_val)")
def summary_of_scores(s, d):
    """The summary document: quantiles of the whole and count, mean and spread by source."""
    got = json.loads(SK.summary_document(table(s, d, "routes_train_val"), "synthesizability", "datasource"))
    rows = [("all", got["all"]["count"], got["all"]["mean"]), *((k, v["count"], v["mean"]) for k, v in got["by_source"].items())]
    return rounded(s.createDataFrame(rows, "source string, n long, mean double"))


@query("SELECT x AS column, round(r, 3)::VARCHAR AS r FROM (SELECT unnest(['l_quantity', 'l_discount']) AS x, unnest([1.0, corr(l_quantity, l_discount)]) AS r FROM lineitem)")
def correlation_lines(s, d):
    """The first row of the correlation text, read back."""
    text = SK.correlation_text(M.correlations(table(s, d, "lineitem"), ["l_quantity", "l_discount"]))
    first = text.splitlines()[0].split()
    return s.createDataFrame([(c, str(float(v))) for c, v in zip(("l_quantity", "l_discount"), first[1:])], "column string, r string")


@query("SELECT model, metric, string_agg(v::VARCHAR, ',' ORDER BY seed, fold) AS values FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'GNN' ELSE 'MLP' END AS model, 'n' AS metric, o_orderkey % 2 AS seed, o_orderkey % 3 AS fold, count(*) AS v FROM orders GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")
def nested_fold_scores(s, d):
    own = table(s, d, "orders").groupBy(F.when(F.col("o_orderkey") % 5 == 0, "GNN").otherwise("MLP").alias("model"), F.lit("n").alias("metric"), (F.col("o_orderkey") % 2).alias("seed"), (F.col("o_orderkey") % 3).alias("fold")).agg(F.count("*").alias("value"))
    got = SK.nested_scores(own)
    return s.createDataFrame([(m, k, ",".join(map(str, v))) for m, own in got.items() for k, v in own.items()], "model string, metric string, values string")


@query("SELECT * FROM (VALUES (1, 'GNN_seed0_fold0', 0.75, 'a'), (2, 'MLP_seed0_fold0', 0.25, 'b')) AS t(place, model, weight, path)")
def ensemble_manifest(s, d):
    """The ensemble's document: members by falling weight, with their paths and the feature configuration."""
    weights = {"MLP_seed0_fold0": 0.25, "GNN_seed0_fold0": 0.75}
    got = json.loads(SK.manifest(weights, {"MLP_seed0_fold0": "b", "GNN_seed0_fold0": "a"}, {"fp": {"radius": 3}}))
    return s.createDataFrame([(i, m["model"], m["weight"], m["path"]) for i, m in enumerate(got["members"], 1)], "place int, model string, weight double, path string")


@query("SELECT * FROM (VALUES ('scored', 'out/deep_routes_scored'), ('summary', 'out/deep_routes_summary.json'), ('report', 'out/deep_routes_report.txt')) AS t(kind, path)")
def paths_of_results(s, d):
    return s.createDataFrame(list(SK.output_paths("in/routes.csv", "out", "deep").items()), "kind string, path string")


@query("WITH t AS (SELECT row_id, unnest(['target', 'building_block']) AS role FROM (SELECT 1 AS row_id)) SELECT role, CASE role WHEN 'target' THEN 1 ELSE 3 END::BIGINT AS n FROM t")
def route_file(s, d):
    """Target and leaves of one route as a file of roles, read back."""
    path = f"{_folder(s)}/route.csv"
    own = s.createDataFrame([(1, "{1: [['T => A.BB', '']], 2: [['A => B', '']], 3: [['B => C.D', '']]}")], "row_id long, route string")
    SK.write_file(SK.route_table(RT.with_reactions(own, "route"), "row_id").select("role", "smiles"), path)
    return RD.read_delimited(s, path).groupBy("role").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in Q.items() if q}

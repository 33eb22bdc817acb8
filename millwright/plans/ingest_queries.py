"""Registered queries of sources, ingest and model scores over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions import scalars as S
from millwright.operators import cells as C
from millwright.operators import ingest as I
from millwright.operators import numeric as M
from millwright.operators import process_log as P
from millwright.operators import sessions as H
from millwright.operators import usage as U
from millwright.plans import views as V
from millwright.plans.queries import _REC, _U, _profiles, _rated, _records, _runs, _stages, _tools, query
from millwright.sources import tables as T
from millwright.sources.staging import shared_folder, staged
from millwright.streaming import files as FS


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/millwright/{name}-{uuid.uuid4().hex}"


def _t(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# files that Spark derives from the tables


def _log_file(spark, d) -> str:
    """The events as a process-log file with bad values and bad times in it."""
    path = _folder(spark, "log")
    value = F.when(F.col("event_id") % 50 == 0, "n/a").when(F.col("event_id") % 51 == 0, "1d").otherwise(F.floor("value").cast("string"))
    at = F.when(F.col("event_id") % 97 == 0, "soon").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    rows = _t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("lot_id"), at.alias("worked_at"), (F.col("user_id") % 5).cast("string").alias("product"),
        F.concat(F.lit("00"), (F.col("event_id") % 30).cast("string")).alias("item_id"), F.lit("x").alias("item_name"), value.alias("value"))
    rows.write.option("header", True).csv(path)
    return path


_LOG = """l AS (SELECT CAST(user_id AS VARCHAR) AS lot_id, CASE WHEN event_id % 97 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END END AS worked_at,
 '00' || CAST(event_id % 30 AS VARCHAR) AS item_id, CASE WHEN event_id % 50 <> 0 AND event_id % 51 <> 0 THEN floor(value) END AS value FROM events)"""


@query(f"WITH {_LOG} SELECT lot_id, worked_at, item_id, value, count(*) AS n FROM l WHERE worked_at IS NOT NULL GROUP BY ALL")
def load_readings(spark, d):
    good, _ = T.load_readings(spark, _log_file(spark, d))
    return good.groupBy("lot_id", "worked_at", "item_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOG} SELECT item_id, count(*) AS n FROM l WHERE worked_at IS NULL GROUP BY 1")
def load_readings_bad_times(spark, d):
    return T.load_readings(spark, _log_file(spark, d))[1].groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT '0' || CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name, CASE WHEN p_size % 2 = 0 THEN 'input' ELSE 'output' END AS io, p_brand AS role,
 CASE WHEN p_size <= 25 THEN CAST(p_size AS INTEGER) END AS zone FROM part""")
def load_catalogue(spark, d):
    path = _folder(spark, "catalogue")
    io = F.when(F.col("p_size") % 2 == 0, "input").otherwise("output")
    zone = F.when(F.col("p_size") <= 25, F.col("p_size"))
    rows = _t(spark, d, "part").select(F.concat(F.lit("0"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_name").alias("item_name"), io.alias("io"), F.col("p_brand").alias("role"), zone.alias("zone"))
    rows.write.option("header", True).csv(path)
    return T.load_catalogue(spark, path)


@query("SELECT p_brand AS product, round(avg(p_retailprice), 4) AS target, CAST(max(p_size) AS DOUBLE) AS tolerance, 'mm' AS unit FROM part GROUP BY 1")
def load_product_spec(spark, d):
    path = _folder(spark, "spec")
    rows = _t(spark, d, "part").groupBy(F.col("p_brand").alias("product")).agg(F.round(F.avg("p_retailprice"), 4).alias("target"), F.max("p_size").cast("double").alias("tolerance"), F.lit("mm").alias("unit"))
    rows.write.option("header", True).csv(path)
    return T.load_product_spec(spark, path)


@query("""SELECT CASE n_regionkey % 3 WHEN 0 THEN 'ees' WHEN 1 THEN 'mes' END AS kind, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS content_hash
 FROM nation WHERE n_regionkey % 3 <> 2 GROUP BY n_regionkey, 1""")
def scan_files(spark, d):
    root = _folder(spark, "files")
    lines = _t(spark, d, "nation").repartition(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    lines.select(F.col("n_name").alias("value"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dir")).write.partitionBy("dir").text(root)
    dirs = T.stage_dirs("dir=r0:ees, dir=r1 :mes,dir=r2,dir=r3:ees, dir=r4:mes,dir=r9:iqc")
    return T.scan(spark, root, dirs, {"ees", "mes", "iqc"}, ("txt",)).select("kind", "content_hash")


@query("""SELECT CASE n_regionkey % 3 WHEN 0 THEN 'ees' WHEN 1 THEN 'mes' END AS kind, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS content_hash,
 count(*) AS lines, min(n_name) AS first FROM nation WHERE n_regionkey % 3 <> 2 GROUP BY n_regionkey, 1""")
def streamed_files(spark, d):
    """The files of ``scan_files`` as a stream, two for each batch, and their lines: what the store then holds."""
    root = _folder(spark, "files")
    lines = _t(spark, d, "nation").repartition(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    lines.select(F.col("n_name").alias("value"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dir")).write.partitionBy("dir").text(root)
    dirs = T.stage_dirs("dir=r0:ees, dir=r1 :mes,dir=r3:ees, dir=r4:mes")
    store = T.Store(spark, _folder(spark, "store"))
    read = lambda files: {"lines": files.select("path", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")}
    files = FS.stream_files(spark, root, dirs, {"ees", "mes"}, ("txt",), per_batch=2)
    FS.ingest_files(files, store, _folder(spark, "stream"), read).awaitTermination()
    per = store.load("lines").groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"))
    return store.load("files").join(per, "path").select("kind", "content_hash", "lines", "first")


@query(f"""WITH {_U}, rn AS (SELECT mold_no, count(*) AS runs, count(DISTINCT equipment) AS machines FROM ru GROUP BY 1)
 SELECT ti.mold_no, ti.line, coalesce(runs, 0) AS runs, coalesce(machines, 0) AS machines FROM ti LEFT JOIN rn USING (mold_no)""")
def runs_of_published_tools(spark, d):
    """Tools and runs published in buckets of the tool id: the join and the counts read them without an exchange."""
    store = T.Store(spark, _folder(spark, "store"))
    store.replace_all({"tools": _tools(spark, d), "runs": _runs(spark, d)}, buckets={"tools": (8, "mold_no"), "runs": (8, "mold_no")})
    per = store.load("runs").groupBy("mold_no").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("equipment").alias("machines"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "machines")}
    return store.load("tools").join(per, "mold_no", "left").select("mold_no", "line", *zero.values())


_FILES = """f AS (SELECT c_name AS path, c_mktsegment AS kind, md5(CAST(c_nationkey AS VARCHAR)) AS h FROM customer WHERE c_custkey % 11 <> 0),
 k AS (SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE md5(CAST(c_nationkey AS VARCHAR)) END AS h FROM customer WHERE c_custkey % 7 <> 0)"""


def _found(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.where("c_custkey % 11 <> 0").select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("kind"), F.md5(F.col("c_nationkey").cast("string").cast("binary")).alias("content_hash"))


def _known(spark, d) -> DataFrame:
    c = _t(spark, d, "customer").where("c_custkey % 7 <> 0")
    return c.select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(F.md5(F.col("c_nationkey").cast("string").cast("binary"))).alias("content_hash"))


@query(f"WITH {_FILES} SELECT path, CASE WHEN k.h IS NULL THEN 'new' WHEN f.h IS NULL THEN 'removed' WHEN f.h <> k.h THEN 'changed' ELSE 'same' END AS change FROM f FULL JOIN k USING (path)")
def change_set(spark, d):
    return T.change_set(_found(spark, d), _known(spark, d))


@query(f"WITH {_FILES} SELECT path, kind, h AS content_hash, TIMESTAMP '2026-01-02 03:04:05' AS seen_at FROM f")
def file_registry(spark, d):
    return T.merge_files(_found(spark, d), "2026-01-02 03:04:05")


@query(f"WITH {_U} SELECT mold_no, equipment, equipment_code, line FROM ti")
def published_tables(spark, d):
    """The second publication replaces the first whole."""
    store = T.Store(spark, _folder(spark, "store"))
    store.replace_all({"tools": _tools(spark, d).where("line = 'L1'").drop("jig_name"), "gone": _found(spark, d)})
    store.replace_all({"tools": _tools(spark, d).drop("jig_name")})
    return store.load("tools")


@query("SELECT CAST(count(*) AS BIGINT) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def latest_run(spark, d):
    store = T.Store(spark, _folder(spark, "runs"))
    store.record_run({"orders": 0, "keys": 0})
    store.record_run(_t(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys")).first().asDict())
    return spark.createDataFrame([store.latest_run()], "orders long, keys long")


@query("SELECT CAST(count(*) AS BIGINT) AS id, 'part' AS kind FROM part GROUP BY p_brand")
def saved_layouts(spark, d):
    store = T.Store(spark, _folder(spark, "layouts"))
    for r in _t(spark, d, "part").groupBy("p_brand").count().orderBy("p_brand").collect():  # a layout for each sheet
        store.save_layout({"id": r[1], "kind": "part"})
    store.save_layout({"id": -1, "kind": "other"})
    return store.load_layouts("part", "id long, kind string").select("id", "kind")


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_rows(spark, d):
    a = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return T.union_rows([a, b])


# process log and models


@query("""WITH c AS (SELECT * FROM (VALUES ('click', 'input', 'control', 1), ('signup', 'input', 'control', 2), ('error', 'input', 'control', NULL), ('view', 'output', 'loading_level', 1), ('purchase', 'output', 'loading_level', 2)) t(item_id, io, role, zone))
 SELECT event_type AS item_id, io, role, zone, count(*) AS n, sum(CASE WHEN floor(value / 10) = 0 THEN 1 ELSE 0 END) AS unmeasured FROM events LEFT JOIN c ON event_type = item_id GROUP BY ALL""")
def readings_with_catalogue(spark, d):
    rows = P.with_catalogue(V.readings(spark, d), V.catalogue(spark))
    return rows.groupBy("item_id", "io", "role", "zone").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value").isNotNull() & S.measured("value").isNull(), 1).otherwise(0)).alias("unmeasured"))


@query("""WITH z AS (SELECT o_custkey AS lot_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS zone, floor(o_totalprice / 1000) AS g FROM orders)
 SELECT a.lot_id, CAST(a.zone AS INTEGER) AS zone, CAST(o.i AS INTEGER) AS i, coalesce(b.g, 0.0) AS g FROM z a, (SELECT unnest(range(5)) AS i) o LEFT JOIN z b ON b.lot_id = a.lot_id AND b.zone = a.zone + o.i - 2""")
def neighbour_design(spark, d):
    z = V.finals(spark, d).groupBy(F.col("product").alias("lot_id")).agg(F.array_sort(F.collect_list(F.struct("lot_id", "os_gap"))).alias("a"))
    z = z.select("lot_id", M.neighbours(F.transform("a", lambda x: F.floor(x["os_gap"] / 1000).cast("double")), 2).alias("n"))
    z = z.select("lot_id", F.posexplode("n").alias("zone", "r")).select("lot_id", (F.col("zone") + 1).cast("int").alias("zone"), F.posexplode("r").alias("i", "g"))
    return z.select("lot_id", "zone", F.col("i").cast("int").alias("i"), "g")


@query("""WITH p AS (SELECT lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pred, o_totalprice AS actual FROM orders) SELECT round(avg(abs(pred - actual)), 6) AS level_mae FROM p""")
def level_mae(spark, d):
    pred = F.lag("os_gap").over(W.partitionBy("product").orderBy("worked_at", "lot_id"))
    return M.level_mae(V.finals(spark, d).withColumn("pred", pred), "pred", "os_gap").select(F.round("level_mae", 6).alias("level_mae"))


@query("""WITH z AS (SELECT o_custkey, o_totalprice / 1e5 AS y, CAST(o_orderkey % 97 AS DOUBLE) / 97 AS x FROM orders), m AS (SELECT *, y - avg(y) OVER w AS dy, x - avg(x) OVER w AS dx FROM z WINDOW w AS (PARTITION BY o_custkey))
 SELECT round(sqrt(avg((dx - dy) * (dx - dy))), 9) AS profile_rmse FROM m""")
def profile_rmse(spark, d):
    p = V.finals(spark, d).groupBy("product").agg(F.array_sort(F.collect_list(F.struct("lot_id", "os_gap", "ds_gap"))).alias("a"))
    p = p.select(F.transform("a", lambda x: x["os_gap"] / 1e5).alias("wet"), F.transform("a", lambda x: x["ds_gap"] / 97).alias("pred"))
    return M.profile_rmse(p, "pred", "wet").select(F.round("profile_rmse", 9).alias("profile_rmse"))


@query("SELECT 'os_gap' AS feature, count(o_totalprice) AS n FROM orders UNION ALL SELECT 'ds_gap', count(o_orderkey) FROM orders")
def available_features(spark, d):
    f = V.finals(spark, d).withColumn("empty", F.lit(None).cast("double"))
    names = M.available_features(f, ["os_gap", "absent", "empty", "ds_gap"])
    return f.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n")


# production, ledger, inspection


@query("""WITH r AS (SELECT CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber <> 7 THEN CAST(l_suppkey AS VARCHAR) END AS code, CASE WHEN l_quantity <> 13 THEN CAST(l_quantity AS BIGINT) END AS produced,
  CAST(l_linenumber AS BIGINT) AS defects, l_orderkey * 10 + l_linenumber AS k FROM lineitem)
 SELECT day, code, arg_max(produced, k) AS produced, arg_max(defects, k) AS defects FROM r WHERE code IS NOT NULL AND produced IS NOT NULL GROUP BY 1, 2""")
def production_index(spark, d):
    return U.production_index(_production_rows(spark, d))[0]


@query("SELECT CAST(l_suppkey AS VARCHAR) AS code, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 AND l_quantity = 13 GROUP BY 1")
def unreadable_production(spark, d):
    return U.production_index(_production_rows(spark, d))[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _production_rows(spark, d) -> DataFrame:
    amount = F.when(F.col("l_quantity") == 13, "측정불가").otherwise(F.format_number("l_quantity", 1))
    return _t(spark, d, "lineitem").select(
        F.concat(F.lit("기간 "), F.date_format("l_shipdate", "yyyy/M/d"), F.lit(" ~ 2030/1/1")).alias("run_date"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey").cast("string")).alias("equipment_code"),
        amount.alias("produced"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".9")).alias("defects"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_key"))


_ITEMS = """it AS (SELECT 'RX' || lpad(CAST(ps AS VARCHAR), 6, '0') AS mold_no, k AS order_key, x.f AS item, x.v AS value, row_number() OVER (PARTITION BY k ORDER BY x.r) AS position FROM (
  SELECT o_custkey AS ps, o_orderkey AS k, unnest([{'f': 'punch', 'v': CAST(o_orderkey % 7 AS VARCHAR), 'r': 1}, {'f': 'die', 'v': CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, 'r': 2},
   {'f': 'gap', 'v': o_orderstatus, 'r': 4}, {'f': 'note', 'v': o_orderpriority, 'r': 1001}, {'f': 'memo', 'v': o_orderstatus, 'r': 1005}]) AS x FROM orders) WHERE x.v IS NOT NULL)"""


def _inspection(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    cell = lambda field, position, value: F.struct(F.lit(field).alias("field"), F.lit(position).alias("position"), value.cast("string").alias("value"))
    tool = F.concat(F.lit(" #rx"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("\t"))
    values = F.array(cell("note", 1, F.col("o_orderpriority")), cell("gap", 2, F.col("o_orderstatus")), cell("mold_no", 3, tool), cell("punch", 4, F.col("o_orderkey") % 7), cell("memo", 5, F.col("o_orderstatus")), cell("die", 6, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))))
    return o.select(tool.alias("mold_no"), F.col("o_orderkey").alias("order_key"), values.alias("values"))


@query(f"WITH {_ITEMS} SELECT mold_no, order_key, CAST(position AS INTEGER) AS position, item, value FROM it")
def inspection_items(spark, d):
    return U.inspection_items(_inspection(spark, d))


@query(f"""WITH {_ITEMS} SELECT mold_no, order_key, '[' || string_agg('{{"label":"' || item || '","value":"' || value || '","judgment":null,"source":{{"file":null,"sheet":null,"cell":null}}}}', ',' ORDER BY position) || ']' AS items_json FROM it GROUP BY 1, 2""")
def inspection_json(spark, d):
    return U.inspection_json(U.inspection_items(_inspection(spark, d)))


@query(f"WITH {_U}, {_ITEMS} SELECT mold_no, count(*) AS n FROM it WHERE mold_no IN (SELECT mold_no FROM ti) GROUP BY 1")
def attached_inspection(spark, d):
    known, _ = U.attach_inspection(U.inspection_items(_inspection(spark, d)), _tools(spark, d))
    return known.groupBy("mold_no").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_U}, {_ITEMS} SELECT DISTINCT mold_no FROM it WHERE mold_no NOT IN (SELECT mold_no FROM ti)")
def orphan_inspection(spark, d):
    return U.attach_inspection(U.inspection_items(_inspection(spark, d)), _tools(spark, d))[1]


_STAGES = """sg AS (SELECT 'RX' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS mold_no, CASE c_custkey % 4 WHEN 0 THEN 'iqc' WHEN 1 THEN 'install' WHEN 2 THEN 'pqc' ELSE 'design' END AS stage,
  CASE WHEN c_custkey % 3 = 0 THEN 'ok' ELSE 'warn' END AS status, c_name AS label, c_mktsegment AS value, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS source_file,
  CASE WHEN c_custkey % 5 = 0 THEN 'OK' END AS judgment, CASE WHEN c_custkey % 3 = 0 THEN c_name || '/A1' END AS source, CASE WHEN c_custkey % 7 = 0 THEN 'late' END AS error FROM customer)"""


@query(f"""WITH {_REC}, {_STAGES}, us AS (SELECT DISTINCT mold_no FROM ru), nm AS (SELECT unnest(['design', 'install', 'iqc', 'pqc', 'ai_recheck']) AS stage)
 SELECT re.mold_no, nm.stage, coalesce(sg.status, CASE WHEN nm.stage = 'install' AND us.mold_no IS NOT NULL THEN 'ok' ELSE 'missing' END) AS status
 FROM re CROSS JOIN nm LEFT JOIN sg ON sg.mold_no = re.mold_no AND sg.stage = nm.stage LEFT JOIN us ON us.mold_no = re.mold_no""")
def stage_status(spark, d):
    out = U.stage_status(_records(spark, d), _stages(spark, d), _runs(spark, d))
    return out.select("mold_no", F.explode("stage_status").alias("stage", "status"))


@query(f"WITH {_STAGES} SELECT mold_no, stage, status, label, value, judgment, source, source_file, error FROM sg WHERE stage IN ('iqc', 'pqc')")
def stage_panels(spark, d):
    out = U.stage_panels(_stages(spark, d)).select("mold_no", "stage", "status", F.inline("items"), "source_file", "error")
    return out.withColumn("source", F.concat(F.col("source.file"), F.lit("/"), F.col("source.cell")))


@query(f"""WITH {_U}, sq AS (SELECT *, row_number() OVER (PARTITION BY mold_no ORDER BY started_at, order_key) AS install_seq FROM ra)
 SELECT mold_no, install_seq, line, equipment AS machine, started_at, ended_at, round(rate, 9) AS rate, produced, defects, coalesce(days_found, 0) AS days_covered, coalesce(days_expected, 0) AS days_expected FROM sq""")
def production_runs(spark, d):
    """Runs with their daily rows stored as JSON, read back and summed."""
    runs = staged(U.install_seq(_rated(spark, d)), "runs")
    stored = runs.join(U.daily_lists(runs, V.production(spark, d)), ["mold_no", "started_at", "order_key"], "left")
    out = U.production_runs(stored)
    return out.withColumns({"rate": F.round("rate", 9)} | {c: F.col(c).cast("long") for c in ("install_seq", "days_covered")})


@query("SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS mold_no, CAST(l_linenumber AS VARCHAR) AS started_at, " + ", ".join(f"CAST(sum(CASE WHEN round(l_discount * 100) = {k} THEN l_quantity END) AS BIGINT) AS d{k}" for k in range(11)) + " FROM lineitem GROUP BY 1, 2")
def defect_columns(spark, d):
    rows = _t(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("mold_no"), F.col("l_linenumber").cast("string").alias("started_at"),
        F.concat(F.lit("d"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("label"), F.col("l_orderkey").alias("order_key"), F.col("l_quantity").cast("long").alias("n"))
    return U.defect_columns(rows)


@query(f"""WITH {_REC}, {_ITEMS} SELECT (SELECT count(*) FROM re) AS tools, (SELECT count(*) FROM ra) AS runs, (SELECT count(DISTINCT mold_no) FROM it WHERE mold_no IN (SELECT mold_no FROM re)) AS inspected,
 (SELECT count(*) FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 59 = 0) AS rejected_events, (SELECT count(DISTINCT mold_no) FROM le WHERE mold_no NOT IN (SELECT mold_no FROM ti)) AS unknown_tools,
 (SELECT count(DISTINCT equipment) FROM le WHERE location = '설비' AND mold_no IN (SELECT mold_no FROM ti) AND equipment NOT IN (SELECT equipment FROM ei)) AS unknown_equipment,
 (SELECT count(DISTINCT day) FROM da LEFT JOIN pr USING (day, code) WHERE code IS NOT NULL AND produced IS NULL) AS missing_days,
 (SELECT count(*) FROM ra WHERE ended_at IS NULL) AS open_runs, (SELECT count(*) FROM ra WHERE ended_at > started_at AND coalesce(days_found, 0) = 0) AS unmatched_runs,
 (SELECT count(DISTINCT mold_no) FROM it WHERE mold_no NOT IN (SELECT mold_no FROM re)) AS orphans, (SELECT count(*) FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 59 = 0) AS skipped_rows""")
def assembled_summary(spark, d):
    p = V.production(spark, d).select(F.col("day").cast("string").alias("run_date"), F.col("code").alias("equipment_code"), F.col("produced").cast("string").alias("produced"), F.col("defects").cast("string").alias("defects"), F.lit(1).alias("order_key"))
    return I.summary(I.assemble(V.master(spark, d), V.ledger(spark, d), p, _inspection(spark, d)))


# cells


_GRID = """cl AS (SELECT p_brand AS sheet, row_no, unnest([{'c': 1, 'v': p_name}, {'c': 2, 'v': p_type}, {'c': 3, 'v': CAST(p_size AS VARCHAR)}, {'c': 4, 'v': CAST(p_retailprice AS VARCHAR)}], recursive := true)
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS INTEGER) AS row_no FROM part)),
 us AS (SELECT p_brand AS sheet, CAST(count(*) + 1 AS INTEGER) AS last_row FROM part GROUP BY 1)"""


@query(f"WITH {_GRID} SELECT sheet, row_no, CAST(c AS INTEGER) AS col_no, last_row > 12 AS rows_cut, TRUE AS cols_cut FROM cl JOIN us USING (sheet) WHERE row_no BETWEEN 3 AND 12 AND c BETWEEN 2 AND 3")
def read_range(spark, d):
    return C.read_range(V.cells(spark, d), 3, 2, 10, 2).select("sheet", "row_no", "col_no", "rows_cut", "cols_cut")


@query(f"WITH {_GRID} SELECT sheet, 1 AS first_row, last_row, 1 AS first_col, 4 AS last_col FROM us")
def used_shape(spark, d):
    return C.used_shape(V.cells(spark, d)).drop("source_file")


@query(f"WITH {_GRID} SELECT sheet, row_no, v AS value FROM cl WHERE c = 2 AND row_no < 21 UNION ALL SELECT sheet, 1, 'Type' FROM us")
def column_values(spark, d):
    return C.column_values(V.cells(spark, d), 2, 20).select("sheet", "row_no", C.cell_text().alias("value"))


@query("SELECT DISTINCT 'part' AS source_file, p_brand AS sheet FROM part")
def sheet_names(spark, d):
    return C.sheet_names(V.cells(spark, d))


@query(f"WITH {_GRID}, n AS (SELECT *, CASE c WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'D' END AS l FROM cl) SELECT sheet, '$' || l || '$' || row_no AS cell, row_no, CAST(c AS INTEGER) AS col_no, CASE WHEN row_no > 4 THEN chr(CAST(ascii(l) + 2 AS INTEGER)) || (row_no - 4) END AS shifted FROM n")
def cell_addresses(spark, d):
    cells = V.cells(spark, d).where("row_no > 1").withColumn("cell", F.concat(F.lit("$"), S.column_letters("col_no"), F.lit("$"), F.col("row_no").cast("string")))
    at = S.a1_row_col("cell")
    return cells.select("sheet", "cell", at["row_no"].alias("row_no"), at["col_no"].alias("col_no"), S.a1_offset("cell", -4, 2).alias("shifted"))


@query("""WITH l AS (SELECT c_mktsegment AS line, c_nationkey AS nation, CAST(floor(sum(c_acctbal)) AS BIGINT) AS m1, count(*) AS m2 FROM customer GROUP BY 1, 2), t AS (SELECT line, sum(m1) AS m1, sum(m2) AS m2 FROM l GROUP BY 1)
 SELECT line, 'm1' AS month, CAST(m1 AS BIGINT) AS summed, CAST(m1 + 1 AS BIGINT) AS stated, CAST(-1 AS BIGINT) AS difference FROM t UNION ALL SELECT line, 'm2', CAST(m2 AS BIGINT), CAST(m2 AS BIGINT), CAST(0 AS BIGINT) FROM t""")
def reconciled_totals(spark, d):
    lines = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("line"), F.col("c_nationkey").cast("string").alias("product")).agg(F.floor(F.sum("c_acctbal")).cast("long").alias("m1"), F.count(F.lit(1)).alias("m2"))
    total = lines.groupBy("line").agg((F.sum("m1") + 1).alias("m1"), F.sum("m2").alias("m2")).select("line", F.concat("line", F.lit(" 소계")).alias("product"), "m1", "m2")
    return C.reconcile(lines.unionByName(total), "line", "product", ["m1", "m2"])


# words and sessions


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'in_use' WHEN 1 THEN 'standby' WHEN 2 THEN 'repair' WHEN 3 THEN 'retired' END AS status, CAST(o_orderdate AS DATE) AS run_date FROM orders""")
def status_words(spark, d):
    word = F.element_at(F.array(*map(F.lit, ["사용 중", " 대기", "수리중\n", "폐 기", "unknown", ""])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    label = F.concat(F.lit("작업 "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit("~"), F.date_format(F.date_add("o_orderdate", 6), "yyyy.M.d"))
    return _t(spark, d, "orders").select("o_orderkey", S.normalize_status(word).alias("status"), S.run_date(label).alias("run_date"))


@query("SELECT conv_id AS session_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS role FROM conversations")
def message_roles(spark, d):
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    return H.serialize(V.messages(spark, d).withColumn("kind", kind)).select("session_id", "turn", "role")


@query("WITH s AS (SELECT conv_id AS id, max(turn) AS updated_at FROM conversations GROUP BY 1) SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM s")
def session_list(spark, d):
    """The order of the list is part of the result."""
    s = V.messages(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.max("turn").alias("updated_at"))
    listed = staged(H.list_sessions(s).withColumn("_at", F.monotonically_increasing_id()), "sessions")
    # a sort by ranges numbers each partition's rows; the partitions' sizes give what stands before them
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = listed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_p", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each partition
    return listed.withColumn("_p", part).join(F.broadcast(before), "_p").select("id", "updated_at", (F.col("_b") + place + 1).alias("place"))

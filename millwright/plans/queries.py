"""Registered queries over the driver's tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions import scalars as S
from millwright.operators import cells as C
from millwright.operators import numeric as M
from millwright.operators import process_log as P
from millwright.operators import search as X
from millwright.operators import sessions as H
from millwright.operators import usage as U
from millwright.plans import views as V
from millwright.sources.staging import shared_folder, staged
from millwright.streaming import settling as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


HOUR = 60  # the views log by the hour: minute parameters are scaled
_R = """r AS (SELECT CAST(user_id AS VARCHAR) AS lot_id, date_trunc('hour', ts) AS worked_at, CAST(user_id % 5 AS VARCHAR) AS product, event_type AS item_id, floor(value / 10) AS value, event_id AS row_no FROM events)"""
_DD = _R + """, dd AS (SELECT lot_id, worked_at, item_id, arg_max(value, row_no) AS value, arg_max(product, row_no) AS product FROM r GROUP BY 1, 2, 3)"""
_CH = _DD + """, ch AS (SELECT lot_id, item_id, worked_at, value, prev_value FROM (SELECT *, lag(value) OVER (PARTITION BY lot_id, item_id ORDER BY worked_at) AS prev_value FROM dd)
  WHERE prev_value IS NULL OR value <> prev_value)"""
_EV = _CH + """, cc AS (SELECT *, CASE item_id WHEN 'click' THEN 1 WHEN 'signup' THEN 2 END AS zone FROM ch WHERE item_id IN ('click', 'signup', 'error') AND prev_value IS NOT NULL),
 g AS (SELECT *, CASE WHEN worked_at - lag(worked_at) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM cc WINDOW w AS (PARTITION BY lot_id ORDER BY worked_at, item_id)),
 de AS (SELECT *, lot_id || '#' || CAST(sum(fresh) OVER (PARTITION BY lot_id ORDER BY worked_at, item_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS event_id FROM g),
 ev AS (SELECT lot_id, event_id, min(worked_at) AS worked_at, count(DISTINCT item_id) AS n_items FROM de GROUP BY 1, 2)"""
_WET = """wl AS (SELECT lot_id, worked_at, CASE item_id WHEN 'view' THEN 1 ELSE 2 END AS zone, value AS wet FROM dd WHERE item_id IN ('view', 'purchase') AND value <> 0),
 wm AS (SELECT lot_id, worked_at, avg(wet) AS wet_mean FROM wl GROUP BY 1, 2)"""
_ANN = _EV + ", " + _WET + """, st AS (SELECT lot_id, lag(worked_at) OVER w AS start, worked_at AS stop, abs(wet_mean - lag(wet_mean) OVER w) / 2 AS sd FROM wm WINDOW w AS (PARTITION BY lot_id ORDER BY worked_at)),
 nx AS (SELECT *, lead(worked_at) OVER (PARTITION BY lot_id ORDER BY worked_at, event_id) AS next_at FROM ev),
 se AS (SELECT nx.lot_id, event_id, min(stop) AS stop FROM nx JOIN st ON nx.lot_id = st.lot_id AND st.sd <= 1.1 AND st.start > nx.worked_at GROUP BY 1, 2),
 an AS (SELECT nx.*, CASE WHEN stop <= nx.worked_at + INTERVAL 48 HOUR THEN stop END AS settled_at FROM nx LEFT JOIN se USING (event_id)),
 ann AS (SELECT lot_id, event_id, worked_at, n_items, settled_at, settled_at IS NULL OR coalesce(next_at < settled_at, FALSE) AS contaminated,
   CASE WHEN settled_at IS NULL THEN 'no_settle' WHEN next_at < settled_at THEN 'overlapped' END AS drop_reason FROM an)"""


def _deduped(spark, d):
    return P.dedupe(V.readings(spark, d))


def _changes(spark, d):
    return P.compress_runs(_deduped(spark, d))


def _events(spark, d):
    return P.build_events(_changes(spark, d), V.catalogue(spark), 6 * HOUR)


def _wet(spark, d):
    return P.wet_long(_deduped(spark, d), V.catalogue(spark))


def _annotated(spark, d):
    return P.annotate_settling(_events(spark, d)[0], P.wet_mean(_wet(spark, d)), 1.1, 2, 48 * HOUR)


def _samples(spark, d):
    log = staged(_deduped(spark, d), "deduped")  # read five times
    events, deltas = P.build_events(P.compress_runs(log), V.catalogue(spark), 6 * HOUR)
    wet = P.wet_long(log, V.catalogue(spark))
    return P.delta_samples(P.annotate_settling(events, P.wet_mean(wet), 1.1, 2, 48 * HOUR), deltas, wet, 24 * HOUR, 2)


@query(f"WITH {_DD} SELECT * FROM dd")
def dedupe_minute(spark, d):
    return _deduped(spark, d)


@query(f"WITH {_CH} SELECT * FROM ch")
def compress_runs(spark, d):
    return _changes(spark, d)


@query(f"""WITH {_CH}, pr AS (SELECT DISTINCT lot_id, TIMESTAMP '2024-01-10 00:00:00' AS at FROM ch)
 SELECT pr.lot_id, pr.at, item_id, arg_max(value, worked_at) AS value FROM pr JOIN ch ON pr.lot_id = ch.lot_id AND ch.worked_at <= pr.at GROUP BY 1, 2, 3""")
def state_at(spark, d):
    ch = _changes(spark, d)
    return P.state_at(ch, ch.select("lot_id", F.lit("2024-01-10 00:00:00").cast("timestamp").alias("at")))


@query(f"WITH {_DD} SELECT lot_id, min(worked_at) AS started_at, max(worked_at) AS ended_at, arg_min(product, (worked_at, item_id)) AS product FROM dd GROUP BY 1")
def lot_bounds(spark, d):
    return P.lot_bounds(_deduped(spark, d))


@query(f"WITH {_CH} SELECT lot_id, max(CASE WHEN item_id IN ('click', 'signup', 'error') AND prev_value IS NOT NULL THEN worked_at END) AS tuning_end FROM ch GROUP BY 1")
def tuning_end_last_change(spark, d):
    return P.tuning_end_last_change(_changes(spark, d), V.catalogue(spark))


@query(f"WITH {_EV} SELECT * FROM ev")
def adjustment_events(spark, d):
    return _events(spark, d)[0]


@query(f"WITH {_EV} SELECT lot_id, event_id, worked_at, item_id, zone, value - prev_value AS delta FROM de")
def event_deltas(spark, d):
    return _events(spark, d)[1]


@query(f"WITH {_DD}, {_WET} SELECT lot_id, worked_at, max(CASE WHEN zone = 1 THEN wet END) AS z1, max(CASE WHEN zone = 2 THEN wet END) AS z2 FROM wl GROUP BY 1, 2")
def wet_wide(spark, d):
    return P.wet_wide(_wet(spark, d), 2)


@query(f"WITH {_DD}, {_WET} SELECT DISTINCT zone FROM wl")
def valid_zones(spark, d):
    return P.valid_zones(_wet(spark, d))


@query(f"WITH {_DD}, {_WET} SELECT * FROM wm")
def wet_mean_series(spark, d):
    return P.wet_mean(_wet(spark, d))


@query(f"WITH {_ANN} SELECT * FROM ann")
def settling(spark, d):
    return _annotated(spark, d)


@query(f"WITH {_ANN} SELECT * FROM ann")
def settling_stream(spark, d):
    """The log replayed as a stream of four files, one row in five a day late: the events of ``settling``."""
    log = staged(_deduped(spark, d), "deduped")
    changes = P.control_changes(P.compress_runs(log), V.catalogue(spark))
    rows = staged(ST.signals(changes, P.wet_mean(P.wet_long(log, V.catalogue(spark)))), "signals")
    at = F.unix_seconds("worked_at") + F.when(F.xxhash64("worked_at", "lot_id") % 5 == 0, 86_400).otherwise(0)
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return spark.createDataFrame([], ST.OUT)
    folder = f"{shared_folder(spark)}/millwright/settling-{uuid.uuid4().hex}"
    part = F.floor((at - lo) * 4 / (hi - lo + 1))
    for k in range(4):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/in")
    # two later rows move the watermark beyond the last deadline
    for k in (1, 2):
        last = spark.createDataFrame([("", hi + 86_400 * 30 * k)], "lot_id string, at long")
        last.select("lot_id", F.timestamp_seconds("at").alias("worked_at"), F.lit(ST.MEAN).alias("kind"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("double").alias("wet_mean")).write.mode("append").parquet(f"{folder}/in")
    own = spark.newSession()
    own.conf.set(ST.STATE_STORE, ST.ROCKS)
    # a partition of the state costs about a second in every batch, however few rows it has
    own.conf.set("spark.sql.shuffle.partitions", min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
    # a quarter of the files at a time: as many batches whatever the input's size
    files = -(-(len(spark.read.schema(rows.schema).parquet(f"{folder}/in").inputFiles()) - 2) // 4)
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{folder}/in")
    found = ST.stream_settling(stream, 6 * HOUR, 1.1, 2, 48 * HOUR, "2 days", 30 * 24 * HOUR)
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(ST.OUT).parquet(f"{folder}/out")


_DS = """cl AS (SELECT * FROM ann WHERE NOT contaminated),
 be AS (SELECT event_id, zone, avg(wet) AS m FROM cl JOIN wl ON cl.lot_id = wl.lot_id AND wl.worked_at BETWEEN cl.worked_at - INTERVAL {w} HOUR AND cl.worked_at GROUP BY 1, 2),
 af AS (SELECT event_id, zone, avg(wet) AS m FROM cl JOIN wl ON cl.lot_id = wl.lot_id AND wl.worked_at BETWEEN cl.settled_at AND cl.settled_at + INTERVAL {w} HOUR GROUP BY 1, 2),
 ga AS (SELECT event_id, zone, arg_max(value - prev_value, (worked_at, item_id)) AS d FROM de WHERE zone IS NOT NULL GROUP BY 1, 2),
 zo AS (SELECT * FROM (VALUES (1), (2)) t(zone)), ok AS (SELECT DISTINCT event_id FROM be INTERSECT SELECT DISTINCT event_id FROM af),
 ds AS (SELECT ok.event_id, CAST(zo.zone AS INTEGER) AS zone, coalesce(ga.d, 0.0) AS dg, af.m - be.m AS dw FROM ok CROSS JOIN zo LEFT JOIN be ON be.event_id = ok.event_id AND be.zone = zo.zone
 LEFT JOIN af ON af.event_id = ok.event_id AND af.zone = zo.zone LEFT JOIN ga ON ga.event_id = ok.event_id AND ga.zone = zo.zone),
 pr AS (SELECT event_id, max(CASE WHEN zone = 1 THEN dg END) AS g1, max(CASE WHEN zone = 2 THEN dg END) AS g2, max(CASE WHEN zone = 1 THEN dw END) AS w1, max(CASE WHEN zone = 2 THEN dw END) AS w2 FROM ds GROUP BY 1),
 gm AS (SELECT count(*) AS n, (sum(g1 * g1) + sum(g2 * g2)) / 2 AS m, sqrt(pow((sum(g1 * g1) - sum(g2 * g2)) / 2, 2) + pow(sum(g1 * g2), 2)) AS r FROM pr),
 sv AS (SELECT n, sqrt(m + r) AS s1, sqrt(greatest(m - r, 0)) AS s2 FROM gm)"""
_RANK = "(CASE WHEN s1 > 0 THEN 1 ELSE 0 END + CASE WHEN s2 > 1e-9 * s1 THEN 1 ELSE 0 END)"


@query(f"WITH {_ANN}, {_DS.format(w=24)} SELECT event_id, lot_id, worked_at, zone, dg, round(dw, 9) AS dw FROM ds JOIN ev USING (event_id)")
def delta_samples(spark, d):
    rows = _samples(spark, d).select("event_id", "lot_id", "worked_at", F.posexplode(F.arrays_zip("dg", "dw")).alias("p", "r"))
    return rows.select("event_id", "lot_id", "worked_at", (F.col("p") + 1).cast("int").alias("zone"), "r.dg", F.round("r.dw", 9).alias("dw"))


@query(f"""WITH {_DD}, {_WET}, i AS (SELECT *, coalesce(abs(wet_mean - 4) <= 2.2, FALSE) AS ok FROM wm), k AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY lot_id ORDER BY worked_at ROWS UNBOUNDED PRECEDING) AS n FROM i),
 s AS (SELECT lot_id, n, min(worked_at) AS at FROM k WHERE ok GROUP BY 1, 2 HAVING count(*) >= 3) SELECT l.lot_id, min(s.at) AS tuning_end FROM (SELECT DISTINCT lot_id FROM wm) l LEFT JOIN s USING (lot_id) GROUP BY 1""")
def tuning_end_band(spark, d):
    return P.tuning_end_band(P.wet_mean(_wet(spark, d)), 4, 2.2, 3)


@query(f"""WITH {_EV}, n AS (SELECT lot_id, CAST(count(*) AS DOUBLE) AS n FROM cc GROUP BY 1) SELECT count(n) AS count, round(avg(n), 9) AS mean, round(stddev_samp(n), 9) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM n""")
def changes_per_lot(spark, d):
    return P.changes_per_lot(_changes(spark, d), V.catalogue(spark)).withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query("SELECT item_id FROM (VALUES ('click'), ('signup'), ('error'), ('pump')) t(item_id) WHERE item_id NOT IN (SELECT event_type FROM events)")
def missing_control_items(spark, d):
    return P.missing_controls(V.readings(spark, d), V.catalogue(spark))


@query("SELECT DISTINCT event_type AS item_id FROM events WHERE event_type NOT IN ('click', 'view')")
def unknown_item_ids(spark, d):
    return P.unknown_items(V.readings(spark, d), V.catalogue(spark).where("item_id in ('click', 'view')"))


def _settled(merge: int, window: int, std: float, wait: int) -> str:
    """``_ANN`` with other hours and window lengths."""
    trail = f"(PARTITION BY lot_id ORDER BY worked_at ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    head, tail = _ANN.split("st AS (")[0], _ANN.split("nx AS (")[1]
    stable = f"""st AS (SELECT lot_id, lag(worked_at, {window - 1}) OVER (PARTITION BY lot_id ORDER BY worked_at) AS start, worked_at AS stop,
  CASE WHEN count(wet_mean) OVER {trail} = {window} THEN stddev_pop(wet_mean) OVER {trail} END AS sd FROM wm)"""
    tail = tail.replace("st.sd <= 1.1", f"st.sd <= {std}").replace("INTERVAL 48 HOUR", f"INTERVAL {wait} HOUR")
    return head.replace("INTERVAL 6 HOUR", f"INTERVAL {merge} HOUR") + stable + ", nx AS (" + tail


@query(f"""WITH {_settled(8, 5, 2.5, 120)}, {_DS.format(w=20)}, f AS (SELECT (SELECT count(*) FROM ann) AS n_events, (SELECT count(*) FROM cl) AS n_clean_events, (SELECT CASE WHEN n > 0 THEN {_RANK} ELSE 0 END FROM sv) AS rank)
 SELECT (SELECT count(DISTINCT lot_id) FROM dd) AS n_lots, (SELECT min(worked_at) FROM dd) AS "from", (SELECT max(worked_at) FROM dd) AS "to", (SELECT count(*) FROM dd) AS n_rows, n_events, n_clean_events,
  (SELECT count(DISTINCT zone) FROM wl) AS n_zones, CAST(rank AS BIGINT) AS effective_rank, (SELECT coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') FROM events WHERE event_type NOT IN ('click', 'signup', 'error', 'view', 'purchase', 'pump')) AS unknown_items,
  (SELECT string_agg(i, ',' ORDER BY i) FROM (VALUES ('click'), ('signup'), ('error'), ('pump')) c(i) WHERE i NOT IN (SELECT event_type FROM events)) AS missing_items, round((n_events - n_clean_events) / n_events, 9) AS contaminated_ratio,
  CASE WHEN n_clean_events < 20 THEN 'insufficient' WHEN rank < 3 THEN 'rank_deficient' ELSE 'trainable' END AS verdict FROM f""")
def log_audit(spark, d):
    out = P.audit(V.readings(spark, d), V.catalogue(spark), 4 * HOUR, 2, 2.5)
    words = {c: F.array_join(c, ",") for c in ("unknown_items", "missing_items")}
    return out.withColumns(words | {"contaminated_ratio": F.round("contaminated_ratio", 9)})


@query(f"""WITH {_ANN}, {_DS.format(w=24)}, e AS (SELECT (g1 - g2) / 2 AS e, w1 IS NOT NULL AS v1, w2 IS NOT NULL AS v2, CASE WHEN w1 IS NULL OR w2 IS NULL THEN 0 ELSE (w1 - w2) / 2 END AS y FROM pr),
 s AS (SELECT sum(CASE WHEN v1 THEN e * e ELSE 0 END) AS p, sum(CASE WHEN v2 THEN e * e ELSE 0 END) AS q, sum(CASE WHEN v1 THEN e * y ELSE 0 END) AS b, sum(CASE WHEN v2 THEN -e * y ELSE 0 END) AS c FROM e),
 a AS (SELECT q + 1e-3 AS a11, -q AS a12, p + q + 1e-3 AS a22, -p AS a23, p + 1e-3 AS a33, c AS b1, b - c AS b2, -b AS b3 FROM s),
 w AS (SELECT a11 * (a22 * a33 - a23 * a23) - a12 * a12 * a33 AS det, (a22 * a33 - a23 * a23) * b1 - a12 * a33 * b2 + a12 * a23 * b3 AS x1, -a12 * a33 * b1 + a11 * a33 * b2 - a11 * a23 * b3 AS x2,
  a12 * a23 * b1 - a11 * a23 * b2 + (a11 * a22 - a12 * a12) * b3 AS x3 FROM a)
 SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(CASE j - i WHEN 0 THEN x2 WHEN 1 THEN x3 ELSE x1 END / det, 6) AS weight FROM w, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)""")
def kernel_fit(spark, d):
    k = M.fit_kernel(_samples(spark, d), 1, 1e-3)
    return M.kernel_rows(spark, k, 2).withColumns({"j": F.col("j").cast("long"), "weight": F.round("weight", 6)})


@query(f"""WITH {_ANN}, {_DS.format(w=24)}, e AS (SELECT CAST(lot_id AS BIGINT) % 2 AS fold, (g1 - g2) / 2 AS e, w1 IS NOT NULL AS v1, w2 IS NOT NULL AS v2, CASE WHEN w1 IS NULL OR w2 IS NULL THEN 0 ELSE (w1 - w2) / 2 END AS y
  FROM pr JOIN ev USING (event_id)),
 s AS (SELECT fold, sum(CASE WHEN v1 THEN e * e ELSE 0 END) AS p, sum(CASE WHEN v2 THEN e * e ELSE 0 END) AS q, sum(CASE WHEN v1 THEN e * y ELSE 0 END) AS b, sum(CASE WHEN v2 THEN -e * y ELSE 0 END) AS c,
  sum(CASE WHEN v1 THEN y * y ELSE 0 END) + sum(CASE WHEN v2 THEN y * y ELSE 0 END) AS yy, count(CASE WHEN v1 THEN 1 END) + count(CASE WHEN v2 THEN 1 END) AS n FROM e GROUP BY 1),
 rr AS (SELECT h.fold, alpha, h.p AS hp, h.q AS hq, h.b AS hb, h.c AS hc, h.yy, h.n, t.p, t.q, t.b, t.c FROM s h JOIN s t ON t.fold <> h.fold, (VALUES (0.001), (10.0)) v(alpha)),
 a AS (SELECT *, q + alpha AS a11, -q AS a12, p + q + alpha AS a22, -p AS a23, p + alpha AS a33, c AS b1, b - c AS b2, -b AS b3 FROM rr),
 d AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * a12 * a33 AS det FROM a),
 w AS (SELECT *, ((a22 * a33 - a23 * a23) * b1 - a12 * a33 * b2 + a12 * a23 * b3) / det AS x1, (-a12 * a33 * b1 + a11 * a33 * b2 - a11 * a23 * b3) / det AS x2,
  (a12 * a23 * b1 - a11 * a23 * b2 + (a11 * a22 - a12 * a12) * b3) / det AS x3 FROM d)
 SELECT fold, CAST(alpha AS DOUBLE) AS alpha, n, round(sqrt((yy - 2 * (x1 * hc + x2 * (hb - hc) - x3 * hb) + x1 * x1 * hq - 2 * x1 * x2 * hq + x2 * x2 * (hp + hq) - 2 * x2 * x3 * hp + x3 * x3 * hp) / n), 6) AS rmse,
  round(x2, 6) AS own FROM w""")
def kernel_folds(spark, d):
    """Kernels of two folds of lots for two penalties, each scored on the other fold."""
    samples = _samples(spark, d).withColumn("fold", F.col("lot_id").cast("long") % 2)
    out = M.evaluate_kernel(samples, [1e-3, 10.0], 1)
    return out.select("fold", "alpha", "n", F.round("rmse", 6).alias("rmse"), F.round(F.col("kernel")[1], 6).alias("own"))


@query(f"WITH {_ANN}, {_DS.format(w=24)} SELECT round(s1, 6) AS s1, round(s2, 6) AS s2, CAST({_RANK} AS BIGINT) AS effective_rank, n AS n_events FROM sv")
def rank_diagnostics(spark, d):
    out = M.rank_diagnostics(_samples(spark, d), 2)
    return out.select(*[F.round(F.get("singular_values", F.lit(k)), 6).alias(f"s{k + 1}") for k in (0, 1)], "effective_rank", "n_events")


@query("""WITH f AS (SELECT o_orderkey AS lot_id, o_custkey AS product, o_totalprice AS g, CAST(o_orderkey % 97 AS DOUBLE) AS h, o_totalprice / 1e5 + o_custkey % 7 + o_orderkey % 3 AS y FROM orders),
 m AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(h) AS mh, stddev_pop(h) AS sh FROM f), x AS (SELECT lot_id, product, (g - mg) / sg AS x1, (h - mh) / sh AS x2, y FROM f, m),
 p AS (SELECT product, sum(x1) AS s1, sum(x2) AS s2, count(*) AS n, sum(y) AS t, sum(x1 * x1) AS q11, sum(x1 * x2) AS q12, sum(x2 * x2) AS q22, sum(x1 * y) AS y1, sum(x2 * y) AS y2 FROM x GROUP BY 1),
 a AS (SELECT sum(q11 - s1 * s1 / (n + 1)) + 1 AS a11, sum(q12 - s1 * s2 / (n + 1)) AS a12, sum(s1 - s1 * n / (n + 1)) AS a13, sum(q22 - s2 * s2 / (n + 1)) + 1 AS a22, sum(s2 - s2 * n / (n + 1)) AS a23,
  sum(n - n * n / (n + 1)) + 1e-12 AS a33, sum(y1 - s1 * t / (n + 1)) AS b1, sum(y2 - s2 * t / (n + 1)) AS b2, sum(t - n * t / (n + 1)) AS b3 FROM p),
 c AS (SELECT *, a22 * a33 - a23 * a23 AS c11, a13 * a23 - a12 * a33 AS c12, a12 * a23 - a13 * a22 AS c13, a11 * a33 - a13 * a13 AS c22, a12 * a13 - a11 * a23 AS c23, a11 * a22 - a12 * a12 AS c33 FROM a),
 w AS (SELECT (c11 * b1 + c12 * b2 + c13 * b3) / det AS w1, (c12 * b1 + c22 * b2 + c23 * b3) / det AS w2, (c13 * b1 + c23 * b2 + c33 * b3) / det AS w3 FROM (SELECT *, a11 * c11 + a12 * c12 + a13 * c13 AS det FROM c))
 SELECT lot_id, round(w1 * x1 + w2 * x2 + w3 + (t - s1 * w1 - s2 * w2 - n * w3) / (n + 1), 6) AS predicted FROM x JOIN p USING (product), w""")
def level_prediction(spark, d):
    f = V.finals(spark, d).withColumn("wet_mean", F.col("os_gap") / 1e5 + F.col("product") % 7 + F.col("lot_id") % 3)
    model = M.fit_level(f, M.available_features(f, ["os_gap", "ds_gap", "absent"]))
    return model.predict(f).select("lot_id", F.round("predicted", 6).alias("predicted"))


# two zones: the best point is inside the box or on one of its four edges
@query(f"""WITH {_DD}, {_WET}, z AS (SELECT lot_id, avg(CASE WHEN zone = 1 THEN wet END) AS z1, avg(CASE WHEN zone = 2 THEN wet END) AS z2 FROM wl GROUP BY 1),
 e AS (SELECT lot_id, coalesce(4 - z1, 0) AS e1, coalesce(4 - z2, 0) AS e2 FROM z), g AS (SELECT lot_id, 2 * (e1 + 0.1 * e2) AS g1, 2 * (0.1 * e1 + e2) AS g2 FROM e),
 c AS (SELECT *, (2.06 * g1 - 0.38 * g2) / (2.06 * 2.06 - 0.38 * 0.38) AS x1, (2.06 * g2 - 0.38 * g1) / (2.06 * 2.06 - 0.38 * 0.38) AS x2 FROM g
  UNION ALL SELECT g.*, b, greatest(-5, least(5, (g2 - 0.38 * b) / 2.06)) FROM g, (VALUES (-5.0), (5.0)) t(b) UNION ALL SELECT g.*, greatest(-5, least(5, (g1 - 0.38 * b) / 2.06)), b FROM g, (VALUES (-5.0), (5.0)) t(b)),
 o AS (SELECT *, 1.03 * x1 * x1 + 0.38 * x1 * x2 + 1.03 * x2 * x2 - g1 * x1 - g2 * x2 AS cost FROM c WHERE x1 BETWEEN -5 AND 5 AND x2 BETWEEN -5 AND 5)
 SELECT lot_id, round(200 + arg_min(x1, cost), 4) AS gap1, round(200 + arg_min(x2, cost), 4) AS gap2 FROM o GROUP BY 1""")
def recommended_gaps(spark, d):
    wide = P.wet_wide(_wet(spark, d), 2).groupBy("lot_id").agg(F.avg("z1").alias("z1"), F.avg("z2").alias("z2"))
    lots = wide.select(
        "lot_id", F.array(F.lit(200.0), F.lit(200.0)).alias("current_gap"), F.array("z1", "z2").alias("current_profile"), F.array(F.lit(4.0), F.lit(4.0)).alias("target_profile"))
    found = M.recommend_gap(lots, M.kernel_matrix(np.array([0.1, 1.0, 0.1]), 2), (100.0, 500.0), 5.0)
    return found.select("lot_id", F.round(F.col("gap")[0], 4).alias("gap1"), F.round(F.col("gap")[1], 4).alias("gap2"))


_FI = "f AS (SELECT o_orderkey AS lot_id, o_custkey AS product, o_orderdate AS worked_at, o_totalprice AS os_gap, CAST(o_orderkey % 97 AS DOUBLE) AS ds_gap FROM orders)"


@query(f"WITH {_FI}, l AS (SELECT lot_id, product, lag(os_gap) OVER w AS os_gap, lag(ds_gap) OVER w AS ds_gap FROM f WINDOW w AS (PARTITION BY product ORDER BY worked_at, lot_id)) SELECT * FROM l WHERE os_gap IS NOT NULL AND ds_gap IS NOT NULL")
def prev_lot_baseline(spark, d):
    return M.prev_lot_baseline(V.finals(spark, d), ["os_gap", "ds_gap"])


@query(f"WITH {_FI}, l AS (SELECT lot_id, product, round(quantile_cont(os_gap, 0.5) OVER w, 6) AS os_gap, quantile_cont(ds_gap, 0.5) OVER w AS ds_gap FROM f WINDOW w AS (PARTITION BY product ORDER BY worked_at, lot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM l WHERE os_gap IS NOT NULL")
def median_baseline(spark, d):
    return M.median_baseline(V.finals(spark, d), ["os_gap", "ds_gap"]).withColumn("os_gap", F.round("os_gap", 6))


@query("WITH r AS (SELECT o_orderkey AS lot_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT lot_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS fold FROM r")
def time_holdout(spark, d):
    return M.time_holdout(V.finals(spark, d), "worked_at", "lot_id", 0.2).select("lot_id", "fold")


_GREEDY = """RECURSIVE s AS (SELECT o_custkey AS product, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, product) AS r FROM s),
 g(r, fold, load) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT), 0, 0, 0, 0] UNION ALL
  SELECT r.r, CAST(list_position(load, list_min(load)) AS BIGINT), list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + r.n ELSE x END) FROM g JOIN r ON r.r = g.r + 1)"""


@query(f"WITH {_GREEDY} SELECT n, CAST(fold - 1 AS INTEGER) AS fold, count(DISTINCT product) AS lots FROM g JOIN r USING (r) GROUP BY 1, 2")
def lot_group_splits(spark, d):
    folds = M.lot_group_splits(V.finals(spark, d), 5, "product")
    return folds.groupBy("n", "fold").agg(F.count_distinct("product").alias("lots"))


_PROFILE = "p AS (SELECT o_custkey AS sample_id, list(o_totalprice / 1e5 ORDER BY o_orderkey) AS wet FROM orders GROUP BY 1)"


def _profiles(spark, d):
    o = V.finals(spark, d).groupBy(F.col("product").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("lot_id", "os_gap"))).alias("a"))
    return o.select("sample_id", F.transform("a", lambda x: x["os_gap"] / 1e5).alias("wet"))


@query(f"WITH {_PROFILE} SELECT round(avg(CASE WHEN len(list_filter(wet, lambda z: abs(z - 2.5) > 2.3)) = 0 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM p")
def hit_rate(spark, d):
    return M.hit_rate(_profiles(spark, d).withColumn("target", F.lit(2.5)).withColumn("tolerance", F.lit(2.3))).select(F.round("hit_rate", 9).alias("hit_rate"))


@query("SELECT o_custkey AS sample_id, round(stddev_pop(o_totalprice / 1e5), 9) AS sigma FROM orders GROUP BY 1")
def cross_width_sigma(spark, d):
    return M.cross_width_sigma(_profiles(spark, d)).withColumn("sigma", F.round("sigma", 9))


# tool usage

_U = """le AS (SELECT 'RX' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS mold_no,
   CASE WHEN o_orderkey % 5 = 0 THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) END AS ev_at,
   CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE CASE o_orderstatus WHEN 'O' THEN '설비' WHEN 'F' THEN '수리실' ELSE '보관함' END END AS location,
   'EQ' || CAST(o_orderkey % 120 AS VARCHAR) AS equipment, o_orderkey AS order_key FROM orders WHERE o_orderkey % 53 <> 0 AND o_orderkey % 59 <> 0),
 ti AS (SELECT 'RX' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS mold_no, 'EQ' || CAST(c_custkey % 100 AS VARCHAR) AS equipment, CAST(c_custkey % 100 AS VARCHAR) AS equipment_code, 'L' || CAST(c_nationkey AS VARCHAR) AS line, c_custkey AS order_key FROM customer WHERE c_custkey % 10 <> 0),
 ei AS (SELECT equipment, arg_max(equipment_code, order_key) AS code, arg_max(line, order_key) AS line FROM ti GROUP BY 1),
 de AS (SELECT mold_no, ev_at, location, equipment, min(order_key) AS order_key FROM le GROUP BY 1, 2, 3, 4),
 pa AS (SELECT *, lead(ev_at) OVER (PARTITION BY mold_no ORDER BY ev_at, order_key) AS ended_at FROM de),
 ru AS (SELECT pa.mold_no, pa.ev_at AS started_at, ended_at, pa.equipment, CASE WHEN ei.equipment IS NOT NULL THEN ei.code ELSE ti.equipment_code END AS code,
   CASE WHEN ei.equipment IS NOT NULL THEN ei.line ELSE ti.line END AS line, ei.equipment IS NULL AS fallback, pa.order_key FROM pa JOIN ti ON pa.mold_no = ti.mold_no LEFT JOIN ei ON pa.equipment = ei.equipment WHERE location = '설비'),
 pr AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_suppkey AS VARCHAR) AS code, CAST(sum(l_quantity) AS BIGINT) AS produced, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS defects FROM lineitem GROUP BY 1, 2),
 da AS (SELECT mold_no, started_at, order_key, code, CAST(CAST(started_at AS DATE) + CAST(k AS INTEGER) AS DATE) AS day FROM (SELECT *, unnest(range(greatest(CAST(ceil(epoch(ended_at - started_at) / 86400.0) AS BIGINT), 1))) AS k FROM ru WHERE ended_at > started_at)),
 pe AS (SELECT mold_no, started_at, order_key, CAST(sum(produced) AS BIGINT) AS produced, CAST(sum(defects) AS BIGINT) AS defects, count(produced) AS days_found, count(*) AS days_expected FROM da LEFT JOIN pr USING (day, code) GROUP BY 1, 2, 3),
 ra AS (SELECT ru.*, pe.produced, pe.defects, pe.days_found, pe.days_expected, CASE WHEN pe.produced <> 0 THEN CAST(pe.defects AS DOUBLE) / pe.produced END AS rate FROM ru LEFT JOIN pe USING (mold_no, started_at, order_key))"""


def _ledger(spark, d):
    return U.clean_ledger(V.ledger(spark, d))


def _tools(spark, d):
    return U.tool_index(V.master(spark, d))[0]


def _runs(spark, d):
    return U.resolve_runs(U.pair_runs(_ledger(spark, d)[0]), _tools(spark, d), U.equipment_index(V.master(spark, d)))


def _rated(spark, d):
    return U.defect_rates(_runs(spark, d), V.production(spark, d))


def _records(spark, d):
    events, tools = _ledger(spark, d)[0], staged(_tools(spark, d), "tools")
    runs = U.resolve_runs(U.pair_runs(events), tools, U.equipment_index(V.master(spark, d)))
    return U.tool_records(tools, U.defect_rates(runs, V.production(spark, d)), U.latest_locations(events))


@query(f"WITH {_U} SELECT mold_no, equipment, equipment_code, line FROM ti")
def tool_index(spark, d):
    return _tools(spark, d).drop("jig_name")


@query(f"WITH {_U} SELECT * FROM ei")
def equipment_index(spark, d):
    return U.equipment_index(V.master(spark, d))


@query(f"WITH {_U} SELECT mold_no, started_at, ended_at, equipment, code, line, fallback, order_key FROM ru")
def usage_runs(spark, d):
    return _runs(spark, d)


@query(f"WITH {_U} SELECT mold_no, started_at, code, day FROM da")
def run_days(spark, d):
    return U.run_days(_runs(spark, d)).select("mold_no", "started_at", "code", "day")


@query(f"WITH {_U} SELECT mold_no, started_at, ended_at, code, produced, defects, days_found, days_expected, round(rate, 9) AS rate FROM ra")
def defect_rate_per_run(spark, d):
    return _rated(spark, d).select("mold_no", "started_at", "ended_at", "code", "produced", "defects", "days_found", "days_expected", F.round("rate", 9).alias("rate"))


@query(f"WITH {_U} SELECT mold_no, arg_max(location, (ev_at, order_key)) AS location FROM le WHERE location <> '' GROUP BY 1")
def latest_locations(spark, d):
    return U.latest_locations(_ledger(spark, d)[0])


_REC = _U + """, lo AS (SELECT mold_no, arg_max(location, (ev_at, order_key)) AS location FROM le WHERE location <> '' GROUP BY 1),
 ag AS (SELECT mold_no, count(*) AS n, CAST(sum(produced) AS BIGINT) AS total_production, arg_max(rate, (started_at, order_key)) FILTER (rate IS NOT NULL) AS latest,
   arg_max(line, (started_at, order_key)) AS line, arg_max(equipment, (started_at, order_key)) AS machine FROM ra GROUP BY 1),
 re AS (SELECT ti.mold_no, CASE location WHEN '설비' THEN 'in_use' WHEN '수리실' THEN 'repair' WHEN '보관함' THEN 'standby' END AS status, n AS total_installs, total_production, round(latest, 9) AS latest_defect_rate,
   CASE WHEN location = '설비' THEN ag.line END AS line, CASE WHEN location = '설비' THEN machine END AS machine FROM ti LEFT JOIN lo USING (mold_no) LEFT JOIN ag USING (mold_no) WHERE location IS NOT NULL OR n IS NOT NULL)"""


@query(f"WITH {_REC} SELECT * FROM re")
def tool_records(spark, d):
    return _records(spark, d).withColumn("latest_defect_rate", F.round("latest_defect_rate", 9))


@query(f"WITH {_REC} SELECT * FROM re WHERE status = 'in_use' AND mold_no LIKE '%RX0001%'")
def list_tools(spark, d):
    return U.list_tools(_records(spark, d), status="in_use", q=" rx0001 ").withColumn("latest_defect_rate", F.round("latest_defect_rate", 9))


@query(f"WITH {_REC} SELECT DISTINCT line, machine FROM re WHERE line IS NOT NULL AND machine IS NOT NULL")
def filter_options(spark, d):
    return U.filter_options(_records(spark, d))


@query(f"""WITH {_U}, x AS (SELECT 'unknown_tool' AS kind, mold_no AS key, count(*) AS n FROM le WHERE mold_no NOT IN (SELECT mold_no FROM ti) GROUP BY 2
 UNION ALL SELECT 'unknown_equipment', equipment, count(*) FROM le WHERE location = '설비' AND mold_no IN (SELECT mold_no FROM ti) AND equipment NOT IN (SELECT equipment FROM ei) GROUP BY 2
 UNION ALL SELECT 'rejected', CASE WHEN o_orderkey % 53 = 0 THEN 'bad sheet name' ELSE 'no id' END, count(*) FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 59 = 0 GROUP BY 2
 UNION ALL SELECT 'bad_sheet', CASE WHEN o_orderkey % 53 = 0 THEN 'Sheet1' ELSE '(빈 이름)' END, count(*) FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 59 = 0 GROUP BY 2
 UNION ALL SELECT 'missing_day', CAST(day AS VARCHAR), 1 FROM (SELECT DISTINCT day FROM da LEFT JOIN pr USING (day, code) WHERE pr.day IS NULL OR produced IS NULL)
 UNION ALL SELECT 'open_run', NULL, count(*) FROM ra WHERE ended_at IS NULL HAVING count(*) > 0
 UNION ALL SELECT 'unmatched_run', NULL, count(*) FROM ra WHERE ended_at > started_at AND coalesce(days_found, 0) = 0 HAVING count(*) > 0) SELECT * FROM x""")
def join_losses(spark, d):
    good, bad = _ledger(spark, d)
    tools, equipment, p = staged(_tools(spark, d), "tools"), U.equipment_index(V.master(spark, d)), V.production(spark, d)
    rated = staged(U.defect_rates(U.resolve_runs(U.pair_runs(good), tools, equipment), p), "rated-runs")
    return U.losses(bad, good, tools, equipment, rated, p)


@query(f"WITH {_U} SELECT mold_no, started_at, row_number() OVER (PARTITION BY mold_no ORDER BY started_at, order_key) AS install_seq, CASE WHEN ended_at IS NULL THEN '가동 중' WHEN coalesce(days_expected, 0) = 0 THEN '—' WHEN days_found >= days_expected THEN days_expected || '일' ELSE days_found || '/' || days_expected || '일' END AS coverage FROM ra")
def run_coverage(spark, d):
    r = U.install_seq(_rated(spark, d))
    return r.select("mold_no", "started_at", F.col("install_seq").cast("long").alias("install_seq"), S.coverage_label("days_found", "days_expected", "ended_at").alias("coverage"))


@query(f"""WITH {_U}, sq AS (SELECT *, row_number() OVER (PARTITION BY mold_no ORDER BY started_at, order_key) AS k FROM ra),
 hi AS (SELECT mold_no, string_agg(k || '/' || equipment || '/' || line || '/' || coalesce(CAST(produced AS VARCHAR), '-'), ',' ORDER BY k) AS runs, arg_max(equipment, k) FILTER (ended_at IS NULL) AS running,
  count(*) AS total_installs, CAST(sum(produced) AS BIGINT) AS total_production, min(started_at) AS first_installed_at FROM sq GROUP BY 1)
 SELECT hi.mold_no, runs, total_installs, total_production, first_installed_at, CASE WHEN c_custkey % 2 = 0 THEN 'iqc' ELSE 'pqc' END || '/L' || c_nationkey || '/' || c_name AS panels, running, CAST(NULL AS VARCHAR) AS design,
  CASE WHEN c_custkey % 4 = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'ok' ELSE 'warn' END ELSE 'ok' END AS installed FROM hi JOIN customer ON hi.mold_no = 'RX' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')""")
def tool_detail(spark, d):
    r = staged(U.install_seq(_rated(spark, d)), "rated-runs")  # read four times
    stage = F.when(F.col("order_key") % 2 == 0, "iqc").otherwise("pqc")
    panels = V.master(spark, d).select(S.normalize_tool("mold_no").alias("mold_no"), stage.alias("stage"), F.col("line").alias("status"), F.col("jig_name").alias("source_file"))
    tools = r.select("mold_no").distinct()
    out = U.tool_detail(tools, r, panels, stages=U.stage_status(tools, _stages(spark, d), r))
    runs = F.array_join(F.transform("history", lambda x: F.concat_ws("/", x["install_seq"].cast("string"), x["equipment"], x["line"], F.coalesce(x["produced"].cast("string"), F.lit("-")))), ",")
    panel = F.array_join(F.transform("panels", lambda x: F.concat_ws("/", x["stage"], x["status"], x["source_file"])), ",")
    more = ["total_installs", "total_production", "first_installed_at", "design"]
    return out.select("mold_no", runs.alias("runs"), panel.alias("panels"), F.col("current.equipment").alias("running"), *more, F.col("stage_status")["install"].alias("installed"))


def _stages(spark, d) -> DataFrame:
    key = F.col("c_custkey") % 4
    stage = F.when(key == 0, "iqc").when(key == 1, "install").when(key == 2, "pqc").otherwise("design")
    source = F.struct(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("file"), F.lit("s").alias("sheet"), F.lit("A1").alias("cell"))
    judged = F.when(F.col("c_custkey") % 5 == 0, "OK")
    item = F.to_json(F.array(F.struct(F.col("c_name").alias("label"), F.col("c_mktsegment").alias("value"), judged.alias("judgment"), source.alias("source"))))
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("RX"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("mold_no"), stage.alias("stage"), F.when(F.col("c_custkey") % 3 == 0, "ok").otherwise("warn").alias("status"),
        item.alias("items_json"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("source_file"), F.when(F.col("c_custkey") % 7 == 0, "late").alias("error"))


# cells

_CE = """pt AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS row_no FROM part)"""


_TEXT = """tx AS (SELECT p_brand AS sheet, row_no, 'A' AS l, p_name AS value FROM pt UNION ALL SELECT p_brand, row_no, 'B', p_type FROM pt UNION ALL SELECT p_brand, row_no, 'C', CAST(p_size AS VARCHAR) FROM pt
 UNION ALL SELECT p_brand, row_no, 'D', CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END FROM pt
 UNION ALL SELECT DISTINCT p_brand, 1, unnest(['A', 'B', 'C']), unnest(['Name', 'Type', 'Size']) FROM part)"""


@query(f"WITH {_CE}, {_TEXT} SELECT sheet, l || row_no AS cell, value, FALSE AS truncated FROM tx WHERE contains(lower(value), 'ring')")
def search_values(spark, d):
    return C.search(V.cells(spark, d), "RING", 1_000_000).drop("source_file")


@query(f"""WITH {_CE}, {_TEXT}, wd AS (SELECT DISTINCT substr(p_name, 1, 6) AS word FROM part UNION SELECT DISTINCT upper(substr(p_type, 1, 2)) FROM part UNION SELECT '7')
 SELECT word, sheet, l || row_no AS cell, value FROM wd JOIN tx ON contains(lower(value), lower(word))""")
def indexed_search(spark, d):
    """Words of the parts' names and types looked up through an index of grams."""
    p = spark.read.parquet(f"{d}/part.parquet")
    words = p.select(F.substring("p_name", 1, 6).alias("word")).union(p.select(F.upper(F.substring("p_type", 1, 2)))).union(spark.range(1).select(F.lit("7")))
    cells, path = V.cells(spark, d), f"{shared_folder(spark)}/millwright/grams-{uuid.uuid4().hex}"
    X.build_index(cells, path, 50)
    return X.search_many(cells, spark.read.parquet(path), words, 50).drop("source_file")


@query("SELECT p_brand AS sheet, round(CAST(sum(p_size) AS DOUBLE) + sum(p_retailprice), 4) AS value, 2 * count(*) AS numeric_count FROM part GROUP BY 1")
def aggregate_values(spark, d):
    return C.aggregate(V.cells(spark, d), "sum").drop("source_file").withColumn("value", F.round("value", 4))


@query("SELECT p_brand AS sheet, 3 AS col_no, count(*) + 1 AS nonnull, count(DISTINCT p_size) + 1 AS n_distinct, count(*) AS n_int, 1 AS n_str FROM part GROUP BY 1")
def column_profile(spark, d):
    p = C.profile(V.cells(spark, d)).where("col_no = 3")
    return p.select("sheet", "col_no", "nonnull", "n_distinct", "n_int", F.col("n_str").cast("int").alias("n_str"))


@query("WITH b AS (SELECT p_brand AS sheet, count(*) AS n FROM part GROUP BY 1) SELECT sheet, 1 AS from_row, 1 AS to_row, 3 AS filled FROM b UNION ALL SELECT sheet, 2, CAST(n + 1 AS INTEGER), 4 FROM b")
def outline_grid(spark, d):
    return C.outline(V.cells(spark, d)).select("sheet", "from_row", "to_row", "filled")


@query("SELECT p_brand AS sheet, 2 AS layout_id FROM part GROUP BY 1")
def pick_layout(spark, d):
    return C.pick_layout(V.cells(spark, d), V.layouts(spark)).select("sheet", F.col("layout_id").cast("int").alias("layout_id"))


@query(f"WITH {_CE} SELECT p_brand AS sheet, CAST(row_no AS INTEGER) AS row_no, p_name AS name, p_type AS type, CAST(p_size AS VARCHAR) AS size, 'Name' AS title FROM pt")
def parse_rows(spark, d):
    c = V.cells(spark, d)
    out = C.parse_rows(c, C.pick_layout(c, V.layouts(spark)), V.layouts(spark))
    return out.select("sheet", "row_no", *[F.col("values")[k].alias(k) for k in ("name", "type", "size", "title")])


@query(f"WITH {_CE}, {_TEXT} SELECT sheet, 'D' AS \"column\", value AS hint FROM tx WHERE l = 'D' AND row_no = 2")
def layout_gaps(spark, d):
    c = V.cells(spark, d)
    return C.layout_gaps(c, C.pick_layout(c, V.layouts(spark)), V.layouts(spark))[0].select("sheet", "column", "hint")


@query("SELECT p_brand AS sheet, '11-' || (count(*) + 1) AS rows FROM part GROUP BY 1")
def layout_row_gaps(spark, d):
    """Rows behind the end of the only table."""
    ends = F.transform("tables", lambda t: t.withField("data_end_row", F.lit(10)))
    c, short = V.cells(spark, d), V.layouts(spark).withColumn("tables", ends)
    return C.layout_gaps(c, C.pick_layout(c, short), short)[1].drop("source_file")


@query(f"""WITH {_CE}, {_TEXT}, w AS (SELECT sheet, row_no, l, value FROM tx UNION ALL SELECT DISTINCT p_brand, 1, 'D', '·' FROM part)
 SELECT sheet, CAST(w.row_no AS INTEGER) AS row_no, w.row_no || chr(9) || string_agg(value, chr(9) ORDER BY l) AS line FROM w GROUP BY sheet, w.row_no UNION ALL SELECT DISTINCT p_brand, 0, chr(9) || 'A' || chr(9) || 'B' || chr(9) || 'C' || chr(9) || 'D' FROM part""")
def format_rows(spark, d):
    return C.format_rows(V.cells(spark, d)).drop("source_file")


# sessions


@query("SELECT conv_id AS session_id, CASE WHEN trim(replace(text, chr(10), ' ')) = '' THEN '새 대화' WHEN length(trim(replace(text, chr(10), ' '))) > 40 THEN substr(trim(replace(text, chr(10), ' ')), 1, 40) || '…' ELSE trim(replace(text, chr(10), ' ')) END AS title FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)")
def session_titles(spark, d):
    return H.titles(V.messages(spark, d))


@query("SELECT conv_id AS session_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def load_history(spark, d):
    h = H.history(V.messages(spark, d))
    return h.select("session_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.size("messages").cast("long").alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'in_use' WHEN 'F' THEN 'repair' ELSE 'standby' END AS status, 'RX' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS tool, o_totalprice AS price, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def scalar_functions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("p")).join(V.ledger_rows(spark, d), F.col("o_orderkey") == F.col("order_key"))
    return o.select("o_orderkey", S.status_from_location("location").alias("status"), S.normalize_tool(F.concat(F.lit(" ##"), F.lower("sheet"))).alias("tool"), S.to_float("p").alias("price"), S.to_int("p").alias("whole"))

"""Forms for long lots and for streams against the plain batch form."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.operators import process_log as P
from millwright.sources import tables as T
from millwright.streaming import files as FS
from millwright.streaming import settling as S

T0 = datetime(2026, 7, 1)
CATALOGUE = [("gap1", "input", "control", 1), ("gap2", "input", "control", 2), ("speed", "input", "control", None)]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "item_id string, io string, role string, zone int")


def signals(spark, seed=3):
    """Changes and means of a lot with half of all rows and of three short ones."""
    rng = np.random.default_rng(seed)
    changes, means = [], []
    for lot, n in (("long", 600), ("a", 200), ("b", 200), ("c", 200)):
        t, v = T0, 18.0
        for k in range(n):
            t += timedelta(seconds=int(rng.choice([30, 60, 120, 121, 600, 4000], p=[0.2, 0.4, 0.2, 0.1, 0.08, 0.02])))
            if rng.random() < 0.25:
                changes.append((lot, str(rng.choice(["gap1", "gap2", "speed"])), t, float(rng.integers(0, 5)), float(rng.integers(5, 9))))
            v += float(rng.choice([0, 0, 0, 0, 0.5, -0.5]))
            means.append((lot, t, None if rng.random() < 0.05 else v))
    c = spark.createDataFrame(sorted(set(changes)), "lot_id string, item_id string, worked_at timestamp, value double, prev_value double").dropDuplicates(["lot_id", "item_id", "worked_at"])
    return c, spark.createDataFrame(means, "lot_id string, worked_at timestamp, wet_mean double")


def settled(c, m, catalogue, minutes):
    events, deltas = P.build_events(c, catalogue, 2, minutes)
    out = P.annotate_settling(events, m, 0.1, 4, 20, minutes)
    return sorted(map(tuple, out.collect()), key=str), sorted(map(tuple, deltas.collect()), key=str)


def plain(c, m):
    """(events with verdicts, event of each change), row by row."""
    changes, means = {}, {}
    for r in c.collect():
        changes.setdefault(r.lot_id, []).append((r.worked_at, r.item_id, r.value - r.prev_value))
    for r in m.collect():
        means.setdefault(r.lot_id, []).append((r.worked_at, r.wet_mean))
    out, of = [], []
    for lot, rows in changes.items():
        sessions = []
        for t, item, delta in sorted(rows):
            if not sessions or t - sessions[-1][-1][0] > timedelta(minutes=2):
                sessions.append([])
            sessions[-1].append((t, item))
            of.append((lot, f"{lot}#{len(sessions)}", t, item, delta))
        g = sorted(means[lot])
        for k, s in enumerate(sessions):
            t, end = s[0][0], None
            for j in range(3, len(g)):
                w = [v for _, v in g[j - 3 : j + 1]]
                if g[j - 3][0] > t and None not in w and np.std(w) <= 0.1:
                    end = g[j][0]
                    break
            end = end if end and end - t <= timedelta(minutes=20) else None
            after = sessions[k + 1][0][0] if k + 1 < len(sessions) else None
            reason = "no_settle" if end is None else "overlapped" if after and after < end else None
            out.append((lot, f"{lot}#{k + 1}", t, len({i for _, i in s}), end, reason is not None, reason))
    return sorted(out, key=str), sorted(of, key=str)


@pytest.mark.parametrize("minutes", [1, 7, 60, 1440, 10_000_000])
def test_pieces_of_any_length(spark, catalogue, minutes):
    c, m = signals(spark)
    got, deltas = settled(c, m, catalogue, minutes)
    want, of = plain(c, m)
    assert got == want
    assert [(d[0], d[1], d[2], d[3], d[5]) for d in deltas] == of
    assert {r[6] for r in got} == {None, "no_settle", "overlapped"}


def test_a_long_lot_is_spread(spark):
    _, m = signals(spark)
    size = {r.lot_id: r["count"] for r in m.groupBy("lot_id").count().collect()}
    piece = m.groupBy("lot_id", P._segment("worked_at", 60).alias("seg")).count().agg(F.max("count")).first()[0]
    assert size["long"] * 2 >= sum(size.values()) and piece * 10 < size["long"]


def test_no_rows(spark, catalogue):
    c, m = signals(spark)
    assert settled(c.where("false"), m, catalogue, 60) == ([], [])
    got, _ = settled(c, m.where("false"), catalogue, 60)
    assert got and {r[6] for r in got} == {"no_settle"}


@pytest.fixture
def rocks(spark):
    spark.conf.set(S.STATE_STORE, S.ROCKS)
    yield
    spark.conf.unset(S.STATE_STORE)


def replay(spark, rows, folder, batches):
    """``rows`` in ``batches`` files, read one file at a time: the settled events."""
    source, sink = f"{folder}/in", f"{folder}/out"
    for k in range(batches):
        rows.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = S.stream_settling(stream, 2, 0.1, 4, 20, "60 minutes").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return query, spark.read.schema(S.OUT).parquet(sink)


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").option("stateVarName", "lot").load(checkpoint).select("key").collect()


def test_stream_gives_the_batch_rows(spark, catalogue, rocks, tmp_path):
    c, m = signals(spark, 5)
    rows = S.signals(c.where("lot_id <> 'long'"), m.where("lot_id <> 'long'"))
    lo, hi = rows.agg(F.min(F.unix_seconds("worked_at")), F.max(F.unix_seconds("worked_at"))).first()
    # three batches by time; one row in five comes up to 50 minutes late
    at = F.unix_seconds("worked_at") + F.when(F.hash("worked_at", "lot_id") % 5 == 0, 3000).otherwise(0)
    batch = F.least(F.floor((at - lo) * 3 / (hi - lo + 1)), F.lit(2))
    end = spark.createDataFrame([("end", datetime(2027, 1, 1), 1, None, None, 3), ("end", datetime(2027, 1, 2), 1, None, None, 4)], "lot_id string, worked_at timestamp, kind int, item_id string, wet_mean double, batch long")
    query, got = replay(spark, rows.withColumn("batch", batch).unionByName(end), str(tmp_path), 5)
    want, _ = plain(c.where("lot_id <> 'long'"), m)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert query.lastProgress["stateOperators"][0]["customMetrics"] is not None
    left = {s["lot_id"] for s in map(lambda r: r["key"].asDict(), state_rows(spark, f"{tmp_path}/state"))}
    assert left == {"end"}  # the other lots' state went at the end of their idle time
    assert sum(p["numRowsDroppedByWatermark"] for r in query.recentProgress for p in r["stateOperators"]) == 0


def test_lot_state_is_small():
    lot = S.Lot()
    for k in range(10_000):
        lot.take(k * 60_000_000, S.CHANGE if k % 50 == 0 else S.MEAN, "i", float(k), 0, 0.1, 5)
        lot.done(k * 60_000_000, 0, 30 * 60_000_000)
    assert len(lot.events) <= 2 and len(lot.trail) == 5 and not lot.waiting
    assert lot.wake(0, 60, 500) == lot.seen + 501


# files and stores


def texts(files):
    return {"lines": files.select("path", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")}


class Broken(Exception):
    pass


@pytest.mark.parametrize("where", ["before", "between", "after"])
def test_a_replayed_batch_is_published_once(spark, tmp_path, where):
    for k in range(7):
        path = tmp_path / "in" / ("a" if k % 2 else "b") / f"{k}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"x{k}\ny{k}\n")
    (tmp_path / "in/a/~$9.txt").write_text("lock")
    (tmp_path / "in/c").mkdir()
    (tmp_path / "in/c/8.txt").write_text("no kind")
    (tmp_path / "in/a/deep").mkdir()
    (tmp_path / "in/a/deep/8.txt").write_text("too deep")
    store, left = T.Store(spark, f"{tmp_path}/store"), [1]

    class Fragile(T.Store):
        def _create(self, number, manifest):
            if number == 2 and left and where == "between":
                left.pop()
                raise Broken
            done = super()._create(number, manifest)
            if number == 2 and left and where == "after":
                left.pop()
                raise Broken
            return done

    def rows(files):
        if where == "before" and left and store.version() == 1:
            left.pop()
            raise Broken
        return texts(files)

    def run():
        files = FS.stream_files(spark, f"{tmp_path}/in", {"a": "one", "b": "two"}, {"one", "two"}, ("txt",), per_batch=3)
        FS.ingest_files(files, Fragile(spark, f"{tmp_path}/store"), f"{tmp_path}/cp", rows).awaitTermination()

    with pytest.raises(Exception, match="Broken"):
        run()
    run()
    assert not left
    got = sorted(r.line for r in store.load("lines").collect())
    assert got == sorted(f"{c}{k}" for k in range(7) for c in "xy")
    files = store.load("files").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.kind, r.content_hash) for r in files) == [(f"{k}.txt", "one" if k % 2 else "two", hashlib.sha256(f"x{k}\ny{k}\n".encode()).hexdigest()) for k in range(7)]
    assert store.version() in (3, 4)  # ten files in threes; a batch of files without a kind publishes nothing
    version = store.version()
    run()
    assert store.version() == version and store.load("files").count() == 7  # nothing new
    (tmp_path / "in/a/10.txt").write_text("z\n")
    run()
    assert store.version() == version + 1 and store.load("lines").count() == 15


def test_two_publishers(spark, tmp_path):
    one, two = T.Store(spark, str(tmp_path)), T.Store(spark, str(tmp_path))
    row = lambda v: spark.createDataFrame([(v,)], "v string")

    class Slow(T.Store):
        def _create(self, number, manifest):
            if number == 1:
                two.replace_all({"t": row("two"), "u": row("u")})  # takes the number meanwhile
            return super()._create(number, manifest)

    assert Slow(spark, str(tmp_path)).publish({"t": row("slow")}, append=True) == 2
    assert sorted(r.v for r in one.load("t").collect()) == ["slow", "two"] and one.load("u").count() == 1
    with pytest.raises(T.Conflict):
        one.replace_all({"t": row("x")}, base=1)
    assert one.version() == 2 and one.load("t").count() == 2
    assert one.replace_all({"t": row("y")}, base=2) == 3 and not one.has("u")


def test_vacuum(spark, tmp_path):
    store = T.Store(spark, str(tmp_path))
    for k in range(3):
        store.publish({"t": spark.range(k + 1)}, append=k == 2)
    (tmp_path / "data/broken").mkdir()
    folders = lambda: {p.name for p in (tmp_path / "data").iterdir()}
    assert len(folders()) == 4
    gone = store.vacuum(keep=1)
    assert len(gone) == 1 and "broken" not in gone and store.load("t").count() == 5 and store.version() == 3
    assert store.vacuum(keep=1, orphan_hours=-1) == ["broken"] and store.load("t").count() == 5


def test_tables_laid_out_for_their_readers(spark, tmp_path):
    store = T.Store(spark, str(tmp_path))
    tools = spark.range(500).selectExpr("concat('RX', id) mold_no", "id n")
    runs = spark.range(3000).selectExpr("concat('RX', id % 400) mold_no", "id started")
    layout = {"records": (8, "mold_no"), "runs": (8, "mold_no")}
    store.replace_all({"records": tools, "runs": runs}, buckets=layout)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = T.Store(spark, str(tmp_path))
        joined = again.load("records").join(again.load("runs"), "mold_no").groupBy("mold_no").agg(F.count("started").alias("n"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, tools.join(runs, "mold_no").groupBy("mold_no").agg(F.count("started")).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for part in (tmp_path / "data").glob("*/runs/*.parquet"):
        ids = [r[0] for r in spark.read.parquet(str(part)).collect()]
        assert ids == sorted(ids)
    store.publish({"runs": runs}, append=True)  # further parts end the layout, not the rows
    assert store.load("runs").count() == 6000 and store.load("records").count() == 500

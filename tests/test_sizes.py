"""What must not grow with the input: joins of two large tables, passes over them, shares of one task."""

import re
from datetime import date, datetime

import pandas as pd
from pyspark.sql import functions as F

from millwright.functions import scalars as S
from millwright.operators import cells as C
from millwright.operators import usage as U
from millwright.plans import views as V
from millwright.streaming import settling as ST


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def runs_and_production(spark):
    runs = spark.range(40).select(
        F.concat(F.lit("RX"), F.col("id").cast("string")).alias("mold_no"), F.lit(datetime(2024, 1, 1)).alias("started_at"), F.lit(datetime(2024, 5, 1)).alias("ended_at"),
        (F.col("id") % 3).cast("string").alias("code"), F.col("id").alias("order_key"))
    production = spark.range(3000).select(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 100).cast("int")).alias("day"), (F.col("id") / 100).cast("int").cast("string").alias("code"), F.lit(2).cast("long").alias("produced"), F.lit(1).cast("long").alias("defects"))
    return runs, production


def test_daily_rows_are_not_broadcast_whole(spark):
    """production_runs: tables that look small by their files were sent to the driver whole."""
    runs, production = runs_and_production(spark)
    lists = U.daily_lists(runs, production)
    assert "SortMergeJoin [code" in physical(lists) and "BroadcastHashJoin [day" not in physical(lists)
    got = {r.mold_no: r.defects_json for r in lists.collect()}
    assert len(got) == 40 and all(x.count('"day"') == 100 and x.startswith('[{"day":"2024-01-01","produced":2,"defects":1}') for x in got.values())


def test_one_pass_reads_the_ledger(spark, tmp_path):
    """tool_records, list_tools, tool_detail, join_losses: the ledger's times were read anew for every use."""
    rows = [("RX0001", "2024-01-01", "설비", "EQ1", 1), ("RX0001", "2024-01-03", "수리실", None, 2), ("x", "2024-01-03", "설비", None, 3)]
    good, bad = U.clean_ledger(spark.createDataFrame(rows, "sheet string, event_at string, location string, equipment string, order_key long"))
    assert all("try_to_timestamp" not in plan(df) and "gettimestamp" not in plan(df) for df in (good, bad))
    assert good.count() == 2 and [r.reason for r in bad.collect()] == ["bad sheet name"]


def test_production_of_other_codes_is_not_summed_up(spark):
    """tool_records and its kin: all production rows were sorted and summed, though runs name few codes."""
    runs, production = runs_and_production(spark)
    seen, staged = [], U.staged
    try:
        U.staged = lambda df, name: seen.append((name, out := staged(df, name))) or out
        rated = U.defect_rates(runs.withColumn("equipment", F.lit("E")), production)
    finally:
        U.staged = staged
    assert {r.produced for r in rated.collect()} == {200}
    assert max(df.count() for name, df in seen if name.startswith("production")) <= 3 * 100 + 2 * 3


CELL = "source_file string, kind string, sheet string, row_no int, col_no int, cell_type string, text string, num double, ts timestamp, bool boolean"


def test_cells_are_not_broadcast(spark, tmp_path):
    """parse_rows, layout_row_gaps, indexed_search: cells looked small by their files and were sent to the driver whole."""
    rows = [("f", "catalog", "s", r, c, "str", f"{n} {r}" if r > 1 else n, None, None, None) for r in range(1, 30) for c, n in ((1, "Name"), (2, "Type"), (3, "Size"))]
    spark.createDataFrame(rows, CELL).write.parquet(f"{tmp_path}/cells")
    cells, layouts = spark.read.parquet(f"{tmp_path}/cells"), V.layouts(spark)
    picked = C.pick_layout(cells, layouts)
    parsed, gaps = C.parse_rows(cells, picked, layouts), C.layout_gaps(cells, picked, layouts)[1]
    for df in (parsed, gaps):
        assert not re.search(r"BroadcastHashJoin \[source_file#\d+, sheet#\d+, row_no|BroadcastHashJoin \[kind.*BuildLeft", physical(df))
    assert parsed.count() == 28 and gaps.count() == 0


def test_production_is_read_once(spark):
    """F2, assembled_summary: rows were read anew for each result and filter, every day through the time formats."""
    days = ["2024-1-2", "2024.1-2", "9월 2024.02.30", "작업 2024/1/3~2024/1/4", "x", None]
    rows = spark.createDataFrame([(d, " c ", n, "1", 1) for d in days for n in ("7", " 1,200 ", "x")], "run_date string, equipment_code string, produced string, defects string, order_key int")
    by_day, unreadable = U.production_index(rows)
    assert sorted((str(r.day), r.code, r.defects) for r in by_day.collect()) == [("2024-01-02", "c", 1), ("2024-01-03", "c", 1)]
    assert unreadable.count() == 14
    for df in (by_day, unreadable):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan.lower() and "rlike" not in plan.lower()
    assert "timestamp" not in rows.select(S.run_date("run_date"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_lot_costs_few_calls_of_its_handle(spark):
    """F3, settling_stream: each visit of a lot listed its timers, deleted them and asked for its state twice."""
    calls, timers, held = [], set(), []

    class Handle:
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                {"registerTimer": timers.add, "deleteTimer": timers.remove}[name](*args)

            return call

    class State:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            held.append(value)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    own = ST.Settling(60_000_000, 0.1, 2, 600_000_000, 6_000_000_000)
    own.handle, own.state = Handle(), State()
    rows = pd.DataFrame({"micros": [0, 30_000_000, 90_000_000, 95_000_000], "kind": [0, 1, 1, 1], "item_id": ["a", None, None, None], "wet_mean": [None, 1.0, 1.0, 1.0]})
    assert not list(own.handleInputRows(("l",), iter([rows]), At(-1)))
    assert calls == ["get", "registerTimer"] and timers == {0}
    calls.clear()
    timers.clear()  # Spark takes a timer that ran
    (out,) = own.handleExpiredTimer(("l",), At(95_000), At(0))
    assert list(out["event_id"]) == ["l#1"] and out["settled_at"][0] == pd.Timestamp(90, unit="s")
    assert calls == ["get", "registerTimer"] and timers == {6_095_001}
    calls.clear()
    assert not list(own.handleInputRows(("l",), iter([rows.tail(1).assign(micros=96_000_000)]), At(95_000)))
    assert calls == ["get", "registerTimer", "deleteTimer"] and timers == {96_000}

"""Literal cases of tool usage, cells, scalars, sources and sessions."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millwright.functions import scalars as S
from millwright.operators import cells as C
from millwright.operators import sessions as H
from millwright.operators import usage as U
from millwright.plans import views as V
from millwright.sources import tables as T

MASTER = "mold_no string, jig_name string, equipment string, equipment_code string, line string, order_key long"
LEDGER = "sheet string, event_at string, location string, equipment string, order_key long"


def one(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f("v")).collect()]


def test_scalars(spark):
    assert one(spark, S.to_float, ["8,412", "0.8%", "측정불가", None, "1d", " 12 ", "1e3"]) == [8412, pytest.approx(0.008), None, None, None, 12, 1000]
    assert one(spark, S.to_int, ["-1.9", "x"]) == [-1, None]
    assert one(spark, S.normalize_tool, ["#RX41194", " rx28312 ", "소계", "", "-", "##a1"]) == ["RX41194", "RX28312", None, None, None, "A1"]
    assert one(spark, S.is_tool_name, ["#RX41194", "Sheet1", "RX1", None]) == [True, False, False, False]
    assert one(spark, S.normalize_status, ["사용 중", "폐기됨", "?"]) == ["in_use", "retired", None]
    assert one(spark, S.status_from_location, ["설비", "외부 수리실", "불용", "어디", None]) == ["in_use", "repair", "retired", "standby", None]
    assert one(spark, S.to_datetime, ["2026-07-01T07:00:00", "2026-7-1 7:05", "2026.07.01", "2026-07-01T07:00", "x"]) == [datetime(2026, 7, 1, 7), datetime(2026, 7, 1, 7, 5), datetime(2026, 7, 1), None, None]
    assert one(spark, S.run_date, ["2026.07.01-2026.07.01", "2026.07-08"]) == [date(2026, 7, 1), None]
    assert one(spark, S.column_letters, [1, 26, 27, 702, 703, 18278], "int") == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert one(spark, S.a1_column, ["A", "Z", "aa", "ZZZ"]) == [1, 26, 27, 18278]
    assert [tuple(r) if r else r for r in one(spark, S.a1_row_col, ["$B$3", "x"])] == [(3, 2), None]
    assert one(spark, S.title, ["a\nb", "x" * 41, "  "]) == ["a b", "x" * 40 + "…", "새 대화"]
    assert one(spark, S.role, ["human", "ai", "system"]) == ["user", "assistant", "system"]
    assert one(spark, S.normalize_text, ["  A  b ", None]) == ["a b", ""]
    rows = [("float", None, 1.0, None, None), ("float", None, 28312.0, None, None), ("float", None, 1.5, None, None), ("int", None, 0.0, None, None), ("str", "  ", None, None, None), ("bool", None, None, None, True), ("datetime", None, None, datetime(2026, 7, 1, 7), None)]
    df = spark.createDataFrame(rows, "cell_type string, text string, num double, ts timestamp, bool boolean")
    assert [r[0] for r in df.select(C.cell_text()).collect()] == ["1", "28312", "1.5", "0", None, "TRUE", "2026-07-01T07:00:00"]
    cov = spark.createDataFrame([(4, 4, "x"), (3, 4, "x"), (0, None, None), (0, 0, "x")], "c int, e int, t string")
    assert [r[0] for r in cov.select(S.coverage_label("c", "e", "t")).collect()] == ["4일", "3/4일", "가동 중", "—"]


def runs(spark, events, master=None):
    master = master or [("RX11111", "a", "EQ1", "C1", "L1", 1), ("RX22222", "b", "EQ2", "C2", "L2", 2)]
    m = spark.createDataFrame(master, MASTER)
    good, bad = U.clean_ledger(spark.createDataFrame([(*e, k) for k, e in enumerate(events)], LEDGER))
    tools = U.tool_index(m)[0]
    return U.resolve_runs(U.pair_runs(good), tools, U.equipment_index(m)), good, bad, tools, U.equipment_index(m)


def test_master(spark):
    m = spark.createDataFrame([("#rx11111", "a", "E", "C1", "L", 1), ("RX11111", "b", "E", "C2", "L", 2), (None, "c", "E", "C", "L", 3), ("소계", "d", "E", "C", "L", 4)], MASTER)
    kept, dropped = U.tool_index(m)
    assert [(r.mold_no, r.equipment_code) for r in kept.collect()] == [("RX11111", "C2")] and dropped.count() == 2


def test_runs(spark):
    ev = [("RX11111", "2026-07-05 07:00:00", "보관함", None), ("RX11111", "2026-07-01 07:00:00", "설비", "EQ1"), ("RX22222", "2026-07-02 07:00:00", "설비", "EQ9"), ("RX11111", "2026-07-01 07:00:00", "설비", "EQ1"), ("RX77777", "2026-07-01 07:00:00", "설비", "EQ7"), ("Sheet", "2026-07-01 07:00:00", "설비", "EQ1"), ("RX11111", "?", "설비", "EQ1")]
    got, good, bad, tools, equipment = runs(spark, ev)
    assert sorted((r.mold_no, str(r.started_at), str(r.ended_at), r.code, r.fallback) for r in got.collect()) == [
        ("RX11111", "2026-07-01 07:00:00", "2026-07-05 07:00:00", "C1", False), ("RX22222", "2026-07-02 07:00:00", "None", "C2", True)]
    production = spark.createDataFrame([(date(2026, 7, 1), "C1", 10000, 300), (date(2026, 7, 2), "C1", 1000, 10)], "day date, code string, produced long, defects long")
    rated = U.defect_rates(got, production)
    r = rated.where("mold_no = 'RX11111'").first()
    assert (r.produced, r.defects, r.days_found, r.days_expected) == (11000, 310, 2, 4) and r.rate == pytest.approx(310 / 11000)
    lost = {(r.kind, r.key): r.n for r in U.losses(bad, good, tools, equipment, rated, production).collect()}
    assert lost == {("rejected", "bad sheet name"): 1, ("bad_sheet", "Sheet"): 1, ("rejected", "bad time"): 1, ("unknown_tool", "RX77777"): 1, ("unknown_equipment", "EQ9"): 1, ("missing_day", "2026-07-03"): 1, ("missing_day", "2026-07-04"): 1, ("open_run", None): 1}
    rec = {r.mold_no: r for r in U.tool_records(tools, rated, U.latest_locations(good)).collect()}
    assert (rec["RX11111"].status, rec["RX11111"].total_installs, rec["RX22222"].status, rec["RX22222"].total_production) == ("standby", 1, "in_use", None)


@pytest.mark.parametrize("end, days", [("2026-07-05 07:00:00", 4), ("2026-07-02 07:30:00", 2), ("2026-07-01 19:00:00", 1), ("2026-07-01 07:00:00", 0), (None, 0)])
def test_days(spark, end, days):
    df = spark.createDataFrame([("RX1", "2026-07-01 07:00:00", end)], "mold_no string, s string, e string").selectExpr("mold_no", "cast(s as timestamp) started_at", "cast(e as timestamp) ended_at")
    assert U.run_days(df).count() == days


def test_inspection_and_panels(spark):
    rows = spark.createDataFrame([("rx1", 1, [("note", 1, "n"), ("gap", 2, "g"), ("punch", 3, "p"), ("die", 4, None)]), (None, 2, [("gap", 1, "g")]), ("RX9", 3, [("gap", 1, "g")])], "mold_no string, order_key long, values array<struct<field:string,position:int,value:string>>")
    items = U.inspection_items(rows)
    assert [(r.item, r.value) for r in items.where("mold_no = 'RX1'").orderBy("position").collect()] == [("punch", "p"), ("gap", "g"), ("note", "n")]
    good, orphans = U.attach_inspection(items, spark.createDataFrame([("RX1",)], "mold_no string"))
    assert good.count() == 3 and [r[0] for r in orphans.collect()] == ["RX9"]
    rec = spark.createDataFrame([("RX1",), ("RX2",)], "mold_no string")
    stages = spark.createDataFrame([("RX2", "iqc", "ok", '[{"label":"a","value":"1"}]', "")], "mold_no string, stage string, status string, items_json string, source_file string")
    st = {r.mold_no: r.stage_status for r in U.stage_status(rec, stages, rec.where("mold_no = 'RX1'")).collect()}
    assert st["RX1"]["install"] == "ok" and st["RX2"] == {"design": "missing", "install": "missing", "iqc": "ok", "pqc": "missing", "ai_recheck": "missing"}
    p = U.stage_panels(stages).first()
    assert p["items"][0].label == "a" and p.source_file is None
    daily = spark.createDataFrame([("RX1", 1, "2026-07-01 00:00:00", "2026-07-03 00:00:00", '[{"day":"2026-07-01","produced":5,"defects":1}]')], "mold_no string, install_seq int, s string, e string, defects_json string").selectExpr("mold_no", "install_seq", "cast(s as timestamp) started_at", "cast(e as timestamp) ended_at", "defects_json", "'L1' line", "'E1' equipment", "0.2D rate")
    r = U.production_runs(daily).first()
    assert (r.produced, r.defects, r.days_covered, r.days_expected, r.line, r.machine, r.rate) == (5, 1, 1, 2, "L1", "E1", 0.2)
    none = U.production_runs(daily.withColumn("ended_at", F.lit(None).cast("timestamp")).withColumn("defects_json", F.element_at(F.array(F.lit(None).cast("string"), F.lit("[]")), F.col("install_seq")))).first()
    assert (none.produced, none.defects, none.days_covered, none.days_expected) == (None, None, 0, 0)
    labels = spark.createDataFrame([("RX1", "t", "b", 1, 5), ("RX1", "t", "a", 2, 6), ("RX2", "t", "a", 3, 7)], "mold_no string, started_at string, label string, order_key long, n long")
    assert U.defect_columns(labels).columns == ["mold_no", "started_at", "b", "a"]
    many = spark.range(300).selectExpr("'RX1' mold_no", "'t' started_at", "concat('d', id) label", "id order_key", "id n")
    assert len(U.defect_columns(many).columns) == 302
    one = json.loads(U.inspection_json(good.withColumn("source_file", F.lit("f.xlsx"))).first().items_json)[0]
    assert one == {"label": "punch", "value": "p", "judgment": None, "source": {"file": "f.xlsx", "sheet": None, "cell": None}}


def test_two_runs_at_one_time(spark):
    """Two machine events of a tool at one time are two runs: the first ends at once and has no days."""
    at = lambda s: datetime.fromisoformat(f"2026-07-{s}")
    rows = [("RX1", at("01 07:00:00"), at("01 07:00:00"), "E1", "C1", 1), ("RX1", at("01 07:00:00"), at("03 07:00:00"), "E2", "C2", 2), ("RX2", at("02 00:00:00"), None, "E1", "C1", 3), ("RX3", at("05 00:00:00"), at("09 00:00:00"), "E1", "C1", 4), ("RX4", at("01 00:00:00"), at("09 00:00:00"), "E1", None, 5), ("RX5", at("02 12:00:00"), at("04 13:00:00"), "E2", "C2", 6)]
    runs = spark.createDataFrame(rows, "mold_no string, started_at timestamp, ended_at timestamp, equipment string, code string, order_key long").withColumn("line", F.lit("L"))
    production = spark.createDataFrame([(date(2026, 7, d), c, 100 * d, d) for c in ("C1", "C2") for d in (1, 2, 4)], "day date, code string, produced long, defects long")
    rated = U.defect_rates(runs, production)
    got = {r.order_key: (r.produced, r.defects, r.days_found, r.days_expected) for r in rated.collect()}
    assert got == {1: (None, None, None, None), 2: (300, 3, 2, 2), 3: (None, None, None, None), 4: (None, None, 0, 4), 5: (None, None, 0, 8), 6: (600, 6, 2, 3)}
    days = {r.order_key: [(d["day"], d["produced"]) for d in json.loads(r.defects_json)] for r in U.daily_lists(runs, production).collect()}
    assert days == {2: [("2026-07-01", 100), ("2026-07-02", 200)], 6: [("2026-07-02", 200), ("2026-07-04", 400)]}
    want = {(r.code, r.day) for r in U.run_days(runs.where("code is not null")).collect()} - {(r.code, r.day) for r in production.collect()}
    assert sorted(r.day for r in U.missing_days(runs, production).collect()) == sorted({d for _, d in want})
    records = U.tool_records(runs.select("mold_no").distinct(), rated, spark.createDataFrame([], "mold_no string, location string"))
    assert {r.mold_no: r.total_production for r in records.collect()}["RX1"] == 300


def test_white_space_and_numbers(spark):
    from millwright.functions import scalars as S

    df = spark.createDataFrame([("\t#rx28312\n", "1d", "B3"), ("\u3000RX1 ", " 1,234.5%\t", "$A$1")], "a string, b string, c string")
    got = df.select(S.normalize_tool("a").alias("a"), S.to_float("b").alias("b"), S.plain_number("b").alias("p"), S.a1_offset("c", 2, 26).alias("o"), S.a1_offset("c", -1, 0).alias("z")).collect()
    assert [tuple(r) for r in got] == [("RX28312", None, None, "AB5", "B2"), ("RX1", 12.345, None, "AA3", None)]


def test_unclean_ledger(spark):
    """An event without a place ends a run; cells are stripped; of two runs at one time the later row is the last."""
    ev = [
        ("RX11111", "2026-07-01 07:00:00", "설비 ", " EQ1"), ("RX11111", "2026-07-03 07:00:00", "  ", None), ("RX11111", "2026-07-09 07:00:00", "보관함", None),
        ("RX22222", "2026-07-02 07:00:00", "설비", "EQ1"), ("RX22222", "2026-07-02 07:00:00", "\u3000설비", "EQ2\t"), ("RX22222", "2026-07-02 07:00:00", "설비", "EQ2"),
        ("Sheet1", "2026-07-02 07:00:00", "설비", "EQ2"), ("  ", "2026-07-02 07:00:00", "설비", "EQ2"), (None, "2026-07-02 07:00:00", "설비", "EQ2"),
    ]
    got, good, bad, tools, equipment = runs(spark, ev, [("RX11111", "a", " EQ1 ", "C1 ", "L1", 1), ("RX22222", "b", "EQ2", "C2", "L2", 2)])
    assert sorted((r.mold_no, str(r.started_at), str(r.ended_at), r.equipment, r.code, r.fallback) for r in got.collect()) == [
        ("RX11111", "2026-07-01 07:00:00", "2026-07-03 07:00:00", "EQ1", "C1", False),
        ("RX22222", "2026-07-02 07:00:00", "2026-07-02 07:00:00", "EQ1", "C1", False), ("RX22222", "2026-07-02 07:00:00", "None", "EQ2", "C2", False)]
    production = spark.createDataFrame([(date(2026, 7, d), "C1", 100, 1) for d in range(1, 10)], "day date, code string, produced long, defects long")
    rated = U.defect_rates(got, production)
    assert {(r.mold_no, r.produced) for r in rated.collect() if r.produced} == {("RX11111", 200)}
    rec = {r.mold_no: r for r in U.tool_records(tools, rated, U.latest_locations(good)).collect()}
    assert (rec["RX22222"].line, rec["RX22222"].machine) == ("L2", "EQ2") and rec["RX11111"].status == "standby"
    lost = {(r.kind, r.key): r.n for r in U.losses(bad, good, tools, equipment, rated, production).collect()}
    assert lost == {("rejected", "bad sheet name"): 1, ("rejected", "no id"): 2, ("bad_sheet", "Sheet1"): 1, ("bad_sheet", "(빈 이름)"): 2, ("open_run", None): 1}


@pytest.mark.parametrize("piece_days", [1, 3, 366])
def test_running_totals_in_pieces(spark, piece_days):
    """Sums of every run against a join by day, with stray days a century before and repeated runs."""
    import random

    rng = random.Random(7)
    at = lambda: datetime(2026, 7, 1 + rng.randrange(28), rng.randrange(24))
    rows = [(f"RX{k % 9}", *sorted((at(), at())), rng.choice(["C1", "C2", "C3", None]), k) for k in range(80)]
    rows += [(*rows[0][:4], 0), ("RX1", at(), None, "C1", 100)]
    runs = spark.createDataFrame(rows, "mold_no string, started_at timestamp, ended_at timestamp, code string, order_key long")
    made = {(date(2026, 7, d), c): (rng.randrange(50), rng.randrange(5)) for d in range(1, 32) for c in ("C1", "C2") if rng.random() < 0.7}
    made[date(1900, 1, 1), "C1"] = (9, 9)
    production = spark.createDataFrame([(*k, *v) for k, v in made.items()], "day date, code string, produced long, defects long")
    days = {}
    for r in U.run_days(runs.dropDuplicates()).collect():
        days.setdefault((r.mold_no, r.started_at, r.order_key), []).append(made.get((r.day, r.code)))
    got = U.defect_rates(runs, production, piece_days).collect()
    assert len(got) == len(rows)
    for r in got:
        own = days.get((r.mold_no, r.started_at, r.order_key), [])
        found = [d for d in own if d]
        want = (sum(d[0] for d in found), sum(d[1] for d in found)) if found else (None, None)
        assert (r.produced, r.defects, r.days_found or 0, r.days_expected or 0) == (*want, len(found), len(own))


def test_cells_as_text_and_times(spark):
    """Numbers as Python writes them, whatever their size; times with microseconds; plain dates."""
    values = [12345678.5, 0.0005, 5e-05, 1.25e-7, 123456789012.25, -0.00025, 1e15 + 0.5, 0.1, 1e20, -3.0]
    df = spark.createDataFrame([("float", v) for v in values], "k string, v double")
    none = F.lit(None)
    got = [r[0] for r in df.select(S.cell_to_text("k", none.cast("string"), "v", none.cast("timestamp"), none.cast("boolean"))).collect()]
    assert got == [str(int(v)) if v == int(v) else str(v) for v in values]
    times = spark.createDataFrame([("datetime", datetime(2026, 7, 1, 7, 0, 0, 1200)), ("datetime", datetime(2026, 7, 1)), ("date", datetime(2026, 7, 1))], "k string, t timestamp")
    got = [r[0] for r in times.select(S.cell_to_text("k", none.cast("string"), none.cast("double"), "t", none.cast("boolean"))).collect()]
    assert got == ["2026-07-01T07:00:00.001200", "2026-07-01T00:00:00", "2026-07-01"]
    assert one(spark, S.normalize_status, ["사용\u3000중", "수\u2003리 중"]) == ["in_use", "repair"]
    assert one(spark, S.status_from_location, ["설\u3000비", "\u3000"]) == ["in_use", None]
    texts = ["2026-07-01 7:5:09", "2026.7.1 7:05", "2026/7/1", "2026/7/1 7:05", "2026-13-01", "2026-7-1 25:00", "20260701", " 2026-07-01\u3000", "2026-07-01 07:00:00.5"]
    assert one(spark, S.to_datetime, texts) == [datetime(2026, 7, 1, 7, 5, 9), datetime(2026, 7, 1, 7, 5), datetime(2026, 7, 1), None, None, None, None, datetime(2026, 7, 1), None]
    assert one(spark, S.log_time, ["20260701", "20260701070500", "7/1/2026 7:05", "2026-07-01 07:00:00.250", "2026-07-01T07:00:00+09:00"]) == [
        datetime(2026, 7, 1), datetime(2026, 7, 1, 7, 5), datetime(2026, 7, 1, 7, 5), datetime(2026, 7, 1, 7, 0, 0, 250000), datetime(2026, 6, 30, 22)]


def grid(spark, rows, top=1, left=1, name="f"):
    out = []
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if v is not None:
                kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "datetime" if isinstance(v, datetime) else "str"
                out.append((name, "k", "s", top + r, left + c, kind, v if kind == "str" else None, float(v) if kind in ("int", "float") else None, v if kind == "datetime" else None, v if kind == "bool" else None))
    return spark.createDataFrame(out, "source_file string, kind string, sheet string, row_no int, col_no int, cell_type string, text string, num double, ts timestamp, bool boolean")


def test_cells(spark):
    g = grid(spark, [["a", "소계"], [1, 2.5], [True, None], ["x", datetime(2026, 1, 1)]])
    assert [r.cell for r in C.search(g, "소계").collect()] == ["B1"]
    assert C.aggregate(grid(spark, [[1, 2, "소계", None, 3.0]]), "sum").first().value == 6.0
    with pytest.raises(ValueError):
        C.aggregate(g, "median")
    p = C.profile(grid(spark, [[1], [2], [None], ["x"], [datetime(2026, 1, 1)]])).first()
    assert (p["count"], p.nulls, p.nonnull, p.n_int, p.n_datetime) == (5, 1, 4, 2, 1)
    o = C.outline(grid(spark, [["h", "h"], [1, "a"], [2, "b"], [None, None], [3, "c"]])).orderBy("line").collect()
    assert [(r.from_row, r.to_row, r.filled) for r in o] == [(1, 1, 2), (2, 3, 2), (4, 4, 0), (5, 5, 2)]
    assert [r.line for r in C.format_rows(g).orderBy("row_no").collect()] == ["\tA\tB", "1\ta\t소계", "2\t1\t2.5", "3\tTRUE\t·", "4\tx\t2026-01-01T00:00:00"]
    wide = C.format_rows(grid(spark, [[1] + [None] * 748 + [2]])).orderBy("row_no").collect()
    assert wide[0].line.endswith("\tABU\tABV") and wide[1].line.split("\t")[750] == "2"
    jobs = spark.createDataFrame([("A", "x", 3, 1), ("A", "y", 4, 1), ("A", "소계", 7, 3)], "line string, product string, m1 long, m2 long")
    assert {r.month: r.difference for r in C.reconcile(jobs, "line", "product", ["m1", "m2"]).collect()} == {"m1": 0, "m2": -1}
    assert C.read_range(g, 1, 1, 2, 1).count() == 2 and C.read_range(g, 1, 1, 2, 1).first().rows_cut


def layout(end=None, role="detail", n=3, cols=(("name", "A"), ("size", "B"))):
    anchors = [("A1", "Name"), ("B1", "size"), ("C1", "other")][:n]
    return (1, "k", "s", [("title", "A1", None)], [("t", role, None, [1], 2, end, list(cols))], anchors, None)


def test_layouts(spark):
    from millwright.plans.views import LAYOUT

    g = grid(spark, [["Name", "Size", "Other"], ["a", 1, "q"], ["b", None, "r"], [None, " ", None], ["c", 3, "s"], ["z", "z", "z"]])
    ls = lambda **k: spark.createDataFrame([layout(**k)], LAYOUT)
    assert C.pick_layout(g, ls(n=2)).count() == 0
    picked = C.pick_layout(g, ls())
    rows = lambda **k: [(r.row_no, r["values"]["name"], r["values"]["size"], r["values"]["title"]) for r in C.parse_rows(g, picked, ls(**k)).orderBy("row_no").collect()]
    assert rows() == [(2, "a", "1", "Name"), (3, "b", None, "Name")]
    assert rows(end=5) == [(2, "a", "1", "Name"), (3, "b", None, "Name"), (5, "c", "3", "Name")]
    assert [dict(r["values"]) for r in C.parse_rows(g, picked, ls(role="summary")).collect()] == [{"title": "Name"}]
    cols, open_rows = C.layout_gaps(g, picked, ls(end=3))
    assert [(r.column, r.hint) for r in cols.collect()] == [("C", "Other")] and [r.rows for r in open_rows.collect()] == ["5-6"]
    assert [r.rows for r in C.layout_gaps(g, picked, ls(end=2), least=2)[1].collect()] == ["3, 5-6"]
    assert C.layout_errors(ls(cols=())).first().error == "no columns"


def test_fields_named_twice(spark):
    """The last of equal fields counts, in columns and in key-values; a key-value sheet is row 1."""
    g = grid(spark, [["Name", "size", "other"], ["a", 1, "x"], ["b", None, "y"]])
    twice = (1, "k", "s", [("title", "A1", None), ("title", "C1", None)], [("t", "detail", None, [1], 2, None, [("name", "A"), ("name", "B"), ("rest", "C")])], [("A1", "Name"), ("B1", "size"), ("C1", "other")], None)
    ls = spark.createDataFrame([twice], V.LAYOUT)
    got = C.parse_rows(g, C.pick_layout(g, ls), ls).orderBy("row_no").collect()
    assert [dict(r["values"]) for r in got] == [{"title": "other", "name": "1", "rest": "x"}, {"title": "other", "name": None, "rest": "y"}]
    keys = spark.createDataFrame([(*twice[:4], [], *twice[5:])], V.LAYOUT)
    r = C.parse_rows(g, C.pick_layout(g, keys), keys).collect()
    assert [(x.row_no, dict(x["values"])) for x in r] == [(1, {"title": "other"})]


def test_blank_anchors(spark):
    anchors = [("A1", "Name"), ("B1", "size"), ("C1", "other"), ("D1", " "), ("D2", None)]
    ls = lambda more: spark.createDataFrame([(*layout()[:5], anchors + more, None)], V.LAYOUT)
    g = grid(spark, [["Name", "size", "other", None], ["a", 1, "x", " "]])
    assert C.pick_layout(g, ls([])).count() == 1
    assert C.pick_layout(g, ls([("B2", "")])).count() == 0


def test_reading_with_fallback(spark):
    """The newest layout that can be parsed; a file with a sheet that has none fails whole, with its reason."""
    good = layout()
    bad = (2, *good[1:4], [("t", "detail", None, [1], 2, None, [])], *good[5:])
    early = (3, *good[1:4], [("t", "detail", None, [1], 5, 2, [("name", "A")])], *good[5:])
    rows = [["Name", "size", "other"], ["a", 1, "x"]]
    one, two = grid(spark, rows, name="one"), grid(spark, rows, name="two")
    cells = one.unionByName(two).unionByName(grid(spark, [["?", "?", "?"]], name="two").withColumn("sheet", F.lit("z")))
    read = lambda *ls: C.read_sheets(cells, spark.createDataFrame(list(ls), V.LAYOUT))
    got, failed = read(good, bad, early)
    assert [(r.source_file, r["values"]["name"]) for r in got.collect()] == [("one", "a")]
    assert [tuple(r) for r in failed.collect()] == [("two", "z: no layout")]
    got, failed = read(bad, early)
    assert got.count() == 0 and sorted(map(tuple, failed.collect())) == [("one", "s: end before start"), ("two", "s: end before start")]


def test_batch_from_cells(spark, tmp_path):
    """Cells of four files to published records, with the losses of each step."""
    from millwright.operators import ingest as I

    fields = {k: v for k, v in I.FIELDS.items()} | {"iqc": ["mold_no", "gap", "note"]}
    sheets = {
        "jig_master": ("master", [["#rx11111", "j", "EQ1 ", "C1", "L1"], ["소계", "j", None, None, None]]),
        "ees": ("RX11111", [["2026-07-01 07:00:00", "설비", " EQ1"], ["2026-07-03 07:00:00", "보관함", None], ["?", "설비", "EQ1"]]),
        "mes": ("day", [["2026/7/1 ~", "C1", "1,000", 5], ["2026/7/2 ~", "C1", "측정불가", 5]]),
        "iqc": ("report", [["RX11111", 1.5, "fine"], ["RX9", 2, None], [None, 3, None]]),
    }
    cells, layouts = None, []
    for n, (kind, (sheet, rows)) in enumerate(sheets.items()):
        names = fields[kind]
        g = grid(spark, [names, *rows], name=f"/{kind}/1.xlsx").withColumns({"sheet": F.lit(sheet), "kind": F.lit(kind)})
        cells = g if cells is None else cells.unionByName(g)
        columns = [(f, "ABCDE"[c]) for c, f in enumerate(names)]
        layouts.append((n + 1, kind, sheet, [], [("t", "detail", None, [1], 2, None, columns)], [(f"{'ABC'[c]}1", f) for c, f in enumerate(names[:3])], None))
    layouts = spark.createDataFrame(layouts, V.LAYOUT)
    broken = grid(spark, [["what", "is", "this"]], name="/mes/2.xlsx").withColumn("kind", F.lit("mes"))
    readers = {k: I.cell_reader(cells.unionByName(broken), layouts, k) for k in I.KINDS}
    store = T.Store(spark, str(tmp_path / "s"))
    found = spark.createDataFrame([(f"/{k}/1.xlsx", k, "h") for k in sheets] + [("/mes/2.xlsx", "mes", "h"), ("/iqc/9.xlsx", "iqc", "h")], "path string, kind string, content_hash string")
    done = I.run_batch(store, found, readers)
    assert done["status"] == "ok" and done["failed_files"] == ["/mes/2.xlsx: s: no layout", "/iqc/9.xlsx: no cells"]
    assert (done["tools"], done["runs"], done["inspected"], done["rejected_events"], done["orphans"], done["skipped_rows"], done["missing_days"]) == (1, 1, 1, 1, 1, 1, 1)
    r = store.load("records").first()
    assert (r.mold_no, r.status, r.total_production) == ("RX11111", "standby", 1000)
    assert {(i.item, i.value) for i in store.load("items").collect()} == {("gap", "1.5"), ("note", "fine")}


def test_sources(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes("﻿lot_id,worked_at,product,item_id,item_name,value\nL1,2026-07-01 18:55,P,0030,x,1.5\nL1,bad,P,1,x,2\nL1,2026-07-01 18:56,P,1,x,abc\nL1,2026/7/1 18:57:01,P,2,x,1d\n".encode())
    good, bad = T.load_readings(spark, str(p))
    assert [(r.lot_id, r.item_id, r.value) for r in good.orderBy("row_no").collect()] == [("L1", "0030", 1.5), ("L1", "1", None), ("L1", "2", None)] and bad.count() == 1
    with pytest.raises(Exception, match="bad time"):
        T.load_readings(spark, str(p), strict=True)[0].collect()
    assert T.stage_dirs("a:x, b : y,c,d:,a:z") == {"a": "z", "b": "y"}
    for name in ("a/1.xlsx", "a/~$1.xlsx", "a/2.XLSX", "a/3.txt", "q/4.xlsx", "q/a/5.xlsx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = T.scan(spark, str(tmp_path), {"a": "x"}, {"x"})
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["1.xlsx", "2.XLSX"]
    with pytest.raises(ValueError):
        T.scan(spark, str(tmp_path), {"a": "w"}, {"x"})
    known = found.withColumn("content_hash", F.when(F.col("path").endswith("1.xlsx"), "old").otherwise(F.col("content_hash"))).unionByName(spark.createDataFrame([("gone", "x", "h")], "path string, kind string, content_hash string"))
    assert {r.path.rsplit("/", 1)[-1]: r.change for r in T.change_set(found, known).collect()} == {"1.xlsx": "changed", "2.XLSX": "same", "gone": "removed"}
    store = T.Store(spark, str(tmp_path / "store"))
    store.replace_all({"mold": spark.createDataFrame([("RX1",), ("RX2",)], "mold_no string")})
    with pytest.raises(Exception):
        store.replace_all({"mold": spark.range(1).select(F.raise_error(F.lit("x")).cast("string").alias("mold_no"))})
    assert store.load("mold").count() == 2
    store.replace_all({"mold": spark.createDataFrame([("RX1",)], "mold_no string")})
    assert [r[0] for r in store.load("mold").collect()] == ["RX1"]
    store.record_run({"n": 1})
    store.record_run({"n": 2})
    assert store.latest_run() == {"n": 2}
    store.save_layout({"id": 1, "kind": "k"})
    store.save_layout({"id": 2, "kind": "k"})
    assert [r.id for r in store.load_layouts("k", "id long, kind string").collect()] == [2, 1]


def test_sessions(spark):
    m = spark.createDataFrame([("s", 1, "assistant", "b"), ("s", 0, "user", "hello\nthere")], "session_id string, turn long, role string, content string")
    assert [x.turn for x in H.history(m).first().messages] == [0, 1]
    assert H.titles(m).first().title == "hello there"


def test_stream_sessions(spark, tmp_path):
    from millwright.streaming.events import stream_events

    src = tmp_path / "in"
    spark.createDataFrame([("L", "2026-07-01 19:00:00", "a"), ("L", "2026-07-01 19:01:00", "b"), ("L", "2026-07-01 19:30:00", "a")], "lot_id string, w string, item_id string").selectExpr("lot_id", "cast(w as timestamp) worked_at", "item_id").write.parquet(str(src))
    s = spark.readStream.schema("lot_id string, worked_at timestamp, item_id string").parquet(str(src))
    q = stream_events(s).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.n_changes for r in spark.table("sessions").collect()} <= {1, 2}


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40


def test_ingest_batch(spark, tmp_path):
    from millwright.operators import ingest as I

    kind = lambda df, schema: spark.createDataFrame(df, schema)
    rows = {
        "jig_master": kind([("#rx11111", "j", "EQ1", "C1", "L1", 1)], MASTER),
        "ees": kind([("RX11111", "2026-07-01 07:00:00", "설비", "EQ1", 1), ("RX11111", "2026-07-03 07:00:00", "보관함", None, 2), ("??", "2026-07-03 07:00:00", "보관함", None, 3)], LEDGER),
        "mes": kind([("2026/7/1 ~", "C1", "1,000", "5", 1), ("2026/7/2 ~", "C1", "측정불가", "5", 2)], "run_date string, equipment_code string, produced string, defects string, order_key long"),
        "iqc": kind([("RX11111", 1, [("gap", 1, "g")]), ("RX9", 2, [("gap", 1, "g")]), (None, 3, [("gap", 1, "g")])], "mold_no string, order_key long, values array<struct<field:string,position:int,value:string>>"),
    }
    failed = {k: [] for k in rows}
    readers = {k: (lambda files, k=k: (rows[k], kind(failed[k], "path string, reason string"))) for k in rows}
    store = T.Store(spark, str(tmp_path / "s"))
    files = [(f"/{k}/1.xlsx", k, "h1") for k in rows]
    found = lambda rows: kind(rows, "path string, kind string, content_hash string")
    run = lambda rows: I.run_batch(store, found(rows), readers)

    assert run([f for f in files if f[1] != "jig_master"])["status"] == "error" and not store.has("records")
    assert run([*files[:2], ("/mes/1.xlsx", "mes", None)]) == store.latest_run() and store.latest_run()["unreadable_files"] == ["/mes/1.xlsx"]
    failed["mes"].append(("/mes/2.xlsx", "broken"))
    done = run([*files, ("/x/1.xlsx", "other", "h")])
    assert done["status"] == "ok" and done["failed_files"] == ["/mes/2.xlsx: broken"]
    assert (done["tools"], done["runs"], done["inspected"], done["rejected_events"], done["orphans"], done["skipped_rows"], done["missing_days"]) == (1, 1, 1, 1, 1, 2, 1)
    assert run(files)["status"] == "skipped" and store.latest_run()["status"] == "skipped"
    failed["ees"].append(("/ees/1.xlsx", "broken"))
    assert run([(*files[0][:2], "h2"), *files[1:]])["status"] == "error"
    assert store.load("records").first().total_production == 1000 and store.load("files").count() == 4
    failed["ees"].clear()
    assert run(files[:3])["status"] == "ok" and store.load("files").count() == 3  # a vanished file is a change
    r = store.load("runs").first()
    assert json.loads(r.defects_json) == [{"day": "2026-07-01", "produced": 1000, "defects": 5}] and r.days_expected == 2

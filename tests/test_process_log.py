"""Literal cases of the process log: input -> expected."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F
import pytest

from millwright.operators import numeric as M
from millwright.operators import process_log as P

T0 = datetime(2026, 7, 1)


def at(text):
    h, m = map(int, text.split(":"))
    return T0 + timedelta(hours=h, minutes=m)


def hm(t):
    return t and t.strftime("%H:%M")


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [("gap1", "input", "control", 1), ("gap2", "input", "control", 2), ("speed", "input", "control", None), ("wet1", "output", "loading_level", 1), ("wet2", "output", "loading_level", 2)]
    return spark.createDataFrame(rows, "item_id string, io string, role string, zone int")


def log(spark, rows):
    return spark.createDataFrame([(lot, at(t), "P", i, v, k) for k, (lot, t, i, v) in enumerate(rows)], "lot_id string, worked_at timestamp, product string, item_id string, value double, row_no long")


def changes(spark, rows):
    return spark.createDataFrame([(lot, i, at(t), v, p) for lot, i, t, v, p in rows], "lot_id string, item_id string, worked_at timestamp, value double, prev_value double")


def means(spark, values, lot="L1", start="19:00"):
    return spark.createDataFrame([(lot, at(start) + timedelta(minutes=k), v) for k, v in enumerate(values)], "lot_id string, worked_at timestamp, wet_mean double")


def test_dedupe_and_compress(spark):
    d = P.dedupe(log(spark, [("L1", "18:56", "A", 10.0), ("L1", "18:56", "A", 11.0)]))
    assert [r.value for r in d.collect()] == [11.0]
    rows = [("L1", f"18:5{k}", "A", v) for k, v in zip(range(5, 10), (10.0, 10.0, 11.0, 11.0, 12.0))] + [("L2", "18:55", "A", 10.0)]
    got = sorted((r.lot_id, hm(r.worked_at), r.value, r.prev_value) for r in P.compress_runs(P.dedupe(log(spark, rows))).collect())
    assert got == [("L1", "18:55", 10, None), ("L1", "18:57", 11, 10), ("L1", "18:59", 12, 11), ("L2", "18:55", 10, None)]
    nulls = P.compress_runs(P.dedupe(log(spark, [("L", "1:00", "A", 10.0), ("L", "1:01", "A", None), ("L", "1:02", "A", 10.0)])))
    assert [r.prev_value for r in nulls.orderBy("worked_at").collect()] == [None, 10.0, None]


def test_state_at(spark):
    ch = changes(spark, [("L", "A", "18:55", 10.0, None), ("L", "A", "18:57", 11.0, 10.0), ("L", "B", "18:56", 20.0, None)])
    probes = spark.createDataFrame([("L", at(t)) for t in ("18:55", "18:56", "18:58")], "lot_id string, at timestamp")
    got = {(hm(r.at), r.item_id): r.value for r in P.state_at(ch, probes).collect()}
    assert got == {("18:55", "A"): 10, ("18:56", "A"): 10, ("18:56", "B"): 20, ("18:58", "A"): 11, ("18:58", "B"): 20}


def test_events(spark, catalogue):
    ch = changes(spark, [("L", "gap1", "19:00", 5.0, 0.0), ("L", "gap2", "19:02", 2.0, 0.0), ("L", "gap1", "19:10", 7.0, 5.0), ("L", "gap1", "18:00", 0.0, None), ("L", "wet1", "19:30", 2.0, 1.0)])
    events, deltas = P.build_events(ch, catalogue, 2)
    assert sorted((r.event_id, hm(r.worked_at), r.n_items) for r in events.collect()) == [("L#1", "19:00", 2), ("L#2", "19:10", 1)]
    assert sorted((r.event_id, r.zone, r.delta) for r in deltas.collect()) == [("L#1", 1, 5), ("L#1", 2, 2), ("L#2", 1, 2)]
    assert hm(P.tuning_end_last_change(ch, catalogue).first().tuning_end) == "19:10"


@pytest.mark.parametrize(
    "asks, wet, wait, want",
    [
        (["19:00"], [18.2, 18.5, 18.4, 18.35] + [18.3] * 6, 30, [None]),
        (["19:00", "19:02"], [18.2, 18.5, 18.45, 18.4, 18.35] + [18.3] * 7, 30, ["overlapped", None]),
        (["19:00"], [18.2, 18.6, 18.1, 18.7, 18.0, 18.8, 18.1, 18.6], 5, ["no_settle"]),
    ],
)
def test_settling(spark, asks, wet, wait, want):
    ev = spark.createDataFrame([("L1", f"L1#{k}", at(t), 1) for k, t in enumerate(asks)], "lot_id string, event_id string, worked_at timestamp, n_items long")
    got = P.annotate_settling(ev, means(spark, wet), 0.02, 3, wait).orderBy("event_id").collect()
    assert [r.drop_reason for r in got] == want
    assert [r.contaminated for r in got] == [w is not None for w in want]


def test_settling_brute_force(spark):
    rng = np.random.default_rng(6)
    lots, ev, rows = [f"L{k}" for k in range(6)], [], []
    for lot in lots:
        t, v = at("1:00"), 18.0
        for k in range(120):
            t += timedelta(minutes=int(rng.integers(1, 4)))
            v += float(rng.choice([0, 0, 0, 0.5, -0.5]))
            rows.append((lot, t, None if rng.random() < 0.05 else v))
        ev += [(lot, f"{lot}#{k}", at("1:00") + timedelta(minutes=int(m)), 1) for k, m in enumerate(sorted(rng.choice(250, 12, replace=False)))]
    e = spark.createDataFrame(ev, "lot_id string, event_id string, worked_at timestamp, n_items long")
    m = spark.createDataFrame(rows, "lot_id string, worked_at timestamp, wet_mean double")
    got = {r.event_id: r.settled_at for r in P.annotate_settling(e, m, 0.1, 4, 20).collect()}
    for lot, i, t, _ in ev:
        g = [(a, v) for x, a, v in rows if x == lot and t < a <= t + timedelta(minutes=20)]
        want = None
        for k in range(3, len(g)):
            w = [v for _, v in g[k - 3 : k + 1]]
            if None not in w and np.std(w) <= 0.1:
                want = g[k][0]
                break
        assert got[i] == want


def test_wet(spark, catalogue):
    d = P.dedupe(log(spark, [("L", "1:00", "wet1", 18.2), ("L", "1:00", "wet2", 0.0), ("L", "1:01", "wet2", 0.0)]))
    wet = P.wet_long(d, catalogue)
    assert [tuple(r)[2:] for r in P.wet_wide(wet, 3).collect()] == [(18.2, None, None)]
    assert [r.zone for r in P.valid_zones(wet).collect()] == [1]
    assert P.wet_mean(wet).first().wet_mean == 18.2


def test_delta_samples(spark):
    ann = spark.createDataFrame([("L1", "L1#1", at("19:00"), 1, at("19:05"), False, None), ("L1", "L1#2", at("19:06"), 1, None, True, "no_settle")], "lot_id string, event_id string, worked_at timestamp, n_items long, settled_at timestamp, contaminated boolean, drop_reason string")
    deltas = spark.createDataFrame([("L1#1", at("19:00"), "g", 1, 3.0), ("L1#1", at("19:01"), "g", 1, 5.0), ("L1#2", at("19:06"), "g", 1, 7.0)], "event_id string, worked_at timestamp, item_id string, zone int, delta double")
    wet = spark.createDataFrame([("L1", at("18:46") + timedelta(minutes=k), 1, 18.2 if k < 15 else 18.5) for k in range(30)], "lot_id string, worked_at timestamp, zone int, wet double")
    got = P.delta_samples(ann, deltas, wet, 3, 2).collect()
    assert [(r.event_id, r.dg) for r in got] == [("L1#1", [5.0, 0.0])]
    assert got[0].dw[0] == pytest.approx(0.3) and got[0].dw[1] is None
    assert P.delta_samples(ann, deltas, wet, 3, 2, combine="sum").first().dg[0] == 8.0


def test_band(spark):
    m = means(spark, [17.0, 18.23, 17.0, 18.24, 18.22], start="18:55").unionByName(means(spark, [1.0, None], "L2"))
    assert {r.lot_id: hm(r.tuning_end) for r in P.tuning_end_band(m, 18.23, 0.1, 2).collect()} == {"L1": "18:58", "L2": None}


def test_audit_without_changes(spark, catalogue):
    r = P.audit(log(spark, [("L", f"18:{k}", i, 1.0) for k in range(10, 30) for i in ("gap1", "wet1")] + [("L", "18:59", "zz", 1.0)]), catalogue, 1, 2).first()
    assert (r.n_events, r.verdict, r.unknown_items, r.missing_items) == (0, "insufficient", ["zz"], ["gap2", "speed"])


def test_kernel(spark):
    rng = np.random.default_rng(0)
    true = np.array([0.1, 0.3, 1.0, 0.3, 0.1])
    g = M.kernel_matrix(true, 25)
    dg = rng.normal(size=(200, 25))
    rows = [(x.tolist(), y.tolist()) for x, y in zip(dg, dg @ g.T)]
    rows[3][1][4] = None
    got = M.fit_kernel(spark.createDataFrame(rows, "dg array<double>, dw array<double>"), 2, 1e-6)
    # the means are taken off before the edges are padded, so a small bias stays
    assert np.abs(got - true).max() < 0.02
    assert g[10, 9] == 0.3 and g[10, 12] == 0.1 and g[10, 13] == 0
    assert {(r.i, r.j): r.weight for r in M.kernel_rows(spark, true, 25).collect()} == {(i, j): g[i, j] for i in range(25) for j in range(25) if abs(i - j) <= 2}


def test_kernel_of_every_fold(spark):
    rng = np.random.default_rng(4)
    k, rows = np.array([0.1, 0.4, 0.2]), []
    for n in range(90):
        g = rng.normal(size=8)
        w = np.convolve(g - g.mean(), k[::-1], "same") + rng.normal(size=8) * 0.1
        rows.append((n % 3 if n < 84 else None, g.tolist(), [None if rng.random() < 0.1 else float(v) for v in w]))
    df = spark.createDataFrame(rows, "fold int, dg array<double>, dw array<double>")
    got = {(r.fold, r.alpha): r for r in M.evaluate_kernel(df, [0.5, 20.0], 1).collect()}
    assert len(got) == 6
    for (fold, alpha), r in got.items():
        w = M.fit_kernel(df.where(f"fold <> {fold}"), 1, alpha)
        assert np.allclose(r.kernel, w, atol=1e-12)
        errors = [(v.y - np.dot(v.x, w)) ** 2 for v in M._kernel_rows(df.where(f"fold = {fold}"), 1).collect()]
        assert r.n == len(errors) and abs(r.rmse - np.sqrt(np.mean(errors))) < 1e-9
    assert M.evaluate_kernel(df.where("false"), [1.0]).count() == 0


def test_rank(spark):
    rng = np.random.default_rng(1)
    for x, want in ((np.outer(np.arange(1, 301.0), np.ones(25)), 1), (rng.normal(size=(300, 25)), 25), (rng.normal(size=(300, 4)) @ rng.normal(size=(4, 25)), 4)):
        df = spark.createDataFrame([(r.tolist(),) for r in x], "dg array<double>").repartition(5)
        r = M.rank_diagnostics(df).first()
        assert (r.effective_rank, r.n_events) == (want, 300)
        assert np.allclose(r.singular_values[:want], np.linalg.svd(x, compute_uv=False)[: min(10, want)], rtol=1e-9)


def test_level(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), None if k % 9 == 0 else float(b), p, 18.0 + 2 * (p == "P2") + 0.01 * float(a)) for k, (a, b, p) in enumerate(zip(rng.normal(size=80), rng.normal(size=80), ["P1", "P2"] * 40))]
    df = spark.createDataFrame(rows, "os_gap double, ds_gap double, product string, wet_mean double")
    assert M.available_features(df, ["bp", "os_gap", "ds_gap"]) == ["os_gap", "ds_gap"]
    model = M.fit_level(df, ["os_gap", "ds_gap"], alpha=0.01)
    p = {r.product: r.predicted for r in model.predict(spark.createDataFrame([(0.0, 0.0, x) for x in ("P1", "P2", "P3", None)], "os_gap double, ds_gap double, product string")).collect()}
    assert p["P2"] - p["P1"] > 1.0 and p["P1"] < p["P3"] == p[None] < p["P2"]
    x = np.array([[a, np.median([r[1] for r in rows if r[1] is not None]) if b is None else b] for a, b, _, _ in rows])
    x = np.hstack(((x - x.mean(0)) / x.std(0), np.array([[r[2] == "P1", r[2] == "P2"] for r in rows], float), np.ones((80, 1))))
    w = np.linalg.solve(x.T @ x + np.diag([0.01] * 4 + [1e-12]), x.T @ np.array([r[3] for r in rows]))
    rows = model.predict(df.withColumn("k", F.monotonically_increasing_id())).orderBy("k").collect()
    assert np.allclose([r.predicted for r in rows], x @ w)


def test_level_many_products(spark):
    df = spark.range(6000).selectExpr("cast(id % 17 as double) os_gap", "cast(id % 1500 as string) product", "(id % 1500) / 100 + (id % 17) * 0.5 wet_mean")
    worst = M.fit_level(df, ["os_gap"], alpha=1e-6).predict(df).selectExpr("max(abs(predicted - wet_mean))").first()[0]
    assert worst < 1e-3


def test_median_baseline(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(p), int(k * 7919 % 400), None if k % 11 == 0 else float(v)) for k, (p, v) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 30, 400)))]
    df = spark.createDataFrame(rows, "lot_id long, product long, worked_at int, gap double")
    got = {r.lot_id: r.gap for r in M.median_baseline(df, ["gap"]).collect()}
    for k, p, at, _ in rows:
        before = [v for _, q, t, v in rows if q == p and t < at and v is not None]
        assert got.get(k) == (np.median(before) if before else None)


def test_time_holdout_one_time(spark):
    df = spark.range(1000).selectExpr("id lot_id", "case when id < 700 then 5 else id end at")
    folds = {r.lot_id: r.fold for r in M.time_holdout(df.repartition(7), "at", "lot_id", 0.2).collect()}
    order = sorted(folds, key=lambda k: (5 if k < 700 else k, k))
    assert [folds[k] for k in order] == ["train"] * 800 + ["test"] * 200
    assert {r.fold for r in M.time_holdout(df, "at", "lot_id", 0.0).collect()} == {"train"} and M.time_holdout(df.where("false"), "at", "lot_id").count() == 0


def test_time_holdout_puts_null_times_last(spark):
    df = spark.createDataFrame([(k, T0 + timedelta(days=k) if k % 3 else None) for k in range(12)], "lot long, t timestamp")
    got = {r.lot: r.fold for r in M.time_holdout(df, "t", "lot", 0.5).collect()}
    assert sorted(k for k, f in got.items() if f == "train") == [1, 2, 4, 5, 7, 8]


def test_group_splits(spark):
    rng = np.random.default_rng(8)
    lots = {k: int(n) for k, n in enumerate(rng.choice([1, 1, 1, 2, 3, 8, 21, 60], 300))}
    df = spark.createDataFrame([(k,) for k, n in lots.items() for _ in range(n)], "lot_id long")
    got = {r.lot_id: r.fold for r in M.lot_group_splits(df, 5).collect()}
    load, want = [0] * 5, {}
    for k in sorted(lots, key=lambda k: -lots[k]):
        f = load.index(min(load))
        load[f] += lots[k]
        want.setdefault((lots[k], f), []).append(k)
    for (n, f), ks in want.items():
        assert sum(got[k] == f for k in lots if lots[k] == n) == len(ks)


def test_recommend(spark):
    g = M.kernel_matrix(np.array([0.1, 1.0, 0.1]), 5)
    rows = [("a", [300.0] * 5, [18.0] * 5, [18.5] * 5), ("b", [499.9] * 5, [1.0] * 5, [99.0] * 5), ("c", [300.0] * 5, [18.0] * 5, [18.0] * 5)]
    df = spark.createDataFrame(rows, "lot_id string, current_gap array<double>, current_profile array<double>, target_profile array<double>")
    got = {r.lot_id: np.array(r.gap) for r in M.recommend_gap(df, g, (100.0, 500.0), 5.0).collect()}
    assert np.allclose(got["c"], 300, atol=1e-3) and np.allclose(got["b"], 500)
    d = np.diff(np.eye(5), axis=0)
    free = np.linalg.solve(g.T @ g + 0.01 * np.eye(5) + 0.01 * d.T @ d, g.T @ np.full(5, 0.5))
    assert np.allclose(got["a"] - 300, free, atol=1e-6)
    with pytest.raises(Exception, match="no room"):
        M.recommend_gap(df, g, (600.0, 700.0), 5.0).collect()


def test_baselines_and_scores(spark):
    f = spark.createDataFrame([(f"L{k}", p, at(f"{k}:00"), v, v) for k, p, v in ((1, "P1", 160.0), (2, "P1", 162.0), (3, "P2", 200.0), (4, "P1", 164.0))], "lot_id string, product string, worked_at timestamp, os_gap double, ds_gap double")
    assert {r.lot_id: r.os_gap for r in M.prev_lot_baseline(f, ["os_gap", "ds_gap"]).collect()} == {"L2": 160, "L4": 162}
    assert {r.lot_id: r.os_gap for r in M.median_baseline(f, ["os_gap", "ds_gap"]).collect()} == {"L2": 160, "L4": 161}
    s = spark.createDataFrame([(1, [18.2, 18.3, 18.25]), (2, [18.2, 18.9, 18.25]), (3, [18.2, None, 18.25]), (4, [None] * 3)], "sample_id long, wet array<double>").selectExpr("*", "18.23D target", "0.4D tolerance")
    assert M.hit_rate(s).first()[0] == 0.75
    assert M.cross_width_sigma(spark.createDataFrame([(1, [18.0, 18.4, None])], "sample_id long, wet array<double>")).first().sigma == pytest.approx(0.2)
    p = spark.createDataFrame([([1.0, 3.0], [2.0, 2.0], 1.0, 3.0)], "a array<double>, b array<double>, x double, y double")
    assert M.profile_rmse(p, "a", "b").first()[0] == 1.0 and M.level_mae(p, "x", "y").first()[0] == 2.0

"""Step-signal process logs: compression, adjustment events, settling and responses.

Column contract: lot_id, worked_at, product, item_id, value, row_no.  The item catalogue (item_id, io,
role, zone) is an argument.  Nulls follow one rule: a missing value is unknown, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.operators.ranks import order_statistics
from millwright.sources.staging import staged

KEY = ["lot_id", "item_id"]
SEGMENT = 1440  # minutes; a lot is worked on in pieces of this length
PIECE = ["lot_id", "seg"]


def _segment(at: Column | str, minutes: float) -> Column:
    """Number of the piece of time that holds ``at``."""
    return F.floor(F.unix_micros(at) / F.lit(int(minutes * 60_000_000)))


def with_catalogue(readings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Left join; the catalogue is a few dozen items, so the optimiser broadcasts it by size."""
    return readings.join(catalogue, "item_id", "left")


def unknown_items(readings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """J2."""
    return readings.select("item_id").distinct().join(catalogue, "item_id", "left_anti").orderBy("item_id")


def dedupe(readings: DataFrame) -> DataFrame:
    """The last written row of each exact (lot, time, item), even if its value is null.

    ``max_by`` combines on the map side.  Rows with a null key are dropped.
    """
    last = F.max_by(F.struct("product", "value"), "row_no").alias("r")
    keyed = readings.where("lot_id is not null and worked_at is not null and item_id is not null")
    return keyed.groupBy("lot_id", "worked_at", "item_id").agg(last).select("lot_id", "worked_at", "item_id", "r.*")


def compress_runs(deduped: DataFrame) -> DataFrame:
    """First and every changed value with the one before; a null is a change, and what follows it
    starts anew."""
    w = W.partitionBy(*KEY).orderBy("worked_at")
    prev = F.lag("value").over(w)
    out = deduped.withColumn("prev_value", prev)
    return out.where("prev_value is null or value is null or value <> prev_value").select("lot_id", "item_id", "worked_at", "value", "prev_value")


def state_at(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """For every probe (lot_id, at) each item's last non-null value at or before it.

    Items are the lot's own; probes and changes are sorted together once, no range join.
    """
    items = changes.select(*KEY).distinct()
    ask = probes.select("lot_id", "at").distinct().join(items, "lot_id").select(*KEY, F.col("at").alias("worked_at"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("ask"))
    both = changes.select(*KEY, "worked_at", "value", F.lit(0).alias("ask")).unionByName(ask)
    w = W.partitionBy(*KEY).orderBy("worked_at", "ask").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("v", F.last("value", ignorenulls=True).over(w)).where("ask = 1 and v is not null").select("lot_id", F.col("worked_at").alias("at"), "item_id", F.col("v").alias("value"))


def lot_bounds(deduped: DataFrame) -> DataFrame:
    """A1."""
    first = F.min_by("product", F.when(F.col("product").isNotNull(), F.struct("worked_at", "item_id")))
    return deduped.groupBy("lot_id").agg(F.min("worked_at").alias("started_at"), F.max("worked_at").alias("ended_at"), first.alias("product"))


def control_changes(changes: DataFrame, catalogue: DataFrame) -> DataFrame:
    return changes.join(catalogue.where("role = 'control'").select("item_id", "zone"), "item_id").where(F.col("prev_value").isNotNull())


def tuning_end_last_change(changes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Last real control change of every lot; null where nothing was touched.  Where the input
    has no ``prev_value`` the first row of each lot and item is its start and no change."""
    if "prev_value" not in changes.columns:
        at = F.row_number().over(W.partitionBy(*KEY).orderBy("worked_at"))
        changes = changes.withColumn("prev_value", F.when(at > 1, 0.0))
    hit = control_changes(changes, catalogue).groupBy("lot_id").agg(F.max("worked_at").alias("tuning_end"))
    return changes.select("lot_id").distinct().join(hit, "lot_id", "left")


def build_events(changes: DataFrame, catalogue: DataFrame, merge_minutes: float = 2, segment_minutes: float = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(events, deltas).  A gap equal to ``merge_minutes`` to the change before stays inside.

    A scan in pieces: changes are sorted within the pieces of a lot and numbered there; a summary row for each
    piece (first change, last change, events that begin behind the first) is summed up along the lot, and
    gives each piece the number of events before it.  However long a lot is, a task has one piece of it; the
    pieces' length changes no result.
    """
    least = int(merge_minutes * 60_000_000)
    inside = W.partitionBy(*PIECE).orderBy("worked_at", "item_id")
    gap = F.unix_micros("worked_at") - F.unix_micros(F.lag("worked_at").over(inside))
    c = control_changes(changes, catalogue).withColumn("seg", _segment("worked_at", segment_minutes))
    c = c.withColumn("new", F.coalesce((gap > least).cast("int"), F.lit(0)))
    c = c.withColumn("inner", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    c = staged(c.select(*PIECE, "worked_at", "item_id", "zone", (F.col("value") - F.col("prev_value")).alias("delta"), "inner"), "control-changes")
    along = W.partitionBy("lot_id").orderBy("seg")
    per = c.groupBy(*PIECE).agg(F.min("worked_at").alias("first"), F.max("worked_at").alias("last"), F.max("inner").alias("n"))
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(along))
    per = per.withColumn("opens", F.coalesce((gap > least).cast("int"), F.lit(1)))
    before = F.coalesce(F.sum(F.col("n") + F.col("opens")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("opens")
    c = c.join(per.select(*PIECE, before.alias("before")), PIECE)
    c = c.withColumn("event_id", F.concat_ws("#", "lot_id", (F.col("before") + F.col("inner")).cast("string")))
    events = c.groupBy("lot_id", "event_id").agg(F.min("worked_at").alias("worked_at"), F.count_distinct("item_id").alias("n_items"))
    return events, c.select("lot_id", "event_id", "worked_at", "item_id", "zone", "delta")


def wet_long(deduped: DataFrame, catalogue: DataFrame, role: str = "loading_level") -> DataFrame:
    """F14, R1 in long form: measured zones only; a minute without any is absent."""
    zones = catalogue.where((F.col("role") == role) & F.col("zone").isNotNull()).select("item_id", "zone")
    return deduped.join(zones, "item_id").withColumn("wet", F.nullif(F.col("value"), F.lit(0.0))).where("wet is not null").select("lot_id", "worked_at", "zone", "wet")


def wet_wide(wet: DataFrame, n_zones: int = 25) -> DataFrame:
    """One column for each zone, always all of them."""
    out = wet.groupBy("lot_id", "worked_at").pivot("zone", list(range(1, n_zones + 1))).agg(F.last("wet"))
    return out.select("lot_id", "worked_at", *[F.col(str(z)).alias(f"z{z}") for z in range(1, n_zones + 1)])


def valid_zones(wet: DataFrame) -> DataFrame:
    """A14."""
    return wet.select("zone").distinct()


def wet_mean(wet: DataFrame) -> DataFrame:
    """A15."""
    return wet.groupBy("lot_id", "worked_at").agg(F.avg("wet").alias("wet_mean"))


def with_tails(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (lot_id, seg, worked_at, wet_mean, and ``left``, the rows of the piece from this one on) and in every piece the
    last ``k`` rows of the lot before it, marked by ``tail``: what a frame of k rows back needs.

    Of every piece only its last k rows go along the lot; a piece has one row at least, so the k pieces before hold them."""
    ends = rows.where(F.col("left") <= k).groupBy(*PIECE).agg(F.array_sort(F.collect_list(F.struct("worked_at", "wet_mean"))).alias("end"))
    along = W.partitionBy("lot_id").orderBy("seg").rowsBetween(-k, -1)
    ends = ends.withColumn("end", F.flatten(F.collect_list("end").over(along)))
    tails = ends.select(*PIECE, F.inline(F.slice("end", F.greatest(F.size("end") - (k - 1), F.lit(1)), k)))
    cols = [*PIECE, "worked_at", "wet_mean"]
    return rows.select(*cols, F.lit(False).alias("tail")).unionByName(tails.select(*cols, F.lit(True).alias("tail")))


def stable_windows(means: DataFrame, std_max: float = 0.02, window: int = 5, segment_minutes: float = SEGMENT) -> DataFrame:
    """(lot_id, at, end): first and last time of every run of ``window`` rows whose deviation is ``std_max`` at most."""
    w = max(2, window)
    rows = means.select("lot_id", "worked_at", "wet_mean").withColumn("seg", _segment("worked_at", segment_minutes))
    rows = staged(rows.withColumn("left", F.row_number().over(W.partitionBy(*PIECE).orderBy(F.desc("worked_at")))), "means")
    piece = W.partitionBy(*PIECE).orderBy("worked_at")
    trail = piece.rowsBetween(-(w - 1), 0)
    rows = with_tails(rows, w - 1).withColumn("std", F.stddev_pop("wet_mean").over(trail)).withColumn("n", F.count("wet_mean").over(trail)).withColumn("at", F.lag("worked_at", w - 1).over(piece))
    stable = ~F.col("tail") & (F.col("n") == w) & (F.col("std") <= std_max) & F.col("at").isNotNull()
    return rows.where(stable).select("lot_id", "at", F.col("worked_at").alias("end"))


def annotate_settling(events: DataFrame, means: DataFrame, std_max: float = 0.02, window: int = 5, max_wait_minutes: float = 30, segment_minutes: float = SEGMENT) -> DataFrame:
    """settled_at, contaminated, drop_reason.

    Stable windows are keyed by their first row; each event takes the first one behind it.  Events and windows
    are sorted together within the pieces of a lot; what an event doesn't find in its piece it takes from a
    summary row of the pieces behind (first event, end of the first stable window).
    """
    none = F.lit(None).cast("timestamp")
    stable = stable_windows(means, std_max, window, segment_minutes).select("*", F.lit(0).alias("k"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("long").alias("n_items"))
    asks = events.select("lot_id", F.col("worked_at").alias("at"), none.alias("end"), F.lit(1).alias("k"), "event_id", F.col("n_items").cast("long").alias("n_items"))
    both = stable.unionByName(asks).withColumn("seg", _segment("at", segment_minutes))
    # from the last row back, so that the frame grows row by row
    behind = W.partitionBy(*PIECE).orderBy(F.desc("at"), F.desc("k"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, -1)
    event = F.col("k") == 1
    first = F.min(F.when(~event, F.struct("at", "end"))).over(W.partitionBy(*PIECE))
    both = both.withColumn("found", F.when(event, F.last("end", ignorenulls=True).over(behind)).otherwise(F.col("end")))
    both = both.withColumn("next_at", F.when(event, F.last(F.when(event, F.col("at")), ignorenulls=True).over(behind))).withColumn("first", first)
    both = staged(both.where(event | (F.struct("at", "end") == F.col("first"))).drop("first", "end"), "settling-events")
    later = W.partitionBy("lot_id").orderBy(F.desc("seg")).rowsBetween(W.unboundedPreceding, -1)
    per = both.groupBy(*PIECE).agg(F.min(F.when(event, F.col("at"))).alias("event"), F.min(F.when(~event, F.col("found"))).alias("end"))
    per = per.select(*PIECE, *[F.last(c, ignorenulls=True).over(later).alias(f"later_{c}") for c in ("event", "end")])
    out = both.where(event).join(per, PIECE).withColumn("worked_at", F.col("at"))
    out = out.withColumn("end", F.coalesce("found", "later_end")).withColumn("next_at", F.coalesce("next_at", "later_event"))
    in_time = F.unix_micros("end") - F.unix_micros("worked_at") <= int(max_wait_minutes * 60_000_000)
    out = out.withColumn("settled_at", F.when(in_time, F.col("end")))
    reason = F.when(F.col("settled_at").isNull(), "no_settle").when(F.col("next_at") < F.col("settled_at"), "overlapped")
    out = out.withColumn("drop_reason", reason)
    return out.select("lot_id", "event_id", "worked_at", "n_items", "settled_at", F.col("drop_reason").isNotNull().alias("contaminated"), "drop_reason")


def delta_samples(annotated: DataFrame, deltas: DataFrame, wet: DataFrame, window_minutes: float = 5, n_zones: int = 25, combine: str = "last") -> DataFrame:
    """(event_id, lot_id, worked_at, dg, dw), the last two arrays, of clean events with rows in both windows.

    The interval join is an equi-join on time buckets as wide as the window, two buckets at most for
    each side of an event.  Of several deltas of a zone the latest wins, or with combine="sum" all add.
    """
    span = int(window_minutes * 60_000_000)
    clean = annotated.where("not contaminated")
    event = ["event_id", "lot_id", "event_at"]
    sides = clean.select("lot_id", "event_id", F.col("worked_at").alias("event_at"), F.explode(F.array(
        F.struct(F.lit("before").alias("side"), (F.unix_micros("worked_at") - span).alias("lo"), F.unix_micros("worked_at").alias("hi")),
        F.struct(F.lit("after").alias("side"), F.unix_micros("settled_at").alias("lo"), (F.unix_micros("settled_at") + span).alias("hi")))).alias("s")).select(*event, "s.*")
    sides = sides.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))))
    rows = wet.withColumn("at", F.unix_micros("worked_at")).withColumn("bucket", F.floor(F.col("at") / span))
    mean = sides.join(rows.select("lot_id", "bucket", "at", "zone", "wet"), ["lot_id", "bucket"]).where("at between lo and hi").groupBy(*event, "side", "zone").agg(F.avg("wet").alias("m"))
    m = mean.groupBy(*event).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("zone", "m")))).alias(s) for s in ("before", "after")])
    m = m.where((F.size("before") > 0) & (F.size("after") > 0))
    zoned = deltas.where("zone is not null").groupBy("event_id", "zone").agg((F.sum("delta") if combine == "sum" else F.max_by("delta", F.struct("worked_at", "item_id"))).alias("d"))
    g = zoned.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("zone", "d"))).alias("gap"))
    zones = F.sequence(F.lit(1), F.lit(n_zones))
    out = m.join(g, "event_id", "left")
    dg = F.transform(zones, lambda z: F.coalesce(F.try_element_at("gap", z.cast("int")), F.lit(0.0)))
    dw = F.transform(zones, lambda z: F.try_element_at("after", z.cast("int")) - F.try_element_at("before", z.cast("int")))
    return out.select("event_id", "lot_id", F.col("event_at").alias("worked_at"), dg.alias("dg"), dw.alias("dw"))


def tuning_end_band(means: DataFrame, target: float, band: float = 0.1, least: int = 5) -> DataFrame:
    """Start of the first streak of ``least`` consecutive in-band observations; null where none."""
    w = W.partitionBy("lot_id").orderBy("worked_at")
    inside = F.coalesce(F.abs(F.col("wet_mean") - target) <= band, F.lit(False))
    rows = means.withColumn("inside", inside).withColumn("island", F.sum((~F.col("inside")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    streak = rows.where("inside").groupBy("lot_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("worked_at").alias("at")).where(F.col("n") >= least)
    return means.select("lot_id").distinct().join(streak.groupBy("lot_id").agg(F.min("at").alias("tuning_end")), "lot_id", "left")


def missing_controls(readings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A21."""
    return catalogue.where("role = 'control'").select("item_id").join(readings.select("item_id").distinct(), "item_id", "left_anti").orderBy("item_id")


def changes_per_lot(changes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Real control changes of each lot that has any, described over lots."""
    n = staged(control_changes(changes, catalogue).groupBy("lot_id").agg(F.count(F.lit(1)).cast("double").alias("n")), "changes-of-lots")
    q = dict(zip(("q25", "q50", "q75"), order_statistics(n, {"n": [0.25, 0.5, 0.75]})["n"]))
    shares = [F.lit(v).cast("double").alias(k) for k, v in q.items()]
    return n.agg(F.count("n").alias("count"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), *[F.max(s).alias(k) for s, k in zip(shares, q)], F.max("n").alias("max"))


def verdict(n_clean: Column, rank: Column, least: int = 20) -> Column:
    """Can a model be trained on this log?"""
    return F.when(n_clean < least, "insufficient").when(rank < 3, "rank_deficient").otherwise("trainable")


def audit(readings: DataFrame, catalogue: DataFrame, minutes: int = 1, n_zones: int = 25, std_max: float = 0.02) -> DataFrame:
    """One row of facts about a log.  ``minutes`` scales all minute parameters."""
    from millwright.operators.numeric import rank_diagnostics

    # what several facts are read from is written once
    deduped = staged(dedupe(readings), "deduped")
    changes = compress_runs(deduped)
    events, deltas = (staged(x, name) for x, name in zip(build_events(changes, catalogue, 2 * minutes), ("events", "deltas")))
    wet = staged(wet_long(deduped, catalogue), "wet")
    ann = staged(annotate_settling(events, wet_mean(wet), std_max, 5, 30 * minutes), "settling")
    rank = rank_diagnostics(delta_samples(ann, deltas, wet, 5 * minutes, n_zones), n_zones).select(F.col("effective_rank"))
    facts = ann.agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("contaminated")).alias("n_clean_events"))
    base = deduped.agg(F.count_distinct("lot_id").alias("n_lots"), F.min("worked_at").alias("from"), F.max("worked_at").alias("to"), F.count(F.lit(1)).alias("n_rows"))
    zones = wet.agg(F.count_distinct("zone").alias("n_zones"))
    unknown = unknown_items(readings, catalogue).agg(F.sort_array(F.collect_list("item_id")).alias("unknown_items"))
    missing = missing_controls(readings, catalogue).agg(F.sort_array(F.collect_list("item_id")).alias("missing_items"))
    out = base.withColumn("k", F.lit(1))
    for one in (facts, zones, rank, unknown, missing):  # one-row tables; rank is empty without samples
        out = out.join(one.withColumn("k", F.lit(1)), "k", "left")
    out = out.drop("k").withColumn("effective_rank", F.coalesce("effective_rank", F.lit(0)))
    ratio = F.try_divide(F.col("n_events") - F.col("n_clean_events"), F.col("n_events"))
    return out.withColumn("contaminated_ratio", ratio).withColumn("verdict", verdict(F.col("n_clean_events"), F.col("effective_rank")))

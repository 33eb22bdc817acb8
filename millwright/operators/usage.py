"""Tool usage: location ledger -> runs -> daily production -> one record per tool, with every loss named.

``order_key`` decides which of two rows is the later one wherever a later row wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions import scalars as S
from millwright.sources.staging import staged

ITEM_FIRST = ["punch", "die", "diff", "gap"]  # fixed value: order of the known inspection fields
STAGES = ["design", "install", "iqc", "pqc", "ai_recheck"]  # fixed value: the five stages of a tool


def _clean_master(master: DataFrame) -> DataFrame:
    rows = master.withColumns({c: S.blank_to_null(F.col(c)) for c in ("equipment", "equipment_code", "line")})
    return rows.withColumn("mold_no", S.normalize_tool("mold_no"))


def tool_index(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (last row of each tool, dropped rows with a reason)."""
    rows = _clean_master(master)
    last = F.max_by(F.struct("jig_name", "equipment", "equipment_code", "line"), "order_key").alias("r")
    kept = rows.where("mold_no is not null").groupBy("mold_no").agg(last).select("mold_no", "r.*")
    return kept, master.where(S.normalize_tool("mold_no").isNull()).withColumn("reason", F.lit("no tool id"))


def equipment_index(master: DataFrame) -> DataFrame:
    """A5: last row of each equipment name; needs both equipment and tool id."""
    rows = _clean_master(master).where("mold_no is not null and equipment is not null")
    return rows.groupBy("equipment").agg(F.max_by(F.struct(F.col("equipment_code").alias("code"), "line"), "order_key").alias("r")).select("equipment", "r.*")


def production_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last row of each (day, code), unreadable rows).  Rows without a code are totals and vanish.

    The rows are read and written once: both results, and the filters on what was read, would read them anew."""
    rows = rows.withColumn("equipment_code", S.blank_to_null(F.col("equipment_code"))).where("equipment_code is not null").select(S.run_date("run_date").alias("day"), F.col("equipment_code").alias("code"), S.to_int("produced").alias("produced"), S.to_int("defects").alias("defects"), "order_key")
    rows = staged(rows, "production-rows")
    good = F.col("day").isNotNull() & F.col("produced").isNotNull() & F.col("defects").isNotNull()
    return last_production(rows.where(good)), rows.where(~good)


def last_production(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "code").agg(F.max_by(F.struct("produced", "defects"), "order_key").alias("r")).select("day", "code", "r.*")


NO_NAME = "(빈 이름)"  # fixed value: how a sheet without a name is listed


def clean_ledger(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable events, rejected rows with a reason).

    Cells are stripped; an event without a place is an event (it ends a run), its location is the empty text."""
    cell = {"location": F.coalesce(S.blank_to_null(F.col("location")), F.lit("")), "equipment": S.blank_to_null(F.col("equipment"))}
    rows = ledger.withColumns(cell).withColumn("tool", S.normalize_tool("sheet")).withColumn("at", S.to_datetime("event_at"))
    reason = F.when(F.col("tool").isNull(), "no id").when(~S.is_tool_name("sheet"), "bad sheet name").when(F.col("at").isNull(), "bad time")
    rows = staged(rows.withColumn("reason", reason), "ledger")  # a filter on the reason would read each time twice
    return rows.where("reason is null").select(F.col("tool").alias("mold_no"), "at", "location", "equipment", "order_key"), rows.where("reason is not null")


def pair_runs(events: DataFrame, at_machine: str = S.AT_MACHINE) -> DataFrame:
    """Every event at a machine opens a run that ends at the tool's next event anywhere.

    Equal events count once (the first); both windows share one shuffle by tool.
    """
    same = W.partitionBy("mold_no", "at", "location", "equipment").orderBy("order_key")
    rows = events.repartition("mold_no").withColumn("k", F.row_number().over(same)).where("k = 1")
    nxt = F.lead("at").over(W.partitionBy("mold_no").orderBy("at", "order_key"))
    return rows.withColumn("ended_at", nxt).where(F.col("location") == at_machine).select("mold_no", F.col("at").alias("started_at"), "ended_at", "equipment", "order_key")


def resolve_runs(runs: DataFrame, tools: DataFrame, equipment: DataFrame) -> DataFrame:
    """Tools without a master row drop out; code and line come from the equipment, or as a
    whole from the tool's own row where the equipment is unknown."""
    t = tools.select("mold_no", F.col("equipment_code").alias("own_code"), F.col("line").alias("own_line"))
    out = runs.join(t.hint("merge"), "mold_no").join(equipment.withColumn("hit", F.lit(True)), "equipment", "left")
    pick = lambda a, b: F.when(F.col("hit"), F.col(a)).otherwise(F.col(b))
    return out.select("mold_no", "started_at", "ended_at", "equipment", pick("code", "own_code").alias("code"), pick("line", "own_line").alias("line"), F.col("hit").isNull().alias("fallback"), "order_key")


DAY = 86_400_000_000  # microseconds


def _covered(runs: DataFrame) -> DataFrame:
    """Adds first and last covered day and their number; null where a run is open or has no length."""
    span = F.unix_micros("ended_at") - F.unix_micros("started_at")
    n = F.when(span > 0, F.greatest(F.ceil(span / F.lit(DAY)), F.lit(1)).cast("int"))
    first = F.when(span > 0, F.to_date("started_at"))
    return runs.withColumn("days_expected", n.cast("long")).withColumn("first_day", first).withColumn("last_day", F.date_add(first, n - 1))


def run_days(runs: DataFrame) -> DataFrame:
    """One row for each covered day; ceil(duration / 24 h) days from the start date, one at least."""
    closed = _covered(runs).where("first_day is not null").withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    return closed.drop("days_expected", "first_day", "last_day")


def _of_codes(production: DataFrame, runs: DataFrame) -> DataFrame:
    """The production rows of codes that runs have; no other row can meet a run.

    The codes are written first: few of them are a small table, which Spark then joins before production is summed."""
    return production.join(staged(runs.select("code").where("code is not null").distinct(), "codes"), "code", "left_semi")


def defect_rates(runs: DataFrame, production: DataFrame, piece_days: int = 366) -> DataFrame:
    """Produced, defects, days found and expected, and rate = sum of defects / sum of production.

    A run's sums are the code's running totals up to its last day less those before its first.  Every day that a
    run asks for is sorted in once among the production rows of its code, which are summed up in pieces of
    ``piece_days``, the pieces then along their code: as many rows as there are, whatever days they span, and a
    task has one piece of a code.  Rows that repeat come out as often as they came in.
    """
    runs = staged(runs, "runs-to-rate")
    out = _covered(runs).withColumn("day_before", F.date_sub("first_day", 1))
    sums = ["produced", "defects", "found"]
    asked = out.where("first_day is not null and code is not null").select("code", F.explode(F.array("last_day", "day_before")).alias("day")).distinct()
    rows = _of_codes(production.where("code is not null and day is not null"), runs).select("code", "day", "produced", "defects", F.col("produced").isNotNull().cast("int").alias("found"), F.lit(False).alias("asked"))
    both = rows.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True).withColumn("piece", F.floor(F.unix_date("day") / piece_days))
    both = staged(both, "production-and-days")
    along = W.partitionBy("code").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    before = both.groupBy("code", "piece").agg(*[F.sum(c).alias(c) for c in sums])
    before = before.select("code", "piece", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"before_{c}") for c in sums])
    # on one day production stands before the asked day
    inside = W.partitionBy("code", "piece").orderBy("day", "asked").rowsBetween(W.unboundedPreceding, 0)
    at = both.select("code", "piece", "day", "asked", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in sums]).where("asked")
    at = at.join(before, ["code", "piece"]).select("code", "day", *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in sums])
    for edge in ("last_day", "day_before"):
        out = out.join(at.select("code", F.col("day").alias(edge), *[F.col(c).alias(f"{edge}_{c}") for c in sums]), ["code", edge], "left")
    less = {f"_{c}": F.coalesce(F.col(f"last_day_{c}") - F.col(f"day_before_{c}"), F.lit(0)) for c in sums}
    out = out.withColumns(less).withColumn("days_found", F.when(F.col("days_expected").isNotNull(), F.col("_found")))
    for c in ("produced", "defects"):
        out = out.withColumn(c, F.when(F.col("days_found") > 0, F.col(f"_{c}")))
    rate = F.try_divide(F.col("defects").cast("double"), F.col("produced").cast("double"))
    return out.select(*runs.columns, "produced", "defects", "days_found", "days_expected", rate.alias("rate"))


def daily_lists(runs: DataFrame, production: DataFrame, piece_days: int = 64) -> DataFrame:
    """(mold_no, started_at, order_key, defects_json): the production rows of a run's days as JSON.
    Runs without any are absent.

    A run meets the rows of its code in pieces of ``piece_days``, so it is one row for each piece and not for each day."""
    key = ["mold_no", "started_at", "order_key"]
    piece = lambda day: F.floor(F.unix_date(day) / piece_days)
    closed = _covered(runs.select(*key, "ended_at", "code")).where("first_day is not null and code is not null")
    spans = closed.select(*key, "code", "first_day", "last_day", F.explode(F.sequence(piece("first_day"), piece("last_day"))).alias("piece"))
    rows = _of_codes(production.where("code is not null and day is not null"), runs)
    held = rows.groupBy("code", piece("day").alias("piece")).agg(F.collect_list(F.struct("day", "produced", "defects")).alias("rows"))
    own = F.filter("rows", lambda r: r["day"].between(F.col("first_day"), F.col("last_day")))
    # by their files the sides may look small enough to broadcast when their rows are not
    days = spans.hint("merge").join(held, ["code", "piece"]).select(*key, own.alias("own")).where(F.size("own") > 0)
    return days.groupBy(*key).agg(F.to_json(F.array_sort(F.flatten(F.collect_list("own")))).alias("defects_json"))


def missing_days(runs: DataFrame, production: DataFrame) -> DataFrame:
    """A10: covered days without a production row for their code.

    Runs of a code are counted in and out by day, so a day that many runs cover is one row.
    """
    runs = _covered(runs.where("code is not null")).where("first_day is not null")
    steps = runs.select("code", F.explode(F.array(F.struct(F.col("first_day").alias("day"), F.lit(1).alias("n")), F.struct(F.date_add("last_day", 1).alias("day"), F.lit(-1).alias("n")))).alias("s"))
    steps = steps.groupBy("code", "s.day").agg(F.sum("s.n").alias("n"))
    w = W.partitionBy("code").orderBy("day")
    open_runs = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    held = steps.withColumn("open", open_runs).withColumn("next", F.lead("day").over(w)).where("open > 0")
    days = held.select("code", F.explode(F.sequence("day", F.date_sub("next", 1))).alias("day"))
    return days.join(_of_codes(production, runs).hint("merge"), ["day", "code"], "left_anti").select("day").distinct()


def losses(rejected: DataFrame, events: DataFrame, tools: DataFrame, equipment: DataFrame, rated: DataFrame, production: DataFrame) -> DataFrame:
    """A10: long table (kind, key, n) of everything dropped or unmatched."""
    def rows(df, kind, key):
        return df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")

    none = F.lit(None).cast("string")
    counts = rated.agg(F.count_if(F.col("ended_at").isNull()).alias("open_run"), F.count_if((F.col("ended_at") > F.col("started_at")) & (F.coalesce("days_found", F.lit(0)) == 0)).alias("unmatched_run"))
    left = counts.unpivot([], ["open_run", "unmatched_run"], "kind", "n")
    at = events.where(F.col("location") == S.AT_MACHINE)
    ids = tools.select("mold_no").hint("merge")  # by its file a table of tools may look small enough to broadcast when its rows are not
    known = at.join(ids, "mold_no", "left_semi").where("equipment is not null")
    parts = [
        rows(rejected, "rejected", F.col("reason")),
        rows(rejected.where("reason in ('no id', 'bad sheet name')"), "bad_sheet", F.coalesce(S.blank_to_null(F.col("sheet")), F.lit(NO_NAME))),
        rows(events.join(ids, "mold_no", "left_anti"), "unknown_tool", F.col("mold_no")),
        rows(known.join(equipment.select("equipment"), "equipment", "left_anti"), "unknown_equipment", F.col("equipment")),
        rows(missing_days(rated, production), "missing_day", F.col("day")),
        left.select("kind", none.alias("key"), "n").where("n > 0"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_locations(events: DataFrame) -> DataFrame:
    """Location of each tool's last event that has one; on equal times the later row."""
    some = events.where("at is not null and location <> ''")
    return some.groupBy("mold_no").agg(F.max_by("location", F.struct("at", "order_key")).alias("location"))


def tool_records(tools: DataFrame, rated: DataFrame, places: DataFrame) -> DataFrame:
    """One record per tool; 0 runs and no production are null, a rate of 0.0 is a rate.

    Of runs that start together the later row is the last."""
    order = F.struct("started_at", "order_key")
    per = rated.groupBy("mold_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("produced").alias("total_production"), F.max_by("rate", F.when(F.col("rate").isNotNull(), order)).alias("latest_defect_rate"),
        F.max_by(F.struct("line", "equipment"), order).alias("last"))
    out = tools.select("mold_no").join(places, "mold_no", "left").join(per, "mold_no", "left").where("location is not null or n is not null")
    status = S.status_from_location("location")
    using = status == "in_use"
    return out.select("mold_no", status.alias("status"), F.nullif("n", F.lit(0)).alias("total_installs"), "total_production", "latest_defect_rate", F.when(using, F.col("last.line")).alias("line"), F.when(using, F.col("last.equipment")).alias("machine"))


def install_seq(runs: DataFrame) -> DataFrame:
    """W9."""
    return runs.withColumn("install_seq", F.row_number().over(W.partitionBy("mold_no").orderBy("started_at", "order_key")))


def inspection_json(items: DataFrame) -> DataFrame:
    """(mold_no, order_key, items_json) of ``inspection_items`` rows: an array in their order, each with
    label, value, judgment (null) and source (file, sheet, cell as far as the rows have them)."""
    have = {c: F.col(f"source_{c}") if f"source_{c}" in items.columns else F.lit(None).cast("string") for c in ("file", "sheet", "cell")}
    one = F.struct("position", F.struct(F.col("item").alias("label"), "value", F.lit(None).cast("string").alias("judgment"), F.struct(*[v.alias(k) for k, v in have.items()]).alias("source")).alias("x"))
    per = items.groupBy("mold_no", "order_key").agg(F.array_sort(F.collect_list(one)).alias("p"))
    return per.select("mold_no", "order_key", F.to_json(F.transform("p", lambda x: x["x"]), {"ignoreNullFields": "false"}).alias("items_json"))


def inspection_items(rows: DataFrame) -> DataFrame:
    """Long (mold_no, position, item, value): known fields first, then the others in column order.

    ``values``: array of (field, position, value); nulls and the id itself are skipped.
    """
    first = F.array_position(F.array(*map(F.lit, ITEM_FIRST)), F.col("v.field"))
    out = rows.select(S.normalize_tool("mold_no").alias("mold_no"), "order_key", F.explode("values").alias("v")).where("v.value is not null and v.field <> 'mold_no'")
    rank = F.when(first > 0, first).otherwise(F.col("v.position") + 1000)
    return out.withColumn("position", F.row_number().over(W.partitionBy("mold_no", "order_key").orderBy(rank))).select("mold_no", "order_key", "position", F.col("v.field").alias("item"), F.col("v.value").alias("value"))


def attach_inspection(items: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items of known tools, orphan ids)."""
    known = records.select("mold_no").hint("merge")
    return items.join(known, "mold_no", "left_semi"), items.where("mold_no is not null").select("mold_no").distinct().join(known, "mold_no", "left_anti")


def list_tools(records: DataFrame, status=None, line=None, machine=None, q=None) -> DataFrame:
    """equality filters and a substring search on the id (% and _ are wildcards)."""
    for col, v in (("status", status), ("line", line), ("machine", machine)):
        if v is not None:
            records = records.where(F.col(col) == v)
    if q and q.strip():
        records = records.where(F.upper("mold_no").like(f"%{q.strip().upper()}%"))
    return records.orderBy("mold_no")


def stage_status(records: DataFrame, stages: DataFrame, runs: DataFrame) -> DataFrame:
    """Five stages as a map, missing by default; install is ok when a run exists, unless said otherwise."""
    default = F.create_map(*[x for s in STAGES for x in (F.lit(s), F.lit("missing"))])
    given = stages.groupBy("mold_no").agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("given"))
    used = runs.select("mold_no").distinct().withColumn("used", F.lit(True))
    out = records.select("mold_no").join(given, "mold_no", "left").join(used, "mold_no", "left")
    state = F.transform_values(default, lambda k, v: F.coalesce(F.try_element_at("given", k), F.when((k == "install") & F.col("used"), "ok"), v))
    return out.select("mold_no", state.alias("stage_status"))


def stage_panels(stages: DataFrame, names=("iqc", "pqc", "ai_recheck")) -> DataFrame:
    """The flexible stages with typed items (label, value, judgment, and source where it names a file); an empty
    source file is null, and so are error and updated_at where the table doesn't have them."""
    source = "struct<file:string,sheet:string,cell:string>"
    raw = F.from_json("items_json", f"array<struct<label:string,value:string,judgment:string,source:{source}>>")
    items = F.transform(raw, lambda i: F.struct(i["label"].alias("label"), i["value"].alias("value"), i["judgment"].alias("judgment"), F.when(i["source"]["file"] != "", i["source"]).alias("source")))
    more = [F.col(c) if c in stages.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("error", "string"), ("updated_at", "timestamp"))]
    return stages.where(F.col("stage").isin(*names)).select("mold_no", "stage", "status", items.alias("items"), F.when(F.col("source_file") != "", F.col("source_file")).alias("source_file"), *more)


def production_runs(runs: DataFrame, daily_json: str = "defects_json") -> DataFrame:
    """Runs in order with line, machine and rate, sums over their stored daily array, days covered and expected.

    Without a daily row nothing is known: the sums are null and not 0, while no day is covered; an open run has
    0 days to expect."""
    kind = "array<struct<day:date,produced:bigint,defects:bigint>>"
    total = lambda f: F.when(F.size("daily") > 0, F.aggregate("daily", F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d[f], F.lit(0))))
    out = _covered(runs.drop("days_expected").withColumn("daily", F.from_json(daily_json, kind)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select(
        "mold_no", "install_seq", "line", F.col("equipment").alias("machine"), "started_at", "ended_at", "rate", total("produced").alias("produced"), total("defects").alias("defects"),
        F.greatest(zero(F.size("daily")), F.lit(0)).alias("days_covered"), zero(F.col("days_expected")).alias("days_expected"))
    return staged(out, "production-runs").orderBy("mold_no", "install_seq")  # a sort by ranges reads its rows twice


def tool_detail(records: DataFrame, runs: DataFrame, panels: DataFrame, design: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """Every tool with its totals, runs in order, the open run, panels, design and stage map (the last two null when
    not given).  Without a run the number of installs is null, without production the total is."""
    run = F.struct("install_seq", "started_at", "ended_at", "line", "equipment", "produced", "defects", "rate")
    h = runs.groupBy("mold_no").agg(F.array_sort(F.collect_list(run)).alias("history"), F.count(F.lit(1)).alias("total_installs"), F.sum("produced").alias("total_production"), F.min("started_at").alias("first_installed_at"))
    p = panels.groupBy("mold_no").agg(F.array_sort(F.collect_list(F.struct("stage", "status", "source_file"))).alias("panels"))
    out = records.drop("total_installs", "total_production").join(h, "mold_no", "left").join(p, "mold_no", "left")
    out = out.withColumn("current", F.try_element_at(F.filter("history", lambda r: r["ended_at"].isNull()), F.lit(-1)))
    for name, more, kind in (("design", design, "string"), ("stage_status", stages, "map<string,string>")):
        out = out.join(more, "mold_no", "left") if more is not None else out.withColumn(name, F.lit(None).cast(kind))
    return out


def filter_options(records: DataFrame) -> DataFrame:
    """U4."""
    return records.where("line is not null and machine is not null").select("line", "machine").distinct().orderBy("line", "machine")


def defect_columns(daily: DataFrame) -> DataFrame:
    """One column per defect label in first-seen order; missing stays null.

    Labels become columns, so they are listed on the driver: a vocabulary, not data."""
    seen = daily.groupBy("label").agg(F.min("order_key").alias("k")).orderBy("k", "label")
    labels = [r[0] for r in seen.toLocalIterator()]
    return daily.groupBy("mold_no", "started_at").pivot("label", labels).agg(F.sum("n"))

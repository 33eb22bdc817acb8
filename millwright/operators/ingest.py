"""One ingest batch: from changed source files to published tables, or to a recorded reason why not."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators import cells as C
from millwright.operators import usage as U
from millwright.sources.staging import staged
from millwright.sources.tables import Store, change_set, merge_files

# The kinds of source files, those without which no batch runs, and those whose broken files
# are left out one by one.
KINDS = ["jig_master", "ees", "mes", "iqc"]
REQUIRED = ["jig_master", "ees"]
ISOLATED = ["mes", "iqc"]

#: Fields of the kinds that have a fixed set of them.
FIELDS = {
    "jig_master": ["mold_no", "jig_name", "equipment", "equipment_code", "line"],
    "ees": ["event_at", "location", "equipment"],
    "mes": ["run_date", "equipment_code", "produced", "defects"],
}

#: Reads the files of a table (path, kind, content_hash): (rows, failed files as path and reason).
Reader = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def cell_reader(cells: DataFrame, layouts: DataFrame, kind: str) -> Reader:
    """A reader for ``run_batch`` over the cells of all files: rows of ``kind`` with the columns that ``assemble`` takes.

    ``cells.read_sheets`` picks the layouts and names the files that fail; a file without cells fails too.
    Rows keep the order of path, sheet and row: a later file's row is the later one.
    """
    layouts = layouts.where(F.col("kind") == kind)

    def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = cells.join(files.select(F.col("path").alias("source_file")), "source_file", "left_semi")
        rows, failed = C.read_sheets(own, layouts)
        empty = files.select("path").join(own.select(F.col("source_file").alias("path")).distinct(), "path", "left_anti").withColumn("reason", F.lit("no cells"))
        order = F.struct("source_file", "sheet", "table_no", "row_no").alias("order_key")
        field = lambda name: F.try_element_at("values", F.lit(name)).alias(name)
        if kind == "iqc":
            each = F.map_entries("values")
            values = F.transform(each, lambda e, k: F.struct(e["key"].alias("field"), k.alias("position"), e["value"].alias("value"))).alias("values")
            out = rows.select(field("mold_no"), order, values)
        else:
            out = rows.select("sheet", order, *map(field, FIELDS[kind]))
        return out, failed.withColumnRenamed("source_file", "path").unionByName(empty)

    return read


def assemble(master: DataFrame, ledger: DataFrame, production: DataFrame, inspection: DataFrame) -> dict[str, DataFrame]:
    """Tool records, their runs, inspection items and everything that was lost on the way.

    ``inspection`` has the rows that ``usage.inspection_items`` takes.  What is read more than once is
    written first.
    """
    tools, dropped = U.tool_index(master)
    equipment = U.equipment_index(master)
    events, rejected = U.clean_ledger(ledger)
    by_day, unreadable = U.production_index(production)
    tools, events, by_day = (staged(x, name) for x, name in ((tools, "tools"), (events, "events"), (by_day, "production")))
    runs = U.resolve_runs(U.pair_runs(events), tools, equipment)
    rated = staged(U.install_seq(U.defect_rates(runs, by_day)), "rated-runs")
    records = staged(U.tool_records(tools, rated, U.latest_locations(events)), "records")
    items = staged(U.inspection_items(inspection), "items")
    known, orphans = U.attach_inspection(items, records)
    lost = U.losses(rejected, events, tools, equipment, rated, by_day)
    more = [
        (dropped.select("reason"), "dropped_master", F.col("reason")),
        (unreadable.select(F.lit("unreadable").alias("reason")), "production_row", F.col("reason")),
        (inspection.where(U.S.normalize_tool("mold_no").isNull()), "skipped_row", F.lit(None).cast("string")),
        (orphans, "orphan_tool", F.col("mold_no")),
    ]
    for rows, kind, key in more:
        lost = lost.unionByName(rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n"))
    daily = U.daily_lists(rated, by_day)
    runs = rated.join(daily, ["mold_no", "started_at", "order_key"], "left")
    return {"records": records, "runs": runs, "items": known, "losses": lost}


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts of an assembled batch."""
    lost = tables["losses"].groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
    of = lambda kind, col: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(col))), F.lit(0)).cast("long")
    lost = lost.agg(
        of("rejected", "n").alias("rejected_events"), of("unknown_tool", "keys").alias("unknown_tools"), of("unknown_equipment", "keys").alias("unknown_equipment"),
        of("missing_day", "keys").alias("missing_days"), of("open_run", "n").alias("open_runs"), of("unmatched_run", "n").alias("unmatched_runs"),
        of("orphan_tool", "keys").alias("orphans"), (of("skipped_row", "n") + of("bad_sheet", "n")).alias("skipped_rows"))
    tools = tables["records"].agg(F.count(F.lit(1)).alias("tools"))
    matched = tables["items"].agg(F.count_distinct("mold_no").alias("inspected"))
    runs = tables["runs"].agg(F.count(F.lit(1)).alias("runs"))
    out = tools.withColumn("_k", F.lit(1))
    for one in (runs, matched, lost):  # one row each
        out = out.join(one.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def run_batch(store: Store, found: DataFrame, readers: dict[str, Reader], now: datetime | None = None) -> dict:
    """Read what changed, assemble, publish; returns and records what happened.

    ``found`` comes from ``tables.scan``.  Any unreadable file, or no change since the last batch, skips the
    batch; a missing required kind, or a broken file of one, is an error and the old tables stay.  Broken
    files of the other kinds are left out and listed.  Records, runs, items, losses and the file registry
    become visible together.
    """
    now = now or datetime.now(timezone.utc)
    entry = {"started_at": now.isoformat()}
    try:
        entry |= _batch(store, staged(found.where(F.col("kind").isin(KINDS)), "found"), readers, now)
    except Exception as e:  # the batch's own record must not be lost with it
        entry |= {"status": "error", "error": f"{type(e).__name__}: {e}"[:2000]}
    store.record_run(entry)
    return entry


def _paths(df: DataFrame) -> list[str]:
    return [r[0] for r in df.select("path").orderBy("path").collect()]  # a list of files, for the record


def _batch(store: Store, found: DataFrame, readers: dict[str, Reader], now: datetime) -> dict:
    out = {"files": _paths(found)}
    if bad := _paths(found.where("content_hash is null")):
        return out | {"status": "skipped", "unreadable_files": bad}
    known = store.load("files") if store.has("files") else found.where("false").withColumn("seen_at", F.lit(None).cast("timestamp"))
    if not change_set(found, known).where("change <> 'same'").limit(1).count():
        return out | {"status": "skipped"}
    kinds = {r[0] for r in found.select("kind").distinct().collect()}
    for kind in REQUIRED:
        if kind not in kinds:
            return out | {"status": "error", "error": f"no file of kind {kind}"}
    rows, failed = {}, []
    for kind in KINDS:
        rows[kind], broken = readers[kind](found.where(F.col("kind") == kind))
        names = [f"{r.path}: {r.reason}" for r in broken.select("path", "reason").orderBy("path").collect()]
        if names and kind not in ISOLATED:
            return out | {"status": "error", "error": names[0]}
        failed += names
    tables = assemble(rows["jig_master"], rows["ees"], rows["mes"], rows["iqc"])
    counts = summary(tables).first().asDict()
    store.replace_all(tables | {"files": merge_files(found, now)})
    return out | {"status": "ok", "failed_files": failed} | counts

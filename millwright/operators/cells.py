"""Spreadsheet cells as a long table: search, profile, outline, layout matching and row extraction.

cells: source_file, kind, sheet, row_no, col_no, cell_type, text, num, ts, bool.  Absent cells are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions import scalars as S

SHEET = ["source_file", "sheet"]


def cell_text():
    return S.cell_to_text("cell_type", "text", "num", "ts", "bool")


def read_range(cells: DataFrame, top: int, left: int, rows: int = 30, cols: int = 30) -> DataFrame:
    """A rectangle, capped, with flags for what was cut off; the cap is the feature."""
    inside = F.col("row_no").between(top, top + rows - 1) & F.col("col_no").between(left, left + cols - 1)
    used = used_shape(cells)
    cut = used.select(*SHEET, (F.col("last_row") > top + rows - 1).alias("rows_cut"), (F.col("last_col") > left + cols - 1).alias("cols_cut"))
    return cells.where(inside).join(cut, SHEET)


def used_shape(cells: DataFrame) -> DataFrame:
    """S6."""
    return cells.groupBy(*SHEET).agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.min("col_no").alias("first_col"), F.max("col_no").alias("last_col"))


def column_values(cells: DataFrame, col_no: int, most_rows: int = 5000) -> DataFrame:
    """One column of the first ``most_rows`` rows of the used range."""
    used = used_shape(cells).select(*SHEET, "first_row")
    return cells.where(F.col("col_no") == col_no).join(used, SHEET).where(F.col("row_no") < F.col("first_row") + most_rows).drop("first_row")


def search(cells: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """F16: first hits of each sheet in row order with their address; ``truncated`` tells of more."""
    t = cell_text()
    hit = cells.withColumn("value", t).where(F.contains(F.lower("value"), F.lit(query.lower())))
    k = F.row_number().over(W.partitionBy(*SHEET).orderBy("row_no", "col_no"))
    n = F.count(F.lit(1)).over(W.partitionBy(*SHEET))
    out = hit.withColumn("k", k).withColumn("n", n).where(F.col("k") <= limit)
    return out.select(*SHEET, F.concat(S.column_letters("col_no"), F.col("row_no").cast("string")).alias("cell"), "value", (F.col("n") > limit).alias("truncated"))


def profile(cells: DataFrame, sample: int = 5) -> DataFrame:
    """Count, nonnull, nulls, distinct and type counts of every column; empty cells of the used
    range count as null.  Samples are the first distinct rows' texts in order."""
    used = used_shape(cells).withColumn("rows", F.col("last_row") - F.col("first_row") + 1).select(*SHEET, "rows")
    v = cells.withColumn("value", cell_text()).withColumn("kind", S.type_name("cell_type")).where("value is not null")
    first = F.row_number().over(W.partitionBy(*SHEET, "col_no").orderBy("row_no"))
    kinds = ("bool", "datetime", "int", "float", "str", "other")
    out = v.withColumn("k", first).groupBy(*SHEET, "col_no").agg(
        F.count("value").alias("nonnull"), F.count_distinct("value").alias("n_distinct"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= sample, F.struct("k", "value")))), lambda s: s["value"]).alias("samples"))
    return out.join(used, SHEET).withColumn("count", F.col("rows")).withColumn("nulls", F.col("rows") - F.col("nonnull")).drop("rows")


AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def aggregate(cells: DataFrame, op: str) -> DataFrame:
    """Over the numeric cells (bool is not a number); nothing gives 0.0; an unknown op is an error."""
    if op not in AGGREGATES:
        raise ValueError(f"unknown aggregate {op!r}")
    v = F.when(F.col("cell_type").isin("int", "float"), F.col("num"))
    return cells.groupBy(*SHEET).agg(F.coalesce(AGGREGATES[op](v).cast("double"), F.lit(0.0)).alias("value"), F.count(v).alias("numeric_count"))


def reconcile(rows: DataFrame, group: str, label: str, months: list[str], words=("소계",)) -> DataFrame:
    """Sums of plain rows against their subtotal rows, month by month."""
    long = rows.unpivot([group, label], months, "month", "n")
    is_total = F.lit(False)
    for w in words:
        is_total = is_total | F.coalesce(F.contains(F.col(label), F.lit(w)), F.lit(False))
    out = long.groupBy(group, "month").agg(F.sum(F.when(~is_total, F.col("n"))).alias("summed"), F.sum(F.when(is_total, F.col("n"))).alias("stated"))
    return out.withColumn("difference", F.col("summed") - F.col("stated"))


def outline(cells: DataFrame, sample: int = 4, width: int = 24) -> DataFrame:
    """Consecutive rows of equal shape as one line; empty rows of the used range count."""
    cell = F.struct("col_no", S.type_name("cell_type").alias("kind"), F.substring(cell_text(), 1, width).alias("value"))
    rows = cells.where(cell_text().isNotNull()).groupBy(*SHEET, "row_no").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    every = used_shape(cells).select(*SHEET, F.explode(F.sequence("first_row", "last_row")).alias("row_no"))
    none = F.array().cast("array<struct<col_no:int,kind:string,value:string>>")
    rows = every.join(rows, [*SHEET, "row_no"], "left").withColumn("cells", F.coalesce(F.col("cells").cast("array<struct<col_no:int,kind:string,value:string>>"), none))
    rows = rows.withColumn("shape", F.transform("cells", lambda c: F.struct(c["col_no"].alias("c"), c["kind"].alias("k"))))
    w = W.partitionBy(*SHEET).orderBy("row_no")
    rows = rows.withColumn("new", F.coalesce((F.col("shape") != F.lag("shape").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("line", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    head = F.min_by("cells", "row_no")
    return rows.groupBy(*SHEET, "line").agg(
        F.min("row_no").alias("from_row"), F.max("row_no").alias("to_row"), F.size(head).alias("filled"), F.array_min(F.transform(head, lambda c: c["col_no"])).alias("from_col"),
        F.array_max(F.transform(head, lambda c: c["col_no"])).alias("to_col"), F.slice(F.transform(head, lambda c: c["value"]), 1, sample).alias("samples"))


def format_rows(cells: DataFrame) -> DataFrame:
    """Each row of the used range as tab-separated text behind its number, empty cells as a dot; the
    row before the first holds the column letters, so that every value stands below its letter."""
    used = used_shape(cells)
    text = cells.groupBy(*SHEET, "row_no").agg(F.map_from_entries(F.collect_list(F.when(cell_text().isNotNull(), F.struct("col_no", cell_text().alias("v"))))).alias("m"))
    every = used.withColumn("row_no", F.explode(F.sequence(F.col("first_row") - 1, F.col("last_row"))))
    cols = F.sequence("first_col", "last_col")
    head = F.array_join(F.transform(cols, S.column_letters), "\t")
    body = F.array_join(F.transform(cols, lambda c: F.coalesce(F.try_element_at("m", c), F.lit("·"))), "\t")
    is_head = F.col("row_no") < F.col("first_row")
    line = F.when(is_head, F.concat(F.lit("\t"), head)).otherwise(F.concat(F.col("row_no").cast("string"), F.lit("\t"), body))
    return every.join(text, [*SHEET, "row_no"], "left").select(*SHEET, "row_no", line.alias("line"))


def sheet_names(cells: DataFrame) -> DataFrame:
    """The sheets of every file."""
    return cells.select(*SHEET).distinct()


def matching_layouts(cells: DataFrame, layouts: DataFrame, least: int = 3) -> DataFrame:
    """Every layout of the sheet's kind whose anchors all match; fewer than ``least`` never match.

    Only cells at anchors are joined; layouts are few and broadcast, whatever Spark takes their size for.  An anchor
    with an empty text matches an empty cell and one that isn't there.
    """
    a = layouts.select("id", "kind", F.size("anchors").alias("need"), F.explode("anchors").alias("a")).where(F.col("need") >= least)
    a = a.withColumn("at", S.a1_row_col("a.cell")).select("id", "kind", "need", F.col("at.row_no").alias("row_no"), F.col("at.col_no").alias("col_no"), S.normalize_text("a.text").alias("want"))
    a = a.withColumn("need", F.col("need") - F.sum((F.col("want") == "").cast("int")).over(W.partitionBy("id", "kind")))
    met = cells.withColumn("value", S.normalize_text(cell_text())).join(F.broadcast(a), ["kind", "row_no", "col_no"]).where("value = want or want = ''")
    per = met.groupBy(*SHEET, "id", "need").agg(F.count_if((F.col("want") != "") & (F.col("value") == F.col("want"))).alias("n"), F.count_if((F.col("want") == "") & (F.col("value") != "")).alias("against"))
    return per.where("n = need and against = 0").select(*SHEET, F.col("id").alias("layout_id"))


def pick_layout(cells: DataFrame, layouts: DataFrame, least: int = 3) -> DataFrame:
    """The newest of a sheet's ``matching_layouts``."""
    return matching_layouts(cells, layouts, least).groupBy(*SHEET).agg(F.max("layout_id").alias("layout_id"))


def _tables(layouts: DataFrame, role: str | None = "detail") -> DataFrame:
    t = layouts.select(F.col("id").alias("layout_id"), "key_values", F.posexplode("tables").alias("table_no", "t"))
    t = t if role is None else t.where(F.col("t.role") == role)
    return t.select("layout_id", "table_no", "key_values", F.col("t.data_start_row").alias("start"), F.col("t.data_end_row").alias("end"), F.col("t.columns").alias("columns"))


def table_rows(cells: DataFrame, picked: DataFrame, layouts: DataFrame, raw: bool = False, role: str | None = "detail") -> DataFrame:
    """R2, R4 shared: one row for each consumed data row of every detail table with its mapped cells.

    With an end row blank rows are skipped, without one the first blank row ends the table.  ``raw``
    calls a row blank only when its cells are absent (R4), else when they hold no text (R2).
    """
    t = picked.join(_tables(layouts, role), "layout_id").join(used_shape(cells).select(*SHEET, "last_row"), SHEET)
    last = F.least(F.coalesce("end", "last_row"), F.col("last_row"))
    rows = t.where(last >= F.col("start")).withColumn("row_no", F.explode(F.sequence("start", last)))
    cols = rows.select(*SHEET, "layout_id", "table_no", "end", "row_no", F.posexplode("columns").alias("position", "c"))
    cols = cols.select("*", F.col("c.field").alias("field"), S.a1_column("c.column").alias("col_no"))
    value = cells.select(*SHEET, "row_no", "col_no", cell_text().alias("value"), F.lit(True).alias("there"))
    # by their files cells may look small enough to broadcast when their rows are not
    got = cols.join(value.hint("merge"), [*SHEET, "row_no", "col_no"], "left")
    blank = F.max(F.col("there").isNotNull() if raw else F.col("value").isNotNull())
    per = got.groupBy(*SHEET, "layout_id", "table_no", "end", "row_no").agg((~blank).alias("blank"), F.array_sort(F.collect_list(F.struct("position", "field", "value"))).alias("values"))
    stop = F.min(F.when(F.col("end").isNull() & F.col("blank"), F.col("row_no"))).over(W.partitionBy(*SHEET, "table_no"))
    per = per.withColumn("stop", stop).where("stop is null or row_no < stop")
    return per.drop("stop", "end")


def parse_rows(cells: DataFrame, picked: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows as map(field -> text); sheet-level values are defaults that a column's value
    overrides even when it is null.  A sheet without a detail table gives one key-value row, number 1.

    Of fields that a layout names twice the last counts.  Detail tables of ``layout_errors`` give no rows here;
    ``read_sheets`` reports them."""
    kv = picked.join(layouts.select(F.col("id").alias("layout_id"), F.posexplode("key_values").alias("position", "k")), "layout_id")
    kv = kv.withColumn("at", S.a1_row_col("k.value_cell")).select(*SHEET, "position", F.col("k.field").alias("field"), F.col("at.row_no").alias("row_no"), F.col("at.col_no").alias("col_no"))
    kv = kv.join(cells.select(*SHEET, "row_no", "col_no", cell_text().alias("value")).hint("merge"), [*SHEET, "row_no", "col_no"], "left")
    kv = kv.groupBy(*SHEET, "field").agg(F.max_by(F.struct("value"), "position").alias("v"))
    defaults = kv.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("field", "v.value"))).alias("defaults"))
    last = F.filter("values", lambda v: ~F.exists("values", lambda w: (w["field"] == v["field"]) & (w["position"] > v["position"])))
    rows = table_rows(cells, picked, layouts).where("not blank").select(*SHEET, "table_no", "row_no", F.map_from_entries(F.transform(last, lambda v: F.struct(v["field"], v["value"]))).alias("values"))
    none = F.create_map().cast("map<string,string>")
    own = F.col("values")
    merged = F.map_concat(F.map_filter(F.coalesce("defaults", none), lambda k, v: ~F.map_contains_key(own, k)), own)
    detail = rows.join(defaults, SHEET, "left").select(*SHEET, "table_no", "row_no", merged.alias("values"))
    single = picked.join(_tables(layouts).select("layout_id").distinct(), "layout_id", "left_anti").join(defaults, SHEET).select(*SHEET, F.lit(-1).alias("table_no"), F.lit(1).alias("row_no"), F.col("defaults").alias("values"))
    return detail.unionByName(single)


def read_sheets(cells: DataFrame, layouts: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(``parse_rows`` of all sheets, failed files as source_file and reason).

    Every sheet takes the newest of its matching layouts that can be parsed.  A sheet without any, or whose
    layouts are all of ``layout_errors``, fails its file, and a failed file gives no rows at all; of several
    reasons the first by sheet is told.
    """
    found = matching_layouts(cells, layouts, least)
    errors = layout_errors(layouts).groupBy("layout_id").agg(F.min_by("error", "table_no").alias("error"))
    found = found.join(errors, "layout_id", "left")
    per = found.groupBy(*SHEET).agg(F.max(F.when(F.col("error").isNull(), F.col("layout_id"))).alias("layout_id"), F.max_by("error", "layout_id").alias("error"))
    sheets = sheet_names(cells).join(per, SHEET, "left").withColumn("reason", F.when(F.col("layout_id").isNull(), F.concat("sheet", F.lit(": "), F.coalesce("error", F.lit("no layout")))))
    failed = sheets.where("reason is not null").groupBy("source_file").agg(F.min_by("reason", "sheet").alias("reason"))
    picked = sheets.where("layout_id is not null").join(failed.select("source_file"), "source_file", "left_anti").select(*SHEET, "layout_id")
    return parse_rows(cells, picked, layouts), failed


def layout_errors(layouts: DataFrame) -> DataFrame:
    """R2: detail tables without columns or that end before they start."""
    bad = F.when(F.size("columns") == 0, "no columns").when(F.col("end") < F.col("start"), "end before start")
    return _tables(layouts).withColumn("error", bad).where("error is not null").select("layout_id", "table_no", "error")


def layout_gaps(cells: DataFrame, picked: DataFrame, layouts: DataFrame, least: int = 3, hint: int = 12) -> tuple[DataFrame, DataFrame]:
    """(filled but unmapped columns of each detail table with the first text in them, header rows
    first; per sheet the rows with ``least`` filled cells that no table and no key-value covers, folded
    into ranges)."""
    used = table_rows(cells, picked, layouts, raw=True).select(*SHEET, "layout_id", "table_no", "row_no")
    t = layouts.select(F.col("id").alias("layout_id"), "key_values", F.posexplode("tables").alias("table_no", "t"))
    heads = picked.join(t.select("layout_id", "table_no", F.explode("t.header_rows").alias("row_no")), "layout_id").select(*used.columns)
    inside = used.withColumn("head", F.lit(1)).unionByName(heads.withColumn("head", F.lit(0))).groupBy(*used.columns).agg(F.min("head").alias("head"))
    filled = cells.withColumn("value", cell_text()).where("value is not null").select(*SHEET, "row_no", "col_no", "value")
    mapped = _tables(layouts).select("layout_id", "table_no", F.explode("columns").alias("c")).select("layout_id", "table_no", S.a1_column("c.column").alias("col_no"))
    detail = inside.join(_tables(layouts).select("layout_id", "table_no").distinct(), ["layout_id", "table_no"], "left_semi")
    seen = filled.hint("merge").join(detail, [*SHEET, "row_no"]).groupBy(*SHEET, "layout_id", "table_no", "col_no").agg(F.min_by("value", F.struct("head", "row_no")).alias("v"))
    columns = seen.join(mapped, ["layout_id", "table_no", "col_no"], "left_anti").withColumn("column", S.column_letters("col_no"))
    columns = columns.withColumn("hint", F.when(F.length("v") > hint, F.concat(F.substring("v", 1, hint), F.lit("…"))).otherwise(F.col("v"))).drop("v")

    # rows of any table from its first header row on, and rows of key-values, are covered
    start = picked.join(t, "layout_id").select(*SHEET, "layout_id", "table_no", F.array_min(F.concat("t.header_rows", F.array("t.data_start_row"))).alias("lo"), (F.col("t.data_start_row") - 1).alias("hi"))
    before = start.where("hi >= lo").select(*SHEET, F.explode(F.sequence("lo", "hi")).alias("row_no"))
    keys = picked.join(layouts.select(F.col("id").alias("layout_id"), F.explode("key_values").alias("k")), "layout_id").select(*SHEET, F.explode(F.array("k.value_cell", "k.label_cell")).alias("cell"))
    keys = keys.where("cell is not null").select(*SHEET, S.a1_row_col("cell")["row_no"].alias("row_no"))
    other = table_rows(cells, picked, layouts, raw=True, role=None).select(*SHEET, "row_no")
    covered = other.unionByName(before).unionByName(keys).unionByName(heads.select(*SHEET, "row_no")).distinct()
    thick = filled.groupBy(*SHEET, "row_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    open_rows = thick.join(covered.hint("merge"), [*SHEET, "row_no"], "left_anti").join(picked.select(*SHEET), SHEET, "left_semi")
    island = F.col("row_no") - F.row_number().over(W.partitionBy(*SHEET).orderBy("row_no"))
    ranges = open_rows.withColumn("i", island).groupBy(*SHEET, "i").agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    folded = F.array_sort(F.collect_list(F.struct("lo", label.alias("r"))))
    return columns, ranges.groupBy(*SHEET).agg(F.array_join(F.transform(folded, lambda x: x["r"]), ", ").alias("rows"))

"""The driver's tables in the roles of the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = [("click", "input", "control", 1), ("signup", "input", "control", 2), ("error", "input", "control", None), ("view", "output", "loading_level", 1), ("purchase", "output", "loading_level", 2), ("pump", "input", "control", None)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "item_id string, io string, role string, zone int")


def readings(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("lot_id"), F.date_trunc("hour", "ts").alias("worked_at"), (F.col("user_id") % 5).cast("string").alias("product"),
        F.col("event_type").alias("item_id"), F.floor(F.col("value") / 10).cast("double").alias("value"), F.col("event_id").alias("row_no"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """``ledger_rows`` as people keep it: padded cells, events without a place, sheets that are no tool, equal times."""
    k = F.col("order_key")
    place = F.when(k % 41 == 0, None).when(k % 43 == 0, F.concat(F.lit(" "), "location", F.lit("\u3000"))).otherwise(F.col("location"))
    sheet = F.when(k % 53 == 0, "Sheet1").when(k % 59 == 0, " ").otherwise(F.col("sheet"))
    at = F.when(k % 5 == 0, F.concat(F.substring("event_at", 1, 7), F.lit("-01"))).otherwise(F.col("event_at"))
    pad = F.when(k % 37 == 0, F.concat(F.lit("\t"), "equipment", F.lit(" "))).otherwise(F.col("equipment"))
    return ledger_rows(spark, d).withColumns({"location": place, "sheet": sheet, "event_at": at, "equipment": pad})


def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600)
    place = F.when(F.col("o_orderstatus") == "O", "설비").when(F.col("o_orderstatus") == "F", "수리실").otherwise("보관함")
    return _t(spark, d, "orders").select(
        F.concat(F.lit("RX"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("sheet"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("event_at"), place.alias("location"),
        F.concat(F.lit("EQ"), (F.col("o_orderkey") % 120).cast("string")).alias("equipment"), F.col("o_orderkey").alias("order_key"))


def master(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").where("c_custkey % 10 <> 0").select(
        F.concat(F.lit("#rx"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("mold_no"), F.col("c_name").alias("jig_name"), F.concat(F.lit("EQ"), (F.col("c_custkey") % 100).cast("string"), F.when(F.col("c_custkey") % 17 == 0, " ").otherwise("")).alias("equipment"),
        (F.col("c_custkey") % 100).cast("string").alias("equipment_code"), F.concat(F.lit("L"), F.col("c_nationkey").cast("string")).alias("line"), F.col("c_custkey").alias("order_key"))


def production(spark: SparkSession, d: str) -> DataFrame:
    defects = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    rows = _t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").cast("string").alias("code"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("produced"), defects.cast("long").alias("defects"))


def finals(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("lot_id"), F.col("o_custkey").alias("product"), F.col("o_orderdate").alias("worked_at"), F.col("o_totalprice").alias("os_gap"), (F.col("o_orderkey") % 97).cast("double").alias("ds_gap"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Each brand is a sheet; its rows follow each other with a header row on top."""
    from pyspark.sql import Window as W

    none = F.lit(None)

    def cell(col: int, kind: str, text=none, num=none):
        return F.struct(F.lit(col).alias("col_no"), F.lit(kind).alias("cell_type"), text.cast("string").alias("text"), num.cast("double").alias("num"), none.cast("timestamp").alias("ts"), none.cast("boolean").alias("bool"))

    p = _t(spark, d, "part").withColumn("row_no", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) + 1)
    body = p.select("p_brand", "row_no", F.explode(F.array(cell(1, "str", F.col("p_name")), cell(2, "str", F.col("p_type")), cell(3, "int", num=F.col("p_size")), cell(4, "float", num=F.col("p_retailprice")))).alias("c"))
    head = p.select("p_brand").distinct().select("p_brand", F.lit(1).alias("row_no"), F.explode(F.array(cell(1, "str", F.lit("Name")), cell(2, "str", F.lit("Type")), cell(3, "str", F.lit("Size")))).alias("c"))
    out = body.unionByName(head)
    return out.select(F.lit("part").alias("source_file"), F.lit("catalog").alias("kind"), F.col("p_brand").alias("sheet"), "row_no", "c.*")


LAYOUT = "id long, kind string, sheet_name string, key_values array<struct<field:string,value_cell:string,label_cell:string>>, tables array<struct<name:string,role:string,category:string,header_rows:array<int>,data_start_row:int,data_end_row:int,columns:array<struct<field:string,column:string>>>>, anchors array<struct<cell:string,text:string>>, notes string"


def layouts(spark: SparkSession) -> DataFrame:
    columns = [("name", "A"), ("type", "B"), ("size", "C")]
    old = (1, "catalog", "x", [], [("t", "detail", None, [1], 2, None, columns)], [("A1", "other"), ("B1", "Type"), ("C1", "Size")], None)
    new = (2, "catalog", "x", [("title", "A1", None)], [("t", "detail", None, [1], 2, None, columns)], [("A1", " name "), ("B1", "TYPE"), ("C1", "Size")], None)
    return spark.createDataFrame([old, new], LAYOUT)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))

"""The gram index against a scan for every word."""

import pytest
from pyspark.sql import functions as F

from millwright.operators import cells as C
from millwright.operators import search as X
from millwright.plans import views as V

SMALL = "/root/testdata/sf0.001"
WORDS = ["ring", "RING", "in", "g", "tin bra", "설비", "a_b", "%", "no such text", "", None, "ring", "İ", "1", "12", ".5", " "]


def sheets(spark):
    more = [("k.xlsx", "a", 1, 1, "설비 A_B"), ("k.xlsx", "a", 1, 2, "설 비"), ("k.xlsx", "b", 900, 28, "x%y"), ("k.xlsx", "b", 2, 3, "i̇İ")]
    own = spark.createDataFrame([(f, "k", s, r, c, "str", t, None, None, None) for f, s, r, c, t in more], V.cells(spark, SMALL).select("source_file", "kind", "sheet", "row_no", "col_no", "cell_type", "text", "num", "ts", "bool").schema)
    return V.cells(spark, SMALL).select(own.columns).unionByName(own)


@pytest.mark.parametrize("rows, rarest", [(1, 3), (7, 1), (500, 2)])
def test_equals_the_scan(spark, tmp_path, rows, rarest):
    cells = sheets(spark)
    X.build_index(cells, f"{tmp_path}/i", rows)
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    got = X.search_many(cells, spark.read.parquet(f"{tmp_path}/i"), words, rows, rarest).collect()
    text = cells.withColumn("value", C.cell_text()).where("value is not null").collect()
    lower = dict(spark.createDataFrame([(w, w) for w in {r.value for r in text} | {w for w in WORDS if w}], "w string, l string").select("w", F.lower("l")).collect())  # as Spark lowers
    want = sorted((w, r.source_file, r.sheet, r.row_no, r.value) for w in {w for w in WORDS if w} for r in text if lower[w] in lower[r.value])
    assert sorted((r.word, r.source_file, r.sheet, int("".join(c for c in r.cell if c.isdigit())), r.value) for r in got) == want
    assert {r.word for r in got} >= {"ring", "RING", "in", "g", "설비", "a_b", "%"} and "no such text" not in {r.word for r in got}
    assert {r.cell for r in got if r.word == "%"} == {"AB900"}


def test_reads_only_the_parts_of_its_grams(spark, tmp_path):
    cells = sheets(spark)
    X.build_index(cells, f"{tmp_path}/i", 50)
    index = spark.read.parquet(f"{tmp_path}/i")
    read = []
    where = type(index).where

    def seen(self, condition):
        out = where(self, condition)
        if "part" in self.columns and "block" in self.columns:
            read.append(len(out.inputFiles()) and out.select("part").distinct().count())
        return out

    type(index).where = seen
    try:
        found = X.search_many(cells, index, spark.createDataFrame([("ring",)], "word string"), 50)
    finally:
        type(index).where = where
    assert found.count() > 0 and read and read[0] <= 2  # "rin" and "ing"


def test_no_words_and_no_cells(spark, tmp_path):
    cells = sheets(spark)
    X.build_index(cells, f"{tmp_path}/i", 50)
    index = spark.read.parquet(f"{tmp_path}/i")
    assert X.search_many(cells, index, spark.createDataFrame([], "word string"), 50).count() == 0

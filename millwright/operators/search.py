"""Many search words over many sheets: an index of grams finds the blocks of rows that can hold a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import scalars as S
from millwright.operators.cells import SHEET, cell_text
from millwright.sources.staging import staged

PARTS = 64
BLOCK = [*SHEET, "block"]


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def grams(text: Column, lengths: Column) -> Column:
    """The distinct grams of a text of each length."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def _block(rows: int) -> Column:
    return F.floor(F.col("row_no") / rows)


def build_index(cells: DataFrame, path: str, rows: int = 500) -> None:
    """Writes (part, gram, source_file, sheet, block): the one-, two- and three-letter grams of the cells of every block of
    ``rows`` rows, each once, in folders by ``part`` and sorted by gram within."""
    text = F.lower(cell_text())
    each = cells.select(*SHEET, _block(rows).alias("block"), F.explode(grams(text, F.array(*map(F.lit, (1, 2, 3))))).alias("gram")).distinct()
    each = each.withColumn("part", _part(F.col("gram"))).repartition(PARTS, "part").sortWithinPartitions("part", "gram")
    each.write.partitionBy("part").parquet(path)


def search_many(cells: DataFrame, index: DataFrame, words: DataFrame, rows: int = 500, rarest: int = 3) -> DataFrame:
    """F16 for a table of words: (word, source_file, sheet, cell, value) of every cell that contains the word, whatever the case.

    A word is looked up by its ``rarest`` grams of three letters (a shorter word by itself as one gram); blocks that
    have them all are read and their cells compared, so the result is that of a scan.  Only the index folders
    of those grams are read.  ``rows`` must be that of the index.  Null and empty words find nothing, words that
    differ in case only are words of their own, and a word that repeats is searched once.
    """
    asked = words.select(F.col("word").cast("string").alias("word")).where("word <> ''").distinct()
    size = F.least(F.length(F.lower("word")), F.lit(3))
    asked = asked.select("word", F.explode(grams(F.lower("word"), F.array(size))).alias("gram")).withColumn("part", _part(F.col("gram")))
    asked = staged(asked, "search-grams")
    parts = [r[0] for r in asked.select("part").distinct().collect()]  # PARTS at most
    held = staged(index.where(F.col("part").isin(parts)).join(asked.select("part", "gram").distinct(), ["part", "gram"], "left_semi"), "search-postings")
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no block has makes its word impossible; it is the rarest of all
    few = asked.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = few.groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, rarest).alias("g"))
    few = few.select("word", F.size("g").alias("need"), F.explode("g.gram").alias("gram"))
    # by their files postings and cells may look small enough to broadcast when their rows are not
    met = few.join(held.hint("merge"), "gram").groupBy("word", "need", *BLOCK).agg(F.count(F.lit(1)).alias("n")).where("n = need").select("word", *BLOCK)
    some = cells.withColumn("block", _block(rows)).withColumn("value", cell_text())
    found = met.hint("merge").join(some, BLOCK).where(F.contains(F.lower("value"), F.lower("word")))
    at = F.concat(S.column_letters("col_no"), F.col("row_no").cast("string"))
    return found.select("word", *SHEET, at.alias("cell"), "value")

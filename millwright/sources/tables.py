"""Sources and sinks: process-log files, file scans, and tables published whole."""

from __future__ import annotations

import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions import scalars as S

READING = "lot_id string, worked_at string, product string, item_id string, item_name string, value string"
SUFFIXES = ("xlsx", "xlsm", "xls")  # fixed value


def load_readings(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(readings, rows with a bad time).  A bad value is null; file order gives ``row_no``, a sortable
    struct of file, block and place in it.  ``strict`` raises on a bad time."""
    raw = spark.read.schema(READING).option("header", True).option("encoding", "UTF-8").csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    rows = raw.withColumn("row_no", order).drop("item_name").withColumn("raw_at", F.col("worked_at"))
    rows = rows.withColumn("worked_at", S.log_time("worked_at")).withColumn("value", S.plain_number("value"))
    bad = rows.where("worked_at is null")
    if strict:
        rows = rows.withColumn("worked_at", F.when(F.col("worked_at").isNull(), F.raise_error(F.concat(F.lit("bad time: "), F.coalesce("raw_at", F.lit("null"))))).otherwise(F.col("worked_at")))
        return rows.drop("raw_at"), bad
    return rows.where("worked_at is not null").drop("raw_at"), bad


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Ids stay text."""
    return spark.read.schema("item_id string, item_name string, io string, role string, zone int").option("header", True).csv(path)


def load_product_spec(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.schema("product string, target double, tolerance double, unit string").option("header", True).csv(path)


def stage_dirs(text: str) -> dict[str, str]:
    """S5: "dir:kind,dir:kind"; malformed parts are dropped, a repeated dir's later part wins."""
    parts = (p.split(":") for p in text.split(","))
    return {p[0].strip(): p[1].strip() for p in parts if len(p) == 2 and p[0].strip() and p[1].strip()}


def scan(spark: SparkSession, root: str, dirs: dict[str, str], kinds: set[str], suffixes: tuple = SUFFIXES) -> DataFrame:
    """(path, kind, content_hash) of the files (spreadsheets, or as ``suffixes`` says) that stand directly in the mapped folders of
    ``root``.  A kind that is not known fails at once; lock files are skipped.

    A file that is listed but whose content can't be read has a null hash: the listing needs no content,
    and the contents are read by a second pass that leaves broken files out.
    """
    if unknown := set(dirs.values()) - kinds:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")

    def below(reader) -> DataFrame:
        return spreadsheets(reader.format("binaryFile").option("recursiveFileLookup", True).load(root), root, dirs, suffixes)

    names = below(spark.read).select("path", "kind")
    hashed = below(spark.read.option("ignoreCorruptFiles", True)).select("path", F.sha2("content", 256).alias("content_hash"))
    return names.join(hashed, "path", "left").select("path", "kind", "content_hash").orderBy("path")


def spreadsheets(files: DataFrame, root: str, dirs: dict[str, str], suffixes: tuple = SUFFIXES) -> DataFrame:
    """Of ``files`` (path and more) those that stand directly in the mapped folders of ``root``, with their kind."""
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    above = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1), r"^[a-z0-9]+:/*", "/")
    home = "/" + re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    named = F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$") & ~F.col("path").rlike(r"/~\$[^/]*$")
    kind = F.create_map(*[F.lit(x) for kv in sorted(dirs.items()) for x in kv]) if dirs else F.create_map().cast("map<string,string>")
    return files.where(named & (above == home)).withColumn("kind", F.try_element_at(kind, parent)).where("kind is not null")


def change_set(found: DataFrame, known: DataFrame) -> DataFrame:
    """Path, change (new, changed, removed, same)."""
    j = found.select("path", "content_hash").alias("f").join(known.select("path", "content_hash").alias("k"), "path", "full_outer")
    kind = F.when(F.col("k.content_hash").isNull(), "new").when(F.col("f.content_hash").isNull(), "removed").when(F.col("f.content_hash") != F.col("k.content_hash"), "changed").otherwise("same")
    return j.select("path", kind.alias("change"))


def merge_files(found: DataFrame, seen_at) -> DataFrame:
    """The registry after a batch: found files with the new time; vanished paths are forgotten."""
    return found.where("content_hash is not null").select("path", "kind", "content_hash").withColumn("seen_at", F.lit(seen_at).cast("timestamp"))


class Conflict(RuntimeError):
    """Someone else published since the version that this publication builds on."""


class Store:
    """Named tables in one folder, published together by a numbered manifest.

    A batch writes its tables below ``data`` and then creates ``versions/<n + 1>.json``, which lists the folders of
    every table.  The file is created only if it isn't there, so of two writers one takes the number and the
    other goes on from it; a failed batch leaves the old manifest the last one.  (The file system must
    create a file exclusively, as HDFS does.)
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, name: str, row: dict) -> None:
        self.spark.createDataFrame([(time.time_ns(), json.dumps(row, ensure_ascii=False, default=str))], "at long, body string").write.mode("append").parquet(f"{self.root}/{name}")

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.schema("at long, body string").parquet(f"{self.root}/{name}")

    # manifests

    def _path(self, name: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, fs = self._path("versions")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def _manifest(self, number: int) -> dict:
        path, fs = self._path(f"versions/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, number: int, manifest: dict) -> bool:
        """Puts the manifest there if no other is; a reader sees it once it is closed."""
        path, fs = self._path(f"versions/{number:012d}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        out.write(json.dumps(manifest).encode())
        out.close()
        return True

    def version(self) -> int:
        """Number of the published version, 0 before the first."""
        return max(self._numbers(), default=0)

    def _last(self) -> tuple[int, dict]:
        number = self.version()
        return number, self._manifest(number) if number else {"tables": {}, "batches": {}}

    # tables

    def publish(self, tables: dict[str, DataFrame], append: bool = False, batch: tuple[str, int] | None = None, base: int | None = None, buckets: dict[str, tuple[int, str]] | None = None) -> int:
        """Makes ``tables`` visible together; returns the number of the version that holds them.

        In place of all tables there were, or with ``append`` as further rows of tables of those names.  ``batch``
        (name and rising number) makes it happen once: a batch that is published already is left as it is,
        and what a broken attempt wrote is overwritten.  With ``base`` it fails if that is no longer the
        version.  ``buckets`` (number, column) lays a table out hashed and sorted by that column, so that its readers
        join and group by it without an exchange.
        """
        place = f"data/{batch[0]}-{batch[1]}" if batch else f"data/{uuid.uuid4().hex}"
        number, last = self._last()
        if batch and last["batches"].get(batch[0], -1) >= batch[1]:
            return number
        for name, df in tables.items():
            self._write(df, f"{place}/{name}", (buckets or {}).get(name))
        while True:
            if base is not None and number != base:
                raise Conflict(f"version {number} was published after {base}")
            kept = dict(last["tables"]) if append else {}
            for name in tables:
                parts = [*kept[name]["parts"], f"{place}/{name}"] if name in kept else [f"{place}/{name}"]
                kept[name] = {"parts": parts, "buckets": (buckets or {}).get(name) if len(parts) == 1 else None}
            manifest = {"tables": kept, "batches": last["batches"] | ({batch[0]: batch[1]} if batch else {})}
            if self._create(number + 1, manifest):
                return number + 1
            number, last = self._last()
            if batch and last["batches"].get(batch[0], -1) >= batch[1]:
                return number

    def _write(self, df: DataFrame, place: str, bucket: tuple[int, str] | None) -> None:
        if bucket is None:
            df.write.mode("overwrite").parquet(f"{self.root}/{place}")
            return
        n, col = bucket
        name = f"millwright_{uuid.uuid4().hex}"
        rows = df.repartition(n, col).sortWithinPartitions(col)
        rows.write.mode("overwrite").bucketBy(n, col).sortBy(col).format("parquet").option("path", f"{self.root}/{place}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files are outside the warehouse

    def replace_all(self, tables: dict[str, DataFrame], **how) -> int:
        """``publish`` in place of all tables."""
        return self.publish(tables, **how)

    def load(self, name: str) -> DataFrame:
        table = self._last()[1]["tables"][name]
        paths = [f"{self.root}/{p}" for p in table["parts"]]
        rows = self.spark.read.parquet(*paths)
        if not table["buckets"]:
            return rows
        n, col = table["buckets"]
        known = "millwright_" + re.sub(r"\W", "_", paths[0])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY (`{col}`) SORTED BY (`{col}`) INTO {n} BUCKETS LOCATION '{paths[0]}'")
        return self.spark.table(known)

    def has(self, name: str) -> bool:
        """Whether the published version holds the table."""
        return name in self._last()[1]["tables"]

    def vacuum(self, keep: int = 1, orphan_hours: float = 24) -> list[str]:
        """Removes all but the last ``keep`` manifests and the folders that only those had, then folders that no
        manifest names and that are older than ``orphan_hours``, left by broken batches.  Returns what went."""
        numbers = self._numbers()
        of = {n: {p.split("/")[1] for t in self._manifest(n)["tables"].values() for p in t["parts"]} for n in numbers}
        old, held = numbers[:-keep], set().union(*(of[n] for n in numbers[-keep:]), set())
        path, fs = self._path("data")
        gone = []
        limit = time.time() * 1000 - orphan_hours * 3_600_000
        for f in fs.listStatus(path) if fs.exists(path) else []:
            name = f.getPath().getName()
            named = any(name in of[n] for n in old)
            if name not in held and (named or f.getModificationTime() < limit):
                fs.delete(f.getPath(), True)
                gone.append(name)
        for n in old:
            path, fs = self._path(f"versions/{n:012d}.json")
            fs.delete(path, False)
        return sorted(gone)

    def record_run(self, summary: dict) -> None:
        self._append("runs", summary)

    def latest_run(self) -> dict | None:
        body = self._rows("runs").agg(F.max_by("body", "at")).first()[0]
        return json.loads(body) if body else None

    def save_layout(self, layout: dict) -> None:
        self._append("layouts", layout)

    def load_layouts(self, kind: str, schema: str) -> DataFrame:
        """Newest first; old ones are kept."""
        rows = self._rows("layouts").withColumn("l", F.from_json("body", schema)).where(F.col("l.kind") == kind)
        return rows.select("at", "l.*").orderBy(F.desc("at"))


def union_rows(tables: list[DataFrame]) -> DataFrame:
    """Rows of one kind over files and sheets; columns that are missing somewhere are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out

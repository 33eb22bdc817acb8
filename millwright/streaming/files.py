"""Source files as a stream: every new file is read once and published once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwright.sources.tables import SUFFIXES, Store, spreadsheets

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, root: str, dirs: dict[str, str], kinds: set[str], suffixes: tuple = SUFFIXES, per_batch: int = 1000) -> DataFrame:
    """S4 as a stream: (path, kind, content_hash, seen_at, content) of files that come to the mapped folders.

    ``seen_at`` is the file's own time, so that a replayed batch is the same batch.  A file that is rewritten under
    its name isn't seen again, and none that goes; ``tables.scan`` and ``change_set`` find those.
    """
    if unknown := set(dirs.values()) - kinds:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    found = spreadsheets(files, root, dirs, suffixes)
    return found.select("path", "kind", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("seen_at"), "content")


def ingest_files(files: DataFrame, store: Store, checkpoint: str, rows: Callable[[DataFrame], dict[str, DataFrame]], name: str = "files") -> StreamingQuery:
    """Publishes each batch of ``stream_files``: its registry rows (table ``files``) and the tables that ``rows`` reads
    from it, appended to those before and visible together.

    Takes what is there and ends.  A batch that broke anywhere is replayed by the next call with the same
    ``checkpoint`` and is published once, whether it broke before or after its publication.
    """

    def publish(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.publish({"files": batch.drop("content")} | rows(batch), append=True, batch=(name, number))

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()

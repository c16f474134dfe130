"""A recognition that goes on where it stopped: pages found in the cache are not asked for again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.request import cache_misses

SCHEMA = "hash string, page_index int, content string, seq long"


def _folders(spark: SparkSession, path: str) -> tuple:
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, [x.getPath() for x in fs.listStatus(top) if fs.exists(x.getPath().suffix("/_SUCCESS"))] if fs.exists(top) else []


def load(spark: SparkSession, path: str, but: str = "") -> DataFrame:
    """The cache, a folder for each batch and one for the batches that compact() has put together, without one of them."""
    _, found = _folders(spark, path)
    kept = [p.toString() for p in found if p.getName() != but]
    return spark.read.schema(SCHEMA).parquet(*kept) if kept else spark.createDataFrame([], SCHEMA)


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Puts the batches below upto together, one row a page, sorted by hash so that a lookup's filter skips most of it.

    The whole is written before the parts go; where both are there, for a crash between, the first row of a page counts.
    """
    fs, found = _folders(spark, path)
    old = [p for p in found if p.getName().startswith("whole-") or int(p.getName().removeprefix("batch=")) < upto]
    if len(old) > 1:
        rows = spark.read.schema(SCHEMA).parquet(*[p.toString() for p in old])
        first = rows.groupBy("hash", "page_index").agg(F.min_by(F.struct("content", "seq"), "seq").alias("c")).select("hash", "page_index", "c.*")
        first.sortWithinPartitions("hash").write.parquet(f"{path}/whole-{upto}")
        for p in old:
            fs.delete(p, True)


def delete(spark: SparkSession, path: str) -> None:
    """Forgets the cache, once its documents are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def recognize_missing(pages: DataFrame, cache: str, batch: int, ask: Callable[[DataFrame], DataFrame]) -> None:
    """Asks for the pages (hash, page_index and more) that the cache lacks, and keeps what has no error.

    A batch writes its own folder anew, so that a batch run twice is kept once.
    """
    spark = pages.sparkSession
    known = load(spark, cache, f"batch={batch}")
    fresh = ask(cache_misses(pages.dropDuplicates(["hash", "page_index"]), known)).where("error is null")
    fresh.select("hash", "page_index", "content", F.lit(batch).cast("long").alias("seq")).write.mode("overwrite").parquet(f"{cache}/batch={batch}")


def stream(pages: DataFrame, cache: str, checkpoint: str, ask: Callable[[DataFrame], DataFrame], compact_every: int = 50) -> StreamingQuery:
    """Runs over all there is of a stream of pages; what a stopped run has kept stays kept."""

    def batch(df: DataFrame, i: int) -> None:
        if i and i % compact_every == 0:
            compact(df.sparkSession, cache, i)
        recognize_missing(df, cache, i, ask)

    writer = pages.writeStream.foreachBatch(batch)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

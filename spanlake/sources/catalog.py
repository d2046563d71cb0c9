"""Text sources of event names, timeline tables on disk, and the cache of such tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHE_BYTES = 512 << 20


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty trimmed lines: one ``Logger.Event`` each."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def harvested(spark: SparkSession, path: str) -> DataFrame:
    """Event names that source files declare by the tracing macros, sorted."""
    found = F.explode(F.regexp_extract_all("value", F.lit(r"UE_TRACE_(?:MINIMAL_)?EVENT_BEGIN(?:_EXTERN)?\(\s*(\w+\s*,\s*\w+)"), 1))
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_replace(found, r"\s*,\s*", ".").alias("name")).distinct().orderBy("name")


def write_timeline(intervals: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An interval index: Parquet sorted by start, so that scans skip row groups by their least and greatest start."""
    intervals.repartitionByRange("trace_id", "start_cycle").sortWithinPartitions("trace_id", "start_cycle", "end_cycle").write.mode(mode).parquet(path)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spans(index: DataFrame) -> DataFrame:
    """How many intervals an index has for each capture, and the cycles that they span."""
    return index.groupBy("trace_id").agg(F.count("*").alias("intervals"), F.min("start_cycle").alias("first_cycle"), F.max("end_cycle").alias("last_cycle"))


def content_key(files: DataFrame) -> str:
    """A name for captures by their bytes: the digest of their sorted digests. Captures are few, so their digests are."""
    digests = files.select(F.sha2("content", 256).alias("d")).orderBy("d").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("d"))), 256).alias("key"))
    return digests.first()["key"]


def cached_timeline(spark: SparkSession, files: DataFrame, root: str, build: Callable[[str], object], limit: int = CACHE_BYTES) -> str:
    """The folder under ``root`` of the index of captures with these bytes, built if it is not there.

    Writing is atomic, so two builders at once give one index. Then the entries that outgrow ``limit`` go, oldest first.
    """
    path = f"{root}/{content_key(files)}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    if not fs.exists(at(f"{path}/_SUCCESS")):
        build(path)
    entries = [(s.getPath().toString(), fs.getContentSummary(s.getPath()).getLength(), s.getModificationTime()) for s in fs.listStatus(at(root)) if s.isDirectory()]
    old = evicted(spark.createDataFrame(entries, "path string, bytes long, modified long"), limit).where(~F.col("path").endswith(path.rpartition("/")[2]))
    for row in old.collect():
        fs.delete(at(row["path"]), True)
    return path


def evicted(entries: DataFrame, limit: int = CACHE_BYTES) -> DataFrame:
    """Cache entries (path, bytes, modified) to drop: all but the most recent that fit the limit together."""
    newest = Window.orderBy(F.desc("modified"), "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("kept_bytes", F.sum("bytes").over(newest)).where(F.col("kept_bytes") > limit).drop("kept_bytes")

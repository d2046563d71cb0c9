"""Live views: windows over event time, deduplication, and frames that late ends revise."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with an event time that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return counts.select(F.unix_micros("window.start").alias("window_start"), "event_type", "n", "cents")


def sliding(stream: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.unix_micros("window.start").alias("window_start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.unix_micros("session_window.start").alias("session_start"), F.unix_micros("session_window.end").alias("session_end"), "n")


def deduplicated(stream: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


FRAMES = "frame_type long, frame_number long, begin_cycle long, end_cycle long, revision long"
#: A begin that no end follows.
_NEVER = np.iinfo(np.int64).max
STATE = "open_begin long, number long, published boolean, next_number long, revision long"


def live_frames(markers: DataFrame) -> DataFrame:
    """Frames of rows of ``frame_type, seq, cycle, is_begin``: a later end before the next begin revises its frame.

    State is one open slot for each frame type. Within a batch markers follow ``seq``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, number, published, following, revision = state.get if state.exists else (None, -1, False, 0, 0)
        rows = pd.concat(list(batches))[["seq", "cycle", "is_begin"]].sort_values("seq")
        cycle, opens = rows["cycle"].to_numpy(np.int64), rows["is_begin"].to_numpy(bool)
        # Slot 0 is the frame that was open before; the others are this batch's begins.
        slot, starts = np.cumsum(opens), np.concatenate([[_NEVER if begin is None else begin], cycle[opens]])
        late = ~opens & (cycle >= starts[slot])
        ended, first, revised = np.unique(slot[late][::-1], return_index=True, return_counts=True)
        out = []
        for at, end, n in zip(ended.tolist(), cycle[late][::-1][first].tolist(), revised.tolist(), strict=True):  # a row for each frame that changed
            if at or not published:
                number, following = following, following + 1
            revision = n if at else revision + n
            published = True
            out.append((key[0], number, int(starts[at]), end, revision))
        if slot[-1]:
            begin = int(starts[-1])
            if not len(ended) or ended[-1] != slot[-1]:
                number, published, revision = -1, False, 0
        state.update((begin, number, published, following, revision))
        yield pd.DataFrame(out, columns=[p.split()[0] for p in FRAMES.split(", ")])

    return markers.groupBy("frame_type").applyInPandasWithState(update, FRAMES, STATE, "update", GroupStateTimeout.NoTimeout)


def drained(result: DataFrame, name: str, mode: str, *keys: str) -> DataFrame:
    """Run a stream over what is there now and return what its sink holds, as a written table.

    Micro-batches are appended to a table in the shared folder, each under its number. With ``complete`` the last batch
    is the result; with ``update`` the last row for each of ``keys``, or all rows where there are none.
    """
    spark = result.sparkSession
    root = f"{shared_folder(spark)}/spanlake/stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={number}")  # a batch that runs again replaces itself

    query = result.writeStream.queryName(f"{name}-{uuid.uuid4().hex}").outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    done = query.lastProgress
    if done is None:  # nothing was there
        return spark.createDataFrame([], result.schema)
    table = spark.read.schema(T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/table")
    if mode == "complete":
        last = table.agg(F.max("batch")).first()[0]
        table = table.where(F.col("batch") == last)
    elif keys:
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
        table = table.withColumn("_n", newest).where("_n = 1").drop("_n")
    return table.drop("batch")


def patches(result: DataFrame, path: str, trigger: str = "100 milliseconds"):
    """Write every change as JSON lines with a rising ``sequence``; each patch replaces what it names."""

    def publish(batch: DataFrame, number: int) -> None:
        batch.select(F.lit(number).alias("sequence"), F.lit("snapshot").alias("kind"), F.struct(*batch.columns).alias("body")).write.mode("append").json(path)

    return result.writeStream.outputMode("update").foreachBatch(publish).trigger(processingTime=trigger)

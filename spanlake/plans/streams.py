"""Registered streaming queries over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from ..streaming import progressive, session
from . import captures
from .bindings import E_SQL, query


@query("stream_tumbling", f"WITH {E_SQL} SELECT CAST(cycle // 86400000000 * 86400000000 AS BIGINT) AS window_start, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.drained(session.tumbling(session.event_stream(spark, sf_dir), "1 day"), "stream_tumbling", "complete")


@query("stream_sliding", f"""WITH {E_SQL} SELECT CAST((cycle // 21600000000 - o) * 21600000000 AS BIGINT) AS window_start, event_type, count(*) AS n FROM e, (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.drained(session.sliding(session.event_stream(spark, sf_dir), "1 day", "6 hours"), "stream_sliding", "complete")


@query("stream_session", f"""WITH {E_SQL}, g AS (SELECT *, CASE WHEN cycle - lag(cycle) OVER x < 10800000000 THEN 0 ELSE 1 END AS b FROM e WINDOW x AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS sid FROM g) SELECT user_id, min(cycle) AS session_start, max(cycle) + 10800000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.drained(session.sessions(session.event_stream(spark, sf_dir), "3 hours"), "stream_session", "complete")


@query("stream_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.drained(session.deduplicated(session.event_stream(spark, sf_dir), "event_id").select("event_id", "user_id"), "stream_dedup", "append")


@query("stream_frames", f"""WITH {E_SQL}, r AS (SELECT user_id % 4 AS frame_type, event_id, cycle, event_type = 'signup' AS b FROM e WHERE event_type IN ('signup', 'click')),
    n AS (SELECT *, sum(b::int) OVER (PARTITION BY frame_type ORDER BY event_id) AS slot FROM r), o AS (SELECT *, max(CASE WHEN b THEN cycle END) OVER (PARTITION BY frame_type, slot) AS bc FROM n WHERE slot > 0),
    g AS (SELECT frame_type, slot, max(bc) AS begin_cycle, max(cycle) FILTER (NOT b) AS end_cycle, min(event_id) FILTER (NOT b) AS first, count(*) FILTER (NOT b) AS revision FROM o GROUP BY 1, 2)
    SELECT frame_type, row_number() OVER (PARTITION BY frame_type ORDER BY first) - 1 AS frame_number, begin_cycle, end_cycle, revision FROM g WHERE revision > 0""")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session.event_stream(spark, sf_dir).where(F.col("event_type").isin("signup", "click"))
    markers = e.select((F.col("user_id") % 4).alias("frame_type"), F.col("event_id").alias("seq"), F.unix_micros("ts").alias("cycle"), (F.col("event_type") == "signup").alias("is_begin"))
    return session.drained(session.live_frames(markers), "stream_frames", "update", "frame_type", "frame_number")


#: Bytes of the chunks that a capture arrives in, and files that its chunks are dealt to, a micro-batch each.
CHUNK, FILES = 6000, 4


def chunked(spark: SparkSession, sf_dir: str, theme: str) -> DataFrame:
    """A stream of a theme's captures in chunks, which come in no order."""
    whole = captures.content(captures.THEMES[theme](captures.base(spark, sf_dir)))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / CHUNK)))
    chunks = whole.select("trace_id", "content", at.alias("chunk_no")).select("trace_id", "chunk_no", F.expr(f"substring(content, cast(chunk_no * {CHUNK} + 1 as int), {CHUNK})").alias("data"))
    path = f"{shared_folder(spark)}/spanlake/chunks-{uuid.uuid4().hex}"
    chunks.repartition(FILES, F.col("chunk_no") % FILES).write.parquet(path)
    return spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_capture_events", f"WITH {captures.C_SQL}, {captures.INVENTORY_SQL} SELECT trace_id, logger, event, count(*) AS count FROM i GROUP BY 1, 2, 3")
def stream_capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of captures that stream in, counted; each comes once although its packets are cut anywhere."""
    found = session.drained(progressive.events(chunked(spark, sf_dir, "gpu")), "stream_capture_events", "append")
    return found.dropDuplicates(["trace_id", "thread_id", "local_seq"]).groupBy("trace_id", "logger", "event").agg(F.count("*").alias("count"))


@query("stream_capture_scopes", f"WITH {captures.C_SQL}{captures.CPU_SQL} SELECT trace_id, thread_id, spec_id, is_metadata, cycle AS start_cycle, end_cycle, duration FROM sc WHERE matched")
def stream_capture_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.drained(progressive.scopes(chunked(spark, sf_dir, "scopes")), "stream_capture_scopes", "append")

"""Begin/end pairing by windows: stacks, overwriting maps, last end wins, and lifecycle merges.

All of them partition by a key and order by ``seq``; none gathers a key's rows in Python, and Spark spills windows
that outgrow memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_lifo(events: DataFrame, keys: Sequence[str], seq: str, is_begin: Column, is_end: Column, cycle: str, ends: Sequence[str] = ()) -> DataFrame:
    """Stack discipline: an end closes the newest open begin of its key.

    Returns every begin and end row with ``kind`` (begin, end), ``depth``, ``matched``, and on matched begins
    ``end_seq``, ``end_cycle``, ``end_<c>`` for each column c of ``ends``, and the saturating ``duration``. The stack is a walk reflected at zero: an end is
    unmatched exactly where the running minimum of the walk drops.
    """
    order = Window.partitionBy(*keys).orderBy(seq)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.where(is_begin | is_end).withColumn("kind", F.when(is_begin, "begin").otherwise("end"))
    rows = rows.withColumn("_walk", F.sum(F.when(F.col("kind") == "begin", 1).otherwise(-1)).over(upto))
    rows = rows.withColumn("_floor", F.least(F.lit(0), F.min("_walk").over(upto)))
    rows = rows.withColumn("_dropped", F.col("_floor") < F.coalesce(F.lag("_floor").over(order), F.lit(0)))
    depth = F.col("_walk") - F.col("_floor")
    rows = rows.withColumn("depth", F.when(F.col("kind") == "begin", depth).otherwise(depth + 1))
    level = Window.partitionBy(*keys, "depth", "_lost").orderBy(seq)
    rows = rows.withColumn("_lost", (F.col("kind") == "end") & F.col("_dropped"))
    nxt = lambda c: F.lead(c).over(level)
    closes = (F.col("kind") == "begin") & (nxt("kind") == "end")
    rows = rows.withColumns({"end_seq": F.when(closes, nxt(seq)), "end_cycle": F.when(closes, nxt(cycle)), **{f"end_{c}": F.when(closes, nxt(c)) for c in ends}})
    rows = rows.withColumn("matched", F.when(F.col("kind") == "begin", F.col("end_seq").isNotNull()).otherwise(~F.col("_lost")))
    return rows.withColumn("duration", F.when((F.col("end_cycle") - F.col(cycle)).isNotNull(), F.greatest(F.col("end_cycle") - F.col(cycle), F.lit(0)))).drop("_walk", "_floor", "_dropped", "_lost")


def pair_overwrite(events: DataFrame, keys: Sequence[str], seq: str, is_begin: Column, is_end: Column, cycle: str, ends: Sequence[str] = ()) -> DataFrame:
    """Map discipline: a begin replaces an open one of its key, an end removes it; other ends are unmatched.

    Returns begin and end rows with ``kind``, ``outcome`` (matched, overwritten, open or unmatched) and, on matched
    begins, ``end_seq``, ``end_cycle``, ``end_<c>`` for each column c of ``ends``, and ``duration``.
    """
    order = Window.partitionBy(*keys).orderBy(seq)
    rows = events.where(is_begin | is_end).withColumn("kind", F.when(is_begin, "begin").otherwise("end"))
    before, after = F.lag("kind").over(order), F.lead("kind").over(order)
    outcome = (
        F.when(F.col("kind") == "end", F.when(before == "begin", "matched").otherwise("unmatched"))
        .when(after == "end", "matched")
        .when(after == "begin", "overwritten")
        .otherwise("open")
    )
    closes = (F.col("kind") == "begin") & (after == "end")
    rows = rows.withColumns({"outcome": outcome, "end_seq": F.when(closes, F.lead(seq).over(order)), "end_cycle": F.when(closes, F.lead(cycle).over(order)), **{f"end_{c}": F.when(closes, F.lead(c).over(order)) for c in ends}})
    return rows.withColumn("duration", F.when((F.col("end_cycle") - F.col(cycle)).isNotNull(), F.greatest(F.col("end_cycle") - F.col(cycle), F.lit(0))))


def last_end_wins(events: DataFrame, keys: Sequence[str], seq: str, is_begin: Column, is_end: Column, cycle: str) -> DataFrame:
    """Frame discipline: every end before the next begin rewrites its slot's end, if it is not before the begin.

    One row for each published slot: begin, last end, duration, ``revisions`` and ``frame_number``, the order in which
    slots of the key were first closed.
    """
    order = Window.partitionBy(*keys).orderBy(seq)
    rows = events.where(is_begin | is_end).withColumn("_begin", is_begin)
    rows = rows.withColumn("_slot", F.sum(F.col("_begin").cast("int")).over(order)).where("_slot > 0")
    opened = F.max(F.when(F.col("_begin"), F.col(cycle))).over(Window.partitionBy(*keys, "_slot"))
    rows = rows.withColumn("begin_cycle", opened)
    late = ~F.col("_begin") & (F.col(cycle) >= F.col("begin_cycle"))
    slots = rows.groupBy(*keys, "_slot").agg(
        F.min(F.when(F.col("_begin"), F.col(seq))).alias("begin_seq"), F.max("begin_cycle").alias("begin_cycle"), F.max_by(F.when(late, F.col(cycle)), F.when(late, F.col(seq))).alias("end_cycle"),
        F.min(F.when(late, F.col(seq))).alias("_first"), F.count_if(late).alias("revisions"),
    ).where("revisions > 0")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1
    return slots.select(*keys, number.cast("long").alias("frame_number"), "begin_seq", "begin_cycle", "end_cycle", (F.col("end_cycle") - F.col("begin_cycle")).alias("duration"), "revisions")


def lifecycle(events: DataFrame, key: Sequence[str], seq: str, kind: Column, cycle: str) -> DataFrame:
    """One row for each request, which a ``create`` opens; start, complete and fail update the newest of their key.

    ``status`` is completed or failed by the last of such events, started, or created. Updates before any create of
    the key are not attributed.
    """
    order = Window.partitionBy(*key).orderBy(seq)
    rows = events.withColumn("_kind", kind).where(F.col("_kind").isin("create", "start", "complete", "fail"))
    rows = rows.withColumn("_n", F.sum((F.col("_kind") == "create").cast("int")).over(order)).where("_n > 0")
    at = lambda k: F.max_by(F.when(F.col("_kind") == k, F.col(cycle)), F.when(F.col("_kind") == k, F.col(seq)))
    final = F.max_by(F.when(F.col("_kind").isin("complete", "fail"), F.col("_kind")), F.when(F.col("_kind").isin("complete", "fail"), F.col(seq)))
    out = rows.groupBy(*key, F.col("_n").alias("request_no")).agg(at("create").alias("create_cycle"), at("start").alias("start_cycle"), at("complete").alias("complete_cycle"), F.count_if(F.col("_kind") == "start").alias("starts"), final.alias("_final"))
    status = F.when(F.col("_final") == "complete", "completed").when(F.col("_final") == "fail", "failed").when(F.col("starts") > 0, "started").otherwise("created")
    return out.withColumn("status", status).drop("_final")


def outstanding(events: DataFrame, address: Sequence[str], seq: str, is_alloc: Column, is_free: Column, size: str) -> DataFrame:
    """What is allocated at the end: addresses whose last event is an alloc, with its size."""
    rows = events.where(is_alloc | is_free).withColumn("_alloc", is_alloc)
    last = rows.groupBy(*address).agg(F.max_by(F.struct(F.col("_alloc").alias("alloc"), F.col(size).alias("size"), F.col(seq).alias("seq")), seq).alias("last"))
    return last.where("last.alloc").select(*address, F.col("last.seq").alias("alloc_seq"), F.col("last.size").alias("size"))


def bound_value(events: DataFrame, keys: Sequence[str], seq: str, binds: Column, value: Column, unbinds: Column, name: str, default: str = "") -> DataFrame:
    """As-of binding: the value that the latest bind of the key left, unless it was unbound since."""
    order = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.when(binds, F.struct(value.alias("v"))).when(unbinds, F.struct(F.lit(None).cast("string").alias("v")))
    return events.withColumn(name, F.coalesce(F.last(state, ignorenulls=True).over(order)["v"], F.lit(default)))

"""Interval search on timelines, frame windows and lanes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a query returns unless told otherwise, and at most.
DEFAULT_LIMIT, MAX_LIMIT = 500, 10_000


class InvalidQuery(ValueError):
    """A query whose start lies after its end."""


def matches_text(needle: str | None, *names: Column) -> Column:
    """Whether any name holds the trimmed needle, in lower case; an empty needle matches all."""
    wanted = (needle or "").strip().lower()
    out = F.lit(not wanted)
    for name in names if wanted else ():
        out = out | F.coalesce(F.contains(F.lower(name), F.lit(wanted)), F.lit(False))
    return out


def overlapping(intervals: DataFrame, start: str, end: str, query_start: int | None, query_end: int | None) -> DataFrame:
    """Closed intervals that meet the closed query; a missing bound is open. Both bounds are pushed to the scan."""
    if query_start is not None and query_end is not None and query_start > query_end:
        raise InvalidQuery(f"start {query_start} lies after end {query_end}")
    if query_end is not None:
        intervals = intervals.where(F.col(start) <= query_end)
    return intervals if query_start is None else intervals.where(F.col(end) >= query_start)


def limited(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))


def index_query(intervals: DataFrame, start: str, end: str, order: Sequence[str], query_start: int | None = None, query_end: int | None = None, thread: tuple[str, object] | None = None, text: str | None = None, names: Sequence[str] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first matches in order, and one row of ``matches, returned, truncated``. Open intervals never match."""
    n = limited(limit)
    hits = overlapping(intervals.where(F.col(end).isNotNull()), start, end, query_start, query_end)
    if thread is not None:
        hits = hits.where(F.col(thread[0]) == F.lit(thread[1]))
    hits = hits.where(matches_text(text, *(F.col(c) for c in names)))
    rows = hits.orderBy(start, end, *order).limit(n)
    return rows, hits.agg(F.count("*").alias("matches")).select("matches", F.least("matches", F.lit(n)).alias("returned"), (F.col("matches") > n).alias("truncated"))


def exact_query(intervals: DataFrame, start: str, end: str, order: Sequence[str], query_start: int, query_end: int, limit: int | None = None) -> DataFrame:
    """Intervals that meet the window, still open ones and those that close after it clipped to its end."""
    if query_start > query_end:
        raise InvalidQuery(f"start {query_start} lies after end {query_end}")
    hits = intervals.where((F.col(start) <= query_end) & (F.col(end).isNull() | (F.col(end) >= query_start)))
    clipped = hits.withColumn(end, F.coalesce(F.least(F.col(end), F.lit(query_end)), F.lit(query_end))).withColumn("duration", F.col(end) - F.col(start))
    return clipped.orderBy(start, end, *order).limit(limited(limit))


def prefix_max_end(intervals: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Greatest end so far in start order: what lets a search skip ahead."""
    return intervals.withColumn("prefix_end", F.max(end).over(Window.partitionBy(*keys).orderBy(start, end, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def lane_depth(intervals: DataFrame, keys: Sequence[str], start: str, end: str, ident: str, cap: int = 6) -> DataFrame:
    """How many earlier intervals of the key are still open at each one's start, up to ``cap``.

    Order is by start and then the longer first. Starts add one and ends take one off a running sum, so no interval
    meets another in a join.
    """
    lane = Window.partitionBy(*keys)
    opens = intervals.select(*keys, F.col(start).alias("_t"), F.lit(1).alias("_what"), (-F.col(end)).alias("_tie"), F.col(ident).alias("_id"), F.lit(1).alias("_step"))
    ends = intervals.where(F.col(end) > F.col(start)).select(*keys, F.col(end).alias("_t"), F.lit(0).alias("_what"), F.lit(0).cast("long").alias("_tie"), F.col(ident).alias("_id"), F.lit(-1).alias("_step"))
    # An interval of no length is never open for others.
    opens = opens.withColumn("_step", F.when(-F.col("_tie") > F.col("_t"), 1).otherwise(0))
    both = opens.unionByName(ends)
    open_now = F.sum("_step").over(lane.orderBy("_t", "_what", "_tie", "_id").rowsBetween(Window.unboundedPreceding, -1))
    depth = both.withColumn("depth", F.least(F.coalesce(open_now, F.lit(0)), F.lit(cap))).where("_what = 1").select(*keys, F.col("_id").alias(ident), F.col("depth").cast("long"))
    return intervals.join(depth, [*keys, ident])


def in_frame(rows: DataFrame, keys: Sequence[str], frame_column: str, frame: int, start: str, end: str, order: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of a frame in order, at least one, and ``begin, end, intervals, truncated`` of all of them by key."""
    hits = rows.where(F.col(frame_column) == frame)
    kept = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= max(1, limit)).drop("_n")
    totals = hits.groupBy(*keys).agg(F.min(start).alias("begin"), F.max(end).alias("end"), F.count("*").alias("intervals"))
    return kept, totals.withColumn("truncated", F.col("intervals") > max(1, limit))


def window_of_frames(frames: DataFrame, number: str, first: int, last: int, start: str, end: str) -> DataFrame:
    """The cycle window that selected frames span."""
    return frames.where(F.col(number).between(first, last)).agg(F.min(start).alias("window_start"), F.max(end).alias("window_end"), F.count("*").alias("frames"))


def cycle_in_window(cycle: Column, lo: int | None, hi: int | None) -> Column:
    """True for everything without a window; a null cycle is outside one."""
    return F.lit(True) if lo is None or hi is None else F.coalesce(cycle.between(lo, hi), F.lit(False))


def interval_in_window(start: Column, end: Column, lo: int | None, hi: int | None) -> Column:
    return F.lit(True) if lo is None or hi is None else F.coalesce((start <= hi) & (end >= lo), F.lit(False))


def frame_ordinals(frames: DataFrame, keys: Sequence[str], start: str, number: str) -> DataFrame:
    """Ordinal by begin, nulls last, and cycles since the first frame's begin."""
    order = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(number))
    return frames.withColumns({"ordinal": F.row_number().over(order), "elapsed": F.greatest(F.lit(0), F.col(start) - F.first(start).over(order))})


def forward_fill(rows: DataFrame, keys: Sequence[str], seq: str, value: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: int, order: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; the newest ``keep`` stay."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    newest = both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v")))).where("_rn = 1").drop("_rn", "_v")
    return newest.orderBy(F.desc(order), *keys).limit(keep)


def merge_live(old: DataFrame, patch: DataFrame, number: str, keep: int) -> DataFrame:
    """A patch of frames into a live history; the newest ``keep`` frames stay.

    A patch that begins with a known frame, reaches the end and holds every known frame in between replaces all from
    its first frame on; another one replaces the frames that it names.
    """
    span = patch.agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.countDistinct(number).alias("_n"))
    suffix = old.join(F.broadcast(span), F.col(number) >= F.col("_lo"))
    known = suffix.join(patch.select(F.col(number).alias("_p")).distinct(), F.col(number) == F.col("_p"), "left")
    fits = known.agg((F.coalesce(F.count_if(F.col("_p").isNull()) == 0, F.lit(False)) & (F.min(number) == F.min("_lo"))).alias("_fits"))
    named = patch.select(F.col(number).alias("_p")).distinct()
    rest = old.crossJoin(F.broadcast(span)).crossJoin(F.broadcast(fits)).join(named, F.col(number) == F.col("_p"), "left")
    kept = rest.where(F.col("_p").isNull() & (F.col("_lo").isNull() | ~(F.coalesce("_fits", F.lit(False)) & (F.col(number) >= F.col("_lo"))))).select(*old.columns)
    return kept.unionByName(patch.select(*old.columns)).orderBy(F.desc(number)).limit(keep)

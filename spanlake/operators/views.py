"""What a viewer asks of result tables: filters, sorting, selections, roll-ups, flattening and exit codes."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .timeline import matches_text

FRAME_TYPES = {"game": 0, "rendering": 1}
# Process exit codes by kind of failure.
EXIT_CODES = {"ok": 0, "MalformedData": 2, "UnsupportedFormat": 3, "io": 4, "internal": 5, "partial": 6, "ResourceLimit": 7, "usage": 64}


def frames_of(frames: DataFrame, kind: str, column: str = "frame_type") -> DataFrame:
    """Frames of the game or the rendering thread, or all of them."""
    return frames if kind == "all" else frames.where(F.col(column) == FRAME_TYPES[kind])


def table_view(rows: DataFrame, needle: str | None, columns: Sequence[str], sort: str, descending: bool = False, *ties: str) -> DataFrame:
    """Rows that hold the needle in any of ``columns``, sorted by one of them with nulls last."""
    by = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.where(matches_text(needle, *(F.col(c).cast("string") for c in columns))).orderBy(by, *ties)


def selected_by_position(frames: DataFrame, keys: Sequence[str], order: str, lo: float, hi: float) -> DataFrame:
    """Frames between two shares of their key's rows, as a brush over the chart selects them."""
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    numbered = frames.withColumns({"_at": at, "_n": n})
    first, last = F.floor(F.lit(max(0.0, lo)) * (F.col("_n") - 1)), F.ceil(F.lit(min(1.0, hi)) * (F.col("_n") - 1))
    return numbered.where((F.col("_at") >= first) & (F.col("_at") <= last)).drop("_at", "_n")


def frames_of_brush(frames: DataFrame, keys: Sequence[str], number: str, first: int, last: int) -> DataFrame:
    """``start_frame, end_frame`` of a brush over the frames in order, by places from 0; no row if it covers all."""
    order = Window.partitionBy(*keys).orderBy(number)
    placed = frames.select(*keys, number).withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    clamped = lambda i: F.greatest(F.lit(0), F.least(F.lit(i), F.col("_n") - 1))
    lo = clamped(first)
    hi = F.greatest(lo, clamped(last))
    ends = placed.groupBy(*keys).agg(F.max(F.when(F.col("_at") == lo, F.col(number))).alias("start_frame"), F.max(F.when(F.col("_at") == hi, F.col(number))).alias("end_frame"), F.max(F.when(F.col("_at") == lo, F.col("_at"))).alias("_lo"), F.max(F.when(F.col("_at") == hi, F.col("_at"))).alias("_hi"), F.max("_n").alias("_n"))
    return ends.where((F.col("_lo") > 0) | (F.col("_hi") < F.col("_n") - 1)).drop("_lo", "_hi", "_n")


def brush_of_frames(frames: DataFrame, keys: Sequence[str], number: str, start: int, end: int) -> DataFrame:
    """``first, last`` places of the frames from ``start`` to ``end``; no row if there are none."""
    order = Window.partitionBy(*keys).orderBy(number)
    placed = frames.select(*keys, number).withColumn("_at", F.row_number().over(order) - 1)
    return placed.where(F.col(number).between(start, end)).groupBy(*keys).agg(F.min("_at").alias("first"), F.max("_at").alias("last"))


def rolled_up(tops: DataFrame, by: Sequence[str], name: str, count: str, cycles: str, limit: int = 40) -> DataFrame:
    """Sum the top lists of selected frames anew; what a list left out stays out."""
    totals = tops.groupBy(*by, name).agg(F.sum(count).alias(count), F.sum(cycles).alias(cycles))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(cycles), name)))
    return ranked.where(F.col("rank") <= limit)


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value if isinstance(value, str) else json.dumps(value)


_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


@arrow_udf(_LEAVES)
def flattened(values: pa.Array) -> pa.Array:
    """The leaves of a JSON column as paths and values; null for null."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
    return pa.array([None if v is None else [{"path": p, "value": x} for p, x in leaves(json.loads(v))] for v in values.to_pylist()], kind)


def wide_table(rows: DataFrame, row: str, name: str, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """One column for each name, in the order given or else sorted; the first value of each cell."""
    return rows.groupBy(row).pivot(name, list(names) if names else None).agg(F.first(value, ignorenulls=True))


def frame_label(number: Column, kind: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit(" frame "), number)

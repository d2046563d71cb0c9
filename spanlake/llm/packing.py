"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Pieces of one length are interchangeable, so the packing of any number of documents follows from the histogram
of piece lengths, which has at most ``capacity`` rows. The driver packs that histogram best-fit decreasing: a
segment tree over remaining capacities finds the tightest class of open sequences in logarithmic time, and whole
runs of equal sequences are filled at once. The plan says, for each run of ranks within a length, which sequences
it fills; its size depends on the capacity, not on the corpus. Pieces find their rank within their length by
salted counts, and their place by a lookup in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import whole_texts

CAPACITY = 4096
END_ID = 1


class CapacityTree:
    """Segment tree over remaining capacities 0..n that marks the capacities of open sequences."""

    def __init__(self, n: int):
        self.size = 1 << max(1, n).bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = self.size + capacity
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity of at least ``least``."""
        i = self.size + least
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length -> count), as (length, rank_lo, rank_hi, per_sequence, first_sequence, offset).

    The piece of rank r in [rank_lo, rank_hi) of that length goes to sequence
    ``first_sequence + (r - rank_lo) // per_sequence`` at ``offset + (r - rank_lo) % per_sequence * length``.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    tree, fresh = CapacityTree(capacity), 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            runs.setdefault(room, []).append((first, count))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                per = room // length
                first, count = fresh, -(-left // per)
                fresh += count
            else:
                per = room // length
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    tree.mark(room, False)
            full = min(count, left // per)
            if full:
                plan.append((length, rank, rank + full * per, per, first, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < count:
                plan.append((length, rank, rank + left, per, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, count - full)
    return plan


def tokenized_pieces(docs: DataFrame, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) of each piece of each document row.

    A document is the ids of its whole text, null counting as empty, and ``end_id``; only one longer than
    ``capacity`` is cut. Repeated rows give repeated pieces.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = whole_texts(tokenizer, "word")
        for batch in batches:
            out: list[tuple] = []
            size = 0
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, words.encode([t.as_py() for t in batch.column(1)]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    out.append((key, n, start, len(piece), piece.tobytes()))
                size += ids.nbytes
                if size >= 8 << 20:
                    yield as_batch(out)
                    out, size = [], 0
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return base.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def place(pieces: DataFrame, *, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, a table that can be reread; lengths are 1 to ``capacity``.

    Each row gets a place of its own, ties and repeated rows too; which of two rows of equal length comes first
    is arbitrary. An empty table stays empty. All other columns pass through; columns of the two new names are replaced.
    """
    pieces = pieces.drop(*(c for c in ("sequence_id", "offset") if c != length))
    counted = pieces.groupBy(F.col(length).cast("int").alias("l")).count().collect()  # at most ``capacity`` rows
    plan = plan_packing({r["l"]: r["count"] for r in counted}, capacity)
    salts = max(1, math.isqrt(sum(r["count"] for r in counted)))
    salted = pieces.withColumns({"__l": F.col(length).cast("int"), "__salt": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))})
    salted = stored(salted, "salted-pieces")
    cell = Window.partitionBy("__l", "__salt")
    before = Window.partitionBy("__l").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = salted.groupBy("__l", "__salt").agg(F.count("*").alias("__n")).select("__l", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__row", F.row_number().over(cell.orderBy(F.lit(1)))).join(cells, ["__l", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    spots = pieces.sparkSession.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], "__p_l int, __p_lo long, __p_hi long, __p_per long, __p_first long, __p_offset long")
    at = F.col("__rank") - F.col("__p_lo")
    return (
        ranked.join(F.broadcast(spots), (F.col("__l") == F.col("__p_l")) & (F.col("__rank") >= F.col("__p_lo")) & (F.col("__rank") < F.col("__p_hi")))
        .withColumns({"__sequence": F.col("__p_first") + F.floor(at / F.col("__p_per")), "__offset": F.col("__p_offset") + at % F.col("__p_per") * F.col("__l")})
        .select(*pieces.columns, F.col("__sequence").cast("long").alias("sequence_id"), F.col("__offset").cast("long").alias("offset"))
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of each packed sequence, from placed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))

"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame expressions only.

A document's fingerprint keeps every distinct hash of its 5-word shingles below a fixed fraction of the hash range,
so fingerprints of parts can be merged by union, and the share of the smaller one's hashes that the other has too
estimates containment between texts of very unequal length. The smallest hash is always kept, so that a short text
has a fingerprint; a text without words has an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
HASH_BITS = 48
#: One in SCALE shingle hashes is kept.
SCALE = 4
#: Rows of one range of ids, about, and the most ranges, beyond which they grow; windows over them spill. They set how
#: sorting is spread, not what comes out.
RANGE_ROWS, MAX_RANGES = 5000, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column) -> Column:
    """A HASH_BITS-bit hash of each run of SHINGLE word hashes, or of all words where there are fewer."""
    n = F.size(words)
    cut = lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: cut(F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE)))))
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(cut(F.xxhash64(words)))).otherwise(F.array().cast("array<long>"))


def kept_hashes(shingles: Column) -> Column:
    """The sketch: sorted distinct hashes below the threshold, and the smallest hash."""
    least = F.when(F.size(shingles) > 0, F.array(F.array_min(shingles))).otherwise(F.array().cast("array<long>"))
    return F.array_sort(F.array_union(F.filter(shingles, lambda h: h < (1 << HASH_BITS) // SCALE), least))


def add_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Each step is a projection of its own, so that no array is computed anew for each of its elements."""
    return df.withColumn(name, word_hashes(F.col(text))).withColumn(name, shingle_hashes(F.col(name))).withColumn(name, kept_hashes(F.col(name)))


def as_text(sketch: Column) -> Column:
    """The sketch as hexadecimal digits, HASH_BITS / 4 for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that both have: 1 for two empty ones, 0 for one empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def place_in(bounds: list[int], key: Column) -> Column:
    """How many of the rising ``bounds`` are at most ``key``, by halving steps; null keys count none.

    The steps are rows of a fold, so the expression is as small for many bounds as for few.
    """
    table, steps = F.lit(np.array(bounds, np.int64)), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    reached = lambda out, step: (out + step <= len(bounds)) & (F.get(table, out + step - 1) <= key)
    return F.aggregate(F.lit(np.array(steps, np.int32)), F.lit(0), lambda out, step: F.when(reached(out, step), out + step).otherwise(out))


def with_next(docs: DataFrame, columns: list[str], *, key: str = "doc_id") -> DataFrame:
    """Add ``next_<c>`` for each of ``columns``: its value in the next row by ``key``; after the last comes the first.

    Ranges of ids that begin with an existing id split the rows, and the first row of each range also goes to the
    range before it, so one shuffle finds every next row. Null keys come first; rows of equal keys follow each other
    in an order fixed by a hash of ``columns``; a single row is its own next.
    """
    n, least, nulls = docs.agg(F.count("*"), F.min(key), F.count_if(F.col(key).isNull())).first()
    ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx(key, F.lit(np.arange(1, ranges) / ranges), 20 * ranges)).first()[0] if ranges > 1 else []
    starts = sorted({least, *(cuts or [])} - {None})  # at most MAX_RANGES
    is_null = F.col(key).isNull()
    docs = docs.withColumn("__range", place_in(starts, F.col(key)) if starts else F.lit(0))
    own = F.col("__range")
    begins = F.coalesce(F.get(F.lit(np.array(starts, np.int64)), own - 1) == F.col(key), F.lit(False)) if starts else F.lit(False)
    is_first = is_null if nulls else F.coalesce(F.col(key) == F.lit(least), F.lit(False))
    spot = lambda at, wrap, copy: F.struct(at.cast("int").alias("range"), F.lit(wrap).alias("wrap"), F.lit(copy).alias("copy"))
    own = F.when(is_null, 0).otherwise(own)
    before = F.when(begins & (own > (0 if nulls else 1)), spot(own - 1, False, True))
    around = F.when(is_first, spot(F.lit(len(starts)), True, True))
    spots = F.filter(F.array(spot(own, False, False), before, around), lambda s: s.isNotNull())
    spread = docs.withColumn("__spot", F.explode(spots))
    order = Window.partitionBy("__spot.range").orderBy(F.col("__spot.wrap"), F.col(key).asc_nulls_first(), F.col("__spot.copy"), F.xxhash64(*columns))
    return spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("__spot.copy")).drop("__spot", "__range")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, sketch`` of every row; a null text is empty. Other columns are dropped."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return add_sketch(base, "text", "sketch")


def edited_likeness(docs: DataFrame, **names: str) -> DataFrame:
    """Fingerprints of every row's text and of its text with the last quarter replaced from the next row.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Repeated
    rows and null ids each keep their row; an empty table stays empty.
    """
    pairs = with_next(fingerprints(docs, **names), ["text", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - cut), F.substring("next_text", F.lit(1), cut))
    out = add_sketch(pairs.withColumns({"n_chars": n.cast("long"), "edited": edited}).drop("text", "next_text"), "edited", "edited_sketch")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

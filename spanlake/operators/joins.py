"""Lookups against catalogs, as-of and range joins, set differences, ordering by modular serials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Serials are 24-bit and wrap.
SERIALS = 1 << 24
#: Fixed value: sync packets from which on a gap cannot close any more.
GENUINE_SYNCS = 3


def named_facts(facts: DataFrame, catalog: DataFrame, key: str, catalog_key: str, name: str, out: str = "name") -> DataFrame:
    """Facts with their catalog name, ``#<id>`` where the catalog has none. Spark broadcasts a catalog that is small."""
    dim = catalog.select(F.col(catalog_key).alias("_k"), F.col(name).alias("_name"))
    return facts.join(dim, facts[key] == F.col("_k"), "left").withColumn(out, F.coalesce("_name", F.concat(F.lit("#"), F.col(key)))).drop("_k", "_name")


def catalog_counts(catalog: DataFrame, facts: DataFrame, catalog_key: str, key: str, count: str = "count") -> DataFrame:
    """Every catalog row with its number of facts, zero included; facts are counted before the join."""
    counts = facts.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return catalog.join(counts, catalog[catalog_key] == F.col("_k"), "left").withColumn(count, F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def unresolved(facts: DataFrame, catalog: DataFrame, key: str, catalog_key: str) -> DataFrame:
    """Facts whose id the catalog lacks."""
    return facts.join(catalog.select(F.col(catalog_key).alias(key)).distinct(), key, "left_anti")


def flagged(rows: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """Rows with whether ``other`` has their key."""
    seen = other.select(F.col(other_key).alias("_k")).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, rows[key] == F.col("_k"), "left").withColumn(name, F.coalesce("_seen", F.lit(False))).drop("_k", "_seen")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str], prefix: str = "asof_") -> DataFrame:
    """Each left row with the values of the right row of its keys with the greatest ``seq`` not above its own.

    One sorted pass over both sides together, instead of a join on a range.
    """
    cols = [c for c in left.columns]
    marked = left.withColumns({"_side": F.lit(1), **{f"_v{i}": F.lit(None).cast(right.schema[v].dataType) for i, v in enumerate(values)}, "_has": F.lit(None).cast("long")})
    other = right.select(*keys, seq, F.lit(0).alias("_side"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)), F.lit(1).cast("long").alias("_has"))
    both = marked.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(seq, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_v{i}") for i in range(len(values))))), ignorenulls=True).over(order)
    return both.withColumn("_got", got).where("_side = 1").select(*cols, *(F.col(f"_got._v{i}").alias(f"{prefix}{v}") for i, v in enumerate(values)))


def in_ranges(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Points with the ranges [start, end) that hold them: equal buckets of ``width`` first, then the bounds.

    A range goes to every bucket that it meets, so ``width`` should be about the ranges' length. ``on`` names columns
    that a point and its range share.
    """
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))).where(F.col(end) > F.col(start))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(spread, ["_b", *on]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_b")


def resolve_ranges(points: DataFrame, ranges: DataFrame, key: Sequence[str], point: str, start: str, end: str, name: str, width: int, on: Sequence[str] = ()) -> DataFrame:
    """``status`` resolved, ambiguous or missing, and the range's name where exactly one range holds the point.

    ``on`` names those of the ``key`` that a range has too and must share with its points.
    """
    hits = in_ranges(points.select(*key, point).distinct(), ranges.select(*on, start, end, name), point, start, end, width, on)
    counted = hits.groupBy(*key, point).agg(F.count("*").alias("hits"), F.min(name).alias("_one"))
    out = points.join(counted, [*key, point], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    status = F.when(F.col("hits") == 0, "missing").when(F.col("hits") == 1, "resolved").otherwise("ambiguous")
    return out.withColumns({"status": status, name: F.when(F.col("hits") == 1, F.col("_one"))}).drop("_one")


def newest_enclosing(points: DataFrame, spans: DataFrame, keys: Sequence[str], seq: str, start: str, end: str, number: str, width: int) -> DataFrame:
    """Each point with the newest span of its keys whose closed range holds it; null if none does.

    Points meet only the spans of their bucket of ``width``, which should be about the spans' length.
    """
    buckets = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    spread = spans.where(F.col(end) >= F.col(start)).select(*keys, start, end, number, F.explode(buckets).alias("_b"))
    hits = points.select(*keys, seq, F.floor(F.col(seq) / width).alias("_b")).join(spread, [*keys, "_b"]).where(F.col(seq).between(F.col(start), F.col(end)))
    best = hits.groupBy(*keys, seq).agg(F.max(number).alias(number))
    return points.join(best, [*keys, seq], "left")


def merge_by_number(sides: dict[str, DataFrame], number: str) -> DataFrame:
    """Full outer merge of tables that share a number column; each has one row a number."""
    out = None
    for df in sides.values():
        out = df if out is None else out.join(df, number, "full_outer")
    return out


def coverage(observed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Both set differences and the intersection, as ``key, status``: unseen, not_in_universe or observed."""
    a, b = observed.select(key).distinct(), known.select(key).distinct()
    return (
        b.join(a, key, "left_anti").withColumn("status", F.lit("unseen"))
        .unionByName(a.join(b, key, "left_anti").withColumn("status", F.lit("not_in_universe")))
        .unionByName(a.join(b, key, "left_semi").withColumn("status", F.lit("observed")))
    )


def in_ranges_of(rows: DataFrame, *order: Column, partitions: int | None = None) -> DataFrame:
    """Rows sorted in ranges and written, so that the ranges are fixed, with their range ``_part`` and place ``_place``."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return ranged.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def numbered(rows: DataFrame, *order: Column, name: str = "seq", by: Sequence[str] = (), partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Rows with their 0-based place in a total order, or in the order within ``by``, without one task that sees them all.

    Places within a range are counted there; what is summed up is the size of each range's part of each group, which
    also gives the groups' sizes, as ``total`` if that names a column.
    """
    ranged = in_ranges_of(rows, *(F.col(c) for c in by), *order, partitions=partitions)
    parts = ranged.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_place").alias("_lo"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", *by, (before - F.col("_lo")).alias("_shift"), F.sum("_n").over(group).alias("_total"))
    placed = _same(ranged, parts, ["_part", *by]).withColumn(name, F.col("_place") + F.col("_shift"))
    placed = placed if total is None else placed.withColumn(total, F.col("_total"))
    return placed.drop("_part", "_place", "_shift", "_total")


def _same(rows: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null; ``other`` has one row for each."""
    renamed = other.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = [rows[c].eqNullSafe(renamed[f"_by_{c}"]) for c in by]
    return rows.join(renamed, on, "left").drop(*(f"_by_{c}" for c in by)) if by else rows.crossJoin(F.broadcast(renamed))


def carried(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Add the last non-null ``value`` of the keys up to each row, however long a key's run is.

    Runs are cut into ranges that are filled by themselves; what crosses a border is one value for each key and range.
    """
    ranged = in_ranges_of(rows, *(F.col(k) for k in keys), F.col(order))
    upto = Window.partitionBy("_part", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = ranged.groupBy("_part", *keys).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col("_place"))).alias("_own"))
    before = F.last("_own", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("_part", *keys, before.alias("_before"))
    out = _same(ranged.withColumn("_own", F.last(value, ignorenulls=True).over(upto)), edges, ["_part", *keys])
    return out.withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before", "_part", "_place")


def _gaps(rows: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """``by, p, d``: values of ``at`` that follow each other; compared within buckets and across their borders."""
    spread = rows.withColumn("_b", F.floor(F.col(at) / (1 << 14)))
    inner = spread.withColumn("p", F.lag(at).over(Window.partitionBy(*by, "_b").orderBy(at))).select(*by, "p", F.col(at).alias("d"))
    edges = spread.groupBy(*by, "_b").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))  # at most 1024 of each
    across = edges.select(*by, F.lag("hi").over(Window.partitionBy(*by).orderBy("_b")).alias("p"), F.col("lo").alias("d"))
    return inner.unionByName(across).where("p is not null")


def serial_origins(rows: DataFrame, by: Sequence[str], serial: str) -> DataFrame:
    """``by, origin``: where the circular run of serials of each group starts, after the largest gap.

    An inner gap wins over an equal wrap gap, and of equal inner gaps the first. Groups without serials have no row.
    """
    distinct = rows.where(F.col(serial).isNotNull()).select(*by, F.col(serial).cast("long").alias("s")).distinct()
    inner = _gaps(distinct, by, "s").groupBy(*by).agg(F.max(F.struct((F.col("d") - F.col("p")).alias("gap"), (-F.col("d")).alias("neg"))).alias("best"))
    ends = distinct.groupBy(*by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    wrap = F.col("lo") + SERIALS - F.col("hi")
    best = _same(ends, inner, by) if by else ends.crossJoin(inner)
    return best.select(*by, F.when(wrap > F.coalesce("best.gap", F.lit(0)), F.col("lo")).otherwise(-F.col("best.neg")).alias("origin"))


def serial_origin(rows: DataFrame, serial: str) -> int | None:
    """The origin of all rows together; null without serials."""
    found = serial_origins(rows.withColumn("_all", F.lit(0)), ["_all"], serial).first()
    return found and found["origin"]


def serial_order(rows: DataFrame, thread: str, local: str, serial: str, origin: int | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dispatch order ``seq``: by distance from the origin modulo 2**24; unsynced rows follow their thread's last serial.

    Rows before a thread's first serial come first of all. With ``by`` (say, the capture) each group has an order of its
    own, from the origins of ``serial_origins``.
    """
    placed = carried(rows, [*by, thread], local, serial, "_carry")
    placed = placed.withColumn("_origin", F.lit(origin)) if not isinstance(origin, DataFrame) else _same(placed, origin.withColumnRenamed("origin", "_origin"), by)
    placed = placed.withColumn("_distance", F.pmod(F.col("_carry").cast("long") - F.coalesce("_origin", F.lit(0)), F.lit(SERIALS)))
    return numbered(placed, F.col("_distance").asc_nulls_first(), F.col(thread), F.col(local), by=by).drop("_distance", "_carry", "_origin")


def serial_gaps(rows: DataFrame, serial: str, origin: int | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gaps between serials that follow each other: the first missing serial and how many are missing, for each ``by``."""
    d = rows.where(F.col(serial).isNotNull())
    d = d.withColumn("_origin", F.lit(origin)) if not isinstance(origin, DataFrame) else _same(d, origin.withColumnRenamed("origin", "_origin"), by)
    d = d.select(*by, "_origin", F.pmod(F.col(serial).cast("long") - F.col("_origin"), F.lit(SERIALS)).alias("_d"))
    missing = F.col("d") - F.col("p") - 1
    return _gaps(d, [*by, "_origin"], "_d").where((missing > 0) & (missing < SERIALS // 2)).select(*by, F.pmod(F.col("p") + 1 + F.col("_origin"), F.lit(SERIALS)).alias("after_serial"), missing.alias("missing"))


def dispatch_summary(rows: DataFrame, by: Sequence[str], serial: str, origins: DataFrame, syncs: DataFrame | None = None) -> DataFrame:
    """``synced, unsynced, dispatched, gaps, missing_serials, gap_kind`` of each group.

    A gap is genuine if the capture has at least GENUINE_SYNCS sync packets (``syncs`` has ``by, sync_count``), else
    provisional: events may still be on their way.
    """
    counts = rows.groupBy(*by).agg(F.count(serial).alias("synced"), F.count_if(F.col(serial).isNull()).alias("unsynced"), F.count("*").alias("dispatched"))
    gaps = serial_gaps(rows, serial, origins, by).groupBy(*by).agg(F.count("*").alias("gaps"), F.sum("missing").alias("missing_serials"))
    out = _same(counts, gaps, by).fillna(0, ["gaps", "missing_serials"])
    out = out.withColumn("sync_count", F.lit(0)) if syncs is None else _same(out, syncs, by).fillna(0, ["sync_count"])
    return out.withColumn("gap_kind", F.when(F.col("gaps") > 0, F.when(F.col("sync_count") >= GENUINE_SYNCS, "genuine").otherwise("provisional"))).drop("sync_count")


def single_epoch(rows: DataFrame, by: Sequence[str], serial: str) -> DataFrame:
    """Rows, failing where a group has as many serials as there are: its order would not be told apart from a second round."""
    full = rows.groupBy(*by).agg(F.count(serial).alias("_synced")).where(F.col("_synced") >= SERIALS)
    check = F.when(F.col("_synced") >= SERIALS, F.raise_error(F.lit("UnsupportedFormat: more than one round of serials"))).otherwise(F.lit(0))
    return _same(rows, full, by).withColumn("_checked", check).where(F.col("_checked").isNull() | (F.col("_checked") == 0)).drop("_synced", "_checked")

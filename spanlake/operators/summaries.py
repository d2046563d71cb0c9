"""Aggregations: scope totals, counters, running values, percentiles, top-k, caps, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import numbered


def scope_totals(facts: DataFrame, by: Sequence[str], cycles: str) -> DataFrame:
    """Count and saturating total of cycles for each group; map-side combined."""
    return facts.groupBy(*by).agg(F.count("*").alias("count"), F.sum(F.greatest(F.col(cycles), F.lit(0))).alias("total_cycles"))


def scope_rollups(facts: DataFrame, sets: Sequence[Sequence[str]], cycles: str) -> DataFrame:
    """Totals by several groupings at once; ``grouping_id`` tells them apart. One pass over the facts."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return facts.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().cast("long").alias("grouping_id"), F.count("*").alias("count"), F.sum(cycles).alias("total_cycles"))


def counter_summary(samples: DataFrame, by: Sequence[str], seq: str, cycle: str, value: str) -> DataFrame:
    """Samples, first and last cycle and latest value in order of arrival, least and greatest value."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.min_by(cycle, seq).alias("first_cycle"), F.max_by(cycle, seq).alias("last_cycle"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.max_by(value, seq).alias("latest_value"),
    )


def running_value(ops: DataFrame, keys: Sequence[str], seq: str, op: Column, amount: Column, name: str = "value") -> DataFrame:
    """The value after each set, add, inc or dec, from 0: a sum that restarts at every set."""
    order = Window.partitionBy(*keys).orderBy(seq)
    rows = ops.withColumn("_op", op).where(F.col("_op").isin("set", "add", "inc", "dec"))
    step = F.when(F.col("_op") == "inc", 1).when(F.col("_op") == "dec", -1).otherwise(amount)
    rows = rows.withColumns({"_step": step, "_part": F.sum((F.col("_op") == "set").cast("int")).over(order)})
    return rows.withColumn(name, F.sum("_step").over(Window.partitionBy(*keys, "_part").orderBy(seq))).drop("_op", "_step", "_part")


def latest(rows: DataFrame, by: Sequence[str], value: str, *order: str) -> DataFrame:
    """The value of each group's row that is greatest in ``order``; of ties the later in the last order column."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("latest_value"), F.max(F.struct(*order))[order[0]].alias("latest_cycle"))


def ranked_values(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with the index range [lo, hi) that they take in sorted order, and the size ``n``.

    Values are counted before they are sorted, so a group shuffles its distinct values alone.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy(value)
    return counts.withColumns({"hi": F.sum("_c").over(order), "n": F.sum("_c").over(Window.partitionBy(*by))}).withColumn("lo", F.col("hi") - F.col("_c"))


def percentiles(rows: DataFrame, by: Sequence[str], value: str, index: dict[str, Column]) -> DataFrame:
    """Order statistics at the 0-based indices given as expressions of the group's size ``n``."""
    ranked = ranked_values(rows, by, value)
    pick = lambda at: F.max(F.when((F.col("lo") <= at) & (at < F.col("hi")), F.col(value)))
    return ranked.groupBy(*by).agg(F.max("n").cast("long").alias("n"), *(pick(at).alias(name) for name, at in index.items()))


def floor_index(p: float) -> Column:
    """min(n - 1, floor(p n)): the rule of the percentile table, which percentile_disc does not follow."""
    return F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))


def ceil_index(p: float) -> Column:
    """ceil(p n) - 1, at least 0: the rule of the chart labels."""
    return F.greatest(F.lit(0), F.ceil(F.lit(p) * F.col("n")) - 1)


def upper_median_index() -> Column:
    return F.floor(F.col("n") / 2)


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def top_k_per_group(rows: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups to k before and after its shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def capped(rows: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """First ``k`` rows of each group with the group's ``total`` and whether it was ``truncated``."""
    kept = top_k_per_group(rows, by, k, *order)
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"))
    return kept.join(totals, list(by)).withColumn("truncated", F.col("total") > k)


def inventory(events: DataFrame, by: Sequence[str], seq: str, sample: str) -> DataFrame:
    """Event types with counts and the sample of the first event."""
    return events.groupBy(*by).agg(F.count("*").alias("count"), F.min_by(sample, seq).alias("first_sample"))


def spike_flags(rows: DataFrame, cost: str, key: str, share: float = 0.9) -> DataFrame:
    """Flag rows whose cost reaches the sorted positive costs' element at floor(share n)."""
    positive = rows.where(F.col(cost) > 0)
    limit = percentiles(positive, [], cost, {"spike_limit": F.floor(F.lit(share) * F.col("n"))}).select("spike_limit")
    flag = (F.col(cost) > 0) & (F.col(cost) >= F.col("spike_limit"))
    return _with_scalar(rows, limit, "spike_limit").withColumn("is_spike", F.coalesce(flag, F.lit(False)))


def _with_scalar(rows: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """Add the only value of a one-row table as a column, as a scalar subquery."""
    return rows.withColumn(name, one.scalar())


def budget_class(value: Column, budget: Column) -> Column:
    """good up to 5 % over budget, warn up to 30 %, else bad; unknown without a value."""
    return F.when(value.isNull(), "unknown").when(value * 100 <= budget * 105, "good").when(value * 100 <= budget * 130, "warn").otherwise("bad")


def hitch_triage(frames: DataFrame, by: Sequence[str], duration: str, number: str, budget: Column) -> DataFrame:
    """Frames over budget, their share, and the first of the longest frames."""
    return frames.groupBy(*by).agg(F.count("*").alias("frames"), F.count_if(F.col(duration) > budget).alias("over_budget"), F.max_by(number, F.struct(F.col(duration), -F.col(number))).alias("worst_frame"), F.max(duration).alias("worst_duration"))


def two_phase_sum(rows: DataFrame, by: Sequence[str], value: str, salts: int) -> DataFrame:
    """Sums by salted partial groups first, for keys that hold a large part of all rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value, *rows.columns), F.lit(salts)))
    return salted.groupBy(*by, "_salt").agg(F.sum(value).alias("_s"), F.count("*").alias("_n")).groupBy(*by).agg(F.sum("_n").alias("count"), F.sum("_s").alias("total"))


def downsample_minmax(rows: DataFrame, by: Sequence[str], seq: str, metrics: Sequence[str], budget: int) -> DataFrame:
    """Keep the first and last row and each bucket's first least and first greatest row of every metric.

    All rows stay where there are at most ``budget``; a budget too small for one bucket keeps the two ends. Rows are
    numbered in ranges and buckets are plain groups, so a group of any size is spread over all tasks.
    """
    columns = rows.columns
    placed = numbered(rows, F.col(seq), name="_i", by=by, total="_n")
    ends = placed.where((F.col("_n") <= budget) | ((F.col("_i") == 0) & F.lit(budget >= 1)) | ((F.col("_i") == F.col("_n") - 1) & F.lit(budget >= 2)))
    buckets = max(0, budget - 2) // (2 * len(metrics))
    if not buckets:
        return ends.select(*columns)
    bucket = F.floor(((F.col("_i") + 1) * buckets - 1) / F.col("_n")).alias("_bucket")
    row = F.struct("_i", *columns)
    best = [f(row, F.struct(F.col(m), sign * F.col("_i"))) for m in metrics for f, sign in ((F.min_by, 1), (F.max_by, -1))]
    chosen = placed.where(F.col("_n") > budget).groupBy(*by, bucket).agg(F.array(*best).alias("_rows"))
    chosen = chosen.select(F.explode("_rows").alias("_row")).select("_row.*")
    return ends.select("_i", *columns).unionByName(chosen).dropDuplicates([*by, "_i"]).select(*columns)


def reservoir(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their key: the same rows in any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)

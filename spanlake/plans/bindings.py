"""Registered queries: every operator bound to the supplied tables.

``event_id`` is the sequence, microseconds of ``ts`` the cycle, ``user_id`` the thread or entity. Amounts are integer
cents, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import joins, pairing, summaries, timeline


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def is_type(kind: str) -> Column:
    return F.col("event_type") == kind


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, cycle, k (the number in props), cents."""
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", micros("ts").alias("cycle"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"), "value"
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval an order, from its date to its last shipment, in days; open where nothing has shipped."""
    days = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    ships = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    orders = load(spark, sf_dir, "orders")
    return orders.join(ships, orders["o_orderkey"] == ships["l_orderkey"], "left").select(
        "o_orderkey", "o_custkey", "o_orderpriority", days("o_orderdate").alias("start"), days("last").alias("end")
    )


E_SQL = """e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS cycle, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(round(value * 100) AS BIGINT) AS cents, value FROM events)"""
SPAN_SQL = """s AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS start,
    CAST(CAST(m AS DATE) - DATE '1970-01-01' AS BIGINT) AS "end"
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Pairing


def lifo_sql(keys: str) -> str:
    return f"""WITH {E_SQL}, r AS (SELECT *, event_type = 'view' AS b FROM e WHERE event_type IN ('view', 'purchase')),
    w AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE -1 END) OVER (PARTITION BY {keys} ORDER BY event_id) AS walk FROM r),
    m AS (SELECT *, least(0, min(walk) OVER (PARTITION BY {keys} ORDER BY event_id)) AS fl FROM w),
    l AS (SELECT *, fl < coalesce(lag(fl) OVER (PARTITION BY {keys} ORDER BY event_id), 0) AS lost FROM m),
    d AS (SELECT *, walk - fl + CASE WHEN b THEN 0 ELSE 1 END AS depth FROM l),
    p AS (SELECT *, lead(b) OVER x AS nb, lead(cycle) OVER x AS nc FROM d WINDOW x AS (PARTITION BY {keys}, depth, lost AND NOT b ORDER BY event_id))"""


def lifo(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("k4", F.col("k") % 4)
    return pairing.pair_lifo(rows, keys, "event_id", is_type("view"), is_type("purchase"), "cycle")


@query("span_summary", lifo_sql("user_id") + """ SELECT user_id, count(*) FILTER (b AND NOT nb) AS pairs, CAST(sum(CASE WHEN b AND NOT nb THEN nc - cycle END) AS BIGINT) AS total_cycles,
    count(*) FILTER (NOT b AND lost) AS unmatched_ends, count(*) FILTER (b AND coalesce(nb, true)) AS unterminated FROM p GROUP BY user_id ORDER BY total_cycles DESC NULLS LAST, user_id LIMIT 100""")
def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lifo(spark, sf_dir, ["user_id"])
    begin = F.col("kind") == "begin"
    totals = p.groupBy("user_id").agg(
        F.count_if(begin & F.col("matched")).alias("pairs"), F.sum("duration").alias("total_cycles"), F.count_if(~begin & ~F.col("matched")).alias("unmatched_ends"), F.count_if(begin & ~F.col("matched")).alias("unterminated")
    )
    return summaries.top_k(totals, 100, F.col("total_cycles").desc_nulls_last(), F.col("user_id"))


PAIR_COLS = "event_id, {k}, CASE WHEN b THEN 'begin' ELSE 'end' END AS kind, CAST(depth AS BIGINT) AS depth, CASE WHEN b THEN coalesce(NOT nb, false) ELSE NOT lost END AS matched, CASE WHEN b AND NOT nb THEN nc - cycle END AS duration"


@query("span_pair_lifo", lifo_sql("user_id") + f" SELECT {PAIR_COLS.format(k='user_id')} FROM p")
def span_pair_lifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifo(spark, sf_dir, ["user_id"]).select("event_id", "user_id", "kind", F.col("depth").cast("long"), "matched", "duration")


@query("span_pair_keyed", lifo_sql("user_id, k % 4") + f" SELECT {PAIR_COLS.format(k='user_id, k % 4 AS k4')} FROM p")
def span_pair_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifo(spark, sf_dir, ["user_id", "k4"]).select("event_id", "user_id", "k4", "kind", F.col("depth").cast("long"), "matched", "duration")


@query("span_pair_overwrite", f"""WITH {E_SQL}, r AS (SELECT *, event_type = 'signup' AS b FROM e WHERE event_type IN ('signup', 'click')),
    p AS (SELECT *, lag(b) OVER x AS pb, lead(b) OVER x AS nb, lead(cycle) OVER x AS nc FROM r WINDOW x AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, user_id, CASE WHEN NOT b THEN CASE WHEN pb THEN 'matched' ELSE 'unmatched' END WHEN nb IS NULL THEN 'open' WHEN nb THEN 'overwritten' ELSE 'matched' END AS outcome,
    CASE WHEN b AND NOT nb THEN nc - cycle END AS duration FROM p""")
def span_pair_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_overwrite(events(spark, sf_dir), ["user_id"], "event_id", is_type("signup"), is_type("click"), "cycle").select("event_id", "user_id", "outcome", "duration")


@query("span_last_end_wins", f"""WITH {E_SQL}, r AS (SELECT *, event_type = 'signup' AS b FROM e WHERE event_type IN ('signup', 'click')),
    n AS (SELECT *, sum(b::int) OVER (PARTITION BY user_id ORDER BY event_id) AS slot FROM r),
    o AS (SELECT *, max(CASE WHEN b THEN cycle END) OVER (PARTITION BY user_id, slot) AS bc FROM n WHERE slot > 0),
    g AS (SELECT user_id, slot, min(event_id) FILTER (b) AS begin_seq, max(bc) AS begin_cycle, arg_max(cycle, event_id) FILTER (NOT b AND cycle >= bc) AS end_cycle,
    min(event_id) FILTER (NOT b AND cycle >= bc) AS first, count(*) FILTER (NOT b AND cycle >= bc) AS revisions FROM o GROUP BY 1, 2)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS frame_number, begin_seq, begin_cycle, end_cycle, end_cycle - begin_cycle AS duration, revisions FROM g WHERE revisions > 0""")
def span_last_end_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.last_end_wins(events(spark, sf_dir), ["user_id"], "event_id", is_type("signup"), is_type("click"), "cycle")


LIFECYCLE = {"view": "create", "click": "start", "purchase": "complete", "error": "fail"}


@query("request_lifecycle", f"""WITH {E_SQL}, r AS (SELECT *, k % 10 AS handle FROM e WHERE event_type <> 'signup'),
    n AS (SELECT *, sum((event_type = 'view')::int) OVER (PARTITION BY user_id, handle ORDER BY event_id) AS no FROM r),
    g AS (SELECT user_id, handle, CAST(no AS BIGINT) AS request_no, arg_max(cycle, event_id) FILTER (event_type = 'view') AS create_cycle, arg_max(cycle, event_id) FILTER (event_type = 'click') AS start_cycle,
    arg_max(cycle, event_id) FILTER (event_type = 'purchase') AS complete_cycle, count(*) FILTER (event_type = 'click') AS starts, arg_max(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) AS f FROM n WHERE no > 0 GROUP BY 1, 2, 3)
    SELECT user_id, handle, request_no, create_cycle, start_cycle, complete_cycle, starts, CASE WHEN f = 'purchase' THEN 'completed' WHEN f = 'error' THEN 'failed' WHEN starts > 0 THEN 'started' ELSE 'created' END AS status FROM g""")
def request_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for event, k in LIFECYCLE.items():
        kind = F.when(is_type(event), F.lit(k)).otherwise(kind)
    return pairing.lifecycle(events(spark, sf_dir).withColumn("handle", F.col("k") % 10), ["user_id", "handle"], "event_id", kind, "cycle")


@query("outstanding_allocs", f"""WITH {E_SQL}, g AS (SELECT k, arg_max(event_type, event_id) AS t, max(event_id) AS alloc_seq, arg_max(cents, event_id) AS size FROM e WHERE event_type IN ('purchase', 'error') GROUP BY k)
    SELECT k, alloc_seq, size FROM g WHERE t = 'purchase'""")
def outstanding_allocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.outstanding(events(spark, sf_dir), ["k"], "event_id", is_type("purchase"), is_type("error"), "cents")


@query("handle_binding", f"""WITH {E_SQL}, s AS (SELECT *, CASE WHEN event_type = 'view' THEN {{'v': 'file-' || k}} WHEN event_type = 'error' THEN {{'v': NULL::VARCHAR}} END AS st FROM e),
    b AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS cur FROM s)
    SELECT event_id, user_id, coalesce(cur.v, '') AS path FROM b WHERE event_type = 'click'""")
def handle_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = pairing.bound_value(events(spark, sf_dir), ["user_id"], "event_id", is_type("view"), F.concat(F.lit("file-"), F.col("k")), is_type("error"), "path")
    return bound.where(is_type("click")).select("event_id", "user_id", "path")


# Aggregations


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", cents("l_extendedprice").alias("cycles"))


@query("scope_totals", """SELECT l_partkey, coalesce(p_name, '#' || l_partkey) AS name, n AS count, c AS total_cycles FROM (SELECT l_partkey, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY 1)
    LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON l_partkey = p_partkey""")
def scope_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = summaries.scope_totals(line_facts(spark, sf_dir), ["l_partkey"], "cycles")
    return joins.named_facts(totals, load(spark, sf_dir, "part").where("p_partkey % 3 <> 0"), "l_partkey", "p_partkey", "p_name")


@query("scope_totals_by_thread", "SELECT l_suppkey, l_partkey, count(*) AS count, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_cycles FROM lineitem GROUP BY 1, 2")
def scope_totals_by_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.scope_totals(line_facts(spark, sf_dir), ["l_suppkey", "l_partkey"], "cycles")


@query("scope_totals_grouping_sets", """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id, count(*) AS count, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_cycles
    FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))""")
def scope_totals_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.scope_rollups(line_facts(spark, sf_dir), [[], ["l_returnflag"], ["l_returnflag", "l_linestatus"]], "cycles")


@query("counter_summary", f"""WITH {E_SQL} SELECT event_type, count(*) AS samples, arg_min(cycle, event_id) AS first_cycle, arg_max(cycle, event_id) AS last_cycle, min(cents) AS min_value, max(cents) AS max_value, arg_max(cents, event_id) AS latest_value FROM e GROUP BY 1""")
def counter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.counter_summary(events(spark, sf_dir), ["event_type"], "event_id", "cycle", "cents")


@query("running_stat", f"""WITH {E_SQL}, o AS (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE cents END AS step, sum((event_type = 'purchase')::int) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM e WHERE event_type <> 'signup')
    SELECT event_id, user_id, CAST(sum(step) OVER (PARTITION BY user_id, seg ORDER BY event_id) AS BIGINT) AS value FROM o""")
def running_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(is_type("purchase"), "set").when(is_type("click"), "inc").when(is_type("error"), "dec").when(is_type("view"), "add")
    return summaries.running_value(events(spark, sf_dir), ["user_id"], "event_id", op, F.col("cents")).select("event_id", "user_id", "value")


@query("latest_value", f"WITH {E_SQL} SELECT user_id, event_type, arg_max(cents, event_id) AS latest_value, max(cycle) AS latest_cycle FROM e GROUP BY 1, 2")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.latest(events(spark, sf_dir), ["user_id", "event_type"], "cents", "cycle", "event_id")


def rank_sql(picks: str) -> str:
    return f"""WITH {E_SQL}, r AS (SELECT event_type, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e)
    SELECT event_type, max(n) AS n, {picks} FROM r GROUP BY 1"""


POINTS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999}


@query("percentile_floor", rank_sql(", ".join(f"max(CASE WHEN i = least(n - 1, CAST(floor({p}::DOUBLE * n) AS BIGINT)) THEN cents END) AS {name}" for name, p in POINTS.items())))
def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.percentiles(events(spark, sf_dir), ["event_type"], "cents", {name: summaries.floor_index(p) for name, p in POINTS.items()})


@query("percentile_ceil", rank_sql(", ".join(f"max(CASE WHEN i = greatest(0, CAST(ceil({p}::DOUBLE * n) AS BIGINT) - 1) THEN cents END) AS {name}" for name, p in POINTS.items())))
def percentile_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.percentiles(events(spark, sf_dir), ["event_type"], "cents", {name: summaries.ceil_index(p) for name, p in POINTS.items()})


@query("upper_median", rank_sql("max(CASE WHEN i = n // 2 THEN cents END) AS median"))
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.percentiles(events(spark, sf_dir), ["event_type"], "cents", {"median": summaries.upper_median_index()})


def day_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.floor(F.col("cycle") / 86_400_000_000).alias("day")).agg(F.sum("cents").alias("cost"), F.min("cycle").alias("begin_cycle"), F.max("cycle").alias("end_cycle"))


DAY_SQL = f"WITH {E_SQL}, d AS (SELECT CAST(floor(cycle / 86400000000) AS BIGINT) AS day, CAST(sum(cents) AS BIGINT) AS cost, min(cycle) AS begin_cycle, max(cycle) AS end_cycle FROM e GROUP BY 1)"


@query("spike_flag", DAY_SQL + """, r AS (SELECT cost, row_number() OVER (ORDER BY cost) - 1 AS i, count(*) OVER () AS n FROM d WHERE cost > 0)
    SELECT day, cost, cost > 0 AND cost >= (SELECT max(cost) FROM r WHERE i = CAST(floor(0.9::DOUBLE * n) AS BIGINT)) AS is_spike FROM d""")
def spike_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.spike_flags(day_frames(spark, sf_dir), "cost", "day").select("day", "cost", "is_spike")


@query("budget_class", DAY_SQL + " SELECT day, cost, CASE WHEN cost * 100 <= 100000 * 105 THEN 'good' WHEN cost * 100 <= 100000 * 130 THEN 'warn' ELSE 'bad' END AS class FROM d")
def budget_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_frames(spark, sf_dir).select("day", "cost", summaries.budget_class(F.col("cost"), F.lit(100_000)).alias("class"))


@query("hitch_triage", DAY_SQL + " SELECT day % 7 AS weekday, count(*) AS frames, count(*) FILTER (cost > 100000) AS over_budget, arg_max(day, (cost, -day)) AS worst_frame, max(cost) AS worst_duration FROM d GROUP BY 1")
def hitch_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.hitch_triage(day_frames(spark, sf_dir).withColumn("weekday", F.col("day") % 7), ["weekday"], "cost", "day", F.lit(100_000))


@query("partial_final_agg", f"WITH {E_SQL} SELECT user_id, count(*) AS count, CAST(sum(cents) AS BIGINT) AS total FROM e GROUP BY 1")
def partial_final_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.two_phase_sum(events(spark, sf_dir), ["user_id"], "cents", 16)


@query("inventory", f"WITH {E_SQL} SELECT user_id, event_type, count(*) AS count, arg_min(cents, event_id) AS first_sample FROM e GROUP BY 1, 2")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.inventory(events(spark, sf_dir), ["user_id", "event_type"], "event_id", "cents")


@query("topk_per_group", f"WITH {E_SQL} SELECT user_id, event_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) AS rank FROM e QUALIFY rank <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top_k_per_group(events(spark, sf_dir), ["user_id"], 5, F.desc("cents"), F.col("event_id")).select("user_id", "event_id", "cents", F.col("rank").cast("long"))


@query("topk_global", f"WITH {E_SQL} SELECT event_id, cents FROM e ORDER BY cents DESC, event_id LIMIT 40")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top_k(events(spark, sf_dir).select("event_id", "cents"), 40, F.desc("cents"), F.col("event_id"))


@query("truncate_with_total", f"WITH {E_SQL} SELECT user_id, event_id, row_number() OVER x AS rank, count(*) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) > 8 AS truncated FROM e WINDOW x AS (PARTITION BY user_id ORDER BY event_id) QUALIFY rank <= 8")
def truncate_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.capped(events(spark, sf_dir).select("user_id", "event_id"), ["user_id"], 8, F.col("event_id")).select("user_id", "event_id", F.col("rank").cast("long"), "total", "truncated")


@query("downsample_minmax", f"""WITH {E_SQL}, r AS (SELECT event_type, event_id, cents, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e),
    b AS (SELECT *, ((i + 1) * 49 - 1) // n AS bk FROM r),
    m AS (SELECT *, arg_min(i, (cents, i)) OVER (PARTITION BY event_type, bk) AS lo, arg_max(i, (cents, -i)) OVER (PARTITION BY event_type, bk) AS hi FROM b)
    SELECT event_type, event_id, cents FROM m WHERE n <= 100 OR i = 0 OR i = n - 1 OR i = lo OR i = hi""")
def downsample_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.downsample_minmax(events(spark, sf_dir).select("event_type", "event_id", "cents"), ["event_type"], "event_id", ["cents"], 100)


@query("reservoir")
def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.reservoir(events(spark, sf_dir).select("event_id", "cents"), 200, 42, "event_id")


# Joins


def some_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")


@query("catalog_join_unresolved", "SELECT c_custkey, coalesce(n_name, '#' || c_nationkey) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def catalog_join_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.named_facts(load(spark, sf_dir, "customer"), some_nations(spark, sf_dir), "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("catalog_keep_zero", "SELECT n_nationkey, n_name, count(c_custkey) AS count FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_nationkey = n_nationkey GROUP BY 1, 2")
def catalog_keep_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.catalog_counts(load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer").where("c_acctbal < 0"), "n_nationkey", "c_nationkey").select("n_nationkey", "n_name", "count")


@query("semi_saved", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS saved FROM customer")
def semi_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.flagged(load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey", "saved")


@query("anti_missing", "SELECT c_nationkey, count(*) AS unresolved FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unresolved(load(spark, sf_dir, "customer"), some_nations(spark, sf_dir), "c_nationkey", "n_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("unresolved"))


@query("two_hop_join", "SELECT s_suppkey, r_name AS category FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def two_hop_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("s_suppkey", F.col("r_name").alias("category"))


@query("asof_generation", f"WITH {E_SQL}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view') SELECT p.event_id, p.user_id, v.event_id AS asof_view, v.cents AS asof_cents FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.event_id >= v.event_id")
def asof_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    views = e.where(is_type("view")).select("user_id", "event_id", F.col("event_id").alias("view"), "cents")
    return joins.as_of(e.where(is_type("purchase")).select("event_id", "user_id"), views, ["user_id"], "event_id", ["view", "cents"])


MODULES = [(1, 10, "m1"), (8, 20, "m2"), (25, 31, "m3"), (35, 51, "m4"), (44, 46, "m5")]


@query("range_join_module", """WITH m(lo, hi, module) AS (VALUES (1, 10, 'm1'), (8, 20, 'm2'), (25, 31, 'm3'), (35, 51, 'm4'), (44, 46, 'm5')), q AS (SELECT CAST(l_quantity AS BIGINT) AS pc, count(*) AS frames FROM lineitem GROUP BY 1),
    h AS (SELECT pc, any_value(frames) AS frames, count(module) AS hits, min(module) AS one FROM q LEFT JOIN m ON pc >= lo AND pc < hi GROUP BY 1)
    SELECT pc, frames, hits, CASE hits WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN hits = 1 THEN one END AS module FROM h""")
def range_join_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = spark.createDataFrame(MODULES, "lo long, hi long, module string")
    points = load(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("pc")).agg(F.count("*").alias("frames"))
    return joins.resolve_ranges(points, modules, [], "pc", "lo", "hi", "module", 16)


@query("range_join_latest", f"""WITH {E_SQL}, s AS (SELECT user_id, event_id AS lo, event_id + 2000 AS hi, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame FROM e WHERE event_type = 'signup')
    SELECT e.event_id, e.user_id, max(frame) AS frame FROM e LEFT JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN lo AND hi WHERE event_type = 'click' GROUP BY 1, 2""")
def range_join_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    spans = e.where(is_type("signup")).select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 2000).alias("hi"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("frame"))
    return joins.newest_enclosing(e.where(is_type("click")).select("event_id", "user_id"), spans, ["user_id"], "event_id", "lo", "hi", "frame", 2000)


@query("frame_correlation", """WITH c AS (SELECT CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS frame, c_acctbal FROM customer), s AS (SELECT CAST(regexp_extract(s_name, '(\\d+)$', 1) AS BIGINT) AS frame, s_acctbal FROM supplier),
    x AS (SELECT frame, count(*) AS cpu_scopes, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cpu_cycles FROM c WHERE frame % 2 = 0 GROUP BY 1), y AS (SELECT frame, count(*) AS gpu_work, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS gpu_cycles FROM s GROUP BY 1)
    SELECT coalesce(x.frame, y.frame) AS frame, cpu_scopes, cpu_cycles, gpu_work, gpu_cycles FROM x FULL JOIN y ON x.frame = y.frame""")
def frame_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long").alias("frame")
    cpu = load(spark, sf_dir, "customer").groupBy(number("c_name")).agg(F.count("*").alias("cpu_scopes"), F.sum(cents("c_acctbal")).alias("cpu_cycles")).where("frame % 2 = 0")
    gpu = load(spark, sf_dir, "supplier").groupBy(number("s_name")).agg(F.count("*").alias("gpu_work"), F.sum(cents("s_acctbal")).alias("gpu_cycles"))
    return joins.merge_by_number({"cpu": cpu, "gpu": gpu}, "frame")


@query("tag_rollup", "SELECT r_name AS tag, count(*) AS count, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS bytes FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def tag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_nation = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(cents("c_acctbal")).alias("b"))
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    up = per_nation.join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return up.groupBy(F.col("r_name").alias("tag")).agg(F.sum("n").alias("count"), F.sum("b").alias("bytes"))


@query("set_coverage", """WITH o AS (SELECT DISTINCT event_type AS t FROM events), u(t) AS (VALUES ('click'), ('view'), ('purchase'), ('refund'), ('chargeback')),
    x AS (SELECT t, 'unseen' AS status FROM u WHERE t NOT IN (SELECT t FROM o) UNION ALL SELECT t, 'not_in_universe' FROM o WHERE t NOT IN (SELECT t FROM u) UNION ALL SELECT t, 'observed' FROM o WHERE t IN (SELECT t FROM u)) SELECT t AS event_type, status FROM x""")
def set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = spark.createDataFrame([(t,) for t in ("click", "view", "purchase", "refund", "chargeback")], "event_type string")
    return joins.coverage(load(spark, sf_dir, "events"), universe, "event_type")


# Order


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of events with serials that wrap and have gaps; every sixth event of a user is unsynced."""
    e = load(spark, sf_dir, "events").where("event_id % 3 <> 0")
    serial = F.when(F.col("event_id") % 6 != 1, F.pmod(F.col("event_id") * 7 + 16777000, F.lit(1 << 24)))
    return e.select((F.col("user_id") % 8).alias("thread"), F.col("event_id").alias("local"), serial.alias("serial"))


SYNC_SQL = "y AS (SELECT user_id % 8 AS thread, event_id AS local, CASE WHEN event_id % 6 <> 1 THEN (event_id * 7 + 16777000) % 16777216 END AS serial FROM events WHERE event_id % 3 <> 0)"
ORIGIN_SQL = """d AS (SELECT DISTINCT serial AS s FROM y WHERE serial IS NOT NULL), g AS (SELECT s, s - lag(s) OVER (ORDER BY s) AS gap FROM d),
    o AS (SELECT CASE WHEN (SELECT min(s) + 16777216 - max(s) FROM d) > coalesce(max(gap), 0) THEN (SELECT min(s) FROM d) ELSE arg_max(s, (gap, -s)) END AS origin FROM g WHERE gap IS NOT NULL)"""


@query("serial_origin", f"WITH {SYNC_SQL}, {ORIGIN_SQL} SELECT CAST(origin AS BIGINT) AS origin FROM o")
def serial_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(joins.serial_origin(synced(spark, sf_dir), "serial"),)], "origin long")


@query("serial_order", f"""WITH {SYNC_SQL}, {ORIGIN_SQL}, c AS (SELECT *, last_value(serial IGNORE NULLS) OVER (PARTITION BY thread ORDER BY local) AS carry FROM y)
    SELECT thread, local, serial, row_number() OVER (ORDER BY (carry - origin + 16777216) % 16777216 NULLS FIRST, thread, local) - 1 AS seq FROM c, o""")
def serial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synced(spark, sf_dir)
    return joins.serial_order(rows, "thread", "local", "serial", joins.serial_origin(rows, "serial") or 0)


@query("serial_gaps", f"""WITH {SYNC_SQL}, {ORIGIN_SQL}, r AS (SELECT (serial - origin + 16777216) % 16777216 AS q, origin FROM y, o WHERE serial IS NOT NULL), p AS (SELECT lag(q) OVER (ORDER BY q) AS p, q, origin FROM r)
    SELECT (p + 1 + origin) % 16777216 AS after_serial, q - p - 1 AS missing FROM p WHERE q - p - 1 > 0 AND q - p - 1 < 8388608""")
def serial_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synced(spark, sf_dir)
    return joins.serial_gaps(rows, "serial", joins.serial_origin(rows, "serial") or 0)


GROUPED_SQL = """g AS (SELECT user_id % 3 AS trace, user_id % 8 AS thread, event_id AS local, CASE WHEN event_id % 5 <> 0 THEN CAST((event_id * 7 + 16777000) % 16777216 AS BIGINT) END AS serial FROM events),
    gd AS (SELECT trace, serial, lag(serial) OVER (PARTITION BY trace ORDER BY serial) AS p FROM (SELECT DISTINCT trace, serial FROM g WHERE serial IS NOT NULL)),
    go AS (SELECT trace, CASE WHEN min(serial) + 16777216 - max(serial) > coalesce(max(serial - p), 0) THEN min(serial) ELSE arg_max(serial, (serial - p, -serial)) FILTER (p IS NOT NULL) END AS origin FROM gd GROUP BY 1)"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures of eight threads that share their thread ids; one event in five has no serial."""
    serial = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") * 7 + 16777000) % 16777216)
    return load(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("trace"), (F.col("user_id") % 8).alias("thread"), F.col("event_id").alias("local"), serial.alias("serial"))


@query("serial_order_captures", f"""WITH {GROUPED_SQL}, c AS (SELECT *, last_value(serial IGNORE NULLS) OVER (PARTITION BY trace, thread ORDER BY local) AS carry FROM g)
    SELECT c.trace, thread, local, serial, row_number() OVER (PARTITION BY c.trace ORDER BY (carry - origin + 16777216) % 16777216 NULLS FIRST, thread, local) - 1 AS seq FROM c JOIN go ON c.trace = go.trace""")
def serial_order_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.single_epoch(grouped(spark, sf_dir), ["trace"], "serial")
    return joins.serial_order(rows, "thread", "local", "serial", joins.serial_origins(rows, ["trace"], "serial"), by=["trace"])


@query("dispatch_summary", f"""WITH {GROUPED_SQL}, r AS (SELECT g.trace, (serial - origin + 16777216) % 16777216 AS q FROM g JOIN go ON g.trace = go.trace WHERE serial IS NOT NULL),
    p AS (SELECT trace, q - lag(q) OVER (PARTITION BY trace ORDER BY q) - 1 AS missing FROM r), m AS (SELECT trace, count(*) AS gaps, CAST(sum(missing) AS BIGINT) AS missing_serials FROM p WHERE missing > 0 AND missing < 8388608 GROUP BY 1),
    n AS (SELECT trace, count(serial) AS synced, count(*) - count(serial) AS unsynced, count(*) AS dispatched FROM g GROUP BY 1)
    SELECT n.*, coalesce(gaps, 0) AS gaps, coalesce(missing_serials, 0) AS missing_serials, CASE WHEN gaps > 0 THEN CASE WHEN n.trace + 2 >= 3 THEN 'genuine' ELSE 'provisional' END END AS gap_kind FROM n LEFT JOIN m ON n.trace = m.trace""")
def dispatch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir)
    syncs = rows.select("trace").distinct().withColumn("sync_count", F.col("trace") + 2)
    return joins.dispatch_summary(rows, ["trace"], "serial", joins.serial_origins(rows, ["trace"], "serial"), syncs)


@query("forward_fill_frame", f"WITH {E_SQL} SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS frame FROM e")
def forward_fill_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.forward_fill(events(spark, sf_dir), ["user_id"], "event_id", F.when(is_type("signup"), F.col("k")), "frame").select("event_id", "user_id", "frame")


@query("conversation_turns", """SELECT conv_id, turn, role, lag(role) OVER x AS previous_role, CAST(length(text) AS BIGINT) AS n_chars, CAST(sum(length(text)) OVER x AS BIGINT) AS running_chars FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(order).alias("previous_role"), F.length("text").cast("long").alias("n_chars"), F.sum(F.length("text")).over(order).alias("running_chars"))


# Timelines

QUERY_DAYS = (9300, 9400)


@query("interval_query_index", f"""WITH {SPAN_SQL} SELECT o_orderkey, o_orderpriority, start, "end" FROM s WHERE start <= 9400 AND "end" >= 9300 AND contains(lower(o_orderpriority), 'high') ORDER BY start, "end", o_custkey, o_orderkey LIMIT 500""")
def interval_query_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.index_query(order_spans(spark, sf_dir), "start", "end", ["o_custkey", "o_orderkey"], *QUERY_DAYS, text=" HIGH ", names=["o_orderpriority"])[0].select("o_orderkey", "o_orderpriority", "start", "end")


@query("interval_query_total", f"""WITH {SPAN_SQL} SELECT count(*) AS matches, least(count(*), 500) AS returned, count(*) > 500 AS truncated FROM s WHERE start <= 9400 AND "end" >= 9300""")
def interval_query_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.index_query(order_spans(spark, sf_dir), "start", "end", ["o_custkey", "o_orderkey"], *QUERY_DAYS)[1]


@query("interval_query_exact", f"""WITH {SPAN_SQL} SELECT o_orderkey, start, coalesce(least("end", 9400), 9400) AS "end", coalesce(least("end", 9400), 9400) - start AS duration FROM s WHERE start <= 9400 AND ("end" IS NULL OR "end" >= 9300) ORDER BY 2, 3, o_custkey, o_orderkey LIMIT 10000""")
def interval_query_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.exact_query(order_spans(spark, sf_dir), "start", "end", ["o_custkey", "o_orderkey"], *QUERY_DAYS, limit=20_000).select("o_orderkey", "start", "end", "duration")


@query("interval_prefix_max", f"""WITH {SPAN_SQL} SELECT o_orderkey, o_custkey, max("end") OVER (PARTITION BY o_custkey ORDER BY start, "end" NULLS FIRST, o_orderkey ROWS UNBOUNDED PRECEDING) AS prefix_end FROM s""")
def interval_prefix_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.prefix_max_end(order_spans(spark, sf_dir), ["o_custkey"], "start", "end", ["o_orderkey"]).select("o_orderkey", "o_custkey", "prefix_end")


@query("depth_pack", f"""WITH {SPAN_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY start, "end" DESC, o_orderkey) AS i FROM s WHERE "end" IS NOT NULL)
    SELECT a.o_orderkey, a.o_custkey, least(6, count(b.i)) AS depth FROM c a LEFT JOIN c b ON a.o_custkey = b.o_custkey AND b.i < a.i AND b."end" > a.start GROUP BY 1, 2""")
def depth_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.lane_depth(order_spans(spark, sf_dir).where(F.col("end").isNotNull()), ["o_custkey"], "start", "end", "o_orderkey").select("o_orderkey", "o_custkey", "depth")


@query("frame_window", DAY_SQL + " SELECT min(begin_cycle) AS window_start, max(end_cycle) AS window_end, count(*) AS frames FROM d WHERE day BETWEEN 19730 AND 19750")
def frame_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.window_of_frames(day_frames(spark, sf_dir), "day", 19730, 19750, "begin_cycle", "end_cycle")


@query("frame_ordinals", f"WITH {E_SQL}, f AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN cycle END AS c FROM e) SELECT user_id, event_id, row_number() OVER x AS ordinal, greatest(0, c - first_value(c) OVER x) AS elapsed FROM f WHERE c IS NOT NULL WINDOW x AS (PARTITION BY user_id ORDER BY c, event_id)")
def frame_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(~is_type("error"))
    return timeline.frame_ordinals(rows, ["user_id"], "cycle", "event_id").select("user_id", "event_id", F.col("ordinal").cast("long"), "elapsed")


@query("merge_latest", f"""WITH {E_SQL}, o AS (SELECT k, max(event_id) AS frame FROM e WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT k, max(event_id) AS frame FROM e WHERE k % 3 = 0 GROUP BY 1)
    SELECT k, frame FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)) ORDER BY frame DESC, k LIMIT 50""")
def merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    last = lambda rows: rows.groupBy("k").agg(F.max("event_id").alias("frame"))
    return timeline.merge_latest(last(e.where("event_id % 2 = 0")), last(e.where("k % 3 = 0")), ["k"], 50, "frame")


# Scalars


@query("text_search", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'thtion') AND contains(text, 'the ')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(timeline.matches_text(" THTION ", F.col("text")) & F.contains("text", F.lit("the "))).select("doc_id", "source")


@query("string_runs", "SELECT page_id, CAST(len(regexp_extract_all(url, '[ -~]{4,}')) AS BIGINT) AS runs, regexp_extract_all(url, '[ -~]{4,}')[1] AS first_run FROM pages")
def string_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fn.ascii_runs(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", F.size(runs).cast("long").alias("runs"), F.get(runs, F.lit(0)).alias("first_run"))


@query("name_render", "SELECT event_id, 'user ' || user_id || ' did ' || event_type AS name FROM events")
def name_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", fn.percent_s(F.lit("user %s did %s"), F.array(F.col("user_id").cast("string"), "event_type")).alias("name"))


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("scalar_math", """SELECT event_id, (user_id - event_id) % 16777216 + CASE WHEN (user_id - event_id) % 16777216 < 0 THEN 16777216 ELSE 0 END AS distance, greatest(user_id - event_id, 0) AS saturated, (user_id << 4) | (event_id & 15) AS packed,
    CASE event_id % 16 WHEN 0 THEN 'NoLogging' WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Display' WHEN 5 THEN 'Log' WHEN 6 THEN 'Verbose' WHEN 7 THEN 'VeryVerbose' ELSE 'unknown' END AS verbosity,
    '0x' || lower(printf('%X', event_id)) AS address FROM events""")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, i = F.col("user_id"), F.col("event_id")
    return load(spark, sf_dir, "events").select(
        "event_id", fn.serial_distance(u, i).alias("distance"), fn.saturating_sub(u, i).alias("saturated"), fn.packed_size(u, i, 4).alias("packed"), fn.log_verbosity(i).alias("verbosity"), fn.address_text(i).alias("address")
    )


@query("wide_table", f"WITH {E_SQL} SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, CAST(max(cents) FILTER (event_type = 'purchase') AS BIGINT) AS purchase FROM e GROUP BY 1")
def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = events(spark, sf_dir).groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id").alias("n"), F.max("cents").alias("m"))
    return wide.select("user_id", F.coalesce("click_n", F.lit(0)).alias("click"), F.coalesce("view_n", F.lit(0)).alias("view"), F.col("purchase_m").alias("purchase"))

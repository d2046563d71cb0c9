"""Operators against state machines on random rows, and their edge cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanlake.operators import joins, pairing, summaries, timeline


def spans(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(4), i, r.choice("bbe" if seed % 2 else "bee"), r.randrange(1000)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_pairing_against_state_machines(spark, seed):
    rows = spans(seed)
    df = spark.createDataFrame(rows, "e int, seq long, kind string, cycle long").withColumnRenamed("kind", "what")
    begin, end = F.col("what") == "b", F.col("what") == "e"
    stacks, lifo, slot, over = defaultdict(list), {}, {}, {}
    frames = defaultdict(list)
    for e, i, kind, cycle in rows:
        if kind == "b":
            stacks[e].append((i, cycle))
            over[e] = (i, cycle)
            slot[e] = [i, cycle, None]
        else:
            if stacks[e]:
                b, at = stacks[e].pop()
                lifo[b] = (i, max(0, cycle - at))
            if e in slot and cycle >= slot[e][1]:
                if slot[e][2] is None:
                    frames[e].append(slot[e])
                slot[e][2] = cycle
    got = pairing.pair_lifo(df, ["e"], "seq", begin, end, "cycle").where("kind = 'begin' and matched").collect()
    assert {r.seq: (r.end_seq, r.duration) for r in got} == lifo
    opened, matched = {}, {}
    for e, i, kind, cycle in rows:
        if kind == "b":
            opened[e] = (i, cycle)
        elif e in opened:
            b, at = opened.pop(e)
            matched[b] = (i, max(0, cycle - at))
    got = pairing.pair_overwrite(df, ["e"], "seq", begin, end, "cycle").where("kind = 'begin' and outcome = 'matched'").collect()
    assert {r.seq: (r.end_seq, r.duration) for r in got} == matched
    got = pairing.last_end_wins(df, ["e"], "seq", begin, end, "cycle").collect()
    assert {(r.e, r.frame_number): (r.begin_seq, r.end_cycle) for r in got} == {(e, n): (f[0], f[2]) for e, fs in frames.items() for n, f in enumerate(fs)}


def test_lifecycle_and_outstanding(spark):
    rows = [(1, 0, "start", 5), (1, 1, "create", 10), (1, 2, "start", 11), (1, 3, "complete", 20), (1, 4, "create", 30), (1, 5, "fail", 35), (2, 6, "create", 40)]
    df = spark.createDataFrame(rows, "k int, seq long, what string, cycle long")
    got = {(r.k, r.request_no): (r.status, r.starts, r.complete_cycle) for r in pairing.lifecycle(df, ["k"], "seq", F.col("what"), "cycle").collect()}
    assert got == {(1, 1): ("completed", 1, 20), (1, 2): ("failed", 0, None), (2, 1): ("created", 0, None)}
    allocs = spark.createDataFrame([(16, 0, "a", 64), (16, 1, "f", 0), (32, 2, "a", 8), (32, 3, "a", 9), (48, 4, "f", 0)], "addr long, seq long, what string, size long")
    assert [(r.addr, r.size) for r in pairing.outstanding(allocs, ["addr"], "seq", F.col("what") == "a", F.col("what") == "f", "size").collect()] == [(32, 9)]


def test_serials_wrap_and_gaps(spark):
    top = 1 << 24
    rows = [(5, 0, None), (5, 1, top - 2), (5, 2, 0), (10, 0, top - 1), (10, 1, None), (10, 2, 4)]
    df = spark.createDataFrame(rows, "thread int, local long, serial int")
    origin = joins.serial_origin(df, "serial")
    assert origin == top - 2
    order = [(r.thread, r.local) for r in joins.serial_order(df, "thread", "local", "serial", origin).orderBy("seq").collect()]
    assert order == [(5, 0), (5, 1), (10, 0), (10, 1), (5, 2), (10, 2)]
    assert [(r.after_serial, r.missing) for r in joins.serial_gaps(df, "serial", origin).collect()] == [(1, 3)]
    interleaved = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (2, 0, 1)], "thread int, local long, serial int")
    assert joins.serial_gaps(interleaved, "serial", 0).count() == 0
    assert joins.serial_origin(df.where("false"), "serial") is None


def test_percentile_rules(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v long")
    row = summaries.percentiles(df, [], "v", {"a": summaries.floor_index(0.5), "b": summaries.ceil_index(0.5), "m": summaries.upper_median_index(), "top": summaries.floor_index(0.999)}).first()
    assert (row.n, row.a, row.b, row.m, row.top) == (4, 3, 2, 3, 4)


@pytest.mark.parametrize("n,budget", [(0, 5), (1, 5), (10, 0), (10, 1), (10, 3), (50, 12), (7, 100)])
def test_downsampling(spark, n, budget):
    values = [random.Random(n).randrange(9) for _ in range(n)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, i long, v long")
    got = sorted(r.i for r in summaries.downsample_minmax(df, ["k"], "i", ["v"], budget).collect())
    buckets = max(0, budget - 2) // 2
    if n <= budget:
        want = set(range(n))
    else:
        want = ({0} if budget >= 1 else set()) | ({n - 1} if budget >= 2 else set())
        for b in range(buckets):
            part = [i for i in range(n) if ((i + 1) * buckets - 1) // n == b]
            if part:
                want |= {min(part, key=lambda i: (values[i], i)), max(part, key=lambda i: (values[i], -i))}
    assert got == sorted(want)


def test_interval_queries(spark):
    df = spark.createDataFrame([(1, 7, "Alpha", 0, 100), (2, 7, "beta", 40, 50), (3, 8, "ALPHABET", 60, None), (4, 8, None, 200, 210)], "id int, thread int, name string, s long, e long")
    rows, total = timeline.index_query(df, "s", "e", ["thread"], 45, 70, text=" alpha ", names=["name"], limit=0)
    assert [r.id for r in rows.collect()] == [1] and tuple(total.first()) == (1, 1, False)
    exact = timeline.exact_query(df, "s", "e", ["thread"], 45, 70).collect()
    assert [(r.id, r.e, r.duration) for r in exact] == [(1, 70, 70), (2, 50, 10), (3, 70, 10)]
    with pytest.raises(timeline.InvalidQuery):
        timeline.index_query(df, "s", "e", [], 9, 3)


def test_lane_depth_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), i, s := r.randrange(50), s + r.randrange(12)) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, i long, s long, e long")
    got = {x.i: x.depth for x in timeline.lane_depth(df, ["k"], "s", "e", "i").collect()}
    for k, i, s, e in rows:
        before = [x for x in rows if x[0] == k and (x[2], -x[3], x[1]) < (s, -e, i)]
        assert got[i] == min(6, sum(x[3] > s for x in before))


def test_ranges_and_coverage(spark):
    points = spark.createDataFrame([(v,) for v in (0, 5, 9, 40)], "pc long")
    modules = spark.createDataFrame([(0, 6, "a"), (5, 10, "b")], "lo long, hi long, m string")
    got = {r.pc: (r.status, r.m) for r in joins.resolve_ranges(points, modules, [], "pc", "lo", "hi", "m", 4).collect()}
    assert got == {0: ("resolved", "a"), 5: ("ambiguous", None), 9: ("resolved", "b"), 40: ("missing", None)}
    a, b = (spark.createDataFrame([(x,) for x in s], "t string") for s in ("xy", "yz"))
    assert {(r.t, r.status) for r in joins.coverage(a, b, "t").collect()} == {("x", "not_in_universe"), ("y", "observed"), ("z", "unseen")}


def test_reservoir_is_a_fair_choice_that_partitions_do_not_change(spark):
    df = spark.range(2000).withColumnRenamed("id", "i")
    first = {r.i for r in summaries.reservoir(df.repartition(7), 200, 42, "i").collect()}
    assert first == {r.i for r in summaries.reservoir(df.repartition(1), 200, 42, "i").collect()} and len(first) == 200
    halves = [sum(i < 1000 for i in {r.i for r in summaries.reservoir(df, 200, seed, "i").collect()}) for seed in range(8)]
    assert len(set(map(int, halves))) > 1 and 700 < sum(halves) < 900
    assert summaries.reservoir(df, 5000, 1, "i").count() == 2000


def test_orders_of_captures(spark):
    """Two captures with equal threads: each has an order, an origin and gaps of its own, carried over any partitioning."""
    r = random.Random(5)
    rows = []
    for trace, start in (("a", 100), ("b", joins.SERIALS - 20)):
        serials = [(start + i) % joins.SERIALS for i in range(60) if i != 7]
        for local, s in enumerate(serials):
            rows.append((trace, r.randrange(3), local, s))
            if r.random() < 0.4:
                rows.append((trace, rows[-1][1], local * 1000 + 500, None))
    rows = [(t, th, n, s) for n, (t, th, _, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "t string, th int, n long, s long").repartition(3)
    origins = joins.serial_origins(df, ["t"], "s")
    assert {x.t: x.origin for x in origins.collect()} == {"a": 100, "b": joins.SERIALS - 20}
    got = joins.serial_order(df, "th", "n", "s", origins, by=["t"]).collect()
    for trace in "ab":
        ordered = [x for x in sorted(got, key=lambda x: x.seq) if x.t == trace]
        assert [x.seq for x in ordered] == list(range(len(ordered)))
        assert [x.s for x in ordered if x.s is not None] == [s for t, _, _, s in rows if t == trace and s is not None]
        for before, x in zip(ordered, ordered[1:], strict=False):
            if x.s is None and any(y.th == x.th and y.n < x.n and y.s is not None for y in ordered):
                assert before.th == x.th and before.n < x.n
    assert {(x.t, x.missing) for x in joins.serial_gaps(df, "s", origins, ["t"]).collect()} == {("a", 1), ("b", 1)}
    kinds = joins.dispatch_summary(df, ["t"], "s", origins, spark.createDataFrame([("a", 3)], "t string, sync_count long")).collect()
    assert {x.t: (x.synced, x.gaps, x.gap_kind) for x in kinds} == {"a": (59, 1, "genuine"), "b": (59, 1, "provisional")}
    full = spark.range(joins.SERIALS).select(F.lit("a").alias("t"), F.col("id").alias("s"))
    with pytest.raises(Exception, match="UnsupportedFormat"):
        joins.single_epoch(full, ["t"], "s").count()

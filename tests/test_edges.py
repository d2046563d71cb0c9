"""Operators on empty tables and nulls."""

from pyspark.sql import functions as F

from spanlake.operators import joins, pairing, summaries, timeline

EVENTS = "e int, seq long, what string, cycle long"


def test_empty_tables(spark):
    df = spark.createDataFrame([], EVENTS)
    begin, end = F.col("what") == "b", F.col("what") == "e"
    for found in (
        pairing.pair_lifo(df, ["e"], "seq", begin, end, "cycle"), pairing.pair_overwrite(df, ["e"], "seq", begin, end, "cycle"), pairing.last_end_wins(df, ["e"], "seq", begin, end, "cycle"),
        pairing.lifecycle(df, ["e"], "seq", F.col("what"), "cycle"), summaries.counter_summary(df, ["e"], "seq", "cycle", "cycle"), summaries.percentiles(df, ["e"], "cycle", {"p": summaries.floor_index(0.5)}),
        summaries.capped(df, ["e"], 3, F.col("seq")), summaries.downsample_minmax(df, ["e"], "seq", ["cycle"], 10), joins.numbered(df, F.col("seq")), timeline.lane_depth(df, ["e"], "seq", "cycle", "seq"),
    ):
        assert found.count() == 0


def test_nulls(spark):
    df = spark.createDataFrame([(None, 0, "b", 5), (None, 1, "e", None), (1, 2, "b", None), (1, 3, "e", 9)], EVENTS)
    begin, end = F.col("what") == "b", F.col("what") == "e"
    got = {r.seq: (r.matched, r.duration) for r in pairing.pair_lifo(df, ["e"], "seq", begin, end, "cycle").collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (True, None), 3: (True, None)}
    catalog = spark.createDataFrame([(1, None), (2, "two")], "id int, name string")
    facts = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    assert [r.name for r in joins.named_facts(facts, catalog.withColumnRenamed("id", "cid"), "id", "cid", "name").orderBy("id").collect()] == [None, "#1", "two", "#3"]
    row = summaries.percentiles(df, [], "cycle", {"m": summaries.upper_median_index()}).first()
    assert (row.n, row.m) == (2, 9)


def test_numbering_is_dense_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = joins.numbered(df, F.col("v"), partitions=5)
    assert got.where("seq <> v").count() == 0


def test_added_columns_replace_those_of_their_names(spark):
    df = spark.createDataFrame([("a", 1, "b", 10, "x", 5, True), ("a", 2, "e", 30, "y", 6, False)], "e string, seq long, what string, cycle long, kind string, duration long, matched boolean")
    begin, end = F.col("what") == "b", F.col("what") == "e"
    for paired in (pairing.pair_lifo(df, ["e"], "seq", begin, end, "cycle"), pairing.pair_overwrite(df, ["e"], "seq", begin, end, "cycle")):
        assert len(paired.columns) == len(set(paired.columns))
        first = paired.where("kind = 'begin'").first()
        assert (first.duration, first.end_seq) == (20, 2)
    again = joins.numbered(df.withColumn("seq", F.lit(7)), F.col("cycle"))
    assert sorted(r.seq for r in again.collect()) == [0, 1] and again.columns.count("seq") == 1
    top = summaries.top_k_per_group(df.withColumn("rank", F.lit("z")), ["e"], 1, F.col("cycle"))
    assert [r.rank for r in top.collect()] == [1]

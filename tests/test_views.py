from pyspark.sql import functions as F

from spanlake.operators import views


def test_views(spark):
    frames = spark.createDataFrame([(i, i % 2, 100 - i, f"Name {i}") for i in range(10)], "n int, frame_type int, cost int, name string")
    assert views.frames_of(frames, "rendering").count() == 5 and views.frames_of(frames, "all").count() == 10
    assert [r.n for r in views.table_view(frames, " NAME 3", ["name"], "cost").collect()] == [3]
    assert [r.n for r in views.table_view(frames, None, ["name"], "cost", True).limit(2).collect()] == [0, 1]
    assert [r.n for r in views.selected_by_position(frames, [], "n", 0.25, 0.5).orderBy("n").collect()] == [2, 3, 4, 5]
    tops = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 2, 6), (2, "b", 1, 20)], "f int, name string, n long, c long")
    assert [tuple(r) for r in views.rolled_up(tops, [], "name", "n", "c", 1).collect()] == [("b", 1, 20, 1)]
    wide = views.wide_table(tops, "f", "name", "c", ["b", "a"]).orderBy("f")
    assert [tuple(r) for r in wide.collect()] == [(1, None, 5), (2, 20, 6)]


def test_flattened(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, "x"]}, "c": null, "d": {}}',), (None,)], "j string")
    rows = df.select(views.flattened(F.col("j")).alias("f")).collect()
    assert [tuple(x) for x in rows[0].f] == [("a.b[0]", "1"), ("a.b[1]", "x"), ("c", "null"), ("d", "{}")] and rows[1].f is None

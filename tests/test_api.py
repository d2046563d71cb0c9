"""The calls and the command line over captures on disk, and the viewer's selections and merges."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from spanlake import __main__ as cli
from spanlake import api
from spanlake import functions as fn
from spanlake.operators import timeline, views
from spanlake.plans import reports
from spanlake.sources import capture, catalog, writer
from spanlake.sources.capture import TraceError
from test_progressive import TYPES, some_events


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    for n in range(2):
        (path / f"{n}.trace").write_bytes(writer.capture_bytes(some_events(120, seed=n), TYPES))
    return path


def test_capture_calls(spark, folder, tmp_path):
    found = api.Capture(spark, str(folder))
    parts = found.inspect()
    assert parts["captures"].count() == 2 and parts["types"].count() == 2 * len(TYPES)
    want = {}
    for n in range(2):
        for _, name, _, _ in some_events(120, seed=n):
            want[n, name.partition(".")[2]] = want.get((n, name.partition(".")[2]), 0) + 1
    got = {(int(r.trace_id[-7]), r.event): r["count"] for r in found.inventory().where("logger is not null").collect()}
    assert got == want
    assert all(r.gaps > 0 and r.gap_kind for r in found.dispatch().collect())  # events without serials took some numbers
    summary = {r.trace_id[-7]: r for r in found.coverage()["summary"].collect()}
    assert summary["0"].raw_types == 1 and summary["0"].decoded_types == 3
    found.build_gpu_timeline(str(tmp_path / "gpu"))
    body = json.loads(found.bundle())
    assert body["status"] == "ok" and {r["event"] for r in body["inventory"] if "event" in r} == {e for _, e in got}
    with pytest.raises(Exception, match="exist"):
        found.build_gpu_timeline(str(tmp_path / "gpu"))
    seqs = api.visited(found.events, lambda t: t.select(["trace_id", "seq"]).slice(0, 3), "trace_id string, seq long").collect()
    assert sorted(r.seq for r in seqs) == [0, 0, 1, 1, 2, 2]


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    one = str(folder / "0.trace")
    for command in ("inspect", "inventory", "coverage"):
        assert cli.main([command, one, "--format", "text"], spark) == 0
        assert json.loads((cli.main([command, one], spark), capsys.readouterr().out)[1].splitlines()[-1])["status"] == "ok"
    out = tmp_path / "x.json"
    assert cli.main(["inventory", one, "--out", str(out)], spark) == 0 and json.loads(out.read_text())["schema_version"] == 2
    assert cli.main(["inventory", one, "--out", str(out)], spark) == 4
    assert cli.main(["dashboard-progress", one]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[-1]["kind"] == "complete"
    assert cli.main(["nothing"]) == 64 and cli.main(["inspect", str(folder / "none.trace")], spark) == 4
    (tmp_path / "bad.trace").write_bytes(b"XXXX")
    assert cli.main(["inspect", str(tmp_path / "bad.trace")], spark) == 2
    assert cli.main(["dashboard-progress", str(tmp_path / "bad.trace")]) == 2
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": io.BytesIO((folder / "0.trace").read_bytes())}))
    assert cli.main(["inspect", "-"], spark) == 0


def test_timeline_commands(spark, tmp_path):
    types = {t.name: t for t in (writer.Declared("CpuProfiler.EventSpec", (("Id", "uint32"), ("Name", "ansi_string")), True, False), writer.Declared("CpuProfiler.EventBatchV3", (("Data", "array"),), False, False))}
    batch = bytes([100 << 2 & 0x7F | 0x80 | 1, 3, 2, 5 << 2, 10 << 2 | 1, 2, 7 << 2]).hex()
    (tmp_path / "c.trace").write_bytes(writer.capture_bytes([(0, "CpuProfiler.EventSpec", None, {"Id": 1, "Name": "Tick"}), (3, "CpuProfiler.EventBatchV3", None, {"Data": batch})], types))
    index = str(tmp_path / "index")
    assert cli.main(["timeline-index", str(tmp_path / "c.trace"), "--index", index, "--format", "text"], spark) == 0
    rows, summary = api.query_timeline(spark, index, text="tick", limit=1)
    assert rows.first().name == "Tick" and summary.first()[:] == (2, 1, True)
    assert cli.main(["timeline-query", index, "--start", "9", "--end", "1"], spark) == 64
    files = capture.captures(spark, str(tmp_path / "c.trace"))
    found = api.Capture(spark, str(tmp_path / "c.trace"))
    (tmp_path / "cache").mkdir()
    built = []
    build = lambda path: (built.append(path), found.build_timeline(path))
    first = catalog.cached_timeline(spark, files, str(tmp_path / "cache"), build)
    assert catalog.cached_timeline(spark, files, str(tmp_path / "cache"), build, limit=1) == first and built == [first]
    assert catalog.read_timeline(spark, first).count() == 2
    assert [(r.name, r["count"]) for r in found.scope_totals().collect()] == [("Tick", 2)]


def test_exit_codes():
    assert [reports.exit_code(e) for e in (None, TraceError("ResourceLimit", 0, "x", "y"), timeline.InvalidQuery("x"), OSError(), RuntimeError("UnsupportedFormat at 3 in a: b"), RuntimeError("x"))] == [0, 7, 64, 4, 3, 5]


def test_merge_live(spark):
    for seed in range(12):
        r = random.Random(seed)
        old = {n: "a" for n in range(10) if r.random() < 0.8}
        lo = r.randint(0, 9)
        patch = {n: "b" for n in range(lo, r.randint(lo, 14) + 1) if r.random() < 0.8}
        want = dict(old)
        suffix = [n for n in old if patch and n >= min(patch)]
        if suffix and min(suffix) == min(patch) and all(n in patch for n in suffix):
            want = {n: v for n, v in old.items() if n < min(patch)}
        want.update(patch)
        df = lambda d: spark.createDataFrame([*d.items()], "n long, v string")
        got = {x.n: x.v for x in timeline.merge_live(df(old), df(patch), "n", 6).collect()}
        assert got == dict(sorted(want.items())[-6:]), seed


def test_brush(spark):
    df = spark.createDataFrame([("t", n * 10) for n in range(8)], "k string, n long")
    assert views.frames_of_brush(df, ["k"], "n", -3, 2).first()[:] == ("t", 0, 20) and views.frames_of_brush(df, ["k"], "n", 6, 99).first()[:] == ("t", 60, 70)
    assert views.frames_of_brush(df, ["k"], "n", 0, 99).count() == 0 and views.frames_of_brush(df, ["k"], "n", 5, 2).first()[:] == ("t", 50, 50)
    assert views.brush_of_frames(df, ["k"], "n", 15, 45).first()[:] == ("t", 2, 4) and views.brush_of_frames(df, ["k"], "n", 71, 99).count() == 0


def test_number_texts(spark):
    row = spark.range(1).select(*(fn.bytes_text(F.lit(n)) for n in (5, 2048, 3 << 20, 5 << 30)), *(fn.compact_text(F.lit(n)) for n in (999, 1500, 2_000_000, 3_450_000_000)), fn.ms_text(F.lit(0.0123)), fn.ms_text(F.lit(None).cast("double"))).first()
    assert list(row) == ["5 B", "2.0 KiB", "3.00 MiB", "5.00 GiB", "999", "1.5K", "2M", "3.5B", "12.30 ms", "—"]

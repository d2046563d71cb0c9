"""Dashboard families over events made here, payload decoders and the reports."""

import json
import struct

import pytest

from spanlake.functions import decoders
from spanlake.plans import dashboard, reports
from spanlake.sources import catalog

SCHEMA = "trace_id string, thread_id int, local_seq long, uid int, logger string, event string, serial int, scope_cycle decimal(20,0), fields string, error string"


def batch(*ops):
    return b"".join(bytes([i << 3 | op, step]) + rest for i, op, step, rest in ops)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("Counters", "Spec", {"Id": 7, "Type": 0, "Name": "fps"}), ("Counters", "SetValueInt", {"Cycle": 100, "Value": 50, "CounterId": 7}), ("Counters", "SetValueFloat", {"Cycle": 120, "Value": 75.5, "CounterId": 7}),
        ("Misc", "BeginFrame", {"Cycle": 100, "FrameType": 0}), ("Misc", "BeginFrame", {"Cycle": 150, "FrameType": 0}), ("Misc", "EndFrame", {"Cycle": 200, "FrameType": 0}), ("Misc", "EndFrame", {"Cycle": 260, "FrameType": 0}),
        ("CsvProfiler", "BeginStat", {"StatId": 9, "Cycle": 100}), ("CsvProfiler", "EndStat", {"StatId": 9, "Cycle": 150}), ("CsvProfiler", "EndStat", {"StatId": 9, "Cycle": 200}),
        ("Memory", "Alloc", {"Address": 16, "Size": 64, "RootHeap": 0}), ("Memory", "Free", {"Address": 16, "RootHeap": 0}), ("Memory", "AllocVideo", {"Address": 32, "Size": 8}),
        ("Logging", "LogCategory", {"CategoryPointer": 1, "Name": "LogInit"}), ("Logging", "LogMessageSpec", {"LogPoint": 5, "CategoryPointer": 1, "Verbosity": 0x83, "FormatString": "%d of %s"}),
        ("Logging", "LogMessage", {"LogPoint": 5, "Cycle": 3, "FormatArgs": (bytes([2, 0x44, 0xC1]) + struct.pack("<i", -3) + b"ten\0").hex()}),
        ("Stats", "EventBatch2", {"Data": batch((1, 3, 10, bytes([84])), (1, 4, 5, struct.pack("<d", 1.5)), (1, 0, 2, b"")).hex()}),
        ("GpuProfiler", "EventFrameBoundary", {"QueueId": 0x10203, "FrameNumber": 4}), ("GpuProfiler", "EventBeginWork", {"QueueId": 0x10203, "GPUTimestampTOP": 10, "CPUTimestamp": 4}), ("GpuProfiler", "EventEndWork", {"QueueId": 0x10203, "GPUTimestampBOP": 25}),
        ("Misc", "RegionBegin", {"RegionName": "load", "Category": "io", "Cycle": 5}), ("Misc", "RegionEnd", {"RegionName": "load", "Cycle": 9}),
        ("IoStore", "RequestCreate", {"RequestHandle": 3, "Cycle": 1, "Size": 10}), ("IoStore", "RequestFailed", {"RequestHandle": 3, "Cycle": 6}),
        ("Trace", "ChannelAnnounce", {"Id": 1, "Name": "cpu", "IsEnabled": 0}), ("Trace", "ChannelToggle", {"Id": 1, "IsEnabled": 1}), ("$Trace", "ThreadInfo", {"ThreadId": 2, "Name": "GameThread", "SortHint": -7, "SystemId": 99}),
        ("Other", "Thing", {"a": "<b>"}),
    ]
    df = spark.createDataFrame([("t", 9, i, 16 + i, logger, event, i, None, json.dumps(f), None) for i, (logger, event, f) in enumerate(rows)], SCHEMA)
    return dashboard.dispatched(df).cache()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_families(events):
    found = dashboard.dashboard(events)
    r = one(found["counters"])
    assert (r.samples, r.int_samples, r.first_cycle, r.last_cycle, r.min_value, r.max_value, r.latest_value, r.kind) == (2, 1, 100, 120, 50.0, 75.5, 75.5, "int")
    r = one(found["frames"])
    assert (r.begin_cycle, r.end_cycle, r.duration, r.frame_number, r.revisions) == (150, 260, 110, 0, 2)
    r = one(found["csv"])
    assert (r.begins, r.ends, r.unmatched_ends, r.total_duration) == (1, 2, 1, 50)
    assert {(m.heap, m.allocated_bytes, m.freed_bytes, m.outstanding_bytes) for m in found["memory"].collect()} == {("System memory", 64, 64, 0), ("Video memory", 8, 0, 8)}
    r = one(found["logs"])
    assert (r.category, r.verbosity, r.sample, r["count"]) == ("LogInit", "Warning", "-3 of ten", 1)
    r = one(found["stats"])
    assert (r.samples, r.min_value, r.max_value, r.latest_value) == (3, 42.0, 44.5, 44.5)
    r = one(found["gpu_queues"])
    assert (r.work_count, r.work_cycles, r.queue_type, r.gpu, r.queue_index) == (1, 15, 3, 2, 1)
    assert int(one(found["gpu_latency"]).median) == 6
    r = one(found["regions"])
    assert (r.name, r.category, r["count"], r.total_cycles) == ("load", "io", 1, 4)
    assert one(found["io_requests"]).status == "failed"
    r = one(found["channels"])
    assert (r.enabled, r.toggles) == (True, 1)
    assert one(found["threads"]).name == "GameThread" and one(found["unmodeled"]).event == "Thing"
    for name in ("bookmarks", "tasks", "task_waits", "load_requests", "load_packages", "files", "modules", "callstacks", "slate", "metadata_stack", "gpu_breadcrumbs", "llm_tags", "llm_values", "task_names", "load_classes", "io_backends", "thread_timing", "end_threads", "named_events", "file_samples", "cpu_specs", "memory_tags"):
        assert found[name].count() == 0, name


def test_reports_and_coverage(spark, events, tmp_path):
    found = {k: dashboard.FAMILIES[k](events) for k in ("counters", "unmodeled")}
    body = json.loads(reports.as_json(found, "a.trace"))
    assert body["schema_version"] == 2 and body["dashboard"]["counters"][0]["name"] == "fps"
    assert "&lt;b&gt;" in reports.as_html(found, "x <y>") and "x &lt;y&gt;" in reports.as_html(found, "x <y>")
    assert reports.as_text(found).startswith("counters (1)")
    (tmp_path / "u.txt").write_text("Other.Thing\n\n  Never.Seen \nOther.Thing\n")
    status = {r.name: r.status for r in dashboard.coverage(events, catalog.universe(spark, str(tmp_path / "u.txt"))).collect()}
    assert status["Never.Seen"] == "unseen" and status["Other.Thing"] == "observed" and status["Misc.EndFrame"] == "not_in_universe"


def test_timeline_tables_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("t", i, i + 5) for i in range(50)], "trace_id string, start_cycle long, end_cycle long")
    catalog.write_timeline(df, str(tmp_path / "x"))
    assert catalog.read_timeline(spark, str(tmp_path / "x")).where("start_cycle >= 40").count() == 10
    with pytest.raises(Exception, match="exist"):
        catalog.write_timeline(df, str(tmp_path / "x"))
    entries = spark.createDataFrame([("a", 60, 3), ("b", 50, 2), ("c", 1, 1)], "path string, bytes long, modified long")
    assert {r.path for r in catalog.evicted(entries, 100).collect()} == {"b", "c"}


def test_decoders():
    values = decoders.cbor_values(bytes.fromhex("83016161f5a1616120fb3ff8000000000000"))["values"]
    assert [decoders.shown(v) for v in values] == ["1, a, true", "a=-1", "1.5"]
    assert decoders.cbor_values(b"\xff\x01")["skipped"] == 1
    assert decoders.format_args(bytes([1, 0x44, 1]))[1] and decoders.format_args(b"") == ([], True)
    args = decoders.format_args(bytes([3, 0x41, 0x88, 0xC2]) + b"\xff" + struct.pack("<d", 2.5) + "hé".encode("utf-16-le") + b"\0\0")[0]
    assert decoders.printf_text("%5d %.1f [%-9s] 100%% %d", args) == "-1 2.5 [hé] 100% %d"
    assert decoders.metadata_name("Frame %d %f", [{"kind": "unsigned", "value": 3}, {"kind": "float", "value": 2.0}]) == "Frame 3 2.0"
    assert decoders.metadata_name("no slots", []) is None and decoders.metadata_name("%d", []) is None
    assert decoders.fnv1a(b"b", decoders.fnv1a(b"a")) == decoders.fnv1a(b"ab") == 0x089C4407B545986A


def test_messages_and_names():
    wide = "hello world".encode("utf-16-le")
    assert decoders.message_text("%s: %s", b"\xff" + wide) == "hello world: %s"
    assert decoders.message_text("no slot", b"\xff" + wide) is None
    assert decoders.message_text("%s", b"\xffplain text\x01") == "plain text" and decoders.message_text("x %d", b"") == "x %d"
    assert decoders.split_name("Pass", "Pass %d") == ("Pass", " %d") and decoders.split_name("", "Draw(%d)") == ("Draw", "(%d)") and decoders.split_name("A", "A") == ("A", None) and decoders.split_name("", "") == ("Unknown", None)
    number = [{"kind": "unsigned", "value": 3}]
    assert decoders.full_name("Pass", " %d", number) == "Pass 3" and decoders.full_name("Pass", "n%d", number) == "Pass n3" and decoders.full_name("Unknown", "n%d", number) == "n3" and decoders.full_name("Pass", "%d", []) is None
    assert decoders.field_names(bytes.fromhex("6261626163")) == ["ab", "c"]
    assert decoders.cbor_values(bytes.fromhex("62ff61"))["failed"] == 3 and decoders.cbor_values(bytes.fromhex("3bffffffffffffffff"))["failed"] > 0

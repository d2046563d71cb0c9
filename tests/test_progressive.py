"""Captures in pieces, live frames over micro-batches, CPU scopes in their contexts, and the writer's round trip."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanlake.sources import capture, cpu, writer
from spanlake.streaming import progressive, session

TYPES = {t.name: t for t in (
    writer.Declared("$Trace.ThreadInfo", (("ThreadId", "uint32"), ("Name", "ansi_string")), True, False),
    writer.Declared("Misc.BeginFrame", (("Cycle", "uint64"), ("FrameType", "uint8"))),
    writer.Declared("Misc.EndFrame", (("Cycle", "uint64"), ("FrameType", "uint8"))),
    writer.Declared("GpuProfiler.EventBeginWork", (("QueueId", "uint32"), ("GPUTimestampTOP", "uint64"), ("CPUTimestamp", "uint64"))),
    writer.Declared("GpuProfiler.EventEndWork", (("QueueId", "uint32"), ("GPUTimestampBOP", "uint64"))),
    writer.Declared("Game.Note", (("Text", "wide_string"), ("Data", "array"), ("Small", "int16"), ("Share", "float32")), False, False),
)}


def some_events(n=300, seed=1, threads=4):
    r = random.Random(seed)
    out = [(0, "$Trace.ThreadInfo", None, {"ThreadId": 2, "Name": "main"})]
    for i in range(n):
        cycle, thread = 1000 + 10 * i, r.randint(2, 1 + threads)
        kind = r.choice(["Misc.BeginFrame", "Misc.EndFrame", "GpuProfiler.EventBeginWork", "GpuProfiler.EventEndWork", "Game.Note"])
        fields = {"Misc.BeginFrame": {"Cycle": cycle, "FrameType": r.randint(0, 1)}, "Misc.EndFrame": {"Cycle": cycle, "FrameType": r.randint(0, 1)}, "GpuProfiler.EventBeginWork": {"QueueId": 7, "GPUTimestampTOP": cycle, "CPUTimestamp": cycle - r.randint(0, 500)}, "GpuProfiler.EventEndWork": {"QueueId": 7, "GPUTimestampBOP": cycle}, "Game.Note": {"Text": "é" * r.randint(0, 40), "Data": r.randbytes(r.randint(0, 3000)).hex(), "Small": -i, "Share": 0.5}}[kind]
        out.append((thread, kind, i if TYPES[kind].synced else None, fields))
    return out


def decoded(data):
    header = capture.read_header(data)
    streams = {}
    for _, thread, is_sync, _, _, _, payload in capture.read_packets(data, header.offset):
        if not is_sync:
            streams[thread] = streams.get(thread, b"") + payload
    registry = capture.read_registry(streams, header.protocol)
    return {t: [(registry[e.uid].event, e.serial, capture.field_values(registry[e.uid], e.data, e.aux)) for e in capture.thread_events(t, s, registry) if e.uid in registry] for t, s in streams.items()}


def test_written_captures_read_back():
    events = some_events()
    got = decoded(writer.capture_bytes(events, TYPES))
    for thread in {t for t, *_ in events}:
        want = [(name.partition(".")[2], serial, fields) for t, name, serial, fields in events if t == thread]
        assert got[thread] == want
    big = [(3, "Game.Note", None, {"Data": "ab" * 700_000})]
    assert decoded(writer.capture_bytes(big, TYPES))[3][0][2]["Data"] == "ab" * 700_000


@pytest.mark.parametrize("size", [1, 7, 500, 100_000])
def test_session_in_chunks(size):
    data = writer.capture_bytes(some_events(60 if size == 1 else 300, threads=1), TYPES)
    whole, parts = progressive.Session(), progressive.Session()
    first = whole.push(data)
    messages = [m for at in range(0, len(data), size) for m in parts.push(data[at : at + size])]
    assert parts.live == whole.live and parts.observed == whole.observed and parts.totals() == whole.totals()
    done = parts.finish()
    every = [*messages, *done]
    assert [m["sequence"] for m in every] == list(range(1, len(every) + 1)) and every[0]["kind"] == "bootstrap"
    assert done[-1]["kind"] == "complete" and done[-1]["inventory"] == whole.finish()[-1]["inventory"]
    assert first[0]["threads"] == [{"ThreadId": 2, "Name": "main"}]
    assert [json.loads(x)["kind"] for x in progressive.ndjson(every).splitlines()] == [m["kind"] for m in every]
    for call in (parts.finish, lambda: parts.push(b"x")):
        with pytest.raises(capture.TraceError):
            call()


def test_session_failures():
    data = writer.capture_bytes(some_events(20), TYPES)
    cut = progressive.Session()
    cut.push(data[:-3])
    assert cut.finish()[-1]["kind"] == "failed"
    assert progressive.Session().push(b"XXXX\4\7")[0]["error_kind"] == "MalformedData"
    assert progressive.Session().push(bytes(progressive.CHUNK_BYTES + 1))[0]["error_kind"] == "ResourceLimit"


def test_late_types_and_pending_work():
    # A type that is declared after its first event: the event waits and is tried again.
    data = writer.capture_bytes([(2, "Misc.BeginFrame", 1, {"Cycle": 5, "FrameType": 0})], {"Misc.BeginFrame": TYPES["Misc.BeginFrame"]})
    reader = progressive.EventReader()
    reader.protocol = 7
    packets = [p for p in capture.read_packets(data, capture.read_header(data).offset) if not p[2]]
    for _, thread, *_, payload in sorted(packets, key=lambda p: -p[1]):
        reader.feed(thread, payload)
        found = [e.uid for e in reader.events()]
    assert found == [0, 16]
    live = progressive.LiveFrames()
    live.begin_work(1, 100, 55)
    live.end_work(1, 130)
    live.begin(0, 50)
    assert len(live.pending) == 1
    live.end(0, 60)
    assert not live.pending and (live.frames[0].work, live.frames[0].work_cycles) == (1, 30)
    for i in range(progressive.PENDING_WORK + 5):
        live.begin_work(1, 10, 1000 + i)
        live.end_work(1, 20)
    assert len(live.pending) == progressive.PENDING_WORK and live.pending[0][0] == 1005


def test_latest_value():
    seen, now = [], [0.0]
    latest = progressive.LatestValue(seen.append, lambda: now[0])
    for t, v in ((0, 1), (0.01, 2), (0.02, 3), (0.2, 4), (0.25, 5)):
        now[0] = t
        latest.offer(v)
    latest.flush()
    latest.flush()
    assert seen == [1, 4, 5]


def test_live_frames_over_batches(spark, tmp_path):
    r = random.Random(3)
    marks = [(r.randint(0, 2), i, 100 + i * r.choice([1, 1, 0]), r.random() < 0.3) for i in range(400)]
    want, slots = {}, {}
    counts = {}
    for kind, _, cycle, begins in marks:
        if begins:
            slots[kind] = [cycle, None, 0]
        elif kind in slots and cycle >= slots[kind][0]:
            slot = slots[kind]
            if slot[1] is None:
                slot[1] = counts.get(kind, 0)
                counts[kind] = slot[1] + 1
            slot[2] += 1
            want[kind, slot[1]] = (slot[0], cycle, slot[2])
    df = spark.createDataFrame(marks, "frame_type long, seq long, cycle long, is_begin boolean")
    for n, (lo, hi) in enumerate(((0, 130), (130, 131), (131, 300), (300, 400))):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/marks/part={n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/marks")
    got = session.drained(session.live_frames(stream.drop("part")), "test_live_frames", "update", "frame_type", "frame_number")
    assert {(x.frame_type, x.frame_number): (x.begin_cycle, x.end_cycle, x.revision) for x in got.collect()} == want


def varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def test_plain_scopes_equal_the_state_machine():
    used = 0
    for seed in range(400):
        r = random.Random(seed)
        cycle, last, data = r.choice([0, 10**9]), 0, b""
        for _ in range(r.randint(0, 60)):
            cycle += r.choice([0, 1, 5, 100, 10**6, 10**9])
            shown = cycle if not last or r.random() < 0.3 or cycle - last >= last else cycle - last
            op = r.choice([0, 1])
            data += varint(shown << 2 | op) + (varint(r.randint(0, 9)) if op else b"")
            last = cycle = shown if shown >= last else shown + last
        state = cpu.CpuThread()
        want = [*state.decode(data), *((s.spec, s.is_metadata, s.start, -1, -1) for s in state.stack)]
        found = cpu.plain_scopes(data)
        if found is not None:
            used += 1
            assert list(zip(*(x.tolist() for x in found), strict=True)) == want
    assert used > 100 and cpu.plain_scopes(varint(8 << 2 | 2) + varint(0)) is None
    with pytest.raises(ValueError):
        cpu.plain_scopes(varint(5 << 2 | 1))


def test_metadata_contexts():
    """Saved and restored stacks: what is active when a scope closes, and which restored entry it counts for."""
    enter = lambda cycle, payload: varint(cycle << 2 | 1) + varint(payload)
    leave = lambda cycle: varint(cycle << 2)
    state = cpu.CpuThread()
    assert list(state.intervals(enter(10, 5 * 2 + 1) + enter(11, 2), 0)) == []
    state.stack_event("SaveStack", 9)
    (i,) = state.intervals(leave(20), 1)
    assert (i.spec, i.active, i.restored, i.opened, i.closed) == (1, [5], None, 0, 1)
    (i,) = state.intervals(leave(30), 2)
    assert (i.spec, i.is_metadata, i.active) == (5, True, [5]) and state.context == []
    state.stack_event("RestoreStack", 9)
    (i,) = state.intervals(enter(40, 4) + leave(50), 3)
    assert (i.spec, i.active, i.restored) == (2, [5], 5)
    list(state.intervals(enter(60, 7 * 2 + 1), 4))
    (i,) = state.intervals(enter(61, 4) + leave(62), 4)
    assert (i.active, i.restored) == ([7, 5], 5)
    state.stack_event("ClearScope")
    (i,) = state.intervals(leave(70), 5)
    assert (i.spec, i.active) == (7, []) and state.context == []
    state.stack_event("RestoreStack", 1)
    assert state.context == []

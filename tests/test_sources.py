"""Captures made here: header, packets, compression, registry, framing, CPU batches."""

import struct

import pyarrow as pa
import pytest

from spanlake.sources import capture, cpu


def declaration(uid, logger, event, fields, flags=0, protocol=7):
    out = struct.pack("<HBBBB", uid, len(fields), flags, len(logger), len(event))
    for offset, size, info, name in fields:
        out += (b"\0\0" if protocol >= 6 else b"") + struct.pack("<HHBB", offset, size, info, len(name))
    return out + (logger + event + "".join(f[3] for f in fields)).encode()


def important(uid, data):
    return struct.pack("<HH", uid, len(data)) + data


def packet(thread, payload, encode=False):
    if not encode:
        return struct.pack("<HH", len(payload) + 4, thread) + payload
    packed = pa.Codec("lz4_raw").compress(payload, asbytes=True)
    return struct.pack("<HHH", len(packed) + 6, thread | 0x8000, len(payload)) + packed


def sample(protocol=7):
    registry = important(0, declaration(16, "Counters", "Spec", [(0, 2, 1, "Id"), (2, 0, 0x88, "Name")], flags=3, protocol=protocol))
    registry += important(0, declaration(17, "Counters", "SetValueInt", [(0, 8, 3, "Cycle"), (8, 8, 0x13, "Value")], flags=0, protocol=protocol))
    registry += important(16, struct.pack("<H", 7) + struct.pack("<I", 1 | 1 << 8 | 3 << 13) + b"fps" + b"\3")
    def event(serial, cycle, value):
        return struct.pack("<H", 17 << 1 | 1) + serial.to_bytes(3, "little") + struct.pack("<Qq", cycle, value)

    enter, leave = bytes([6 << 1]) + struct.pack("<Q", 90), bytes([7 << 1]) + struct.pack("<Q", 99)
    stream = enter + event(5, 100, 50) + leave + event(6, 120, -75)
    return b"2CRT\0\0" + bytes([4, protocol]) + packet(0, registry, True) + packet(0x3FFF, b"") + packet(9, stream[:13]) + packet(9, stream[13:], True)


@pytest.mark.parametrize("protocol", [5, 7])
def test_decodes_a_capture(spark, tmp_path, protocol):
    (tmp_path / "a.trace").write_bytes(sample(protocol))
    p = capture.packets(capture.captures(spark, str(tmp_path)))
    totals = {r.thread_id: (r.packet_count, r.sync_count) for r in capture.packet_totals(p).collect()}
    assert totals == {0: (1, 0), 9: (2, 0), 0x3FFF: (1, 1)}
    types = capture.event_types(p)
    assert [(r.uid, r.event, r.no_sync) for r in types.orderBy("uid").collect()] == [(16, "Spec", False), (17, "SetValueInt", False)]
    events = capture.raw_events(p, types)
    got = [(r.thread_id, r.event, r.serial, r.scope_cycle and int(r.scope_cycle), r.fields) for r in events.where("logger is not null").orderBy("thread_id", "local_seq").collect()]
    assert got == [(0, "Spec", None, None, '{"Id": 7, "Name": "fps"}'), (9, "SetValueInt", 5, 90, '{"Cycle": 100, "Value": 50}'), (9, "SetValueInt", 6, None, '{"Cycle": 120, "Value": -75}')]
    assert {(r.event, r["count"]) for r in capture.inventory(events.where("logger is not null")).collect()} == {("Spec", 1), ("SetValueInt", 2)}


@pytest.mark.parametrize("data,kind", [(b"XXXX\4\7", "MalformedData"), (b"TRC2\4\7", "UnsupportedFormat"), (b"ECRT\3\7", "UnsupportedFormat"), (b"ECRT\4\x08", "UnsupportedFormat"), (b"EC", "MalformedData")])
def test_bad_headers(data, kind):
    with pytest.raises(capture.TraceError) as e:
        capture.read_header(data)
    assert e.value.kind == kind


def test_damaged_packets(spark, tmp_path):
    for bad in (sample()[:-1], b"ECRT\4\7" + struct.pack("<HH", 2, 9), b"ECRT\4\7" + struct.pack("<HH", 5, 0x3FFF) + b"x", b"ECRT\4\7" + struct.pack("<HHH", 8, 0x8009, 50) + b"ab"):
        with pytest.raises(capture.TraceError):
            list(capture.read_packets(bad, capture.read_header(bad).offset))
    (tmp_path / "b.trace").write_bytes(sample()[:-1])
    rows = capture.packets(capture.captures(spark, str(tmp_path)), "PERMISSIVE").collect()
    assert [r.error is not None for r in rows][-1] and len(rows) == 4


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def batch(*records):
    return b"".join(varint(cycle << 2 | op) + b"".join(map(varint, rest)) for cycle, op, *rest in records)


def test_cpu_batches(spark):
    data = batch((100, 1, 2), (10, 1, 4), (30, 0), (60, 0), (5, 0))
    state = cpu.CpuThread()
    assert list(state.decode(data)) == [(2, False, 110, 140, 30), (1, False, 100, 200, 100)]
    assert state.counts["unmatched_ends"] == 1
    coroutine = cpu.CpuThread()
    # Coroutine 9 runs a scope from 100, is set aside at 110, resumes at 200 and ends at 205.
    found = list(coroutine.decode(batch((90, 3, 9, 0), (100, 1, 2), (110, 2, 0), (200, 3, 9, 0), (205, 0))))
    assert found == [(1, False, 200, 205, 15)]
    df = spark.createDataFrame([("t", 3, 1, batch((50, 0))), ("t", 3, 0, batch((10, 1, 2), (20, 1, 6)))], "trace_id string, thread_id int, local_seq long, data binary")
    rows = cpu.cpu_intervals(df).orderBy("seq").collect()
    assert [(r.spec_id, r.start_cycle, r.end_cycle) for r in rows] == [(3, 20, 50), (1, 10, None)]
    with pytest.raises(ValueError):
        list(cpu.varints(b"\x80"))

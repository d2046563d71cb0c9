"""Reader of binary trace captures: bytes to packets, thread streams, event types, events and CPU intervals.

A capture is one binary file. Transport decoding is sequential in the file and framing is sequential in a thread, so
captures are spread over tasks first and their threads next. Errors are rows in PERMISSIVE mode and raise in FAILFAST.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the capture format.
MAGIC_METADATA, MAGIC_PLAIN, MAGIC_LEGACY = b"2CRT", b"ECRT", b"\1\0\0\0"
BIG_ENDIAN = (b"TRC2", b"TRCE")
TRANSPORT, NEWEST_PROTOCOL = 4, 7
SYNC_THREAD, THREAD_MASK, ENCODED = 0x3FFF, 0x3FFF, 0x8000
IMPORTANT_THREADS = (0, 1)
UID_NEW_EVENT, UID_AUX, UID_AUX_END, FIRST_USER_UID = 0, 1, 3, 16
KNOWN_SIZES = {6: 8, 7: 8, 8: 7, 9: 7}
ENTER_UIDS, LEAVE_UIDS = (6, 8), (7, 9)
FLAG_NAMES = ("important", "maybe_has_aux", "no_sync", "definition")
#: Most aux records of one event.
MAX_AUX = 64_000
#: Bytes of payloads that leave a task at a time.
BATCH_BYTES = 8 << 20


class TraceError(Exception):
    """``kind`` is MalformedData, ResourceLimit or UnsupportedFormat."""

    def __init__(self, kind: str, offset: int, path: str, detail: str):
        super().__init__(f"{kind} at {offset} in {path}: {detail}")
        self.kind, self.offset, self.path, self.detail = kind, offset, path, detail


class Incomplete(TraceError):
    """Bytes end before a value does; more of them may still come."""


def malformed(offset: int, path: str, detail: str) -> TraceError:
    return TraceError("MalformedData", offset, path, detail)


class Cursor:
    """Bounds-checked little-endian reads."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int, path: str) -> bytes:
        if n > self.left:
            raise Incomplete("MalformedData", self.at, path, f"needs {n} bytes, has {self.left}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, path: str) -> int:
        return int.from_bytes(self.take(n, path), "little")


@dataclass
class Header:
    magic: str
    metadata_size: int | None
    transport: int
    protocol: int
    offset: int


def read_header(data: bytes) -> Header:
    c = Cursor(data)
    magic, metadata = c.take(4, "Header.Magic"), None
    if magic in BIG_ENDIAN:
        raise TraceError("UnsupportedFormat", 0, "Header.Magic", "big-endian captures")
    if magic == MAGIC_METADATA:
        metadata = c.number(2, "Header.MetadataSize")
        c.take(metadata, "Header.Metadata")
    elif magic == MAGIC_LEGACY:
        c.at = 0
    elif magic != MAGIC_PLAIN:
        raise malformed(0, "Header.Magic", f"unknown magic {magic.hex()}")
    transport, protocol = c.number(1, "Header.TransportVersion"), c.number(1, "Header.ProtocolVersion")
    if transport != TRANSPORT:
        raise TraceError("UnsupportedFormat", c.at - 2, "Header.TransportVersion", f"transport {transport}")
    if protocol > NEWEST_PROTOCOL:
        raise TraceError("UnsupportedFormat", c.at - 1, "Header.ProtocolVersion", f"protocol {protocol}")
    return Header(magic.decode("latin-1"), metadata, transport, protocol, c.at)


def lz4_block(data: bytes, size: int, offset: int) -> bytes:
    if not size:
        return b""
    try:
        out = pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True)
    except Exception as e:
        raise malformed(offset, "Packet.CompressedData", str(e)) from e
    if len(out) != size:
        raise malformed(offset, "Packet.DecodedSize", f"expected {size} bytes, got {len(out)}")
    return out


def read_packets(data: bytes, offset: int) -> Iterator[tuple[int, int, bool, bool, int, int, bytes]]:
    """(packet_no, thread_id, is_sync, is_encoded, raw_size, decoded_size, payload) of each packet."""
    c, n = Cursor(data, offset), 0
    while c.left:
        start = c.at
        size, word = c.number(2, "Packet.PacketSize"), c.number(2, "Packet.ThreadId")
        thread, encoded = word & THREAD_MASK, bool(word & ENCODED)
        if size < 4:
            raise malformed(start, "Packet.PacketSize", f"packet size {size}")
        if thread == SYNC_THREAD:
            if size != 4:
                raise malformed(start, "Packet.Sync", f"sync packet of {size} bytes")
            yield n, thread, True, False, size, 0, b""
        elif encoded:
            if size < 6:
                raise malformed(start, "Packet.DecodedSize", f"encoded packet of {size} bytes")
            decoded = c.number(2, "Packet.DecodedSize")
            payload = lz4_block(c.take(size - 6, "Packet.CompressedData"), decoded, start)
            yield n, thread, False, True, size, decoded, payload
        else:
            yield n, thread, False, False, size, size - 4, c.take(size - 4, "Packet.Data")
        n += 1


def type_name(info: int) -> str:
    size, kind, special = 1 << (info & 3), info & 0xC0, info & 0x18
    if kind == 0x80:
        return {(8, 1): "ansi_string", (8, 2): "wide_string"}.get((special, size), "array")
    if kind == 0x40:
        return f"float{8 * size}"
    return f"{'int' if special == 0x10 else 'uint'}{8 * size}" if kind == 0 else f"unknown_0x{info:02x}"


@dataclass
class FieldType:
    name: str
    offset: int
    size: int
    family: str
    type_name: str
    ref_uid: int | None = None


@dataclass
class EventType:
    uid: int
    logger: str
    event: str
    flags: dict[str, bool]
    fields: list[FieldType] = field(default_factory=list)

    @property
    def data_size(self) -> int:
        return max((f.offset + f.size for f in self.fields), default=0)


def read_event_type(data: bytes, protocol: int) -> EventType:
    c = Cursor(data)
    uid = c.number(2, "NewEvent.EventUid")
    count, flags, logger_size, event_size = (c.number(1, "NewEvent.Header") for _ in range(4))
    raw = []
    for _ in range(count):
        family = 0
        if protocol >= 6:
            family = c.number(1, "NewEvent.FieldType")
            c.take(1, "NewEvent.Padding")
        if family > 2:
            raise malformed(c.at, "NewEvent.FieldType", f"unknown family {family}")
        offset, second, info = c.number(2, "Field.Offset"), c.number(2, "Field.Size"), 0
        if family == 2:
            c.take(1, "Field.Unused")
            info, name_size = c.number(1, "Field.TypeInfo"), 0
        else:
            info, name_size = c.number(1, "Field.TypeInfo"), c.number(1, "Field.NameSize")
        raw.append((("regular", "reference", "definition_id")[family], offset, second, info, name_size))
    text = lambda n, path: c.take(n, path).decode("latin-1")
    out = EventType(uid, text(logger_size, "NewEvent.Logger"), text(event_size, "NewEvent.Event"), {n: bool(flags >> i & 1) for i, n in enumerate(FLAG_NAMES)})
    for family, offset, second, info, name_size in raw:
        name = "DefinitionId" if family == "definition_id" else text(name_size, "Field.Name")
        out.fields.append(FieldType(name, offset, second if family == "regular" else 1 << (info & 3), family, type_name(info), second if family == "reference" else None))
    if c.left > 1:
        raise malformed(c.at, "NewEvent", f"{c.left} bytes after a declaration")
    return out


def important_events(stream: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, uid, data) of the fixed-header stream."""
    c = Cursor(stream)
    while c.left:
        at = c.at
        uid, size = c.number(2, "Events.Header"), c.number(2, "Events.Header")
        yield at, uid, c.take(size, "Events.Data")


def read_registry(streams: dict[int, bytes], protocol: int) -> dict[int, EventType]:
    """Event types by uid; captures before protocol 5 have none."""
    found: dict[int, EventType] = {}
    if protocol >= 5:
        for thread in IMPORTANT_THREADS:
            for _, uid, data in important_events(streams.get(thread, b"")):
                if uid == UID_NEW_EVENT:
                    t = read_event_type(data, protocol)
                    found[t.uid] = t
    return dict(sorted(found.items()))


def join_aux(parts: Iterator[tuple[int, bytes]]) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    for index, payload in parts:
        out[index] = out.get(index, b"") + payload
    return out


def important_aux(data: bytes, start: int) -> Iterator[tuple[int, bytes]]:
    """Aux fragments behind the fixed part of an important event."""
    c = Cursor(data, start)
    while c.left and c.data[c.at] not in (3, 6):
        if c.data[c.at] not in (1, 2):
            raise malformed(c.at, "Aux.Uid", f"uid {c.data[c.at]}")
        pack = c.number(4, "Aux.Header")
        yield pack >> 8 & 0x1F, c.take(pack >> 13, "Aux.Data")


@dataclass
class Event:
    thread_id: int
    local_seq: int
    uid: int
    serial: int | None
    scope_cycle: int | None
    data: bytes
    aux: dict[int, bytes]


class UnknownType(TraceError):
    """An event whose type is not declared, or not yet."""


def _record(c: Cursor, registry: dict[int, EventType]) -> tuple[int, int | None, bool, bytes, int]:
    """uid, serial, whether aux records follow, data and aux index of the record at the cursor."""
    at = c.at
    uid = c.number(1, "Events.Uid")
    if uid & 1:
        uid |= c.number(1, "Events.Uid") << 8
    first, uid = uid & 0xFF, uid >> 1
    if uid >= FIRST_USER_UID:
        kind = registry.get(uid)
        if kind is None:
            raise UnknownType("MalformedData", at, "Events.Uid", f"unknown uid {uid}")
        serial = None if kind.flags["no_sync"] else c.number(3, "Events.Serial")
        return uid, serial, kind.flags["maybe_has_aux"], c.take(kind.data_size, "Events.Data"), 0
    if uid == UID_AUX:
        pack = first | c.number(3, "Aux.Header") << 8
        return uid, None, False, c.take(pack >> 13, "Aux.Data"), pack >> 8 & 0x1F
    return uid, None, False, c.take(KNOWN_SIZES.get(uid, 0), "Events.Data"), 0


def normal_events(thread: int, c: Cursor, registry: dict[int, EventType], scopes: list[int], n: int = 0) -> Iterator[Event]:
    """Frame a normal thread's stream: shifted uids, serials of synced types, aux chains and the scope cycle.

    The cursor stands behind each event that comes out, and ``scopes`` holds the cycles of open scopes, so that framing
    can go on from there when more bytes have come.
    """
    while c.left:
        uid, serial, has_aux, data, _ = _record(c, registry)
        if uid == UID_AUX_END:
            continue
        parts: list[tuple[int, bytes]] = []
        while has_aux:
            kind, _, _, payload, index = _record(c, registry)
            if kind == UID_AUX_END:
                break
            if kind == UID_AUX:
                parts.append((index, payload))
                if len(parts) > MAX_AUX:
                    raise TraceError("ResourceLimit", c.at, "Aux", f"over {MAX_AUX} aux records")
        if uid in ENTER_UIDS:
            scopes.append(int.from_bytes(data, "little"))
        elif uid in LEAVE_UIDS and scopes:
            scopes.pop()
        yield Event(thread, n, uid, serial, scopes[-1] if scopes and uid >= FIRST_USER_UID else None, data, join_aux(iter(parts)))
        n += 1


def wide_text(data: bytes, path: str) -> str:
    try:
        return data.decode("utf-16-le").removesuffix("\0")
    except UnicodeDecodeError as e:
        raise malformed(0, path, str(e)) from e


def field_value(kind: FieldType, index: int, data: bytes, aux: dict[int, bytes]) -> object:
    """A field's value: number, text, list of numbers, or hexadecimal bytes."""
    if kind.type_name in ("ansi_string", "wide_string", "array"):
        raw = aux.get(index)
        if raw is None:
            return None
        if kind.type_name == "ansi_string":
            return raw.decode("latin-1").removesuffix("\0")
        return wide_text(raw, kind.name) if kind.type_name == "wide_string" else raw.hex()
    raw = data[kind.offset : kind.offset + kind.size]
    if len(raw) < kind.size:
        raise malformed(kind.offset, kind.name, "field beyond the event")
    if kind.type_name in ("float32", "float64"):
        return struct.unpack("<f" if kind.size == 4 else "<d", raw)[0]
    return int.from_bytes(raw, "little", signed=kind.type_name.startswith("int"))


def field_values(kind: EventType, data: bytes, aux: dict[int, bytes]) -> dict[str, object]:
    return {f.name: field_value(f, i, data, aux) for i, f in enumerate(kind.fields)}


# Spark

PACKETS = "trace_id string, protocol int, packet_no long, thread_id int, is_sync boolean, is_encoded boolean, raw_size int, decoded_size int, payload binary, error string"
EVENTS = "trace_id string, thread_id int, local_seq long, uid int, logger string, event string, serial int, scope_cycle decimal(20,0), fields string, blob binary, error string"
TYPES = "trace_id string, uid int, logger string, event string, important boolean, maybe_has_aux boolean, no_sync boolean, definition boolean, fields array<struct<name:string,offset:int,size:int,family:string,type_name:string,ref_uid:int>>"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """``trace_id, content`` of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("trace_id"), "content")


def packets(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """One row for each packet of each capture; in PERMISSIVE mode a capture ends with a row that has its error."""
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trace, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, protocol, failure, held = [], None, None, 0
                try:
                    data = content.as_py()
                    header = read_header(data)
                    protocol = header.protocol
                    for p in read_packets(data, header.offset):
                        rows.append((trace, protocol, *p, None))
                        held += len(p[-1])
                        if held >= BATCH_BYTES:
                            yield as_batch(rows, kinds, PACKETS)
                            rows, held = [], 0
                except TraceError as e:
                    if mode == "FAILFAST":
                        raise
                    failure = str(e)
                if failure:
                    rows.append((trace, protocol, None, None, None, None, None, None, None, failure))
                yield as_batch(rows, kinds, PACKETS)

    return files.mapInArrow(scan, PACKETS)


HEADERS = "trace_id string, magic string, metadata_size int, transport int, protocol int, data_offset int, error string"


def headers(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """The header of each capture; in PERMISSIVE mode a damaged one is a row with its error."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for trace, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    h = read_header(content.as_py())
                    rows.append((trace, h.magic, h.metadata_size, h.transport, h.protocol, h.offset, None))
                except TraceError as e:
                    if mode == "FAILFAST":
                        raise
                    rows.append((trace, None, None, None, None, None, str(e)))
            yield as_batch(rows, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), HEADERS)

    return files.mapInArrow(scan, HEADERS)


def as_batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def packet_totals(p: DataFrame) -> DataFrame:
    """Packets, bytes and sync packets of each thread."""
    return p.where("error is null").groupBy("trace_id", "thread_id").agg(F.count("*").alias("packet_count"), F.sum("raw_size").alias("raw_bytes"), F.sum("decoded_size").alias("decoded_bytes"), F.count_if("is_sync").alias("sync_count"))


def ordered_streams(batch: pa.Table) -> dict[int, bytes]:
    streams: dict[int, list[bytes]] = {}
    for _, thread, payload in sorted(zip(batch["packet_no"].to_pylist(), batch["thread_id"].to_pylist(), batch["payload"].to_pylist(), strict=True), key=lambda r: r[0]):
        streams.setdefault(thread, []).append(payload)
    return {k: b"".join(v) for k, v in streams.items()}


def event_types(p: DataFrame) -> DataFrame:
    """The declared event types of each capture; a capture has few, so the table is small."""

    def declare(table: pa.Table) -> pa.Table:
        registry = read_registry(ordered_streams(table), table["protocol"][0].as_py())
        trace = table["trace_id"][0].as_py()
        rows = [{"trace_id": trace, "uid": t.uid, "logger": t.logger, "event": t.event, **t.flags, "fields": [vars(f) for f in t.fields]} for t in registry.values()]
        struct_ = pa.struct([("name", pa.string()), ("offset", pa.int32()), ("size", pa.int32()), ("family", pa.string()), ("type_name", pa.string()), ("ref_uid", pa.int32())])
        return pa.Table.from_pylist(rows, schema=pa.schema([("trace_id", pa.string()), ("uid", pa.int32()), ("logger", pa.string()), ("event", pa.string()), *((n, pa.bool_()) for n in FLAG_NAMES), ("fields", pa.list_(struct_))]))

    return p.where(F.col("thread_id").isin(*IMPORTANT_THREADS) & F.col("error").isNull()).groupBy("trace_id").applyInArrow(declare, TYPES)


def raw_events(p: DataFrame, types: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Events of every thread in its own order, with decoded ``fields`` as JSON.

    Framing needs the thread's bytes in order, so a thread is one task; the registry comes along by a join. The array of
    a batch event, most of a capture's bytes, comes as ``blob`` and not as hexadecimal among the fields.
    """
    registry = types.groupBy("trace_id").agg(F.to_json(F.collect_list(F.struct(*(c for c in types.columns if c != "trace_id")))).alias("registry"))
    streams = p.where("error is null and not is_sync").join(registry, "trace_id", "left")
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.decimal128(20, 0), pa.string(), pa.binary(), pa.string())

    def frame(table: pa.Table) -> pa.Table:
        trace, thread, protocol = (table[c][0].as_py() for c in ("trace_id", "thread_id", "protocol"))
        known = {t["uid"]: EventType(t["uid"], t["logger"], t["event"], {n: t[n] for n in FLAG_NAMES}, [FieldType(f["name"], f["offset"], f["size"], f["family"], f["type_name"], f.get("ref_uid")) for f in t.get("fields", [])]) for t in json.loads(table["registry"][0].as_py() or "[]")}
        stream, rows = ordered_streams(table)[thread], []
        try:
            if protocol >= 5:
                for e in thread_events(thread, stream, known):
                    kind = known.get(e.uid)
                    is_batch = kind is not None and kind.event.startswith("EventBatch") and kind.logger == "CpuProfiler" and e.aux
                    blob = e.aux.pop(max(e.aux)) if is_batch else None
                    values = json.dumps(field_values(kind, e.data, e.aux)) if kind else None
                    rows.append((trace, thread, e.local_seq, e.uid, kind and kind.logger, kind and kind.event, e.serial, e.scope_cycle, values, blob, None))
        except TraceError as error:
            if mode == "FAILFAST":
                raise
            rows.append((trace, thread, len(rows), None, None, None, None, None, None, None, str(error)))
        return pa.Table.from_batches([as_batch(rows, kinds, EVENTS.replace("(20,0)", ""))])

    return streams.groupBy("trace_id", "thread_id").applyInArrow(frame, EVENTS)


def thread_events(thread: int, stream: bytes, registry: dict[int, EventType]) -> Iterator[Event]:
    if thread not in IMPORTANT_THREADS:
        yield from normal_events(thread, Cursor(stream), registry, [])
        return
    for n, (_, uid, data) in enumerate(important_events(stream)):
        kind = registry.get(uid)
        size = kind.data_size if kind else len(data)
        yield Event(thread, n, uid, None, None, data[:size], join_aux(important_aux(data, size)) if kind and kind.flags["maybe_has_aux"] else {})


def inventory(events: DataFrame) -> DataFrame:
    """Count and first sample of every event type seen."""
    return events.where("uid is not null").groupBy("trace_id", "uid", "logger", "event").agg(F.count("*").alias("count"), F.min_by("fields", F.struct("thread_id", "local_seq")).alias("first_sample"))

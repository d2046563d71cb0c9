"""Captures that arrive in pieces: packets, events and live views from the bytes so far.

A session takes chunks of any size and tells what changed; the streaming functions keep one session for each capture
in their state, so a capture may arrive over many micro-batches, its chunks in any order.
"""

from __future__ import annotations

import json
import pickle
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import capture, cpu

# Limits of a session.
CHUNK_BYTES, STREAM_BYTES, BOOTSTRAP_THREADS = 1 << 20, 1 << 30, 4096
GPU_QUEUES, OPEN_WORK, PENDING_WORK = 64, 256, 1024
PROTOCOL_VERSION = 1


class PacketReader:
    """Packets of a capture whose bytes come in pieces; a partial header or packet waits for the rest."""

    def __init__(self) -> None:
        self.header: capture.Header | None = None
        self.waiting = b""
        self.consumed = 0

    def push(self, chunk: bytes) -> Iterator[tuple]:
        """The packets that are complete now, as ``capture.read_packets`` gives them but for their number."""
        self.waiting += chunk
        if self.header is None:
            try:
                self.header = capture.read_header(self.waiting)
            except capture.Incomplete:
                return
            self._drop(self.header.offset)
        while len(self.waiting) >= 2:
            size = int.from_bytes(self.waiting[:2], "little")
            if size >= 4 and len(self.waiting) < size:
                return
            found = next(capture.read_packets(self.waiting[: max(size, 4)], 0))
            self._drop(size)
            yield found[1:]

    def _drop(self, n: int) -> None:
        self.waiting, self.consumed = self.waiting[n:], self.consumed + n

    def finish(self) -> None:
        if self.header is None or self.waiting:
            raise capture.malformed(self.consumed, "Session", f"{len(self.waiting)} bytes of an unfinished packet")


class EventReader:
    """Events of all threads as far as their bytes and their types are known; what is not, waits."""

    def __init__(self) -> None:
        self.protocol: int | None = None
        self.registry: dict[int, capture.EventType] = {}
        self.buffers: dict[int, bytes] = {}
        self.scopes: dict[int, list[int]] = {}
        self.counts: dict[int, int] = {}

    def feed(self, thread: int, payload: bytes) -> None:
        self.buffers[thread] = self.buffers.get(thread, b"") + payload

    def events(self) -> Iterator[capture.Event]:
        """What can be framed now: declarations first, so that events that came before their type are tried again."""
        if self.protocol is None or self.protocol < 5:
            return
        for thread in sorted(self.buffers, key=lambda t: t not in capture.IMPORTANT_THREADS):
            c, n = capture.Cursor(self.buffers[thread]), self.counts.get(thread, 0)
            done = 0
            try:
                found = self._important(thread, c, n) if thread in capture.IMPORTANT_THREADS else capture.normal_events(thread, c, self.registry, self.scopes.setdefault(thread, []), n)
                for event in found:
                    done, n = c.at, n + 1
                    yield event
                done = c.at
            except (capture.Incomplete, capture.UnknownType):
                pass
            self.buffers[thread], self.counts[thread] = self.buffers[thread][done:], n

    def _important(self, thread: int, c: capture.Cursor, n: int) -> Iterator[capture.Event]:
        while c.left:
            uid, size = c.number(2, "Events.Header"), c.number(2, "Events.Header")
            data = c.take(size, "Events.Data")
            if uid == capture.UID_NEW_EVENT:
                kind = capture.read_event_type(data, self.protocol or 0)
                self.registry[kind.uid] = kind
            kind = self.registry.get(uid)
            fixed = kind.data_size if kind else len(data)
            yield capture.Event(thread, n, uid, None, None, data[:fixed], capture.join_aux(capture.important_aux(data, fixed)) if kind and kind.flags["maybe_has_aux"] else {})
            n += 1

    def finish(self) -> None:
        """Fails if bytes are left that make no event."""
        for thread, left in self.buffers.items():
            if left and self.protocol is not None and self.protocol >= 5:
                raise capture.malformed(0, "Events", f"{len(left)} bytes of thread {thread} make no event")


@dataclass
class Frame:
    number: int
    frame_type: int
    begin: int
    end: int
    work: int = 0
    work_cycles: int = 0


@dataclass
class LiveFrames:
    """Frames by their markers, and GPU work that belongs to the newest frame which holds its submission.

    A begin opens a slot of its type; every later end not before the begin closes it, again and again, which revises
    the frame. Work that no frame holds yet waits; of more than PENDING_WORK the oldest is forgotten.
    """

    frames: list[Frame] = field(default_factory=list)
    slots: dict[int, tuple[int, int | None]] = field(default_factory=dict)
    revision: int = 0
    open_work: dict[int, deque] = field(default_factory=dict)
    pending: deque = field(default_factory=deque)

    def begin(self, kind: int, cycle: int) -> None:
        self.slots[kind] = cycle, None

    def end(self, kind: int, cycle: int) -> None:
        begin, at = self.slots.get(kind, (None, None))
        if begin is None or cycle < begin:
            return
        if at is None:
            at = len(self.frames)
            self.frames.append(Frame(at, kind, begin, cycle))
            self.slots[kind] = begin, at
        frame = self.frames[at]
        frame.end = cycle
        self.revision += 1
        waiting, self.pending = self.pending, deque()
        for submitted, duration in waiting:
            if not self._credit([frame], submitted, duration):
                self.pending.append((submitted, duration))

    @staticmethod
    def _credit(frames: list[Frame], submitted: int, duration: int) -> bool:
        for frame in reversed(frames):
            if frame.begin <= submitted <= frame.end:
                frame.work, frame.work_cycles = frame.work + 1, frame.work_cycles + duration
                return True
        return False

    def begin_work(self, queue: int, top: int, submitted: int) -> None:
        if queue in self.open_work or len(self.open_work) < GPU_QUEUES:
            stack = self.open_work.setdefault(queue, deque())
            stack.append((top, submitted))
            if len(stack) > OPEN_WORK:
                stack.popleft()

    def end_work(self, queue: int, bottom: int) -> None:
        stack = self.open_work.get(queue)
        if not stack:
            return
        top, submitted = stack.pop()
        if bottom < top or not submitted:
            return
        if self._credit(self.frames, submitted, bottom - top):
            self.revision += 1
            return
        if len(self.pending) >= PENDING_WORK:
            self.pending.popleft()
        self.pending.append((submitted, bottom - top))

    def record(self, name: str, values: dict) -> None:
        """Take an event by its ``Logger.Event`` name; others than frames and work change nothing."""
        if name == "Misc.BeginFrame":
            self.begin(values["FrameType"], values["Cycle"])
        elif name == "Misc.EndFrame":
            self.end(values["FrameType"], values["Cycle"])
        elif name == "GpuProfiler.EventBeginWork":
            self.begin_work(values["QueueId"], values["GPUTimestampTOP"], values["CPUTimestamp"])
        elif name == "GpuProfiler.EventEndWork":
            self.end_work(values["QueueId"], values["GPUTimestampBOP"])


class Session:
    """One capture from its first chunk to its end, as messages with a rising ``sequence``.

    ``push`` returns a bootstrap message once the header is known, then snapshots of what changed: packet totals and
    frames, each a whole replacement. ``finish`` returns the completion; anything after it is an error, as is a second
    one. A failure is a message too, and the last.
    """

    def __init__(self, max_frames: int = 120):
        self.packets, self.reader, self.live = PacketReader(), EventReader(), LiveFrames()
        self.max_frames, self.sequence, self.revision = max_frames, 0, 0
        self.threads: dict[int, dict] = {}
        self.infos: list[dict] = []
        self.observed: dict[str, int] = {}
        self.bytes, self.stream_bytes, self.count, self.sync_count = 0, 0, 0, 0
        self.phase = "reading"

    def message(self, kind: str, **body: object) -> dict:
        self.sequence += 1
        progress = {"bytes_consumed": self.bytes, "packets_observed": self.count, "phase": self.phase}
        return {"protocol_version": PROTOCOL_VERSION, "sequence": self.sequence, "kind": kind, "progress": progress, **body}

    def push(self, chunk: bytes) -> list[dict]:
        if self.phase in ("complete", "failed"):
            raise capture.malformed(self.bytes, "Session", "input after the end")
        try:
            if len(chunk) > CHUNK_BYTES:
                raise capture.TraceError("ResourceLimit", self.bytes, "Session.Chunk", f"chunk of {len(chunk)} bytes")
            return self._taken(chunk)
        except capture.TraceError as error:
            self.phase = "failed"
            return [self.message("failed", error=str(error), error_kind=error.kind)]

    def _taken(self, chunk: bytes) -> list[dict]:
        started, before, out = self.packets.header is not None, self.count, []
        self.bytes += len(chunk)
        for thread, is_sync, _, raw, size, payload in self.packets.push(chunk):
            own = self.threads.setdefault(thread, {"thread_id": thread, "packet_count": 0, "raw_bytes": 0, "decoded_bytes": 0})
            own["packet_count"], own["raw_bytes"], own["decoded_bytes"] = own["packet_count"] + 1, own["raw_bytes"] + raw, own["decoded_bytes"] + size
            self.count, self.sync_count, self.stream_bytes = self.count + 1, self.sync_count + is_sync, self.stream_bytes + size
            if self.stream_bytes > STREAM_BYTES:
                raise capture.TraceError("ResourceLimit", self.bytes, "Session.Streams", f"over {STREAM_BYTES} bytes")
            if not is_sync:
                self.reader.feed(thread, payload)
        self.reader.protocol = self.packets.header.protocol if self.packets.header else None
        for event in self.reader.events():
            self._event(event)
        if self.packets.header and not started:
            out.append(self.message("bootstrap", header=vars(self.packets.header), event_types=len(self.reader.registry), threads=self.infos[:BOOTSTRAP_THREADS], threads_truncated=len(self.infos) > BOOTSTRAP_THREADS, packets=self.totals()))
        elif self.count > before:
            out.append(self.message("snapshot", patch="transport", packets=self.totals()))
        if self.live.revision > self.revision:
            self.revision = self.live.revision
            out.append(self.frames_message())
        return out

    def _event(self, event: capture.Event) -> None:
        kind = self.reader.registry.get(event.uid)
        if kind is None:
            return
        name = f"{kind.logger}.{kind.event}"
        self.observed[name] = self.observed.get(name, 0) + 1
        if name == "$Trace.ThreadInfo" or name.startswith(("Misc.", "GpuProfiler.")):
            values = capture.field_values(kind, event.data, event.aux)
            if name == "$Trace.ThreadInfo":
                self.infos.append(values)
            else:
                self.live.record(name, values)

    def totals(self) -> dict:
        return {"count": self.count, "sync_count": self.sync_count, "threads": [self.threads[t] for t in sorted(self.threads)]}

    def frames_message(self) -> dict:
        kept = self.live.frames[-self.max_frames :]
        return self.message("snapshot", patch="frames", total_frame_count=len(self.live.frames), truncated=len(self.live.frames) > len(kept), frames=[vars(f) for f in kept])

    def finish(self) -> list[dict]:
        if self.phase in ("complete", "failed"):
            raise capture.malformed(self.bytes, "Session", "a session ends once")
        try:
            self.packets.finish()
            self.reader.finish()
        except capture.TraceError as error:
            self.phase = "failed"
            return [self.message("failed", error=str(error), error_kind=error.kind)]
        self.phase = "analyzing"
        out = [self.message("snapshot", patch="transport", packets=self.totals())]
        self.phase = "complete"
        return [*out, self.message("complete", inventory=dict(sorted(self.observed.items(), key=lambda x: (-x[1], x[0]))), total_frame_count=len(self.live.frames))]


def ndjson(messages: list[dict]) -> str:
    """Messages as one line of JSON each."""
    return "".join(json.dumps(m) + "\n" for m in messages)


class LatestValue:
    """Publishes only the newest of the values that come within an interval; ``flush`` publishes what waits."""

    def __init__(self, publish: Callable[[object], None], clock: Callable[[], float], interval: float = 0.1):
        self.publish, self.clock, self.interval = publish, clock, interval
        self.last, self.waiting = float("-inf"), deque(maxlen=1)

    def offer(self, value: object) -> None:
        self.waiting.append(value)
        if self.clock() - self.last >= self.interval:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.last = self.clock()
            self.publish(self.waiting.pop())

    def cancel(self) -> None:
        self.waiting.clear()


# Streaming: one state for each capture.


class Arrivals:
    """Chunks in the order of their numbers, whatever the order in which they come; repeated ones are ignored."""

    def __init__(self) -> None:
        self.next, self.early = 0, {}

    def take(self, number: int, data: bytes) -> Iterator[bytes]:
        if number >= self.next:
            self.early.setdefault(number, data)
        while self.next in self.early:
            yield self.early.pop(self.next)
            self.next += 1


@dataclass
class Feed:
    arrivals: Arrivals = field(default_factory=Arrivals)
    packets: PacketReader = field(default_factory=PacketReader)
    reader: EventReader = field(default_factory=EventReader)
    cpu: dict[int, cpu.CpuThread] = field(default_factory=dict)

    def events(self, chunks: pd.DataFrame) -> Iterator[capture.Event]:
        """The events that rows of ``chunk_no, data`` complete."""
        for number, data in chunks[["chunk_no", "data"]].sort_values("chunk_no").itertuples(index=False):
            for chunk in self.arrivals.take(number, data):
                for thread, is_sync, _, _, _, payload in self.packets.push(chunk):
                    if not is_sync:
                        self.reader.feed(thread, payload)
        self.reader.protocol = self.packets.header.protocol if self.packets.header else None
        yield from self.reader.events()


def _stateful(chunks: DataFrame, schema: str, rows_of: Callable[[str, Feed, pd.DataFrame], list[tuple]]) -> DataFrame:
    """Rows that each micro-batch of ``trace_id, chunk_no, data`` adds, with a ``Feed`` for each capture as state."""
    names = [p.split()[0] for p in schema.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed = pickle.loads(state.get[0]) if state.exists else Feed()
        for batch in batches:
            yield pd.DataFrame(rows_of(key[0], feed, batch), columns=names)
        state.update((pickle.dumps(feed),))

    return chunks.groupBy("trace_id").applyInPandasWithState(update, schema, "feed binary", "append", GroupStateTimeout.NoTimeout)


EVENTS = "trace_id string, thread_id int, local_seq long, uid int, logger string, event string, serial int, fields string"


def events(chunks: DataFrame) -> DataFrame:
    """Events of captures whose chunks stream in, each once it is complete and its type is known."""

    def rows(trace: str, feed: Feed, batch: pd.DataFrame) -> list[tuple]:
        out = []
        for e in feed.events(batch):
            kind = feed.reader.registry.get(e.uid)
            if kind is not None:
                out.append((trace, e.thread_id, e.local_seq, e.uid, kind.logger, kind.event, e.serial, json.dumps(capture.field_values(kind, e.data, e.aux))))
        return out

    return _stateful(chunks, EVENTS, rows)


SCOPES = "trace_id string, thread_id int, spec_id long, is_metadata boolean, start_cycle long, end_cycle long, duration long"


def scopes(chunks: DataFrame) -> DataFrame:
    """CPU scopes as they close, for a timeline that is built while its capture arrives."""

    def rows(trace: str, feed: Feed, batch: pd.DataFrame) -> list[tuple]:
        out = []
        for e in feed.events(batch):
            kind = feed.reader.registry.get(e.uid)
            if kind is None:
                continue
            name = f"{kind.logger}.{kind.event}"
            if name == "$Trace.NewTrace":
                values = capture.field_values(kind, e.data, e.aux)
                feed.cpu[-1] = cpu.CpuThread(values["StartCycle"], values["CycleFrequency"])
            elif name.startswith("CpuProfiler.EventBatch"):
                origin = feed.cpu.get(-1, cpu.CpuThread())
                thread = feed.cpu.setdefault(e.thread_id, cpu.CpuThread(origin.base, origin.frequency))
                data = bytes.fromhex(capture.field_values(kind, e.data, e.aux)["Data"] or "")
                out += [(trace, e.thread_id, i.spec, i.is_metadata, i.start, i.end, i.duration) for i in thread.intervals(data, 0)]
        return out

    return _stateful(chunks, SCOPES, rows)

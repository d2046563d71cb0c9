"""CPU scope batches: varint records of one thread to intervals.

A thread's records change one stack, with coroutines that set part of it aside, so they are decoded in order. Threads
without coroutines, rebases and metadata contexts are decoded as arrays; both ways give the same intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cycles of one second where a capture does not give its frequency, and seconds that a scope can last.
DEFAULT_SLACK, LONGEST = 10_000_000, 64
LEAVE, ENTER, SUSPEND, RESUME = range(4)


def varints(data: bytes) -> Iterator[int]:
    value = shift = 0
    for byte in data:
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            yield value
            value = shift = 0
    if shift:
        raise ValueError("a varint is cut off")


def varint_array(data: bytes) -> np.ndarray:
    """The same as unsigned 64-bit numbers."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if raw[-1] >= 0x80:
        raise ValueError("a varint is cut off")
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = (raw[starts] & 0x7F).astype(np.uint64)
    for k in range(1, int((ends - starts).max()) + 1):
        more = np.flatnonzero(ends - starts >= k)
        out[more] |= (raw[starts[more] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out


def zigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


@dataclass
class Scope:
    spec: int
    is_metadata: bool
    start: int
    before: int = 0
    batch: int = 0


@dataclass
class Interval:
    """A closed scope, with the batches that opened and closed it and the metadata that was active when it closed.

    ``active`` lists metadata ids, the innermost first; ``restored`` is the first of them that a restored stack brought.
    """

    spec: int
    is_metadata: bool
    start: int
    end: int
    duration: int
    opened: int
    closed: int
    restored: int | None
    active: list[int]


@dataclass
class CpuThread:
    """State of one thread over its batches and its metadata stack events."""

    base: int = 0
    frequency: int | None = None
    last: int = 0
    stack: list[Scope] = field(default_factory=list)
    aside: dict[int, list[Scope]] = field(default_factory=dict)
    coroutine: int | None = None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("records", "unmatched_ends", "rebases", "implausible", "coroutine_records"), 0))
    #: Metadata ids with whether a restored stack brought them, the innermost last.
    context: list[tuple[int, bool]] = field(default_factory=list)
    saved: dict[int, list[int]] = field(default_factory=dict)

    def set_aside(self, depth: int, cycle: int) -> None:
        """Take the stack above ``depth`` off; keep it if a coroutine is running."""
        if len(self.stack) > depth:
            taken, self.stack = self.stack[depth:], self.stack[:depth]
            for s in taken:
                s.before += max(0, cycle - s.start)
            if self.coroutine is not None:
                self.aside[self.coroutine] = taken

    def stack_event(self, kind: str, ident: int | None = None) -> None:
        """ClearScope, SaveStack or RestoreStack; an unknown id restores nothing."""
        if kind == "ClearScope":
            self.context = []
        elif kind == "SaveStack":
            self.saved[ident] = [m for m, _ in self.context]
        elif kind == "RestoreStack":
            self.context = [(m, True) for m in self.saved.get(ident, [])]

    def leave_metadata(self, ident: int) -> None:
        """Forget the newest entry of a metadata scope that ends, but not one that was restored."""
        for i in range(len(self.context) - 1, -1, -1):
            if self.context[i] == (ident, False):
                del self.context[i]
                return

    def decode(self, data: bytes) -> Iterator[tuple[int, bool, int, int, int]]:
        """(spec or metadata id, is_metadata, start, end, duration) of each scope that ends."""
        for i in self.intervals(data, 0):
            yield i.spec, i.is_metadata, i.start, i.end, i.duration

    def intervals(self, data: bytes, batch: int) -> Iterator[Interval]:
        """The scopes that end in a batch."""
        slack = self.frequency or DEFAULT_SLACK
        values = varints(data)
        for first in values:
            self.counts["records"] += 1
            cycle = first >> 2
            relative = cycle < self.last
            if relative:
                cycle += self.last
            if cycle < self.base:
                cycle += self.base
            anchored = self.base > 0 and self.last > 0 and max(0, self.last - self.base) < slack
            if anchored and not relative and cycle - self.last > slack:
                shift = cycle - self.last
                for s in (*self.stack, *(s for saved in self.aside.values() for s in saved)):
                    s.start += shift
                self.counts["rebases"] += 1
            op = first & 3
            if op == LEAVE:
                if self.stack:
                    s = self.stack.pop()
                    duration = s.before + max(0, cycle - s.start)
                    if duration > LONGEST * slack:
                        self.counts["implausible"] += 1
                        duration = LONGEST * slack
                    restored = next((m for m, r in reversed(self.context) if r), None)
                    yield Interval(s.spec, s.is_metadata, s.start, cycle, duration, s.batch, batch, None if s.is_metadata else restored, [m for m, _ in reversed(self.context)])
                    if s.is_metadata:
                        self.leave_metadata(s.spec)
                else:
                    self.counts["unmatched_ends"] += 1
            elif op == ENTER:
                payload = next(values)
                self.stack.append(Scope(payload >> 1, bool(payload & 1), cycle, 0, batch))
                if payload & 1:
                    self.context.append((payload >> 1, False))
            else:
                self.counts["coroutine_records"] += 1
                resumed = next(values) if op == RESUME else None
                self.set_aside(next(values), cycle)
                self.coroutine = resumed
                for s in self.aside.pop(resumed, []) if resumed is not None else []:
                    s.start = cycle
                    self.stack.append(s)
            self.last = cycle


def plain_scopes(data: bytes, frequency: int | None = None) -> tuple[np.ndarray, ...] | None:
    """Spec, is_metadata, start, end and duration of a thread's scopes as arrays; None where they need a ``CpuThread``.

    Closed scopes come first, in the order of their ends; then open ones with an end of -1. That is so for records
    without coroutines whose cycles follow one rule: at least the first cycle means absolute, less means relative.
    """
    values = varint_array(data)
    opens = (values & np.uint64(3)) == ENTER
    # A payload follows each record that opens; in a run of values that look so, every second one is a payload.
    at = np.arange(len(values))
    run_start = np.maximum.accumulate(np.where(opens & ~np.concatenate([[False], opens[:-1]]), at, -1))
    after_open = np.concatenate([[False], opens[:-1]])
    payload = after_open & (((at - np.concatenate([[0], run_start[:-1]])) & 1) == 1)
    where = np.flatnonzero(~payload)
    first = values[where]
    op = (first & np.uint64(3)).astype(np.int64)
    if len(op) and op.max() > ENTER:
        return None
    if len(where) and op[-1] == ENTER and where[-1] + 1 == len(values):
        raise ValueError("a record is cut off")
    cycles = (first >> np.uint64(2)).astype(np.int64)
    if not len(cycles):
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, bool), empty, empty, empty
    absolute = cycles >= cycles[0]
    absolute[0] = True
    steps = np.cumsum(np.where(absolute, 0, cycles))
    anchor = np.maximum.accumulate(np.where(absolute, np.arange(len(cycles)), 0))
    now = cycles[anchor] + steps - steps[anchor]
    if (absolute[1:] != (cycles[1:] >= now[:-1])).any():
        return None
    walk = np.cumsum(np.where(op == ENTER, 1, -1))
    floor = np.minimum(0, np.minimum.accumulate(walk))
    lost = (op == LEAVE) & (floor < np.concatenate([[0], floor[:-1]]))
    level = np.where(op == ENTER, walk - floor, walk - floor + 1)
    kept = np.flatnonzero(~lost)
    kept = kept[np.argsort(level[kept], kind="stable")]
    begins = op[kept] == ENTER
    partner = np.full(len(kept), -1)
    if len(kept) > 1:
        closes = begins[:-1] & ~begins[1:] & (level[kept[:-1]] == level[kept[1:]])
        partner[:-1][closes] = kept[1:][closes]
    begin, end = kept[begins], partner[begins]
    order = np.lexsort((begin, np.where(end < 0, len(op) + begin, end)))
    begin, end = begin[order], end[order]
    detail = values[where[begin] + 1]
    start, stop = now[begin], np.where(end < 0, -1, now[end])
    duration = np.minimum(np.maximum(stop - start, 0), LONGEST * (frequency or DEFAULT_SLACK))
    return (detail >> np.uint64(1)).astype(np.int64), (detail & np.uint64(1)) == 1, start, stop, np.where(end < 0, -1, duration)


INTERVALS = "trace_id string, thread_id int, seq long, spec_id long, is_metadata boolean, start_cycle long, end_cycle long, duration long, opened_seq long, closed_seq long, restored_id long, active array<long>"
_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
_NAMES = [p.split()[0] for p in INTERVALS.split(", ")]


def cpu_intervals(batches: DataFrame, base: int = 0, frequency: int | None = None, contexts: bool = False) -> DataFrame:
    """Intervals of rows of ``trace_id, thread_id, local_seq, data``; open scopes come last with null ends.

    Rows may also have ``base`` and ``frequency``, the capture's own, and with ``contexts`` ``kind`` and ``ident`` of
    metadata stack events in the same order, and ``batch``, what ``opened_seq`` and ``closed_seq`` name (else null).
    """

    def decode(table: pa.Table) -> pa.Table:
        trace, thread = table["trace_id"][0].as_py(), table["thread_id"][0].as_py()
        names = table.column_names
        own_base = (table["base"][0].as_py() or 0) if "base" in names else base
        own_frequency = table["frequency"][0].as_py() if "frequency" in names else frequency
        table = table.sort_by("local_seq")
        if not contexts and not own_base:
            found = plain_scopes(b"".join(d for d in table["data"].to_pylist() if d is not None), own_frequency)
            if found is not None:
                spec, is_metadata, start, end, duration = found
                n = len(spec)
                nulls = lambda kind: pa.nulls(n, kind)
                masked = lambda x: pa.array(x, mask=end < 0)
                columns = [pa.repeat(pa.scalar(trace, pa.string()), n), pa.repeat(pa.scalar(thread, pa.int32()), n), pa.array(np.arange(n)), pa.array(spec), pa.array(is_metadata), pa.array(start), masked(end), masked(duration), *map(nulls, _KINDS[8:])]
                return pa.table(columns, names=_NAMES)
        state, rows = CpuThread(own_base, own_frequency), []
        extra = [table[c].to_pylist() if c in names else [None] * len(table) for c in ("kind", "ident", "batch")]
        for data, kind, ident, batch in zip(table["data"].to_pylist(), *extra, strict=True):
            if data is None:
                state.stack_event(kind, ident)
                continue
            rows += [(trace, thread, len(rows) + i, x.spec, x.is_metadata, x.start, x.end, x.duration, x.opened, x.closed, x.restored, x.active) for i, x in enumerate(state.intervals(data, batch))]
        rows += [(trace, thread, len(rows) + i, s.spec, s.is_metadata, s.start, None, None, s.batch, None, None, None) for i, s in enumerate(state.stack)]
        columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
        return pa.table([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return batches.groupBy("trace_id", "thread_id").applyInArrow(decode, INTERVALS)


TOTALS = "trace_id string, thread_id int, spec_id long, count long, total_cycles decimal(38,0)"


def cpu_totals(batches: DataFrame, base: int = 0, frequency: int | None = None) -> DataFrame:
    """Closed scopes that are not metadata and their cycles, for each thread and spec of rows as ``cpu_intervals`` takes.

    Summed up where they are decoded, so that a thread sends a row for each spec and not for each scope.
    """

    def decode(table: pa.Table) -> pa.Table:
        trace, thread = table["trace_id"][0].as_py(), table["thread_id"][0].as_py()
        own_base = (table["base"][0].as_py() or 0) if "base" in table.column_names else base
        own_frequency = table["frequency"][0].as_py() if "frequency" in table.column_names else frequency
        data = b"".join(d for d in table.sort_by("local_seq")["data"].to_pylist() if d is not None)
        found = None if own_base else plain_scopes(data, own_frequency)
        if found is None:
            rows = list(CpuThread(own_base, own_frequency).decode(data))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            spec, is_metadata, _, end, duration = (np.array(c, np.int64) for c in columns)
            is_metadata = is_metadata.astype(bool)
        else:
            spec, is_metadata, _, end, duration = found
        kept = (end >= 0) & ~is_metadata
        specs, place = np.unique(spec[kept], return_inverse=True)
        counts, low, high = np.bincount(place, minlength=len(specs)), np.zeros(len(specs), np.int64), np.zeros(len(specs), np.int64)
        np.add.at(low, place, duration[kept] & 0xFFFFFFFF)  # in two halves, so that no sum runs over
        np.add.at(high, place, duration[kept] >> 32)
        sums = [Decimal(int(a) + (int(b) << 32)) for a, b in zip(low, high, strict=True)]
        n = len(specs)
        columns = [pa.repeat(pa.scalar(trace, pa.string()), n), pa.repeat(pa.scalar(thread, pa.int32()), n), pa.array(specs), pa.array(counts.astype(np.int64)), pa.array(sums, pa.decimal128(38, 0))]
        return pa.table(columns, names=[p.split()[0] for p in TOTALS.split(", ")])

    return batches.groupBy("trace_id", "thread_id").applyInArrow(decode, TOTALS)


def _data(events: DataFrame) -> Column:
    """A batch's bytes: by themselves, or as hexadecimal among its fields."""
    fields = F.unhex(F.get_json_object("fields", "$.Data"))
    return F.coalesce(F.col("blob"), fields) if "blob" in events.columns else fields


def batches_of(events: DataFrame) -> DataFrame:
    """``trace_id, thread_id, local_seq, data`` of the CPU batch events among decoded events."""
    rows = events.where((F.col("logger") == "CpuProfiler") & F.col("event").startswith("EventBatch"))
    return rows.select("trace_id", "thread_id", "local_seq", _data(events).alias("data"))


def batches_in_context(events: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """The same with metadata stack events and the dispatch place of each, for ``cpu_intervals`` with contexts.

    ``origin`` has ``trace_id, base, frequency`` where the capture tells them.
    """
    is_batch = (F.col("logger") == "CpuProfiler") & F.col("event").startswith("EventBatch")
    rows = events.where(is_batch | (F.col("logger") == "MetadataStack")).select(
        "trace_id", "thread_id", "local_seq", F.when(is_batch, _data(events)).alias("data"), F.when(~is_batch, F.col("event")).alias("kind"),
        F.get_json_object("fields", "$.Id").try_cast("long").alias("ident"), F.col("seq").alias("batch"),
    )
    return rows if origin is None else rows.join(origin, "trace_id", "left")

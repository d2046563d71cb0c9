"""Reports of results that are bounded by their families' caps: JSON, text and HTML, and how a process ends.

Everything here collects, so it takes families, summaries and first rows, never whole event tables.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators.timeline import InvalidQuery
from ..operators.views import EXIT_CODES
from ..sources.capture import TraceError

SCHEMA_VERSION = 2


def records(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def envelope(name: str, body: object, path: str, status: str = "ok") -> str:
    """``{schema_version, status, path, <name>}`` as JSON."""
    return json.dumps({"schema_version": SCHEMA_VERSION, "status": status, "path": path, name: body})


def as_json(families: dict[str, DataFrame], path: str, status: str = "ok") -> str:
    return envelope("dashboard", {name: records(df) for name, df in families.items()}, path, status)


def _lines(title: str, df: DataFrame) -> list[str]:
    rows = df.collect()
    return [f"{title} ({len(rows)})", *("  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows)]


def as_text(families: dict[str, DataFrame]) -> str:
    return "\n".join(line for name, df in families.items() for line in _lines(name, df))


def _table(rows: Sequence[Sequence[object]]) -> list[str]:
    """Columns of equal width, numbers to the right."""
    shown = [["" if v is None else str(v) for v in r] for r in rows]
    widths = [max(len(r[i]) for r in shown) for i in range(len(shown[0]))] if shown else []
    right = [all(isinstance(r[i], (int, float)) for r in rows[1:]) and len(rows) > 1 for i in range(len(widths))]
    return ["  ".join(v.rjust(w) if n else v.ljust(w) for v, w, n in zip(r, widths, right, strict=True)).rstrip() for r in shown]


def _framed(title: str, head: Sequence[str], df: DataFrame) -> str:
    return "\n".join([title, *_table([list(head), *([r[c] for c in head] for r in df.select(*head).collect())])])


def inspect_text(headers: DataFrame, totals: DataFrame) -> str:
    """Header of each capture and the packets and bytes of its threads."""
    first = _framed("captures", ["trace_id", "magic", "transport", "protocol"], headers)
    return f"{first}\n{_framed('threads', ['trace_id', 'thread_id', 'packet_count', 'raw_bytes', 'decoded_bytes', 'sync_count'], totals.orderBy('trace_id', 'thread_id'))}"


def inventory_text(found: DataFrame) -> str:
    return _framed("event types", ["trace_id", "logger", "event", "count"], found.orderBy("trace_id", found["count"].desc(), "logger", "event"))


def coverage_text(summary: DataFrame, found: DataFrame, missing: DataFrame) -> str:
    """Counts by decode status, then the types that are raw, then known types that a capture does not declare."""
    parts = [
        _framed("coverage", ["trace_id", "declared_types", "decoded_types", "partial_types", "raw_types", "observed_events", "raw_events"], summary),
        _framed("raw types", ["trace_id", "logger", "event", "observed"], found.where("status = 'raw'")),
        _framed("not observed", ["trace_id", "logger", "event"], missing.orderBy("trace_id", "logger", "event")),
    ]
    return "\n".join(parts)


def timeline_index_text(path: str, totals: DataFrame) -> str:
    """Where an index is and what it spans; ``totals`` has ``trace_id, intervals, first_cycle, last_cycle``."""
    return f"index {path}\n{_framed('intervals', ['trace_id', 'intervals', 'first_cycle', 'last_cycle'], totals)}"


def timeline_query_text(rows: DataFrame, summary: DataFrame) -> str:
    """The rows of a timeline query, and how many match and whether they are cut off."""
    s = summary.first()
    note = f"{s['returned']} of {s['matches']}" + (", cut off" if s["truncated"] else "")
    return _framed(f"scopes ({note})", ["trace_id", "thread_id", "name", "start_cycle", "end_cycle", "duration"], rows)


def as_html(families: dict[str, DataFrame], title: str) -> str:
    """A page that needs no other file; every value is escaped."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    parts = []
    for name, df in families.items():
        head = "".join(cell("th", c) for c in df.columns)
        body = "".join(f"<tr>{''.join(cell('td', v) for v in r)}</tr>" for r in df.collect())
        parts.append(f"<section>{cell('h2', name)}<table><tr>{head}</tr>{body}</table></section>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{cell('h1', title)}{''.join(parts)}"


def exit_code(error: BaseException | None) -> int:
    """The code that a process ends with: by the kind of a trace error, also where it comes out of an executor."""
    if error is None:
        return EXIT_CODES["ok"]
    if isinstance(error, TraceError):
        return EXIT_CODES[error.kind]
    if isinstance(error, (InvalidQuery, ValueError)):
        return EXIT_CODES["usage"]
    if isinstance(error, OSError):
        return EXIT_CODES["io"]
    said = str(error)
    for kind in ("MalformedData", "UnsupportedFormat", "ResourceLimit"):
        if f"{kind} at " in said or f"{kind}: " in said:
            return EXIT_CODES[kind]
    return EXIT_CODES["io"] if "PATH_NOT_FOUND" in said or "FileNotFound" in said else EXIT_CODES["internal"]


def fan_out(df: DataFrame, *sinks: Callable[[DataFrame], object]) -> list[object]:
    """Give every sink the same written table, so that what makes it runs once."""
    from ..storage import written

    table = written(df, "fan-out")
    return [sink(table) for sink in sinks]

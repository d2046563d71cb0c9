"""Command line: ``python -m spanlake inspect|inventory|coverage|dashboard|dashboard-progress|timeline-index|timeline-query PATH``.

A path of ``-`` reads one capture from standard input. Results go to standard output, or with ``--out`` to a file that
appears whole or not at all and is never overwritten.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from pathlib import Path

from .operators.views import EXIT_CODES
from .plans import reports
from .streaming import progressive


def parsed(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="spanlake", description=__doc__)
    p.add_argument("command", choices=["inspect", "inventory", "coverage", "dashboard", "dashboard-progress", "timeline-index", "timeline-query"])
    p.add_argument("path")
    p.add_argument("--format", choices=["json", "text", "html"], default="json")
    p.add_argument("--out", help="file of the result; it may not exist")
    p.add_argument("--index", help="folder of the timeline index")
    p.add_argument("--universe", help="text file of event names")
    for name in ("start", "end", "thread", "limit"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--text")
    return p.parse_args(args)


def write_whole(text: str, path: str) -> None:
    """Write a file under another name and give it its own at the end; fails if the name is taken."""
    target = Path(path)
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.link(temporary, target)
    finally:
        os.unlink(temporary)


def progress(path: str, out) -> int:
    """Messages of a session as lines, while the input is read; needs no Spark."""
    session = progressive.Session()
    with sys.stdin.buffer if path == "-" else open(path, "rb") as source:
        while session.phase != "failed" and (chunk := source.read(64 << 10)):
            out.write(progressive.ndjson(session.push(chunk)))
            out.flush()
    if session.phase != "failed":
        last = session.finish()
    else:
        return EXIT_CODES["MalformedData"]
    out.write(progressive.ndjson(last))
    return EXIT_CODES["ok"] if last[-1]["kind"] == "complete" else EXIT_CODES.get(last[-1].get("error_kind"), EXIT_CODES["internal"])


def result(args: argparse.Namespace, spark) -> str:
    from . import api
    from .sources import catalog

    if args.command == "timeline-query":
        rows, summary = api.query_timeline(spark, args.index or args.path, args.start, args.end, args.thread, args.text, args.limit)
        return reports.timeline_query_text(rows, summary) if args.format == "text" else reports.envelope("timeline", {"rows": reports.records(rows), **summary.first().asDict()}, args.path)
    found = api.Capture(spark, args.path)
    if args.command == "timeline-index":
        spans = found.build_timeline(args.index)
        return reports.timeline_index_text(args.index, spans) if args.format == "text" else reports.envelope("timeline_index", reports.records(spans), args.index)
    if args.command == "inspect":
        parts = found.inspect()
        return reports.inspect_text(parts["captures"], parts["threads"]) if args.format == "text" else reports.envelope("inspect", {k: reports.records(v) for k, v in parts.items()}, args.path)
    if args.command == "inventory":
        rows = found.inventory()
        return reports.inventory_text(rows) if args.format == "text" else reports.envelope("inventory", reports.records(rows), args.path)
    if args.command == "coverage":
        parts = found.coverage(catalog.universe(spark, args.universe) if args.universe else None)
        return reports.coverage_text(parts["summary"], parts["events"], parts["not_observed"]) if args.format == "text" else reports.envelope("coverage", {k: reports.records(v) for k, v in parts.items()}, args.path)
    families = found.dashboard()
    return {"json": lambda: reports.as_json(families, args.path), "text": lambda: reports.as_text(families), "html": lambda: reports.as_html(families, args.path)}[args.format]()


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = parsed(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return EXIT_CODES["ok"] if e.code == 0 else EXIT_CODES["usage"]
    try:
        if args.command == "dashboard-progress":
            return progress(args.path, sys.stdout)
        if args.path == "-":
            with tempfile.NamedTemporaryFile(suffix=".trace", delete=False) as f:
                f.write(sys.stdin.buffer.read())
            args.path = f.name
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("spanlake").getOrCreate()
        text = result(args, spark)
        if args.out:
            write_whole(text, args.out)
        else:
            print(text)
    except Exception as error:  # noqa: BLE001  every failure ends in a code
        print(error, file=sys.stderr)
        return reports.exit_code(error)
    return EXIT_CODES["ok"]


if __name__ == "__main__":
    sys.exit(main())

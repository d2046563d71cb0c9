"""What a user calls: captures at a path to inspections, inventories, coverage, dashboards and timelines."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import joins, timeline
from .plans import dashboard, reports
from .session import ship
from .sources import capture, catalog, cpu
from .storage import written
from .streaming.progressive import Session

TRACE = dashboard.TRACE


@dataclass
class Capture:
    """All captures at a path, each under its ``trace_id``; what is decoded once is kept as a written table."""

    spark: SparkSession
    path: str
    mode: str = "FAILFAST"

    def __post_init__(self) -> None:
        ship(self.spark)

    @cached_property
    def files(self) -> DataFrame:
        return capture.captures(self.spark, self.path)

    @cached_property
    def packets(self) -> DataFrame:
        return written(capture.packets(self.files, self.mode), "packets")

    @cached_property
    def types(self) -> DataFrame:
        return written(capture.event_types(self.packets), "event-types")

    @cached_property
    def raw(self) -> DataFrame:
        return written(capture.raw_events(self.packets, self.types, self.mode), "raw-events")

    @cached_property
    def events(self) -> DataFrame:
        return written(dashboard.dispatched(self.raw.where("logger is not null")), "trace-events")

    def inspect(self) -> dict[str, DataFrame]:
        return {"captures": capture.headers(self.files, self.mode), "threads": capture.packet_totals(self.packets), "types": self.types}

    def inventory(self) -> DataFrame:
        return capture.inventory(self.raw)

    def dispatch(self) -> DataFrame:
        """How the capture's events were put in order, and the serials that are missing."""
        rows = self.raw.where("logger is not null")
        syncs = capture.packet_totals(self.packets).groupBy(*TRACE).agg(F.sum("sync_count").alias("sync_count"))
        return joins.dispatch_summary(rows, TRACE, "serial", joins.serial_origins(rows, TRACE, "serial"), syncs)

    def coverage(self, universe: DataFrame | None = None) -> dict[str, DataFrame]:
        found = dashboard.coverage_events(self.raw, self.types)
        out = {"summary": dashboard.coverage_summary(found), "events": found, "not_observed": dashboard.decoders_not_observed(self.spark, self.types)}
        return out if universe is None else {**out, "universe": dashboard.coverage(self.raw, universe)}

    def dashboard(self) -> dict[str, DataFrame]:
        return dashboard.dashboard(self.events)

    def scope_totals(self) -> DataFrame:
        """CPU scopes by their names. Of the events only those without batches need a dispatch order, which are few."""
        events = dashboard.dispatched(dashboard.timeline_only(self.raw).where("blob is null").drop("blob"))
        return dashboard.spec_totals(events, cpu.batches_of(self.raw))

    @cached_property
    def intervals(self) -> DataFrame:
        """CPU scopes with their names."""
        scopes = dashboard.cpu_intervals(self.events, contexts=False)
        specs = dashboard.cpu_specs(self.events).select(*TRACE, "spec_id", "name")
        named = scopes.join(specs.withColumn("is_metadata", F.lit(False)), [*TRACE, "spec_id", "is_metadata"], "left")
        return named.withColumn("name", F.coalesce("name", F.concat(F.lit("#"), "spec_id")))

    def build_timeline(self, path: str) -> DataFrame:
        """Write an index of the closed CPU scopes; fails if there is one. What it spans, for each capture."""
        catalog.write_timeline(self.intervals.where("end_cycle is not null"), path)
        return catalog.spans(catalog.read_timeline(self.spark, path))

    def build_gpu_timeline(self, path: str) -> DataFrame:
        """The same for the GPU's work and breadcrumbs, by frame."""
        work = dashboard.gpu_work(self.events).where("not unterminated and not negative").select(*TRACE, "queue", "frame", F.lit("Work").alias("name"), F.col("start").alias("start_cycle"), F.col("end").alias("end_cycle"), "duration")
        crumbs = dashboard.gpu_breadcrumb_intervals(self.events).select(*TRACE, "queue", "frame", F.coalesce("rendered", "name").alias("name"), F.col("start").alias("start_cycle"), F.col("end").alias("end_cycle"), "duration")
        catalog.write_timeline(work.unionByName(crumbs).where("frame is not null"), path)
        return catalog.spans(catalog.read_timeline(self.spark, path))

    def memory_timeline(self) -> DataFrame:
        """The closed CPU scopes, kept by the session's executors until they are unpersisted."""
        return self.intervals.where("end_cycle is not null").cache()

    def bundle(self) -> str:
        """Dashboard, inventory and coverage in one JSON text."""
        body = {"dashboard": {k: reports.records(v) for k, v in self.dashboard().items()}, "inventory": reports.records(self.inventory()), "coverage": reports.records(self.coverage()["summary"])}
        return json.dumps({"schema_version": reports.SCHEMA_VERSION, "status": "ok", "path": self.path, **body})


def query_timeline(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, thread: int | None = None, text: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The scopes of an index that meet a window, and how many there are."""
    return timeline.index_query(catalog.read_timeline(spark, path), "start_cycle", "end_cycle", ["trace_id", "thread_id", "spec_id"], start, end, None if thread is None else ("thread_id", thread), text, ["name"], limit)


def visited(events: DataFrame, visit: Callable, schema: str) -> DataFrame:
    """Rows of ``schema`` from a function of each capture's events in dispatch order, given and returned as Arrow tables."""
    return events.groupBy(*TRACE).applyInArrow(lambda table: visit(table.sort_by("seq")), schema)


def create_progressive(max_frames: int = 120) -> Session:
    return Session(max_frames)

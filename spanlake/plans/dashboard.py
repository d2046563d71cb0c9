"""The dashboard: one DataFrame for each family of results over the decoded events of captures.

A family that shows its first rows alone also tells how many there are, as ``total``, and whether it is ``truncated``.

``events`` are rows of ``sources.capture.raw_events`` with a dispatch order ``seq``. Every provider filters its own
event types and binds operators to their fields, so a provider reads only what it needs; families are lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import decoders
from ..operators import joins, pairing, summaries, timeline
from ..sources import cpu

# How many rows each family shows.
CAPS = {
    "frames": 120, "timeline": 500, "counter_points": 40, "hot_stats": 64, "csv_samples": 40, "files": 64, "file_samples": 40, "log_categories": 50, "log_messages": 50, "memory_tags": 4096, "packages": 80, "io_samples": 40, "breadcrumbs": 40,
    "frame_breadcrumbs": 8, "frame_scopes": 5, "named_tasks": 64, "wait_samples": 40, "unmodeled": 80, "bookmark_callstacks": 8, "callstacks": 4096, "latency_pairs": 64, "serial_gaps": 64, "metadata_names": 40, "metadata_specs": 40, "metadata_strings": 40, "spec_strings": 8,
}
# Names of the trace model, the handle of a failed open, and the most values of one event.
LOGGERS = "$Trace CpuProfiler Misc Counters Stats CsvProfiler TaskTrace LoadTime IoStore PlatformFile Memory LLM MetadataStack SlateTrace Trace GpuProfiler Logging Diagnostics".split()
GPU_EVENTS = "EventFrameBoundary EventBeginBreadcrumb EventEndBreadcrumb EventBeginWork EventEndWork EventWait EventStats SignalFence WaitFence".split()
INVALID_HANDLE = str((1 << 64) - 1)
LLM_VALUES = 4096
FULLY = ["$Trace.NewTrace", "$Trace.ThreadInfo", "CpuProfiler.EventSpec", "Misc.BeginFrame", "Misc.EndFrame"]
MODELED = {
    "$Trace": "NewTrace ThreadInfo ThreadGroupBegin ThreadGroupEnd ThreadTiming",
    "CpuProfiler": "EventSpec MetadataSpec Metadata EventBatchV3 EndThread",
    "Misc": "BeginFrame EndFrame BookmarkSpec Bookmark RegionBegin RegionBeginWithId RegionEnd RegionEndWithId",
    "Counters": "Spec SetValueInt SetValueFloat",
    "Stats": "Spec EventBatch2",
    "CsvProfiler": "RegisterCategory DefineDeclaredStat DefineInlineStat BeginStat EndStat CustomStatInt CustomStatFloat",
    "TaskTrace": "Init Created Launched Scheduled SubsequentAdded Started Finished Completed Destroyed WaitingStarted WaitingFinished",
    "LoadTime": "ClassInfo PackageSummary BeginRequest EndRequest StartAsyncLoading SuspendAsyncLoading ResumeAsyncLoading",
    "IoStore": "BackendName RequestCreate RequestStarted RequestCompleted RequestFailed RequestUnresolved",
    "PlatformFile": "BeginOpen EndOpen BeginReOpen EndReOpen BeginClose EndClose BeginRead EndRead BeginWrite EndWrite",
    "Memory": "Init TagSpec MemoryScope Alloc AllocSystem AllocVideo Free FreeSystem FreeVideo ReallocAlloc ReallocAllocSystem ReallocAllocVideo ReallocFree ReallocFreeSystem ReallocFreeVideo CallstackSpec",
    "LLM": "TagsSpec TrackerSpec TagSetSpec TagValue",
    "MetadataStack": "ClearScope SaveStack RestoreStack",
    "SlateTrace": "AddWidget",
    "Trace": "ChannelAnnounce ChannelToggle",
    "GpuProfiler": "Init QueueSpec EventFrameBoundary EventBreadcrumbSpec EventBeginBreadcrumb EventEndBreadcrumb EventBeginWork EventEndWork EventWait EventStats SignalFence WaitFence",
    "Logging": "LogCategory LogMessageSpec LogMessage",
    "Diagnostics": "ModuleInit ModuleLoad ModuleUnload",
}
TRACE = ["trace_id"]


def text(name: str) -> Column:
    return F.get_json_object("fields", f"$.{name}")


def number(name: str) -> Column:
    return text(name).try_cast("long")


def dispatched(events: DataFrame) -> DataFrame:
    """Add ``seq``: the serial order over the threads of each capture; important threads come first."""
    rows = joins.single_epoch(events.where("uid is not null"), TRACE, "serial")
    return joins.serial_order(rows, "thread_id", "local_seq", "serial", joins.serial_origins(rows, TRACE, "serial"), by=TRACE)


def gap_samples(events: DataFrame) -> DataFrame:
    """The first gaps in each capture's serials, in their order, with how many there are."""
    rows = events.where("uid is not null")
    origins = joins.serial_origins(rows, TRACE, "serial")
    gaps = joins.serial_gaps(rows, "serial", origins, TRACE).join(origins, TRACE)
    distance = fn.serial_distance(F.col("after_serial"), F.col("origin"))
    return summaries.capped(gaps, TRACE, CAPS["serial_gaps"], distance).drop("origin")


def timeline_only(events: DataFrame) -> DataFrame:
    """The events that CPU scopes and their names need; other providers' are not read."""
    wanted = (F.col("logger") == "CpuProfiler") & (F.col("event").startswith("EventBatch") | F.col("event").isin("EventSpec", "MetadataSpec", "Metadata"))
    return events.where(wanted | (F.col("logger") == "MetadataStack") | (F.concat_ws(".", "logger", "event") == "$Trace.NewTrace"))


def of(events: DataFrame, logger: str, *names: str) -> DataFrame:
    return events.where((F.col("logger") == logger) & F.col("event").isin(*names))


def is_event(*names: str) -> Column:
    return F.col("event").isin(*names)


def last_by(rows: DataFrame, key: Sequence[str], **values: Column) -> DataFrame:
    """A catalog whose last row for each key wins."""
    return rows.groupBy(*TRACE, *key).agg(F.max_by(F.struct(*(v.alias(k) for k, v in values.items())), "seq").alias("_r")).select(*TRACE, *key, "_r.*")


def counters(e: DataFrame) -> DataFrame:
    specs = last_by(of(e, "Counters", "Spec").withColumn("id", number("Id")), ["id"], name=text("Name"), kind=fn.label(number("Type"), fn.COUNTER_KIND))
    samples = of(e, "Counters", "SetValueInt", "SetValueFloat").select(*TRACE, "seq", number("CounterId").alias("id"), number("Cycle").alias("cycle"), text("Value").cast("double").alias("value"), is_event("SetValueInt").alias("is_int"))
    totals = samples.groupBy(*TRACE, "id").agg(F.count("*").alias("samples"), F.count_if("is_int").alias("int_samples"), F.min_by("cycle", "seq").alias("first_cycle"), F.max_by("cycle", "seq").alias("last_cycle"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max_by("value", "seq").alias("latest_value"))
    return specs.join(totals, [*TRACE, "id"], "left").fillna(0, ["samples", "int_samples"]).orderBy(*TRACE, F.desc("samples"), "name", "id")


def stat_specs(e: DataFrame) -> DataFrame:
    flag = lambda name: F.coalesce(number(name), F.lit(0)) != 0
    return last_by(of(e, "Stats", "Spec").withColumn("id", number("Id")), ["id"], name=text("Name"), stat_group=text("Group"), is_float=flag("IsFloatingPoint"), is_memory=flag("IsMemory"), clears=flag("ShouldClearEveryFrame"))


def stat_groups(e: DataFrame) -> DataFrame:
    return stat_specs(e).groupBy(*TRACE, "stat_group").agg(F.count("*").alias("specs"), F.count_if("is_float").alias("float_specs"), F.count_if("is_memory").alias("memory_specs"), F.count_if("clears").alias("clearing_specs")).orderBy(*TRACE, F.desc("specs"), "stat_group")


def stats(e: DataFrame) -> DataFrame:
    """Hot stats: values after every operation of the packed batches."""
    batches = of(e, "Stats", "EventBatch2").select(*TRACE, "seq", F.unhex(text("Data")).alias("data"))

    def unpack(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(t, s, i, *op) for t, s, d in pdf.itertuples(index=False) for i, op in enumerate(decoders.stat_batch(d))]
            yield pd.DataFrame(rows, columns=["trace_id", "batch", "n", "id", "cycle", "op", "amount"])

    ops = batches.mapInPandas(unpack, "trace_id string, batch long, n long, id long, cycle long, op string, amount double").withColumn("seq", F.struct("batch", "n"))
    values = summaries.running_value(ops, [*TRACE, "id"], "seq", F.col("op"), F.col("amount"))
    totals = values.groupBy(*TRACE, "id").agg(F.count("*").alias("samples"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max_by("value", "seq").alias("latest_value"))
    named = totals.join(stat_specs(e).select(*TRACE, "id", "name", "stat_group"), [*TRACE, "id"], "left")
    return summaries.capped(named, TRACE, CAPS["hot_stats"], F.desc("samples"), F.col("id"))


def csv_stats(e: DataFrame) -> DataFrame:
    """Stat definitions with their category, null where that is unknown."""
    names = last_by(of(e, "CsvProfiler", "DefineDeclaredStat", "DefineInlineStat").withColumn("stat", text("StatId")), ["stat"], name=text("Name"), category_index=number("CategoryIndex"), declared=is_event("DefineDeclaredStat"))
    categories = last_by(of(e, "CsvProfiler", "RegisterCategory").withColumn("category_index", number("Index")), ["category_index"], category=text("Name"))
    return names.join(categories, [*TRACE, "category_index"], "left")


def csv_categories(e: DataFrame) -> DataFrame:
    categories = last_by(of(e, "CsvProfiler", "RegisterCategory").withColumn("category_index", number("Index")), ["category_index"], category=text("Name"))
    counts = csv_stats(e).groupBy(*TRACE, "category_index").agg(F.count("*").alias("stats"), F.count_if("declared").alias("declared_stats"), F.count_if(~F.col("declared")).alias("inline_stats"))
    return categories.join(counts, [*TRACE, "category_index"], "left").fillna(0, ["stats", "declared_stats", "inline_stats"]).orderBy(*TRACE, F.desc("stats"), "category", "category_index")


def csv(e: DataFrame) -> DataFrame:
    """Begin and end events and custom values of each stat; ``unresolved`` counts begins and values without a definition."""
    spans = of(e, "CsvProfiler", "BeginStat", "EndStat").select(*TRACE, "thread_id", "seq", "event", text("StatId").alias("stat"), number("Cycle").alias("cycle"))
    paired = pairing.pair_lifo(spans, [*TRACE, "thread_id", "stat"], "seq", is_event("BeginStat"), is_event("EndStat"), "cycle")
    begin = F.col("kind") == "begin"
    totals = paired.groupBy(*TRACE, "stat").agg(F.count_if(begin).alias("begins"), F.count_if(~begin).alias("ends"), F.count_if(~begin & ~F.col("matched")).alias("unmatched_ends"), F.count_if(begin & ~F.col("matched")).alias("open_begins"), F.sum("duration").alias("total_duration"))
    custom = of(e, "CsvProfiler", "CustomStatInt", "CustomStatFloat").groupBy(*TRACE, text("StatId").alias("stat")).agg(F.count_if(is_event("CustomStatInt")).alias("int_values"), F.count_if(is_event("CustomStatFloat")).alias("float_values"))
    both = totals.join(custom, [*TRACE, "stat"], "full_outer").fillna(0, ["begins", "ends", "unmatched_ends", "open_begins", "int_values", "float_values"])
    named = both.join(csv_stats(e).select(*TRACE, "stat", "name", "declared"), [*TRACE, "stat"], "left")
    return named.withColumn("unresolved", F.when(F.col("name").isNull(), F.col("begins") + F.col("int_values") + F.col("float_values")).otherwise(0))


def frames(e: DataFrame) -> DataFrame:
    marks = of(e, "Misc", "BeginFrame", "EndFrame").select(*TRACE, "seq", "event", number("FrameType").alias("frame_type"), number("Cycle").alias("cycle"))
    found = pairing.last_end_wins(marks, [*TRACE, "frame_type"], "seq", is_event("BeginFrame"), is_event("EndFrame"), "cycle").withColumn("frame_kind", fn.label(F.col("frame_type"), fn.FRAME_TYPE, "unknown"))
    return summaries.capped(found, [*TRACE, "frame_type"], CAPS["frames"], F.col("frame_number"))


def _region_pairs(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    of_kind = lambda *names: of(e, "Misc", *names)
    category = F.when(text("Category") != "", text("Category")).alias("category")
    named = of_kind("RegionBegin", "RegionEnd").select(*TRACE, "seq", "event", F.coalesce(text("RegionName"), F.lit("")).alias("name"), category, number("Cycle").alias("cycle"))
    by_name = pairing.pair_lifo(named, [*TRACE, "name"], "seq", is_event("RegionBegin"), is_event("RegionEnd"), "cycle")
    keyed = of_kind("RegionBeginWithId", "RegionEndWithId").select(*TRACE, "seq", "event", F.coalesce(text("CycleAndId"), text("RegionId")).alias("id"), F.coalesce(text("RegionName"), F.lit("")).alias("name"), category, F.coalesce(number("CycleAndId"), number("Cycle")).alias("cycle"))
    return by_name, pairing.pair_overwrite(keyed, [*TRACE, "id"], "seq", is_event("RegionBeginWithId"), is_event("RegionEndWithId"), "cycle")


def regions(e: DataFrame) -> DataFrame:
    by_name, by_id = _region_pairs(e)
    columns = [*TRACE, "name", "category", "duration"]
    both = by_name.where("matched and kind = 'begin'").select(*columns).unionByName(by_id.where("outcome = 'matched' and kind = 'begin'").select(*columns))
    return both.groupBy(*TRACE, "name", "category").agg(F.count("*").alias("count"), F.sum("duration").alias("total_cycles")).orderBy(*TRACE, F.desc("total_cycles"), F.desc("count"), "name", "category")


def region_totals(e: DataFrame) -> DataFrame:
    by_name, by_id = _region_pairs(e)
    begin = F.col("kind") == "begin"
    fits = by_name.select(*TRACE, "kind", F.col("matched").alias("done"), (begin & ~F.col("matched")).alias("open"), F.lit(False).alias("with_id"))
    fits = fits.unionByName(by_id.select(*TRACE, "kind", (F.col("outcome") == "matched").alias("done"), (begin & (F.col("outcome") == "open")).alias("open"), F.lit(True).alias("with_id")))
    return fits.groupBy(*TRACE).agg(F.count_if(begin).alias("begins"), F.count_if(~begin).alias("ends"), F.count_if(begin & F.col("done")).alias("completed"), F.count_if(~begin & ~F.col("done")).alias("unmatched_ends"), F.count_if("open").alias("unterminated"), F.count_if(begin & F.col("with_id")).alias("begins_with_id"), F.count_if(~begin & F.col("with_id")).alias("ends_with_id"))


def bookmarks(e: DataFrame) -> DataFrame:
    """Points with their events; those of unknown points are not resolved. ``callstacks`` are the first ones that are not 0."""
    specs = last_by(of(e, "Misc", "BookmarkSpec").withColumn("point", text("BookmarkPoint")), ["point"], format=text("FormatString"), file=text("FileName"), line=number("Line"))
    stack = F.when(number("CallstackId") != 0, F.struct("seq", number("CallstackId").alias("id")))
    hits = of(e, "Misc", "Bookmark").withColumns({"point": text("BookmarkPoint"), "cycle": number("Cycle"), "stack": stack})
    ranked = hits.withColumn("n", F.count("stack").over(Window.partitionBy(*TRACE, "point").orderBy("seq")))
    kept = F.when(F.col("n") <= CAPS["bookmark_callstacks"], F.col("stack"))
    totals = ranked.groupBy(*TRACE, "point").agg(F.count("*").alias("count"), F.min_by("cycle", "seq").alias("first_cycle"), F.max_by("cycle", "seq").alias("last_cycle"), F.count("stack").alias("callstack_count"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["id"]).alias("callstacks"))
    return specs.join(totals, [*TRACE, "point"], "full_outer").withColumns({"resolved": F.col("format").isNotNull(), "count": F.coalesce("count", F.lit(0)), "callstack_count": F.coalesce("callstack_count", F.lit(0))})


def _log_points(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    categories = last_by(of(e, "Logging", "LogCategory").withColumn("category_id", text("CategoryPointer")), ["category_id"], category=text("Name"), default_verbosity=fn.log_verbosity(F.coalesce(number("DefaultVerbosity"), F.lit(0))))
    specs = last_by(of(e, "Logging", "LogMessageSpec").withColumn("point", text("LogPoint")), ["point"], category_id=text("CategoryPointer"), verbosity=fn.log_verbosity(number("Verbosity")), format=text("FormatString"), file=text("FileName"), line=number("Line"))
    args = F.unhex(text("FormatArgs"))
    hits = of(e, "Logging", "LogMessage").groupBy(*TRACE, text("LogPoint").alias("point")).agg(F.count("*").alias("count"), F.sum(F.coalesce(F.octet_length(args), F.lit(0))).alias("args_bytes"), F.min_by(args, F.when(args.isNotNull(), F.col("seq"))).alias("args"), F.min_by(number("Cycle"), "seq").alias("first_cycle"), F.max_by(number("Cycle"), "seq").alias("last_cycle"))
    return categories, specs, hits


def logs(e: DataFrame) -> DataFrame:
    """Declared message points with their category, verbosity, count and the first message as text; the most frequent."""
    categories, specs, hits = _log_points(e)
    rows = specs.join(hits, [*TRACE, "point"], "left").fillna(0, ["count", "args_bytes"]).join(categories.select(*TRACE, "category_id", "category"), [*TRACE, "category_id"], "left")
    rows = rows.withColumn("sample", F.when(F.col("args").isNotNull(), decoders.render_message("format", "args"))).drop("args")
    return summaries.capped(rows, TRACE, CAPS["log_messages"], F.desc("count"), F.col("format"), F.col("point"))


def _log_counts(e: DataFrame) -> DataFrame:
    _, specs, hits = _log_points(e)
    return specs.join(hits.select(*TRACE, "point", "count"), [*TRACE, "point"], "left").fillna(0, ["count"])


def log_verbosities(e: DataFrame) -> DataFrame:
    return _log_counts(e).groupBy(*TRACE, "verbosity").agg(F.count("*").alias("message_specs"), F.sum("count").alias("messages"))


def log_categories(e: DataFrame) -> DataFrame:
    counts = _log_counts(e).groupBy(*TRACE, "category_id").agg(F.count("*").alias("message_specs"), F.sum("count").alias("messages"))
    rows = _log_points(e)[0].join(counts, [*TRACE, "category_id"], "left").fillna(0, ["message_specs", "messages"])
    return summaries.capped(rows, TRACE, CAPS["log_categories"], F.desc("messages"), F.desc("message_specs"), F.col("category"))


def log_totals(e: DataFrame) -> DataFrame:
    categories, specs, hits = _log_points(e)
    seen = joins.flagged(hits.withColumn("key", F.struct(*TRACE, "point")), specs.withColumn("key", F.struct(*TRACE, "point")), "key", "key", "known").drop("key")
    known = specs.join(categories.select(*TRACE, "category_id", F.lit(1).alias("has")), [*TRACE, "category_id"], "left")
    of_specs = known.groupBy(*TRACE).agg(F.count("*").alias("message_specs"), F.count_if(F.col("has").isNull()).alias("specs_without_category"))
    of_hits = seen.groupBy(*TRACE).agg(F.sum("count").alias("messages"), F.sum("args_bytes").alias("args_bytes"), F.sum(F.when(~F.col("known"), F.col("count")).otherwise(0)).alias("unresolved_messages"))
    return of_specs.join(of_hits, TRACE, "full_outer")


def tasks(e: DataFrame) -> DataFrame:
    kinds = {"Created": "created", "Launched": "launched", "Scheduled": "scheduled", "SubsequentAdded": "subsequent_added", "Started": "started", "Finished": "finished", "Completed": "completed", "Destroyed": "destroyed"}
    rows = e.where(F.col("logger") == "TaskTrace")
    return rows.groupBy(*TRACE).agg(F.max_by(number("Version"), F.when(is_event("Init"), F.col("seq"))).alias("version"), *(F.count_if(F.col("event") == k).alias(name) for k, name in kinds.items()))


def task_names(e: DataFrame) -> DataFrame:
    """The first non-empty name of each task, for the tasks that were launched with one first."""
    named = of(e, "TaskTrace", "Launched").select(*TRACE, "seq", text("TaskId").alias("task"), text("DebugName").alias("name")).where("name <> ''")
    first = named.groupBy(*TRACE, "task").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
    return summaries.capped(first, TRACE, CAPS["named_tasks"], F.col("seq")).select(*TRACE, "task", "name")


def _waits(e: DataFrame) -> DataFrame:
    rows = of(e, "TaskTrace", "WaitingStarted", "WaitingFinished").select(*TRACE, "thread_id", "seq", "event", number("Timestamp").alias("cycle"), (F.length(F.coalesce(text("Tasks"), F.lit(""))) / 16).cast("long").alias("task_count"))
    return pairing.pair_lifo(rows, [*TRACE, "thread_id"], "seq", is_event("WaitingStarted"), is_event("WaitingFinished"), "cycle")


def task_waits(e: DataFrame) -> DataFrame:
    """Finished waits in the order of their ends, the first of each capture, with how many there are."""
    closed = _waits(e).where("kind = 'begin' and matched").select(*TRACE, "thread_id", "cycle", "end_cycle", "duration", "task_count", "end_seq")
    return summaries.capped(closed, TRACE, CAPS["wait_samples"], F.col("end_seq")).drop("end_seq")


def task_wait_totals(e: DataFrame) -> DataFrame:
    begin = F.col("kind") == "begin"
    totals = _waits(e).groupBy(*TRACE).agg(F.count_if(begin).alias("wait_started"), F.count_if(~begin).alias("wait_finished"), F.count_if(~begin & ~F.col("matched")).alias("unmatched_wait_ends"), F.count_if(begin & ~F.col("matched")).alias("open_waits"), F.count_if(begin & F.col("matched")).alias("_done"))
    return totals.withColumn("wait_count", F.least("_done", F.lit(CAPS["wait_samples"]))).drop("_done")


def load_requests(e: DataFrame) -> DataFrame:
    rows = of(e, "LoadTime", "BeginRequest", "EndRequest").select(*TRACE, "seq", "event", text("RequestId").alias("request"), number("Cycle").alias("cycle"))
    return pairing.pair_overwrite(rows, [*TRACE, "request"], "seq", is_event("BeginRequest"), is_event("EndRequest"), "cycle")


def load_totals(e: DataFrame) -> DataFrame:
    """Requests and asynchronous loading of each capture."""
    begin, matched = F.col("kind") == "begin", F.col("outcome") == "matched"
    requests = load_requests(e).groupBy(*TRACE).agg(F.count_if(begin).alias("begun"), F.count_if(~begin).alias("ended"), F.count_if(begin & matched).alias("completed"), F.count_if(~begin & ~matched).alias("unmatched_ends"), F.count_if(begin & (F.col("outcome") == "open")).alias("open_requests"), F.coalesce(F.sum("duration"), F.lit(0)).alias("total_cycles"))
    steps = of(e, "LoadTime", "StartAsyncLoading", "SuspendAsyncLoading", "ResumeAsyncLoading").withColumn("cycle", number("Cycle"))
    loading = steps.groupBy(*TRACE).agg(*(F.count_if(is_event(f"{k}AsyncLoading")).alias(f"{k.lower()}s") for k in ("Start", "Suspend", "Resume")), F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"))
    return requests.join(loading, TRACE, "full_outer")


def load_classes(e: DataFrame) -> DataFrame:
    return last_by(of(e, "LoadTime", "ClassInfo").withColumn("class", text("Class")), ["class"], name=text("Name")).orderBy(*TRACE, "name", "class")


def load_packages(e: DataFrame) -> DataFrame:
    rows = last_by(of(e, "LoadTime", "PackageSummary").withColumn("package", text("AsyncPackage")), ["package"], name=text("Name"), header_bytes=number("TotalHeaderSize"), imports=number("ImportCount"), exports=number("ExportCount"), priority=number("Priority"))
    return summaries.capped(rows, TRACE, CAPS["packages"], F.col("name"), F.col("package"))


def io_requests(e: DataFrame) -> DataFrame:
    """One row for each request handle, by its latest creation; what precedes any creation changes no request."""
    rows = e.where(F.col("logger") == "IoStore").select(*TRACE, "seq", "event", text("RequestHandle").alias("request"), number("Cycle").alias("cycle"), number("Size").alias("size"), text("BackendHandle").alias("backend")).where("request is not null")
    rows = rows.withColumn("n", F.sum(is_event("RequestCreate").cast("int")).over(Window.partitionBy(*TRACE, "request").orderBy("seq")))
    newest = rows.withColumn("last", F.max("n").over(Window.partitionBy(*TRACE, "request"))).where("n > 0 and n = last")
    at = lambda name, value: F.max_by(F.when(is_event(name), value), F.when(is_event(name), F.col("seq")))
    status = F.regexp_replace(F.lower("event"), "^request", "")
    out = newest.groupBy(*TRACE, "request").agg(at("RequestCreate", F.col("cycle")).alias("create_cycle"), at("RequestCreate", F.col("size")).alias("size"), at("RequestStarted", F.col("cycle")).alias("start_cycle"), at("RequestStarted", F.col("backend")).alias("backend"), at("RequestCompleted", F.col("cycle")).alias("complete_cycle"), at("RequestCompleted", F.col("size")).alias("completed_size"), F.max_by(status, "seq").alias("status"))
    return out.withColumn("status", F.when(F.col("status") == "create", "created").otherwise(F.col("status")))


def io_backends(e: DataFrame) -> DataFrame:
    """Backends by their starts, those of unknown requests too; a backend that was never named has no name."""
    names = last_by(of(e, "IoStore", "BackendName").withColumn("backend", text("BackendHandle")), ["backend"], name=text("Name"))
    starts = of(e, "IoStore", "RequestStarted").groupBy(*TRACE, text("BackendHandle").alias("backend")).agg(F.count("*").alias("starts"))
    return names.join(starts, [*TRACE, "backend"], "full_outer").fillna(0, ["starts"]).orderBy(*TRACE, F.desc("starts"), "name", "backend")


def io_totals(e: DataFrame) -> DataFrame:
    kinds = ("Created", "Started", "Completed", "Failed", "Unresolved")
    rows = e.where(F.col("logger") == "IoStore").withColumn("event", F.when(is_event("RequestCreate"), "RequestCreated").otherwise(F.col("event")))
    bytes_of = lambda k: F.coalesce(F.sum(F.when(is_event(f"Request{k}"), number("Size"))), F.lit(0))
    return rows.groupBy(*TRACE).agg(*(F.count_if(is_event(f"Request{k}")).alias(k.lower()) for k in kinds), bytes_of("Created").alias("bytes_requested"), bytes_of("Completed").alias("bytes_completed"))


def _file_events(e: DataFrame) -> DataFrame:
    """Events of files with the ``path`` that they count for, the empty one for unknown handles.

    Opens and reopens bind their path to the handle that their end names, unless it is invalid; a close unbinds it.
    An end belongs to its thread's latest begin that no end has taken.
    """
    rows = e.where(F.col("logger") == "PlatformFile").select(
        *TRACE, "thread_id", "seq", "event", text("Path").alias("path"), number("Cycle").alias("cycle"), number("Size").alias("requested"), F.coalesce(number("SizeRead"), number("SizeWritten")).alias("actual"),
        F.coalesce(text("FileHandle"), text("NewFileHandle"), text("OldFileHandle")).alias("handle"), F.coalesce(text("ReadHandle"), text("WriteHandle")).alias("op"),
    )
    base = F.regexp_replace("event", "^(Begin|End)", "")
    rows = rows.withColumns({"what": base, "begins": F.col("event").startswith("Begin")})
    per_thread = Window.partitionBy(*TRACE, "thread_id", "what").orderBy("seq")
    by_thread = rows.where("what in ('Open', 'ReOpen', 'Close')").withColumns({"paired": F.col("begins") | (F.lag("begins").over(per_thread) == F.lit(True)), "opener": F.lag(F.struct("path", "handle", "seq")).over(per_thread)})
    per_op = Window.partitionBy(*TRACE, "what", "op").orderBy("seq")
    by_op = rows.where("what in ('Read', 'Write')").withColumns({"paired": F.col("begins") | (F.lag("begins").over(per_op) == F.lit(True)), "opener": F.lag(F.struct("path", "handle", "seq")).over(per_op)})
    all_ = by_thread.unionByName(by_op).withColumn("paired", F.coalesce("paired", F.lit(False)))
    return all_


def files(e: DataFrame) -> DataFrame:
    """Opens, reopens, closes, reads and writes of each path, the busiest; bytes are asked for at begins and moved at ends.

    Reopened handles keep the path of the handle that they come from; paths are followed through any number of reopens
    by taking each handle's binding as of the operation, one reopen after the other.
    """
    return summaries.capped(_file_totals(e), TRACE, CAPS["files"], F.desc(F.col("opens") + F.col("reads") + F.col("writes")), F.desc("bytes_read"), F.col("path"))


def _file_totals(e: DataFrame) -> DataFrame:
    rows = _file_events(e)
    # State of a capture's handles, in order: what binds a handle to what, resolved below.
    state = rows.where("(event in ('EndOpen', 'EndReOpen') and paired) or begins")

    def follow(frames):
        import pandas as pd

        for pdf in frames:
            bound: dict = {}
            waiting: dict = {}
            out = []
            for r in pdf.sort_values("seq").itertuples(index=False):
                path = ""
                if r.event == "BeginOpen":
                    path = r.path or ""
                    waiting["Open", r.thread_id] = path
                elif r.event == "BeginReOpen":
                    path = bound.get(r.handle, "")
                    waiting["ReOpen", r.thread_id] = path
                elif r.event in ("EndOpen", "EndReOpen"):
                    path = waiting.get((r.what, r.thread_id), "")
                    if r.handle != INVALID_HANDLE:
                        bound[r.handle] = path
                elif r.event == "BeginClose":
                    path = bound.pop(r.handle, "")
                else:
                    path = bound.get(r.handle, "")
                out.append((r.trace_id, r.seq, path))
            yield pd.DataFrame(out, columns=["trace_id", "seq", "file"])

    paths = state.select(*TRACE, "thread_id", "seq", "event", "what", "path", "handle").groupBy(*TRACE).applyInPandas(lambda pdf: next(follow([pdf])), "trace_id string, seq long, file string")
    begun = paths.select(*TRACE, F.col("seq").alias("opener_seq"), F.col("file").alias("opened_file"))
    known = rows.join(paths, [*TRACE, "seq"], "left").withColumn("opener_seq", F.col("opener.seq")).join(begun, [*TRACE, "opener_seq"], "left")
    known = known.where("begins or paired").withColumn("path", F.when(F.col("begins"), F.col("file")).otherwise(F.coalesce("file", "opened_file")))
    invalid = F.col("handle") == INVALID_HANDLE
    bytes_of = lambda event, c: F.coalesce(F.sum(F.when(is_event(event), F.col(c))), F.lit(0))
    return known.groupBy(*TRACE, "path").agg(
        F.count_if(is_event("EndOpen")).alias("opens"), F.count_if(is_event("EndOpen", "EndReOpen") & invalid).alias("open_failures"), F.count_if(is_event("EndReOpen")).alias("reopens"), F.count_if(is_event("EndClose")).alias("closes"), F.count_if(is_event("BeginRead")).alias("reads"), F.count_if(is_event("BeginWrite")).alias("writes"),
        bytes_of("BeginRead", "requested").alias("bytes_requested_read"), bytes_of("EndRead", "actual").alias("bytes_read"), bytes_of("BeginWrite", "requested").alias("bytes_requested_write"), bytes_of("EndWrite", "actual").alias("bytes_written"),
    )


def file_samples(e: DataFrame) -> DataFrame:
    """The first activities of each capture: a row that its begin opens and its end completes, with all begins counted."""
    rows = _file_events(e)
    begins = rows.where("begins").select(*TRACE, "thread_id", "seq", "what", "cycle", "requested")
    ends = rows.where("not begins and paired").select(*TRACE, F.col("opener.seq").alias("seq"), F.col("cycle").alias("end_cycle"), "actual", F.coalesce(is_event("EndOpen", "EndReOpen") & (F.col("handle") == INVALID_HANDLE), F.lit(False)).alias("failed"))
    first = summaries.capped(begins, TRACE, CAPS["file_samples"], F.col("seq"))
    return first.join(ends, [*TRACE, "seq"], "left").withColumn("duration", F.greatest(F.col("end_cycle") - F.col("cycle"), F.lit(0)))


def heap(event: str) -> Column:
    """The root heap that the spelling of an event names, else its field."""
    return F.when(F.col(event).endswith("System"), 0).when(F.col(event).endswith("Video"), 1).otherwise(F.coalesce(number("RootHeap"), F.lit(0)))


def _allocations(e: DataFrame) -> DataFrame:
    """Allocations and frees of each address; sizes in units of the capture's shift with their low bits."""
    init = last_by(of(e, "Memory", "Init"), [], size_shift=number("SizeShift"))
    rows = e.where((F.col("logger") == "Memory") & F.col("event").rlike("^(Alloc|Free|ReallocAlloc|ReallocFree)")).select(*TRACE, "seq", "event", text("Address").alias("address"), number("Size").alias("size"), F.coalesce(number("AlignmentPow2_SizeLower"), F.lit(0)).alias("low"), heap("event").alias("root_heap"), number("CallstackId").alias("callstack"))
    shift = F.coalesce("size_shift", F.lit(0)).cast("int")
    size = F.call_function("shiftleft", F.col("size"), shift).bitwiseOR(F.col("low").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1))
    rows = rows.join(init, TRACE, "left").withColumn("size", size)
    is_alloc = F.col("event").contains("Alloc")
    return pairing.pair_overwrite(rows.withColumn("cycle", F.col("seq")), [*TRACE, "address"], "seq", is_alloc, ~is_alloc, "cycle")


def memory(e: DataFrame) -> DataFrame:
    """Counts and bytes of each root heap; a free counts for the heap of its allocation, or its own if it has none."""
    paired = _allocations(e)
    begin, matched = F.col("kind") == "begin", F.col("outcome") == "matched"
    # A matched pair's free is told from its allocation's row, so that it counts for that row's heap.
    frees = F.when(begin & matched, 1).when(~begin & ~matched, 1).otherwise(0)
    size = lambda when: F.coalesce(F.sum(F.when(when, F.col("size"))), F.lit(0))
    out = paired.groupBy(*TRACE, "root_heap").agg(F.count_if(begin).alias("allocations"), F.sum(frees).alias("frees"), size(begin).alias("allocated_bytes"), size(begin & matched).alias("freed_bytes"), size(begin & (F.col("outcome") == "open")).alias("outstanding_bytes"))
    return out.withColumns({"heap": fn.label(F.col("root_heap"), fn.ROOT_HEAP, "Other"), "net_bytes": F.col("allocated_bytes") - F.col("freed_bytes")})


def memory_totals(e: DataFrame) -> DataFrame:
    begin, matched = F.col("kind") == "begin", F.col("outcome") == "matched"
    is_open, realloc = begin & (F.col("outcome") == "open"), F.col("event").startswith("Realloc")
    size = lambda when: F.coalesce(F.sum(F.when(when, F.col("size"))), F.lit(0))
    return _allocations(e).groupBy(*TRACE).agg(F.count_if(begin).alias("allocations"), F.count_if(~begin).alias("frees"), F.count_if(begin & realloc).alias("realloc_allocations"), F.count_if(~begin & realloc).alias("realloc_frees"), F.count_if(~begin & ~matched).alias("unresolved_frees"), size(begin).alias("allocated_bytes"), size(begin & matched).alias("freed_bytes"), F.count_if(is_open).alias("outstanding"), size(is_open).alias("outstanding_bytes"))


def memory_tags(e: DataFrame) -> DataFrame:
    specs = last_by(of(e, "Memory", "TagSpec").withColumn("tag", number("Tag")), ["tag"], parent=number("Parent"), name=text("Display"))
    uses = of(e, "Memory", "MemoryScope").groupBy(*TRACE, number("Tag").alias("tag")).agg(F.count("*").alias("scopes"))
    return specs.join(uses, [*TRACE, "tag"], "full_outer").fillna(0, ["scopes"])


def modules(e: DataFrame) -> DataFrame:
    """The latest load of each base, bases in bytes; ``active`` until it is unloaded. Loads of no bytes do not count."""
    init = last_by(of(e, "Diagnostics", "ModuleInit"), [], shift=number("ModuleBaseShift"))
    rows = of(e, "Diagnostics", "ModuleLoad", "ModuleUnload").select(*TRACE, "seq", "event", number("Base").alias("raw"), number("Size").alias("size"), text("Name").alias("name"), text("ImageId").alias("image_id")).where("event = 'ModuleUnload' or size > 0")
    rows = rows.join(init, TRACE, "left").withColumn("base", F.call_function("shiftleft", F.col("raw"), F.coalesce("shift", F.lit(0)).cast("int"))).withColumn("cycle", F.col("seq"))
    paired = pairing.pair_overwrite(rows, [*TRACE, "base"], "seq", is_event("ModuleLoad"), is_event("ModuleUnload"), "cycle").where("kind = 'begin'")
    newest = paired.groupBy(*TRACE, "base").agg(F.max_by(F.struct("size", "name", "image_id", F.col("outcome").isin("open", "overwritten").alias("active")), "seq").alias("r"), F.count_if(F.col("outcome") == "overwritten").alias("duplicates"))
    return newest.select(*TRACE, "base", "r.*", "duplicates", module_identity(F.col("r.image_id")).alias("identity"))


def module_identity(image_id: Column) -> Column:
    """What identifies a module's build: a GUID with an age for 20 bytes, else the bytes; null without any."""
    data = F.unhex(image_id)
    with_age = F.concat(fn.guid_text(F.substring(data, 1, 16)), F.lit("-"), F.conv(F.concat(*(F.hex(F.substring(data, i, 1)) for i in (20, 19, 18, 17))), 16, 10))
    return F.when(F.octet_length(data) == 20, with_age).when(F.octet_length(data) > 0, F.lower(image_id))


def callstacks(e: DataFrame) -> DataFrame:
    """First definition of each callstack, its duplicates, frames as hexadecimal bytes (255 frames at most)."""
    rows = e.where(F.col("event") == "CallstackSpec").select(*TRACE, "seq", number("CallstackId").alias("id"), F.substring(text("Frames"), 1, 255 * 16).alias("frames"))
    first = rows.groupBy(*TRACE, "id").agg(F.min_by("frames", "seq").alias("frames"), (F.count("*") - 1).alias("duplicates"), F.min("seq").alias("seq")).where("id <> 0")
    ranked = first.withColumns({"place": F.row_number().over(Window.partitionBy(*TRACE).orderBy("seq")), "total": F.count("*").over(Window.partitionBy(*TRACE))})
    return ranked.where(F.col("place") <= CAPS["callstacks"]).select(*TRACE, "id", "frames", (F.length("frames") / 16).cast("long").alias("frame_count"), "duplicates", (F.col("total") > CAPS["callstacks"]).alias("truncated"))


def resolve_callstacks(rows: DataFrame, stacks: DataFrame, key: str) -> DataFrame:
    """Add ``callstack_status``: none, resolved, missing, or truncated where the capture has more stacks than are kept."""
    cut = stacks.groupBy(*TRACE).agg(F.max("truncated").alias("_cut"))
    joined = rows.join(stacks.select(*TRACE, F.col("id").alias(key), "frames"), [*TRACE, key], "left").join(cut, TRACE, "left")
    missing = F.when(F.coalesce("_cut", F.lit(False)), "truncated").otherwise("missing")
    return joined.withColumn("callstack_status", F.when(F.coalesce(F.col(key), F.lit(0)) == 0, "none").when(F.col("frames").isNotNull(), "resolved").otherwise(missing)).drop("_cut")


def symbolized(addresses: DataFrame, loaded: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Addresses with module, offset and status; ``symbols`` (module, start, end, symbol) name them if given."""
    found = joins.resolve_ranges(addresses, loaded.withColumn("stop", F.col("base") + F.col("size")), TRACE, "address", "base", "stop", "name", 1 << 20, on=TRACE)
    located = found.join(loaded.select(*TRACE, "name", "base"), [*TRACE, "name"], "left").withColumn("rva", F.col("address") - F.col("base"))
    if symbols is None:
        return located
    return located.join(symbols, (located["name"] == symbols["module"]) & (located["rva"] >= symbols["start"]) & (located["rva"] < symbols["end"]), "left")


def prologue(e: DataFrame) -> DataFrame:
    """Where a capture's cycles begin and how many make a second."""
    return last_by(of(e, "$Trace", "NewTrace"), [], start_cycle=number("StartCycle"), frequency=number("CycleFrequency"), endian=number("Endian"), pointer_size=number("PointerSize"))


def with_seconds(rows: DataFrame, e: DataFrame, **cycles: str) -> DataFrame:
    """Add seconds for cycle columns, given as new name to column; null where the capture does not tell its frequency."""
    joined = rows.join(prologue(e).select(*TRACE, "frequency"), TRACE, "left")
    return joined.withColumns({name: fn.cycles_to_seconds(F.col(c), F.col("frequency")) for name, c in cycles.items()}).drop("frequency")


def _group_pairs(e: DataFrame) -> DataFrame:
    rows = of(e, "$Trace", "ThreadGroupBegin", "ThreadGroupEnd").select(*TRACE, "seq", "event", text("Name").alias("name"), F.col("seq").alias("cycle"))
    return pairing.pair_lifo(rows, TRACE, "seq", is_event("ThreadGroupBegin"), is_event("ThreadGroupEnd"), "cycle")


def thread_groups(e: DataFrame) -> DataFrame:
    begins = _group_pairs(e).where("kind = 'begin'")
    return begins.groupBy(*TRACE, "name").agg(F.count("*").alias("begins"), F.count_if("matched").alias("ends")).withColumn("balanced", F.col("begins") == F.col("ends")).orderBy(*TRACE, F.desc("begins"), "name")


def thread_group_totals(e: DataFrame) -> DataFrame:
    begin = F.col("kind") == "begin"
    return _group_pairs(e).groupBy(*TRACE).agg(F.count_if(begin).alias("begins"), F.count_if(~begin).alias("ends"), F.count_if(~begin & ~F.col("matched")).alias("unmatched_ends"), F.count_if(begin & ~F.col("matched")).alias("unclosed"))


def threads(e: DataFrame) -> DataFrame:
    """Declared threads, the first declaration of each, with the groups that were open then, outermost first."""
    rows = of(e, "$Trace", "ThreadInfo").select(*TRACE, "seq", number("ThreadId").alias("thread"), text("Name").alias("name"), number("SortHint").alias("sort_hint"), number("SystemId").alias("system_id"))
    first = rows.groupBy(*TRACE, "thread").agg(F.min_by(F.struct("seq", "name", "sort_hint", "system_id"), "seq").alias("r")).select(*TRACE, "thread", "r.*")
    groups = _group_pairs(e).where("kind = 'begin'").select(*TRACE, F.col("seq").alias("opened"), F.col("end_seq").alias("closed"), F.col("name").alias("group_name"))
    inside = first.join(groups, TRACE).where((F.col("opened") < F.col("seq")) & (F.col("closed").isNull() | (F.col("closed") > F.col("seq"))))
    lists = inside.groupBy(*TRACE, "thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("opened", "group_name"))), lambda x: x["group_name"]).alias("groups"))
    out = first.join(lists, [*TRACE, "thread"], "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
    return out.withColumn("active_group", F.try_element_at("groups", F.lit(-1))).drop("seq").orderBy(*TRACE, "thread")


def with_thread_names(rows: DataFrame, e: DataFrame, key: str = "thread_id") -> DataFrame:
    """Add ``thread_name`` and ``system_id`` of declared threads."""
    return rows.join(threads(e).select(*TRACE, F.col("thread").cast("int").alias(key), F.col("name").alias("thread_name"), "system_id"), [*TRACE, key], "left")


def thread_timing(e: DataFrame) -> DataFrame:
    """The latest base timestamp of each thread that gives one."""
    return last_by(of(e, "$Trace", "ThreadTiming"), ["thread_id"], base_timestamp=number("BaseTimestamp"))


def end_threads(e: DataFrame) -> DataFrame:
    return of(e, "CpuProfiler", "EndThread").select(*TRACE, "seq", "thread_id", number("Cycle").alias("cycle"))


def channels(e: DataFrame) -> DataFrame:
    announced = last_by(of(e, "Trace", "ChannelAnnounce").withColumn("id", number("Id")), ["id"], name=text("Name"), announced_enabled=number("IsEnabled") != 0)
    toggles = of(e, "Trace", "ChannelToggle").groupBy(*TRACE, number("Id").alias("id")).agg(F.max_by(number("IsEnabled") != 0, "seq").alias("toggled"), F.count("*").alias("toggles"))
    return announced.join(toggles, [*TRACE, "id"], "left").withColumn("enabled", F.coalesce("toggled", "announced_enabled")).fillna(0, ["toggles"]).drop("toggled")


def slate(e: DataFrame) -> DataFrame:
    return of(e, "SlateTrace", "AddWidget").groupBy(*TRACE).agg(F.count("*").alias("widgets"), F.min_by(number("Cycle"), "seq").alias("first_cycle"), F.max_by(number("Cycle"), "seq").alias("last_cycle"))


def metadata_stack(e: DataFrame) -> DataFrame:
    """Saved and restored stacks by id: the union of both sets of ids."""
    rows = of(e, "MetadataStack", "SaveStack", "RestoreStack")
    return rows.groupBy(*TRACE, number("Id").alias("id")).agg(F.count_if(is_event("SaveStack")).alias("saves"), F.count_if(is_event("RestoreStack")).alias("restores")).withColumn("saved", F.col("saves") > 0)


def metadata_stack_totals(e: DataFrame) -> DataFrame:
    clears = of(e, "MetadataStack", "ClearScope").groupBy(*TRACE).agg(F.count("*").alias("clears"))
    ids = metadata_stack(e).groupBy(*TRACE).agg(F.sum("saves").alias("saves"), F.sum("restores").alias("restores"), F.sum(F.when(F.col("saved"), 0).otherwise(F.col("restores"))).alias("unmatched_restores"))
    return ids.join(clears, TRACE, "full_outer").fillna(0)


# GPU. The frame of a fact is its queue's latest boundary; work and breadcrumbs belong to the frame in which they end.


def _gpu_rows(e: DataFrame) -> DataFrame:
    rows = e.where(F.col("logger") == "GpuProfiler").select(
        *TRACE, "seq", "event", number("QueueId").alias("queue"), number("FrameNumber").alias("boundary"), F.coalesce(number("GPUTimestampTOP"), number("GPUTimestampBOP")).alias("cycle"), number("CPUTimestamp").alias("submitted"),
        number("SpecId").alias("spec"), F.unhex(text("Metadata")).alias("metadata"), number("StartTime").alias("wait_start"), number("EndTime").alias("wait_end"), number("NumDraws").alias("draws"), number("NumPrimitives").alias("primitives"),
    ).where(F.col("event").isin(*GPU_EVENTS))
    return timeline.forward_fill(rows, [*TRACE, "queue"], "seq", F.when(is_event("EventFrameBoundary"), F.col("boundary")), "frame")


def _gpu_pairs(e: DataFrame, what: str) -> DataFrame:
    """Begins and ends of Work or Breadcrumb; breadcrumbs without a time are as if they were not there."""
    rows = _gpu_rows(e).where(is_event(f"EventBegin{what}", f"EventEnd{what}"))
    rows = rows.where("cycle <> 0") if what == "Breadcrumb" else rows
    return pairing.pair_lifo(rows, [*TRACE, "queue"], "seq", is_event(f"EventBegin{what}"), is_event(f"EventEnd{what}"), "cycle", ends=["frame"])


def gpu_work(e: DataFrame) -> DataFrame:
    """Begun work of each queue with the frame in which it ends; ends before begins are negative."""
    paired = _gpu_pairs(e, "Work").where("kind = 'begin'")
    return paired.select(*TRACE, "queue", F.col("end_frame").alias("frame"), "submitted", F.col("cycle").alias("start"), F.col("end_cycle").alias("end"), "duration", F.coalesce(F.col("end_cycle") < F.col("cycle"), F.lit(False)).alias("negative"), F.col("end_seq").isNull().alias("unterminated"), "seq", "end_seq")


def gpu_breadcrumb_specs(e: DataFrame) -> DataFrame:
    specs = last_by(of(e, "GpuProfiler", "EventBreadcrumbSpec").withColumn("spec", number("SpecId")), ["spec"], static=text("StaticName"), format=text("NameFormat"), fields=F.unhex(text("FieldNames")))
    parts = decoders.split_names("static", "format")
    return specs.withColumn("_n", parts).select(*TRACE, "spec", F.col("_n.name").alias("name"), F.col("_n.template").alias("template"), decoders.field_name_list("fields").alias("field_names"))


def gpu_breadcrumb_intervals(e: DataFrame) -> DataFrame:
    """Closed breadcrumbs with their rendered name; ends before begins have no duration."""
    paired = _gpu_pairs(e, "Breadcrumb").where("kind = 'begin' and matched")
    named = paired.join(gpu_breadcrumb_specs(e), [*TRACE, "spec"], "left").withColumn("_m", decoders.metadata_report("name", "template", "metadata"))
    return named.select(*TRACE, "queue", F.col("end_frame").alias("frame"), "spec", F.coalesce("name", F.concat(F.lit("#"), "spec")).alias("name"), F.col("_m.rendered").alias("rendered"), F.col("cycle").alias("start"), F.col("end_cycle").alias("end"), "duration", (F.col("end_cycle") < F.col("cycle")).alias("negative"), F.col("_m.bytes").alias("metadata_bytes"), F.col("_m.decoded_bytes").alias("decoded_bytes"), "seq", "end_seq")


def gpu_queues(e: DataFrame) -> DataFrame:
    """Measures of each queue; times span all events of a queue that have one."""
    rows, work, crumbs = _gpu_rows(e), _gpu_pairs(e, "Work"), _gpu_pairs(e, "Breadcrumb")
    by = [*TRACE, "queue"]
    begin, matched = F.col("kind") == "begin", F.col("matched")
    negative = F.col("end_cycle") < F.col("cycle")

    def pairs(paired: DataFrame, name: str, negative_counts: bool) -> DataFrame:
        done = begin & matched & (F.lit(True) if negative_counts else ~negative)
        return paired.groupBy(*by).agg(F.count_if(done).alias(f"{name}_count"), F.coalesce(F.sum(F.when(done, F.col("duration"))), F.lit(0)).alias(f"{name}_cycles"), F.count_if(~begin & ~matched).alias(f"unmatched_{name}_ends"), F.count_if(begin & matched & negative).alias(f"negative_{name}"), F.count_if(begin & ~matched).alias(f"unterminated_{name}"))

    is_wait = is_event("EventWait")
    good = is_wait & (F.col("wait_end") >= F.col("wait_start"))
    timed = F.when(F.col("event").contains("Breadcrumb"), F.when(F.col("cycle") != 0, F.col("cycle"))).otherwise(F.col("cycle"))
    on_cpu = F.when(is_event("EventBeginWork", "SignalFence", "WaitFence"), F.col("submitted"))
    order = F.when(on_cpu.isNotNull(), F.col("seq"))
    own = rows.groupBy(*by).agg(
        F.least(F.min(timed), F.min(F.least("wait_start", "wait_end"))).alias("first_gpu"), F.greatest(F.max(timed), F.max(F.greatest("wait_start", "wait_end"))).alias("last_gpu"), F.min_by(on_cpu, order).alias("first_cpu"), F.max_by(on_cpu, order).alias("last_cpu"),
        F.count_if(good).alias("wait_count"), F.coalesce(F.sum(F.when(good, F.col("wait_end") - F.col("wait_start"))), F.lit(0)).alias("wait_cycles"), F.count_if(is_event("EventFrameBoundary")).alias("boundaries"), F.max_by("boundary", F.when(is_event("EventFrameBoundary"), F.col("seq"))).alias("last_frame"),
        F.coalesce(F.sum("draws"), F.lit(0)).alias("draws"), F.coalesce(F.sum("primitives"), F.lit(0)).alias("primitives"), F.count_if(is_event("SignalFence")).alias("signal_fences"), F.count_if(is_event("WaitFence")).alias("wait_fences"),
    )
    names = last_by(of(e, "GpuProfiler", "QueueSpec").withColumn("queue", number("QueueId")), ["queue"], queue_name=F.when(text("TypeString") != "", text("TypeString")))
    out = own.join(pairs(work, "work", False), by, "left").join(pairs(crumbs, "breadcrumb", True), by, "left").join(names, by, "full_outer")
    zero = [c for c in out.columns if c.endswith(("_count", "_cycles", "_ends", "_fences")) or c.startswith(("negative", "unterminated")) or c in ("boundaries", "draws", "primitives")]
    kind, gpu, index = fn.queue_parts(F.col("queue"))
    return out.fillna(0, zero).withColumns({"queue_type": kind, "gpu": gpu, "queue_index": index}).orderBy(*TRACE, F.desc("work_cycles"), "queue")


def gpu_frames(e: DataFrame) -> DataFrame:
    """Facts of each queue's frames; times span the work, breadcrumbs and waits that count."""
    rows = _gpu_rows(e).where("frame is not null")
    none = F.lit(None).cast("long")
    work = gpu_work(e).where("not unterminated and not negative and frame is not null").select(*TRACE, "queue", "frame", F.lit("work").alias("what"), "start", "end", "duration", none.alias("draws"), none.alias("primitives"))
    crumbs = gpu_breadcrumb_intervals(e).where("frame is not null").select(*TRACE, "queue", "frame", F.lit("breadcrumb").alias("what"), "start", "end", "duration", none.alias("draws"), none.alias("primitives"))
    waits = rows.where(is_event("EventWait") & (F.col("wait_end") >= F.col("wait_start"))).select(*TRACE, "queue", "frame", F.lit("wait").alias("what"), F.col("wait_start").alias("start"), F.col("wait_end").alias("end"), (F.col("wait_end") - F.col("wait_start")).alias("duration"), none.alias("draws"), none.alias("primitives"))
    other = rows.where(is_event("EventFrameBoundary", "EventStats", "SignalFence", "WaitFence")).select(*TRACE, "queue", "frame", F.col("event").alias("what"), none.alias("start"), none.alias("end"), none.alias("duration"), "draws", "primitives")
    facts = work.unionByName(crumbs).unionByName(waits).unionByName(other)
    is_ = lambda what: F.col("what") == what
    spans = [m for w in ("work", "breadcrumb", "wait") for m in (F.count_if(is_(w)).alias(f"{w}_count"), F.coalesce(F.sum(F.when(is_(w), F.col("duration"))), F.lit(0)).alias(f"{w}_cycles"))]
    return facts.groupBy(*TRACE, "queue", "frame").agg(
        F.count_if(is_("EventFrameBoundary")).alias("boundaries"), *spans, F.coalesce(F.sum("draws"), F.lit(0)).alias("draws"), F.coalesce(F.sum("primitives"), F.lit(0)).alias("primitives"), F.count_if(is_("SignalFence")).alias("signal_fences"), F.count_if(is_("WaitFence")).alias("wait_fences"),
        F.least(F.min("start"), F.min("end")).alias("first_gpu"), F.greatest(F.max("start"), F.max("end")).alias("last_gpu"),
    ).orderBy(*TRACE, "queue", "frame")


def gpu_frame_breadcrumbs(e: DataFrame) -> DataFrame:
    """The rendered breadcrumbs of each queue's frame with the most cycles."""
    totals = gpu_breadcrumb_intervals(e).where("frame is not null and rendered <> ''").groupBy(*TRACE, "queue", "frame", "rendered").agg(F.count("*").alias("count"), F.sum("duration").alias("total_cycles"))
    return summaries.capped(totals, [*TRACE, "queue", "frame"], CAPS["frame_breadcrumbs"], F.desc("total_cycles"), F.desc("count"), F.col("rendered"))


def gpu_timeline(e: DataFrame, frame: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Work and breadcrumbs that end in a frame, in dispatch order, and their bounds and number whatever the limit."""
    work = gpu_work(e).where("not unterminated and not negative").select(*TRACE, "queue", "frame", F.lit("work").alias("what"), F.lit("Work").alias("name"), "start", "end", "duration", "end_seq")
    crumbs = gpu_breadcrumb_intervals(e).select(*TRACE, "queue", "frame", F.lit("breadcrumb").alias("what"), F.coalesce("rendered", "name").alias("name"), "start", "end", "duration", "end_seq")
    return timeline.in_frame(work.unionByName(crumbs), TRACE, "frame", frame, "start", "end", ["end_seq"], CAPS["timeline"] if limit is None else limit)


def gpu_latency(e: DataFrame) -> DataFrame:
    """Upper median, least and greatest delay from submission to start over the first pairs of each capture."""
    rows = gpu_work(e).where("submitted <> 0 and start <> 0").withColumn("delay", F.col("start").cast("decimal(38,0)") - F.col("submitted"))
    first = summaries.top_k_per_group(rows, TRACE, CAPS["latency_pairs"], F.col("seq"))
    return summaries.percentiles(first, TRACE, "delay", {"median": summaries.upper_median_index(), "least": F.lit(0), "greatest": F.col("n") - 1})


def gpu_breadcrumbs(e: DataFrame) -> DataFrame:
    """Breadcrumbs by their spec with the bytes of their metadata; those with the most cycles."""
    totals = gpu_breadcrumb_intervals(e).groupBy(*TRACE, "spec", "name").agg(F.count("*").alias("count"), F.sum("duration").alias("total_cycles"), F.count_if(F.col("metadata_bytes") > 0).alias("metadata_events"), F.sum("metadata_bytes").alias("metadata_bytes"))
    return summaries.capped(totals, TRACE, CAPS["breadcrumbs"], F.desc("total_cycles"), F.desc("count"), F.col("spec"))


# Memory tags of the low-level tracker.


def llm_tags(e: DataFrame) -> DataFrame:
    return last_by(of(e, "LLM", "TagsSpec").withColumn("tag", text("TagId")), ["tag"], name=text("Name"), parent=text("ParentId"), tag_set=text("TagSetId"))


def llm_trackers(e: DataFrame) -> DataFrame:
    return last_by(of(e, "LLM", "TrackerSpec").withColumn("tracker", number("TrackerId")), ["tracker"], name=text("Name"))


def llm_tag_sets(e: DataFrame) -> DataFrame:
    return last_by(of(e, "LLM", "TagSetSpec").withColumn("tag_set", number("TagSetId")), ["tag_set"], name=text("Name"))


def llm_values(e: DataFrame) -> DataFrame:
    """The latest value of each tracker and tag by cycle, of equal cycles the later arrival.

    Tags are 32 or 64 bits wide, values 64; an event has at most LLM_VALUES of them.
    """
    rows = of(e, "LLM", "TagValue").select(*TRACE, "seq", number("TrackerId").alias("tracker"), number("Cycle").alias("cycle"), F.upper(text("Tags")).alias("tags"), F.upper(text("Values")).alias("values"))
    n = (F.length("values") / 16).cast("int")
    little = lambda digits, at, width: F.concat(*(F.substring(digits, at + 2 * i + 1, 2) for i in range(width - 1, -1, -1)))
    signed = lambda digits: F.conv(digits, 16, -10).cast("long")
    pieces = rows.withColumn("n", F.least(n, F.lit(LLM_VALUES))).withColumn("width", (F.length("tags") / 2 / n).cast("int")).where("n > 0 and width in (4, 8)")
    pieces = pieces.select(*TRACE, "seq", "tracker", "cycle", "tags", "values", "width", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    tag = F.when(F.col("width") == 4, F.conv(little(F.col("tags"), F.col("i") * 8, 4), 16, 10).cast("long")).otherwise(signed(little(F.col("tags"), F.col("i") * 16, 8)))
    facts = pieces.select(*TRACE, F.struct("seq", "i").alias("order"), "tracker", "cycle", tag.alias("tag"), signed(little(F.col("values"), F.col("i") * 16, 8)).alias("value"))
    return summaries.latest(facts, [*TRACE, "tracker", "tag"], "value", "cycle", "order").orderBy(*TRACE, F.desc(F.abs("latest_value")), F.desc("latest_cycle"), "tracker", "tag")


# CPU scopes, their metadata, and the frames that metadata name.


def cpu_specs(e: DataFrame) -> DataFrame:
    return last_by(of(e, "CpuProfiler", "EventSpec").withColumn("spec_id", number("Id")), ["spec_id"], name=text("Name"), file=text("File"), line=number("Line"))


def cpu_intervals(e: DataFrame, contexts: bool = True) -> DataFrame:
    """CPU scopes in the capture's own cycles, with the metadata that was active when they closed."""
    origin = prologue(e).select(*TRACE, F.col("start_cycle").alias("base"), "frequency")
    return cpu.cpu_intervals(cpu.batches_in_context(e, origin) if contexts else cpu.batches_of(e).join(origin, TRACE, "left"), contexts=contexts)


def scope_totals(intervals: DataFrame, specs: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Closed scopes that are not metadata, by their spec and, say, their thread."""
    plain = intervals.where("end_cycle is not null and not is_metadata") if "is_metadata" in intervals.columns else intervals.where("end_cycle is not null")
    totals = summaries.scope_totals(plain, [*TRACE, *by, "spec_id"], "duration")
    named = totals if specs is None else totals.join(specs, [*TRACE, "spec_id"], "left")
    return named.withColumn("name", F.coalesce(F.col("name") if specs is not None else F.lit(None).cast("string"), F.concat(F.lit("#"), "spec_id"))).orderBy(*TRACE, *by, F.desc("total_cycles"), "spec_id")


def thread_totals(e: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Scopes and cycles of each thread and spec, summed up where they are decoded.

    Batches are in their threads' order already, so they may come from events that were not dispatched.
    """
    origin = prologue(e).select(*TRACE, F.col("start_cycle").alias("base"), "frequency")
    totals = cpu.cpu_totals((cpu.batches_of(e) if batches is None else batches).join(F.broadcast(origin), TRACE, "left"))  # a row for each capture
    return totals.withColumn("total_cycles", F.least("total_cycles", F.lit(fn.MAX_LONG)).cast("long"))


def spec_totals(e: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """The same of all threads together, by the names of the specs."""
    sums = thread_totals(e, batches).groupBy(*TRACE, "spec_id").agg(F.sum("count").alias("count"), F.sum("total_cycles").alias("total_cycles"))
    named = sums.join(cpu_specs(e).select(*TRACE, "spec_id", "name"), [*TRACE, "spec_id"], "left")
    return named.withColumn("name", F.coalesce("name", F.concat(F.lit("#"), "spec_id"))).orderBy(*TRACE, F.desc("total_cycles"), "spec_id")


def thread_scopes(e: DataFrame) -> DataFrame:
    """Scopes of each thread with its declared name, and their seconds."""
    named = thread_totals(e).join(cpu_specs(e).select(*TRACE, "spec_id", "name"), [*TRACE, "spec_id"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("#"), "spec_id")))
    return with_seconds(with_thread_names(named, e), e, total_seconds="total_cycles").orderBy(*TRACE, "thread_id", F.desc("total_cycles"), "spec_id")


def metadata_specs(e: DataFrame) -> DataFrame:
    specs = last_by(of(e, "CpuProfiler", "MetadataSpec").withColumn("spec_id", number("Id")), ["spec_id"], static=text("Name"), format=text("NameFormat"), fields=F.unhex(text("FieldNames")))
    parts = decoders.split_names("static", "format")
    return specs.withColumn("_n", parts).select(*TRACE, "spec_id", F.col("_n.name").alias("name"), F.col("_n.template").alias("template"), decoders.field_name_list("fields").alias("field_names"))


def metadata_records(e: DataFrame) -> DataFrame:
    """Every introduction of metadata, in dispatch order, with its rendered name and what its payload holds."""
    rows = of(e, "CpuProfiler", "Metadata").select(*TRACE, "seq", number("Id").alias("metadata_id"), number("SpecId").alias("spec_id"), F.unhex(text("Metadata")).alias("payload"))
    named = rows.join(metadata_specs(e), [*TRACE, "spec_id"], "left").withColumn("_m", decoders.metadata_report("name", "template", "payload"))
    return named.select(*TRACE, "seq", "metadata_id", "spec_id", F.coalesce("name", F.concat(F.lit("#"), "spec_id")).alias("name"), "_m.*")


def _as_of_batch(rows: DataFrame, at: str, key: str, records: DataFrame, values: Sequence[str], prefix: str) -> DataFrame:
    """``values`` of a row's metadata as it was known when the batch at ``at`` was dispatched."""
    left = rows.withColumns({"_seq": F.col(at), "_key": F.col(key)})
    right = records.select(*TRACE, F.col("metadata_id").alias("_key"), F.col("seq").alias("_seq"), *values)
    return joins.as_of(left, right, [*TRACE, "_key"], "_seq", values, prefix).drop("_seq", "_key")


def metadata_intervals(e: DataFrame, intervals: DataFrame, records: DataFrame) -> DataFrame:
    """Scopes that count for metadata: those that are metadata, and others within a restored stack."""
    closed = intervals.where("end_cycle is not null")
    own = closed.where("is_metadata").withColumnRenamed("spec_id", "metadata_id")
    own = _as_of_batch(own, "opened_seq", "metadata_id", records, ["spec_id"], "meta_").where("meta_spec_id is not null").withColumn("attribution", F.lit("inline"))
    restored = closed.where("not is_metadata and restored_id is not null").withColumn("metadata_id", F.col("restored_id"))
    restored = _as_of_batch(restored, "closed_seq", "metadata_id", records, ["spec_id"], "meta_").where("meta_spec_id is not null").withColumn("attribution", F.lit("restored"))
    columns = [*TRACE, "thread_id", "seq", "metadata_id", F.col("meta_spec_id").alias("spec_id"), "attribution", "start_cycle", "end_cycle", "duration", "closed_seq"]
    both = own.select(*columns).unionByName(restored.select(*columns))
    return _as_of_batch(both, "closed_seq", "metadata_id", records, ["rendered"], "")


def metadata_totals(found: DataFrame, specs: DataFrame) -> DataFrame:
    """Scopes and cycles of each metadata spec, by attribution."""
    totals = found.groupBy(*TRACE, "spec_id", "attribution").agg(F.count("*").alias("count"), F.sum("duration").alias("total_cycles"))
    return totals.join(specs.select(*TRACE, "spec_id", "name"), [*TRACE, "spec_id"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("#"), "spec_id")))


def metadata_names(found: DataFrame) -> DataFrame:
    """Scopes and cycles of each rendered name, the ones with the most cycles."""
    totals = found.where("rendered is not null").groupBy(*TRACE, "spec_id", "rendered").agg(F.count("*").alias("count"), F.sum("duration").alias("total_cycles"))
    return summaries.capped(totals, TRACE, CAPS["metadata_names"], F.desc("total_cycles"), F.desc("count"), F.col("spec_id"), F.col("rendered"))


def metadata_spec_summaries(e: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """Records, bytes and decode quality of each spec, its first texts and names in order, and its scopes."""
    last = records.groupBy(*TRACE, "metadata_id").agg(F.max_by(F.struct("spec_id", "rendered", "bytes", "decoded_bytes", "skipped_bytes", "failed_reads", "n_values", "strings"), "seq").alias("r")).select(*TRACE, "metadata_id", "r.*")
    good = F.col("n_values") > 0
    firsts = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, CAPS["spec_strings"])
    of_records = last.groupBy(*TRACE, "spec_id").agg(
        F.count("*").alias("records"), F.sum("bytes").alias("metadata_bytes"), F.count_if(good).alias("decoded_records"), F.sum("n_values").alias("decoded_values"), F.sum("decoded_bytes").alias("decoded_bytes"), F.sum("skipped_bytes").alias("undecoded_bytes"), F.count_if(~good & (F.col("bytes") > 0)).alias("undecoded_records"), F.count_if(F.col("failed_reads") > 0).alias("failed_records"),
        firsts(F.flatten(F.collect_set("strings"))).alias("strings"), firsts(F.collect_set(F.when(good, F.col("rendered")))).alias("rendered_names"), F.min(F.when(good, F.col("metadata_id"))).alias("sample_id"),
    )
    scopes = found.groupBy(*TRACE, "spec_id").agg(F.count("*").alias("scopes"), F.sum("duration").alias("total_cycles"))
    out = of_records.join(scopes, [*TRACE, "spec_id"], "full_outer").fillna(0, ["records", "metadata_bytes", "decoded_records", "decoded_values", "decoded_bytes", "undecoded_bytes", "undecoded_records", "failed_records", "scopes", "total_cycles"])
    named = out.join(metadata_specs(e).select(*TRACE, "spec_id", "name"), [*TRACE, "spec_id"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("#"), "spec_id")))
    return summaries.capped(named, TRACE, CAPS["metadata_specs"], F.desc("total_cycles"), F.desc("scopes"), F.desc("records"), F.desc("metadata_bytes"), F.col("spec_id"))


def metadata_dashboard(e: DataFrame, intervals: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """One row a capture: specs, records, scopes with and without a known record, distinct field names and texts."""
    specs = metadata_specs(e)
    of_specs = specs.groupBy(*TRACE).agg(F.count("*").alias("specs"), F.count("template").alias("specs_with_template"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("field_names")))).alias("field_names"))
    last = records.groupBy(*TRACE, "metadata_id").agg(F.max_by(F.struct("bytes", "n_values", "strings"), "seq").alias("r")).select(*TRACE, "r.*")
    of_records = last.groupBy(*TRACE).agg(F.count("*").alias("records"), F.sum("bytes").alias("metadata_bytes"), F.sum("n_values").alias("decoded_values"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("strings")))), 1, CAPS["metadata_strings"]).alias("strings"))
    opened = intervals.where("is_metadata").groupBy(*TRACE).agg(F.count("*").alias("scopes"))
    resolved = found.groupBy(*TRACE).agg(F.count("*").alias("resolved_scopes"))
    out = of_specs.join(of_records, TRACE, "full_outer").join(opened, TRACE, "full_outer").join(resolved, TRACE, "full_outer").fillna(0, ["specs", "specs_with_template", "records", "metadata_bytes", "decoded_values", "scopes", "resolved_scopes"])
    return out.withColumn("unresolved_scopes", F.greatest(F.col("scopes") - F.col("resolved_scopes"), F.lit(0)))


def framed_scopes(intervals: DataFrame, records: DataFrame) -> DataFrame:
    """Closed scopes with the number of the innermost active metadata that names a frame, as known at their end."""
    closed = intervals.where("end_cycle is not null")
    named = records.withColumn("frame", fn.frame_number(F.col("rendered")))
    states = closed.where(F.size("active") > 0).select(*TRACE, "thread_id", "closed_seq", "active").distinct()
    each = states.select(*TRACE, "thread_id", "closed_seq", "active", F.posexplode("active").alias("place", "metadata_id"))
    known = _as_of_batch(each, "closed_seq", "metadata_id", named, ["frame"], "")
    frames_of = known.where("frame is not null").groupBy(*TRACE, "thread_id", "closed_seq", "active").agg(F.min_by("frame", "place").alias("frame"))
    return closed.join(frames_of, [*TRACE, "thread_id", "closed_seq", "active"], "left")


def cpu_timeline(scopes: DataFrame, frame: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scopes of a frame in dispatch order, and their bounds and number whatever the limit; of ``framed_scopes``."""
    return timeline.in_frame(scopes, TRACE, "frame", frame, "start_cycle", "end_cycle", ["closed_seq", "seq"], CAPS["timeline"] if limit is None else limit)


def frame_scopes(scopes: DataFrame) -> DataFrame:
    """The scopes of each frame with the most cycles; metadata scopes do not count."""
    totals = scopes.where("frame is not null and not is_metadata").groupBy(*TRACE, "frame", "spec_id").agg(F.count("*").alias("count"), F.sum("duration").alias("total_cycles"))
    return summaries.capped(totals, [*TRACE, "frame"], CAPS["frame_scopes"], F.desc("total_cycles"), F.col("spec_id"))


def frame_correlation(found: DataFrame, scopes: DataFrame, gpu: DataFrame) -> DataFrame:
    """Frames by number: metadata that name them, bounds of their scopes, and their GPU work over all queues."""
    by = [*TRACE, "frame"]
    meta = found.withColumn("frame", fn.frame_number(F.col("rendered"))).where("frame is not null").groupBy(*by).agg(F.count("*").alias("cpu_metadata_count"), F.sum("duration").alias("cpu_metadata_cycles"))
    bounds = scopes.where("frame is not null and not is_metadata").groupBy(*by).agg(F.min("start_cycle").alias("cpu_begin_cycle"), F.max("end_cycle").alias("cpu_end_cycle"))
    queues = gpu.groupBy(*by).agg(F.count("*").alias("gpu_queues"), *(F.sum(c).alias(f"gpu_{c}") for c in ("work_count", "work_cycles", "breadcrumb_count", "breadcrumb_cycles")))
    out = meta.join(bounds, by, "full_outer").join(queues, by, "full_outer")
    return out.fillna(0, [c for c in out.columns if c.startswith(("cpu_metadata", "gpu_"))]).orderBy(*by)


def frame_breadcrumbs(tops: DataFrame) -> DataFrame:
    """A frame's breadcrumbs over its queues, from the queues' lists, without those that name frames themselves."""
    kept = tops.where(fn.frame_number(F.col("rendered")).isNull())
    totals = kept.groupBy(*TRACE, "frame", "rendered").agg(F.sum("count").alias("count"), F.sum("total_cycles").alias("total_cycles"))
    return summaries.capped(totals, [*TRACE, "frame"], CAPS["frame_breadcrumbs"], F.desc("total_cycles"), F.desc("count"), F.col("rendered"))


# Types without a family of their own, and coverage.


def named_events(e: DataFrame) -> DataFrame:
    """Named CPU events with their first sample."""
    return summaries.inventory(e.where(F.col("logger") == "Cpu"), [*TRACE, "event"], "seq", "fields").orderBy(*TRACE, F.desc("count"), "event")


def unmodeled(e: DataFrame) -> DataFrame:
    """The most frequent types of loggers without a family, with the number of all such types and events."""
    rows = e.where(F.col("logger").isNotNull() & ~F.col("logger").isin(*LOGGERS, "Cpu"))
    counted = summaries.inventory(rows, [*TRACE, "logger", "event"], "seq", "fields")
    totals = counted.groupBy(*TRACE).agg(F.count("*").alias("event_types"), F.sum("count").alias("observed_events"))
    return summaries.capped(counted, TRACE, CAPS["unmodeled"], F.desc("count"), F.col("logger"), F.col("event")).join(totals, TRACE)


def decode_status(logger: Column, event: Column) -> Column:
    """decoded, partial or raw: how much of a type's events these families read."""
    name = F.concat_ws(".", logger, event)
    known = [f"{a}.{b}" for a, names in MODELED.items() for b in names.split()]
    return F.when(name.isin(*FULLY), "decoded").when(name.isin(*known) | (logger == "Cpu"), "partial").otherwise("raw")


def coverage_events(events: DataFrame, types: DataFrame) -> DataFrame:
    """Declared types with how often they occur and their decode status."""
    counts = events.where("uid is not null").groupBy(*TRACE, "uid").agg(F.count("*").alias("observed"))
    declared = types.select(*TRACE, "uid", "logger", "event").join(counts, [*TRACE, "uid"], "left").fillna(0, ["observed"])
    return declared.withColumn("status", decode_status(F.col("logger"), F.col("event"))).orderBy(*TRACE, F.desc("observed"), "logger", "event")


def coverage_summary(found: DataFrame) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    return found.groupBy(*TRACE).agg(F.count("*").alias("declared_types"), *(F.count_if(is_(s)).alias(f"{s}_types") for s in ("decoded", "partial", "raw")), F.sum("observed").alias("observed_events"), F.sum(F.when(is_("raw"), F.col("observed")).otherwise(0)).alias("raw_events"))


def decoders_not_observed(spark: SparkSession, types: DataFrame) -> DataFrame:
    """Types that the families know and a capture does not declare."""
    known = spark.createDataFrame([(a, b) for a, names in MODELED.items() for b in names.split()], "logger string, event string")
    wanted = types.select(*TRACE).distinct().crossJoin(F.broadcast(known))  # a bounded list for each capture
    return wanted.join(types.select(*TRACE, "logger", "event"), [*TRACE, "logger", "event"], "left_anti")


def coverage(events: DataFrame, universe: DataFrame) -> DataFrame:
    """Seen event types against a universe of ``Logger.Event`` names."""
    return joins.coverage(events.where("logger is not null").select(F.concat_ws(".", "logger", "event").alias("name")), universe, "name")


FAMILIES = {
    f.__name__: f
    for f in (
        counters, stats, stat_groups, csv, csv_stats, csv_categories, frames, regions, region_totals, bookmarks, logs, log_verbosities, log_categories, log_totals, tasks, task_names, task_waits, task_wait_totals,
        load_requests, load_totals, load_classes, load_packages, io_requests, io_backends, io_totals, files, file_samples, memory, memory_totals, memory_tags, modules, callstacks, prologue, threads, thread_groups, thread_group_totals,
        thread_timing, end_threads, channels, slate, metadata_stack, metadata_stack_totals, gpu_queues, gpu_frames, gpu_frame_breadcrumbs, gpu_latency, gpu_breadcrumbs, llm_tags, llm_trackers, llm_tag_sets, llm_values, cpu_specs, thread_scopes, named_events, unmodeled,
    )
}


def cpu_families(e: DataFrame) -> dict[str, DataFrame]:
    """The families that need the scopes' metadata contexts."""
    intervals, records = cpu_intervals(e), metadata_records(e)
    found, scopes = metadata_intervals(e, intervals, records), framed_scopes(intervals, records)
    return {
        "scopes": scope_totals(intervals, cpu_specs(e).select(*TRACE, "spec_id", "name")), "metadata": metadata_totals(found, metadata_specs(e)), "metadata_names": metadata_names(found), "metadata_specs": metadata_spec_summaries(e, found, records),
        "metadata_dashboard": metadata_dashboard(e, intervals, found, records), "frame_scopes": frame_scopes(scopes), "frame_correlation": frame_correlation(found, scopes, gpu_frames(e)), "frame_breadcrumbs": frame_breadcrumbs(gpu_frame_breadcrumbs(e)),
    }


def dashboard(events: DataFrame) -> dict[str, DataFrame]:
    """Every family, lazily, over events in dispatch order."""
    return {**{name: family(events) for name, family in FAMILIES.items()}, **cpu_families(events)}

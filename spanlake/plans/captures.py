"""Captures made of the supplied events, written, read back, decoded and summed up, with SQL over the same events.

Each capture holds the events of forty users, a thread each, in the order of ``event_id``, which the serials follow.
A theme is a set of mappings from events to trace events; a theme's captures are decoded once for a table and kept as a
written table, and every family reads its own part of that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..operators import joins, timeline
from ..sources import capture, writer
from ..storage import written
from . import dashboard
from .bindings import events, query

USERS = 40
#: The first serial of a capture, so that larger ones run over the end of the serials.
FIRST_SERIAL = 16_777_000

TYPES = [
    writer.Declared(name, tuple(tuple(f.split(":")) for f in fields.split()), important, synced)
    for name, fields, important, synced in (
        ("$Trace.NewTrace", "StartCycle:uint64 CycleFrequency:uint64 Endian:uint16 PointerSize:uint8", True, False),
        ("$Trace.ThreadInfo", "ThreadId:uint32 SystemId:uint32 SortHint:int32 Name:ansi_string", True, False),
        ("$Trace.ThreadGroupBegin", "Name:ansi_string", True, False),
        ("$Trace.ThreadGroupEnd", "Unused:uint8", True, False),
        ("$Trace.ThreadTiming", "BaseTimestamp:uint64", False, True),
        ("Counters.Spec", "Id:uint16 Type:uint8 Name:ansi_string", True, False),
        ("Counters.SetValueInt", "Cycle:uint64 Value:int64 CounterId:uint16", False, True),
        ("Counters.SetValueFloat", "Cycle:uint64 Value:float64 CounterId:uint16", False, True),
        ("Stats.Spec", "Id:uint32 IsFloatingPoint:uint8 IsMemory:uint8 ShouldClearEveryFrame:uint8 Name:ansi_string Group:ansi_string", True, False),
        ("Stats.EventBatch2", "Data:array", False, True),
        ("CsvProfiler.RegisterCategory", "Index:int32 Name:ansi_string", True, False),
        ("CsvProfiler.DefineDeclaredStat", "StatId:uint64 CategoryIndex:int32 Name:ansi_string", True, False),
        ("CsvProfiler.DefineInlineStat", "StatId:uint64 CategoryIndex:int32 Name:ansi_string", True, False),
        ("CsvProfiler.BeginStat", "StatId:uint64 Cycle:uint64", False, True),
        ("CsvProfiler.EndStat", "StatId:uint64 Cycle:uint64", False, True),
        ("CsvProfiler.CustomStatInt", "StatId:uint64 Cycle:uint64 Value:int32 OpType:uint8", False, True),
        ("Misc.BeginFrame", "Cycle:uint64 FrameType:uint8", False, True),
        ("Misc.EndFrame", "Cycle:uint64 FrameType:uint8", False, True),
        ("Misc.BookmarkSpec", "BookmarkPoint:uint64 Line:int32 FormatString:wide_string FileName:ansi_string", True, False),
        ("Misc.Bookmark", "Cycle:uint64 BookmarkPoint:uint64 CallstackId:uint32", False, True),
        ("Misc.RegionBegin", "Cycle:uint64 RegionName:wide_string Category:wide_string", False, True),
        ("Misc.RegionEnd", "Cycle:uint64 RegionName:wide_string", False, True),
        ("Misc.RegionBeginWithId", "CycleAndId:uint64 RegionName:wide_string Category:wide_string", False, True),
        ("Misc.RegionEndWithId", "Cycle:uint64 RegionId:uint64", False, True),
        ("Logging.LogCategory", "CategoryPointer:uint64 DefaultVerbosity:uint8 Name:ansi_string", True, False),
        ("Logging.LogMessageSpec", "LogPoint:uint64 CategoryPointer:uint64 Line:int32 Verbosity:uint8 FormatString:wide_string", True, False),
        ("Logging.LogMessage", "LogPoint:uint64 Cycle:uint64 FormatArgs:array", False, True),
        ("TaskTrace.Init", "Version:uint32", True, False),
        ("TaskTrace.Created", "Timestamp:uint64 TaskId:uint64", False, True),
        ("TaskTrace.Launched", "Timestamp:uint64 TaskId:uint64 DebugName:ansi_string", False, True),
        ("TaskTrace.Scheduled", "Timestamp:uint64 TaskId:uint64", False, True),
        ("TaskTrace.Started", "Timestamp:uint64 TaskId:uint64", False, True),
        ("TaskTrace.Finished", "Timestamp:uint64 TaskId:uint64", False, True),
        ("TaskTrace.WaitingStarted", "Timestamp:uint64 Tasks:array", False, True),
        ("TaskTrace.WaitingFinished", "Timestamp:uint64", False, True),
        ("LoadTime.ClassInfo", "Class:uint64 Name:ansi_string", False, True),
        ("LoadTime.PackageSummary", "AsyncPackage:uint64 TotalHeaderSize:uint32 ImportCount:uint32 ExportCount:uint32 Priority:int32 Name:wide_string", False, True),
        ("LoadTime.BeginRequest", "Cycle:uint64 RequestId:uint64", False, True),
        ("LoadTime.EndRequest", "Cycle:uint64 RequestId:uint64", False, True),
        ("LoadTime.StartAsyncLoading", "Cycle:uint64", False, True),
        ("LoadTime.SuspendAsyncLoading", "Cycle:uint64", False, True),
        ("LoadTime.ResumeAsyncLoading", "Cycle:uint64", False, True),
        ("IoStore.BackendName", "BackendHandle:uint64 Name:wide_string", True, False),
        ("IoStore.RequestCreate", "Cycle:uint64 RequestHandle:uint64 BatchHandle:uint64 Offset:uint64 Size:uint64 ChunkIdHash:uint32 ChunkType:uint8", False, True),
        ("IoStore.RequestStarted", "Cycle:uint64 RequestHandle:uint64 BackendHandle:uint64", False, True),
        ("IoStore.RequestCompleted", "Cycle:uint64 RequestHandle:uint64 Size:uint64", False, True),
        ("IoStore.RequestFailed", "Cycle:uint64 RequestHandle:uint64", False, True),
        ("PlatformFile.BeginOpen", "Cycle:uint64 Path:wide_string", False, True),
        ("PlatformFile.EndOpen", "Cycle:uint64 FileHandle:uint64", False, True),
        ("PlatformFile.BeginReOpen", "Cycle:uint64 OldFileHandle:uint64", False, True),
        ("PlatformFile.EndReOpen", "Cycle:uint64 NewFileHandle:uint64", False, True),
        ("PlatformFile.BeginClose", "Cycle:uint64 FileHandle:uint64", False, True),
        ("PlatformFile.EndClose", "Cycle:uint64", False, True),
        ("PlatformFile.BeginRead", "Cycle:uint64 ReadHandle:uint64 FileHandle:uint64 Offset:uint64 Size:uint64", False, True),
        ("PlatformFile.EndRead", "Cycle:uint64 ReadHandle:uint64 SizeRead:uint64", False, True),
        ("Memory.Init", "PageSize:uint64 MarkerPeriod:uint32 Version:uint8 MinAlignment:uint8 SizeShift:uint8", True, False),
        ("Memory.TagSpec", "Tag:int32 Parent:int32 Display:ansi_string", True, False),
        ("Memory.MemoryScope", "Tag:int32", False, True),
        ("Memory.Alloc", "Address:uint64 CallstackId:uint32 Size:uint32 AlignmentPow2_SizeLower:uint8 RootHeap:uint8", False, True),
        ("Memory.ReallocAllocVideo", "Address:uint64 CallstackId:uint32 Size:uint32 AlignmentPow2_SizeLower:uint8", False, True),
        ("Memory.Free", "Address:uint64 RootHeap:uint8", False, True),
        ("Memory.ReallocFreeSystem", "Address:uint64", False, True),
        ("Memory.CallstackSpec", "CallstackId:uint32 Frames:array", False, True),
        ("LLM.TagsSpec", "TagId:int64 ParentId:int64 TagSetId:uint8 Name:ansi_string", True, False),
        ("LLM.TrackerSpec", "TrackerId:uint8 Name:ansi_string", True, False),
        ("LLM.TagSetSpec", "TagSetId:uint8 Name:ansi_string", True, False),
        ("LLM.TagValue", "TrackerId:uint8 Cycle:uint64 Tags:array Values:array", False, True),
        ("MetadataStack.ClearScope", "Unused:uint8", False, True),
        ("MetadataStack.SaveStack", "Id:uint32", False, True),
        ("MetadataStack.RestoreStack", "Id:uint32", False, True),
        ("SlateTrace.AddWidget", "Cycle:uint64 WidgetId:uint64", False, True),
        ("Trace.ChannelAnnounce", "Id:uint32 IsEnabled:uint8 ReadOnly:uint8 Name:ansi_string", True, False),
        ("Trace.ChannelToggle", "Id:uint32 IsEnabled:uint8", False, True),
        ("Diagnostics.ModuleInit", "ModuleBaseShift:uint8 SymbolFormat:ansi_string", True, False),
        ("Diagnostics.ModuleLoad", "Base:uint64 Size:uint32 Name:wide_string ImageId:array", False, True),
        ("Diagnostics.ModuleUnload", "Base:uint64", False, True),
        ("GpuProfiler.QueueSpec", "QueueId:uint32 TypeString:wide_string", True, False),
        ("GpuProfiler.EventFrameBoundary", "QueueId:uint32 FrameNumber:uint32", False, True),
        ("GpuProfiler.EventBreadcrumbSpec", "SpecId:uint32 StaticName:wide_string NameFormat:wide_string FieldNames:array", True, False),
        ("GpuProfiler.EventBeginBreadcrumb", "SpecId:uint32 QueueId:uint32 GPUTimestampTOP:uint64 Metadata:array", False, True),
        ("GpuProfiler.EventEndBreadcrumb", "QueueId:uint32 GPUTimestampBOP:uint64", False, True),
        ("GpuProfiler.EventBeginWork", "QueueId:uint32 GPUTimestampTOP:uint64 CPUTimestamp:uint64", False, True),
        ("GpuProfiler.EventEndWork", "QueueId:uint32 GPUTimestampBOP:uint64", False, True),
        ("GpuProfiler.EventWait", "QueueId:uint32 StartTime:uint64 EndTime:uint64", False, True),
        ("GpuProfiler.EventStats", "QueueId:uint32 NumDraws:uint32 NumPrimitives:uint32", False, True),
        ("GpuProfiler.SignalFence", "QueueId:uint32 CPUTimestamp:uint64 Value:uint64", False, True),
        ("GpuProfiler.WaitFence", "QueueId:uint32 CPUTimestamp:uint64 Value:uint64", False, True),
        ("CpuProfiler.EventSpec", "Id:uint32 Line:int32 Name:wide_string File:ansi_string", True, False),
        ("CpuProfiler.MetadataSpec", "Id:uint32 Name:ansi_string NameFormat:wide_string FieldNames:array", True, False),
        ("CpuProfiler.Metadata", "Id:uint32 SpecId:uint32 Metadata:array", False, True),
        ("CpuProfiler.EventBatchV3", "Data:array", False, False),
        ("CpuProfiler.EndThread", "Cycle:uint64", False, True),
        ("Cpu.Tick", "Value:uint32", False, True),
        ("Game.Score", "Points:int32 Player:ansi_string", False, True),
    )
]


def _hex_udf(f: Callable):
    """An Arrow UDF from a list of numbers to hexadecimal bytes."""

    @arrow_udf(T.StringType())
    def udf(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v).hex() for v in values.to_pylist()], pa.string())

    return udf


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


varints = _hex_udf(lambda numbers: b"".join(map(varint, numbers)))
little32 = _hex_udf(lambda numbers: b"".join(n.to_bytes(4, "little") for n in numbers))
little64 = _hex_udf(lambda numbers: b"".join(n.to_bytes(8, "little", signed=True) for n in numbers))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied events with their capture, thread and cycle."""
    e = events(spark, sf_dir).withColumnRenamed("cycle", "micros")
    return e.select("*", F.concat(F.lit("c"), F.floor(F.col("user_id") / USERS)).alias("trace_id"), (F.col("user_id") % USERS + 2).cast("int").alias("thread_id"), (F.col("event_id") * 1000 + 1000).alias("cycle"))


def emitted(e: DataFrame, name: str, where: str, sub: int = 0, **fields: str) -> DataFrame:
    """Trace events of a type for the events that ``where`` holds for; fields are SQL, columns of hexadecimal included."""
    return e.where(where).select("trace_id", "thread_id", "event_id", F.lit(sub).alias("sub"), F.lit(name).alias("name"), F.to_json(F.struct(*(F.expr(v).alias(k) for k, v in fields.items()))).alias("fields"))


def declared(e: DataFrame, name: str, n: int, sub: int = 0, **fields: str) -> DataFrame:
    """``n`` important events of a type in every capture; fields are SQL over ``i``, from 0."""
    rows = e.select("trace_id").distinct().select("trace_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return rows.select("trace_id", F.lit(0).alias("thread_id"), (F.col("i").cast("long") - 1000).alias("event_id"), F.lit(sub).alias("sub"), F.lit(name).alias("name"), F.to_json(F.struct(*(F.expr(v).alias(k) for k, v in fields.items()))).alias("fields"))


def content(rows: list[DataFrame]) -> DataFrame:
    """``trace_id, content``: captures of the emitted rows, with serials in the order of their events."""
    every = reduce(DataFrame.unionByName, rows)
    synced = F.col("name").isin(*(t.name for t in TYPES if t.synced))
    order = F.row_number().over(Window.partitionBy("trace_id", synced).orderBy("event_id", "sub"))
    placed = every.withColumns({"pos": F.col("event_id") * 100 + F.col("sub"), "serial": F.when(synced, (order + FIRST_SERIAL) % joins.SERIALS).cast("int")})
    names = {r["name"] for r in every.select("name").distinct().collect()}  # of the types above
    return writer.write_captures(placed, [t for t in TYPES if t.name in names])


THEMES: dict[str, Callable[[DataFrame], list[DataFrame]]] = {}
_DECODED: dict[tuple[str, str, str], tuple[DataFrame, DataFrame]] = {}


def theme(f: Callable[[DataFrame], list[DataFrame]]) -> Callable[[DataFrame], list[DataFrame]]:
    THEMES[f.__name__] = f
    return f


def decoded(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A theme's events in dispatch order, decoded once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DECODED:
        packets = written(capture.packets(written(content(THEMES[name](base(spark, sf_dir))), "captures")), "packets")
        types = written(capture.event_types(packets), "event-types")
        _DECODED[key] = written(dashboard.dispatched(capture.raw_events(packets, types)), "trace-events"), types, packets
    return _DECODED[key][0]


def parts(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A theme's dispatched events, event types and packets."""
    decoded(spark, sf_dir, name)
    return _DECODED[spark.sparkContext.applicationId, sf_dir, name]


@theme
def annotations(e: DataFrame) -> list[DataFrame]:
    starts = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("started", F.last(F.when(F.col("event_type") == "signup", F.col("cycle")), ignorenulls=True).over(starts))
    e = e.withColumn("args", F.concat(F.lit("0244c1"), little32(F.array("k")), F.lower(F.hex("event_type")), F.lit("00")))
    e = e.withColumn("ops", varints(F.array(F.col("k") % 5 * 8 + F.col("event_id") % 4, F.lit(1), F.col("cents") * 2))).withColumn("ops", F.when(F.col("event_id") % 4 < 2, F.substring("ops", 1, 4)).otherwise(F.col("ops")))
    e = e.withColumn("waited", little64(F.sequence(F.lit(1).cast("long"), F.col("k") % 3 + 1)))
    return [
        declared(e, "Counters.Spec", 6, Id="i", Type="i % 2", Name="concat('counter', i)"),
        emitted(e, "Counters.SetValueInt", "event_type in ('click', 'view')", Cycle="cycle", Value="cents", CounterId="k % 4"),
        emitted(e, "Counters.SetValueFloat", "event_type = 'purchase'", Cycle="cycle", Value="value", CounterId="k % 4"),
        declared(e, "Stats.Spec", 4, Id="i", IsFloatingPoint="i % 2", IsMemory="i div 3", ShouldClearEveryFrame="1 - i % 2", Name="concat('stat', i)", Group="concat('group', i div 2)"),
        emitted(e, "Stats.EventBatch2", "true", 1, Data="ops"),
        declared(e, "CsvProfiler.RegisterCategory", 2, Index="i", Name="concat('category', i)"),
        declared(e, "CsvProfiler.DefineDeclaredStat", 3, StatId="i", CategoryIndex="i", Name="concat('csv', i)"),
        declared(e, "CsvProfiler.DefineInlineStat", 2, StatId="i + 3", CategoryIndex="0", Name="concat('csv', i + 3)"),
        emitted(e, "CsvProfiler.BeginStat", "event_type = 'view'", 2, StatId="k % 6", Cycle="cycle"),
        emitted(e, "CsvProfiler.EndStat", "event_type = 'click'", 2, StatId="k % 6", Cycle="cycle"),
        emitted(e, "CsvProfiler.CustomStatInt", "event_type = 'error'", 2, StatId="k % 6", Cycle="cycle", Value="cents", OpType="1"),
        emitted(e, "Misc.BeginFrame", "event_type = 'signup'", 3, Cycle="cycle", FrameType="user_id % 2"),
        emitted(e, "Misc.EndFrame", "event_type = 'click'", 3, Cycle="cycle", FrameType="user_id % 2"),
        declared(e, "Misc.BookmarkSpec", 5, BookmarkPoint="i", Line="10 * i", FormatString="concat('mark ', i)", FileName="'a.cpp'"),
        emitted(e, "Misc.Bookmark", "event_type = 'error'", 4, BookmarkPoint="k % 6", Cycle="cycle", CallstackId="k % 10"),
        emitted(e, "Misc.RegionBegin", "event_type = 'view'", 5, Cycle="cycle", RegionName="concat('régión ', k % 5)", Category="if(k % 3 = 0, '', concat('cat', k % 3))"),
        emitted(e, "Misc.RegionEnd", "event_type = 'purchase'", 5, Cycle="cycle", RegionName="concat('régión ', k % 5)"),
        emitted(e, "Misc.RegionBeginWithId", "event_type = 'signup'", 6, CycleAndId="cycle", RegionName="concat('id ', k % 4)", Category="'keyed'"),
        emitted(e, "Misc.RegionEndWithId", "event_type = 'click' and started is not null", 6, Cycle="cycle", RegionId="started"),
        declared(e, "Logging.LogCategory", 3, CategoryPointer="i + 1", DefaultVerbosity="5", Name="concat('Log', i)"),
        declared(e, "Logging.LogMessageSpec", 8, LogPoint="i + 100", CategoryPointer="i % 4 + 1", Line="i", Verbosity="i % 3 + 130", FormatString="concat('%d of %s at ', i)"),
        emitted(e, "Logging.LogMessage", "event_type = 'view'", 7, LogPoint="k % 9 + 100", Cycle="cycle", FormatArgs="args"),
        declared(e, "TaskTrace.Init", 1, Version="3"),
        emitted(e, "TaskTrace.Created", "event_type = 'signup'", 8, Timestamp="cycle", TaskId="event_id"),
        emitted(e, "TaskTrace.Launched", "event_type = 'click'", 8, Timestamp="cycle", TaskId="k", DebugName="if(k % 4 = 0, '', concat('task', event_id))"),
        emitted(e, "TaskTrace.Scheduled", "event_type = 'click'", 9, Timestamp="cycle", TaskId="k"),
        emitted(e, "TaskTrace.Started", "event_type = 'view'", 8, Timestamp="cycle", TaskId="k"),
        emitted(e, "TaskTrace.Finished", "event_type = 'purchase'", 8, Timestamp="cycle", TaskId="k"),
        emitted(e, "TaskTrace.WaitingStarted", "event_type = 'error'", 10, Timestamp="cycle", Tasks="waited"),
        emitted(e, "TaskTrace.WaitingFinished", "event_type = 'purchase'", 10, Timestamp="cycle"),
        emitted(e, "SlateTrace.AddWidget", "event_type = 'view'", 11, Cycle="cycle", WidgetId="k"),
        declared(e, "Trace.ChannelAnnounce", 6, Id="i", IsEnabled="i % 2", Name="concat('channel', i)"),
        emitted(e, "Trace.ChannelToggle", "event_type = 'error' and k < 50", 12, Id="k % 5", IsEnabled="k div 5 % 2"),
        emitted(e, "Cpu.Tick", "event_type = 'click'", 13, Value="k"),
        emitted(e, "Game.Score", "event_type = 'purchase'", 13, Points="cents", Player="concat('user ', user_id)"),
        emitted(e, "CpuProfiler.EndThread", "event_type = 'error' and k = 7", 14, Cycle="cycle"),
        emitted(e, "$Trace.ThreadTiming", "event_type = 'signup'", 14, BaseTimestamp="cycle"),
        declared(e, "$Trace.NewTrace", 1, StartCycle="0", CycleFrequency="1000000", Endian="21069", PointerSize="8"),
        declared(e, "$Trace.ThreadGroupBegin", 2, 1, Name="concat('group', i)"),
        declared(e, "$Trace.ThreadInfo", 30, 2, ThreadId="i + 2", SystemId="i + 100", SortHint="-i", Name="concat('thread', i)"),
        declared(e, "$Trace.ThreadGroupEnd", 5, 3, Unused="0"),
    ]


@theme
def resources(e: DataFrame) -> list[DataFrame]:
    e = e.withColumns({"frames": little64(F.sequence(F.col("k"), F.col("k") + F.col("event_id") % 4)), "image": F.sha1(F.col("k").cast("string").cast("binary"))})
    e = e.withColumns({"tags": little32(F.array(F.col("k") % 7, F.col("k") % 7 + 10)), "wide_tags": little64(F.array(F.col("k") % 7 - 3, F.col("k") % 7 + 10)), "values": little64(F.array("cents", -F.col("k")))})
    return [
        declared(e, "IoStore.BackendName", 2, BackendHandle="i", Name="concat('backend', i)"),
        emitted(e, "IoStore.RequestCreate", "event_type = 'view'", RequestHandle="k", Cycle="cycle", Size="cents", BatchHandle="1", Offset="0", ChunkIdHash="k", ChunkType="1"),
        emitted(e, "IoStore.RequestStarted", "event_type = 'click'", RequestHandle="k", Cycle="cycle", BackendHandle="k % 3"),
        emitted(e, "IoStore.RequestCompleted", "event_type = 'purchase'", RequestHandle="k", Cycle="cycle", Size="cents"),
        emitted(e, "IoStore.RequestFailed", "event_type = 'error'", RequestHandle="k", Cycle="cycle"),
        emitted(e, "LoadTime.ClassInfo", "event_type = 'purchase'", 1, Class="k % 20", Name="concat('Class', cents % 9)"),
        emitted(e, "LoadTime.PackageSummary", "event_type = 'error'", 1, AsyncPackage="k * 2", TotalHeaderSize="cents", ImportCount="k", ExportCount="k + 1", Priority="-1", Name="concat('/Game/P', k)"),
        emitted(e, "LoadTime.BeginRequest", "event_type = 'signup'", 1, Cycle="cycle", RequestId="k % 8"),
        emitted(e, "LoadTime.EndRequest", "event_type = 'click'", 1, Cycle="cycle", RequestId="k % 8"),
        emitted(e, "LoadTime.StartAsyncLoading", "event_type = 'view' and k % 3 = 0", 2, Cycle="cycle"),
        emitted(e, "LoadTime.SuspendAsyncLoading", "event_type = 'view' and k % 3 = 1", 2, Cycle="cycle"),
        emitted(e, "LoadTime.ResumeAsyncLoading", "event_type = 'view' and k % 3 = 2", 2, Cycle="cycle"),
        emitted(e, "PlatformFile.BeginOpen", "event_type = 'signup' and k % 2 = 0", 3, Cycle="cycle", Path="concat('/p', k % 10)"),
        emitted(e, "PlatformFile.EndOpen", "event_type = 'signup' and k % 4 <> 1", 4, Cycle="cycle + 5", FileHandle="if(k % 10 = 8, '18446744073709551615', string(user_id))"),
        emitted(e, "PlatformFile.BeginRead", "event_type = 'view'", 3, Cycle="cycle", ReadHandle="user_id", FileHandle="user_id", Offset="0", Size="cents"),
        emitted(e, "PlatformFile.EndRead", "event_type = 'click'", 3, Cycle="cycle", ReadHandle="user_id", SizeRead="k"),
        emitted(e, "PlatformFile.BeginClose", "event_type = 'error' and k % 2 = 0", 3, Cycle="cycle", FileHandle="user_id"),
        emitted(e, "PlatformFile.EndClose", "event_type = 'error' and k % 4 = 0", 4, Cycle="cycle"),
        emitted(e, "PlatformFile.BeginReOpen", "event_type = 'purchase' and k % 8 = 0", 3, Cycle="cycle", OldFileHandle="user_id"),
        emitted(e, "PlatformFile.EndReOpen", "event_type = 'purchase' and k % 8 = 0", 4, Cycle="cycle + 2", NewFileHandle="user_id + 1000000"),
        declared(e, "Memory.Init", 1, PageSize="4096", MarkerPeriod="1", Version="2", MinAlignment="8", SizeShift="3"),
        declared(e, "Memory.TagSpec", 5, Tag="i", Parent="i - 1", Display="concat('tag', i)"),
        emitted(e, "Memory.MemoryScope", "event_type = 'view'", 5, Tag="k % 6"),
        emitted(e, "Memory.Alloc", "event_type = 'purchase'", 5, Address="k * 16", CallstackId="k % 12", Size="cents div 8", AlignmentPow2_SizeLower="cents % 8 + 64", RootHeap="k % 3"),
        emitted(e, "Memory.ReallocAllocVideo", "event_type = 'signup'", 5, Address="k * 16", CallstackId="k % 12", Size="cents div 8", AlignmentPow2_SizeLower="cents % 8"),
        emitted(e, "Memory.Free", "event_type = 'error'", 5, Address="k * 16", RootHeap="2"),
        emitted(e, "Memory.ReallocFreeSystem", "event_type = 'click'", 5, Address="k * 16"),
        emitted(e, "Memory.CallstackSpec", "event_type = 'view' and k < 20", 6, CallstackId="k % 10", Frames="frames"),
        declared(e, "LLM.TagsSpec", 4, TagId="i", ParentId="i - 1", TagSetId="i % 2", Name="concat('llm', i)"),
        declared(e, "LLM.TrackerSpec", 2, TrackerId="i", Name="concat('tracker', i)"),
        declared(e, "LLM.TagSetSpec", 2, TagSetId="i", Name="concat('set', i)"),
        emitted(e, "LLM.TagValue", "event_type = 'error'", 7, TrackerId="k % 2", Cycle="cycle", Tags="tags", Values="values"),
        emitted(e, "LLM.TagValue", "event_type = 'signup'", 7, TrackerId="k % 2", Cycle="greatest(cycle - cents, 0)", Tags="wide_tags", Values="values"),
        declared(e, "Diagnostics.ModuleInit", 1, ModuleBaseShift="16", SymbolFormat="'pdb'"),
        emitted(e, "Diagnostics.ModuleLoad", "event_type = 'click'", 8, Base="k", Size="k % 9 * 4096", Name="concat('m', k, '.dll')", ImageId="image"),
        emitted(e, "Diagnostics.ModuleUnload", "event_type = 'error'", 8, Base="k"),
    ]


@theme
def gpu(e: DataFrame) -> list[DataFrame]:
    e = e.withColumns({"queue": F.expr("user_id % 3 + 256 * (user_id % 2) + 65536"), "crumb": F.when(F.col("k") < 24, F.lpad(F.hex("k"), 2, "0")).otherwise(F.concat(F.lit("18"), F.hex("k")))})
    return [
        declared(e, "GpuProfiler.QueueSpec", 3, QueueId="i + 65536", TypeString="if(i = 2, '', concat('Queue ', i))"),
        declared(e, "GpuProfiler.EventBreadcrumbSpec", 5, SpecId="i", StaticName="if(i = 4, 'Frame', concat('Pass', i))", NameFormat="if(i = 4, 'Frame %d', if(i = 3, 'Pass3', concat('Pass', i, ' %d')))", FieldNames="'6161'"),
        emitted(e, "GpuProfiler.EventFrameBoundary", "event_type = 'signup'", QueueId="queue", FrameNumber="k % 20"),
        emitted(e, "GpuProfiler.EventBeginWork", "event_type = 'view'", QueueId="queue", GPUTimestampTOP="cycle", CPUTimestamp="if(k % 9 = 0, 0, cycle - 500)"),
        emitted(e, "GpuProfiler.EventEndWork", "event_type = 'purchase'", QueueId="queue", GPUTimestampBOP="greatest(cycle - if(k % 4 = 0, 500000, 0), 1)"),
        emitted(e, "GpuProfiler.EventWait", "event_type = 'click' and k % 3 = 0", QueueId="queue", StartTime="cycle", EndTime="cycle + cents % 1000 - if(k % 5 = 0, 900, 0)"),
        emitted(e, "GpuProfiler.EventStats", "event_type = 'click' and k % 3 = 1", QueueId="queue", NumDraws="k", NumPrimitives="cents"),
        emitted(e, "GpuProfiler.SignalFence", "event_type = 'click' and k % 3 = 2", QueueId="queue", CPUTimestamp="cycle", Value="k"),
        emitted(e, "GpuProfiler.WaitFence", "event_type = 'click' and k % 3 = 2", 1, QueueId="queue", CPUTimestamp="cycle + 1", Value="k"),
        emitted(e, "GpuProfiler.EventBeginBreadcrumb", "event_type = 'error' and k % 2 = 0", SpecId="k % 6", QueueId="queue", GPUTimestampTOP="if(k % 10 = 0, 0, cycle)", Metadata="crumb"),
        emitted(e, "GpuProfiler.EventEndBreadcrumb", "event_type = 'error' and k % 2 = 1", QueueId="queue", GPUTimestampBOP="if(k % 7 = 0, 0, greatest(cycle - if(k % 9 = 0, 400000, 0), 1))"),
    ]


def _scopes(e: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """CPU scopes: views and signups open, purchases and clicks close; every second record gives its cycle as a difference."""
    in_thread = Window.partitionBy("user_id").orderBy("event_id")
    acts = e.where("event_type <> 'error'").withColumn("before", F.lag("cycle").over(in_thread))
    shown = F.when((F.col("event_id") % 2 == 1) & (F.col("cycle") - F.col("before") < F.col("before")), F.col("cycle") - F.col("before")).otherwise(F.col("cycle"))
    opens = F.col("event_type").isin("view", "signup")
    payload = F.when(F.col("event_type") == "signup", F.col("event_id") * 2 + 1).otherwise((F.col("k") % 5 + 1) * 2)
    acts = acts.withColumn("data", varints(F.when(opens, F.array(shown * 4 + 1, payload)).otherwise(F.array(shown * 4))))
    acts = acts.withColumn("cbor", F.concat(F.when(F.col("k") < 24, F.lpad(F.hex("k"), 2, "0")).otherwise(F.concat(F.lit("18"), F.hex("k"))), F.lit("63616263")))
    return acts, [
        declared(e, "$Trace.NewTrace", 1, StartCycle="0", CycleFrequency="1000000", Endian="21069", PointerSize="8"),
        declared(e, "$Trace.ThreadInfo", 30, 2, ThreadId="i + 2", SystemId="i + 100", SortHint="-i", Name="concat('thread', i)"),
        declared(e, "CpuProfiler.EventSpec", 4, Id="i + 1", Line="i", Name="concat('Scope', i + 1)", File="'a.cpp'"),
        declared(e, "CpuProfiler.MetadataSpec", 2, Id="i", Name="if(i = 0, 'Frame', 'Asset')", NameFormat="if(i = 0, 'Frame %d', 'Asset %d of %s')", FieldNames="if(i = 0, '666e756d626572', '626964646e616d65')"),
        # Of four introductions one comes after its scope begins, so that nothing is known of it then.
        emitted(acts, "CpuProfiler.Metadata", "event_type = 'signup' and k % 4 <> 3", 0, Id="event_id", SpecId="k % 3", Metadata="cbor"),
        emitted(acts, "CpuProfiler.EventBatchV3", "true", 1, Data="data"),
        emitted(acts, "CpuProfiler.Metadata", "event_type = 'signup' and k % 4 = 3", 2, Id="event_id", SpecId="k % 3", Metadata="cbor"),
    ]


@theme
def scopes(e: DataFrame) -> list[DataFrame]:
    return _scopes(e)[1]


@theme
def stacks(e: DataFrame) -> list[DataFrame]:
    return [
        *_scopes(e)[1],
        emitted(e, "MetadataStack.SaveStack", "event_type = 'error' and k % 4 = 0", Id="k % 8"),
        emitted(e, "MetadataStack.RestoreStack", "event_type = 'error' and k % 4 = 1", Id="k % 12"),
        emitted(e, "MetadataStack.ClearScope", "event_type = 'error' and k % 4 = 2", Unused="0"),
    ]


# SQL over the same events.

C_SQL = f"""c AS (SELECT *, 'c' || (user_id // {USERS}) AS trace_id, CAST(user_id % {USERS} + 2 AS INTEGER) AS thread_id, event_id * 1000 + 1000 AS cycle FROM
    (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents, value FROM events)), tr AS (SELECT DISTINCT trace_id FROM c)"""


def stack_sql(name: str, keys: str, carry: str = "") -> str:
    """CTEs over ``name`` (keys, seq, cycle, kind b or e): ``{name}_p`` has each row's partner by the stack rule."""
    more = "".join(f", lead({c}) OVER w AS end_{c}" for c in carry.split())
    return f"""{name}_w AS (SELECT *, sum(CASE WHEN kind = 'b' THEN 1 ELSE -1 END) OVER (PARTITION BY {keys} ORDER BY seq) AS s FROM {name}),
    {name}_f AS (SELECT *, least(0, min(s) OVER (PARTITION BY {keys} ORDER BY seq)) AS f FROM {name}_w),
    {name}_d AS (SELECT *, kind = 'e' AND f < coalesce(lag(f) OVER (PARTITION BY {keys} ORDER BY seq), 0) AS lost, CASE WHEN kind = 'b' THEN s - f ELSE s - f + 1 END AS depth FROM {name}_f),
    {name}_l AS (SELECT *, lead(kind) OVER w = 'e' AND kind = 'b' AS closes, lead(seq) OVER w AS nseq, lead(cycle) OVER w AS ncycle{more} FROM {name}_d WINDOW w AS (PARTITION BY {keys}, depth, lost ORDER BY seq)),
    {name}_p AS (SELECT * EXCLUDE (nseq, ncycle), coalesce(closes, false) AS matched, CASE WHEN closes THEN nseq END AS end_seq, CASE WHEN closes THEN ncycle END AS end_cycle FROM {name}_l)"""


def map_sql(name: str, keys: str) -> str:
    """CTE ``{name}_p`` by the overwriting rule: outcome and, of matched begins, the end."""
    return f"""{name}_p AS (SELECT *, CASE WHEN kind = 'e' THEN CASE WHEN lag(kind) OVER w = 'b' THEN 'matched' ELSE 'unmatched' END WHEN lead(kind) OVER w = 'e' THEN 'matched' WHEN lead(kind) OVER w = 'b' THEN 'overwritten' ELSE 'open' END AS outcome,
        CASE WHEN kind = 'b' AND lead(kind) OVER w = 'e' THEN lead(cycle) OVER w END AS end_cycle FROM {name} WINDOW w AS (PARTITION BY {keys} ORDER BY seq))"""


def family(name: str, of: str, sql: str, columns: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register ``capture_<name>``: a family of a theme, as the columns that its SQL returns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = dashboard.FAMILIES[name](decoded(spark, sf_dir, of))
        return (change(found) if change else found).select(*columns.split())

    query(f"capture_{name}", f"WITH {C_SQL} {sql}")(run)


# Transport, registry and order.


@query("capture_packets", f"""WITH {C_SQL} SELECT trace_id, thread_id, CAST(sum(CASE WHEN event_type = 'view' THEN 21 WHEN event_type = 'purchase' THEN 21 ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (event_type IN ('view', 'purchase')) AS events FROM c GROUP BY 1, 2 HAVING count(*) FILTER (event_type IN ('view', 'purchase')) > 0""")
def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each thread's stream, which its packets hold in pieces, and the events in it."""
    e = base(spark, sf_dir)
    rows = [emitted(e, "CsvProfiler.BeginStat", "event_type = 'view'", StatId="k", Cycle="cycle"), emitted(e, "CsvProfiler.EndStat", "event_type = 'purchase'", StatId="k", Cycle="cycle")]
    packets = written(capture.packets(content(rows)), "packets")
    counts = capture.raw_events(packets, capture.event_types(packets)).where("uid >= 16").groupBy("trace_id", "thread_id").agg(F.count("*").alias("events"))
    return capture.packet_totals(packets).select("trace_id", "thread_id", F.col("decoded_bytes").alias("bytes")).join(counts, ["trace_id", "thread_id"])


@query("capture_registry", f"""WITH {C_SQL}, t(uid, logger, event, n_fields, data_size) AS (VALUES (16, 'GpuProfiler', 'QueueSpec', 2, 4), (17, 'GpuProfiler', 'EventFrameBoundary', 2, 8), (18, 'GpuProfiler', 'EventBreadcrumbSpec', 4, 4), (19, 'GpuProfiler', 'EventBeginBreadcrumb', 4, 16),
    (20, 'GpuProfiler', 'EventEndBreadcrumb', 2, 12), (21, 'GpuProfiler', 'EventBeginWork', 3, 20), (22, 'GpuProfiler', 'EventEndWork', 2, 12), (23, 'GpuProfiler', 'EventWait', 3, 20), (24, 'GpuProfiler', 'EventStats', 3, 12), (25, 'GpuProfiler', 'SignalFence', 3, 20), (26, 'GpuProfiler', 'WaitFence', 3, 20))
    SELECT trace_id, uid, logger, event, n_fields, data_size FROM tr, t""")
def capture_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array_max(F.transform("fields", lambda f: f["offset"] + f["size"] * (~f["type_name"].isin("ansi_string", "wide_string", "array")).cast("int")))
    return parts(spark, sf_dir, "gpu")[1].select("trace_id", "uid", "logger", "event", F.size("fields").alias("n_fields"), sizes.alias("data_size"))


INVENTORY_SQL = """i AS (SELECT trace_id, 'GpuProfiler' AS logger, CASE event_type WHEN 'signup' THEN 'EventFrameBoundary' WHEN 'view' THEN 'EventBeginWork' WHEN 'purchase' THEN 'EventEndWork' WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'EventBeginBreadcrumb' ELSE 'EventEndBreadcrumb' END
        ELSE CASE k % 3 WHEN 0 THEN 'EventWait' WHEN 1 THEN 'EventStats' ELSE 'SignalFence' END END AS event FROM c
    UNION ALL SELECT trace_id, 'GpuProfiler', 'WaitFence' FROM c WHERE event_type = 'click' AND k % 3 = 2
    UNION ALL SELECT trace_id, 'GpuProfiler', 'QueueSpec' FROM tr, range(3) UNION ALL SELECT trace_id, 'GpuProfiler', 'EventBreadcrumbSpec' FROM tr, range(5))"""


@query("capture_inventory", f"WITH {C_SQL}, {INVENTORY_SQL} SELECT trace_id, logger, event, count(*) AS count FROM i GROUP BY 1, 2, 3")
def capture_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.inventory(decoded(spark, sf_dir, "gpu").where("logger is not null")).select("trace_id", "logger", "event", "count")


@query("capture_dispatch", f"WITH {C_SQL} SELECT trace_id, event_id, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) - 1 AS seq FROM c")
def capture_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each event among its capture's, from the serials alone; threads of several captures share their ids."""
    rows = emitted(base(spark, sf_dir), "TaskTrace.Created", "true", Timestamp="cycle", TaskId="event_id")
    packets = written(capture.packets(content([rows])), "packets")
    found = dashboard.dispatched(capture.raw_events(packets, capture.event_types(packets)).where("event = 'Created'"))
    return found.select("trace_id", F.get_json_object("fields", "$.TaskId").cast("long").alias("event_id"), "seq")


@query("capture_gap_samples", f"""WITH {C_SQL}, r AS (SELECT trace_id, event_type, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) AS n FROM c), p AS (SELECT trace_id, n, lag(n) OVER (PARTITION BY trace_id ORDER BY n) AS b FROM r WHERE event_type <> 'error'),
    g AS (SELECT trace_id, (b + 1 + 16777000) % 16777216 AS after_serial, n - b - 1 AS missing, row_number() OVER (PARTITION BY trace_id ORDER BY n) AS rank, count(*) OVER (PARTITION BY trace_id) AS total FROM p WHERE n - b > 1) SELECT *, total > 64 AS truncated FROM g WHERE rank <= 64""")
def capture_gap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps where the events of one type are lost after they had taken their serials."""
    rows = emitted(base(spark, sf_dir), "TaskTrace.Created", "true", Timestamp="if(event_type = 'error', 0, cycle)", TaskId="event_id")
    packets = written(capture.packets(content([rows])), "packets")
    found = capture.raw_events(packets, capture.event_types(packets))
    return dashboard.gap_samples(found.where("event = 'Created' and get_json_object(fields, '$.Timestamp') <> '0'"))


@query("capture_prologue", f"WITH {C_SQL} SELECT trace_id, 0 AS start_cycle, 1000000 AS frequency, 21069 AS endian, 8 AS pointer_size FROM tr")
def capture_prologue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.prologue(decoded(spark, sf_dir, "scopes"))


@query("capture_coverage", f"""WITH {C_SQL}, {INVENTORY_SQL}, n AS (SELECT trace_id, event, count(*) AS n FROM i GROUP BY 1, 2) SELECT trace_id, count(*) AS declared_types, 0 AS decoded_types, count(*) AS partial_types, 0 AS raw_types, CAST(sum(n) AS BIGINT) AS observed_events, 0 AS raw_events FROM n GROUP BY 1""")
def capture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, types, _ = parts(spark, sf_dir, "gpu")
    return dashboard.coverage_summary(dashboard.coverage_events(found.where("logger is not null"), types))


@query("capture_coverage_status", f"""WITH {C_SQL}, x AS (SELECT trace_id, 'Cpu.Tick' AS name, count(*) FILTER (event_type = 'click') AS observed FROM c GROUP BY 1 UNION ALL SELECT trace_id, 'Game.Score', count(*) FILTER (event_type = 'purchase') FROM c GROUP BY 1
    UNION ALL SELECT trace_id, 'Misc.BeginFrame', count(*) FILTER (event_type = 'signup') FROM c GROUP BY 1 UNION ALL SELECT trace_id, 'SlateTrace.AddWidget', count(*) FILTER (event_type = 'view') FROM c GROUP BY 1)
    SELECT trace_id, name, observed, CASE name WHEN 'Misc.BeginFrame' THEN 'decoded' WHEN 'Game.Score' THEN 'raw' ELSE 'partial' END AS status FROM x""")
def capture_coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, types, _ = parts(spark, sf_dir, "annotations")
    rows = dashboard.coverage_events(found, types).withColumn("name", F.concat_ws(".", "logger", "event"))
    return rows.where(F.col("name").isin("Cpu.Tick", "Game.Score", "Misc.BeginFrame", "SlateTrace.AddWidget")).select("trace_id", "name", "observed", "status")


@query("capture_decoders_not_observed", f"WITH {C_SQL} SELECT trace_id, event FROM tr, (VALUES ('Init')) v(event)")
def capture_decoders_not_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.decoders_not_observed(spark, parts(spark, sf_dir, "gpu")[1]).where("logger = 'GpuProfiler'").select("trace_id", "event")


# Annotations.

family("counters", "annotations", """, v AS (SELECT trace_id, k % 4 AS id, event_id AS seq, cycle, CASE WHEN event_type = 'purchase' THEN value ELSE CAST(cents AS DOUBLE) END AS v, event_type <> 'purchase' AS is_int FROM c WHERE event_type IN ('click', 'view', 'purchase'))
    SELECT trace_id, id, 'counter' || id AS name, CASE id % 2 WHEN 0 THEN 'int' ELSE 'float' END AS kind, count(seq) AS samples, count(*) FILTER (is_int) AS int_samples, arg_min(cycle, seq) AS first_cycle, arg_max(cycle, seq) AS last_cycle, min(v) AS min_value, max(v) AS max_value, arg_max(v, seq) AS latest_value
    FROM (SELECT trace_id, i AS id FROM tr, range(6) r(i)) s LEFT JOIN v USING (trace_id, id) GROUP BY 1, 2, 3, 4""", "trace_id id name kind samples int_samples first_cycle last_cycle min_value max_value latest_value")  # fmt: skip
family("stat_groups", "annotations", "SELECT trace_id, 'group' || (i // 2) AS stat_group, count(*) AS specs, count(*) FILTER (i % 2 = 1) AS float_specs, count(*) FILTER (i // 3 = 1) AS memory_specs, count(*) FILTER (i % 2 = 0) AS clearing_specs FROM tr, range(4) r(i) GROUP BY 1, 2", "trace_id stat_group specs float_specs memory_specs clearing_specs")
family("stats", "annotations", """, o AS (SELECT trace_id, event_id AS seq, k % 5 AS id, event_id % 4 AS op, cents FROM c), g AS (SELECT *, sum(CASE WHEN op = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, id ORDER BY seq) AS part FROM o),
    v AS (SELECT *, sum(CASE op WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE cents END) OVER (PARTITION BY trace_id, id, part ORDER BY seq) AS v FROM g)
    SELECT trace_id, id, count(*) AS samples, CAST(min(v) AS DOUBLE) AS min_value, CAST(max(v) AS DOUBLE) AS max_value, CAST(arg_max(v, seq) AS DOUBLE) AS latest_value, CASE WHEN id < 4 THEN 'stat' || id END AS name, CASE WHEN id < 4 THEN 'group' || (id // 2) END AS stat_group FROM v GROUP BY 1, 2""", "trace_id id samples min_value max_value latest_value name stat_group")  # fmt: skip
family("csv_categories", "annotations", "SELECT trace_id, i AS category_index, 'category' || i AS category, CASE i WHEN 0 THEN 3 ELSE 1 END AS stats, 1 AS declared_stats, CASE i WHEN 0 THEN 2 ELSE 0 END AS inline_stats FROM tr, range(2) r(i)", "trace_id category_index category stats declared_stats inline_stats")
family("csv_stats", "annotations", "SELECT trace_id, CAST(i AS VARCHAR) AS stat, 'csv' || i AS name, i < 3 AS declared, CASE WHEN i <> 2 THEN 'category' || CASE i WHEN 1 THEN 1 ELSE 0 END END AS category FROM tr, range(5) r(i)", "trace_id stat name declared category")
family("csv", "annotations", f""", x AS (SELECT trace_id, thread_id, k % 6 AS stat, event_id AS seq, cycle, CASE event_type WHEN 'view' THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type IN ('view', 'click')), {stack_sql("x", "trace_id, thread_id, stat")},
    t AS (SELECT trace_id, stat, count(*) FILTER (kind = 'b') AS begins, count(*) FILTER (kind = 'e') AS ends, count(*) FILTER (lost) AS unmatched_ends, count(*) FILTER (kind = 'b' AND NOT matched) AS open_begins, CAST(sum(end_cycle - cycle) AS BIGINT) AS total_duration FROM x_p GROUP BY 1, 2),
    u AS (SELECT trace_id, k % 6 AS stat, count(*) AS int_values FROM c WHERE event_type = 'error' GROUP BY 1, 2)
    SELECT trace_id, CAST(stat AS VARCHAR) AS stat, begins, ends, unmatched_ends, open_begins, total_duration, coalesce(int_values, 0) AS int_values, CASE WHEN stat = 5 THEN begins + coalesce(int_values, 0) ELSE 0 END AS unresolved FROM t LEFT JOIN u USING (trace_id, stat)""", "trace_id stat begins ends unmatched_ends open_begins total_duration int_values unresolved")  # fmt: skip
family("frames", "annotations", """, r AS (SELECT trace_id, user_id % 2 AS frame_type, event_id, cycle, event_type = 'signup' AS b FROM c WHERE event_type IN ('signup', 'click')),
    n AS (SELECT *, sum(b::int) OVER (PARTITION BY trace_id, frame_type ORDER BY event_id) AS slot FROM r), o AS (SELECT *, max(CASE WHEN b THEN cycle END) OVER (PARTITION BY trace_id, frame_type, slot) AS bc FROM n WHERE slot > 0),
    g AS (SELECT trace_id, frame_type, slot, max(bc) AS begin_cycle, arg_max(cycle, event_id) FILTER (NOT b AND cycle >= bc) AS end_cycle, min(event_id) FILTER (NOT b AND cycle >= bc) AS first, count(*) FILTER (NOT b AND cycle >= bc) AS revisions FROM o GROUP BY 1, 2, 3),
    f AS (SELECT *, row_number() OVER (PARTITION BY trace_id, frame_type ORDER BY first) - 1 AS frame_number, count(*) OVER (PARTITION BY trace_id, frame_type) AS total FROM g WHERE revisions > 0)
    SELECT trace_id, frame_type, frame_number, begin_cycle, end_cycle, end_cycle - begin_cycle AS duration, revisions, total, CASE frame_type WHEN 0 THEN 'game' ELSE 'rendering' END AS frame_kind FROM f WHERE frame_number < 120""", "trace_id frame_type frame_number begin_cycle end_cycle duration revisions total frame_kind")  # fmt: skip
REGION_SQL = f""", n AS (SELECT trace_id, 'régión ' || (k % 5) AS name, CASE WHEN event_type = 'view' AND k % 3 > 0 THEN 'cat' || (k % 3) END AS category, event_id AS seq, cycle, CASE event_type WHEN 'view' THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type IN ('view', 'purchase')), {stack_sql("n", "trace_id, name")},
    s0 AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN cycle END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM c),
    d AS (SELECT trace_id, id, 'id ' || (k % 4) AS name, 'keyed' AS category, event_id AS seq, cycle, CASE event_type WHEN 'signup' THEN 'b' ELSE 'e' END AS kind FROM s0 WHERE event_type IN ('signup', 'click') AND id IS NOT NULL), {map_sql("d", "trace_id, id")}"""
family("regions", "annotations", f"""{REGION_SQL}, a AS (SELECT trace_id, name, category, end_cycle - cycle AS duration FROM n_p WHERE matched UNION ALL SELECT trace_id, name, category, end_cycle - cycle FROM d_p WHERE kind = 'b' AND outcome = 'matched')
    SELECT trace_id, name, category, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM a GROUP BY 1, 2, 3""", "trace_id name category count total_cycles")  # fmt: skip
family("region_totals", "annotations", f"""{REGION_SQL}, a AS (SELECT trace_id, kind, CASE WHEN kind = 'b' THEN matched ELSE NOT lost END AS done, kind = 'b' AND NOT matched AS open, false AS w FROM n_p UNION ALL SELECT trace_id, kind, outcome = 'matched', kind = 'b' AND outcome = 'open', true FROM d_p)
    SELECT trace_id, count(*) FILTER (kind = 'b') AS begins, count(*) FILTER (kind = 'e') AS ends, count(*) FILTER (kind = 'b' AND done) AS completed, count(*) FILTER (kind = 'e' AND NOT done) AS unmatched_ends, count(*) FILTER (open) AS unterminated, count(*) FILTER (kind = 'b' AND w) AS begins_with_id, count(*) FILTER (kind = 'e' AND w) AS ends_with_id FROM a GROUP BY 1""",
    "trace_id begins ends completed unmatched_ends unterminated begins_with_id ends_with_id")
family("bookmarks", "annotations", """, b AS (SELECT *, k % 6 AS point, k % 10 AS stack FROM c WHERE event_type = 'error'), n AS (SELECT *, sum((stack <> 0)::int) OVER (PARTITION BY trace_id, point ORDER BY event_id) AS place FROM b),
    t AS (SELECT trace_id, point, count(*) AS count, arg_min(cycle, event_id) AS first_cycle, arg_max(cycle, event_id) AS last_cycle, count(*) FILTER (stack <> 0) AS callstack_count, string_agg(CAST(stack AS VARCHAR), ',' ORDER BY event_id) FILTER (stack <> 0 AND place <= 8) AS callstacks FROM n GROUP BY 1, 2)
    SELECT trace_id, CAST(point AS VARCHAR) AS point, CASE WHEN point < 5 THEN 'mark ' || point END AS format, CASE WHEN point < 5 THEN 10 * point END AS line, count, first_cycle, last_cycle, callstack_count, coalesce(callstacks, '') AS callstacks, point < 5 AS resolved FROM t""",
    "trace_id point format line count first_cycle last_cycle callstack_count callstacks resolved", lambda df: df.withColumn("callstacks", F.concat_ws(",", "callstacks")))
LOG_SQL = """, h AS (SELECT trace_id, k % 9 + 100 AS point, count(*) AS count, CAST(sum(8 + length(event_type)) AS BIGINT) AS args_bytes, arg_min(k, event_id) AS k1, arg_min(cycle, event_id) AS first_cycle, arg_max(cycle, event_id) AS last_cycle FROM c WHERE event_type = 'view' GROUP BY 1, 2),
    sp AS (SELECT trace_id, i + 100 AS point, i, i % 4 + 1 AS category_id, CASE i % 3 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' ELSE 'Display' END AS verbosity FROM tr, range(8) r(i)), m AS (SELECT sp.*, coalesce(count, 0) AS count, coalesce(args_bytes, 0) AS args_bytes, k1, first_cycle, last_cycle FROM sp LEFT JOIN h USING (trace_id, point))"""
family("logs", "annotations", f"""{LOG_SQL} SELECT trace_id, CAST(point AS VARCHAR) AS point, CASE WHEN category_id < 4 THEN 'Log' || (category_id - 1) END AS category, verbosity, i AS line, count, args_bytes, CASE WHEN count > 0 THEN k1 || ' of view at ' || i END AS sample, first_cycle, last_cycle FROM m""", "trace_id point category verbosity line count args_bytes sample first_cycle last_cycle")
family("log_verbosities", "annotations", f"{LOG_SQL} SELECT trace_id, verbosity, count(*) AS message_specs, CAST(sum(count) AS BIGINT) AS messages FROM m GROUP BY 1, 2", "trace_id verbosity message_specs messages")
family("log_categories", "annotations", f"{LOG_SQL} SELECT trace_id, 'Log' || (category_id - 1) AS category, 'Log' AS default_verbosity, count(*) AS message_specs, CAST(sum(count) AS BIGINT) AS messages FROM m WHERE category_id < 4 GROUP BY 1, 2", "trace_id category default_verbosity message_specs messages")
family("log_totals", "annotations", f"""{LOG_SQL}, a AS (SELECT trace_id, CAST(sum(count) AS BIGINT) AS messages, CAST(sum(args_bytes) AS BIGINT) AS args_bytes, CAST(coalesce(sum(count) FILTER (point = 108), 0) AS BIGINT) AS unresolved_messages FROM h GROUP BY 1)
    SELECT trace_id, 8 AS message_specs, 2 AS specs_without_category, messages, args_bytes, unresolved_messages FROM a""", "trace_id message_specs specs_without_category messages args_bytes unresolved_messages")
family("tasks", "annotations", """SELECT trace_id, 3 AS version, count(*) FILTER (event_type = 'signup') AS created, count(*) FILTER (event_type = 'click') AS launched, count(*) FILTER (event_type = 'click') AS scheduled, 0 AS subsequent_added, count(*) FILTER (event_type = 'view') AS started, count(*) FILTER (event_type = 'purchase') AS finished, 0 AS completed, 0 AS destroyed FROM c GROUP BY 1""",
    "trace_id version created launched scheduled subsequent_added started finished completed destroyed")
family("task_names", "annotations", """, n AS (SELECT trace_id, k, min(event_id) AS first FROM c WHERE event_type = 'click' AND k % 4 <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY first) AS place FROM n) SELECT trace_id, CAST(k AS VARCHAR) AS task, 'task' || first AS name FROM r WHERE place <= 64""", "trace_id task name")
WAIT_SQL = f""", x AS (SELECT trace_id, thread_id, event_id AS seq, cycle, k % 3 + 1 AS task_count, CASE event_type WHEN 'error' THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type IN ('error', 'purchase')), {stack_sql("x", "trace_id, thread_id")}"""
family("task_waits", "annotations", f"""{WAIT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY end_seq) AS place, count(*) OVER (PARTITION BY trace_id) AS total FROM x_p WHERE matched)
    SELECT trace_id, thread_id, cycle, end_cycle, end_cycle - cycle AS duration, task_count, total, total > 40 AS truncated FROM r WHERE place <= 40""", "trace_id thread_id cycle end_cycle duration task_count total truncated")
family("task_wait_totals", "annotations", f"{WAIT_SQL} SELECT trace_id, count(*) FILTER (kind = 'b') AS wait_started, count(*) FILTER (kind = 'e') AS wait_finished, count(*) FILTER (lost) AS unmatched_wait_ends, count(*) FILTER (kind = 'b' AND NOT matched) AS open_waits, least(count(*) FILTER (matched), 40) AS wait_count FROM x_p GROUP BY 1", "trace_id wait_started wait_finished unmatched_wait_ends open_waits wait_count")
family("slate", "annotations", "SELECT trace_id, count(*) AS widgets, min(cycle) AS first_cycle, max(cycle) AS last_cycle FROM c WHERE event_type = 'view' GROUP BY 1", "trace_id widgets first_cycle last_cycle")
family("channels", "annotations", """, t AS (SELECT trace_id, k % 5 AS id, count(*) AS toggles, arg_max(k // 5 % 2, event_id) AS state FROM c WHERE event_type = 'error' AND k < 50 GROUP BY 1, 2) SELECT trace_id, i AS id, 'channel' || i AS name, coalesce(toggles, 0) AS toggles, coalesce(state, i % 2) = 1 AS enabled FROM (SELECT trace_id, i FROM tr, range(6) r(i)) s LEFT JOIN t ON s.trace_id = t.trace_id AND t.id = i""".replace("SELECT trace_id, i AS id", "SELECT s.trace_id, i AS id"), "trace_id id name toggles enabled")
family("named_events", "annotations", "SELECT trace_id, 'Tick' AS event, count(*) AS count, arg_min(k, event_id) AS first_value FROM c WHERE event_type = 'click' GROUP BY 1", "trace_id event count first_value", lambda df: df.withColumn("first_value", F.get_json_object("first_sample", "$.Value").cast("long")))
family("unmodeled", "annotations", "SELECT trace_id, 'Game' AS logger, 'Score' AS event, count(*) AS count, 1 AS event_types, count(*) AS observed_events, arg_min('user ' || user_id, event_id) AS first_player FROM c WHERE event_type = 'purchase' GROUP BY 1", "trace_id logger event count event_types observed_events first_player", lambda df: df.withColumn("first_player", F.get_json_object("first_sample", "$.Player")))
family("end_threads", "annotations", "SELECT trace_id, thread_id, cycle FROM c WHERE event_type = 'error' AND k = 7", "trace_id thread_id cycle")
family("thread_timing", "annotations", "SELECT trace_id, thread_id, arg_max(cycle, event_id) AS base_timestamp FROM c WHERE event_type = 'signup' GROUP BY 1, 2", "trace_id thread_id base_timestamp")
# Important events keep the order in which they were declared: begin 0, thread 0, end, begin 1, thread 1, end, and so on.
family("threads", "annotations", "SELECT trace_id, i + 2 AS thread, 'thread' || i AS name, -i AS sort_hint, i + 100 AS system_id, CASE WHEN i < 2 THEN 'group' || i ELSE '' END AS groups, CASE WHEN i < 2 THEN 'group' || i END AS active_group FROM tr, range(30) r(i)", "trace_id thread name sort_hint system_id groups active_group", lambda df: df.withColumn("groups", F.concat_ws("/", "groups")))
family("thread_groups", "annotations", "SELECT trace_id, 'group' || i AS name, 1 AS begins, 1 AS ends, true AS balanced FROM tr, range(2) r(i)", "trace_id name begins ends balanced")
family("thread_group_totals", "annotations", "SELECT trace_id, 2 AS begins, 5 AS ends, 3 AS unmatched_ends, 0 AS unclosed FROM tr", "trace_id begins ends unmatched_ends unclosed")

# Resources.

family("io_totals", "resources", """SELECT trace_id, count(*) FILTER (event_type = 'view') AS created, count(*) FILTER (event_type = 'click') AS started, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, 0 AS unresolved, CAST(coalesce(sum(cents) FILTER (event_type = 'view'), 0) AS BIGINT) AS bytes_requested, CAST(coalesce(sum(cents) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS bytes_completed FROM c GROUP BY 1""",
    "trace_id created started completed failed unresolved bytes_requested bytes_completed")
family("io_backends", "resources", "SELECT trace_id, CAST(k % 3 AS VARCHAR) AS backend, CASE WHEN k % 3 < 2 THEN 'backend' || (k % 3) END AS name, count(*) AS starts FROM c WHERE event_type = 'click' GROUP BY 1, 2, 3", "trace_id backend name starts")
family("io_requests", "resources", """, x AS (SELECT *, sum((event_type = 'view')::int) OVER (PARTITION BY trace_id, k ORDER BY event_id) AS n FROM c WHERE event_type <> 'signup'), y AS (SELECT *, max(n) OVER (PARTITION BY trace_id, k) AS last FROM x)
    SELECT trace_id, CAST(k AS VARCHAR) AS request, max(cycle) FILTER (event_type = 'view') AS create_cycle, arg_max(cents, event_id) FILTER (event_type = 'view') AS size, max(cycle) FILTER (event_type = 'click') AS start_cycle, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN CAST(k % 3 AS VARCHAR) END AS backend, max(cycle) FILTER (event_type = 'purchase') AS complete_cycle,
    arg_max(cents, event_id) FILTER (event_type = 'purchase') AS completed_size, CASE arg_max(event_type, event_id) WHEN 'view' THEN 'created' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM y WHERE n > 0 AND n = last GROUP BY trace_id, k""", "trace_id request create_cycle size start_cycle backend complete_cycle completed_size status")  # fmt: skip
family("load_totals", "resources", f""", x AS (SELECT trace_id, k % 8 AS r, event_id AS seq, cycle, CASE event_type WHEN 'signup' THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type IN ('signup', 'click')), {map_sql("x", "trace_id, r")},
    q AS (SELECT trace_id, count(*) FILTER (kind = 'b') AS begun, count(*) FILTER (kind = 'e') AS ended, count(*) FILTER (kind = 'b' AND outcome = 'matched') AS completed, count(*) FILTER (kind = 'e' AND outcome = 'unmatched') AS unmatched_ends, count(*) FILTER (outcome = 'open') AS open_requests, CAST(coalesce(sum(end_cycle - cycle), 0) AS BIGINT) AS total_cycles FROM x_p GROUP BY 1),
    l AS (SELECT trace_id, count(*) FILTER (k % 3 = 0) AS starts, count(*) FILTER (k % 3 = 1) AS suspends, count(*) FILTER (k % 3 = 2) AS resumes, min(cycle) AS first_cycle, max(cycle) AS last_cycle FROM c WHERE event_type = 'view' GROUP BY 1)
    SELECT * FROM q FULL JOIN l USING (trace_id)""", "trace_id begun ended completed unmatched_ends open_requests total_cycles starts suspends resumes first_cycle last_cycle")  # fmt: skip
family("load_classes", "resources", "SELECT trace_id, CAST(k % 20 AS VARCHAR) AS class, 'Class' || arg_max(cents % 9, event_id) AS name FROM c WHERE event_type = 'purchase' GROUP BY 1, 2", "trace_id class name")
family("load_packages", "resources", """, x AS (SELECT trace_id, k, arg_max(cents, event_id) AS cents FROM c WHERE event_type = 'error' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY '/Game/P' || k) AS place, count(*) OVER (PARTITION BY trace_id) AS total FROM x)
    SELECT trace_id, CAST(k * 2 AS VARCHAR) AS package, '/Game/P' || k AS name, cents AS header_bytes, k AS imports, k + 1 AS exports, -1 AS priority, total FROM r WHERE place <= 80""", "trace_id package name header_bytes imports exports priority total")
# In this theme a reopen's end follows its begin at once and gives a handle that nothing else uses, so a handle's path is its latest open's until it is closed.
FILE_SQL = """, o AS (SELECT *, event_type = 'signup' AND k % 2 = 0 AS bo, event_type = 'signup' AND k % 4 <> 1 AS eo, event_type = 'error' AND k % 2 = 0 AS bc, event_type = 'error' AND k % 4 = 0 AS ec FROM c),
    ev AS (SELECT trace_id, thread_id, user_id, event_id * 2 AS seq, 'bo' AS w, '/p' || (k % 10) AS path, cents, k FROM o WHERE bo UNION ALL SELECT trace_id, thread_id, user_id, event_id * 2 + 1, 'eo', NULL, cents, k FROM o WHERE eo UNION ALL SELECT trace_id, thread_id, user_id, event_id * 2, 'bc', NULL, cents, k FROM o WHERE bc
        UNION ALL SELECT trace_id, thread_id, user_id, event_id * 2 + 1, 'ec', NULL, cents, k FROM o WHERE ec UNION ALL SELECT trace_id, thread_id, user_id, event_id * 2, 'br', NULL, cents, k FROM o WHERE event_type = 'view' UNION ALL SELECT trace_id, thread_id, user_id, event_id * 2, 'er', NULL, cents, k FROM o WHERE event_type = 'click'
        UNION ALL SELECT trace_id, thread_id, user_id, event_id * 2, 'bp', NULL, cents, k FROM o WHERE event_type = 'purchase' AND k % 8 = 0),
    pr AS (SELECT *, lag(w) OVER (PARTITION BY user_id, right(w, 1) ORDER BY seq) AS pw, lag(seq) OVER (PARTITION BY user_id, right(w, 1) ORDER BY seq) AS pseq, last_value(path IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS opened FROM ev),
    st AS (SELECT *, w IN ('bo', 'bc', 'br', 'bp') OR pw = 'b' || right(w, 1) AS ok FROM pr),
    bd AS (SELECT *, CASE WHEN w = 'eo' AND ok AND k % 10 <> 8 THEN opened WHEN w = 'bc' THEN '' END AS binds FROM st),
    fp AS (SELECT *, coalesce(last_value(binds IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bound FROM bd WHERE ok),
    fl AS (SELECT *, CASE w WHEN 'bo' THEN opened WHEN 'eo' THEN opened WHEN 'bc' THEN bound WHEN 'br' THEN bound WHEN 'bp' THEN bound END AS own FROM fp),
    ff AS (SELECT a.*, coalesce(a.own, b.own) AS file FROM fl a LEFT JOIN fl b ON a.user_id = b.user_id AND a.pseq = b.seq AND b.w = 'b' || right(a.w, 1))"""
family("files", "resources", f"""{FILE_SQL}, t AS (SELECT trace_id, file AS path, count(*) FILTER (w = 'eo') AS opens, count(*) FILTER (w = 'eo' AND k % 10 = 8) AS open_failures, count(*) FILTER (w = 'bp') AS reopens, count(*) FILTER (w = 'ec') AS closes, count(*) FILTER (w = 'br') AS reads, 0 AS writes,
    CAST(coalesce(sum(cents) FILTER (w = 'br'), 0) AS BIGINT) AS bytes_requested_read, CAST(coalesce(sum(k) FILTER (w = 'er'), 0) AS BIGINT) AS bytes_read FROM ff GROUP BY 1, 2) SELECT * FROM t""", "trace_id path opens open_failures reopens closes reads writes bytes_requested_read bytes_read")
family("file_samples", "resources", f"""{FILE_SQL}, z AS (SELECT trace_id, thread_id, seq, CASE w WHEN 'bo' THEN 'Open' WHEN 'bc' THEN 'Close' WHEN 'br' THEN 'Read' ELSE 'ReOpen' END AS what, user_id, w, (seq // 2) * 1000 + 1000 AS cycle FROM ev WHERE w LIKE 'b%'),
    r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS place, count(*) OVER (PARTITION BY trace_id) AS total FROM z), en AS (SELECT user_id, pseq, w, (seq // 2) * 1000 + 1000 + CASE w WHEN 'eo' THEN 5 ELSE 0 END AS ec, CASE w WHEN 'er' THEN k END AS actual, w = 'eo' AND k % 10 = 8 AS failed FROM st WHERE ok AND w LIKE 'e%')
    SELECT trace_id, thread_id, what, cycle, total, CASE WHEN r.w = 'bp' THEN cycle + 2 ELSE ec END AS end_cycle, actual, CASE WHEN r.w = 'bp' THEN false ELSE failed END AS failed FROM r LEFT JOIN en ON r.user_id = en.user_id AND en.pseq = r.seq AND right(en.w, 1) = right(r.w, 1) WHERE place <= 40""", "trace_id thread_id what cycle total end_cycle actual failed")  # fmt: skip
MEMORY_SQL = f""", x AS (SELECT trace_id, k AS a, event_id AS seq, cycle, cents AS size, event_type AS t, CASE event_type WHEN 'purchase' THEN k % 3 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS root_heap, CASE WHEN event_type IN ('purchase', 'signup') THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type <> 'view'), {map_sql("x", "trace_id, a")}"""
family("memory", "resources", f"""{MEMORY_SQL} SELECT trace_id, root_heap, CASE root_heap WHEN 0 THEN 'System memory' WHEN 1 THEN 'Video memory' ELSE 'Other' END AS heap, count(*) FILTER (kind = 'b') AS allocations, count(*) FILTER ((kind = 'b') = (outcome = 'matched')) AS frees, CAST(coalesce(sum(size) FILTER (kind = 'b'), 0) AS BIGINT) AS allocated_bytes,
    CAST(coalesce(sum(size) FILTER (kind = 'b' AND outcome = 'matched'), 0) AS BIGINT) AS freed_bytes, CAST(coalesce(sum(size) FILTER (outcome = 'open'), 0) AS BIGINT) AS outstanding_bytes FROM x_p GROUP BY 1, 2""", "trace_id root_heap heap allocations frees allocated_bytes freed_bytes outstanding_bytes")
family("memory_totals", "resources", f"""{MEMORY_SQL} SELECT trace_id, count(*) FILTER (kind = 'b') AS allocations, count(*) FILTER (kind = 'e') AS frees, count(*) FILTER (t = 'signup') AS realloc_allocations, count(*) FILTER (t = 'click') AS realloc_frees, count(*) FILTER (outcome = 'unmatched') AS unresolved_frees, CAST(sum(size) FILTER (kind = 'b') AS BIGINT) AS allocated_bytes,
    CAST(coalesce(sum(size) FILTER (kind = 'b' AND outcome = 'matched'), 0) AS BIGINT) AS freed_bytes, count(*) FILTER (outcome = 'open') AS outstanding, CAST(coalesce(sum(size) FILTER (outcome = 'open'), 0) AS BIGINT) AS outstanding_bytes FROM x_p GROUP BY 1""", "trace_id allocations frees realloc_allocations realloc_frees unresolved_frees allocated_bytes freed_bytes outstanding outstanding_bytes")
family("memory_tags", "resources", """, u AS (SELECT trace_id, k % 6 AS tag, count(*) AS scopes FROM c WHERE event_type = 'view' GROUP BY 1, 2) SELECT trace_id, tag, parent, name, coalesce(scopes, 0) AS scopes FROM (SELECT trace_id, i AS tag, i - 1 AS parent, 'tag' || i AS name FROM tr, range(5) r(i)) s FULL JOIN u USING (trace_id, tag)""", "trace_id tag parent name scopes")
family("callstacks", "resources", """, x AS (SELECT trace_id, k % 10 AS id, arg_min(event_id % 4 + 1, event_id) AS frame_count, arg_min(k, event_id) AS first_frame, count(*) - 1 AS duplicates FROM c WHERE event_type = 'view' AND k < 20 GROUP BY 1, 2) SELECT trace_id, id, frame_count, first_frame, duplicates, false AS truncated FROM x WHERE id <> 0""",
    "trace_id id frame_count first_frame duplicates truncated", lambda df: df.withColumn("first_frame", F.conv(F.substring("frames", 1, 2), 16, 10).cast("long")))
family("llm_tags", "resources", "SELECT trace_id, CAST(i AS VARCHAR) AS tag, 'llm' || i AS name, CAST(i - 1 AS VARCHAR) AS parent, CAST(i % 2 AS VARCHAR) AS tag_set FROM tr, range(4) r(i)", "trace_id tag name parent tag_set")
family("llm_trackers", "resources", "SELECT trace_id, i AS tracker, 'tracker' || i AS name FROM tr, range(2) r(i)", "trace_id tracker name")
family("llm_tag_sets", "resources", "SELECT trace_id, i AS tag_set, 'set' || i AS name FROM tr, range(2) r(i)", "trace_id tag_set name")
family("llm_values", "resources", """, x AS (SELECT trace_id, k % 2 AS tracker, event_id, cycle, k % 7 AS tag, cents AS value, 0 AS i FROM c WHERE event_type = 'error' UNION ALL SELECT trace_id, k % 2, event_id, cycle, k % 7 + 10, -k, 1 FROM c WHERE event_type = 'error'
    UNION ALL SELECT trace_id, k % 2, event_id, greatest(cycle - cents, 0), k % 7 - 3, cents, 0 FROM c WHERE event_type = 'signup' UNION ALL SELECT trace_id, k % 2, event_id, greatest(cycle - cents, 0), k % 7 + 10, -k, 1 FROM c WHERE event_type = 'signup')
    SELECT trace_id, tracker, tag, arg_max(value, (cycle, event_id, i)) AS latest_value, max(cycle) AS latest_cycle FROM x GROUP BY 1, 2, 3""", "trace_id tracker tag latest_value latest_cycle")
family("modules", "resources", f""", x AS (SELECT trace_id, k, event_id AS seq, cycle, CASE event_type WHEN 'click' THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type = 'error' OR event_type = 'click' AND k % 9 > 0), {map_sql("x", "trace_id, k")}
    SELECT trace_id, k * 65536 AS base, any_value(k % 9 * 4096) AS size, any_value('m' || k || '.dll') AS name, arg_max(outcome IN ('open', 'overwritten'), seq) AS active, count(*) FILTER (outcome = 'overwritten') AS duplicates FROM x_p WHERE kind = 'b' GROUP BY trace_id, k""", "trace_id base size name active duplicates")



@query("capture_symbols", f"""WITH {C_SQL}, x AS (SELECT trace_id, k, event_id AS seq, cycle, CASE event_type WHEN 'click' THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type = 'error' OR event_type = 'click' AND k % 9 > 0), {map_sql("x", "trace_id, k")},
    m AS (SELECT trace_id, k * 65536 AS base, any_value(k % 9 * 4096) AS size, any_value('m' || k || '.dll') AS name FROM x_p WHERE kind = 'b' GROUP BY trace_id, k), a AS (SELECT DISTINCT trace_id, k * 40000 AS address FROM c WHERE event_type = 'view'),
    h AS (SELECT a.trace_id, address, count(base) AS hits, any_value(name) AS name, any_value(address - base) AS rva FROM a LEFT JOIN m ON a.trace_id = m.trace_id AND address >= base AND address < base + size GROUP BY 1, 2)
    SELECT trace_id, address, CASE hits WHEN 0 THEN 'missing' ELSE 'resolved' END AS status, name, rva, CASE WHEN hits = 1 THEN 'f' || (rva // 8192) END AS symbol FROM h""")
def capture_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to modules, offsets and symbols; the symbols' table has a function for every 8 KiB of a module."""
    e = decoded(spark, sf_dir, "resources")
    loaded = dashboard.modules(e).select("trace_id", "base", "size", "name")
    addresses = base(spark, sf_dir).where("event_type = 'view'").select("trace_id", (F.col("k") * 40000).alias("address")).distinct()
    names = loaded.select(F.col("name").alias("module")).distinct().select("module", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    symbols = names.select("module", (F.col("i") * 8192).alias("start"), (F.col("i") * 8192 + 8192).alias("end"), F.concat(F.lit("f"), "i").alias("symbol"))
    return dashboard.symbolized(addresses, loaded, symbols).select("trace_id", "address", "status", "name", "rva", "symbol")


@query("capture_callstack_status", f"""WITH {C_SQL}, s AS (SELECT DISTINCT trace_id, k % 10 AS id FROM c WHERE event_type = 'view' AND k < 20 AND k % 10 <> 0) SELECT c.trace_id, CASE WHEN k % 12 = 0 THEN 'none' WHEN id IS NOT NULL THEN 'resolved' ELSE 'missing' END AS callstack_status, count(*) AS allocations FROM c LEFT JOIN s ON c.trace_id = s.trace_id AND k % 12 = id WHERE event_type = 'purchase' GROUP BY 1, 2""")
def capture_callstack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = decoded(spark, sf_dir, "resources")
    rows = dashboard.of(e, "Memory", "Alloc").select("trace_id", dashboard.number("CallstackId").alias("callstack"))
    return dashboard.resolve_callstacks(rows, dashboard.callstacks(e), "callstack").groupBy("trace_id", "callstack_status").agg(F.count("*").alias("allocations"))


# GPU.

GPU_SQL = f""", g AS (SELECT *, user_id % 3 + 256 * (user_id % 2) + 65536 AS queue FROM c), q AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN k % 20 END IGNORE NULLS) OVER (PARTITION BY trace_id, queue ORDER BY event_id) AS frame FROM g),
    w AS (SELECT trace_id, queue, frame, event_id AS seq, CASE event_type WHEN 'view' THEN cycle ELSE greatest(cycle - CASE WHEN k % 4 = 0 THEN 500000 ELSE 0 END, 1) END AS cycle, CASE WHEN k % 9 = 0 THEN 0 ELSE cycle - 500 END AS submitted, CASE event_type WHEN 'view' THEN 'b' ELSE 'e' END AS kind FROM q WHERE event_type IN ('view', 'purchase')), {stack_sql("w", "trace_id, queue", "frame")},
    b0 AS (SELECT trace_id, queue, frame, event_id AS seq, k % 6 AS spec, k, CASE k % 2 WHEN 0 THEN CASE WHEN k % 10 = 0 THEN 0 ELSE cycle END ELSE CASE WHEN k % 7 = 0 THEN 0 ELSE greatest(cycle - CASE WHEN k % 9 = 0 THEN 400000 ELSE 0 END, 1) END END AS cycle, CASE k % 2 WHEN 0 THEN 'b' ELSE 'e' END AS kind FROM q WHERE event_type = 'error'),
    b AS (SELECT * FROM b0 WHERE cycle <> 0), {stack_sql("b", "trace_id, queue", "frame")},
    wi AS (SELECT trace_id, queue, frame, event_id AS seq, cycle AS ws, cycle + cents % 1000 - CASE WHEN k % 5 = 0 THEN 900 ELSE 0 END AS we FROM q WHERE event_type = 'click' AND k % 3 = 0),
    bn AS (SELECT *, CASE WHEN spec < 4 THEN 'Pass' || spec WHEN spec = 4 THEN 'Frame' ELSE '#5' END AS name, CASE WHEN spec < 3 THEN 'Pass' || spec || ' ' || k WHEN spec = 4 THEN 'Frame ' || k END AS rendered, greatest(end_cycle - cycle, 0) AS duration FROM b_p WHERE matched)"""
family("gpu_queues", "gpu", f"""{GPU_SQL}, t AS (SELECT trace_id, queue, cycle AS ts FROM w UNION ALL SELECT trace_id, queue, cycle FROM b UNION ALL SELECT trace_id, queue, ws FROM wi UNION ALL SELECT trace_id, queue, we FROM wi), tt AS (SELECT trace_id, queue, min(ts) AS first_gpu, max(ts) AS last_gpu FROM t GROUP BY 1, 2),
    cp AS (SELECT trace_id, queue, event_id * 2 AS o, CASE WHEN k % 9 = 0 THEN 0 ELSE cycle - 500 END AS ts FROM q WHERE event_type = 'view' UNION ALL SELECT trace_id, queue, event_id * 2, cycle FROM q WHERE event_type = 'click' AND k % 3 = 2 UNION ALL SELECT trace_id, queue, event_id * 2 + 1, cycle + 1 FROM q WHERE event_type = 'click' AND k % 3 = 2),
    ct AS (SELECT trace_id, queue, arg_min(ts, o) AS first_cpu, arg_max(ts, o) AS last_cpu FROM cp GROUP BY 1, 2),
    wt AS (SELECT trace_id, queue, count(*) FILTER (matched AND end_cycle >= cycle) AS work_count, CAST(coalesce(sum(end_cycle - cycle) FILTER (matched AND end_cycle >= cycle), 0) AS BIGINT) AS work_cycles, count(*) FILTER (lost) AS unmatched_work_ends, count(*) FILTER (matched AND end_cycle < cycle) AS negative_work, count(*) FILTER (kind = 'b' AND NOT matched) AS unterminated_work FROM w_p GROUP BY 1, 2),
    bt AS (SELECT trace_id, queue, count(*) FILTER (matched) AS breadcrumb_count, CAST(coalesce(sum(greatest(end_cycle - cycle, 0)) FILTER (matched), 0) AS BIGINT) AS breadcrumb_cycles, count(*) FILTER (lost) AS unmatched_breadcrumb_ends, count(*) FILTER (matched AND end_cycle < cycle) AS negative_breadcrumb, count(*) FILTER (kind = 'b' AND NOT matched) AS unterminated_breadcrumb FROM b_p GROUP BY 1, 2),
    st AS (SELECT trace_id, queue, count(*) FILTER (event_type = 'signup') AS boundaries, arg_max(k % 20, event_id) FILTER (event_type = 'signup') AS last_frame, CAST(coalesce(sum(k) FILTER (event_type = 'click' AND k % 3 = 1), 0) AS BIGINT) AS draws, CAST(coalesce(sum(cents) FILTER (event_type = 'click' AND k % 3 = 1), 0) AS BIGINT) AS primitives, count(*) FILTER (event_type = 'click' AND k % 3 = 2) AS signal_fences FROM q GROUP BY 1, 2),
    it AS (SELECT trace_id, queue, count(*) FILTER (we >= ws) AS wait_count, CAST(coalesce(sum(we - ws) FILTER (we >= ws), 0) AS BIGINT) AS wait_cycles FROM wi GROUP BY 1, 2), al AS (SELECT trace_id, queue FROM st UNION SELECT trace_id, i + 65536 FROM tr, range(3) r(i))
    SELECT trace_id, queue, CASE WHEN queue < 65538 THEN 'Queue ' || (queue - 65536) END AS queue_name, queue % 256 AS queue_type, queue // 256 % 256 AS gpu, 1 AS queue_index, coalesce(work_count, 0) AS work_count, coalesce(work_cycles, 0) AS work_cycles, coalesce(unmatched_work_ends, 0) AS unmatched_work_ends, coalesce(negative_work, 0) AS negative_work, coalesce(unterminated_work, 0) AS unterminated_work,
    coalesce(breadcrumb_count, 0) AS breadcrumb_count, coalesce(breadcrumb_cycles, 0) AS breadcrumb_cycles, coalesce(unmatched_breadcrumb_ends, 0) AS unmatched_breadcrumb_ends, coalesce(negative_breadcrumb, 0) AS negative_breadcrumb, coalesce(unterminated_breadcrumb, 0) AS unterminated_breadcrumb, coalesce(wait_count, 0) AS wait_count, coalesce(wait_cycles, 0) AS wait_cycles, coalesce(boundaries, 0) AS boundaries, last_frame,
    coalesce(draws, 0) AS draws, coalesce(primitives, 0) AS primitives, coalesce(signal_fences, 0) AS signal_fences, coalesce(signal_fences, 0) AS wait_fences, first_gpu, last_gpu, first_cpu, last_cpu FROM al LEFT JOIN st USING (trace_id, queue) LEFT JOIN wt USING (trace_id, queue) LEFT JOIN bt USING (trace_id, queue) LEFT JOIN it USING (trace_id, queue) LEFT JOIN tt USING (trace_id, queue) LEFT JOIN ct USING (trace_id, queue)""",
    "trace_id queue queue_name queue_type gpu queue_index work_count work_cycles unmatched_work_ends negative_work unterminated_work breadcrumb_count breadcrumb_cycles unmatched_breadcrumb_ends negative_breadcrumb unterminated_breadcrumb wait_count wait_cycles boundaries last_frame draws primitives signal_fences wait_fences first_gpu last_gpu first_cpu last_cpu")
GPU_FRAMES_SQL = f"""{GPU_SQL}, fa AS (SELECT trace_id, queue, end_frame AS frame, 'w' AS what, cycle AS a, end_cycle AS z, end_cycle - cycle AS d, 0 AS dr, 0 AS pr FROM w_p WHERE matched AND end_cycle >= cycle UNION ALL SELECT trace_id, queue, end_frame, 'b', cycle, end_cycle, duration, 0, 0 FROM bn
    UNION ALL SELECT trace_id, queue, frame, 'i', ws, we, we - ws, 0, 0 FROM wi WHERE we >= ws UNION ALL SELECT trace_id, queue, frame, 'f', NULL, NULL, 0, 0, 0 FROM q WHERE event_type = 'signup' UNION ALL SELECT trace_id, queue, frame, 's', NULL, NULL, 0, k, cents FROM q WHERE event_type = 'click' AND k % 3 = 1 UNION ALL SELECT trace_id, queue, frame, 'x', NULL, NULL, 0, 0, 0 FROM q WHERE event_type = 'click' AND k % 3 = 2),
    gf AS (SELECT trace_id, queue, frame, count(*) FILTER (what = 'f') AS boundaries, count(*) FILTER (what = 'w') AS work_count, CAST(coalesce(sum(d) FILTER (what = 'w'), 0) AS BIGINT) AS work_cycles, count(*) FILTER (what = 'b') AS breadcrumb_count, CAST(coalesce(sum(d) FILTER (what = 'b'), 0) AS BIGINT) AS breadcrumb_cycles, count(*) FILTER (what = 'i') AS wait_count, CAST(coalesce(sum(d) FILTER (what = 'i'), 0) AS BIGINT) AS wait_cycles,
        CAST(sum(dr) AS BIGINT) AS draws, CAST(sum(pr) AS BIGINT) AS primitives, count(*) FILTER (what = 'x') AS signal_fences, count(*) FILTER (what = 'x') AS wait_fences, least(min(a), min(z)) AS first_gpu, greatest(max(a), max(z)) AS last_gpu FROM fa WHERE frame IS NOT NULL GROUP BY 1, 2, 3)"""
family("gpu_frames", "gpu", f"{GPU_FRAMES_SQL} SELECT * FROM gf", "trace_id queue frame boundaries work_count work_cycles breadcrumb_count breadcrumb_cycles wait_count wait_cycles draws primitives signal_fences wait_fences first_gpu last_gpu")
FRAME_CRUMBS_SQL = f"""{GPU_SQL}, fb AS (SELECT trace_id, queue, end_frame AS frame, rendered, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM bn WHERE end_frame IS NOT NULL AND rendered IS NOT NULL GROUP BY 1, 2, 3, 4), fr AS (SELECT *, row_number() OVER (PARTITION BY trace_id, queue, frame ORDER BY total_cycles DESC, count DESC, rendered) AS rank FROM fb)"""
family("gpu_frame_breadcrumbs", "gpu", f"{FRAME_CRUMBS_SQL} SELECT trace_id, queue, frame, rendered, count, total_cycles, rank FROM fr WHERE rank <= 8", "trace_id queue frame rendered count total_cycles rank")
family("gpu_breadcrumbs", "gpu", f"""{GPU_SQL} SELECT trace_id, spec, name, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles, count(*) AS metadata_events, CAST(sum(CASE WHEN k < 24 THEN 1 ELSE 2 END) AS BIGINT) AS metadata_bytes FROM bn GROUP BY 1, 2, 3""", "trace_id spec name count total_cycles metadata_events metadata_bytes")
family("gpu_latency", "gpu", f"""{GPU_SQL}, l AS (SELECT trace_id, cycle - submitted AS delay, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS place FROM w WHERE kind = 'b' AND submitted <> 0) SELECT trace_id, count(*) AS n, 500 AS median, min(delay) AS least, max(delay) AS greatest FROM l WHERE place <= 64 GROUP BY 1""",
    "trace_id n median least greatest", lambda df: df.select("trace_id", "n", *(F.col(c).cast("long") for c in ("median", "least", "greatest"))))


@query("capture_gpu_timeline", f"""WITH {C_SQL}{GPU_SQL}, u AS (SELECT trace_id, queue, 'work' AS what, 'Work' AS name, cycle AS start, end_cycle AS "end", end_cycle - cycle AS duration, end_seq FROM w_p WHERE matched AND end_cycle >= cycle AND end_frame = 7 UNION ALL SELECT trace_id, queue, 'breadcrumb', coalesce(rendered, name), cycle, end_cycle, duration, end_seq FROM bn WHERE end_frame = 7),
    r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY end_seq) AS place FROM u) SELECT trace_id, queue, what, name, start, "end", duration FROM r WHERE place <= 10""")
def capture_gpu_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.gpu_timeline(decoded(spark, sf_dir, "gpu"), 7, 10)[0].select("trace_id", "queue", "what", "name", "start", "end", "duration")


@query("capture_gpu_timeline_bounds", f"""WITH {C_SQL}{GPU_SQL}, u AS (SELECT trace_id, cycle AS a, end_cycle AS z FROM w_p WHERE matched AND end_cycle >= cycle AND end_frame = 7 UNION ALL SELECT trace_id, cycle, end_cycle FROM bn WHERE end_frame = 7) SELECT trace_id, min(a) AS begin, max(z) AS "end", count(*) AS intervals, count(*) > 10 AS truncated FROM u GROUP BY 1""")
def capture_gpu_timeline_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.gpu_timeline(decoded(spark, sf_dir, "gpu"), 7, 10)[1]


@query("capture_frame_breadcrumbs", f"""WITH {C_SQL}{FRAME_CRUMBS_SQL}, t AS (SELECT trace_id, frame, rendered, CAST(sum(count) AS BIGINT) AS count, CAST(sum(total_cycles) AS BIGINT) AS total_cycles FROM fr WHERE rank <= 8 AND NOT regexp_matches(rendered, '^Frame [0-9]') GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY trace_id, frame ORDER BY total_cycles DESC, count DESC, rendered) AS rank FROM t) SELECT * FROM r WHERE rank <= 8""")
def capture_frame_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.frame_breadcrumbs(dashboard.gpu_frame_breadcrumbs(decoded(spark, sf_dir, "gpu"))).select("trace_id", "frame", "rendered", "count", "total_cycles", "rank")


# CPU scopes. A scope lasts 64 seconds of the capture's own million cycles at most.

CPU_SQL = f""", x AS (SELECT trace_id, thread_id, event_id AS seq, cycle, k, event_type, CASE WHEN event_type IN ('view', 'signup') THEN 'b' ELSE 'e' END AS kind FROM c WHERE event_type <> 'error'), {stack_sql("x", "trace_id, thread_id")},
    sc AS (SELECT *, event_type = 'signup' AS is_metadata, CASE WHEN event_type = 'signup' THEN seq ELSE k % 5 + 1 END AS spec_id, CASE WHEN matched THEN least(end_cycle - cycle, 64000000) END AS duration FROM x_p WHERE kind = 'b'),
    mt AS (SELECT trace_id, event_id AS metadata_id, k % 3 AS spec_id, k % 4 <> 3 AS early, k, CASE k % 3 WHEN 0 THEN 'Frame ' || k WHEN 1 THEN 'Asset ' || k || ' of abc' END AS rendered FROM c WHERE event_type = 'signup'),
    mi AS (SELECT sc.trace_id, sc.thread_id, mt.metadata_id, mt.spec_id, mt.rendered, mt.k, cycle, end_cycle, duration FROM sc JOIN mt ON sc.trace_id = mt.trace_id AND sc.spec_id = mt.metadata_id WHERE is_metadata AND matched AND early)"""


def cpu_parts(spark: SparkSession, sf_dir: str, of: str = "scopes") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Dispatched events, scopes, metadata records and the scopes that count for metadata."""
    e = decoded(spark, sf_dir, of)
    intervals, records = dashboard.cpu_intervals(e), dashboard.metadata_records(e)
    return e, intervals, records, dashboard.metadata_intervals(e, intervals, records)


family("thread_scopes", "scopes", f"""{CPU_SQL}, t AS (SELECT trace_id, thread_id, spec_id, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM sc WHERE matched AND NOT is_metadata GROUP BY 1, 2, 3)
    SELECT trace_id, thread_id, spec_id, CASE WHEN spec_id < 5 THEN 'Scope' || spec_id ELSE '#5' END AS name, count, total_cycles, total_cycles / 1000000.0 AS total_seconds, CASE WHEN thread_id < 32 THEN 'thread' || (thread_id - 2) END AS thread_name, CASE WHEN thread_id < 32 THEN thread_id + 98 END AS system_id FROM t""".replace("total_cycles / 1000000.0", "total_cycles / CAST(1000000 AS DOUBLE)"), "trace_id thread_id spec_id name count total_cycles total_seconds thread_name system_id")  # fmt: skip


@query("capture_cpu_scopes", f"""WITH {C_SQL}{CPU_SQL} SELECT trace_id, thread_id, spec_id, is_metadata, cycle AS start_cycle, end_cycle, duration FROM sc""")
def capture_cpu_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scope, open ones without an end: metadata contexts included, and decoded as arrays below."""
    return dashboard.cpu_intervals(decoded(spark, sf_dir, "stacks")).select("trace_id", "thread_id", "spec_id", "is_metadata", "start_cycle", "end_cycle", "duration")


@query("capture_cpu_scopes_plain", f"""WITH {C_SQL}{CPU_SQL} SELECT trace_id, thread_id, spec_id, is_metadata, cycle AS start_cycle, end_cycle, duration FROM sc""")
def capture_cpu_scopes_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.cpu_intervals(decoded(spark, sf_dir, "stacks"), contexts=False).select("trace_id", "thread_id", "spec_id", "is_metadata", "start_cycle", "end_cycle", "duration")


@query("capture_scope_totals", f"""WITH {C_SQL}{CPU_SQL} SELECT trace_id, spec_id, CASE WHEN spec_id < 5 THEN 'Scope' || spec_id ELSE '#5' END AS name, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM sc WHERE matched AND NOT is_metadata GROUP BY 1, 2, 3""")
def capture_scope_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = decoded(spark, sf_dir, "scopes")
    return dashboard.scope_totals(dashboard.cpu_intervals(e, False), dashboard.cpu_specs(e).select("trace_id", "spec_id", "name"))


@query("capture_spec_totals", f"""WITH {C_SQL}{CPU_SQL} SELECT trace_id, spec_id, CASE WHEN spec_id < 5 THEN 'Scope' || spec_id ELSE '#5' END AS name, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM sc WHERE matched AND NOT is_metadata GROUP BY 1, 2, 3""")
def capture_spec_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, summed up while the scopes are decoded: partial sums of threads, then their sum."""
    return dashboard.spec_totals(decoded(spark, sf_dir, "scopes"))


@query("capture_metadata", f"""WITH {C_SQL}{CPU_SQL} SELECT trace_id, spec_id, CASE spec_id WHEN 0 THEN 'Frame' WHEN 1 THEN 'Asset' ELSE '#2' END AS name, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM mi GROUP BY 1, 2, 3""")
def capture_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata scopes by spec, those alone that were known when they began."""
    e, _, _, found = cpu_parts(spark, sf_dir)
    return dashboard.metadata_totals(found, dashboard.metadata_specs(e)).select("trace_id", "spec_id", "name", "count", "total_cycles")


@query("capture_metadata_names", f"""WITH {C_SQL}{CPU_SQL}, t AS (SELECT trace_id, spec_id, rendered, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM mi WHERE rendered IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY total_cycles DESC, count DESC, spec_id, rendered) AS rank FROM t) SELECT * FROM r WHERE rank <= 40""")
def capture_metadata_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.metadata_names(cpu_parts(spark, sf_dir)[3]).select("trace_id", "spec_id", "rendered", "count", "total_cycles", "rank")


@query("capture_metadata_specs", f"""WITH {C_SQL}{CPU_SQL}, a AS (SELECT trace_id, spec_id, count(*) AS records, CAST(sum(CASE WHEN k < 24 THEN 5 ELSE 6 END) AS BIGINT) AS metadata_bytes, count(*) AS decoded_records, count(*) * 2 AS decoded_values, 'abc' AS strings, min(metadata_id) AS sample_id FROM mt GROUP BY 1, 2),
    b AS (SELECT trace_id, spec_id, count(*) AS scopes, CAST(sum(duration) AS BIGINT) AS total_cycles FROM mi GROUP BY 1, 2), n AS (SELECT DISTINCT trace_id, spec_id, rendered FROM mt WHERE rendered IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY trace_id, spec_id ORDER BY rendered) AS place FROM n),
    p AS (SELECT trace_id, spec_id, string_agg(rendered, ',' ORDER BY rendered) AS rendered_names FROM o WHERE place <= 8 GROUP BY 1, 2)
    SELECT trace_id, spec_id, CASE spec_id WHEN 0 THEN 'Frame' WHEN 1 THEN 'Asset' ELSE '#2' END AS name, records, metadata_bytes, decoded_records, decoded_values, strings, coalesce(rendered_names, '') AS rendered_names, sample_id, coalesce(scopes, 0) AS scopes, coalesce(total_cycles, 0) AS total_cycles FROM a LEFT JOIN b USING (trace_id, spec_id) LEFT JOIN p USING (trace_id, spec_id)""")
def capture_metadata_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, records, found = cpu_parts(spark, sf_dir)
    rows = dashboard.metadata_spec_summaries(e, found, records)
    return rows.select("trace_id", "spec_id", "name", "records", "metadata_bytes", "decoded_records", "decoded_values", F.concat_ws(",", "strings").alias("strings"), F.concat_ws(",", "rendered_names").alias("rendered_names"), "sample_id", "scopes", "total_cycles")


@query("capture_metadata_dashboard", f"""WITH {C_SQL}{CPU_SQL}, a AS (SELECT trace_id, count(*) AS records, CAST(sum(CASE WHEN k < 24 THEN 5 ELSE 6 END) AS BIGINT) AS metadata_bytes, count(*) * 2 AS decoded_values FROM mt GROUP BY 1), b AS (SELECT trace_id, count(*) AS scopes FROM sc WHERE is_metadata GROUP BY 1), d AS (SELECT trace_id, count(*) AS resolved_scopes FROM mi GROUP BY 1)
    SELECT trace_id, 2 AS specs, 2 AS specs_with_template, 'id,name,number' AS field_names, records, metadata_bytes, decoded_values, 'abc' AS strings, scopes, resolved_scopes, scopes - resolved_scopes AS unresolved_scopes FROM a JOIN b USING (trace_id) JOIN d USING (trace_id)""")
def capture_metadata_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, intervals, records, found = cpu_parts(spark, sf_dir)
    return dashboard.metadata_dashboard(e, intervals, found, records).withColumns({"field_names": F.concat_ws(",", "field_names"), "strings": F.concat_ws(",", "strings")})


# The innermost metadata scope around a scope's end that names a frame and was known by then.
FRAMED_SQL = f"""{CPU_SQL}, en AS (SELECT a.trace_id, a.thread_id, a.seq, f.k AS frame, row_number() OVER (PARTITION BY a.trace_id, a.thread_id, a.seq ORDER BY m.seq DESC) AS place FROM sc a JOIN sc m ON a.trace_id = m.trace_id AND a.thread_id = m.thread_id AND m.is_metadata AND m.seq <= a.seq AND (NOT m.matched OR m.end_seq >= a.end_seq) AND a.matched
        JOIN mt f ON f.trace_id = m.trace_id AND f.metadata_id = m.spec_id AND f.spec_id = 0),
    fs AS (SELECT sc.*, en.frame FROM sc LEFT JOIN en ON sc.trace_id = en.trace_id AND sc.thread_id = en.thread_id AND sc.seq = en.seq AND place = 1 WHERE matched)"""


@query("capture_framed_scopes", f"""WITH {C_SQL}{FRAMED_SQL} SELECT trace_id, thread_id, spec_id, cycle AS start_cycle, frame FROM fs""")
def capture_framed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, intervals, records, _ = cpu_parts(spark, sf_dir)
    return dashboard.framed_scopes(intervals, records).select("trace_id", "thread_id", "spec_id", "start_cycle", "frame")


@query("capture_cpu_timeline", f"""WITH {C_SQL}{FRAMED_SQL}, ca AS (SELECT trace_id, thread_id, event_id AS end_seq, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY trace_id, thread_id ORDER BY event_id) AS carry FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY carry NULLS FIRST, thread_id, end_seq) AS place FROM fs JOIN ca USING (trace_id, thread_id, end_seq) WHERE frame = 6) SELECT trace_id, thread_id, spec_id, is_metadata, cycle AS start_cycle, end_cycle, duration FROM r WHERE place <= 5""")
def capture_cpu_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scopes of a frame; batches have no serials, so they follow the latest introduction of metadata in their thread."""
    _, intervals, records, _ = cpu_parts(spark, sf_dir)
    return dashboard.cpu_timeline(dashboard.framed_scopes(intervals, records), 6, 5)[0].select("trace_id", "thread_id", "spec_id", "is_metadata", "start_cycle", "end_cycle", "duration")


@query("capture_cpu_timeline_bounds", f"""WITH {C_SQL}{FRAMED_SQL} SELECT trace_id, min(cycle) AS begin, max(end_cycle) AS "end", count(*) AS intervals, count(*) > 5 AS truncated FROM fs WHERE frame = 6 GROUP BY 1""")
def capture_cpu_timeline_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, intervals, records, _ = cpu_parts(spark, sf_dir)
    return dashboard.cpu_timeline(dashboard.framed_scopes(intervals, records), 6, 5)[1]


@query("capture_frame_scopes", f"""WITH {C_SQL}{FRAMED_SQL}, t AS (SELECT trace_id, frame, spec_id, count(*) AS count, CAST(sum(duration) AS BIGINT) AS total_cycles FROM fs WHERE frame IS NOT NULL AND NOT is_metadata GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id, frame ORDER BY total_cycles DESC, spec_id) AS rank FROM t) SELECT * FROM r WHERE rank <= 5""")
def capture_frame_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, intervals, records, _ = cpu_parts(spark, sf_dir)
    return dashboard.frame_scopes(dashboard.framed_scopes(intervals, records)).select("trace_id", "frame", "spec_id", "count", "total_cycles", "rank")


@query("capture_frame_correlation", f"""WITH {C_SQL}{FRAMED_SQL}{GPU_FRAMES_SQL}, ma AS (SELECT trace_id, k AS frame, count(*) AS cpu_metadata_count, CAST(sum(duration) AS BIGINT) AS cpu_metadata_cycles FROM mi WHERE spec_id = 0 GROUP BY 1, 2), mb AS (SELECT trace_id, frame, min(cycle) AS cpu_begin_cycle, max(end_cycle) AS cpu_end_cycle FROM fs WHERE frame IS NOT NULL AND NOT is_metadata GROUP BY 1, 2),
    mg AS (SELECT trace_id, frame, count(*) AS gpu_queues, CAST(sum(work_count) AS BIGINT) AS gpu_work_count, CAST(sum(work_cycles) AS BIGINT) AS gpu_work_cycles, CAST(sum(breadcrumb_count) AS BIGINT) AS gpu_breadcrumb_count, CAST(sum(breadcrumb_cycles) AS BIGINT) AS gpu_breadcrumb_cycles FROM gf GROUP BY 1, 2)
    SELECT trace_id, frame, coalesce(cpu_metadata_count, 0) AS cpu_metadata_count, coalesce(cpu_metadata_cycles, 0) AS cpu_metadata_cycles, cpu_begin_cycle, cpu_end_cycle, coalesce(gpu_queues, 0) AS gpu_queues, coalesce(gpu_work_count, 0) AS gpu_work_count, coalesce(gpu_work_cycles, 0) AS gpu_work_cycles, coalesce(gpu_breadcrumb_count, 0) AS gpu_breadcrumb_count, coalesce(gpu_breadcrumb_cycles, 0) AS gpu_breadcrumb_cycles
    FROM ma FULL JOIN mb USING (trace_id, frame) FULL JOIN mg USING (trace_id, frame)""")
def capture_frame_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, intervals, records, found = cpu_parts(spark, sf_dir)
    return dashboard.frame_correlation(found, dashboard.framed_scopes(intervals, records), dashboard.gpu_frames(decoded(spark, sf_dir, "gpu")))


family("metadata_stack", "stacks", """SELECT trace_id, k % 4 * 0 + CASE k % 4 WHEN 0 THEN k % 8 ELSE k % 12 END AS id, count(*) FILTER (k % 4 = 0) AS saves, count(*) FILTER (k % 4 = 1) AS restores, count(*) FILTER (k % 4 = 0) > 0 AS saved FROM c WHERE event_type = 'error' AND k % 4 < 2 GROUP BY 1, 2""", "trace_id id saves restores saved")
family("metadata_stack_totals", "stacks", """, i AS (SELECT trace_id, CASE k % 4 WHEN 0 THEN k % 8 ELSE k % 12 END AS id, count(*) FILTER (k % 4 = 0) AS saves, count(*) FILTER (k % 4 = 1) AS restores FROM c WHERE event_type = 'error' AND k % 4 < 2 GROUP BY 1, 2), n AS (SELECT trace_id, count(*) AS clears FROM c WHERE event_type = 'error' AND k % 4 = 2 GROUP BY 1)
    SELECT trace_id, CAST(sum(saves) AS BIGINT) AS saves, CAST(sum(restores) AS BIGINT) AS restores, CAST(coalesce(sum(restores) FILTER (saves = 0), 0) AS BIGINT) AS unmatched_restores, any_value(clears) AS clears FROM i JOIN n USING (trace_id) GROUP BY 1""", "trace_id saves restores unmatched_restores clears")


@query("capture_timeline_query", f"""WITH {C_SQL}{CPU_SQL} SELECT trace_id, thread_id, spec_id, cycle AS start_cycle, end_cycle FROM sc WHERE matched AND NOT is_metadata AND cycle <= 4000000 AND end_cycle >= 3000000 AND spec_id = 3 ORDER BY cycle, end_cycle, trace_id, thread_id, spec_id LIMIT 50""")
def capture_timeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scopes of a name in a window of cycles."""
    e = decoded(spark, sf_dir, "scopes")
    named = joins.named_facts(dashboard.cpu_intervals(e, False).where("not is_metadata"), dashboard.cpu_specs(e).select("spec_id", "name").distinct(), "spec_id", "spec_id", "name")
    return timeline.index_query(named, "start_cycle", "end_cycle", ["trace_id", "thread_id", "spec_id"], 3_000_000, 4_000_000, text="scope3", names=["name"], limit=50)[0].select("trace_id", "thread_id", "spec_id", "start_cycle", "end_cycle")

"""Token ids of a corpus in files of the range coder's blocks, and back.

Documents are dealt to parts by ranges of their ids, so the parts' order is the corpus's; there are as many parts as
the text needs, up to MOST_PARTS, beyond which parts grow. A part is a run of groups: a group's rows are the lengths of
the documents that begin in it (kind 0) and then its blocks (kind 1), each a self-contained unit of ``rangecoder``; the
ids run through the blocks without regard to documents. Texts become ids and ids become documents again group by group,
so memory does not grow with a part; blocks are coded and decoded by ``blockcoder``, in Spark's own processes.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blockcoder, rangecoder
from .common import new_path
from .tokens import whole_texts

#: Bytes of text in a part, about, and the most parts.
PART_BYTES, MOST_PARTS = 10 << 20, 20_000
END_ID = 0
SCHEMA = "part int, grp int, kind int, seq long, doc_id long, n_tokens long, code binary"


def vocabulary_size(tokenizer: str) -> int:
    return max(whole_texts(tokenizer, "byte").tokenizer.get_vocab().values()) + 1


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> int:
    """Write the ids of every row's whole text (null as empty) and ``end_id``, in ascending doc_id, nulls first.

    Rows of one id follow each other in the order of their texts' hashes; other columns are ignored. An empty table
    gives files without rows. Fails if the vocabulary is larger than the coder takes. Returns the number of parts.
    """
    vocabulary = vocabulary_size(tokenizer)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-total // PART_BYTES)))
    dealt = base.repartitionByRange(parts, "doc_id").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group = whole_texts(tokenizer, "byte"), rangecoder.BLOCK * rangecoder.LANES
        part, grp, n_docs, held = None, 0, 0, 0
        waiting: list[np.ndarray] = []

        def blocks(ids: np.ndarray) -> pa.RecordBatch:
            return as_batch([(part, grp, 1, i, None, None, ids[at : at + rangecoder.BLOCK].tobytes()) for i, at in enumerate(range(0, len(ids), rangecoder.BLOCK))])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            index = []
            for key, ids in zip(batch.column(0).to_pylist(), words.encode([t.as_py() for t in batch.column(1)]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                index.append((part, grp, 0, n_docs, key, len(ids), None))
                n_docs += 1
                waiting.append(ids)
                held += len(ids)
                while held >= group:
                    joined = np.concatenate(waiting)
                    yield as_batch(index)
                    yield blocks(joined[:group])
                    index, waiting, held, grp = [], [joined[group:]], held - group, grp + 1
            yield as_batch(index)
        if held:
            yield blocks(np.concatenate(waiting))

    plain = dealt.mapInArrow(encode, SCHEMA)
    plain.withColumn("code", blockcoder.encoded(docs.sparkSession, F.col("code"), vocabulary)).write.parquet(path)
    return parts


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "grp", "kind", "seq", "doc_id", "n_tokens", "code"])


def read_token_files(spark: SparkSession, path: str, parts: int, *, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files; ``ids`` too if asked for.

    Fails if a block is damaged or ids are missing.
    """
    vocabulary = vocabulary_size(tokenizer)
    files = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None  # part and group
        index: deque[tuple[int | None, int]] = deque()
        blocks: list[np.ndarray] = []
        ids, done = np.zeros(0, "<u4"), 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Join a group's ids and give out the documents that are whole."""
            nonlocal ids, done, blocks
            ids, blocks = np.concatenate([ids, *blocks]), []
            out, used = [], 0
            while index and used + index[0][1] <= len(ids):
                key, n = index.popleft()
                own = ids[used : used + n].tobytes()
                out.append((at[0], key, done, n, zlib.crc32(own), own if with_ids else None))
                used, done = used + n, done + n
            ids = ids[used:]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

        for batch in batches:
            for p, g, kind, key, n, code in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), batch.column(6), strict=True):
                if (p, g) != at:
                    if at is not None:
                        yield from flush()
                    if at is None or p != at[0]:
                        if index or len(ids):
                            raise ValueError("the blocks do not hold the documents' ids")
                        done = 0
                    at = p, g
                if kind:
                    blocks.append(np.frombuffer(code.as_buffer(), "<u4"))
                else:
                    index.append((key, n))
        if at is not None:
            yield from flush()
        if index or len(ids):
            raise ValueError("the blocks do not hold the documents' ids")

    dealt = files.repartitionByRange(parts, "part").sortWithinPartitions("part", "grp", "kind", "seq")
    plain = dealt.withColumn("code", blockcoder.decoded(spark, F.col("code"), vocabulary))
    rows = plain.mapInArrow(decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    lengths = files.where("kind = 0").groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(starts, "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, *, tokenizer: str, **names: str) -> DataFrame:
    """Write token files of ``docs`` to the shared folder and read them back. An empty table stays empty."""
    path = new_path(docs.sparkSession, "token-files")
    parts = write_token_files(docs, path, tokenizer=tokenizer, **names)
    return read_token_files(docs.sparkSession, path, parts, tokenizer=tokenizer)

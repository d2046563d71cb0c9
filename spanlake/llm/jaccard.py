"""Exact Jaccard similarity join of word-shingle sets, in the metric space of the Jaccard distance.

Documents are reduced to distinct shingle sets. Two sets with similarity of at least 0.8 share at least t(n) of the
first p(n) shingles in a fixed order of all shingles, so sets that share fewer of theirs with any other set have no
partner and leave, and each shared shingle leads its holders to one region, named after its smallest holder. A region
is joined recursively: pivots are taken far from each other, every set goes to the Voronoi cell of its nearest
pivot, sets too far from all pivots to one more cell, and the triangle inequality says which boundary sets other cells
need. A pivot has met every set of its region, so it leaves; a cell whose sets are all connected is done.

Links join components, so a region yields a spanning forest of its links, never all pairs. The regions themselves are
formed by shared shingles, not by pivots: unrelated texts are all at distance 1, where the triangle inequality says
nothing, so pivots part only what shares shingles already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, sliced, stored
from .components import connected_components
from .hashing import shingle_set

WORDS = 5
#: Percent of the union that two linked sets share at least.
PERCENT = 80
RADIUS = 1 - PERCENT / 100
#: One in SHARED of a set's shingles, at least, must be found with a partner among the first ones.
SHARED = 10
#: Sets beyond FAR of every pivot form a cell of their own.
FAR = 3 * RADIUS
PIVOTS = 8
#: Sets of one region that are joined in one place, and bytes of them; larger regions are joined block by block.
REGION_LIMIT, REGION_BYTES = 20_000, 64 << 20
#: Keys of 32 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets in all cells together, as a multiple of the sets, beyond which a region is not split.
OVERLAP = 1.1


def least_shared(n: np.ndarray | int) -> np.ndarray | int:
    """t: how many shingles of their prefixes two linked sets share at least, if the smaller has ``n`` shingles."""
    return np.maximum(1, n // SHARED)


def prefix_length(n: int) -> int:
    """p: with so many of its first shingles a set meets any partner in at least ``least_shared`` of them."""
    return min(n, n - -(-PERCENT * n // 100) + int(least_shared(n)))


def row_hash(text: str) -> Column:
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0))


def document_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row_hash, n, set_key, check, prefix`` of every row: size, two hashes and first shingles of its set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, keys, checks, prefixes = [], [], [], []
            for value in batch.column(2):
                s = shingle_set((value.as_py() or "").encode("utf-8", "surrogatepass"), WORDS)
                sizes.append(len(s))
                digest = blake2b(s.tobytes(), digest_size=16).digest()
                keys.append(int.from_bytes(digest[:8], "little", signed=True))
                checks.append(int.from_bytes(digest[8:], "little", signed=True))
                prefixes.append(s[: prefix_length(len(s))].view(np.int64))
            offsets = np.zeros(len(prefixes) + 1, np.int32)
            np.cumsum([len(p) for p in prefixes], out=offsets[1:])
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), flat], names=["doc_id", "row_hash", "n", "set_key", "check", "prefix"])

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(text).alias("row_hash"), F.col(text).alias("text"))
    return base.mapInArrow(scan, "doc_id long, row_hash long, n long, set_key long, check long, prefix array<long>")


def told_apart(base: DataFrame) -> DataFrame:
    """``base`` with a ``set_key`` that different sets do not share: where two do, by their other hash, one gets a new key."""
    shared = base.groupBy("set_key").agg(F.min("check").alias("_lo"), F.max("check").alias("_hi")).where("_lo < _hi").select("set_key", "_lo")
    if not shared.head(1):
        return base
    moved = base.join(shared, "set_key", "left")  # some pairs of sets in 2**64
    return moved.withColumn("set_key", F.when(F.col("check") != F.col("_lo"), F.xxhash64("set_key", "check")).otherwise(F.col("set_key"))).select(*base.columns)


class Sets:
    """The sets of one region, with union-find over them."""

    def __init__(self, keys: np.ndarray, sets: list[np.ndarray]):
        self.keys, self.sets = keys, sets
        self.sizes = np.array([len(s) for s in sets])
        self.parent = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """How many shingles each of ``others`` shares with ``pivot``."""
        own = self.sets[pivot]
        flat = np.concatenate([self.sets[i] for i in others])
        at = np.searchsorted(own, flat)
        hit = own[np.minimum(at, len(own) - 1)] == flat
        return np.add.reduceat(hit, np.concatenate([[0], np.cumsum(self.sizes[others])[:-1]]), dtype=np.int64)

    def meet(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Link ``pivot`` with its partners among ``others``; the distances."""
        both = self.shared(pivot, others)
        union = self.sizes[pivot] + self.sizes[others] - both
        mine = self.root(pivot)
        for i in others[100 * both >= PERCENT * union].tolist():
            r = self.root(i)
            if r != mine:
                self.parent[r] = mine
        return 1 - both / union

    def join_all(self) -> None:
        """Join the sets band by band: linked sets' sizes differ by a quarter of the smaller at most."""
        bands = np.floor(np.log(self.sizes) / np.log(100 / PERCENT) + 1e-9).astype(int)
        for b in np.unique(bands).tolist():
            # Rounding may move a size across a bound, so the band before the last one is taken too.
            self.join(np.flatnonzero((bands <= b) & (bands >= b - 2)))

    def join(self, members: np.ndarray) -> None:
        """Find all links among ``members``, but for those within what is one component already."""
        todo = [members]
        while todo:
            members = todo.pop()
            roots = {self.root(i) for i in members.tolist()}
            if len(roots) < 2:
                continue
            distances, left, pivot = [], members, int(members[0])
            for _ in range(min(PIVOTS, len(members) - 1)):
                keep = left != pivot
                left = left[keep]
                distances = [d[keep] for d in distances] + [self.meet(pivot, left)]
                if len(left) < 2:
                    break
                pivot = int(left[np.argmax(np.min(distances, axis=0))])
            if len(left) < 2:
                continue
            d = np.array(distances)
            nearest, least, slack = d.argmin(axis=0), d.min(axis=0), 1e-9
            far = least > FAR
            cells = [least > FAR - RADIUS - slack] if far.any() else []
            for j in range(len(d)):
                core = (nearest == j) & ~far
                if core.any():
                    window = (d[j] <= d[j][core].max() + RADIUS + slack) & ((d[j] <= least + 2 * RADIUS + slack) | far)
                    cells.append(core | window)
            # Where windows cover each other, cells would repeat work; the sets that are left go on as one cell.
            if sum(np.count_nonzero(c) for c in cells) > OVERLAP * len(left):
                todo.append(left)
            else:
                todo += [left[c] for c in cells]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(i) for i in range(len(self.sets))], np.int64)
        linked = roots != np.arange(len(roots))
        return self.keys[linked], self.keys[roots[linked]]


def unit_links(units: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of the links within each unit of ``unit, set_key, label, shingles``.

    Sets of one label (null: none) are known to be connected.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keys, sets, labels = None, [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                group = Sets(np.array(keys, np.int64), sets)
                first: dict[int, int] = {}
                for i, label in enumerate(labels):
                    if label is not None:
                        group.parent[i] = first.setdefault(label, i)
                group.join_all()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in group.forest()], names=["a", "b"])

        for batch in batches:
            for unit, key, label, shingles in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if unit != name:
                    yield from links()
                    name, keys, sets, labels = unit, [], [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    labels.append(label)
                    sets.append(np.frombuffer(shingles.as_buffer(), np.uint64))
        yield from links()

    return units.repartition("unit").sortWithinPartitions("unit", "set_key").mapInArrow(scan, "a long, b long")


def region_links(members: DataFrame, sets: DataFrame, region_limit: int) -> list[DataFrame]:
    """Stored tables of all links that join components within regions of ``region, set_key, n``.

    A region of more than ``region_limit`` sets or REGION_BYTES is dealt to blocks. Each block is joined by itself; where
    that leaves several components, every two blocks are joined too, with what is connected already taken as known.
    """
    sizes = members.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / region_limit), F.ceil(F.sum("n") * 8 / REGION_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "region").select("region", "set_key", "blocks", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block"))
    no_label = F.lit(None).cast("long").alias("label")
    alone = stored(unit_links(dealt.join(sets, "set_key").select(F.concat_ws("/", "region", "block").alias("unit"), "set_key", no_label, "shingles")), "set-links")
    large = dealt.where("blocks > 1")
    if not large.head(1):
        return [alone]
    roots = connected_components(alone).withColumnRenamed("node", "set_key")
    known = large.join(roots, "set_key", "left").withColumn("label", F.coalesce("root", "set_key"))
    parted = known.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("region")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block")))
    pairs = known.join(parted, "region").select("region", "set_key", "label", "block", other.alias("other"))
    unit = F.concat_ws("/", "region", F.least("block", "other"), F.greatest("block", "other")).alias("unit")
    across = unit_links(pairs.select(unit, "set_key", "label").join(sets, "set_key").select("unit", "set_key", "label", "shingles"))
    return [alone, stored(across, "set-links")]


def full_sets(rows: DataFrame) -> DataFrame:
    """``set_key, shingles`` of rows of ``set_key, text``: the whole set as little-endian 64-bit words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set((v.as_py() or "").encode("utf-8", "surrogatepass"), WORDS).astype("<u8").tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["set_key", "shingles"])

    return rows.select("set_key", "text").mapInArrow(scan, "set_key long, shingles binary")


def similarity_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", region_limit: int = REGION_LIMIT) -> DataFrame:
    """``doc_id, row_hash, n_shingles, component_id, is_first`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, null only if all of them are null. A row without words,
    null texts included, is linked with nothing and is its own component. Equal sets are linked, so repeated rows
    and copies share a component. ``is_first`` marks the row that stands for its component (for repeated rows of one
    id and text, all of them). An empty table stays empty; other columns are ignored.
    """
    base = told_apart(stored(document_sets(docs, doc_id, text), "shingle-sets"))
    rows = base.where("n > 0").select(F.explode("prefix").alias("shingle"), "set_key")
    shared = rows.groupBy("shingle").agg(F.min("set_key").alias("region"), F.max("set_key").alias("other"), F.count("*").alias("held")).where("region < other").select("shingle", "region", "held")
    held = rows.join(shared, "shingle").distinct()
    sizes = base.where("n > 0").groupBy("set_key").agg(F.max("n").alias("n"), F.min(F.struct("doc_id", "row_hash")).alias("row"))
    per_set = Window.partitionBy("set_key")
    # In the order of all shingles from rare to frequent, partners meet before the last need - 1 shared ones.
    ranked = held.withColumns({"rank": F.row_number().over(per_set.orderBy("held", "shingle")), "shared": F.count("*").over(per_set)}).join(sizes, "set_key")
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / SHARED))
    alive = stored(ranked.where(F.col("rank") <= F.col("shared") - need + 1).groupBy("set_key").agg(F.first("row").alias("row"), F.first("n").alias("n"), F.collect_set("region").alias("regions")), "sets-with-partners")
    wanted = alive.select("set_key", F.coalesce("row.doc_id", F.lit(0)).alias("k"), F.col("row.doc_id").isNull().alias("z"), F.col("row.row_hash").alias("row_hash"))
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k"), F.col(doc_id).isNull().alias("z"), row_hash(text).alias("row_hash"), F.col(text).alias("text"))
    if alive.count() <= BROADCAST_ROWS:  # so many keys are known to be small; texts then stay where they are
        wanted = F.broadcast(wanted)
    sets = stored(full_sets(texts.join(wanted, ["k", "z", "row_hash"])).dropDuplicates(["set_key"]), "full-sets")
    members = alive.select("set_key", "n", F.explode("regions").alias("region"))
    links = region_links(members, sets, region_limit)
    roots = connected_components(reduce(DataFrame.unionByName, links))
    release(alive, sets, *links)
    known = base.where("n > 0").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("doc_id", "row_hash", "n", F.coalesce("root", "set_key").alias("root"))
    first = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("row_hash"))).alias("first"))
    out = known.join(first, "root").select(
        "doc_id", "row_hash", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash"))).alias("is_first"),
    )
    alone = base.where("n = 0").select("doc_id", "row_hash", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    return out.unionByName(alone)


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component: the smallest doc_id's (nulls last), once if it repeats.

    Rows without words are linked with nothing, so all of them stay, but for repeated rows of one id and text.
    """
    first = similarity_classes(docs, doc_id=doc_id, text=text).where("is_first").select(F.coalesce("doc_id", F.lit(0)).alias("__k"), F.col("doc_id").isNull().alias("__z"), F.col("row_hash").alias("__h"))
    keyed = docs.withColumns({"__k": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "__z": F.col(doc_id).isNull(), "__h": row_hash(text)})
    return keyed.join(first.dropDuplicates(), ["__k", "__z", "__h"], "left_semi").dropDuplicates(["__k", "__z", "__h"]).select(*docs.columns)

"""Exact removal of long repeated strings with a sparse suffix array.

A text is a sequence of symbols: its UTF-8 bytes, or its words. Every string of SPAN symbols holds an anchor: the
position of the least hash among its substrings of GRAM symbols (the first of equals). Anchors depend on the symbols
around them alone, so two copies of a string have corresponding anchors, and a string repeats exactly if around two
anchors of equal substrings the symbols agree l to the left and r to the right with l + r >= SPAN. Anchors whose
surroundings agree wholly (by a strong digest of their bytes) are one kind; the kinds of a substring are compared: the
suffixes at them are sorted deep-shallow, by multikey quicksort to a shallow depth and by blind tries beyond, and a
pass down the common prefixes of neighbours finds each kind's longest qualifying agreement.

A substring with more than GROUP_LIMIT kinds is not gathered in one place. Its kinds are dealt to bands by how far they
may agree to the left, so that two kinds that qualify share a group of some band, whose members agree in all but BAND - 1
symbols of SPAN; such groups are sorted like the others. Those that are still too large are dealt to bands of one
symbol, whose groups are equal strings of SPAN symbols.

What moves between machines are anchors, about two for each SPAN - GRAM symbols, the surroundings of one anchor of
each kind, and the texts: once to cut out the surroundings and once to remove the repeated parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, sliced, stored
from .hashing import SLICE, prefix_sums, spans_hash, word_spans

#: Bytes.
SPAN = 400
GRAM = 144
#: Symbols of eight bytes beyond the common substring that the quicksort looks at.
SHALLOW = 32
#: Different surroundings of one substring that are sorted in one place.
GROUP_LIMIT = 20_000
#: Widths of the bands that larger groups are dealt to, one after the other.
BANDS = (16, 1)
#: Bits of a position; the other bits of a hash choose the anchors.
PLACE = np.uint64((1 << 32) - 1)


class Symbols:
    """A text as symbols of ``width`` bytes: its bytes (1), or hashes of its words (8) with where they start and end."""

    def __init__(self, text: str | None, words: bool):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.codes = np.frombuffer(self.raw, np.uint8)
        self.width = 8 if words else 1
        if words:
            self.starts, self.ends, self.codes = word_spans(self.raw)

    def __len__(self) -> int:
        return len(self.codes)

    def bytes_of(self, run: list[int]) -> tuple[int, int]:
        """Where a run of symbols starts and ends in the text's bytes."""
        return (run[0], run[1]) if self.width == 1 else (int(self.starts[run[0]]), int(self.ends[run[1] - 1]))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(h)
    pad = -n % width
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` symbols; long data in slices that overlap."""
    out = []
    for at in range(0, max(0, len(data) - size + 1), SLICE):
        part = data[at : at + SLICE + size - 1]
        starts = np.arange(len(part) - size + 1)
        out.append(spans_hash(prefix_sums(part), starts, starts + size))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and substring hashes of the anchors of all runs of ``span`` symbols, in linear time.

    Hashes are compared by their upper bits, then by place, which is what the symbols of the run alone decide.
    """
    h = gram_hashes(data, gram)
    width = span - gram + 1
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = (sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), width) & PLACE).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def row_keys(doc_id: str, text: str) -> list[Column]:
    """Columns that tell rows apart: id, whether it is null, hash of the text. Rows equal in them are copies."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k"), F.col(doc_id).isNull().alias("z"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("h")]


KEYS = ["k", "z", "h"]


def anchor_table(rows: DataFrame, span: int, gram: int, words: bool) -> DataFrame:
    """``k, z, h, pos, gram, around`` of rows of ``k, z, h, text``: each anchor with its hash and its surroundings' digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, places, grams, arounds = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
            for value in batch.column(3):
                symbols = Symbols(value.as_py(), words)
                at, h = anchors(symbols.codes, span, gram)
                counts.append(len(at))
                if len(at):
                    places.append(at)
                    grams.append(h)
                    arounds += around_digests(symbols, at, span, gram)
            index = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(grams).view(np.int64)), pa.array(arounds, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(3)), *columns], names=[*KEYS, "pos", "gram", "around"])

    return rows.mapInArrow(scan, "k long, z boolean, h long, pos int, gram long, around binary")


def around_digests(symbols: Symbols, at: np.ndarray, span: int, gram: int) -> list[bytes]:
    """A digest of each anchor's surroundings, with how far they reach to the left."""
    data, width = memoryview(symbols.codes).cast("B"), symbols.width
    left = np.minimum(at, span - gram)
    starts, ends = ((at - left) * width).tolist(), ((at + span) * width).tolist()
    return [blake2b(data[a:b], digest_size=14).digest() + n.to_bytes(2, "little") for a, b, n in zip(starts, ends, left.tolist(), strict=True)]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A trie of strings that keeps only where they branch; order and common prefixes come from its leaves."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, None

    def insert(self, text: bytes, item: int) -> None:
        """A node is [depth, children by byte (-1: ended)] or a leaf (text, items)."""
        if self.root is None:
            self.root = (text, [item])
            return
        node = self.root
        while isinstance(node, list):  # blindly to some leaf
            key = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(key) or next(iter(node[1].values()))
        same = common_prefix(text, node[0])
        if same == len(text) == len(node[0]):
            node[1].append(item)
            return
        parent, key, here = None, None, self.root
        while isinstance(here, list) and here[0] < same:
            parent, key = here, text[here[0]] if here[0] < len(text) else -1
            here = here[1][key]
        leaf = (text, [item])
        if isinstance(here, list) and here[0] == same:
            here[1][text[same] if same < len(text) else -1] = leaf
            return
        other = node[0]
        branch = [same, {(other[same] if same < len(other) else -1): here, (text[same] if same < len(text) else -1): leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def in_order(self) -> list[tuple[int, int]]:
        """(item, length of the common prefix with the item before) in order; the first has the trie's depth."""
        out: list[tuple[int, int]] = []
        todo = [(self.root, self.depth)]
        while todo:
            node, shared = todo.pop()
            if isinstance(node, list):
                children = [node[1][k] for k in sorted(node[1])]
                todo += [(c, node[0]) for c in reversed(children[1:])]
                todo.append((children[0], shared))
            else:
                text, items = node
                out.append((items[0], shared))
                out += [(i, len(text)) for i in items[1:]]
        return out


def deep_shallow(texts: list[bytes], start: int, shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """Sort texts that agree in their first ``start`` bytes; (item, common prefix with the one before) in order.

    Multikey quicksort splits three ways by eight bytes at a time; groups that still agree at depth
    ``start + shallow`` go to a blind trie.
    """
    out: list[tuple[int, int]] = []
    todo = [(list(range(len(texts))), start, start)]
    while todo:
        items, depth, shared = todo.pop()
        if len(items) == 1:
            out.append((items[0], shared))
            continue
        if depth >= start + shallow or len(items) < 4:
            trie = BlindTrie(shared)
            for i in items:
                trie.insert(texts[i], i)
            out += trie.in_order()
            continue
        keys = {i: texts[i][depth : depth + 8] for i in items}
        pivot = sorted((keys[items[0]], keys[items[len(items) // 2]], keys[items[-1]]))[1]
        less, same, more = [], [], []
        for i in items:
            (less if keys[i] < pivot else more if keys[i] > pivot else same).append(i)
        low = max((common_prefix(keys[i], pivot) for i in less), default=0)
        # Neighbours across a split agree as far as the closest keys on its two sides do.
        groups = []
        if less:
            groups.append((less, depth, shared))
        # A short key ends its text: such texts are equal, which the trie takes as it is.
        groups.append((same, start + shallow if len(pivot) < 8 else depth + 8, depth + low if less else shared))
        if more:
            groups.append((more, depth, depth + max(common_prefix(keys[i], pivot) for i in more)))
        todo += reversed(groups)
    return out


def reaches(lefts: list[bytes], rights: list[bytes], gram: int, span: int, width: int = 1) -> list[tuple[int, int]]:
    """How far left and right of each anchor symbols repeat; (0, 0) if no run of ``span`` around it does.

    ``lefts`` are reversed by symbols. Going down the common prefixes of the sorted suffixes, anchors join into classes
    that agree in ever fewer symbols to the right; within a class the closest to the left stand next to each other in
    order of their left sides, and the smaller of two classes moves into the larger.
    """
    best = [[0, 0] for _ in lefts]

    def pair(i: int, j: int, right: int) -> None:
        left = common_prefix(lefts[i], lefts[j]) // width
        if left + right >= span:
            for k in (i, j):
                best[k][0], best[k][1] = max(best[k][0], left), max(best[k][1], right)

    order = [(i, shared // width) for i, shared in deep_shallow(rights, gram * width)]
    parent = list(range(len(order)))
    classes: list[list[tuple[bytes, int]]] = [[(lefts[i], i)] for i, _ in order]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n in sorted(range(1, len(order)), key=lambda n: -order[n][1]):
        shared = order[n][1]
        a, b = root(n - 1), root(n)
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        large = classes[a]
        for entry in classes[b]:
            at = bisect_left(large, entry)
            if at:
                pair(entry[1], large[at - 1][1], shared)
            if at < len(large):
                pair(entry[1], large[at][1], shared)
            large.insert(at, entry)
        classes[b] = []
        parent[b] = a
    return [tuple(x) for x in best]


KIND_SCHEMA = "gram long, around binary, left binary, right binary"


def surroundings(rows: DataFrame, span: int, gram: int, words: bool) -> DataFrame:
    """``gram, around, left, right`` of rows of ``text, spots``, spots being pos, gram and around of anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            for value, spots in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes = Symbols(value.as_py(), words).codes
                for s in spots:
                    p = s["pos"]
                    out.append((s["gram"], s["around"], codes[max(0, p - span + gram) : p][::-1].tobytes(), codes[p : p + span].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["gram", "around", "left", "right"])

    return rows.select("text", "spots").mapInArrow(scan, KIND_SCHEMA)


def group_reaches(parts: DataFrame, group: str, span: int, gram: int, width: int) -> DataFrame:
    """``gram, around, l, r`` for the kinds of each ``group``, sorted group by group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: object = None
        found: dict[bytes, list[tuple[int, bytes, bytes, bytes]]] = {}
        out: list[tuple[int, bytes, int, int]] = []

        def finish() -> None:
            for members in found.values():  # one, but for substrings of equal hashes
                if len(members) > 1:
                    for (g, around, _, _), (left, right) in zip(members, reaches([m[2] for m in members], [m[3] for m in members], gram, span, width), strict=True):
                        if right:
                            out.append((g, around, left, right))
            found.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["gram", "around", "l", "r"])

        for batch in batches:
            for own, g, around, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    finish()
                    name = own
                found.setdefault(right[: gram * width], []).append((g, around, left, right))
            yield flush()
        finish()
        yield flush()

    kinds = parts.select(F.col(group).alias("group"), "gram", "around", "left", "right")
    return kinds.repartition("group").sortWithinPartitions("group").mapInArrow(scan, "gram long, around binary, l int, r int")


def banded(parts: DataFrame, band: int, span: int, gram: int, width: int) -> DataFrame:
    """``gram, around, l, group``: each kind once for each band that it may qualify in, with the band's least reach.

    Two kinds that agree l to the left and SPAN - l to the right, at least, are in one group of the band of that l.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            rows: list[tuple] = []
            for g, around, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(0, min(len(left) // width, span - gram) + 1, band):
                    need = max(gram, span - (low + band - 1))
                    if len(right) >= need * width:
                        rows.append((g, around, low, blake2b(left[: low * width] + right[: need * width], digest_size=16).digest() + low.to_bytes(2, "little")))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["gram", "around", "l", "group"])

    return parts.select("gram", "around", "left", "right").mapInArrow(deal, "gram long, around binary, l int, group binary")


def kind_reaches(parts: DataFrame, sizes: DataFrame, span: int, gram: int, width: int, group_limit: int) -> DataFrame:
    """``gram, around, l, r`` of all kinds that qualify; ``sizes`` has ``gram, kinds``."""
    large = sizes.where(F.col("kinds") > group_limit).select("gram")
    if not large.head(1):
        return group_reaches(parts, "gram", span, gram, width)
    found = group_reaches(parts.join(large, "gram", "left_anti"), "gram", span, gram, width)
    rest = parts.join(large, "gram", "left_semi")
    for band in BANDS:
        dealt = banded(rest, band, span, gram, width)
        # Most groups are of one kind; digests alone move until it is known which are not.
        counted = stored(dealt.groupBy("group").agg(F.count("*").alias("kinds")).where("kinds > 1"), "band-sizes")
        if band == 1:  # a group is one string of the whole span
            equal = dealt.join(counted, "group", "left_semi").select("gram", "around", "l", (F.lit(span) - F.col("l")).alias("r"))
            found = found.unionByName(equal)
            break
        few, many = counted.where(F.col("kinds") <= group_limit), counted.where(F.col("kinds") > group_limit)
        members = dealt.join(few, "group", "left_semi").select("gram", "around", "group").join(parts, ["gram", "around"])
        found = found.unionByName(group_reaches(members, "group", span, gram, width))
        if not many.head(1):
            break
        rest = parts.join(dealt.join(many, "group", "left_semi").select("gram", "around").distinct(), ["gram", "around"], "left_semi")
    return found.groupBy("gram", "around").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def repeated_ranges(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, words: bool = False, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``k, z, h, ranges`` of the rows that hold repeated strings; ranges are [start, end) in symbols, in any order."""
    rows = docs.select(*row_keys(doc_id, text), F.col(text).alias("text")).where(F.octet_length("text") >= (2 * span - 1 if words else span))
    every = stored(anchor_table(rows, span, gram, words), "anchors")
    # Only anchors whose substring is elsewhere too go on; a substring is counted before its anchors move. What is
    # counted is written, so that a frequent substring's anchors can be split over tasks in the join.
    shared = stored(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "shared-substrings")
    table = stored(every.join(shared, "gram"), "shared-anchors")
    release(every, shared)
    kinds = stored(table.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "pos")).alias("at")), "anchor-kinds")
    sizes = stored(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "substrings")
    several = kinds.join(sizes.select("gram"), "gram")
    spots = several.groupBy(*(F.col(f"at.{k}").alias(k) for k in KEYS)).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "gram", "around")).alias("spots"))
    # Of copies of a row one is enough, but taking them all is right too: their surroundings are the same.
    parts = stored(surroundings(rows.join(spots, KEYS), span, gram, words).dropDuplicates(["gram", "around"]), "surroundings")
    found = kind_reaches(parts, sizes, span, gram, 8 if words else 1, group_limit)
    whole = kinds.where("n > 1").select("gram", "around", F.lit(span - gram).alias("l"), F.lit(span).alias("r"))
    marks = stored(whole.unionByName(found).groupBy("gram", "around").agg(F.max("l").alias("l"), F.max("r").alias("r")), "reaches")
    release(parts, sizes, kinds)
    start = F.greatest(F.col("pos") - F.col("l"), F.lit(0))
    ranges = table.join(marks, ["gram", "around"]).groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct(start.alias("start"), (F.col("pos") + F.col("r")).alias("end")))).alias("ranges"))
    out = stored(ranges, "ranges")
    release(table, marks)
    return out


def merged_ranges(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in ranges:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def removed_ranges(ranges: list[dict] | None, size: int, span: int) -> list[list[int]]:
    """Maximal removed runs; whole surroundings end with the text, and count only if they hold a whole string."""
    if not ranges:
        return []
    cut = [(r["start"], min(r["end"], size)) for r in ranges]
    return merged_ranges(sorted((a, b) for a, b in cut if b - a >= span))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, words: bool = False, group_limit: int = GROUP_LIMIT, digest: bool = False, keep_text: bool = False) -> DataFrame:
    """``docs`` with every symbol removed that a repeated string of ``span`` symbols covers.

    Symbols are UTF-8 bytes, or with ``words`` runs of bytes other than space and tab to carriage return, told apart by
    64-bit hashes; with words a removed run goes from its first word's start to its last one's end, so characters stay
    whole. A null text counts as empty; a string repeats if it also starts anywhere else in the table, the same row
    included, and repeats are judged on the input. Repeated rows lose all that is long enough. An empty table stays
    empty, other columns pass through. With ``digest`` the result is ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` of each row, and with ``keep_text`` too the kept text as ``text`` after them; else ``docs`` with the
    kept text (bytes that no longer make a character become U+FFFD; a null text stays null).
    """
    ranges = repeated_ranges(docs, doc_id=doc_id, text=text, span=span, gram=gram, words=words, group_limit=group_limit)
    names = [c for c in docs.columns]
    keyed = docs.select(*docs.columns, *(c.alias(f"__{n}") for c, n in zip(row_keys(doc_id, text), KEYS, strict=True)))
    ranges = ranges.select(*(F.col(n).alias(f"__{n}") for n in KEYS), F.col("ranges").alias("__ranges"))
    joined = keyed.join(ranges, [f"__{n}" for n in KEYS], "left").select(*names, "__ranges")

    facts_names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if keep_text else [])]
    texts_out = keep_text or not digest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, facts = [], []
            texts = batch.column(batch.schema.get_field_index(text))
            for value, found in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                symbols = Symbols(value.as_py(), words and bool(found))
                data = symbols.raw
                runs = [symbols.bytes_of(r) for r in removed_ranges(found, len(symbols), span)]
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else data
                if digest:
                    facts.append((len(data), len(data) - len(kept), len(runs), sha256(kept).hexdigest()))
                if texts_out:
                    out.append((kept.decode("utf-8", "replace") if runs else value.as_py()) if value.is_valid else None)
            if digest:
                columns = list(zip(*facts, strict=True)) or [()] * 4
                arrays = [batch.column(batch.schema.get_field_index(doc_id)), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(out, pa.string())] if keep_text else [])], names=facts_names)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    if digest:
        return joined.select(F.col(doc_id).cast("long").alias(doc_id), text, "__ranges").mapInArrow(scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if keep_text else ""))
    return joined.mapInArrow(scan, T.StructType([f for f in docs.schema.fields]))

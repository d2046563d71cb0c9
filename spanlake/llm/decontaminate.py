"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words and an error budget of k words is split into k + 1 pieces. A passage within distance k
leaves at least one piece untouched, so every leak has an exact piece hit; hits come from one Aho-Corasick pass
over the document. Each hit fixes a window of the document, which Myers' bit-parallel recurrence verifies.

Words are maximal runs of letters, digits and underscores, compared in lower case after NFC, so case, line
breaks and punctuation cost nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Share of an item's words that may differ.
ERROR_RATE = 0.2
#: Words of test items matched in one pass; larger test sets are matched block by block.
BLOCK_WORDS = 400_000

MATCH_SCHEMA = "item_id long, distance long, item_words long, n_regions long, span_start long, span_end long"


def normal_form(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def words_of(text: str) -> list[str]:
    return WORD.findall(normal_form(text).lower())


def budget(n_words: int, rate: float) -> int:
    return int(n_words * rate)


def pieces(n_words: int, errors: int) -> list[tuple[int, int]]:
    """Start and end of the ``errors + 1`` nearly equal pieces of an item."""
    cuts = [n_words * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers_search(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text`` and the first end where it is reached.

    Python integers are the bit vectors, so a pattern may be of any length. An empty text costs the pattern.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, at = full, 0, m, m, 0
    for j, word in enumerate(text):
        eq = masks.get(word, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1, hn << 1
        vp = (hn | ~(d0 | hp)) & full
        vn = hp & d0 & full
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """The pieces of one block of test items in an Aho-Corasick automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(item_id, words_of(text or "")) for item_id, text in items]
        self.errors = [budget(len(words), rate) for _, words in self.items]
        where: dict[str, list[tuple[int, int, int]]] = {}
        for n, (_, words) in enumerate(self.items):
            for start, end in pieces(len(words), self.errors[n]):
                if end > start:
                    where.setdefault(f" {' '.join(words[start:end])} ", []).append((n, start, end - start))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, owners)
        self.empty = not where
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """A tuple in the order of MATCH_SCHEMA for each item that ``text`` holds."""
        if self.empty or not text:
            return []
        words = words_of(text)
        if not words:
            return []
        line = f" {' '.join(words)} "
        hits = list(self.automaton.iter(line))
        if not hits:
            return []
        ends, at = {}, 0
        for i, word in enumerate(words):
            at += len(word) + 1
            ends[at] = i + 1
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, owners in hits:
            for n, offset, length in owners:
                start, k = ends[end] - length - offset, self.errors[n]
                windows.setdefault(n, []).append((max(0, start - k), min(len(words), start + len(self.items[n][1]) + k)))
        found = []
        for n, spans in windows.items():
            item_id, pattern = self.items[n]
            best, regions = None, 0
            for lo, hi in merged(spans):
                distance, end = myers_search(pattern, words[lo:hi])
                if distance <= self.errors[n]:
                    regions += 1
                    if best is None or distance < best[0]:
                        size = myers_search(pattern[::-1], words[lo : lo + end][::-1])[1]
                        best = distance, lo + end - size, lo + end
            if best:
                found.append((item_id, best[0], len(pattern), regions, best[1], best[2]))
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(normal_form(text))]
        if len(spans) != len(words):  # lower case changed what is a word; then count words instead of characters
            spans = [(i, i + 1) for i in range(len(words))]
        return [(i, d, m, r, spans[lo][0] if lo < hi else 0, spans[hi - 1][1] if lo < hi else 0) for i, d, m, r, lo, hi in found]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


@lru_cache(maxsize=2)
def matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """Blocks of test items of at most ``block_words`` words (or one item), one at a time on the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(item_id).cast("long"), F.col(text)).where(F.length(text) > 0).orderBy(item_id, text)
    for key, value in rows.toLocalIterator():
        n = value.count(" ") + 1
        if block and size + n > block_words:
            yield tuple(block)
            block, size = [], 0
        block.append((key, value))
        size += n
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row and test item that it holds within the item's error budget.

    Columns: ``doc_id, item_id, distance, item_words, n_regions, span_start, span_end``; the span, in characters
    of the NFC text, is the best region's. Null or empty texts and items without words match nothing; equal items
    each match; repeated rows each report; a null id stays null. Other columns are ignored.
    """
    schema = f"doc_id long, {MATCH_SCHEMA}"
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text, block_words):

        def scan(batches: Iterator[pa.RecordBatch], block: tuple = block) -> Iterator[pa.RecordBatch]:
            find = matcher(block, rate).matches
            for batch in batches:
                rows = [(key, *m) for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in find(value.as_py())]
                names = ["doc_id", *(part.split()[0] for part in MATCH_SCHEMA.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(names), names=names)

        part = base.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item. Rows with null or empty text stay."""
    out = docs
    for block in item_blocks(items, item_id, item_text, block_words):

        def keep(batches: Iterator[pa.RecordBatch], block: tuple = block) -> Iterator[pa.RecordBatch]:
            find = matcher(block, rate).matches
            for batch in batches:
                yield batch.filter(pa.array([not find(v.as_py()) for v in batch.column(batch.schema.get_field_index(text))], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out



"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: position p of the table holds words of 64 bits whose bit l belongs
to language l, as many words as the languages need, so one lookup per hash and a bitwise AND return all languages that contain an n-gram. A text's score
for a language is the count of its n-grams that the language's filter contains, less the false positives that the
filter's fill predicts; the largest share decides.

N-grams are runs of 2 to 4 letters within a word, in lower case, word ends marked. A language holds an n-gram whose
rate in it is at least MEMBER_SHARE of the n-gram's largest rate over all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, sliced, stored

#: Labelled rows to fit on, about: a hash of the id chooses them.
FIT_ROWS = 6000
#: Rows of each language to fit on at least, about, so that a rare language is learned in a table of any size.
LANGUAGE_ROWS = 200
#: N-grams kept for each language, the most frequent first; with the number of languages it bounds the model.
MAX_NGRAMS = 40_000
MEMBER_SHARE = 0.5
#: How often an n-gram occurs at least in the rows that a language is fitted on, if any of the language's does.
MIN_COUNT = 5
BITS = 1 << 20
HASHES = 3
SIZES = (2, 3, 4)
UNDETERMINED = "und"
#: Letters scored at a time, so that a very long text needs bounded memory.
SLICE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one 0 in place of each run of other characters, 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(1, np.uint32)
    kinds, inverse = (np.arange(128, dtype=np.uint32), codes) if codes.max() < 128 else np.unique(codes, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in kinds.tolist()])[inverse]
    codes = np.where(letters, codes, 0).astype(np.uint32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    return np.concatenate([np.zeros(1, np.uint32), codes[keep], np.zeros(1, np.uint32)])


def ngram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram that holds no word boundary but at its ends."""
    out = []
    c = codes.astype(np.uint64)
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ c[j : len(c) - n + 1 + j]) * _MIX
            h ^= h >> np.uint64(29)
        inner = np.ones(len(h), bool)
        for j in range(1, n - 1):
            inner &= c[j : len(c) - n + 1 + j] != 0
        if n == 2:
            inner &= (c[:-1] != 0) | (c[1:] != 0)
        out.append(h[inner])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def positions(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The filter positions of each n-gram, one array for each hash function."""
    second = (hashes * _MIX) | np.uint64(1)
    for k in range(HASHES):
        yield ((hashes + np.uint64(k) * second) >> np.uint64(17)) & np.uint64(BITS - 1)


class LanguageFilters:
    """The fitted model: language names and the bit-sliced table."""

    def __init__(self, names: list[str], members: list[np.ndarray]):
        self.names = names
        self.table = np.zeros((-(-len(names) // 64), BITS), np.uint64)
        for n, hashes in enumerate(members):
            for at in positions(hashes):
                np.bitwise_or.at(self.table[n // 64], at, np.uint64(1) << np.uint64(n % 64))
        self.false_rate = np.array([float(np.mean(self.table[n // 64] >> np.uint64(n % 64) & np.uint64(1))) ** HASHES for n in range(len(names))])

    def languages_of(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """Bit l is set if the filter of language l, counted from the word's first, contains the n-gram."""
        mask = None
        for at in positions(hashes):
            got = self.table[word][at]
            mask = got if mask is None else mask & got
        return mask

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the corrected counts; UNDETERMINED and 0 without letters or languages."""
        codes = letter_codes(text or "")
        if not codes.any() or not self.names:
            return UNDETERMINED, 0.0
        counts, total = np.zeros(len(self.names)), 0
        for start in range(0, len(codes), SLICE):
            hashes = ngram_hashes(codes[start : start + SLICE + max(SIZES) - 1])
            masks = [self.languages_of(hashes, word) for word in range(len(self.table))]
            total += len(hashes)
            counts += [np.count_nonzero(masks[n // 64] >> np.uint64(n % 64) & np.uint64(1)) for n in range(len(self.names))]
        net = np.maximum(0, (counts - total * self.false_rate) / (1 - self.false_rate))
        best = int(np.argmax(net))
        return self.names[best], float(net[best] / net.sum()) if net.sum() > 0 else 0.0


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, max_ngrams: int = MAX_NGRAMS) -> LanguageFilters:
    """Fit on about ``fit_rows`` rows of ``labelled`` that have a text and a label, and on all of its languages.

    A hash of the key chooses the rows, so the choice is the same in any order of the rows; of each language about
    LANGUAGE_ROWS at least are chosen, or all that there are. N-grams are counted
    where the rows are; the driver gets at most ``max_ngrams`` for each language.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = stored(known.groupBy(lang).agg(F.count("*").alias("language_rows")), "languages")
    n = sizes.agg(F.sum("language_rows")).first()[0]
    if not n:
        return LanguageFilters([], [])
    share = F.greatest(F.lit(min(1.0, fit_rows / n)), F.least(F.lit(1.0), LANGUAGE_ROWS / F.col("language_rows")))
    chosen = known.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(sizes.withColumnRenamed(lang, "lang")), "lang")
    chosen = chosen.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.ceil(share * (1 << 30))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for name in sorted(set(langs)):
                found = [ngram_hashes(letter_codes(t.as_py())) for t, x in zip(batch.column(1), langs, strict=True) if x == name]
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counted = stored(chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-ngram-counts")
    # A language of few n-grams, all of them rarer, keeps its most frequent ones.
    least = counted.groupBy("lang").agg(F.least(F.max("n"), F.lit(MIN_COUNT)).alias("least"))
    grams = stored(counted.join(F.broadcast(least), "lang").where(F.col("n") >= F.col("least")).drop("least"), "language-ngrams")
    release(counted)
    totals = {r["lang"]: r["t"] for r in grams.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    names = sorted(totals)
    counts = {}
    for name in names:
        top = grams.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(max_ngrams).select("gram", "n").collect()
        counts[name] = {r["gram"]: r["n"] / totals[name] for r in top}
    best: dict[int, float] = {}
    for rates in counts.values():
        for gram, rate in rates.items():
            best[gram] = max(rate, best.get(gram, 0.0))
    return LanguageFilters(names, [np.array([g for g, r in counts[x].items() if r >= MEMBER_SHARE * best[g]], np.int64).view(np.uint64) for x in names])


def identify(docs: DataFrame, model: LanguageFilters, *, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with a language and a score of 0 to 1 for each row's whole text; equal texts get equal answers.

    Null, empty and letterless texts get UNDETERMINED and 0, as do all rows where the model knows no language.
    Other columns pass through; columns of the two new names are replaced.
    """
    docs = docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of BITS words, whatever the corpus

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text) if at is None else at
            found = [shared.value.predict(t.as_py()) for t in batch.column(at)]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out of fitting; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))

"""The pipeline's stages: what each must keep and drop, and its whole against a step-by-step version."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlake.llm import decontaminate, langid
from spanlake.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r = random.Random(8)
    make = lambda n: " ".join("".join(r.choice(["th", "er", "on", "an", "ti", "es"]) for _ in range(r.randint(2, 5))) for _ in range(n))
    clean = [make(80) for _ in range(12)]
    item, passage = make(30), make(90)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(20, None), (21, "123 !!"), (22, clean[3]), (23, clean[4] + " tail"), (24, make(40) + " " + item + " " + make(40)), (25, make(50) + passage + make(30)), (26, make(20) + passage + make(60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, str(tmp_path)), f"test-{n}")
        kept[name] = {x.doc_id: x for x in docs.collect()}
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [set(v) for v in kept.values()]
    assert ids[0] == set(range(12)) | {22, 23, 24, 25, 26}
    assert ids[1] == ids[0] - {22, 23} and ids[2] == ids[1] and ids[3] == ids[1] - {24} == ids[4]
    cut = kept["suffix-array dedup"]
    assert all(cut[i].text == clean[i] for i in range(12))
    assert all(passage[20:-20] not in cut[i].text and cut[i].n_chars == len(cut[i].text) for i in (25, 26))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in again.collect()) == Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in docs.collect())


def test_language_stage_follows_the_model(spark):
    rows = [(i, "the other one and this there", "en") for i in range(40)] + [(40, "Ωψφ ξζ", "en"), (41, "12 !", "en"), (42, None, None), (43, "another", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS)
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {*range(40), 43}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x.doc_id for x in corpus_pipeline.language_id(spark, unlabelled, "").collect()} == {*range(41), 43}


def pieces_by_force(rows, items):
    """The pipeline's pieces of (doc_id, text, lang) rows, stage by stage in plain Python."""
    # Language: what is learned are the n-grams of labelled rows that are not held out.
    counts = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(langid.ngram_hashes(langid.letter_codes(text)).tolist())
    known = {h for c in counts.values() for h, n in c.items() if n >= min(langid.MIN_COUNT, max(c.values()))}
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and known & set(langid.ngram_hashes(langid.letter_codes(r[1])).tolist())]
    # Near duplicates: the first of each component of texts that share four fifths of their five-word shingles.
    sets = []
    for _, text, _ in rows:
        words = text.lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    rows = [r for k, r in enumerate(rows) if r[0] == min(rows[j][0] for j in range(len(rows)) if label[j] == label[k])]
    # Passages of over 50 words that stand anywhere else as well.
    words = [r[1].split() for r in rows]
    runs = Counter(tuple(w[k : k + 51]) for w in words for k in range(len(w) - 50))
    texts = {}
    for (i, _, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 50):
            if runs[tuple(w[k : k + 51])] > 1:
                gone[k : k + 51] = [True] * 51
        texts[i] = [x for x, g in zip(w, gone, strict=True) if not g]

    def distance(pattern, text):
        best = [*range(len(pattern) + 1)]
        least = best[-1]
        for word in text:
            row = [0]
            for k, p in enumerate(pattern):
                row.append(min(best[k] + (p != word), best[k + 1] + 1, row[-1] + 1))
            best, least = row, min(least, row[-1])
        return least

    patterns = [decontaminate.words_of(t) for t in items]
    texts = {i: w for i, w in texts.items() if not any(distance(p, decontaminate.words_of(" ".join(w))) <= int(len(p) * decontaminate.ERROR_RATE) for p in patterns)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for i, w in texts.items():
        ids = [*tokenizer.encode(" ".join(w), add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            out[i, n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_against_brute_force(spark, tmp_path, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(["th", "er", "on", "an", "ti", "es", "ré"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    item, passages = make(25), [make(n) for n in (50, 51, 70, 120)]
    rows = [(0, None, "en"), (1, "12 34 !", "en"), (2, "", None), (3, "Ωψφ ξζ", "el")]
    for i in range(4, 45):
        text = make(r.randint(3, 120))
        if r.random() < 0.4:
            text = make(r.randint(0, 60)) + r.choice(passages) + make(r.randint(0, 60))
        if r.random() < 0.15:
            leak = list(item)
            leak[r.randrange(25)] = "other"
            text = text + leak + make(10)
        if r.random() < 0.25 and i > 6:
            text = (rows[r.randrange(4, i)][1] or "x").split()
            if r.random() < 0.6:
                text[r.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), r.choice(["en", "en", None])))
    rows.append((45, " ".join(make(6000)), "en"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = pieces_by_force(rows, [" ".join(item)])
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in places.values():
        assert sum(n for _, n in v) <= 4096 and [a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))]

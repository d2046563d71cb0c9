"""The training-data operators against brute force, on small tables with nulls, ties, copies and odd texts."""

import hashlib
import random
import re
import string
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlake.llm import blockcoder, decontaminate, fingerprint, html, jaccard, langid, packing, queries, rangecoder, suffixes, tokenfiles, tokens, urls, warc
from spanlake.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(seed=0, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    texts = [None, "", " \n ", "word", "Word", "a b c d", "@@@ 12", "x" * 3000]
    while len(texts) < n:
        text = [r.choice(words) for _ in range(r.randint(1, 120))]
        texts.append(" ".join(text))
        if r.random() < 0.5:
            copy = list(text)
            copy[r.randrange(len(copy))] = "changed"
            texts += [" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy)] * r.randint(1, 2)
    rows = [(i, t, r.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[10], (None, texts[12], "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(3)


def edit_distance_in(pattern, text):
    best = list(range(len(pattern) + 1))
    least = best[-1]
    for word in text:
        row = [0]
        for i, p in enumerate(pattern):
            row.append(min(best[i] + (p != word), best[i + 1] + 1, row[-1] + 1))
        best, least = row, min(least, row[-1])
    return least


def test_decontamination(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 10, 30, 90])))) for i in range(12)] + [(12, None), (13, "?!"), (14, "w1 w2")]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if i % 2:
            leak = items[r.randrange(12)][1].split()
            for _ in range(r.randint(0, 4)):
                leak[r.randrange(len(leak))] = "other"
            at = r.randint(0, len(words))
            words[at:at] = leak
        rows.append((i, ", ".join(words).upper() if i % 3 else " ".join(words)))
    rows += [(60, None), (61, ""), (None, items[2][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, text in rows:
        for i, item in items:
            pattern = decontaminate.words_of(item or "")
            if pattern:
                distance = edit_distance_in(pattern, decontaminate.words_of(text or ""))
                if distance <= decontaminate.budget(len(pattern), decontaminate.ERROR_RATE) and text:
                    want[d, i] = distance
    for block_words in (decontaminate.BLOCK_WORDS, 20):
        got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.find_leaks(docs, bench, block_words=block_words).collect()}
        assert got == want
    kept = {x.doc_id for x in decontaminate.drop_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    import bisect

    for seed in range(40):
        r = random.Random(seed)
        capacity = r.choice([7, 40, 4096])
        lengths = [min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(r.choice([0, 1, 9, 400]))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            i = bisect.bisect_left(rooms, n)
            bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - n)
        used = {}
        for length, lo, hi, per, first, offset in packing.plan_packing(Counter(lengths), capacity):
            for k in range(hi - lo):
                used.setdefault(first + k // per, []).append((offset + k % per * length, length))
        assert sorted(capacity - sum(n for _, n in v) for v in used.values()) == rooms
        for v in used.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False))


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.tokenized_pieces(docs, tokenizer=path, capacity=64).cache()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, text, *_ in some_docs():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 64)):
            want[i, n, at, np.array(ids[at : at + 64], "<u4").tobytes()] += 1
    assert Counter((p.doc_id, p.piece, p.start, bytes(p.ids)) for p in pieces.collect()) == want
    placed = packing.place(pieces, capacity=64).collect()
    assert len(placed) == sum(want.values())
    by = {}
    for p in placed:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for v in by.values():
        assert sum(n for _, n in v) <= 64 and [a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))]
    whole = packing.sequences(packing.place(pieces, capacity=64)).collect()
    assert sum(len(w.ids) for w in whole) == 4 * sum(p.length for p in placed)
    assert packing.place(pieces.where("false")).count() == 0
    clashing = pieces.withColumns({"sequence_id": F.lit("x"), "offset": F.lit(-1.5), "p_l": F.lit(1)})
    again = packing.place(clashing, capacity=64)
    assert again.columns == [*pieces.columns, "p_l", "sequence_id", "offset"] and again.agg(F.min("offset"), F.count("sequence_id")).first()[:] == (0, len(placed))


@pytest.mark.parametrize("kind,name", [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_token_memo_equals_the_tokenizer(kind, name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = ["", " ", "a　b\x1c c\r\n\r\n  d", "İstanbul ΑΣ Σ. é é!x", "  \n\n x\ty \n", "it's we'LL don't 1234 ½ <|endoftext|> a", "Ab1!2?? ß× µm ÿ¿ a_b x's''s", None]
    texts += ["".join(r.choice(string.printable + "éßİσ́ ") for _ in range(80)) for _ in range(200)]
    for text, ids in zip(texts, tokens.whole_texts(path, kind).encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [7], [0, 50256, 0], [3] * 9000, list(range(300)) * 40, np.random.default_rng(1).integers(0, 50257, 20000).tolist(), (np.random.default_rng(2).zipf(1.3, 20000) % 50257).tolist()])
def test_range_coder_round_trip(ids):
    blocks = rangecoder.encode_blocks(np.array(ids, np.int64), 50257, block=4096)
    assert rangecoder.decode_blocks(blocks, 50257).tolist() == ids
    for k in range(len(blocks)):  # blocks stand alone
        assert rangecoder.decode_blocks(blocks[k : k + 1], 50257).tolist() == ids[4096 * k : 4096 * (k + 1)]
    if len(ids) > 1000:
        damaged = bytearray(blocks[0])
        damaged[19] ^= 0x40  # lower bits of the code may have room to move within the same ids
        with pytest.raises(ValueError):
            rangecoder.decode_blocks([bytes(damaged)], 50257)


@pytest.mark.parametrize("vocabulary", [1, 2, 200_000, rangecoder.LARGEST])
def test_range_coder_of_any_vocabulary(vocabulary):
    ids = np.minimum(np.random.default_rng(3).zipf(1.2, 3000 if vocabulary < 1 << 20 else 300), vocabulary) - 1
    assert rangecoder.decode_blocks(rangecoder.encode_blocks(ids, vocabulary, block=1000), vocabulary).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        rangecoder.encode_blocks(np.array([vocabulary]), vocabulary)
    with pytest.raises(ValueError):
        rangecoder.encode_blocks(np.array([0]), rangecoder.LARGEST + 1)


def test_range_coder_compresses_better_than_zlib():
    r = random.Random(5)
    words = ["".join(r.choice(["th", "er", "on", "an", "ti", "es", "re"]) for _ in range(r.randint(1, 4))) for _ in range(2000)]
    texts = [" ".join(r.choices(words, [1 / (i + 3) for i in range(2000)], k=150)) for _ in range(200)]
    ids = np.concatenate([np.append(x, 0) for x in tokens.whole_texts(public_tokenizers.path("byte_bpe_50k.json"), "byte").encode(texts)])
    blocks = rangecoder.encode_blocks(ids, 50257)
    plain = [zlib.compress(ids[at : at + rangecoder.BLOCK].astype("<u2").tobytes(), 9) for at in range(0, len(ids), rangecoder.BLOCK)]
    assert sum(map(len, blocks)) < 0.95 * sum(map(len, plain))


def test_blocks_do_not_depend_on_lanes(monkeypatch):
    ids = np.random.default_rng(4).zipf(1.3, 12_000) % 5000
    blocks = rangecoder.encode_blocks(ids, 5000, block=1000)
    monkeypatch.setattr(rangecoder, "LANES", 5)
    assert rangecoder.encode_blocks(ids, 5000, block=1000) == blocks


def test_order_one_learns_frequencies():
    """Two ids follow each id, one three times as often: far fewer bits than order 0 needs, and about what they should take."""
    r = np.random.default_rng(6)
    ids = [0]
    for _ in range(8191):
        ids.append((ids[-1] * 7 + (1 if r.random() < 0.75 else 5)) % 1000)
    bits = 8 * len(rangecoder.encode_blocks(np.array(ids), 1000)[0]) / len(ids)
    assert bits < 3.5


def test_blocks_of_columns_are_those_of_the_range_coder(spark):
    """Byte for byte, whatever the ids and the vocabulary, and back; damaged ones fail."""
    r = np.random.default_rng(7)
    for vocabulary in (1, 2, 300, 50257, rangecoder.LARGEST):
        parts = [np.minimum(r.zipf(a, n), vocabulary) - 1 for a in (1.05, 1.3, 3) for n in (1, 31, 32, 33, 500, 4096)]
        parts += [np.zeros(4096, np.int64), np.arange(4096) % vocabulary, r.integers(0, vocabulary, 4096), np.tile(r.integers(0, vocabulary, 9), 400)]
        rows = [(k, bytearray(ids.astype("<u4").tobytes())) for k, ids in enumerate(parts)] + [(len(parts), None), (len(parts) + 1, bytearray())]
        plain = spark.createDataFrame(rows, "k int, ids binary")
        coded = plain.select("k", "ids", blockcoder.encoded(spark, F.col("ids"), vocabulary).alias("code"))
        got = {x.k: x for x in coded.withColumn("back", blockcoder.decoded(spark, F.col("code"), vocabulary)).collect()}
        for k, ids in enumerate(parts):
            assert [bytes(got[k].code)] == rangecoder.encode_blocks(ids, vocabulary), (vocabulary, k)
        assert all(x.back == x.ids for x in got.values()) and got[len(parts)].code is None and got[len(parts) + 1].back == b""
        beyond = spark.createDataFrame([(bytearray(np.array([vocabulary], "<u4").tobytes()),)], "ids binary")
        with pytest.raises(Exception, match="lies beyond the vocabulary"):
            beyond.select(blockcoder.encoded(spark, F.col("ids"), vocabulary)).collect()
    good = rangecoder.encode_blocks(r.integers(0, 50257, 4096), 50257)[0]
    flipped = good[:19] + bytes([good[19] ^ 0x40]) + good[20:]
    endless = good[:4] + b"\xff\xff\xff\x7f" + good[8:]
    for bad in (flipped, endless, good[:-4], good[:10], b"", b"none" + good[4:]):
        with pytest.raises(Exception, match="not a block of token ids|do not have its checksum"):
            spark.createDataFrame([(bytearray(bad),)], "code binary").select(blockcoder.decoded(spark, F.col("code"), 50257)).collect()


@pytest.mark.parametrize(("chunks", "group"), [(400_000, 2_000_000), (100, 300)])
def test_ids_of_texts_cut_all_at_once(monkeypatch, chunks, group):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", chunks)
    monkeypatch.setattr(tokens, "GROUP_CHARS", group)
    r = random.Random(8)
    pieces = [" ", " ", "  ", "\n", "\t", "\r", "'", "'s", "'ll", "''", "a", "the", "Zé", "ñ", "0", "12", ".", ",", "-", "_", "`", "\0", "日", "×", "\xa0", "<|endoftext|>"]
    texts = ["".join(r.choices(pieces[:-5] if r.random() < 0.8 else pieces, k=r.randint(0, 12))) for _ in range(20_000)]
    texts += ["a  ", "b", "", "", " ", "c", "a \n", "\n b", "", "é" * 5000]
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    encoder = tokens.ByteTexts(path)
    for text, encoding, ids in zip(texts, whole, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoding.ids, text
    assert len(encoder.memo) <= chunks + 2 * len(pieces) ** 2
    assert [x.tolist() for x in encoder.encode([None, "", None])] == [[], [], []]


def test_token_files_in_many_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", 64)
    monkeypatch.setattr(rangecoder, "LANES", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = {x.doc_id: x.ids_crc32 for x in tokenfiles.round_trip(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), tokenizer=path).collect()}
    tokenizer = Tokenizer.from_file(path)
    for i, text, *_ in some_docs()[:-3]:
        assert whole[i] == zlib.crc32(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())


def test_token_files(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PART_BYTES", 2000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted(map(tuple, tokenfiles.round_trip(docs, tokenizer=path).collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == sorted((d[0] for d in some_docs()), key=lambda k: (k is not None, k))
    at = 0
    texts = {}
    for i, text, *_ in some_docs():
        texts.setdefault(i, []).append(text)
    for i, start, n, crc in got:
        ids = [*tokenizer.encode(texts[i].pop() or "", add_special_tokens=False).ids, 0]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert tokenfiles.round_trip(docs.where("false"), tokenizer=path).count() == 0


def test_language_id(spark):
    r = random.Random(4)
    parts = {"aa": ["th", "er", "ing", "the"], "bb": ["sch", "ung", "der", "ein"], "cc": ["ción", "os", "mente", "que"]}
    make = lambda x, n: " ".join("".join(r.choice(parts[x]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, make(x, r.randint(5, 60)), x) for i, x in enumerate(r.choice(list(parts)) for _ in range(400))]
    rows += [(400, None, "aa"), (401, "", "aa"), (402, "12 !? 34", "aa"), (403, "sching", None), (None, make("bb", 30), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("taken"))
    model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(df, model).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    by = {x.doc_id: x.lang_pred for x in out}
    assert [by[i] for i in (400, 401, 402)] == ["und"] * 3 and by[403] != "und"
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(by[i] == rows[i][2] for i in held) >= 0.97 * len(held)
    grams = langid.ngram_hashes(langid.letter_codes("thing"))
    assert all(model.languages_of(grams) >> np.uint64(0) & np.uint64(1))
    empty = langid.fit(df.where("false"))
    assert {x.lang_pred for x in langid.identify(df, empty).collect()} == {"und"}


def test_warc(spark):
    big, small = "é" * 700, "x" * 999
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: 1%", big), (3, None, big), (2, "u", small), (4, "u", small), (6, "n", None), (7, "n", ""), (5, "http://b/", big), (None, "z", big), (8, "y", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path, records = warc.archive(pages)
    got = records.collect()
    assert len(got) == len(rows)
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest) for x in got) == Counter((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows)
    assert sorted((str(x.page_id), x.refers_to) for x in got if x.record_type == "revisit") == [("1", 5), ("3", 5), ("5", 5), ("None", 5)]
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == 4
    whole = warc.read_records(spark, path).collect()
    for w in whole:
        head, _, block = bytes(w.record).partition(b"\r\n\r\n")
        n = int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and block[n:] == b"\r\n\r\n" and b"\nX: 1" not in head
    assert warc.archive(pages.where("false"))[1].count() == 0


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def test_url_filters(spark):
    r = random.Random(5)
    hosts = ["com", "Example.com", "a.example.com", "notexample.com", "x.y.net", "example.net", "", "org", "q.org.", "1.2.3.4:80"]
    urls_ = [f"{r.choice(['http://', 'https://', '', '://'])}{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/7', '/en/71?x', '/de/8#a/en/', '?/en/', '/es/../en/', '/e'])}" for _ in range(300)] + [None, "", "mailto:x"]
    rules = [urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow"), urls.Rule("net", "/de/", "block"), urls.Rule("example.net", "/de/8", "block"), urls.Rule("org", "", "block")]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls_)], "page_id long, url string, host string")
    got = {x.page_id: x for x in urls.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
        found = max((x for x in rules if host and fits(x, host, path)), key=lambda x: (len(x.host + x.path), len(x.host)), default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, found and found.host + found.path, found.verdict if found else "allow"), u
    assert urls.filter_urls(pages, []).where("verdict <> 'allow'").count() == 0


def test_bloom_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    cascade = urls.Cascade(universe, listed)
    assert len(cascade.levels) >= 2
    wrong = universe.withColumn("in", cascade.contains(F.col("key"))).where("in <> (hash(key) % 7 = 0)")
    assert wrong.count() == 0


def test_deep_shallow_sorts():
    for seed in range(60):
        r = random.Random(seed)
        texts = ["".join(r.choice("ab") for _ in range(r.choice([0, 5, 20, 60]))).encode() for _ in range(r.choice([1, 2, 5, 50]))]
        texts += [r.choice(texts)[: r.randint(0, 70)] + b"zz" for _ in range(5)]
        order = suffixes.deep_shallow(texts, 0, r.choice([0, 8, 32]))
        assert [texts[i] for i, _ in order] == sorted(texts)
        assert all(suffixes.common_prefix(texts[a], texts[b]) == n for (a, _), (b, n) in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("limit", [20_000, 3])
def test_suffix_dedup(spark, limit):
    r = random.Random(6)
    make = lambda n: "".join(r.choice("ab é") for _ in range(n))
    shared = [make(n) for n in (20, 50, 90, 41, 39)]
    texts = ["".join(r.choice([make(r.randint(0, 60)), r.choice(shared), r.choice(shared)[r.randint(0, 5) :]]) for _ in range(r.randint(0, 5))) for _ in range(90)]
    texts += ["a" * 300, "a" * 100 + "b" + "a" * 100, None, "", "ab" * 100]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ranges", F.lit(1)).repartition(3)
    data = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 40] for t in data for i in range(len(t) - 39))
    want = Counter()
    for (key, _), t in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 39):
            if count[t[i : i + 40]] > 1:
                gone[i : i + 40] = b"\1" * 40
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        want[key, len(t), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = suffixes.remove_repeats(df, span=40, gram=15, group_limit=limit, digest=True)
    assert Counter(map(tuple, got.collect())) == want
    plain = suffixes.remove_repeats(df, span=40, gram=15, group_limit=limit)
    assert plain.columns == df.columns and plain.count() == len(rows) and plain.where("doc_id = 92 and text is null").count() == 1


@pytest.mark.parametrize("limit", [20_000, 3])
def test_suffix_dedup_by_words(spark, limit):
    r = random.Random(7)
    make = lambda n: [r.choice(["a", "be", "sé", "dog", "I", "zebra", "an"]) + r.choice(["", "n", "x", "y"]) for _ in range(n)]
    shared = [make(n) for n in (50, 51, 52, 60, 100, 180)]
    texts = []
    for i in range(80):
        parts = [make(r.randint(0, 70)), r.choice(shared) if i % 2 else make(5), make(r.randint(0, 70))]
        texts.append(r.choice([" ", "\n", " \t "]).join(w for p in parts for w in p))
    texts += [None, "", " \n", "go " * 200, " ".join(shared[0]), " ".join(shared[1]) + " ", " ".join(shared[1])]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("__ranges_", F.lit(1)).repartition(3)
    words = [(t or "").split() for t in texts]
    count = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    got = {x.doc_id: x.text for x in suffixes.remove_repeats(df, span=51, gram=18, words=True, group_limit=limit).collect()}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 50):
            if count[tuple(w[k : k + 51])] > 1:
                gone[k : k + 51] = [True] * 51
        assert (got[i] or "").split() == [x for x, g in zip(w, gone, strict=True) if not g], i
        assert any(gone) or got[i] == texts[i]
    assert sum(len(a) != len((got[i] or "").split()) for i, a in enumerate(words)) > 30


def test_suffix_dedup_of_very_long_texts(spark):
    r = random.Random(8)
    unit, other = r.randbytes(300).hex()[:400], r.randbytes(1_000_000).hex()
    texts = [unit * 20_000, other + "x" + unit, other[:500_000] + unit]
    began = time.time()
    got = {x.doc_id: x for x in suffixes.remove_repeats(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), digest=True).collect()}
    assert time.time() - began < 60
    assert [got[i].n_bytes - got[i].n_removed for i in range(3)] == [0, 1_500_001, 0] and [got[i].n_spans for i in range(3)] == [1, 2, 1]


def test_suffix_dedup_query_shows_what_is_left(spark, tmp_path):
    r = random.Random(9)
    make = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n)).encode()
    long, short, split = make(600)[:400].decode("utf-8", "ignore").ljust(400, "z"), make(600)[:380].decode("utf-8", "ignore"), "é" * 4 + make(600).decode()
    half = "".join(r.choice("abcdefgh") for _ in range(399))  # with the last byte of the character before it, 400
    assert len(short.encode()) < 400 <= len(long.encode())
    texts = ["one<" + long + ">one", "two(" + long + ")two", "one<" + short + ">one", "two(" + short + ")two", None, "", split, "x" + split, "é" + half, "ũ" + half]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op7_suffix_array_dedup(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {x.doc_id: x for x in out.collect()}
    assert [got[i].text for i in range(6)] == ["one<>one", "two()two", texts[2], texts[3], None, ""] and len(got) == len(texts)
    assert [got[i].text for i in (6, 7, 8, 9)] == ["", "x", "\ufffd", "\ufffd"]
    assert [got[i].kept_sha256 for i in (8, 9)] == [hashlib.sha256(x).hexdigest() for x in (b"\xc3", b"\xc5")]
    for i, text in enumerate(texts[:8]):
        kept = (got[i].text or "").encode()
        assert (got[i].n_bytes, got[i].n_bytes - got[i].n_removed, got[i].kept_sha256) == (len((text or "").encode()), len(kept), hashlib.sha256(kept).hexdigest()), i


def components_by_force(rows):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = {}
    for i, x in enumerate(label):
        out.setdefault(x, []).append(rows[i][0])
    least = {x: min((k for k in v if k is not None), default=None) for x, v in out.items()}
    return Counter((rows[i][0], len(sets[i]), least[label[i]]) for i in range(len(rows)))


def test_jaccard_join(spark, docs):
    got = jaccard.similarity_classes(docs)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == components_by_force(some_docs())
    kept = jaccard.keep_first(docs).collect()
    classes = {x.component_id for x in got.collect() if x.component_id is not None}
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(classes)
    assert jaccard.similarity_classes(docs.where("false")).count() == 0


def test_jaccard_shuffles_keys_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    got = jaccard.similarity_classes(docs).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == components_by_force(some_docs())


@pytest.mark.parametrize("limit", [1, 2])
def test_large_regions_are_joined_block_by_block(spark, docs, limit):
    got = jaccard.similarity_classes(docs, region_limit=limit).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == components_by_force(some_docs())


def test_regions_join_exactly():
    for seed in range(8):
        r = np.random.default_rng(seed)
        sets = []
        for _ in range(12):
            base = np.unique(r.integers(0, 1 << 40, r.integers(5, 60)).astype(np.uint64))
            for _ in range(r.integers(1, 14)):
                change = r.random(len(base)) < r.choice([0.02, 0.1, 0.3])
                sets.append(np.unique(np.where(change, r.integers(0, 1 << 40, len(base)).astype(np.uint64), base)))
        group = jaccard.Sets(np.arange(len(sets)), sets)
        group.join_all()
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
        roots = [group.root(i) for i in range(len(sets))]
        assert len(set(roots)) == len(set(label)) == len(set(zip(roots, label, strict=True)))


def test_sets_with_one_key_are_told_apart(spark):
    rows = [(1, 10, 5, 100, 7), (2, 11, 5, 100, 7), (3, 12, 6, 100, 9), (4, 13, 6, 200, 9)]
    df = spark.createDataFrame(rows, "doc_id long, row_hash long, n long, set_key long, check long")
    got = {x.doc_id: x.set_key for x in jaccard.told_apart(df).collect()}
    assert got[1] == got[2] == 100 and got[4] == 200 and got[3] not in (100, 200)


def test_regions_of_many_bytes_are_joined_block_by_block(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_BYTES", 400)
    got = jaccard.similarity_classes(docs)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == components_by_force(some_docs())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 199)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 199: 199, 200: 199}


def test_fingerprints(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    rows = some_docs()
    got = fingerprint.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t or "")
    prints = {}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    for k, row in enumerate(order):
        text, after = row[1] or "", order[(k + 1) % len(order)][1] or ""
        n, cut = len(text), len(text) // 4
        edited = hashlib.sha256((text[: n - cut] + after[:cut]).encode()).hexdigest()
        assert any(x.doc_id == row[0] and x.n_chars == n and x.edited_sha256 == edited for x in got)
    for x in got:
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        for t in texts[x.doc_id]:
            prints.setdefault(t, set()).add(x.fingerprint)
    assert all(len(v) == 1 for t, v in prints.items())
    assert fingerprint.edited_likeness(docs.where("false")).count() == 0
    one = fingerprint.edited_likeness(docs.where("doc_id = 20")).first()
    assert one.near_next == 1.0


def sketch_by_force(text):
    """The kept hashes of a text, by the published 64-bit hash over words and then over five of their hashes."""
    def hashed(data, seed=42):
        return xxhash.xxh64(data, seed=seed % (1 << 64)).intdigest()

    lowered = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    words = [hashed(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    shingles = set()
    for run in runs:
        h = 42
        for w in run:
            h = hashed(struct.pack("<Q", w), h)
        shingles.add(h >> 16)
    return {h for h in shingles if h < (1 << 48) // 4} | ({min(shingles)} if shingles else set())


def test_fingerprint_values(spark, docs):
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))
    shown = lambda s: "".join(f"{h:012x}" for h in sorted(s))
    rows = [(i, t) for i, t, *_ in some_docs() if i is not None]
    unique = [*dict(rows).items()]
    got = {x.doc_id: x for x in fingerprint.edited_likeness(spark.createDataFrame(unique, "doc_id long, text string").repartition(3)).collect()}
    for k, (i, t) in enumerate(sorted(unique)):
        text, after = t or "", sorted(unique)[(k + 1) % len(unique)][1] or ""
        cut = len(text) // 4
        own, edited, following = map(sketch_by_force, (text, text[: len(text) - cut] + after[:cut], after))
        x = got[i]
        assert (x.fingerprint, x.edited_fingerprint) == (shown(own), shown(edited))
        assert x.near_edited == pytest.approx(share(own, edited)) and x.near_next == pytest.approx(share(own, following))


def test_place_in_bounds(spark):
    for bounds in ([5], [1, 2], [-3, 0, 7], list(range(0, 100, 3))):
        keys = [None, -(1 << 62), *range(-5, 105), 1 << 62]
        df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("n", fingerprint.place_in(bounds, F.col("k")))
        assert {x.k: x.n for x in df.collect()} == {k: 0 if k is None else sum(b <= k for b in bounds) for k in keys}


def test_ranges_of_many_rows_make_no_large_plan(spark):
    """Bounds double their number; the expression that looks them up does not grow fourfold with it."""
    sizes = [len(fingerprint.place_in(list(range(n)), F.col("id"))._jc.node().toString().replace(",", " ").split()) - n for n in (4, 16, 64)]
    assert sizes[2] - sizes[0] < 100
    bounds = list(range(0, 3000, 3))
    got = spark.range(0, 3100, 7).select("id", fingerprint.place_in(bounds, F.col("id")).alias("n")).collect()
    assert all(x.n == min(x.id // 3 + 1, len(bounds)) for x in got)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a>Home</a><li>About</ul></nav><div class="cookie-notice">Cookies!</div><article><h1>{title}</h1><p>One&nbsp;<b>two</b><br>three &lt;x&gt;<p>{text}</p>
<aside>Related</aside><div class="ad">Buy</div><section id="comments"><p>First!</p></section></article><form><p>Name</p></form><footer>&copy;</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(title=f"Title {i}", text=f"Text\n  number {i}")) for i in range(12)]
    rows += [(20, None, "plain &amp text"), (21, "https://h0.example/x", None), (22, "https://h0.example/y", ""), (23, "https://h1.example/z", "<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    out = html.extract(pages).collect()
    assert len(out) == len(rows)
    got = {x.page_id: x.text for x in out}
    for i in range(12):
        assert got[i] == f"Title {i}\n\nOne two three <x>\n\nText number {i}"
    assert (got[20], got[21], got[22], got[23]) == ("plain & text", "", "", "a\n\nb\n\nc\n\nd\n\ne\n\nf")
    assert all(x.n_chars == len(x.text) for x in out)
    for odd in ("<" * 3000, "<p " * 3000, '<a "' * 3000, "<div>" * 3000, "<!--" + "x" * 9):
        html.main_blocks(html.parse(odd), None)


def test_wrappers_align():
    a, b = (html.wrapper_of(html.parse(t)) for t in ("<body><h1>x</h1><p>1</p><p>2</p><div class='a1'>same</div></body>", "<body><h1>y</h1><h2>new</h2><p>3</p><div class='a2'>same</div></body>"))
    assert html.expression(html.merged(a, b, 2)) == "<#page><body><h1>*</>(<h2>=</>)?(<p>*</>)+<div.a0>=</></></>"


def signs(node):
    """A node's tokens: its sign, its children's, and an end."""
    return node[0] + "".join(map(signs, node[4])) + ";" if node[0] != "#" else "#"


def as_pattern(node):
    own = "#" if node[0] == "#" else re.escape(node[0]) + "".join(map(as_pattern, node[4])) + ";"
    own = f"(?:{own})+" if node[3] else own
    return f"(?:{own})?" if node[2] else own


def common_by_force(a, b):
    if not a or not b:
        return 0
    return max(common_by_force(a[1:], b[1:]) + 1 if a[0] == b[0] else 0, common_by_force(a[1:], b), common_by_force(a, b[1:]))


def test_wrappers_cover_what_they_were_inferred_from():
    """As regular expressions, wrappers match the pages that they come from, and align as much as can be aligned."""
    for seed in range(150):
        r = random.Random(seed)

        def element(depth, r=r):
            return f"<{(t := r.choice(['div', 'section', 'ul']))}>" + "".join(element(depth + 1) if depth < 3 and r.random() < 0.5 else f"<p>{r.choice(['same', str(r.random())])}</p>" for _ in range(r.randint(0, 3))) + f"</{t}>"

        pages = [html.wrapper_of(html.parse(f"<body>{''.join(element(0) for _ in range(r.randint(0, 3)))}</body>")) for _ in range(3)]
        wrapper = pages[0]
        for n, page in enumerate(pages[1:]):
            wrapper = html.merged(wrapper, page, n + 2)
        # Runs of equal siblings are folded in pages too, so what a page's own wrapper says once may stand for several.
        assert all(re.fullmatch(as_pattern(wrapper), signs(page)) for page in pages), seed
    for seed in range(200):
        r = random.Random(seed)
        make = lambda: [[r.choice("abcd"), 1, False, False, []] for _ in range(r.randint(0, 6))]
        a, b = html.fold(make()), html.fold(make())
        merged = []
        real, html.fold = html.fold, lambda nodes: merged.extend(nodes) or nodes
        try:
            html.aligned(a, b)
        finally:
            html.fold = real
        if [x[0] for x in a] != [x[0] for x in b]:
            assert len(a) + len(b) - len(merged) == common_by_force([x[0] for x in a], [x[0] for x in b])


def test_template_text_goes_outside_articles():
    pages = [html.parse(f"<body><div class='contact'>Call us now</div><div>story {i}</div></body>") for i in range(6)]
    wrapper = html.wrapper_of(pages[0])
    for p in pages[1:]:
        wrapper = html.merged(wrapper, html.wrapper_of(p), wrapper[1] + 1)
    assert html.main_blocks(pages[2], wrapper) == ["story 2"]


def test_layout_names_leave_the_article():
    text = lambda t: html.main_blocks(html.parse(t), None)
    for body in ("<body class='right-sidebar has-header'><article>{}</article></body>", "<article class='post comments-open'>{}</article>", "<main class='no-sidebar'><article class='comments-open'>{}</article></main>",
                 "<div class='layout-sidebar'><div class='fixed-header'><article>{}</article></div></div>", "<body class='widget'><div class='content no-sidebar'>{}</div></body>", "<div class='with-sidebar'><h1>T</h1>{}</div>"):
        found = text(body.format("<p>Story</p><div class='share'>Share</div><section id='comments'><article class='comment'>First!</article></section>"))
        assert found in (["Story"], ["T", "Story"]), body
    assert text("<article><p>Story</p><article class='comment'>First!</article></article><div class='related'><article>Other</article></div>") == ["Story"]
    assert text("<p>A longer story</p><div class='comments'><article>First!</article></div>") == ["A longer story"]
    assert text("<div class='sidebar'><p>Side</p></div><div class='post-comments'>Hm</div><p>Story</p>") == ["Story"]


def test_html_of_any_depth_and_attribute_length():
    text = lambda t: html.main_blocks(html.parse(t), html.wrapper_of(html.parse(t)))
    for n in (99, 150, 20_000):
        assert text("<div>" * n + "<article><p>Story</p><nav><p>Menu</p></nav><div class='ad'>Buy</div></article></div>After" + "</div>" * (n - 1)) == ["Story"]
    assert text("<p>a</p>" + "<div>" * 500 + "<nav>Menu</nav><p>b</p>" + "</div>" * 500 + "<p>c</p>") == ["a", "b", "c"]
    for n in (10, 5000, 200_000):
        value = "<p class='ad'>x > y</p>" * (n // 20)
        assert text(f'<article data-x="{value}"><p title=it\'s data-y="hidden id=nav">Story\'s</p></article>') == ["Story's"]
    started = time.process_time()
    for odd in ('<a b=">" ' * 50_000, "<div>" * 50_000 + "</section></div><section>" * 20_000, "<section><article>" + "<div>" * 50_000 + "</section>" * 50_000, '<a b="' * 50_000 + ">", "<p>" * 50_000):
        text(odd)
    assert time.process_time() - started < 30


def test_template_text_goes_inside_articles():
    page = "<body><main><article><h1>Title {0}</h1><div class='bar'>Tell a friend</div><p>Story {0}</p><div class='box'><p>Our letters</p></div></article><article class='extra'>About us</article></main></body>"
    pages = [html.parse(page.format(i)) for i in range(6)]
    wrapper = html.wrapper_of(pages[0])
    for p in pages[1:]:
        wrapper = html.merged(wrapper, html.wrapper_of(p), wrapper[1] + 1)
    assert html.main_blocks(pages[2], wrapper) == ["Title 2", "Story 2"]


@pytest.mark.parametrize("n", [2, 3, 150])
def test_repeated_texts_go_at_any_size_of_host(spark, n):
    page = "<body><div class='{1}'><p>Own {0}</p></div><p>Call us now</p><p>Story {0}</p><div class='x'>About us</div></body>"
    rows = [(i, f"https://a.example/{i}", page.format(i, f"k{chr(97 + i % 26)}{chr(97 + i // 26)}")) for i in range(n)]
    rows += [(n + i, f"https://b.example/{i}", f"<article><h1>T {i}</h1><p>Story {i}</p><div>Our letters</div></article><article class='x'><p>Tell a friend</p></article>") for i in range(n)]
    rows += [(2 * n + i, f"https://{h}.example/none", t) for i, (h, t) in enumerate([("a", None), ("b", "")])]
    rows += [(2 * n + 2, "https://c.example/1", "<article><h1>T</h1><p>Same</p><p>Old</p></article>"), (2 * n + 3, "https://c.example/2", "<article><h1>T</h1><p>Same</p><p>New</p></article>")]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(n):
        assert got[i] == f"Own {i}\n\nStory {i}" and got[n + i] == f"T {i}\n\nStory {i}"
    assert (got[2 * n], got[2 * n + 2], got[2 * n + 3]) == ("", "T\n\nSame\n\nOld", "T\n\nSame\n\nNew")


def test_texts_go_by_their_place_in_the_host_s_wrapper(spark):
    """Places that signatures from the root down do not tell apart, on all pages and on most, in and outside articles."""
    rows = [(i, "https://a.example/", f"<body><article><h1>T {i}</h1><p>Story {i}</p><h2>More</h2><p>Tell a friend</p></article></body>") for i in range(10)]
    rows += [(100 + i, "https://b.example/", f"<body><div>Story {i}</div>{'<h2>Find us</h2><div>Call us now</div>' * (i % 10 < 7)}</body>") for i in range(20)]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"T {i}\n\nStory {i}" for i in range(10)} | {100 + i: f"Story {i}" for i in range(20)}


def test_wrappers_in_rounds_and_of_any_partitions(spark, monkeypatch):
    """Hosts of many shapes, aligned some at a time, give one wrapper however the pages lie, and it has what most pages have."""
    monkeypatch.setattr(html, "GROUP", 4)
    part = lambda i, k: f"<section class='{chr(97 + i % 26)}{chr(97 + i // 26)}{k}'><p>Own {i} {k}</p></section>"
    page = lambda i: "<body><article><h1>T {0}</h1>{1}<p>Story {0}</p><h2>More</h2>{2}<p>Tell a friend</p></article></body>".format(i, part(i, "x") * (i % 3), part(i, "y") * (i % 2))
    pages = spark.createDataFrame([(i, "https://a.example/", page(i)) for i in range(90)], "page_id long, url string, html string")
    wrappers = [html.host_wrappers(pages.select(F.lit("a").alias("host"), "html").repartition(n)).collect() for n in (1, 7)]
    assert wrappers[0] == wrappers[1] and len(wrappers[0]) == 1
    for x in html.extract(pages).collect():
        i = x.page_id
        assert x.text == "\n\n".join([f"T {i}", *[f"Own {i} x"] * (i % 3), f"Story {i}", *[f"Own {i} y"] * (i % 2)])


def test_wrappers_of_odd_pages(spark):
    """No rows, pages without text, very deep ones and long alternating ones, in hosts with wrappers."""
    pages = spark.createDataFrame([(i, "https://a.example/", h) for i, h in enumerate([None, "", "<p></p>", *("<div>" * 3000 + f"<p>{i}</p><h2>x</h2><p>Call us</p>" for i in range(3)), *(f"<p>{i}</p>" + "<h3>a</h3><p>b</p>" * n for i, n in enumerate((700, 900, 1100)))])], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.extract(pages).collect()}
    assert [got[i] for i in range(3)] == [""] * 3 and html.extract(pages.where("false")).count() == 0
    assert all(got[3 + i].startswith(str(i)) and got[6 + i].startswith(str(i)) for i in range(3))


def test_long_sequences_are_aligned_at_their_ends():
    r = random.Random(5)
    make = lambda: [r.choice("abcdef") for _ in range(20_000)]
    started = time.process_time()
    pairs, whole = html.matched(("x", "y", *make(), "z"), ("x", "y", *make(), "z"))
    assert not whole and pairs[:2] == [(0, 0), (1, 1)] and pairs[-1] == (20_002, 20_002)
    assert time.process_time() - started < 5


def test_filters_against_counting_by_hand():
    """Bit-sliced filters give each n-gram's languages, and the corrected counts decide, as sets and sums say."""
    r = random.Random(3)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(60)] for lang, letters in {"aa": "abcdef", "bb": "cdefgh", "cc": "xyzabé"}.items()}
    grams = {lang: np.unique(np.concatenate([langid.ngram_hashes(langid.letter_codes(w)) for w in ws])) for lang, ws in words.items()}
    names = sorted(grams)
    model = langid.LanguageFilters(names, [grams[n] for n in names])
    for _ in range(60):
        text = " ".join(r.choice(words[r.choice(names)]) for _ in range(r.randint(1, 12))) + r.choice(["", " 12!", " Qq"])
        hashes = langid.ngram_hashes(langid.letter_codes(text))
        masks = model.languages_of(hashes)
        slots = [{int(p) for at in langid.positions(grams[n]) for p in at} for n in names]
        by_hand = [[all(int(p[0]) in slots[k] for p in langid.positions(hashes[i : i + 1])) for k in range(3)] for i in range(len(hashes))]
        assert [[bool(int(m) >> k & 1) for k in range(3)] for m in masks] == by_hand
        assert all(not np.isin(h, grams[n]) or row[k] for h, row in zip(hashes, by_hand, strict=True) for k, n in enumerate(names))
        rates = [(len(s) / langid.BITS) ** langid.HASHES for s in slots]
        net = [max(0.0, (sum(row[k] for row in by_hand) - len(hashes) * rates[k]) / (1 - rates[k])) for k in range(3)]
        got = model.predict(text)
        assert got[0] == names[max(range(3), key=lambda k: (net[k], -k))] and got[1] == pytest.approx(max(net) / sum(net))


def test_a_language_of_rare_ngrams_is_learned(spark):
    rows = [(i, "the other one and this there", "en") for i in range(40)] + [(100, "zqx wvk", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["en", "zz"] and model.predict("zqx")[0] == "zz" and model.predict("there")[0] == "en"


def test_language_id_learns_more_than_64_and_rare_languages(spark):
    names = [f"l{n:02d}" for n in range(70)]
    words = {x: [chr(0x4E00 + 40 * n + j) * 2 + chr(0x4E00 + 40 * n + j + 1) for j in range(20)] for n, x in enumerate(names)}
    rows = [(1000 * n + i, " ".join(words[x]), x) for n, x in enumerate(names) for i in range(8 if n else 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, fit_rows=100)
    assert model.names == names and model.table.shape == (2, langid.BITS)
    assert all(model.predict(" ".join(words[x]))[0] == x for x in names)


def test_very_long_texts(spark):
    """A text of two million characters beside short ones, through every operator on documents and pages."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(400_000))
    rows = [(1, long, "en", "s", len(long)), (2, "short text here", "en", "s", 15), (3, long + " end", "en", "s", len(long) + 4)]
    docs = spark.createDataFrame(rows, DOCS)
    item = " ".join(long.split()[200_000:200_030])
    leaks = decontaminate.find_leaks(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert {x.doc_id for x in leaks} == {1, 3} and all(x.distance == 0 for x in leaks)
    path = public_tokenizers.path("word_bpe_49k.json")
    n = len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids) + 1
    pieces = packing.tokenized_pieces(docs, tokenizer=path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    assert {x.doc_id: (x.n, x.last) for x in pieces}[1] == (n, (n - 1) // 4096)
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [*Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids, 0]
    assert {x.doc_id: (x.start, x.ids_crc32) for x in tokenfiles.round_trip(docs, tokenizer=path).collect()}[1] == (0, zlib.crc32(np.array(ids, "<u4").tobytes()))
    model = langid.fit(docs)
    assert [x.lang_pred for x in langid.identify(docs, model).collect()] == ["en"] * 3
    assert {x.doc_id: x.component_id for x in jaccard.similarity_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}
    near = {x.doc_id: x for x in fingerprint.edited_likeness(docs).collect()}
    assert near[1].n_chars == len(long) and 0.7 < near[1].near_edited <= 1
    page = f"<html><body><nav>menu</nav><article><h1>t</h1><p>{'</p><p>'.join(long[k : k + 1000] for k in range(0, len(long), 1000))}</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/x", page), (2, "http://a.example/" + "y" * 100_000, page)], "page_id long, url string, html string")
    text = "\n\n".join(["t", *(" ".join(long[k : k + 1000].split()) for k in range(0, len(long), 1000))])
    assert [x.text for x in html.extract(pages).collect()] == [text] * 2
    kept = {x.page_id: x for x in warc.archive(pages)[1].collect()}
    assert kept[1].record_type == "revisit" and kept[1].refers_to == 2 and kept[2].payload_bytes == len(page.encode())
    assert {x.page_id: x.rule for x in urls.filter_urls(pages, [urls.Rule("example", "/yyy", "block")]).collect()} == {1: None, 2: "example/yyy"}


def test_clashing_column_names(spark, docs):
    """Columns that have the names of the operators' own or of their results."""
    odd = docs.withColumns({c: F.lit("own") for c in ("k", "z", "h", "n", "gram", "region", "set_key", "row_hash", "token", "part", "piece", "sequence_id", "lang_pred", "score", "item_id", "next_text", "sketch", "wrapper", "host")})
    items = spark.createDataFrame([(0, "w1 w2", "own")], "item_id long, text string, doc_id string")
    assert decontaminate.drop_leaks(odd, items).columns == odd.columns and decontaminate.find_leaks(odd, items).count() == decontaminate.find_leaks(docs, items).count()
    assert jaccard.keep_first(odd).columns == odd.columns and jaccard.keep_first(odd).count() == jaccard.keep_first(docs).count()
    assert suffixes.remove_repeats(odd, span=40, gram=15).columns == odd.columns
    found = langid.identify(odd, langid.LanguageFilters([], []))
    assert sorted(found.columns) == sorted(odd.columns) and found.where("lang_pred = 'own'").count() == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.place(packing.tokenized_pieces(odd, tokenizer=path)).count() == docs.count()
    assert fingerprint.edited_likeness(odd).count() == docs.count()
    assert tokenfiles.round_trip(odd, tokenizer=public_tokenizers.path("byte_bpe_50k.json")).count() == docs.count()

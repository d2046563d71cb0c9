"""URL filter rules by a Bloom filter cascade.

The key universe is every (host suffix, path prefix) that a url of the corpus could match a rule with. Level 1 of
a cascade is a Bloom filter of the listed keys; level 2 one of the other keys of the universe that pass level 1;
level 3 one of the listed keys that pass level 2; and so on until nothing passes wrongly. A key of the universe is
listed exactly if the number of levels that it passes in a row is odd, so judging a url takes no join.

Everything runs as DataFrame expressions. A level is an array of 64-bit words that enters the plan as a constant;
FILTER_BITS bounds the bits of a level, and rules are split by a hash of their key into as many cascades as that
needs, each applied to the keys of its own shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS_PER_KEY = 12
HASHES = 4
MAX_HASHES = 40
#: Bits of one level at most; more rules than fit make more shards.
FILTER_BITS = 1 << 22
MAX_LEVELS = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def host_suffixes(host: Column) -> Column:
    """The host and the parents of its name: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a rule with a path of one of ``lengths`` code points would fit by, longest rule first.

    Of rules of one total length the one with the longer host comes first.
    """
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    both = F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(prefixes, lambda p: F.struct((F.length(h) + F.length(p)).alias("n"), F.length(h).alias("h"), F.concat(h, F.lit("\u0000"), p).alias("key")))))
    return F.transform(F.reverse(F.array_sort(F.array_distinct(both))), lambda s: s["key"])


def rule_key(host: str | Column, path: str | Column) -> str | Column:
    return f"{host}\0{path}" if isinstance(host, str) else F.concat(host, F.lit("\u0000"), path)


def bit_of(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 64 + k)), F.lit(bits))


@dataclass
class Level:
    words: list[int]
    bits: int
    hashes: int

    def passes(self, key: Column, level: int) -> Column:
        table = F.lit(np.array(self.words, np.int64))
        out = F.lit(True)
        for k in range(self.hashes):
            at = bit_of(key, level, k, self.bits)
            word = F.get(table, F.floor(at / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out


def build_level(keys: DataFrame, n: int, level: int, others: int) -> Level:
    """A Bloom filter of the ``n`` distinct values of column ``key`` that about ``n`` of ``others`` keys pass at most."""
    hashes = min(MAX_HASHES, max(HASHES, math.ceil(math.log2(max(1, others) / n))))
    bits = 64 * max(1, math.ceil(n * hashes * BITS_PER_KEY / HASHES / 64))
    at = F.explode(F.array(*(bit_of(F.col("key"), level, k, bits) for k in range(hashes))))
    found = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).collect()
    words = [0] * (bits // 64)
    for r in found:
        words[r["word"]] = r["set"]
    return Level(words, bits, hashes)


class Cascade:
    """Exact membership of the keys of ``universe`` (distinct values of ``key``) in ``listed``."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        marked = stored(universe.join(listed.select("key", F.lit(True).alias("in")), "key", "left").select("key", F.coalesce("in", F.lit(False)).alias("listed")), "url-universe")
        self.levels: list[Level] = []
        sides = {True: marked.where("listed"), False: marked.where("not listed")}
        side, counts = True, {r["listed"]: r["count"] for r in marked.groupBy("listed").count().collect()}
        while len(self.levels) < MAX_LEVELS:
            if not counts.get(side):
                break
            self.levels.append(build_level(sides[side], counts[side], len(self.levels), counts.get(not side, 0)))
            side = not side
            sides[side] = sides[side].where(self.levels[-1].passes(F.col("key"), len(self.levels) - 1))
            counts[side] = sides[side].count()
        else:
            raise RuntimeError("the cascade does not end")

    def contains(self, key: Column) -> Column:
        """Whether ``key``, of the universe, is listed: the first level that it fails has an even index then."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(self.levels[n].passes(key, n), out).otherwise(F.lit(n % 2 == 1))
        return out


def shards_for(n_rules: int) -> int:
    return max(1, math.ceil(n_rules * BITS_PER_KEY / FILTER_BITS))


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` by the longest rule that fits each url.

    A rule fits its host and all subdomains of it if the url's path starts with the rule's. A url that no rule fits,
    null and malformed ones included, has a null rule and ``default``. Rules repeat at will but may not contradict
    each other. Repeated rows are judged alike; an empty table and an empty list are fine; other columns pass
    through, and columns of the four new names are replaced.
    """
    spark = pages.sparkSession
    pages = pages.drop(*(c for c in ("host", "path", "rule", "verdict", "__fit") if c != url))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    listed = stored(rules.select(F.concat(F.translate("host", UPPER, LOWER), F.lit("\u0000"), F.col("path")).alias("key"), F.length("path").alias("n"), "verdict").distinct(), "url-rules")
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())  # as many as rules have path lengths
    host, path = host_and_path(F.col(url))
    named = pages.withColumns({"host": host, "path": path})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    universe = stored(named.where(F.col("host") != "").select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct(), "url-keys")
    shards = shards_for(listed.count())
    shard = lambda key: F.pmod(F.hash(key), F.lit(shards))
    verdicts = sorted(r["verdict"] for r in listed.select("verdict").distinct().collect())
    cascades = {v: [Cascade(universe.where(shard(F.col("key")) == s), listed.where((F.col("verdict") == v) & (shard(F.col("key")) == s))) for s in range(shards)] for v in verdicts}

    def member(key: Column, v: str) -> Column:
        out = F.lit(False)
        for s, cascade in enumerate(cascades[v]):
            out = F.when(shard(key) == s, cascade.contains(key)).otherwise(out)
        return out

    def verdict_of(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for v in verdicts:
            out = F.when(member(key, v), F.lit(v)).otherwise(out)
        return out

    judged = F.filter(F.transform(keys, lambda key: F.struct(key.alias("key"), verdict_of(key).alias("verdict"))), lambda s: s["verdict"].isNotNull())
    fit = F.get(judged, F.lit(0))
    out = named.withColumn("__fit", F.when(F.col("host") != "", fit))
    return out.select(*own, "host", "path", F.translate(F.col("__fit.key"), "\u0000", "").alias("rule"), F.coalesce("__fit.verdict", F.lit(default)).alias("verdict"))

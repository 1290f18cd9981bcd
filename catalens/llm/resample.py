"""Importance resampling of documents towards the n-grams of a target set.

Features are all runs of 1 to 2 consecutive words; a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo ``BUCKETS``. A bucket's gain is the log ratio of its smoothed shares in
target and corpus; a document's weight is the mean gain of its features, and a draw
without replacement takes the highest weights with Gumbel noise of a hash of the id.

1. Tasks count the strings of their documents in bounded dictionaries; Spark adds them up to
   one dictionary of distinct strings, hashes each once and adds up its buckets.
2. The gains, ``BUCKETS`` whole numbers whatever the input's size, go to the tasks, where
   each document's features meet them by bucket. The way back by string would shuffle
   every document's features, more bytes than the texts; the gain is the bucket's in any case.
3. Drawn documents are numbered by a range sort over narrow rows.

Defined cases: a null or empty text has no feature, weight 0 and is never drawn; texts
of any length are read whole; repeated rows are documents of their own, in an order fixed by
the written table; a null id has the noise of the empty id and comes first among ties; an
empty target leaves shares of the smoothing alone; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import ship, slices
from catalens.shared import materialize, numbered

BUCKETS, LEAST_WORDS, SEED = 10_000, 20, 7
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Rows that a dictionary is passed on in.
PARTS = 4096
#: Dictionary entries that a task holds before it passes them on, words it remembers, and words of a text it takes at once.
HELD, REMEMBERED, RUN = 400_000, 200_000, 1 << 16


def runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text in lists of bounded length; each but the first begins with the last word before."""
    raw = text.encode("utf-8", "replace").lower() if text else b""
    if len(raw) <= 16 * RUN:
        if words := WORD.findall(raw):
            yield words
        return
    found, last = (m[0] for m in WORD.finditer(raw)), []
    while part := list(islice(found, RUN)):
        yield last + part
        last = part[-1:]


def dictionary(docs: DataFrame) -> DataFrame:
    """(feature, n): every distinct string of the table with its occurrences.

    A task passes strings on in ``PARTS`` rows of a text each: far fewer bytes and rows to shuffle
    than a row a string. Parts are of equal size, however frequent a word is, and no string is in two.
    """

    def count(batches):
        held: Counter = Counter()

        def passed():
            parts: list[list[bytes]] = [[] for _ in range(PARTS)]
            for feature in held:
                parts[zlib.crc32(feature) % PARTS].append(feature)
            filled = [k for k in range(PARTS) if parts[k]]
            for s in range(0, len(filled), 256):
                some = filled[s : s + 256]
                joined, ns = [b"\n".join(parts[k]).decode() for k in some], [[held[f] for f in parts[k]] for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(joined), pa.array(ns, pa.list_(pa.int64()))], ["part", "features", "ns"])
            held.clear()

        for b in slices(batches):
            for text in b.column("text").to_pylist():
                for k, words in enumerate(runs(text)):
                    held.update(words if k == 0 else words[1:])
                    held.update(map(b" ".join, zip(words, words[1:])))
                    if len(held) > HELD:
                        yield from passed()
        yield from passed()

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "part int, features string, ns array<long>").repartition("part")
    each = rows.select("part", "ns", F.posexplode_outer(F.split("features", "\n")).alias("pos", "feature")).select("part", "feature", F.expr("ns[pos]").alias("n"))
    return each.groupBy("part", "feature").agg(F.sum("n").alias("n")).select("feature", "n")


def buckets(docs: DataFrame) -> dict[int, int]:
    """Occurrences by bucket; at most ``BUCKETS`` rows come to the driver."""
    return {r[0]: r[1] for r in dictionary(docs).groupBy((F.crc32("feature") % BUCKETS).cast("int").alias("bucket")).agg(F.sum("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    s_all, t_all = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [math.floor(1000 * math.log((target.get(k, 0) + 1) * s_all / ((corpus.get(k, 0) + 1) * t_all))) for k in range(BUCKETS)]


class Gains(dict):
    """Of a word, the gain of its bucket and the CRC-32 that a pair beginning with it goes on from."""

    def __init__(self, of_bucket: list[int]):
        self.of_bucket = of_bucket

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        crc = zlib.crc32(word)
        self[word] = out = (self.of_bucket[crc % BUCKETS], zlib.crc32(b" ", crc))
        return out

    def of(self, text: str | None) -> tuple[int, int]:
        """(number of features, sum of their gains) of a whole text."""
        n = total = 0
        crc32, of_bucket = zlib.crc32, self.of_bucket
        for k, words in enumerate(runs(text)):
            known = [self[w] for w in words]
            own = known if k == 0 else known[1:]
            n += len(own) + len(words) - 1
            total += sum([g for g, _ in own]) + sum([of_bucket[crc32(w, at[1]) % BUCKETS] for at, w in zip(known, words[1:])])
        return n, total


def weights(docs: DataFrame, of_bucket: list[int]) -> DataFrame:
    """(doc_id, n_features, weight) of every row; the weight is the mean gain, floored."""

    def weigh(batches):
        memory = Gains(of_bucket)
        for b in slices(batches):
            found = [memory.of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([total // n if n else 0 for n, total in found], pa.int64())], ["doc_id", "n_features", "weight"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(weigh, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and, of drawn rows, rank; ``percent`` of the rows with ``least_words`` words are drawn."""
    of_bucket = gains(buckets(docs), buckets(target))
    scored = materialize(weights(docs, of_bucket).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enough = F.col("n_features") >= 2 * least_words - 1
    placed = numbered(scored.filter(enough), [F.desc("score"), F.asc("doc_id")], "rank")
    drawn = scored.filter(enough).count() * percent // 100
    ranked = placed.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


ship(__name__)

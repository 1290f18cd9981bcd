"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a fixed order (a hash of the id) and cut into
blocks of ``block`` documents. With weight w, a source's block j may run from
slot floor(j / w) and must have run by slot ceil((j + 1) / w); each slot goes to
the released block of earliest deadline. At any slot a source has had its share
of slots to less than one block. Weights are exact fractions over the whole
horizon, none is rounded.

The slots are cut into spans of ``SPAN``. At the bounds of a span the blocks that
each source has given are known without running through the slots before: the
whole part of its share, and one more for those of the largest remainders, so
that the slots are full. Any such state leaves no stretch of slots with more due
blocks than slots, so earliest deadline first meets every deadline inside a span
too, and executors schedule the spans apart from each other. The driver holds one
row a source, nothing a slot.

The mixture ends with the slot by which every source has given all its
documents. Sources over their natural share start anew until then, so every
document occurs at least once and none is dropped. The default weights are the
natural shares to the power ``temper``, near enough to 1 that repeats stay few
(sources whose shares differ by 10^10 repeat at most tenfold at 0.9).

Defined cases: a null source is a source of its own; given weights must name
every source (others raise ValueError) and be positive; repeated rows are
documents of their own; null ids and ties keep any fixed order; null and empty
texts are documents like others, and texts may be of any length, as they are
not read; an empty table gives an empty result; extra columns are kept by
``mixed``, whatever their names, and ignored by ``schedule``.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import boxed, met, scanned, ship
from catalens.shared import BROADCAST_BYTES, materialize, numbered

BLOCK = 8
SPAN = 1 << 16
TEMPER = 0.9
USES = 64  # of one document that travel in one row


def rounded(weights: Mapping, period: int) -> dict:
    """Whole slots of ``period`` for each source, at least one, by largest remainder."""
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    order = sorted(exact, key=lambda k: (out[k] - exact[k], str(k)))
    while (short := period - sum(out.values())) > 0:
        for k in order[:short]:
            out[k] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda k: (out[k] - exact[k] if out[k] > 1 else -1e18, str(k)))] -= 1
    return out


def paced(shares: Sequence[int], start: int, done: list[int], slots: int, until: Sequence[int] | None = None) -> np.ndarray:
    """The sources of ``slots`` slots from ``start``, by earliest deadline; ``done``, blocks a source, moves on.

    With ``until``, each source gives exactly so many blocks by the last slot.
    """
    total = sum(shares)
    most = [1 << 62] * len(shares) if until is None else until
    waiting = [(j * total // shares[k], k) for k, j in enumerate(done) if j < most[k]]
    heapq.heapify(waiting)
    ready: list = []
    out = np.empty(slots, np.int32)
    for t in range(slots):
        while waiting and waiting[0][0] <= start + t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[k] + 1) * total // shares[k]), k))
        k = heapq.heappop(ready)[1]
        done[k] += 1
        if done[k] < most[k]:
            heapq.heappush(waiting, (done[k] * total // shares[k], k))
        out[t] = k
    return out


def reached(shares: Sequence[int], slot: int) -> list[int]:
    """Blocks that each source has given by ``slot``: the whole part of its share, one more at the largest remainders."""
    total = sum(shares)
    parts = [divmod(slot * x, total) for x in shares]
    out = [n for n, _ in parts]
    # No more sources are rounded up than have a remainder, as the remainders add up to whole slots.
    for k in sorted(range(len(parts)), key=lambda k: (-parts[k][1], k))[: slot - sum(out)]:
        out[k] += 1
    return out


def span(shares: Sequence[int], start: int, slots: int) -> tuple[list[int], np.ndarray]:
    """Blocks done before a span, and the sources of its slots."""
    before, after = reached(shares, start), reached(shares, start + slots)
    return before, paced(shares, start, list(before), slots, after)


def horizon(shares: Sequence[int], needs: Sequence[int]) -> int:
    """The slot by which each source has given ``needs`` blocks."""
    total = sum(shares)
    return max(-(-n * total // x) for n, x in zip(needs, shares))


def pfair(slots: Mapping, period: int) -> list:
    """The source of each slot of a period: earliest deadline first among released blocks."""
    names = sorted(slots, key=str)
    return [names[i] for i in paced([slots[k] for k in names], 0, [0] * len(names), period)]


def whole(weights: Sequence) -> list[int]:
    """Integers in exactly the proportions of ``weights``."""
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(x.denominator for x in exact))
    return [int(x * unit) for x in exact]


def schedule(docs: DataFrame, weights: Mapping | None = None, block: int = BLOCK, temper: float = TEMPER) -> DataFrame:
    """_file, _row, doc_id, source, epoch, block, position: a row for each use of a document."""
    spark = docs.sparkSession
    rows = boxed(docs).select("_file", "_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.source").alias("source"), F.xxhash64(F.lit(29), "_doc.doc_id").alias("_h"))
    ranked = numbered(rows, ["source", "_h", "_file", "_row"])
    found = {r[0]: (r[1], r[2]) for r in ranked.groupBy("source").agg(F.min("idx"), F.count("*")).collect()}
    if not found:
        return rows.select("_file", "_row", "doc_id", "source", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("position"))
    counts = {k: n for k, (_, n) in found.items()}
    if weights is None:
        weights = {k: n**temper for k, n in counts.items()}
    if missing := [k for k in counts if not weights.get(k, 0) > 0]:
        raise ValueError(f"no positive weight for {missing[:5]}")
    names = sorted(counts, key=lambda k: (k is not None, str(k)))
    shares = whole([weights[k] for k in names])
    end = horizon(shares, [-(-counts[k] // block) for k in names])
    done = reached(shares, end)
    sources = spark.createDataFrame([(i, k, found[k][0], counts[k], done[i] * block) for i, k in enumerate(names)], "_s int, _name string, _base long, _n long, _room long")
    given = spark.sparkContext.broadcast(shares)

    def place(batches):
        for b in batches:
            for start in b.column("start").to_pylist():
                before, order = span(given.value, start, min(SPAN, end - start))
                at = np.argsort(order, kind="stable")
                n = np.bincount(order, minlength=len(before))
                used = np.flatnonzero(n)
                first = np.repeat(np.array([before[k] for k in used], np.int64) - (np.cumsum(n[used]) - n[used]), n[used])
                yield pa.RecordBatch.from_arrays([pa.array(order[at]), pa.array(np.arange(len(order)) + first), pa.array(at + start)], ["_s", "_b", "block"])

    spans = -(-end // SPAN)
    places = spark.range(0, end, SPAN, min(spans, 10_000)).select(F.col("id").alias("start")).mapInArrow(place, "_s int, _b long, block long")
    used = (
        ranked.join(F.broadcast(sources) if len(names) <= BROADCAST_BYTES // 128 else sources, F.col("source").eqNullSafe(F.col("_name")))
        .withColumn("_rank", F.col("idx") - F.col("_base"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_room") - 1 - F.col("_rank")) / F.col("_n")))))
        .withColumn("_at", F.col("_rank") + F.col("epoch") * F.col("_n"))
        .withColumn("_b", F.floor(F.col("_at") / F.lit(block)))
    )
    # A merge join at any size, of places and numbers only; a key has at most ``block`` rows.
    return used.join(materialize(places, "places").hint("merge"), ["_s", "_b"]).select(
        "_file", "_row", "doc_id", "source", "epoch", "block", (F.col("block") * block + F.col("_at") % block).alias("position")
    )


def mixed(docs: DataFrame, weights: Mapping | None = None, block: int = BLOCK, temper: float = TEMPER) -> DataFrame:
    """The rows of ``docs`` in mixture order, those of sources over their natural share more than once.

    Texts are read once and move once, to their place in the order: twice as many parts as the
    scan has, as rows are larger on their way than in files, each an equal range of positions.
    """
    docs = scanned(docs)
    uses = materialize(schedule(docs, weights, block, temper).select("_file", "_row", "epoch", "position"), "uses")
    total, parts = uses.count(), 2 * max(1, docs.rdd.getNumPartitions())
    values = uses.groupBy("_file", "_row", F.floor(F.col("epoch") / USES).alias("_layer")).agg(F.collect_list("position").alias("_value"))
    placed = met(docs, values, lambda r: r.select("_doc", F.explode("_value").alias("_at")), F.size("_value") * 8)
    part = F.expr(f"cast(_at * {parts} div {max(1, total)} AS int)")
    return placed.repartitionById(parts, part).sortWithinPartitions("_at").select("_doc.*")


ship(__name__)

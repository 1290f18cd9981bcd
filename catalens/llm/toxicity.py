"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (lower case, letters and digits) and their starts
of 2 to 7 characters, hashed into ``DIM`` cells, words in one half and starts in the
other; a text has a cell or not. A second-order factorization machine (bias, a
weight and a ``RANK``-vector a cell) is fitted by logistic loss, so that pairs of
terms count beyond their sum. It learns from

* the cells whose rate differs between the labels (seen three times, z of 3, log
  odds ratio of 0.7), at most ``KEPT`` of the largest z;
* words that tell in pairs only: of the ``PAIRED`` most frequent words, the pairs that
  stand together in texts of one label beyond what both words alone tell (z of 5),
  at most ``PAIRS`` of the largest z. A mention that is as common in clean texts,
  and harmful with another word, is found here.

Both bounds are of the model, whatever the table's size; a text has all its terms.
The model is fitted on one text each of at most ``positives`` and ``negatives``
labelled ids, chosen by a hash of the id and read once; prediction reads every
whole text.

Defined cases: a null or empty text has no term and gets the bias; labels given
twice for an id count as toxic if one is; null labels and ids are left out; with
one label only, or none, every score is 0 for no toxic row and else the rate;
repeated rows get equal scores; cells and pairs of equal z are taken by number;
texts may be of any length; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from catalens.llm.common import fold, hashed_share, ship, slices
from catalens.shared import materialize

DIM = 1 << 20
RANK = 8
KEPT = 20_000
PAIRED, PAIRS = 1500, 1000
WORDS = re.compile(r"[^\W_]+")
CACHE = 200_000
#: Cells of texts that the fit has factors for at once: the driver has little memory.
AT_ONCE = 1 << 14


def cells(word: str) -> list[int]:
    """Cells of a word and of its starts."""
    half = DIM // 2
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) % half]
    for n in range(2, min(7, len(word)) + 1):
        out.append(half + zlib.crc32(b"s" + word[:n].encode("utf-8", "replace")) % half)
    return out


def words(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


class Terms:
    """Positions of the kept cells of texts; remembers the words it has seen, and what those with such cells have."""

    def __init__(self, index: dict[int, int]):
        self.index, self.seen, self.hits = index, set(), {}

    def of(self, text: str | None) -> list[int]:
        found = words(text)
        if len(self.seen) > CACHE:
            self.seen, self.hits = set(), {}
        for w in found - self.seen:
            if t := [self.index[c] for c in cells(w) if c in self.index]:
                self.hits[w] = t
        self.seen |= found
        return sorted(set().union(*map(self.hits.__getitem__, found & self.hits.keys())))


def sums(a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of rows of ``a``, given so many a group, the sums of groups."""
    out = np.zeros((len(lengths), *a.shape[1:]))
    full = lengths > 0
    if len(a):
        out[full] = np.add.reduceat(a, np.concatenate(([0], np.cumsum(lengths)[:-1]))[full], axis=0)
    return out


def runs(lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Cut groups of so many cells into runs of at most ``AT_ONCE`` cells, or one group: its groups' and its cells' bounds."""
    ends = np.cumsum(lengths)
    first = at = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, at + AT_ONCE, "right")))
        yield first, last, at, int(ends[last - 1])
        first, at = last, int(ends[last - 1])


def places(row: np.ndarray, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Positions in ``keys`` of those cells of ``row`` that stand there, in the row's order; ``order`` sorts ``keys``."""
    at = order[np.minimum(np.searchsorted(keys, row, sorter=order), len(keys) - 1)]
    return at[keys[at] == row].astype(np.int32)


@dataclass
class Machine:
    bias: float
    index: dict[int, int] = field(default_factory=dict)
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Scores of texts, by the positions of their cells."""
        lengths = np.array([len(r) for r in rows], np.int64)
        at = np.concatenate([np.array(r, np.int64) for r in rows]) if lengths.sum() else np.zeros(0, np.int64)
        s = np.full(len(rows), float(self.bias))
        if len(at):
            v = (self.factors * self.value[:, None])[at]
            s += sums((self.weight * self.value)[at], lengths) + 0.5 * ((sums(v, lengths) ** 2).sum(1) - sums((v * v).sum(1), lengths))
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))

    def score(self, terms: list[int]) -> float:
        return float(self.scores([terms])[0])


def train(rows: Sequence[Sequence[int]], y: np.ndarray, weights: np.ndarray, value: np.ndarray, rounds: int = 250, rate: float = 0.05, penalty: float = 2e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the whole (bounded) sample, a run of texts or cells at a time."""
    n, d = len(rows), len(value)
    lengths = np.array([len(r) for r in rows])
    col = np.concatenate([np.asarray(r, np.int32) for r in rows]) if lengths.sum() else np.zeros(0, np.int32)
    at = np.repeat(np.arange(n, dtype=np.int32), lengths)[np.argsort(col, kind="stable")]  # by cell
    used, times = np.unique(col, return_counts=True)
    by_text, by_cell = list(runs(lengths)), list(runs(times))

    rng = np.random.default_rng(7)
    params = [np.array([np.log(max((weights * y).sum(), 1e-9) / max((weights * (1 - y)).sum(), 1e-9))]), np.zeros(d), rng.normal(0, 0.02, (d, RANK))]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = weights / weights.sum()
    both, z = np.zeros((n, RANK)), np.zeros(n)
    for step in range(1, rounds + 1):
        bias, w, v = params
        for first, last, start, end in by_text:
            c, own = col[start:end], lengths[first:last]
            x = value[c]
            vx = v[c] * x[:, None]
            both[first:last] = sums(vx, own)
            z[first:last] = bias + sums(w[c] * x, own) + 0.5 * ((both[first:last] ** 2).sum(1) - sums((vx * vx).sum(1), own))
        g = share * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grads = [np.array([g.sum()]), penalty * w, penalty * v]
        for first, last, start, end in by_cell:
            c, own, t = used[first:last], times[first:last], at[start:end]
            x = np.repeat(value[c], own)
            gx = (g[t] * x)[:, None]
            grads[1][c] += sums(gx, own)[:, 0]
            grads[2][c] += sums(gx * (both[t] - np.repeat(v[c], own, axis=0) * x[:, None]), own)
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.999 * s[i] + 0.001 * grad * grad
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, negatives: int = 8000) -> Machine:
    """Fit on at most ``positives`` and ``negatives`` ids of ``labels`` (doc_id, toxic), all of which may be learned from.

    Of several texts of one id the one of the least hash is learned from.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Machine(-35.0 if not counts.get(1) else 35.0)
    share = {1: min(1.0, positives / counts[1]), 0: min(1.0, negatives / counts[0])}
    at = hashed_share(F.col("doc_id"))
    # a fifth more than asked for, then the least hashes: whatever ids there are, no more than the parameters
    most = {1: positives, 0: negatives}
    chosen = reduce(DataFrame.unionByName, [known.filter((F.col("y") == y) & (at < 1.2 * share[y])).orderBy(at, "doc_id").limit(most[y]) for y in (0, 1)])

    def encode(batches):
        memory: dict[str, list[int]] = {}
        least: dict[int, tuple[int, int, np.ndarray]] = {}
        for b in slices(batches):
            texts = b.column("text")
            for i, (d, key, y) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("y").to_pylist())):
                if d in least and least[d][0] <= key:
                    continue
                if len(memory) > CACHE:
                    memory.clear()
                least[d] = (key, y, np.array(sorted({c for w in words(texts[i].as_py()) for c in (memory.get(w) or memory.setdefault(w, cells(w)))}), np.int32))
        held = list(least.items())
        for s in range(0, len(held), 256):
            ids, keys, ys, found = zip(*((d, *x) for d, x in held[s : s + 256]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(ys, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "key", "y", "cells"])

    # chosen has at most positives + negatives ids; a task gives a row an id
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "key", "y")
    sample = sample.mapInArrow(encode, "doc_id long, key long, y int, cells array<int>").groupBy("doc_id", "y").agg(F.min_by("cells", "key").alias("cells"))
    sample = materialize(sample, "sample")

    def count(batches):
        seen = np.zeros((2, DIM), np.int32)
        for b in batches:
            for found, y in zip(b.column("cells"), b.column("y").to_pylist()):
                seen[y, found.values.to_numpy()] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen[0, at].astype(np.int64)), pa.array(seen[1, at].astype(np.int64))], ["cell", "n0", "n1"])

    totals = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if len(totals) < 2:
        return Machine(-35.0 if not totals.get(1) else 35.0)
    n0, n1 = float(totals[0]), float(totals[1])
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    error = F.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)
    table = materialize(sample.mapInArrow(count, "cell long, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "cells")
    kept = (
        table.filter(F.col("n0") + F.col("n1") >= 3).select("cell", (F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))).alias("odds"), (F.abs(p1 - p0) / error).alias("z"))
        .filter("z >= 3 AND abs(odds) >= 0.7").orderBy(F.desc("z"), "cell").limit(KEPT).collect()
    )
    frequent = [r["cell"] for r in table.filter((F.col("cell") < DIM // 2) & (F.col("n0") + F.col("n1") >= 20)).orderBy(F.desc(F.col("n0") + F.col("n1")), "cell").limit(PAIRED).collect()]
    index = {r["cell"]: i for i, r in enumerate(kept)}
    wanted = np.array(sorted({*index, *frequent}), np.int32)

    def chosen_cells(batches):
        for b in batches:
            out = [x[np.isin(x, wanted, assume_unique=True)] for x in (c.values.to_numpy() for c in b.column("cells"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "y", "cells"])

    # As Arrow: Python's or Java's own integers of these cells would take some ten times their bytes on the driver.
    found = sample.mapInArrow(chosen_cells, "doc_id long, y int, cells array<int>").toArrow().combine_chunks()
    lists, by_id = found["cells"].combine_chunks(), np.argsort(found["doc_id"].to_numpy())
    ends, all_cells = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [all_cells[ends[i] : ends[i + 1]] for i in by_id]
    y = found["y"].to_numpy()[by_id].astype(float)
    value = [min(1.0, abs(r["odds"]) / 3) for r in kept]
    for cell in telling(rows, y, frequent):
        if cell not in index:
            index[cell] = len(index)
            value.append(0.5)
    machine = Machine(0.0, index, np.array(value))
    weights = np.where(y == 1, 1 / share[1], 1 / share[0])
    keys = np.array(list(index), np.int32)
    order = np.argsort(keys)
    machine.bias, machine.weight, machine.factors = train([places(r, keys, order) if len(keys) else () for r in rows], y, weights, machine.value)
    return machine


def telling(rows: Sequence[np.ndarray], y: np.ndarray, frequent: list[int]) -> list[int]:
    """The cells of ``frequent`` in pairs that tell of a label beyond what both alone do, best pairs first."""
    if not frequent:
        return []
    keys = np.array(frequent)
    order = np.argsort(keys)
    both, n = [], []
    for label in (0, 1):
        own = [r for r, v in zip(rows, y) if v == label]
        together = np.zeros((len(frequent), len(frequent)), np.float32)
        for s in range(0, len(own), 1024):
            part = own[s : s + 1024]
            x = np.zeros((len(part), len(frequent)), np.float32)
            for i, r in enumerate(part):
                x[i, places(r, keys, order)] = 1
            together += x.T @ x
        both.append(together)
        n.append(len(own) + 1.0)
    alone = [np.diag(c).astype(np.float64) + 0.5 for c in both]
    own = np.log(alone[1] / n[1]) - np.log(alone[0] / n[0])
    at, found = [], []
    for s in range(0, len(frequent), 128):  # a few rows at once: the driver has little memory
        b0, b1 = (c[s : s + 128].astype(np.float64) + 0.5 for c in both)
        ratio = np.log(b1 / n[1]) - np.log(b0 / n[0])
        error = np.sqrt(1 / b0 + 1 / b1 + sum(1 / a[s : s + 128, None] + 1 / a[None, :] for a in alone))
        z = np.triu(np.abs(ratio - own[s : s + 128, None] - own[None, :]) / error, 1 + s)
        # the pair itself has to tell, too: words that only repeat each other don't
        z[(np.abs(ratio) < 0.7) | (np.abs(ratio) < np.maximum(np.abs(own)[s : s + 128, None], np.abs(own)[None, :])) | (z < 5)] = 0
        some = np.flatnonzero(z)
        at.append(some + s * len(frequent))
        found.append(z.ravel()[some])
    pairs = np.concatenate(at)[np.argsort(-np.concatenate(found), kind="stable")[:PAIRS]]
    out = dict.fromkeys(frequent[k] for p in pairs for k in divmod(int(p), len(frequent)))
    return list(out)


def predict(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, score and predicted for every row, whatever else ``docs`` has."""

    def run(batches):
        terms = Terms(machine.index)
        for b in slices(batches):
            scores = machine.scores([terms.of(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Fit on labels outside the held-out fold; score every row of ``docs``."""
    machine = fit(docs, labels.filter(fold(F.col("doc_id"), folds) != held))
    out = predict(docs, machine)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, as they are, whatever their columns' names."""

    def run(batches):
        terms = Terms(machine.index)
        for b in slices(batches):
            rows = b.column("_doc")
            keep = machine.scores([terms.of(t) for t in pc.struct_field(rows, "text").to_pylist()]) < 0.5
            yield pa.RecordBatch.from_arrays([rows.filter(pa.array(keep))], ["_doc"])

    return docs.select(F.struct("*").alias("_doc")).mapInArrow(run, StructType([StructField("_doc", docs.schema)])).select("_doc.*")


ship(__name__)

"""Nearest neighbours by score-aware anisotropic quantisation and exact reranking.

The nearest vectors by Euclidean distance are those of largest
``<q, x> - |x|^2 / 2``, so the search is a maximum inner product search. Vectors
are product-quantised, ``WIDTH`` components and 16 codewords a part (four bits);
codebooks and codes minimise a loss that weighs the residual parallel to the
vector ``eta`` times the rest, as it is what distorts large inner products.

The scan reads codes and norms only, not vectors: it adds one table entry a part
for each vector, all queries of a block at once. A row is a candidate where its
estimate is within the query's cutoff: the ``k``-th distance in the sample, which
no nearest neighbour exceeds, plus the error that the codes of the sample show
for this query (all but a thousandth of them), and, as the scan goes on, the
``LOCAL``-th best estimate of the task. The ``rerank`` best estimates of all tasks
are ranked exactly: the candidates' places are brought to the files of the vectors
(``common.met``), so a query costs at most ``rerank`` exact distances.

Codebooks are fitted on at most 1.5 x ``sample`` vectors, chosen by a hash of the
id; every row is indexed. Queries are taken in blocks of at most ``QUERIES``,
broadcast one block at a time, so what is broadcast does not grow.

Defined cases: null vectors, zero vectors, vectors with a null, NaN or infinite
component, vectors of other than the commonest length and rows of null id take
no part; of several rows of one id the smallest vector is the query, and none of
them is a candidate for it; ties go to the smaller id; with fewer candidates
than ``k`` all are returned; components of any finite size are allowed (codes are
of scaled vectors; a distance beyond a double is infinite); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.common import boxed, hashed_share, met, ship
from catalens.shared import materialize

WIDTH = 2
WORDS = 16
THRESHOLD = 0.2
SAMPLE = 8192
QUERIES = 16_384
AT_ONCE = 128
RUN = 4096
LOCAL = 128
CLOSE = 0.999


@dataclass
class Quantiser:
    books: np.ndarray  # parts x 16 x WIDTH
    eta: float

    @property
    def parts(self) -> int:
        return len(self.books)

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows as n x parts x WIDTH, zeros beyond the last component."""
        full = np.zeros((len(x), self.parts * WIDTH), np.float32)
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), self.parts, WIDTH)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of rows by coordinate descent on the anisotropic loss."""
        v = self.split(x)
        u = v / np.sqrt(np.maximum((v * v).sum((1, 2), keepdims=True), 1e-30))
        rows = np.arange(len(x))
        out = np.zeros((len(x), self.parts), np.uint8)
        along = np.zeros((len(x), self.parts), np.float32)
        for p in range(self.parts):
            r = v[:, p, None, :] - self.books[p][None]
            out[:, p] = (r * r).sum(2).argmin(1)
            along[:, p] = (r[rows, out[:, p]] * u[:, p]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for p in range(self.parts):
                r = v[:, p, None, :] - self.books[p][None]
                a = np.einsum("nwd,nd->nw", r, u[:, p])
                rest = total - along[:, p]
                loss = (r * r).sum(2) + (self.eta - 1) * (rest[:, None] + a) ** 2
                out[:, p] = loss.argmin(1)
                along[:, p] = a[rows, out[:, p]]
                total = rest + along[:, p]
        return out

    def decoded(self, codes: np.ndarray, d: int) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.books[np.arange(self.parts)[None, :], codes].reshape(len(codes), -1)[:, :d]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: n x parts x 16."""
        return np.einsum("npd,pwd->npw", self.split(q), self.books)


def train(x: np.ndarray, rounds: int = 6) -> Quantiser:
    """Codebooks for rows of ``x``: k-means, then codes and least-squares codewords in turn."""
    d = x.shape[1]
    parts = -(-d // WIDTH)
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    q = Quantiser(np.zeros((parts, WORDS, WIDTH), np.float32), eta)
    v = q.split(x)
    rng = np.random.default_rng(3)
    for p in range(parts):
        c = v[rng.choice(len(x), WORDS, replace=len(x) < WORDS), p].copy()
        for _ in range(12):
            near = ((v[:, p, None, :] - c[None]) ** 2).sum(2).argmin(1)
            n = np.bincount(near, minlength=WORDS)
            for k in range(WIDTH):
                s = np.bincount(near, v[:, p, k], minlength=WORDS)
                c[:, k] = np.where(n > 0, s / np.maximum(n, 1), c[:, k])
        q.books[p] = c
    u = v / np.sqrt(np.maximum((v * v).sum((1, 2), keepdims=True), 1e-30))
    for _ in range(rounds):
        codes = q.codes(x, 1)
        rows = np.arange(parts)[None, :]
        along = ((v - q.books[rows, codes]) * u).sum(2)
        total = along.sum(1)
        for p in range(parts):
            rest = total - along[:, p]
            for w in range(WORDS):
                at = codes[:, p] == w
                if at.any():
                    up, vp = u[at, p], v[at, p]
                    left = at.sum() * np.eye(WIDTH) + (eta - 1) * (up.T @ up)
                    right = (vp + (eta - 1) * up * (rest[at] + (vp * up).sum(1))[:, None]).sum(0)
                    q.books[p, w] = np.linalg.solve(left, right)
            along[:, p] = ((v[:, p] - q.books[p, codes[:, p]]) * u[:, p]).sum(1)
            total = rest + along[:, p]
    return q


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and x (array of double) of the rows that take part, and their length."""
    x = F.col("embedding").cast("array<double>")
    good = F.expr("size(x) > 0 AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf')) AND exists(x, v -> v <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL").filter(good)
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 0
    return rows.filter(F.size("x") == d), d


def search(vectors: DataFrame, k: int = 10, every: int = 100, rerank: int = 1000, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, d = usable(vectors)
    if not d:
        return nothing
    n, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("x", F.abs)))).first()
    chosen = rows.filter(hashed_share(F.col("vec_id")) < min(1.0, sample / n)).orderBy("vec_id").limit(sample * 3 // 2).collect()
    if not chosen:
        chosen = rows.limit(WORDS).collect()
    seen, seen_id = np.array([r["x"] for r in chosen], np.float64) / largest, np.array([r["vec_id"] for r in chosen])
    quantiser = train(seen.astype(np.float32))

    def encode(batches):
        for b in batches:
            x = (matrix(b.column("x"), d) / largest).astype(np.float32)
            c = quantiser.codes(x)
            if c.shape[1] % 2:
                c = np.concatenate([c, np.zeros((len(c), 1), np.uint8)], axis=1)
            packed = c[:, ::2] | (c[:, 1::2] << 4)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array((x * x).sum(1) / 2), pa.array([r.tobytes() for r in packed], pa.binary())], ["vec_id", "x", "half", "codes"])

    index = materialize(rows.mapInArrow(encode, "vec_id long, x array<double>, half float, codes binary"), "index")
    learned = spark.sparkContext.broadcast((seen.astype(np.float32), seen_id, quantiser.decoded(quantiser.codes(seen.astype(np.float32)), d)))

    def cutoff(batches):
        x, ids, known = learned.value
        half = (x * x).sum(1) / 2
        for b in batches:
            for s in range(0, b.num_rows, AT_ONCE):
                part = b.slice(s, AT_ONCE)
                q, own = (matrix(part.column("x"), d) / largest).astype(np.float32), part.column("query_id").to_numpy(zero_copy_only=False)
                away = half - q @ x.T
                error = half - q @ known.T - away
                away[own[:, None] == ids[None, :]] = np.inf
                most = np.full(len(q), np.inf) if len(x) < k else np.partition(away, k - 1, axis=1)[:, k - 1] + np.quantile(error, CLOSE, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("x"), pa.array(most.astype(np.float64))], ["query_id", "x", "most"])

    queries = index.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x"))
    queries = materialize(queries.mapInArrow(cutoff, "query_id long, x array<double>, most double"), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    found = []
    for block in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if not asked:
            continue
        asked.sort(key=lambda r: r["query_id"])
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in asked]), np.array([r["x"] for r in asked], np.float64), np.array([r["most"] for r in asked], np.float32)))
        codes = boxed(index).select("_file", "_row", "_doc.vec_id", "_doc.half", "_doc.codes")
        near = codes.mapInArrow(_scan(shared, quantiser, largest), "query int, _file long, _row long, vec_id long, away float")
        at = F.row_number().over(Window.partitionBy("query").orderBy("away", "vec_id", "_file", "_row"))
        near = near.withColumn("at", at).filter(F.col("at") <= rerank).groupBy("_file", "_row").agg(F.collect_list("query").alias("_value"))
        found.append(met(index, near, lambda r, q=shared: r.select("_doc.vec_id", "_doc.x", "_value").mapInArrow(_exact(q, d), "query_id long, vec_id long, score double"), F.size("_value") * 4))
    if not found:
        return nothing
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(found: list[np.ndarray], m: int) -> list[np.ndarray]:
    """Of (query, away, id, file, row), the ``m`` of each query of least (away, id), by query."""
    order = np.lexsort((found[2], found[1], found[0]))
    query = found[0][order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate((first, [len(query)]))))
    return [c[order[rank < m]] for c in found]


def _scan(shared, quantiser: Quantiser, largest: float):
    """A function over codes that gives each query's candidates of its partition, at most ``LOCAL``."""

    def runs(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= RUN:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def scan(batches):
        ids, q, most = shared.value
        q, most = (q / largest).astype(np.float32), most.copy()
        best: dict[int, list[np.ndarray]] = {}
        for b in runs(batches):
            vec, half, file, row = (b.column(c).to_numpy() for c in ("vec_id", "half", "_file", "_row"))
            packed = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(vec), -1)
            codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(vec), -1)[:, : quantiser.parts].T.copy()
            for a in range(0, len(ids), AT_ONCE):
                part = slice(a, min(a + AT_ONCE, len(ids)))
                tables = quantiser.tables(q[part])
                away = np.broadcast_to(half, (len(tables), len(vec))).copy()
                for p in range(quantiser.parts):
                    away -= tables[:, p].take(codes[p], axis=1)
                near = (away <= most[part, None]) & (ids[part][:, None] != vec[None, :])
                if near.sum() > LOCAL * len(tables):
                    kept = np.where(near, away, np.inf)
                    near &= away <= np.partition(kept, min(LOCAL, len(vec)) - 1, axis=1)[:, min(LOCAL, len(vec)) - 1 :][:, :1]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                new = [(a + i).astype(np.int32), away[i, j], vec[j], file[j], row[j]]
                new = _best([np.concatenate(x) for x in zip(best[a], new)] if a in best else new, LOCAL)
                counts = np.bincount(new[0] - a, minlength=len(tables))
                full = np.flatnonzero(counts >= LOCAL)
                most[a + full] = np.minimum(most[a + full], new[1][np.cumsum(counts)[full] - 1])
                best[a] = new
        for query, away, vec, file, row in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(file), pa.array(row), pa.array(vec), pa.array(away)], ["query", "_file", "_row", "vec_id", "away"])

    return scan


def _exact(shared, d: int):
    """A function over (vec_id, x, positions of queries) that gives exact distances."""

    def rank(batches):
        ids, q, _ = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                b = whole.slice(s, 64)
                asked = b.column("_value")
                at, query = np.repeat(np.arange(b.num_rows), [len(v) for v in asked]), asked.flatten().to_numpy()
                x, vec = matrix(b.column("x"), d), b.column("vec_id").to_numpy(zero_copy_only=False)
                for k in range(0, len(at), 16_384):
                    i, j = at[k : k + 16_384], query[k : k + 16_384]
                    with np.errstate(over="ignore", invalid="ignore"):
                        diff = x[i] - q[j]
                        far = np.sqrt((diff * diff).sum(1))
                        beyond = ~np.isfinite(far) | (far < 1e-150)
                        if beyond.any():  # the squares left a double's range, the distance need not
                            half = x[i[beyond]] / 2 - q[j[beyond]] / 2
                            large = np.abs(half).max(1)
                            part = half / np.where(large > 0, large, 1)[:, None]
                            far[beyond] = 2 * (large * np.sqrt((part * part).sum(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(vec[i]), pa.array(far)], ["query_id", "vec_id", "score"])

    return rank


ship(__name__)

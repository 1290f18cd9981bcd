"""SimHash near-duplicates by the general pigeonhole principle.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of
its word shingles. Fingerprints within ``bits`` differing bits are linked and
documents get the smallest id reachable over links.

Search: correlated bits are grouped into m partitions. With thresholds t_i >= -1
of sum ``bits - m + 1``, two fingerprints within ``bits`` agree up to t_i bits in
some partition i. Dynamic programming picks m and unequal thresholds by the
candidate counts estimated on a bounded sample, scaled to the real number of
fingerprints. Fingerprints that agree in a partition apart from t_i masked bits
meet in a bucket, where they are compared exactly; a bucket passes on the
components it finds as stars, not its pairs. Buckets over ``BLOCK`` fingerprints
are cut into blocks, each pair of blocks a group of its own, so none is dropped.

Equal fingerprints are one item throughout, so copies cost nothing.

Defined cases: a text without a word, or null, has fingerprint zero and is linked
like any other; a text of fewer words than a shingle is one shingle; repeated
rows are all returned; a null id takes no part in the smallest id, and where a
component has only null ids its id is null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import boxed, met, scanned, ship, slices
from catalens.llm.components import components
from catalens.shared import BROADCAST_BYTES, materialize, numbered, small

BLOCK = 4096
HOT = BROADCAST_BYTES // 64  # rows of a list of hot keys that may be broadcast
MARKS = 1 << 20
COUNTED = 1 << 15  # rows of a task whose buckets are counted at once
SAMPLE = 20_000
SEED = 42
ROW_COST, PAIR_COST = 1.0, 0.004
#: Fingerprints of a text for near copies, how many are compared where two texts meet, and the bits that may differ: in one of them for sure, and in those compared.
WORDS, COMPARED, NEAR, WIDE = 8, 3, 6, 52
SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, np.uint64)


# --- Fingerprints ----------------------------------------------------------


def shingles(text: str | None, words: int) -> list[bytes]:
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())]


def simhash(text: str | None, words: int, seed: int = SEED, distinct: bool = False) -> int:
    """The fingerprint as a signed 64-bit number; ``distinct`` counts each shingle once."""
    parts = shingles(text, words)
    return majority(set(parts) if distinct else parts, seed)


def majority(parts, seed: int) -> int:
    if not parts:
        return 0
    one = xxhash.xxh64_intdigest
    h = np.array([one(s, seed) for s in parts], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (signed) of every row."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([simhash(t, words) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# --- Partitions and thresholds ---------------------------------------------


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, correlated bits together."""
    x = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    x -= x.mean(0)
    norm = np.sqrt((x * x).sum(0))
    c = np.abs((x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9))
    np.fill_diagonal(c, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        rest = sorted(left)
        group = [max(rest, key=lambda i: (c[i, rest].sum(), -i))]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda i: (c[i, group].sum(), -i))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def masks_of(bits: list[int], threshold: int) -> list[int]:
    """What two fingerprints must share, for each choice of ``threshold`` free bits of a partition."""
    whole = sum(1 << b for b in bits)
    return [whole - sum(1 << b for b in free) for free in combinations(bits, threshold)]


def cost(sample: np.ndarray, n: int, bits: list[int], threshold: int) -> float:
    """Rows to deal out and pairs to compare for a partition at a threshold, for ``n`` fingerprints."""
    if threshold < 0:
        return 0.0
    masks = masks_of(bits, threshold)
    tried = masks[:: max(1, len(masks) // 12)]
    pairs = 0.0
    for m in tried:
        _, c = np.unique(sample & np.uint64(m), return_counts=True)
        pairs += float((c * (c - 1)).sum()) / 2
    seen = pairs / len(tried) / max(1, len(sample) * (len(sample) - 1) / 2)
    chance = max(seen, 2.0 ** (threshold - len(bits)))
    return len(masks) * (n * ROW_COST + chance * n * (n - 1) / 2 * PAIR_COST)


def allocate(sample: np.ndarray, n: int, within: int) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds of least estimated cost; thresholds of -1 are left out."""
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, 9):
        groups = grouped_bits(sample, m)
        total = within - m + 1
        # state: the sum of (threshold + 1) so far; the last sum must be total + m
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            new: dict[int, tuple[float, list[int]]] = {}
            for t in range(-1, min(within, 3) + 1):
                if comb(len(g), max(t, 0)) > 2000:
                    continue
                c = cost(sample, n, g, t)
                for s, (was, chosen) in table.items():
                    if s + t + 1 <= total + m and (s + t + 1 not in new or was + c < new[s + t + 1][0]):
                        new[s + t + 1] = (was + c, [*chosen, t])
            table = new
        if total + m in table and table[total + m][0] < best[0]:
            best = (table[total + m][0], [(g, t) for g, t in zip(groups, table[total + m][1]) if t >= 0])
    if not best[1]:
        raise ValueError(f"no thresholds for {within} differing bits; up to 31 of 64 have some")
    return best[1]


# --- Probing ---------------------------------------------------------------


def stars(nodes: np.ndarray, bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Components of a bucket as (smallest node, other).

    ``bits`` has a row of 64-bit numbers a node; two nodes are linked if at most
    ``most`` bits of all their numbers differ. All pairs are tried, 256 rows at a time.
    """
    order = np.argsort(nodes)
    nodes, n = nodes[order], len(nodes)
    columns = [np.ascontiguousarray(c) for c in bits[order].T]
    linked = np.zeros((n, n), bool)
    for s in range(0, n, 256):
        apart = np.bitwise_count(columns[0][s : s + 256, None] ^ columns[0][None, :]).astype(np.uint8 if len(columns) < 4 else np.uint16)
        for c in columns[1:]:
            apart += np.bitwise_count(c[s : s + 256, None] ^ c[None, :])
        near = apart <= most
        near[np.arange(len(near)), s + np.arange(len(near))] = False
        linked[s : s + 256] = near
    out = []
    left = linked.any(1)
    while (at := np.flatnonzero(left)).size:
        root = at[0]
        left[root] = False
        todo = [root]
        while todo:
            found = np.flatnonzero(linked[todo.pop()] & left)
            left[found] = False
            todo.extend(found)
            out.extend((int(nodes[root]), int(nodes[k])) for k in found)
    return out


def links(items: DataFrame, within: int, turns: Sequence[Sequence[str]] = (("fp",),), wide: int | None = None) -> DataFrame:
    """(a, b): enough verified connections of ``items`` (node, fingerprints) to give their components.

    Each of ``turns`` searches its first fingerprint: items that differ in at most ``within``
    bits of it meet, and so do others that agree in a partition. Those that meet are linked if
    all fingerprints of the turn together differ in at most ``wide`` bits (``within`` unless given).
    Turns have equally many fingerprints, hashed alike, so they share partitions.
    """
    n = items.count()
    share = min(1.0, SAMPLE / max(1, n))
    chosen = items.filter(F.pmod(F.xxhash64(F.lit(17), "node"), F.lit(1 << 30)) < int(share * (1 << 30))).select(turns[0][0]).limit(2 * SAMPLE).collect()
    sample = np.array(sorted(r[0] for r in chosen), np.int64).view(np.uint64)
    plan = allocate(sample, n, within) if n > 1 and len(sample) > 1 else [([*range(64)], 0)] if within == 0 else [(g, 0) for g in np.array_split(range(64), within + 1)]
    keeps = np.array([m for g, t in plan for m in masks_of([int(x) for x in g], t)], np.uint64)
    carried = [f"f{i}" for i in range(len(turns[0]))]
    most = within if wide is None else wide

    def keyed(batch):
        """(mask's number, masked values) for each turn and mask, with the turn."""
        for t, turn in enumerate(turns):
            fp = batch.column(turn[0]).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, m in enumerate(keeps):
                yield t * len(keeps) + k, (fp & m).view(np.int64), turn

    def keys(batches):
        for b in slices(batches, 4096):
            for k, value, turn in keyed(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value), b.column("node"), *[b.column(c) for c in turn]], ["mask", "value", "node", *carried])

    def sizes(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            for b in whole:
                for k, value, _ in keyed(b):
                    own, c = np.unique(value, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own), pa.array(c)], ["mask", "value", "n"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= COUNTED:
                yield from flush()
        if held:
            yield from flush()

    longs = ", ".join(f"{c} long" for c in ["node", *carried])
    dealt = items.select("node", *dict.fromkeys(c for t in turns for c in t)).mapInArrow(keys, f"mask int, value long, {longs}")
    carried = ["node", *carried]
    full = items.select(*dict.fromkeys(t[0] for t in turns)).mapInArrow(sizes, "mask int, value long, n long").groupBy("mask", "value").agg(F.sum("n").alias("count"))
    hot = materialize(full.filter(F.col("count") > BLOCK), "hot")
    if hot.count():
        dealt = dealt.join(small(hot, HOT), ["mask", "value"], "left").withColumn("blocks", F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("int"))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(F.lit(23), "node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("mask", "value", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), *carried)
    else:
        dealt = dealt.select("mask", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), *carried)
    key = ["mask", "value", "x", "y"]

    def search(batches):
        held: list[np.ndarray] = []
        at = None

        def flush():
            if sum(map(len, held)) < 2:
                return []
            all_ = np.concatenate(held)
            return stars(all_[:, 0], all_[:, 1:].view(np.uint64), most)

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in key]
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in carried], axis=1)
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            out: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                k = tuple(int(c[s]) for c in cols)
                if k != at:
                    out += flush()
                    held, at = [], k
                held.append(rows[s:e])
            yield batch(out)
        yield batch(flush())

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "a long, b long")


def classes(items: DataFrame, within: int, turns: Sequence[Sequence[str]] = (("fp",),), wide: int | None = None) -> DataFrame:
    """(node, root) for every item of a component of two or more; ``items`` is a written table."""
    roots = materialize(components(links(items, within, turns, wide)), "components")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, words: int = 4, within: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    items = materialize(rows.groupBy(F.col("fp").alias("node")).agg(F.first("fp").alias("fp"), F.min("doc_id").alias("rep")), "items")
    known = classes(items, within).join(items, "node").select("node", "root", "rep")
    # Written first, so that a root of very many nodes is a join's key, which can be split, and no aggregate's.
    known = materialize(known, "known")
    least = materialize(known.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = known.join(least.hint("merge"), "root").select("node", "component_id")
    whole = materialize(items.join(named, "node", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "named")
    return rows.join(whole.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- One document of each group of near copies ------------------------------


def marks(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct five-word shingles, ascending."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in set(shingles(text, 5))], np.uint64))


def similar(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Components of sets linked by an exact Jaccard similarity of ``least``, as (smallest node, other)."""
    order = np.argsort(nodes)
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(order)), sizes)
    ends = np.cumsum(sizes)
    left, rest, whose = np.ones(len(order), bool), ids, owner
    has = np.zeros(ids.max(initial=-1) + 1, bool)
    most, out = round(least * 10**6), []
    for root in range(len(order)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            own = ids[ends[at] - sizes[at] : ends[at]]
            has[own] = True
            both = np.bincount(whose[has[rest]], minlength=len(order))
            has[own] = False
            found = np.flatnonzero(left & (both > 0) & (both * 10**6 >= most * (sizes + sizes[at] - both)))
            if len(found):
                left[found] = False
                still = left[whose]
                rest, whose = rest[still], whose[still]
                todo.extend(found.tolist())
                out.extend((int(nodes[order[root]]), int(nodes[order[k]])) for k in found)
    return out


def verified(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links by exact similarity inside each root of ``sets`` (root, node, n, marks), a written table.

    Each root's sets meet in one group; roots of over ``MARKS`` hashes are cut
    into blocks, each pair of blocks a group of its own.
    """
    hot = materialize(sets.groupBy("root").agg(F.ceil(F.sum("n") / MARKS).cast("int").alias("blocks")).filter("blocks > 1"), "hot")
    if hot.count():
        dealt = sets.join(small(hot, HOT), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(F.lit(23), "node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("root", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", "marks")
    else:
        dealt = sets.select("root", F.lit(0).alias("x"), F.lit(0).alias("y"), "node", "marks")
    key = ["root", "x", "y"]

    def search(batches):
        nodes: list[int] = []
        held: list[np.ndarray] = []
        at = None

        def batch():
            out = similar(np.array(nodes), held, least) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in [*key, "node"]]
            lists = b.column("marks")
            for i, (*k, node) in enumerate(zip(*cols)):
                if k != at:
                    yield batch()
                    nodes, held, at = [], [], k
                nodes.append(node)
                held.append(lists[i].values.to_numpy().copy())
        yield batch()

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "a long, b long")


def words_of(h: np.ndarray) -> list[int]:
    """``WORDS`` SimHash fingerprints (signed) of a set of hashes, each by a hash function of its own; none of an empty set."""
    if not len(h):
        return []
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 255):
        z = h[i : i + 255, None] ^ SALTS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)  # 255 at most
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.int64).tolist()


def first_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` without the near copies of an earlier row (by id, then place in the files).

    Two texts are linked if their sets of distinct five-word shingles have a
    Jaccard similarity of ``least``, checked exactly on the hashes. Compared are
    the texts of components of a coarser graph, found by SimHash and the general
    pigeonhole principle: a text has ``WORDS`` fingerprints, texts that differ in
    at most ``NEAR`` bits of one of them meet for sure, others where they agree in
    a partition apart from its threshold, and those that meet are joined if that
    fingerprint and the next ones, ``COMPARED`` in all, differ in at most ``WIDE``
    bits. At 0.8 a bit differs with a probability of 0.15, so the larger part of
    the meetings are of the second kind; what is found of all pairs is in README.
    Texts of equal sets are one item.

    Defined cases: null texts and texts without a word have the empty set and are
    copies of each other; a text of fewer than five words is one shingle; of
    repeated rows the first place stays; a null id counts as the smallest; texts
    may be of any length; an empty table gives an empty result; all columns are
    kept, whatever their names.
    """
    docs = scanned(docs)

    def run(batches):
        for b in slices(batches):
            digests, found = [], []
            for t in b.column("text").to_pylist():
                h = marks(t)
                digests.append([xxhash.xxh64_intdigest(h.tobytes(), seed) for seed in (1, 2)])
                found.append(words_of(h))
            cols = [pa.array(c) for c in np.array(digests, np.uint64).reshape(-1, 2).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([b.column("_file"), b.column("_row"), b.column("doc_id"), *cols, pa.array(found, pa.list_(pa.int64()))], ["_file", "_row", "doc_id", *keys, "words"])

    def unpack(batches):
        for b in slices(batches):
            sets = [marks(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["root", "node", "n", "marks"])

    keys = ["d1", "d2"]
    rows = boxed(docs).select("_file", "_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.col("_doc.text").alias("text"))
    rows = materialize(rows.mapInArrow(run, "_file long, _row long, doc_id long, d1 long, d2 long, words array<long>"), "fingerprints")
    # Joins are merge joins at any size, of places and hashes only; a hot key's side is split by the adaptive planner.
    # Each set's first row has its fingerprints, so that copies cost nothing.
    firsts = rows.groupBy(*keys).agg(F.min(F.struct("_file", "_row")).alias("at"))
    items = numbered(firsts.select(*keys, "at._file", "at._row"), keys, "node")
    names = [f"w{k}" for k in range(WORDS)]
    told = rows.filter(F.size("words") > 0).select("_file", "_row", *[F.col("words")[k].alias(w) for k, w in enumerate(names)])
    told = materialize(told.join(items.select("_file", "_row", "node").hint("merge"), ["_file", "_row"]).select("node", *names), "items")
    coarse = classes(told, NEAR, [[names[(k + i) % WORDS] for i in range(COMPARED)] for k in range(WORDS)], WIDE)
    chosen = items.join(coarse.hint("merge"), "node").select("_file", "_row", F.struct("root", "node").alias("_value"))
    sets = met(docs, chosen, lambda r: r.select("_value.root", "_value.node", F.col("_doc.text").alias("text")).mapInArrow(unpack, "root long, node long, n long, marks array<long>"), F.lit(16))
    roots = materialize(components(verified(materialize(sets, "sets"), least)), "components")
    named = items.join(roots.hint("merge"), "node", "left").select(*keys, F.coalesce("root", "node").alias("root"))
    # Written, here and below, so that a hot root is a join's key, which can be split, and no aggregate's.
    placed = materialize(rows.join(named.hint("merge"), keys).select("_file", "_row", "doc_id", "root"), "placed")
    firsts = placed.groupBy("root").agg(F.min(F.struct("doc_id", "_file", "_row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    drops = placed.join(materialize(firsts, "firsts").hint("merge"), "root").filter(F.struct("doc_id", "_file", "_row") != F.col("first"))
    return met(docs, drops.select("_file", "_row", F.lit(True).alias("_value")), lambda r: r.filter("_value IS NULL").select("_doc.*"), every=True)


ship(__name__)

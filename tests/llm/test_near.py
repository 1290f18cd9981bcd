"""Line dedup, SimHash, vectors and the pipeline."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from catalens.llm import ann, linedup, simhash
from catalens.llm import queries as q
from catalens.llm.components import components

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return len(b) - len(a) <= 1 and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


def kept_lines(rows, equal=linedup.LEAST):
    """Brute force over (doc_id, text), ids ascending."""
    first = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= linedup.LEAST or (len(x) >= equal and x.strip(" \t\n\x0b\f\r")):
                first.setdefault(x, (i, k))
    gone = {b for b in first for a in first if first[a] < first[b] and min(len(a), len(b)) >= linedup.LEAST and one_edit(a, b)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if x not in first or (first[x] == (i, k) and x not in gone)) for i, t in rows}


@pytest.mark.parametrize("equal", [linedup.LEAST, 1])
def test_lines_against_brute_force(spark, tmp_path, equal):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcé "), n)) for n in (20, 21, 40, 63, 64, 65, 128, 200, 500)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(3):
            x = base[rng.integers(len(base))]
            for _ in range(rng.integers(0, 3)):
                k = rng.integers(len(x))
                x = [x[:k] + x[k + 1 :], x[:k] + "z" + x[k:], x[:k] + "y" + x[k + 1 :]][rng.integers(3)]
            lines.append(x)
        rows.append((i, "\n".join([*lines, "short", ["Les.", "\x0b", " \t", "ab"][i % 4]])))
    rows += [(90, None), (91, ""), (92, "\n\n")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: r["text"] for r in linedup.without_duplicates(spark.read.parquet(path), equal).collect()}
    assert got == kept_lines(rows, equal)


def test_short_lines_in_the_pipeline(spark, tmp_path):
    """Repeats of short lines go, near ones and blank ones stay; long lines keep the edit step."""
    long = "a line that is long enough for the edit step"
    texts = ["Les.\n\nLes.\n  \n" + long, "Lez.\n  \n\nLes.\nx\n" + long + "s", "x\n\tLes.\nx", None, "x"]
    want = ["Les.\n\n  \n" + long, "Lez.\n  \n\nx", "\tLes.", None, ""]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(path)
    rows = corpus_pipeline.dedup_lines(spark, spark.read.parquet(path), SMALL).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(want))


def test_lines_odd(spark, odd, empty):
    out = linedup.without_duplicates(odd)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "_lines", "_dropped"]
    assert linedup.without_duplicates(empty).count() == 0
    assert out.filter("doc_id = 10").first()["text"] == "line one is long enough to count\n\nshort"


def test_lines_query_against_oracle(spark, duck):
    want = {tuple(r) for r in duck.execute(q.ORACLES["op7_line_dedup"]).fetchall()}
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"], r["n_chars"], r["text"]) for r in q.op7_line_dedup(spark, SMALL).collect()} == want


def brute_fingerprint(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    parts = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] if len(found) >= words else [" ".join(found)] if found else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, within):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= within):
            parent[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_simhash_against_brute_force(spark, texts):
    rows = q.op10_simhash(spark, SMALL).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for i in list(texts)[:60]:
        assert got[i]["fingerprint"] == f"{brute_fingerprint(texts[i]):016x}"
    ids = sorted(got)
    want = brute_components(ids, np.array([int(got[i]["fingerprint"], 16) for i in ids], np.uint64), 4)
    assert {i: got[i]["component_id"] for i in ids} == want


@pytest.mark.parametrize("block", [4096, 64])
def test_classes_of_clusters(spark, block, monkeypatch):
    """Clusters of near fingerprints, more than a block holds, found whole at any plan."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    fps = set()
    for centre in rng.integers(0, 1 << 62, 6):
        for _ in range(150):
            fps.add(int(centre) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) & ((1 << 63) - 1)))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 600)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    from catalens.shared import materialize
    from pyspark.sql import functions as F

    items = materialize(spark.createDataFrame(rows, "rep long, fp long").withColumn("node", F.col("fp")))
    got = dict(map(tuple, simhash.classes(items, 4).collect()))
    ids, arr = [i for i, _ in rows], np.array([f for _, f in rows], np.int64).view(np.uint64)
    want = brute_components(ids, arr, 4)
    mine = defaultdict(set)
    for i, f in rows:
        mine[got.get(f, f)].add(i)
    theirs = defaultdict(set)
    for i, c in want.items():
        theirs[c].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_pigeonhole_sums_and_groups():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    for n in (1000, 10**6, 10**9):
        for within in (4, 8):
            plan = simhash.allocate(sample, n, within)
            assert sum(t + 1 for _, t in plan) == within + 1 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)
    assert sorted(b for g in simhash.grouped_bits(sample, 5) for b in g) == list(range(64))


def test_simhash_odd(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(empty).count() == 0
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in zero} == {0} and len(zero) >= 3
    first = simhash.first_of_each(odd)
    assert first.columns == odd.columns and first.filter("text = 'the same text stands here more than once'").count() == 1 and simhash.first_of_each(empty).count() == 0


def test_first_of_each_keeps_clean_texts_and_drops_copies(spark, tmp_path):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    rows = [(i, " ".join(word() for _ in range(250))) for i in range(200)]
    for k in range(60):
        words = rows[k][1].split()
        for at in rng.choice(len(words), 4, replace=False):
            words[at] = word()
        rows.append((1000 + k, " ".join(words)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.read.parquet(path)).collect()}
    assert set(range(200)) <= kept and len([i for i in kept if i >= 1000]) <= 2


def edited(rng, words, kind, share):
    """``words`` with a share of them changed: one by one, or the last of them as one passage."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    n = max(1, round(share * len(words)))
    at = rng.choice(len(words), n, replace=False) if kind == "scattered" else range(len(words) - n, len(words))
    out = list(words)
    for k in at:
        out[k] = word()
    return out


def pairs_of(rng, kind, shares, low, high, n):
    """(text, copy) with an exact Jaccard similarity of five-word shingles in [low, high)."""
    out = []
    while len(out) < n:
        words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(rng.integers(150, 600))]
        copy = edited(rng, words, kind, rng.uniform(*shares))
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, copy))
        if low <= len(a & b) / len(a | b) < high:
            out.append((" ".join(words), " ".join(copy)))
    return out


def kept_ids(spark, path, pairs):
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return {r["doc_id"] for r in simhash.first_of_each(spark.read.parquet(path)).collect()}


def test_first_of_each_keeps_texts_below_the_similarity(spark, tmp_path):
    rng = np.random.default_rng(6)
    pairs = pairs_of(rng, "scattered", (0.02, 0.1), 0.62, 0.8, 60) + pairs_of(rng, "passage", (0.1, 0.3), 0.62, 0.8, 60)
    assert kept_ids(spark, str(tmp_path / "d.parquet"), pairs) == set(range(240))


@pytest.mark.parametrize("kind", ["scattered", "passage"])
def test_first_of_each_finds_copies_at_the_similarity(spark, tmp_path, kind):
    pairs = pairs_of(np.random.default_rng(8), kind, (0.01, 0.12), 0.8, 0.84, 120)
    assert kept_ids(spark, str(tmp_path / "d.parquet"), pairs) == set(range(0, 240, 2))


@pytest.mark.parametrize("partitions", [4, 7])
def test_fingerprints_of_near_copies_meet(partitions):
    """Of pairs of sets at 0.8 nearly all meet by a pigeonhole of a fingerprint, whatever thresholds were chosen; no others do."""
    rng = np.random.default_rng(9)
    total = simhash.NEAR - partitions + 1
    parts = [[int(x) for x in p] for p in np.array_split(np.arange(64), partitions)]
    keeps = np.array([m for i, p in enumerate(parts) for m in simhash.masks_of(p, total // partitions + (i < total % partitions))], np.uint64)
    fresh = lambda n: rng.integers(0, 1 << 64, n, np.uint64)

    def meet(a, b):
        a, b = (np.array(simhash.words_of(x), np.int64).view(np.uint64) for x in (a, b))
        apart = np.bitwise_count(a ^ b).astype(int)
        return any(sum(np.roll(apart, -k)[: simhash.COMPARED]) <= simhash.WIDE and ((a[k] ^ b[k]) & keeps == 0).any() for k in range(simhash.WORDS))

    shared = [fresh(160) for _ in range(500)]
    assert sum(meet(np.concatenate([s, fresh(20)]), np.concatenate([s, fresh(20)])) for s in shared) >= 498
    assert not any(meet(np.concatenate([s[:40], fresh(140)]), np.concatenate([s[:40], fresh(140)])) for s in shared)
    assert simhash.words_of(fresh(0)) == [] and simhash.words_of(shared[0]) == simhash.words_of(shared[0][::-1])


def test_first_of_each_takes_candidates_from_the_pigeonhole(spark, tmp_path, monkeypatch):
    """Without links of fingerprints no near copy is found: there is no other path to one."""
    searched = []
    none = lambda items, within, turns, wide: searched.append((within, len(turns))) or spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "links", none)
    pairs = pairs_of(np.random.default_rng(8), "scattered", (0.01, 0.03), 0.8, 0.99, 10)
    assert kept_ids(spark, str(tmp_path / "d.parquet"), [*pairs, (pairs[0][0], pairs[0][0])]) == set(range(21)) - {20}
    assert searched == [(simhash.NEAR, simhash.WORDS)]


@pytest.mark.parametrize("marks", [1 << 20, 500])
def test_verified_links_are_exact(spark, marks, monkeypatch):
    """Chains, sets at 0.8 exactly and hot roots that are cut into blocks."""
    from catalens.shared import materialize

    monkeypatch.setattr(simhash, "MARKS", marks)
    rng = np.random.default_rng(7)
    sets = [sorted({int(x) for x in rng.choice(60, rng.integers(30, 56), replace=False)}) for _ in range(60)] + [list(range(100, 109)), list(range(100, 107)) + [109, 110]]
    sets += [list(range(200, 208)), list(range(200, 210)), list(range(200, 206))]
    rows = [(i % 2 if i < 60 else 2, i, len(s), s) for i, s in enumerate(sets)]
    want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if rows[a][0] == rows[b][0] and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})]
    found = simhash.verified(materialize(spark.createDataFrame(rows, "root long, node long, n long, marks array<long>")), 0.8)
    group = lambda links: dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert (62, 63) in want and (62, 64) not in want and (60, 61) not in want
    assert group([tuple(r) for r in found.collect()]) == group(want)


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    nodes = sorted({x for p in pairs for x in p})
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {n: got.get(n, n) for n in nodes} == {n: find(n) for n in nodes}


def brute_nearest(rows, k=10, every=100):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in best if np.isfinite(d[j])]
    return out


def test_vectors_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest(sorted((r["vec_id"], r["embedding"]) for r in e.collect()))
    got = defaultdict(list)
    for r in sorted(q.op6_ann(spark, "/root/testdata/sf0.01").collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = sum(len({a for a, _ in want[i]} & {a for a, _ in got[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(i, a): s for i in want for a, s in want[i]}
    assert all(s == pytest.approx(exact[i, a], abs=1e-12) for i in got for a, s in got[i] if (i, a) in exact)
    assert all(v == sorted(v, key=lambda p: (p[1], p[0])) for v in got.values())


def test_vectors_odd(spark):
    rows = [(0, [1.0, 0.0, 0.5]), (100, [1.0, 0.0, 0.5]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [1.0, None, 1.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(10 + i, [1.0, 0.0, 0.5]) for i in range(20)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    mine = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert mine == list(range(10, 20)) and all(r["score"] == 0 for r in got)
    few = ann.search(spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")).collect()
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in few} == {(0, 100, 1), (100, 0, 1)}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_quantiser_weighs_the_parallel_residual():
    x = np.random.default_rng(0).normal(size=(2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware = ann.train(x)
    codes = aware.codes(x)
    r = aware.split(x) - aware.books[np.arange(aware.parts)[None], codes]
    plain = ann.Quantiser(aware.books, 1.0)
    s = plain.split(x) - plain.books[np.arange(plain.parts)[None], plain.codes(x)]
    along = lambda v: np.abs((v.reshape(len(x), -1) * x).sum(1)).mean()
    assert along(r) < along(s)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] >= sizes[3]
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.count() == sizes[-1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "packing"]

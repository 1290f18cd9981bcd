"""Operators on corpus statistics against brute-force versions in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from catalens import shared
from catalens.llm import decontaminate, divergence, resample

SMALL = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def audited(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) from (lang, source, text)."""
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in found}:
        docs = Counter(t for r in found if r[0] == lang for t in set(r[2]))
        kept = [t for t, n in docs.items() if n >= least]
        by, total = defaultdict(Counter), Counter()
        for r in found:
            if r[0] == lang:
                by[r[1]].update(t for t in r[2] if docs[t] >= least)
                total.update(t for t in r[2] if docs[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in by.items()}, share(total)
        apart = lambda x, y: (x - y) * (x - y) // y
        for s, p in shares.items():
            pair = [(o, sum(apart(p[t], shares[o][t]) for t in kept)) for o in shares if o != s]
            term = [(t, apart(p[t], q[t])) for t in kept if by[s][t] > 0 and p[t] > q[t]]
            for part, values, most in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile, held, tally", [(64, 200_000, 1 << 20), (2, 50, 30)])
def test_divergence_is_exact(spark, docs, monkeypatch, tile, held, tally):
    for name, value in (("TILE", tile), ("HELD", held), ("TALLY", tally)):
        monkeypatch.setattr(divergence, name, value)
    wanted = audited([(r["lang"], r["source"], r["text"]) for r in docs.collect()])
    assert plain(divergence.audit(docs)) == wanted


def test_divergence_of_odd_rows(odd, empty):
    wanted = audited([(r["lang"], r["source"], r["text"]) for r in odd.collect()], least=2, top=5)
    assert plain(divergence.audit(odd, least=2, top=5)) == wanted
    assert {r[:2] for r in wanted} >= {("", "s"), ("en", "s"), ("", "")}
    assert plain(divergence.audit(odd, least=1000)) == audited([(r["lang"], r["source"], r["text"]) for r in odd.collect()], least=1000)
    assert divergence.audit(empty).count() == 0


def test_divergence_beyond_64_bits(spark):
    """Shares of counts that 64-bit products couldn't hold."""
    df = spark.range(1).selectExpr("7000000000000 AS n", "900000000000000000 AS total", "5L AS v")
    assert df.select(divergence.probability("n", "total", "v").alias("p")).first()[0] == 1 + 10**9 * (7000000000000 + 1) // (900000000000000000 + 5)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def judged(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from (doc_id, text) and (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(ascii_lower(text))
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[s : s + window])].add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w = WORD.findall(ascii_lower(text))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= of
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted(spark, folder, items):
    """Documents that hold passages whole, cut, twice, at either end and almost, among a third of copies of one."""
    texts = [r["text"] for r in items.orderBy("item_id").collect()]
    long = max(texts, key=len).split()
    rows = [None, "", "...", " ".join(long), " ".join(long[:9]), " ".join(long[:10]), "x " + " ".join(long[-10:]), " ".join(long[:10] * 3), " ".join(long[:12]).upper(), " ".join([*long[:6], "zzz", *long[6:12]]), "tiny item", "a TINY, item! twice: tiny item", "tiny", "ça ne VA pas", "Ça ne va pas"]
    rows += [" ".join(long[2:30]) + f" tail {i}" for i in range(12)] + [" ".join(a.split()[:14] + b.split()[:14]) for a, b in zip(texts, texts[1:])]
    made = [(i if i != 3 else None, t, "x") for i, t in enumerate(rows)] + [(6, rows[6], "x")]
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(made, "doc_id long, text string, window string").repartition(3).write.parquet(path)
    own = [(r["item_id"], r["text"]) for r in items.collect()] + [(None, "tiny item"), (900, "tiny item"), (901, "ça ne va pas"), (902, None), (903, " - "), (901, "ça ne va pas")]
    return spark.read.parquet(path), spark.createDataFrame(own, "item_id long, text string"), [r[:2] for r in made], own


@pytest.mark.parametrize("most", [None, 600])
def test_passages_are_found_whole(spark, items, tmp_path, monkeypatch, most):
    if most:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    docs, own, rows, of_items = planted(spark, tmp_path, items)
    found = [tuple(r) for r in decontaminate.decontaminate(docs, own).collect()]
    wanted = judged(rows, of_items)
    assert sorted(found, key=str) == wanted
    assert sum(r[5] for r in wanted) > 20 and any(r[3] > 1 for r in wanted)


def test_passages_of_the_tables(docs, items):
    found = [tuple(r) for r in decontaminate.decontaminate(docs, items).collect()]
    assert sorted(found, key=str) == judged([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_passages_of_odd_rows(spark, odd, empty, items):
    own = spark.createDataFrame([(1, "the same text stands here more than once"), (2, "a"), (3, "word1 tail1 word2 tail2 word3 tail3 word4 tail4 word5 tail5 word6")], "item_id int, text string")
    found = [tuple(r) for r in decontaminate.decontaminate(odd, own).collect()]
    assert sorted(found, key=str) == judged([(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in own.collect()])
    assert decontaminate.decontaminate(empty, items).count() == 0
    clean = decontaminate.decontaminate(odd, own.limit(0)).collect()
    assert len(clean) == odd.count() and not any(r["contaminated"] for r in clean)


def test_decontamination_is_native(spark, docs, items):
    plan = decontaminate.decontaminate(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    places = decontaminate.places(docs, [4])._jdf.queryExecution().optimizedPlan().toString()
    assert places.count("regexp_extract_all") == 1


def drawn(docs, target, percent=25):
    split = lambda text: WORD.findall(ascii_lower(text))
    features = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, text in docs for f in features(split(text)))
    t = Counter(bucket(f) for _, text in target for f in features(split(text)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(all_s + 10000) / ((s[b] + 1) * float(all_t + 10000))))
    rows = []
    for doc_id, text in docs:
        w = split(text)
        own = features(w)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    k = len(enough) * percent // 100
    return sorted([(*r[:4], i + 1 if i < k else None) for i, r in enumerate(enough)] + [(*r[:4], None) for r in rows if not r[4]], key=str)


@pytest.mark.parametrize("held, remembered, run", [(400_000, 200_000, 1 << 16), (100, 50, 7)])
def test_resampling_is_exact(docs, items, monkeypatch, held, remembered, run):
    for name, value in (("HELD", held), ("REMEMBERED", remembered), ("RUN", run)):
        monkeypatch.setattr(resample, name, value)
    wanted = drawn([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((tuple(r) for r in resample.resample(docs, items).collect()), key=str) == wanted
    assert sum(r[4] is not None for r in wanted) > 20


def test_resampling_of_odd_rows(odd, empty, items):
    own = [(r["item_id"], r["text"]) for r in items.collect()]
    wanted = drawn([(r["doc_id"], r["text"]) for r in odd.collect()], own, percent=100)
    assert sorted((tuple(r) for r in resample.resample(odd, items, percent=100).collect()), key=str) == wanted
    assert resample.resample(empty, items).count() == 0
    assert resample.resample(odd, items.limit(0)).count() == odd.count()

"""Sharding, packing and mixing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalens.llm import mixing, packing, sharding
from catalens.llm import queries as q
from catalens.llm.common import tokenizer

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
VOCABULARY = tokenizer("word_bpe_49k.json")


def test_shards_are_even_and_whole(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = q.op2_sharding(spark, MEDIUM).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"}
    by, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), None)
        by[r["shard"]].append(r)
        groups[raw].add(r["shard"])
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert sorted(by) == list(range(16)) and max(sizes) < 1.05 * min(sizes)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert all(len(v) == 1 for v in groups.values())


def test_hot_group_is_cut(spark):
    rows = [(i, "one text that a third of the rows have") for i in range(2000)] + [(2000 + i, f"text {i} " * (i % 9 + 1)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).groupBy("shard").agg({"size": "sum", "*": "count"}).collect()
    sizes, counts = [r["sum(size)"] for r in got], [r["count(1)"] for r in got]
    assert len(got) == 16 and max(sizes) < 1.1 * min(sizes) and max(counts) < 1.25 * min(counts)


def test_two_runs_place_alike(spark):
    rows = [(i if i % 2 else 7, "one text that a third of the rows have") for i in range(1500)] + [(2000 + i, f"text {i} " * (i % 9 + 1)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted(map(tuple, sharding.shard(docs.repartition(n), 16).select("doc_id", "size", "text_crc32", "shard", "slot").collect())) for n in (3, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)


def test_shards_odd(spark, odd, empty):
    got = sharding.shard(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["shard"] < 16 for r in got)
    assert sharding.shard(empty).count() == 0


def test_place_takes_the_emptiest_where_items_ask():
    sizes = np.array([[8, 1, 1], [1, 8, 1], [1, 1, 8], [1, 8, 8], [8, 1, 8], [8, 8, 1]], float)
    where = sharding.place(sizes, 3)
    loads = np.array([sizes[where == s].sum(0) for s in range(3)])
    assert (loads == 9).all()


def check_pieces(rows, ids, window=2048):
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        cover[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(cover) == set(ids)
    for k, v in cover.items():
        assert [a for a, _ in sorted(v)] == list(np.cumsum([0, *[n for _, n in sorted(v)]])[:-1]) and sum(n for _, n in v) == len(ids[k])
    padding = 0
    for v in sequences.values():
        used = sum(n for _, n in v)
        assert [a for a, _ in sorted(v)] == list(np.cumsum([0, *[n for _, n in sorted(v)]])[:-1]) and 0 < used <= window
        padding += window - used if used & (used - 1) else 0
    assert sorted(sequences) == list(range(len(sequences))) and padding < 2 * window


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return {k: [*t.encode(v or "", add_special_tokens=False).ids, 1] for k, v in texts.items()}


def test_pieces(spark, texts):
    rows = q.op3_packing(spark, SMALL).collect()
    check_pieces(rows, ids_of(texts))
    steps = Counter()
    for r in rows:
        steps[r["step_group"]] += r["length"]
    assert Counter(steps.values()).most_common(1)[0][0] == 8 * 2048


def test_pieces_odd(spark, odd, empty):
    unique = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(unique, VOCABULARY).collect(), ids_of({r["doc_id"]: r["text"] for r in unique.collect()}))
    assert packing.pack(odd, VOCABULARY).filter("start = 0").count() == odd.count() and packing.pack(empty, VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2047), st.integers(1, 300), max_size=30))
def test_plan_places_every_token_once(histogram):
    plan = packing.Plan(histogram)
    used, windows = Counter(), defaultdict(list)
    for length, rank, n, start, take, at, offset, tier, _ in plan.moves:
        for i in range(n):
            used[length, rank + i, start, take] += 1
            windows[at + i].append((offset, take, tier))
    tokens = defaultdict(list)
    for (length, rank, start, take), n in used.items():
        assert n == 1
        tokens[length, rank].append((start, take))
    assert set(tokens) == {(k, i) for k, n in histogram.items() for i in range(n)}
    assert all(sum(t for _, t in v) == k[0] and [s for s, _ in sorted(v)] == list(np.cumsum([0, *[t for _, t in sorted(v)]])[:-1]) for k, v in tokens.items())
    short = [w for w, v in windows.items() if sum(t for _, t, _ in v) < v[0][2]]
    assert all([o for o, *_ in sorted(v)] == list(np.cumsum([0, *[t for _, t, _ in sorted(v)]])[:-1]) for v in windows.values()) and len(short) <= 1


@given(st.lists(st.text(max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_ids_are_the_tokenizers(found):
    e = packing.encoder(VOCABULARY)
    want = [np.array([*x.ids, 1], "<u2").tobytes() for x in e.tokenizer.encode_batch(found, add_special_tokens=False)]
    assert e.encode(found) == want
    assert e.encode(["a <|endoftext|> b"]) == [np.array([*e.tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids, 1], "<u2").tobytes()]


def test_ids_of_another_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    found = ["Two Words, and\n some  more", "", "Ünïcode 123", "it's"]
    want = [np.array([*x.ids, 1], "<u2").tobytes() for x in Tokenizer.from_file(path).encode_batch(found, add_special_tokens=False)]
    assert packing.Encoder(path).encode(found) == want and packing.encoder(VOCABULARY).by_words and not packing.Encoder(path).by_words


def test_a_repeated_run_is_cut_once():
    e, seen = packing.Encoder(VOCABULARY), []
    words = e.words
    e.words = lambda text: seen.append(text) or words(text)
    texts = ["Once, upon a time-table, it's 1999; " * 200] * 40
    assert e.encode(texts) == [raw + e.end for raw in e.whole(texts)] and sum(map(len, seen)) < 100


def test_a_call_does_not_walk_the_kept_words():
    class Kept(dict):
        def __iter__(self):
            raise AssertionError("walks all kept words")

        keys = __iter__

    e = packing.Encoder(VOCABULARY)
    e.cache = Kept({f"w{i}": b"" for i in range(9)})
    assert e.encode(["two words"]) == [e.whole(["two words"])[0] + e.end]


def test_every_character_beside_others():
    e = packing.Encoder(VOCABULARY)
    found = [f"{a}{chr(c)}{b}" for c in sorted({*range(0x250), *packing.plain_characters()[0]}) for a, b in [("", ""), ("a", "B"), (" '", "s"), ("1", "'LL"), ("'S", "' "), (chr(c), "\u2003.")]]
    assert e.by_words and e.encode(found) == [raw + e.end for raw in e.whole(found)]


def test_ids_of_cut_columns():
    e = packing.Encoder(VOCABULARY)
    found = [None, "", " \n", "One\xa0two\x85three\x1cfour\u3000five", "x<|endoftext|>y z", "'stuff ''s it'sn't", None, "e\u0301 \u0301 \u03a3\u03a3", "\u00c9T\u00c9, 12a"]
    want = [raw + e.end for raw in e.whole([t or "" for t in found])]
    column = pa.array(["cut off", *found, "too"])
    assert e.encode(column.slice(1, len(found))) == want and e.encode(found) == want and e.encode(pa.array([], pa.string())) == []
    parts = [b.column("text").to_pylist() for b in packing.portions([pa.RecordBatch.from_pydict({"text": column.slice(1, len(found))})], 12)]
    assert sum(parts, []) == found and len(parts) > 3 and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 12 for p in parts)


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.01, 100), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_pfair_stays_within_a_block(weights):
    slots = mixing.rounded(weights, 256)
    order = mixing.pfair(slots, 256)
    assert sum(slots.values()) == 256 and Counter(order) == slots
    had = Counter()
    for t, k in enumerate(order, 1):
        had[k] += 1
        assert all(abs(had[s] - t * n / 256) < 1 for s, n in slots.items())


def test_mixture_is_whole_and_gapless(spark, docs):
    rows = mixing.schedule(docs).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    counts = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}
    uses = Counter(r["doc_id"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for s in counts:
        own = [uses[i] for i in source if source[i] == s]
        assert max(own) - min(own) <= 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_mixture_takes_weights(spark, docs):
    names = [r[0] for r in docs.select("source").distinct().collect()]
    weights = {n: 3.0 if i % 2 else 1.0 for i, n in enumerate(sorted(names))}
    rows = mixing.schedule(docs, weights, block=2).collect()
    share = Counter(r["source"] for r in rows)
    for n in names:
        assert abs(share[n] / len(rows) - weights[n] / sum(weights.values())) < 0.02
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"src0": 1.0})


def worst_deviation(order, shares):
    """The largest distance, in blocks, of any source's progress from its share of the slots so far."""
    t = np.arange(1, len(order) + 1)
    return max(np.abs(np.cumsum(order == k) - t * (w / sum(shares))).max() for k, w in enumerate(shares))


def test_mixture_stays_within_a_block_of_the_targets(spark, tmp_path, monkeypatch):
    """A hot source, ordinary ones and a tiny one, over more slots than a span."""
    monkeypatch.setattr(mixing, "SPAN", 20_000)
    sizes = [20_000, *[2_220] * 18, 20]
    path = str(tmp_path / "d.parquet")
    rows = [(i, f"s{k:02d}") for i, k in enumerate(np.repeat(range(20), sizes).tolist())]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(path)
    got = sorted((r["position"], r["source"], r["doc_id"]) for r in mixing.schedule(spark.read.parquet(path), block=1).collect())
    assert [p for p, *_ in got] == list(range(len(got))) and {d for *_, d in got} == {d for d, _ in rows}
    assert worst_deviation(np.array([int(s[1:]) for _, s, _ in got]), [n**mixing.TEMPER for n in sizes]) < 1


def test_spans_stay_within_a_block_at_many_blocks():
    sizes = [10**7 // 3, *[10**7 * 2 // 54] * 18, 20]
    shares = mixing.whole([n**mixing.TEMPER for n in sizes])
    needs = [-(-n // 8) for n in sizes]
    end = mixing.horizon(shares, needs)
    done = mixing.reached(shares, end)
    order = np.concatenate([mixing.span(shares, a, min(mixing.SPAN, end - a))[1] for a in range(0, end, mixing.SPAN)])
    assert len(order) > 10**6 and worst_deviation(order, shares) < 1
    assert np.bincount(order).tolist() == done and all(d >= n for d, n in zip(done, needs)) and done[-1] * 8 < 10 * 20


def test_mixture_odd(spark, odd, empty):
    rows = mixing.schedule(odd).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows))) and len({(r["_file"], r["_row"]) for r in rows}) == odd.count()
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(empty).count() == 0

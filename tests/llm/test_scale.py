"""Both sides of every bound on what is broadcast, and columns of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalens import shared
from catalens.llm import common, html, linedup, mixing, simhash, toxicity

SMALL = "/root/testdata/sf0.001"
CLASHING = ["position", "_file", "_row", "_doc", "_value", "_lines", "_dropped", "_drop", "_parts", "_kept", "_path", "_chunk", "_at", "_bytes", "_entries", "_layer", "idx", "host", "path", "root", "node", "h1", "bands", "tokens"]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """The small documents in several files."""
    path = str(tmp_path_factory.mktemp("many") / "documents.parquet")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def blocks(monkeypatch):
    """Every broadcast over its bound, chunks and segments of few rows."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(common, "CHUNK", 8)
    monkeypatch.setattr(common, "TOGETHER", (4, 1))
    for module in (simhash, mixing):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(simhash, "HOT", 0)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


OPERATORS = {
    "lines": lambda d: linedup.without_duplicates(d, equal=1),
    "copies": simhash.first_of_each,
    "simhash": simhash.near_duplicates,
    "mixture": mixing.mixed,
}


@pytest.fixture(scope="module")
def whole(many):
    return {k: rows_of(f(many)) for k, f in OPERATORS.items()}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_blocks_change_no_row(many, whole, blocks, name):
    assert rows_of(OPERATORS[name](many)) == whole[name]


def test_pages_on_both_sides(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SMALL}/pages.parquet").repartition(3).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    want = rows_of(html.main_text(pages))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(common, "CHUNK", 8)
    assert rows_of(html.main_text(pages)) == want


@pytest.mark.parametrize("most", [1, 700, 5000, 1 << 30])
@pytest.mark.parametrize("every", [True, False])
def test_values_meet_their_rows(spark, tmp_path, monkeypatch, most, every):
    monkeypatch.setattr(common, "CHUNK", 4)
    monkeypatch.setattr(common, "TOGETHER", (16, 1))
    spark.range(300).repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = common.boxed(docs).filter("_doc.id % 7 = 2").select("_file", "_row", (F.col("_doc.id") * 10).alias("_value"))
    got = common.met(docs, rows, lambda r: r.select("_doc.*", "_value"), every=every, most=most)
    assert rows_of(got) == sorted(((i, 10 * i if i % 7 == 2 else None) for i in range(300) if every or i % 7 == 2), key=repr)


def test_layers_repeat_rows(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = common.boxed(docs).select("_file", "_row", F.explode(F.sequence(F.lit(0), F.col("_doc.id") % 3)).alias("_layer")).withColumn("_value", F.col("_layer") * 2)
    for most in (1, 1 << 30):
        got = common.met(docs, rows, lambda r: r.select("_doc.id", "_value"), most=most)
        assert rows_of(got) == sorted(((i, 2 * k) for i in range(20) for k in range(i % 3 + 1)), key=repr)


@pytest.fixture(scope="module")
def clashing(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    mine = [c for c in CLASHING if c not in odd.columns]
    odd.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in mine], F.lit("x").alias("a.b c")).write.parquet(path)
    return spark.read.parquet(path)


def own(row):
    return (row["doc_id"], *[row[c] for c in CLASHING], row["a.b c"])


def test_columns_of_any_name_are_kept(clashing):
    want = sorted((own(r) for r in clashing.collect()), key=repr)
    lines = linedup.without_duplicates(clashing)
    assert lines.columns == [*clashing.columns, "_lines_", "_dropped_"] and sorted((own(r) for r in lines.collect()), key=repr) == want
    for f in (mixing.mixed, lambda d: toxicity.clean(d, toxicity.Machine(-1.0))):
        out = f(clashing)
        assert out.columns == clashing.columns and set(want) == {own(r) for r in out.collect()}
    first = simhash.first_of_each(clashing)
    assert first.columns == clashing.columns and {own(r) for r in first.collect()} <= set(want)


@pytest.mark.parametrize("kind", ["odd", "empty", "clashing"])
def test_stages_take_odd_tables(spark, tmp_path, request, kind):
    docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES:
        columns, n = docs.columns, docs.count()
        out = stage(spark, docs, SMALL)
        if name == "packing":
            assert out.filter("start = 0").count() == n
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.count()
        assert got == n if name == "line_dedup" else got >= n if name == "mixing" else got <= n
        if kind == "empty":
            assert got == 0


def test_lines_without_a_count_of_characters(spark, tmp_path):
    spark.createDataFrame([(1, "one\none")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert [tuple(r) for r in corpus_pipeline.dedup_lines(spark, spark.read.parquet(str(tmp_path / "d")), SMALL).collect()] == [(1, "one")]


def test_many_sources(spark, tmp_path):
    """A hundred thousand sources: each source is one row of the driver's, and no slot is."""
    n = 100_000
    spark.range(n + 50_000).select(F.col("id").alias("doc_id"), F.least(F.col("id"), F.lit(n - 1)).cast("string").alias("source")).write.parquet(str(tmp_path / "d"))
    got = mixing.schedule(spark.read.parquet(str(tmp_path / "d")), block=1).agg(F.count("*").alias("n"), F.countDistinct("position").alias("p"), F.max("position").alias("last"), F.countDistinct("doc_id").alias("d")).first()
    assert got["n"] == got["p"] == got["last"] + 1 and got["d"] == n + 50_000


def test_states_of_spans_are_within_a_block():
    rng = np.random.default_rng(3)
    for _ in range(30):
        shares = [int(x) for x in rng.integers(1, 1000, rng.integers(1, 30))]
        total = sum(shares)
        for slot in map(int, rng.integers(0, 10**6, 20)):
            done = mixing.reached(shares, slot)
            assert sum(done) == slot and all(abs(d * total - slot * w) < total for d, w in zip(done, shares))


def test_spans_agree_with_any_cut():
    """Spans of any length keep every block between its release and its deadline."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        shares = [int(x) for x in rng.integers(1, 60, rng.integers(2, 12))]
        total, length = sum(shares), int(rng.integers(1, 90))
        order = np.concatenate([mixing.span(shares, a, length)[1] for a in range(0, 8 * length, length)])
        for k, w in enumerate(shares):
            at = np.flatnonzero(order == k)
            assert all(j * total // w <= t < -(-(j + 1) * total // w) for j, t in enumerate(at.tolist()))


def test_deep_pages_cost_their_length():
    depth = 30_000
    page = "<html><body>" + "<div class='level'>" * depth + "the text" + "</span>" * depth
    assert html.extract(page, html.vote(page)[0]) == "the text"


def test_a_hot_text_without_ids_is_cut_evenly(spark):
    from catalens.llm import sharding

    rows = [(None, "one text that a third of the rows have")] * 1600 + [(2000 + i, f"text {i} " * (i % 9 + 1)) for i in range(3200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes, counts = [r["size"] for r in got], [r["n"] for r in got]
    assert len(got) == 16 and max(sizes) < 1.1 * min(sizes) and max(counts) < 1.25 * min(counts)


def test_bounds_without_thresholds_are_refused():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    assert sum(t + 1 for _, t in simhash.allocate(sample, 1000, 20)) == 21
    for within in (32, 40):
        with pytest.raises(ValueError):
            simhash.allocate(sample, 1000, within)


@pytest.mark.parametrize("kind", ["clustered", "even"])
def test_recall_of_vectors_with_bounded_exact_distances(spark, monkeypatch, kind):
    from catalens.llm import ann

    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 32)) if kind == "even" else rng.normal(size=(200, 32))[rng.integers(0, 200, 20_000)] + 0.4 * rng.normal(size=(20_000, 32))
    x = x.astype(np.float32).astype(float)
    ranked, met = [], ann.met

    def counted(index, near, then, weight):
        ranked.append(near.select(F.explode("_value").alias("q")).groupBy("q").count().agg(F.max("count")).first()[0])
        return met(index, near, then, weight)

    monkeypatch.setattr(ann, "met", counted)
    got = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in range(0, 20_000, 100):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(got[i] & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
    assert hits >= 0.97 * 2000 and max(ranked) <= 1000


def test_vectors_of_any_finite_size(spark):
    from catalens.llm import ann

    rng = np.random.default_rng(2)
    small = rng.normal(size=(300, 6))
    for scale in (1e-200, 1e200, 1e307):
        x = np.clip(small, -5, 5) * scale
        rows = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
        for q in (0, 100, 200):
            d = np.sqrt(((x / scale - x[q] / scale) ** 2).sum(1))
            d[q] = np.inf
            want = np.argsort(d)[:10].tolist()
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
            assert len(mine) == 10 and len({v for _, v, _ in mine} & set(want)) >= 9
            assert all(s == pytest.approx(d[v] * scale, rel=1e-9) for _, v, s in mine)


def gold(k, rng):
    """A page of one of four templates, and its main text."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    parts = [say(rng.integers(20, 70)) for _ in range(rng.integers(3, 8))]
    head, side, talk = say(6), [say(3) for _ in range(12)], [say(25) for _ in range(4)]
    body = "".join(f"<p>{p}</p>" for p in parts)
    nav = "<nav><ul>" + "".join(f"<li><a href='/{i}'>{s}</a></li>" for i, s in enumerate(side)) + "</ul></nav>"
    said = "".join(f"<div class='comment'><p>{t}</p></div>" for t in talk)
    page = [
        f"<header>{nav}</header><article class='post-{k}'><h1>{head}</h1>{body}</article><aside>{say(30)}</aside><footer>{say(9)}</footer>",
        f"<div id='top'>{nav}</div><div id='content'><div class='story'><h1>{head}</h1>{body}</div></div><div id='sidebar'>{say(40)}</div><section class='comments'>{said}</section>",
        f"<table><tr><td class='menu'>{nav}</td><td class='x{k}'><h1>{head}</h1>{body}</td></tr></table><div class='copyright'>{say(8)}</div>",
        f"<div class='cookie-banner'>{say(20)}</div><main><h1>{head}</h1>{body}<form>{say(5)}</form></main><div class='newsletter'>{say(12)}</div><script>var x = '{say(5)}'</script>",
    ][k % 4]
    return f"<!doctype html><html><head><title>{head}</title></head><body>{page}</body></html>", "\n".join([head, *parts])


def test_main_text_of_pages_that_are_known(spark):
    rng = np.random.default_rng(9)
    pages = [gold(k, rng) for k in range(120)]
    rows = [(i, f"http://h{i % 4}.example/{i}", p) for i, (p, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    f1 = []
    for i, (_, want) in enumerate(pages):
        a, b = want.split(), got[i].split()
        both = len(set(a) & set(b))
        f1.append(2 * both / max(1, len(set(a)) + len(set(b))))
    assert np.mean(f1) > 0.98 and min(f1) > 0.9, (np.mean(f1), min(f1), np.argmin(f1))

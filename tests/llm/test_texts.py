"""Language, toxicity, digests and page text."""

import hashlib
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from catalens.llm import fingerprint, html, langid, toxicity
from catalens.llm import queries as q

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = q.op1_language_id(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_language_odd(spark, odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 3)) and by[7]["lang_pred"] != "und"
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).filter("false").unionByName(odd.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars", "score", "shard", "idx"))).collect()} == {"und"}


def test_language_sample_is_bounded(spark, tmp_path, monkeypatch):
    """Many texts and copies of one id, and many languages: no more rows and labels than documented."""
    seen = []
    monkeypatch.setattr(langid, "ridge", lambda x, y, labels, *rest: seen.append((len(x), len(labels))))
    at = F.col("id")
    one = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(at % 2 == 0, "a text with very many copies").otherwise(F.concat(F.lit("text "), F.format_string("%d of it", at))).alias("text"), F.lit("en").alias("lang"))
    many = spark.range(12_000).select((at + 100).alias("doc_id"), F.concat(F.lit("words "), F.hex(at)).alias("text"), F.format_string("l%04d", at % 3000).alias("lang"))
    one.unionByName(many).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    langid.fit(docs, 2400)
    langid.fit(docs.filter("doc_id = 7"), 400)
    assert 0 < seen[0][0] <= 3600 and seen[0][1] <= 300 and 0 < seen[1][0] <= 600


def test_kernel_is_the_share_of_common_grams():
    table = langid.letters_table()
    a, b = langid.presence("alpha beta", table), langid.presence("Alpha, BETA!", table)
    assert (a == b).all() and langid.presence("123 ...", table) is None and langid.presence("\u0301 \u0300", table) is None
    x = np.stack([a]).astype(np.float32)
    assert langid.kernel(x, x.T, x.sum(1))[0, 0] == pytest.approx(1)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in q.op9_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == int(r["score"] >= 0.5) and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    y, s = np.array([labels[r["doc_id"]] for r in rows]), np.array([r["score"] for r in rows])
    assert np.mean(s[y == 1] >= 0.5) > 0.8 and np.mean(s[y == 0] >= 0.5) < 0.02


def test_machine_counts_pairs():
    m = toxicity.Machine(-1.0, {1: 0, 2: 1}, np.ones(2), np.array([0.5, 0.25]), np.zeros((2, toxicity.RANK)))
    m.factors[0, 0], m.factors[1, 0] = 2.0, 3.0
    logit = lambda p: np.log(p / (1 - p))
    assert logit(m.score([0, 1])) == pytest.approx(-1 + 0.5 + 0.25 + 6) and logit(m.score([])) == pytest.approx(-1)


def test_pairs_are_learned():
    """Two terms that are harmful only together, which no sum of weights can tell."""
    rows = [[0], [1], [0, 1], []] * 60
    y = np.array([0, 0, 1, 1] * 60, float)
    bias, w, v = toxicity.train(rows, y, np.ones(len(y)), np.ones(2), rounds=800)
    m = toxicity.Machine(bias, {}, np.ones(2), w, v)
    assert m.score([0, 1]) > 0.5 > max(m.score([0]), m.score([1])) and m.score([]) > 0.5


def test_pairs_of_common_words_are_found(spark, tmp_path):
    """Two words as common in clean texts as in toxic ones, each with decoys of its own, tell together."""
    rng = np.random.default_rng(1)
    fill = [f"{a}{b}{c}" for a in "bdfgkm" for b in "aeiou" for c in "lnrst"]
    rows = []
    for i in range(2400):
        toxic = i % 3 == 0
        own = (["slight", "folk"] if rng.random() < 0.5 else []) if toxic else [["slight"], ["folk"]][i % 2]
        rows.append((i, " ".join(rng.permutation([*rng.choice(fill, 30), *own, *(["vileword"] if toxic and not own else [])])), int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, toxic int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    machine = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert {toxicity.cells(w)[0] for w in ("slight", "folk", "vileword")} <= set(machine.index)
    score = lambda t: machine.score(toxicity.Terms(machine.index).of(t))
    assert score("bal del fil slight gar folk") > 0.5 > max(score("bal del fil slight gar"), score("bal del folk gar"), score("bal folk fil"))
    assert score("bal vileword") > 0.5


def test_toxicity_sample_is_bounded(spark, tmp_path, monkeypatch):
    """Very many rows of one labelled id count once; ids are no more than the parameters."""
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, y, *rest: (seen.append((len(rows), int(y.sum()))), train(rows, y, *rest, rounds=2))[1])
    at = F.col("id")
    docs = spark.range(30_000).select(F.when(at < 20_000, 7).otherwise(at).alias("doc_id"), F.concat(F.lit("some words "), F.hex(at % 40)).alias("text"))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 3).cast("int").alias("toxic"))
    toxicity.fit(docs, labels, 300, 600)
    toxicity.fit(docs, labels.filter("doc_id = 7 OR doc_id < 20100"), 300, 600)
    assert seen[0] == (900, 300) and seen[1] == (101, 26)


def test_fit_takes_little_memory(monkeypatch):
    """Factors of a few cells at a time, with the bits of all at once, whatever the runs."""
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(3000, n, replace=False)).astype(np.int32) for n in rng.integers(0, 500, 2000)]
    y = rng.integers(0, 2, len(rows)).astype(float)
    tracemalloc.start()
    whole = toxicity.train(rows, y, np.ones(len(y)), rng.random(3000), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(whole[2]).all() and peak < 30 << 20  # with all factors at once over 100 MB
    some = [r.tolist() for r in rows[:60]] + [[]]
    outs = []
    for most in (1, 70, 1 << 30):
        monkeypatch.setattr(toxicity, "AT_ONCE", most)
        outs.append(toxicity.train(some, np.arange(61) % 2.0, np.ones(61), np.linspace(0.1, 1, 3000), rounds=5))
    assert all(np.array_equal(a, b) for o in outs[1:] for a, b in zip(o, outs[0]))


def test_scores_of_many_are_those_of_each():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(-0.3, {}, rng.random(50), rng.normal(size=50), rng.normal(size=(50, toxicity.RANK)) / 4)
    rows = [sorted(rng.choice(50, n, replace=False).tolist()) for n in (0, 3, 0, 50, 1, 20, 0)]
    for row, got in zip(rows, m.scores(rows)):
        pairs = sum(m.factors[i] @ m.factors[j] * m.value[i] * m.value[j] for k, i in enumerate(row) for j in row[k + 1 :])
        assert got == pytest.approx(1 / (1 + np.exp(-(m.bias + sum(m.weight[i] * m.value[i] for i in row) + pairs))))


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, None), (None, 1), (10, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.scored(odd, labels).count() == odd.count()
    assert toxicity.scored(empty, labels).count() == 0
    assert toxicity.scored(odd, labels.filter("toxic = 7")).filter("predicted = 1").count() == 0
    assert toxicity.clean(odd, toxicity.Machine(-1.0)).count() == odd.count() and toxicity.clean(odd, toxicity.Machine(1.0)).columns == odd.columns


def plain(text):
    """The canonical form, told again: folded and with single spaces."""
    once = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"\s+", " ", re.sub(r"[\x1c-\x1f]", " ", once)).strip()


def check_digests(rows, texts, digest=lambda t: xxhash.xxh3_128(t.encode()).hexdigest()):
    order = sorted(texts)
    following = {i: texts[order[(k + 1) % len(order)]] or "" for k, i in enumerate(order)}
    for r in rows:
        own = texts[r["doc_id"]] or ""
        n = len(own) // 4
        new = own[: len(own) - n] + following[r["doc_id"]][:n] if n else own
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (digest(plain(own)), digest(plain(new)))
        assert r["near_edited"] == float(plain(own) == plain(new)) and r["near_next"] == float(plain(own) == plain(following[r["doc_id"]]))


def test_digests(spark, texts):
    rows = q.op5_fingerprint(spark, SMALL).collect()
    assert len(rows) == len(texts)
    check_digests(rows, texts)


def test_digests_odd(spark, odd, empty):
    unique = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_digests(fingerprint.fingerprints(unique).collect(), {r["doc_id"]: r["text"] for r in unique.collect()})
    assert fingerprint.fingerprints(odd).count() == odd.count() and fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(odd.filter("doc_id = 10")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_canonical_forms():
    assert fingerprint.canonical("  Straße ＡＢ\n\nC ") == fingerprint.canonical("STRASSE ab c") and fingerprint.canonical(None) == b""


def test_unequal_texts_under_one_digest_are_told_apart(spark):
    from catalens.llm import fingerprint as f

    rows = spark.createDataFrame([("same", "s1"), ("same", "s2"), ("other", "s3"), ("other", "s3")], "digest string, sha string")
    assert [r[0] for r in f.differing(rows, spark.createDataFrame([("a",)], "text string")).collect()] == ["same"]


@pytest.mark.parametrize("blind", [False, True])
def test_bytes_are_compared_where_digests_collide(spark, tmp_path, monkeypatch, blind):
    """A digest with many collisions, and with ``blind`` a SHA-256 that tells nothing before the comparison."""
    texts = {i: ["", "abc", "ABC ", "abcdefgh", "abcdefgX", "abcdefgh", None, "y" * 9, "z" * 9][i % 9] + str(i // 9) if i % 9 != 6 else None for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(fingerprint, "digest", lambda canon: str(len(canon) % 3))
    if blind:
        compared = fingerprint.shared_digests
        monkeypatch.setattr(fingerprint, "shared_digests", lambda rows: compared(rows.withColumn("sha", F.lit("0"))))
    rows = fingerprint.fingerprints(docs).collect()
    order = sorted(texts)
    new = {i: fingerprint.edited(texts[i] or "", texts[order[(k + 1) % len(order)]] or "") for k, i in enumerate(order)}
    names = {}
    for r in rows:
        names.setdefault(plain(texts[r["doc_id"]]), set()).add(r["fingerprint"])
        names.setdefault(plain(new[r["doc_id"]]), set()).add(r["edited_fingerprint"])
    assert len(rows) == len(texts) and all(len(v) == 1 for v in names.values())
    assert len(set().union(*names.values())) == len(names)


def test_edited_texts_alone_collide(spark, tmp_path, monkeypatch):
    """Two documents of their own digests whose edited texts share one: only their bytes tell."""
    texts = {0: "aaaaaaab", 1: "bbcccccd", 2: "eefffffg", 3: "h" * 30}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    known = {t.encode() for t in texts.values()}
    monkeypatch.setattr(fingerprint, "digest", lambda c: c.hex() if c in known else "same")
    compared = fingerprint.shared_digests
    monkeypatch.setattr(fingerprint, "shared_digests", lambda rows: compared(rows.withColumn("sha", F.lit("0"))))
    rows = fingerprint.fingerprints(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len({r["edited_fingerprint"] for r in rows}) == 4 and all(r["edited_fingerprint"].startswith("same-") for r in rows)


def test_equal_rows_are_ordered_by_place(spark, tmp_path):
    spark.createDataFrame([(7, "the same text")] * 500 + [(8, "other")], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    rows = fingerprint.fingerprints(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(r["near_next"] for r in rows) == [0.0] * 2 + [1.0] * 499


PAGE = """<html><body class="has-sidebar"><header><a href=/>Home</a></header><div class="cookie-notice">We use cookies</div><div class="sidebar"><p>side</p></div>
<div class="post-content"><h1>Title &amp; more</h1><p>First   para&nbsp;with <a href=x>link</a> text that is long enough to be the main one.<p>Second<br>line<ul><li>one<li>two</ul><script>var a = "<p>no</p>";</script><form>no</form></div>
<div class="comments"><p>reader says a lot of things about all of this and more and more and more and more</p></div><footer>foot</footer></body></html>"""


def test_page_text():
    assert html.extract(PAGE, None) == "Title & more\nFirst para with link text that is long enough to be the main one.\nSecond line\none\ntwo"
    assert html.extract(None, None) == "" and html.extract("", "x") == "" and html.extract("plain <b>words", None) == "plain words"
    assert html.vote(PAGE)[0].endswith("div.post-content") and html.extract("<" * 3000 + "a" * 10, None) is not None


def test_hosts_vote(spark):
    body = "<html><body><div class='x{}'><p>{}</p></div><div class='box'><p>{}</p></div></body></html>"
    rows = [(i, "http://h.example/a", body.format(i, "short", "the article of this page is told here at some length " * 4)) for i in range(6)]
    rows += [(9, "http://h.example/b", body.format(9, "an aside of this page that runs on for quite a while, longer than all the rest of it " * 4, "the article is in its box as on the other pages, and it is told at length here " * 3)), (10, None, None), (11, "no url", "<p>text alone"), (None, "", "")]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[9]["text"].startswith("the article is in its box") and got[10]["text"] == "" and got[11]["text"] == "text alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_hosts_of_mixed_templates(spark):
    """A story beside an intro of the winning class stays whole, alone or as a template of its own."""
    plain = "<html><body><div class='intro'><p>{}</p></div></body></html>"
    mixed = "<html><body><div class='intro'><p>{}</p></div><div class='{}'><p>{}</p></div></body></html>"
    intro, story = "an intro of few words only, told in a line. ", "a story of its own, at some length. "
    rows = [(i, "http://m.example/a", plain.format(intro * 8)) for i in range(8)]
    rows += [(20 + i, "http://m.example/b", mixed.format(intro * 4, "story", story * 8)) for i in range(3)]
    rows += [(30, "http://m.example/c", mixed.format(intro * 2, "single", story * 8))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (intro * 8).strip() for i in range(8)) and all(got[i].endswith((story * 8).strip()) for i in (20, 21, 22, 30))


def test_pages_without_rows(spark):
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_pages(spark):
    rows = q.op8_html(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count() and all(r["text"] for r in rows)


def test_all_containers_of_the_winning_path_are_read():
    split = "<html><body><div class='a'><p>{}</p></div><article><p>{}</p></article><article><p>{}</p></article></body></html>".format("x " * 9, "first half of it. " * 20, "second half of it. " * 19)
    path = html.vote(split)[0]
    assert path.endswith("article") and [x[:6] for x in html.extract(split, path).split("\n")] == ["first ", "second"]

"""Divergence of the sources of a language from each other, in exact integer arithmetic.

Terms are runs of letters (ASCII letters of either case, lower-cased, and all
characters beyond ASCII). A language keeps the terms that ``least`` of its
documents hold. With N a group's (or the language's) occurrences of the V kept
terms, a term that occurs c times has p = 1 + floor(SCALE * (c + 1) / (N + V)), and
a group with p is apart from one with q by floor((p - q)^2 / q).

Joint count histograms: what a pair of sources is apart by depends on how often each
combination (count here, count there) occurs, not on the terms.

1. Tasks count terms by (lang, source) in bounded dictionaries; Spark adds them up.
2. Sources get numbers. Per term, the sources that have it are gathered in rows of at
   most ``TILE`` of them; each two rows of a term are tallied to combinations in
   the task, so that pairs never become rows of their own.
3. Zero cells are implied: a source's own histogram less its joint cells, and V less
   both sources' terms plus the joint ones. They are added as signed counts.
4. The measure is evaluated once a combination and direction, times its count.

Defined cases: null text, lang and source are empty strings, and such a language
or source is one like others; an empty or very long text is counted whole;
repeated rows count each for itself; a group without terms is compared, too; a language
without kept terms has pairs of value 0; ties are ranked by item in UTF-8 order; an
empty table gives an empty result; ids and extra columns are not read. Memory of a task is
that of ``HELD`` dictionary entries and ``TALLY`` pairs; the result has a row for each two
sources of a language, as asked, and nothing else grows with their square.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.common import ship, slices
from catalens.shared import materialize, numbered

SCALE = 1_000_000_000
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Dictionary entries that a task holds before it passes them on, sources a row of a term, and pairs that are tallied at once.
HELD, TILE, TALLY = 500_000, 64, 1 << 20
#: One document beside its occurrences in a dictionary's value.
DOCUMENT = 1 << 40
#: Characters from which a text's terms are taken one by one.
LONG = 1 << 20


def terms(text: str) -> Iterable[bytes]:
    raw = text.encode("utf-8", "replace").lower()
    return TERM.findall(raw) if len(raw) < LONG else (m[0] for m in TERM.finditer(raw))


def _counted(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in held.items():
        names, packed = list(own), list(own.values())
        for s in range(0, len(names), 1 << 14):
            part, both = names[s : s + (1 << 14)], packed[s : s + (1 << 14)]
            columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([x % DOCUMENT for x in both], pa.int64()), pa.array([x // DOCUMENT for x in both], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""

    def count(batches):
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        entries = 0
        for b in slices(batches):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                own = held.setdefault((lang, source), {})
                entries -= len(own)
                seen = own.get
                for term, n in Counter(terms(text)).items():
                    own[term] = seen(term, 0) + n + DOCUMENT
                entries += len(own)
                if entries > HELD:
                    yield from _counted(held)
                    held, entries = {}, 0
        yield from _counted(held)

    # By term and language, so that what a language has of a term needs no further shuffle; dictionaries are added up before.
    rows = _plain(docs, "lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _plain(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact at any size."""
    whole = f"cast({SCALE} AS decimal(10, 0)) * cast({count} + 1 AS decimal(20, 0))"
    return F.expr(f"1 + cast({whole} div cast(greatest({total} + {kept}, 1) AS decimal(20, 0)) AS long)")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def joint(tiles: DataFrame) -> DataFrame:
    """(a, b, ca, cb, m): how many terms sources a < b hold ca and cb times, both more than none."""

    def tally(batches):
        held, size = [], 0
        for b in batches:
            columns = [b.column(c) for c in ("sa", "na", "sb", "nb")]
            width = [np.diff(c.offsets.to_numpy()) for c in columns]
            start = [c.offsets.to_numpy()[:-1] for c in columns]
            values = [c.values.to_numpy() for c in columns]
            shape = width[0] * (TILE + 1) + width[2]
            for k in np.unique(shape):  # rows of equal widths at once
                rows = np.flatnonzero(shape == k)
                wide = (width[0][rows[0]], width[2][rows[0]])
                sa, na, sb, nb = (v[s[rows][:, None] + np.arange(wide[i // 2])] for i, (v, s) in enumerate(zip(values, start)))
                for r in range(0, len(rows), max(1, TALLY // (wide[0] * wide[1]))):
                    part = slice(r, r + max(1, TALLY // (wide[0] * wide[1])))
                    at, i, j = np.nonzero(sa[part, :, None] < sb[part, None, :])
                    held.append(np.stack((sa[part][at, i], sb[part][at, j], na[part][at, i], nb[part][at, j])))
                    size += len(at)
                    if size > TALLY:
                        yield _tallied(held)
                        held, size = [], 0
        if size:
            yield _tallied(held)

    left = tiles.select("lang", "term", "tile", F.col("sources").alias("sa"), F.col("ns").alias("na"))
    right = tiles.select("lang", "term", F.col("tile").alias("other"), F.col("sources").alias("sb"), F.col("ns").alias("nb"))
    both = left.join(right, ["lang", "term"]).filter("tile <= other").select("sa", "na", "sb", "nb")
    return both.mapInArrow(tally, "a long, b long, ca long, cb long, m long").groupBy("a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def _tallied(held: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(held, axis=1)
    rows = rows[:, np.lexsort(rows)]
    first = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0))))
    m = np.diff(np.concatenate((first, [rows.shape[1]])))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:, first], m)], ["a", "b", "ca", "cb", "m"])


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of each group's language, and its ``top`` terms.

    Part ``pair`` has the group's divergence from each other source, over all kept terms; part
    ``term`` the terms that the group has more often than its language, by their own divergence.
    """
    groups = materialize(numbered(_plain(docs, "lang", "source").distinct(), ["lang", "source"], "g"), "groups")
    of_term = Window.partitionBy("lang", "term")
    kept = counts(docs).select("*", F.sum("docs").over(of_term).alias("held"), F.sum("n").over(of_term).alias("total"), F.row_number().over(of_term.orderBy("source")).alias("nth"))
    own = materialize(kept.filter(F.col("held") >= least).join(groups, ["lang", "source"]).select("g", "lang", "term", "n", "total", (F.col("nth") == 1).cast("long").alias("once")), "own")
    langs = own.groupBy("lang").agg(F.sum("once").alias("v"), F.sum("n").alias("all"))
    sums = own.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    groups = groups.join(langs, "lang", "left").join(sums, "g", "left")
    groups = materialize(groups.select("g", "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "all", "n", "terms")]), "groups")

    tiles = own.groupBy("lang", "term", F.expr(f"g div {TILE}").alias("tile")).agg(F.collect_list(F.struct("g", "n")).alias("x")).select("lang", "term", "tile", F.col("x.g").alias("sources"), F.col("x.n").alias("ns"))
    cells = materialize(joint(materialize(tiles, "tiles")), "joint")
    hist = materialize(own.groupBy("g", "n").agg(F.count("*").alias("h")).withColumnRenamed("n", "c"), "histograms")
    side = lambda x: groups.select(F.col("g").alias(x), "lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "v", "n", "terms")])
    pairs = materialize(side("a").join(side("b"), "lang").filter("a < b"), "pairs")
    zero = F.lit(0).cast("long")
    row = lambda df, ca, cb, m: df.select("a", "b", ca.alias("ca"), cb.alias("cb"), m.cast("long").alias("m"))
    ca, cb, m, c, h = (F.col(x) for x in ("ca", "cb", "m", "c", "h"))
    of = lambda x: pairs.select("a", "b").join(hist.withColumnRenamed("g", x), x)
    parts = [row(cells, ca, cb, m), row(cells, ca, zero, -m), row(cells, zero, cb, -m), row(cells, zero, zero, m)]
    parts += [row(of("a"), c, zero, h), row(of("b"), zero, c, h), row(pairs, zero, zero, F.expr("v_a - terms_a - terms_b"))]
    tally = parts[0]
    for more in parts[1:]:
        tally = tally.unionByName(more)
    tally = tally.groupBy("a", "b", "ca", "cb").agg(F.sum("m").alias("m")).join(pairs, ["a", "b"])
    tally = tally.withColumn("p", probability("ca", "n_a", "v_a")).withColumn("q", probability("cb", "n_b", "v_b"))
    value = tally.groupBy("a", "b").agg(F.sum(F.col("m") * apart("p", "q")).alias("ab"), F.sum(F.col("m") * apart("q", "p")).alias("ba"))
    value = pairs.select("a", "b", "lang", "source_a", "source_b").join(value, ["a", "b"]).select("lang", F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("ba").alias("value")),
    )).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "x.value")

    told = own.join(groups.select("g", "source", "v", F.col("n").alias("in_group"), F.col("all").alias("in_lang")), "g")
    told = told.withColumn("p", probability("n", "in_group", "v")).withColumn("q", probability("total", "in_lang", "v")).filter("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    at = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    return value.select("*", at).unionByName(told.select("*", at).filter(F.col("rank") <= top))


ship(__name__)

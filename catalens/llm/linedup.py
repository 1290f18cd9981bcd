"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line of ``equal`` or more characters is a duplicate if an equal line occurs
earlier, one of ``near`` or more also if a line of that length within edit
distance 1 does, in order of (doc_id, text hash, place, line number); duplicates
are taken out of their documents, the earliest stays. Both are ``LEAST`` unless
given; with ``equal`` 1, as in the query and the pipeline, no repeat of a line is left.

1. Equal lines are grouped by a 128-bit hash; a row stands for each line.
2. Two lines within one edit share a half (pigeonhole, by exact length), so only
   lines that share a half with another line go on. Nothing is lost by this.
3. Of those, only lines that agree with another one apart from one of ``PARTS``
   stretches go on: the neighbourhood of coarse deletions, as lossless.
4. Those emit their deletion neighbourhood as hashed keys. A key hashes what is
   before the character's stretch of ``STRETCH`` characters, the stretch without
   the character, and what is after, so a line costs far less than its square.
   Lines that give the same key at the same place differ in that one character:
   all are joined to the earliest of them, without pairs. Keys of one deletion
   are joined with the keys of undeleted lines for insertions.
5. The edit distance of joined lines is verified.

Defined cases: a null text stays null; an empty text stays empty; lines end at
LF only; shorter lines, and blank ones of under ``near`` characters, are never
touched; a document that loses all lines has an
empty text and stays; rows of null ids count as earliest; fully equal rows are
told apart by their place in the file; an empty table gives an empty result;
extra columns are kept, whatever their names; texts and lines may be of any
length. Texts are never moved: lines travel as hashes and places, and decisions
are brought to the files in blocks of bounded bytes (``common.met``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import boxed, met, scanned
from catalens.shared import materialize, numbered

LEAST = 20
PARTS = 16
STRETCH = 64
LINE = ["h1", "h2"]


def lines_of(docs: DataFrame, equal: int = LEAST, near: int = LEAST) -> DataFrame:
    """Every line of ``equal`` or more characters, blank ones of ``near`` or more, with its place and hashes."""
    rows = boxed(docs).select("_file", "_row", F.col("_doc.doc_id").cast("long").alias("doc_id"), F.xxhash64("_doc.text").alias("th"), F.posexplode(F.split("_doc.text", "\n")).alias("pos", "line"))
    judged = rows.withColumn("len", F.length("line")).filter((F.col("len") >= min(equal, near)) & ((F.col("len") >= near) | F.col("line").rlike(r"\S")))
    return judged.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(31), "line"))


def halves() -> Column:
    """Keys of both halves of a line, as one of its length and as the longer of a pair."""
    out = []
    for n in ("len", "len - 1"):
        out.append(F.expr(f"xxhash64(1, {n}, substring(line, 1, cast(floor(({n}) / 2) AS int)))"))
        out.append(F.expr(f"xxhash64(2, {n}, right(line, cast(({n}) - floor(({n}) / 2) AS int)))"))
    return F.array(*out)


def stretches() -> Column:
    """Keys of a line without one of ``PARTS`` stretches, as one of its length and as the longer of a pair."""
    out = []
    for n in ("len", "(len - 1)"):
        for j in range(PARTS):
            start, end = f"cast(floor({j} * {n} / {PARTS}) AS int)", f"cast(floor({j + 1} * {n} / {PARTS}) AS int)"
            out.append(F.expr(f"xxhash64({n}, {j}, substring(line, 1, {start}), right(line, {n} - {end}))"))
    return F.array(*out)


def neighbourhood(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of one deletion (key, at, ord) and of none (key, ord)."""
    b = STRETCH
    cut = (
        lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"cast(floor(len / {b}) AS int)"))))
        .withColumn("before", F.expr(f"xxhash64(substring(line, 1, k * {b}))"))
        .withColumn("part", F.expr(f"substring(line, k * {b} + 1, {b})"))
    )
    deleted = (
        cut.filter(f"k * {b} < len").withColumn("after", F.expr(f"xxhash64(substring(line, (k + 1) * {b} + 1))"))
        .withColumn("i", F.explode(F.expr("sequence(1, length(part))")))
        .select(F.expr("xxhash64(len - 1, k, before, concat(substring(part, 1, i - 1), substring(part, i + 1)), after)").alias("key"), F.expr(f"k * {b} + i").alias("at"), "ord")
    )
    short = f"cast(least({b}, len + 1 - k * {b}) - 1 AS int)"
    whole = cut.select(
        F.expr(f"xxhash64(len, k, before, substring(line, k * {b} + 1, {short}), xxhash64(substring(line, k * {b} + 1 + {short})))").alias("key"), "ord"
    )
    return deleted, whole


def duplicates(docs: DataFrame, equal: int = LEAST, near: int = LEAST) -> DataFrame:
    """(_file, _row, pos) of every line that an equal or near-equal one precedes; ``docs`` reads files."""
    place = F.struct("doc_id", "th", "_file", "_row", "pos")
    lines = lines_of(docs, equal, near)
    distinct = materialize(
        lines.withColumn("keys", F.when(F.col("len") >= near, halves())).groupBy(*LINE)
        .agg(F.min(place).alias("first"), F.count("*").alias("n"), *[F.min(F.col("keys")[i]).alias(f"k{i}") for i in range(4)]),
        "lines",
    )
    # Joins are merge joins at any size, of hashes and places only; a hot line's side is split by the adaptive planner.
    keys = distinct.select(*LINE, F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).filter("key IS NOT NULL")
    shared = keys.groupBy("key").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in LINE]).filter("min_h1 <> max_h1 OR min_h2 <> max_h2").select("key")
    some = keys.join(shared.hint("merge"), "key", "left_semi").select(*LINE).distinct()
    some = distinct.select(*LINE, "first").join(some.hint("merge"), LINE)
    some = numbered(some.select(*LINE, "first.*"), ["doc_id", "th", "_file", "_row", "pos"], "ord")
    texts = materialize(met(docs, some.groupBy("_file", "_row").agg(F.collect_list(F.struct("pos", "ord", *LINE)).alias("_value")), _called_lines, F.size("_value") * 40), "candidates")
    parts = texts.select("ord", F.explode(stretches()).alias("key"))
    alike = parts.groupBy("key").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).filter("low <> high").select("key")
    alike = parts.join(alike.hint("merge"), "key", "left_semi").select("ord").distinct()
    close = materialize(texts.join(alike.hint("merge"), "ord", "left_semi"), "close")
    deleted, whole = neighbourhood(close)
    firsts = deleted.groupBy("key", "at").agg(F.min("ord").alias("a"), F.max("ord").alias("last")).filter("a <> last").select("key", "at", "a")
    swapped = deleted.join(firsts.hint("merge"), ["key", "at"]).filter("ord <> a").select("a", F.col("ord").alias("b"))
    longer = deleted.join(whole.withColumnRenamed("ord", "other").hint("merge"), "key").filter("ord <> other").select(F.least("ord", "other").alias("a"), F.greatest("ord", "other").alias("b"))
    one = close.select(F.col("ord").alias("a"), F.col("line").alias("earlier"))
    two = close.select(F.col("ord").alias("b"), F.col("line").alias("later"), *LINE)
    found = swapped.unionByName(longer).distinct().join(one.hint("merge"), "a").join(two.hint("merge"), "b").filter("levenshtein(earlier, later, 1) BETWEEN 0 AND 1")
    found = found.select(*LINE, F.lit(True).alias("near")).distinct()
    judged = distinct.join(found.hint("merge"), LINE, "left").filter("n > 1 OR near").select(*LINE, F.coalesce("near", F.lit(False)).alias("near"), *[F.col(f"first.{c}").alias(f"first{c}") for c in ("_file", "_row", "pos")])
    judged = materialize(judged, "judged")  # written, so that a hot line is a join's key, which can be split
    stays = " AND ".join(f"{c} = first{c}" for c in ("_file", "_row", "pos"))
    return lines.select("_file", "_row", "pos", *LINE).join(judged.hint("merge"), LINE).filter(f"near OR NOT ({stays})").select("_file", "_row", "pos")


def _called_lines(rows: DataFrame) -> DataFrame:
    """(h1, h2, line, len, ord) of the lines that _value names."""
    each = rows.withColumn("_parts", F.split("_doc.text", "\n")).select("_parts", F.explode("_value").alias("v"))
    return each.select("v.h1", "v.h2", F.expr("_parts[v.pos]").alias("line"), "v.ord").withColumn("len", F.length("line"))


def without_duplicates(docs: DataFrame, equal: int = LEAST, near: int = LEAST) -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``, and _lines and _dropped, their numbers.

    ``equal`` and ``near`` are the least lengths of lines that go for an equal one and for one an edit apart.
    Where ``docs`` has a column of either name, the number's name gets a further underscore.
    """
    docs = scanned(docs)
    drops = duplicates(docs, equal, near).groupBy("_file", "_row").agg(F.collect_list("pos").alias("_value"))
    names = [n if n not in docs.columns else f"{n}_" for n in ("_lines", "_dropped")]
    text, kept = F.col("_doc.text"), F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_value"))
    left = F.when(F.col("_value").isNull() | text.isNull(), text).otherwise(F.expr("array_join(transform(_kept, i -> _parts[i]), '\n')"))

    def apply(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_parts", F.split(text, "\n")).withColumn("_kept", kept)
        return rows.select(F.col("_doc").withField("text", left).alias("_doc"), F.when(text.isNull(), 0).otherwise(F.size("_parts")).alias("a"), F.coalesce(F.size("_value"), F.lit(0)).alias("b")).select(
            "_doc.*", F.col("a").alias(names[0]), F.col("b").alias(names[1])
        )

    return met(docs, drops, apply, F.size("_value") * 4, every=True)

"""Canonical exact digests of documents.

The canonical form of a text is its NFKC form, case-folded, put into NFKC again,
with each run of white space made one space and none at the ends. The digest is
the 128-bit xxhash of its UTF-8 bytes. Members of a bucket of equal digests are
then compared byte for byte (smallest against largest canonical text, partly
aggregated, so that a hot bucket is no single task's work); where they differ,
the digest of each is lengthened by the SHA-256 of its canonical text. Edited
texts are members of buckets like documents: those of a digest that occurs more
than once are made again from the files and compared too.

Order: by id, null ids first, then by a hash of the text, then by place, so a task's
range is a part of any group of equal rows. Defined cases: a null text is empty, and
all empty texts are equal; the only row of a table is its own next; an empty table
gives an empty result; extra columns are ignored, whatever their names; texts may be
of any length.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import boxed, met, scanned, ship, slices
from catalens.shared import BROADCAST_BYTES, materialize

WORDS_OF_BITS = 1 << 17


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def shared_digests(rows: DataFrame) -> DataFrame:
    """The digests of ``rows`` (digest, sha) that occur more than once, with the least and largest sha."""
    many = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("sha").alias("low"), F.max("sha").alias("high"))
    return materialize(many.filter("n > 1"), "buckets")


def differing(rows: DataFrame, texts: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Digests (column ``digest``) under which different canonical texts were found.

    ``rows`` has a digest and sha of every text. Only texts whose digest is in a
    bitmap of fixed size, made from the digests that occur more than once, are
    compared, so single texts aren't moved; false hits cost work only. ``more`` gives
    (digest, canon) of further texts for the table of those digests.
    """
    many = shared_digests(rows)
    word, bit = F.expr(f"pmod(xxhash64(digest), {WORDS_OF_BITS})"), F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(digest), 20), 64) AS int))")
    bits = F.broadcast(many.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")))  # at most WORDS_OF_BITS rows

    canons = texts.select("text").mapInArrow(canonicals, "digest string, canon binary").withColumn("word", word).join(bits, "word").filter(F.col("bits").bitwiseAND(bit) != 0).select("digest", "canon")
    canons = canons if more is None else canons.unionByName(more(many))
    compared = canons.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter("low <> high").select("digest")
    return materialize(many.filter("low <> high").select("digest").union(compared).distinct(), "collisions")


def edited_again(docs: DataFrame, rows: DataFrame, many: DataFrame) -> DataFrame:
    """(digest, canon) of the edited texts of ``rows`` whose digest is in ``many``, from the texts in the files."""
    place = F.struct("_file", "_row")
    of = rows.join(many.select(F.col("digest").alias("edited_digest")).hint("merge"), "edited_digest", "left_semi").select("_file", "_row", "next_file", "next_row", "n_chars")
    kept, put = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"), F.floor(F.col("n_chars") / 4).cast("int")
    own = of.select("_file", "_row", F.lit(0).alias("part"), kept.alias("n"), place.alias("of"))
    following = of.select(F.col("next_file").alias("_file"), F.col("next_row").alias("_row"), F.lit(1).alias("part"), put.alias("n"), place.alias("of"))
    # A document has one next and is the next of one, so a place has at most two values.
    asked = own.unionByName(following).groupBy("_file", "_row").agg(F.collect_list(F.struct("part", "n", "of")).alias("_value"))

    def parts(found: DataFrame) -> DataFrame:
        each = found.select(F.coalesce("_doc.text", F.lit("")).alias("text"), F.explode("_value").alias("v"))
        return each.select("v.of", "v.part", F.expr("substring(text, 1, v.n)").alias("piece"))

    whole = met(docs, asked, parts, F.lit(96)).groupBy("of").agg(*[F.max(F.when(F.col("part") == k, F.col("piece"))).alias(f"piece{k}") for k in (0, 1)])
    return whole.select(F.concat("piece0", "piece1").alias("text")).mapInArrow(canonicals, "digest string, canon binary")


def canonicals(batches):
    for b in slices(batches):
        canon = [canonical(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([digest(c) for c in canon], pa.string()), pa.array(canon, pa.binary())], ["digest", "canon"])


def neighbours(docs: DataFrame) -> DataFrame:
    """A row for each document with its own, its edited and its next text's likeness, in one pass over id order."""
    spark = docs.sparkSession
    order = ["doc_id", F.xxhash64("text"), "_file", "_row"]
    placed = (
        boxed(docs).select(F.col("_doc.doc_id").cast("long").alias("doc_id"), F.coalesce("_doc.text", F.lit("")).alias("text"), "_file", "_row")
        .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )
    fields = (
        "kind string, part int, _file long, _row long, doc_id long, text string, next_file long, next_row long, n_chars long, edited_sha256 string, digest string, sha string, "
        "edited_digest string, edited_sha string, near_edited double, near_next double"
    )
    names = [f.split()[0] for f in fields.split(", ")]

    def facts(doc_id, text, following, canon, next_canon, next_file, next_row):
        new = edited(text, following)
        new_canon = canonical(new)
        return [
            doc_id, None, next_file, next_row, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), digest(canon), hashlib.sha256(canon).hexdigest(), digest(new_canon),
            hashlib.sha256(new_canon).hexdigest(), float(canon == new_canon), float(canon == next_canon),
        ]

    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def walk(batches):
        last = None
        for b in slices(batches):
            out = []
            for part, file, row, doc_id, text in zip(*(b.column(n).to_pylist() for n in ("part", "_file", "_row", "doc_id", "text"))):
                canon = canonical(text)
                if last is None:
                    out.append(["head", part, file, row, doc_id, text, *[None] * 10])
                else:
                    out.append(["row", *last[:3], *facts(*last[3:5], text, last[5], canon, file, row)])
                last = (part, file, row, doc_id, text, canon)
            yield batch(out)
        if last is not None:
            yield batch([["tail", *last[:5], *[None] * 10]])

    walked = materialize(placed.mapInArrow(walk, fields), "neighbours")
    parts = [r[0] for r in walked.filter("kind = 'head'").select("part").orderBy("part").collect()]
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])) or [(-1, -1)], "part int, next_part int")
    heads = walked.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("_file").alias("next_file"), F.col("_row").alias("next_row"))
    own = ["part", "_file", "_row", "doc_id", "text"]
    ends = walked.filter("kind = 'tail'").select(*own).join(F.broadcast(follow), "part").join(heads, "next_part").select(*own, "following", "next_file", "next_row")

    def close(batches):
        for b in slices(batches):
            rows = zip(*(b.column(n).to_pylist() for n in (*own, "following", "next_file", "next_row")))
            yield batch([["row", p, f, r, *facts(i, t, n, canonical(t), canonical(n), nf, nr)] for p, f, r, i, t, n, nf, nr in rows])

    return walked.filter("kind = 'row'").unionByName(ends.mapInArrow(close, fields)).drop("kind", "part", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = scanned(docs)
    rows = materialize(neighbours(docs), "digests")
    both = rows.select("digest", "sha").unionAll(rows.select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha")))
    bad = differing(both, docs, lambda many: edited_again(docs, rows, many))
    own, new = F.col("digest"), F.col("edited_digest")
    if not bad.isEmpty():
        bad = F.broadcast(bad) if bad.count() <= BROADCAST_BYTES // 256 else bad
        marked = bad.withColumn("bad", F.lit(True))
        rows = rows.join(marked, "digest", "left").withColumn("own_bad", F.col("bad")).drop("bad")
        rows = rows.join(marked.withColumnRenamed("digest", "edited_digest"), "edited_digest", "left")
        own, new = _longer(own, "sha", "own_bad"), _longer(new, "edited_sha", "bad")
    return rows.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), new.alias("edited_fingerprint"), "near_edited", "near_next")


def _longer(name: Column, sha: str, bad: str) -> Column:
    return F.when(F.col(bad), F.concat_ws("-", name, F.col(sha))).otherwise(name)


ship(__name__)

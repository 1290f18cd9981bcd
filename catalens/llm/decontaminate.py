"""Benchmark passages in documents by a prefix-filtered set join, in DataFrame functions only.

A window is ``WINDOW`` consecutive words of a benchmark item; an item with fewer words, but
not none, is one window. A document word inside any occurrence of a window is hit.

A window occurs where all of its shingles (runs of ``SHINGLE`` words, fewer in a shorter
window) do, so it is enough to look for any one of them: with whole containment asked,
the necessary prefix of a window, its shingles in order of rarity, is the first one.

1. Documents' shingles that are shingles of any window are kept with their places, as hashes.
2. Their numbers tell how rare shingles are. A window with a shingle that no document has
   is given up; of others, the rarest shingle is the prefix, with its position in the window.
3. Prefixes are joined with the kept places. The position tells where the window would
   begin; it must lie wholly inside the document (length and positional bound).
4. Candidates are brought to the documents in blocks of bounded bytes (``common.met``) and the
   words at their places are compared with the window's, as strings.
5. Documents with the same set of windows share one list of items, made once a set.

Defined cases: null texts and texts without a word have no words and are clean; texts of any length are
read whole; repeated rows are judged each for itself; items with equal words count each by its id,
a null id as the empty string; an empty benchmark leaves every document clean; an empty table gives
an empty result; extra columns are not read. What is broadcast is checked against
``shared.BROADCAST_BYTES``; beyond, merge joins of hashes and places take its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens import shared
from catalens.llm.common import boxed, met, scanned
from catalens.shared import materialize, small

WINDOW, SHINGLE = 10, 4
#: A word: digits, lower-case letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE = ["_file", "_row"]
#: Bytes of a broadcast row: a key, and a window with its prefix.
KEY_BYTES, WINDOW_BYTES = 64, 512


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def shingle(w: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words of ``w`` from position ``at``; null where they are not all there."""
    return F.when(at + size <= F.size(w), F.xxhash64(F.lit(size), *[F.get(w, at + i) for i in range(size)]))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words): every window of every item."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    at = own.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("at"))
    return at.select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words"))


def places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(_file, _row, n, pos, key): every shingle of every document with its place; a null key where there is none."""
    split = boxed(docs).select(*PLACE, words(F.col("_doc.text")).alias("w"))
    least = min(sizes)
    # An outer explode: of an inner one the optimiser makes a filter below the split, and texts would be split twice.
    begins = F.when(F.size("w") >= least, F.sequence(F.lit(0), F.size("w") - least))
    at = split.select(*PLACE, "w", F.size("w").alias("n"), F.explode_outer(begins).alias("pos"))
    if len(sizes) == 1:
        return at.select(*PLACE, "n", "pos", shingle(F.col("w"), F.col("pos"), least).alias("key"))
    return at.select(*PLACE, "n", "pos", F.explode_outer(F.array(*[shingle(F.col("w"), F.col("pos"), k) for k in sizes])).alias("key"))


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(_file, _row, start, window): where windows (window, words) may occur, by their rarest shingles."""
    size = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in windows.select(size.alias("k")).distinct().collect()) or [SHINGLE]  # at most SHINGLE numbers
    at = windows.select("window", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("off"))
    key = F.coalesce(*[F.when(size == k, shingle(F.col("words"), F.col("off"), k)) for k in sizes])
    tokens = materialize(at.select("window", F.size("words").alias("len"), F.expr(f"size(words) - least(size(words), {SHINGLE}) + 1").alias("need"), "off", key.alias("key")), "tokens")
    wanted = small(materialize(tokens.select("key").distinct(), "keys"), shared.BROADCAST_BYTES // KEY_BYTES)
    kept = materialize(places(docs, sizes).join(wanted, "key", "left_semi"), "places")
    rarity = materialize(kept.groupBy("key").agg(F.count("*").alias("count")), "rarity")
    prefix = tokens.join(rarity, "key").groupBy("window", "len", "need").agg(F.count("*").alias("have"), F.min(F.struct("count", "key", "off")).alias("rarest"))
    prefix = materialize(prefix.filter("have = need").select("window", "len", "rarest.key", "rarest.off"), "prefixes")
    met_at = kept.join(small(prefix, shared.BROADCAST_BYTES // WINDOW_BYTES), "key").withColumn("start", F.col("pos") - F.col("off"))
    return met_at.filter("start >= 0 AND start + len <= n").select(*PLACE, "start", "window")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    docs = scanned(docs)
    of_items = materialize(windows_of(items, window).select("item", F.array_join("words", " ").alias("window"), "words").distinct(), "windows")
    found = candidates(docs, of_items.select("window", "words").distinct())
    found = found.groupBy(*PLACE).agg(F.collect_list(F.struct("start", "window")).alias("_value"))
    weight = F.expr("aggregate(_value, 0L, (n, v) -> n + 40 + octet_length(v.window))")

    def judge(rows: DataFrame) -> DataFrame:
        split = rows.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), words(F.col("_doc.text")).alias("w"), "_value")
        # w is read twice here, so that the optimiser keeps it a column and doesn't split a text again for each candidate
        split = split.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr("transform(_value, v -> struct(v.start AS start, v.start + size(split(v.window, ' ')) AS end, v.window AS window))").alias("v"), "w")
        occurs = F.coalesce(F.filter("v", lambda v: F.array_join(F.slice(F.col("w"), v["start"] + 1, v["end"] - v["start"]), " ") == v["window"]), F.expr("array()").cast("array<struct<start:int,end:int,window:string>>"))
        split = split.select("doc_id", "n_words", F.sort_array(occurs).alias("v"))
        covered = F.expr("aggregate(v, struct(0L AS n, 0 AS end), (s, x) -> struct(s.n + greatest(x.end - greatest(s.end, x.start), 0) AS n, greatest(s.end, x.end) AS end), s -> s.n)")
        return split.select("doc_id", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct("v.window")).alias("windows"))

    judged = materialize(met(docs, found, judge, weight, every=True).withColumn("set", F.when(F.size("windows") > 0, F.sha2(F.array_join("windows", "\n"), 256))), "judged")
    sets = judged.filter("set IS NOT NULL").groupBy("set").agg(F.first("windows").alias("windows"))
    listed = sets.select("set", F.explode("windows").alias("window")).join(of_items.select("window", "item"), "window").select("set", "item").distinct()
    listed = listed.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items"))
    listed = materialize(listed.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "sets")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")]
    hit = judged.filter("set IS NOT NULL").join(small(listed, shared.BROADCAST_BYTES // WINDOW_BYTES), "set").select(*columns)
    clean = judged.filter("set IS NULL").withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", F.sha2(F.lit(""), 256))
    return hit.unionByName(clean.select(*columns))

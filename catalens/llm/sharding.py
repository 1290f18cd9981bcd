"""Sharding by vector bin packing.

Every group of equal texts is an item with a size vector (bytes, tokens, rows).
Items go, largest first, to the shard where the dot product of the item's
vector and the shard's residual capacity (both as shares of one shard) is
highest. What is packed is bounded, whatever the table's size:

* groups over ``1 / (HEAVY * shards)`` of a total stand for themselves, at most
  ``3 * HEAVY * shards`` of them;
* the rest are hashed into ``PARCELS * shards`` parcels, each an item;
* a group over one shard's share can't stay whole under any even law and is cut,
  by its rows' numbers in the order of their ids, into pieces of about an
  eighth of a share. Two runs over the same rows give the same shards.

The law is ``bytes``: shards are near equal in bytes (and tokens and rows follow).

Defined cases: a null text has no bytes and counts 1, and all null texts are one
group; a null id is allowed; repeated rows are equal texts; ties in a shard are in
the order of id, checksum and size; texts may be of any length; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.shared import materialize, numbered

HEAVY = 64
PARCELS = 256
PIECES = 8


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``sizes``): largest first, to the highest dot product with what is left."""
    total = np.maximum(sizes.sum(0), 1)
    unit = sizes / total * shards
    left = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), int)
    for i in np.argsort(-unit.max(1), kind="stable"):
        out[i] = np.argmax(left @ unit[i])
        left[out[i]] -= unit[i]
    return out


def tokens_of(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            tokens_of(text).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("group"),
        ),
        "sizes",
    )
    at = rows.metadataColumn("_metadata")
    rows = rows.select("*", F.xxhash64(F.lit(5), at["file_path"], at["row_index"]).alias("spot"))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    whole = [max(1, total[k] or 0) for k in ("bytes", "tokens", "rows")]
    groups = rows.groupBy("group").agg(*sums)
    share = F.greatest(*[F.col(k) / F.lit(float(w)) for k, w in zip(("bytes", "tokens", "rows"), whole)]) * shards
    heavy = sorted(groups.filter(share > 1 / HEAVY).collect(), key=lambda r: r["group"])
    item = F.pmod(F.xxhash64(F.lit(3), "group"), F.lit(PARCELS * shards))
    owners = spark.createDataFrame([(r["group"],) for r in heavy], "group long")
    parcels = rows.join(F.broadcast(owners), "group", "left_anti").groupBy(item.alias("parcel")).agg(*sums).orderBy("parcel").collect()
    vector = lambda r: np.array([r["bytes"], r["tokens"], r["rows"]], float)
    items, vectors, pieces = [], [], {}
    for r in heavy:
        over = float((vector(r) / whole).max() * shards)
        pieces[r["group"]] = max(1, min(r["rows"], int(np.ceil(over * PIECES)))) if over > 1 else 1
        if pieces[r["group"]] == 1:
            items.append((r["group"], None, 0))
            vectors.append(vector(r))
    cut = spark.createDataFrame([(g, n) for g, n in pieces.items()], "group long, pieces int")
    rows = rows.join(F.broadcast(cut), "group", "left").withColumn("piece", F.lit(0))
    if any(n > 1 for n in pieces.values()):
        # spot parts rows that are equal in all that is returned, so that none of them is a hot key
        over = numbered(rows.filter("pieces > 1"), ["group", "doc_id", "spot"]).withColumn("piece", F.pmod("idx", "pieces").cast("int")).drop("idx")
        rows = rows.filter("pieces IS NULL OR pieces = 1").unionByName(over)
        # at most 3 x shards groups are over a share, of PIECES pieces a share
        for r in over.groupBy("group", "piece").agg(*sums).orderBy("group", "piece").collect():
            items.append((r["group"], None, r["piece"]))
            vectors.append(vector(r))
    for r in parcels:
        items.append((None, r["parcel"], 0))
        vectors.append(vector(r))
    where = place(np.array(vectors).reshape(-1, 3), shards)
    own = spark.createDataFrame([(g, k, int(s)) for (g, _, k), s in zip(items, where) if g is not None], "group long, piece int, own_shard int")
    shared = spark.createDataFrame([(p, int(s)) for (_, p, _), s in zip(items, where) if p is not None], "parcel long, parcel_shard int")
    placed = (
        rows.withColumn("parcel", item)
        .join(F.broadcast(own), ["group", "piece"], "left")
        .join(F.broadcast(shared), "parcel", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "parcel_shard").alias("shard"))
    )
    order = ["shard", "doc_id", "text_crc32", "size"]
    at = numbered(placed, order)
    counts = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}
    firsts, before = [], 0
    for s in range(shards):
        firsts.append(before)
        before += counts.get(s, 0)
    first = F.array(*[F.lit(x).cast("long") for x in firsts])
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("idx") - first[F.col("shard")]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

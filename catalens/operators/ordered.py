"""Joins and running values in an order, without bringing a key or the whole table to one task.

``within`` joins rows whose times are at most an interval apart by buckets as wide as
the interval; where pairs are only counted, ``counts_within`` makes none. The others sort rows once into written range partitions, which split a hot key
like any other, and carry what stands before a partition to it: one row a partition.

Defined cases: rows of a null key or time meet nothing and are met by nothing; of equal times
the greatest ``tie`` of the right side is the last; equal rows are rows of their own; an empty
side gives no pairs (``within``) or no partners (``as_of``); a null number adds nothing to a running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from catalens import shared
from catalens.shared import materialize, small

#: Rows of a key's bucket from which it is dealt out to several tasks, and bytes of such a bucket's row when broadcast.
HOT, HOT_BYTES = 100_000, 256


def micros(df: DataFrame, name: str) -> Column:
    """A time as microseconds (a number as it is), without regard to the session's time zone."""
    kind = df.schema[name].dataType
    if isinstance(kind, t.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, (t.TimestampNTZType, t.DateType)):
        of_day = "0" if isinstance(kind, t.DateType) else f"hour(`{name}`) * 3600000000L + minute(`{name}`) * 60000000L + cast(extract(SECOND FROM `{name}`) * 1000000 AS long)"
        return F.expr(f"cast(unix_date(cast(`{name}` AS date)) AS long) * 86400000000L + {of_day}")
    return F.col(name).cast("long")


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, width: int, hot: int | None = None) -> DataFrame:
    """Pairs of equal ``keys`` with left_at <= right_at <= left_at + ``width`` (microseconds, or the numbers' unit).

    A left row meets the buckets of its own time and the next one only. Buckets of over
    ``hot`` right rows are dealt to several tasks, and the left rows of such a bucket go to each of them.
    Columns other than ``keys`` must have different names.
    """
    hot = HOT if hot is None else hot
    bucket = lambda at: F.floor(at / width).cast("long") if width > 0 else at
    ours = left.withColumn("_from", micros(left, left_at))
    ours = ours.withColumn("_bucket", F.explode(F.array(*[bucket(F.col("_from")) + i for i in ((0, 1) if width > 0 else (0,))])))
    theirs = right.withColumn("_to", micros(right, right_at)).withColumn("_bucket", bucket(F.col("_to")))
    on = [*keys, "_bucket"]
    full = theirs.groupBy(*on).count().filter(F.col("count") > hot).select(*on, F.ceil(F.col("count") / hot).cast("int").alias("_parts"))
    full = small(materialize(full, "hot"), shared.BROADCAST_BYTES // HOT_BYTES)
    theirs = theirs.join(full, on, "left").withColumn("_salt", F.coalesce(F.floor(F.rand(7) * F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    ours = ours.join(full, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    met = ours.join(theirs, [*on, "_salt"]).filter(F.col("_to").between(F.col("_from"), F.col("_from") + width))
    return met.drop("_bucket", "_salt", "_from", "_to")


def counts_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, width: int, by: Sequence[str], counted: str, count: str = "n", parts: int | None = None) -> DataFrame:
    """(by, count): of the pairs of ``within``, how many with a ``counted`` value of the right side the left rows of equal ``by`` have, without making a pair.

    Left rows of no pair are left out; those of pairs without a value have 0.

    What stands in an interval is the right rows up to its end less those before its start. Both
    ends and the right rows' times are sorted once, and counted over range partitions, so that
    rows of a hot key cost no more than others. The driver holds a row a partition.
    """
    if width < 0:
        raise ValueError("the interval ends before it starts")
    known = lambda df, at: df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, at]))
    key, group = F.struct(*[F.col(k) for k in keys]).alias("_key"), F.struct(*[F.col(c) for c in by])
    start = micros(left, left_at)
    # In a tie, an interval's start comes before the rows of its time, its end behind them.
    edges = F.array(F.struct(start.alias("_at"), F.lit(0).alias("_side"), F.lit(-1).alias("_sign")), F.struct((start + width).alias("_at"), F.lit(2).alias("_side"), F.lit(1).alias("_sign")))
    ours = known(left, left_at).select(key, group.alias("_by"), F.explode(edges).alias("_edge")).select("_key", "_edge._at", "_edge._side", "_edge._sign", "_by", F.expr("named_struct('met', 0L, 'told', 0L)").alias("_here"))
    theirs = known(right, right_at).select(key, micros(right, right_at).alias("_at"), F.col(counted).alias("_counted")).groupBy("_key", "_at").agg(F.struct(F.count("*").alias("met"), F.count("_counted").alias("told")).alias("_here"))
    theirs = theirs.select("_key", "_at", F.lit(1).alias("_side"), F.lit(0).alias("_sign"), F.lit(None).cast(ours.schema["_by"].dataType).alias("_by"), "_here")
    placed = _placed(ours.unionByName(theirs), ["_key", "_at", "_side"], parts)
    carried, met, told = [], 0, 0
    for part, m, n in sorted(map(tuple, placed.groupBy("_part").agg(F.sum("_here.met"), F.sum("_here.told")).collect())):  # one row a partition
        carried.append((part, met, told))
        met, told = met + m, told + n
    table = left.sparkSession.createDataFrame(carried, "_part int, _met long, _told long")
    upto = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.select("_part", "_sign", "_by", F.sum("_here.met").over(upto).alias("_m"), F.sum("_here.told").over(upto).alias("_n")).filter("_sign <> 0").join(F.broadcast(table), "_part")
    sums = [F.sum(F.col("_sign") * (F.col(a) + F.col(b))).alias(b) for a, b in (("_met", "_m"), ("_told", "_n"))]
    return ends.groupBy("_by").agg(*sums).filter("_m > 0").select("_by.*", F.col("_n").alias(count))


def _placed(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """``df`` sorted into written range partitions, with _part, their number in that order, and _place in it.

    Rows of equal order are dealt out at random, so that they don't all come to one.
    """
    spread = [*order, F.rand(11)]
    dealt = df.repartitionByRange(parts, *spread) if parts else df.repartitionByRange(*spread)
    return materialize(dealt.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "ordered")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, tie: str, parts: int | None = None) -> DataFrame:
    """Each row of ``left`` with _met, the last row of ``right`` (a struct) of its keys at or before its time; null if there is none."""
    key = F.struct(*[F.col(k) for k in keys])
    ours = left.select(key.alias("_key"), micros(left, left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct("*").alias("_left"), F.lit(None).cast(right.schema).alias("_right"))
    theirs = right.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, right_at]))
    theirs = theirs.select(key.alias("_key"), micros(right, right_at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(left.schema).alias("_left"), F.struct("*").alias("_right"))
    lost = ours.filter(" OR ".join(["_at IS NULL", *[f"_key.`{k}` IS NULL" for k in keys]])).select("_left.*", F.col("_right").alias("_met"))
    every = _placed(ours.filter(" AND ".join(["_at IS NOT NULL", *[f"_key.`{k}` IS NOT NULL" for k in keys]])).unionByName(theirs), ["_key", "_at", "_side", "_tie"], parts)
    # The last right row of each partition goes to the next ones that have none of their own before them.
    last = every.filter("_side = 0").groupBy("_part").agg(F.max_by(F.struct("_key", "_right"), "_place").alias("_before"))
    tails = [(r["_part"], r["_before"]) for r in last.collect()]  # one row a partition
    carried, tail = [], dict(tails)
    seen = None
    for part in range(max((p for p, _ in tails), default=-1) + 2):
        carried.append((part, seen))
        seen = tail.get(part, seen)
    after = max(len(carried) - 1, 0)
    schema = t.StructType([t.StructField("_from", t.IntegerType()), t.StructField("_before", last.schema["_before"].dataType)])
    table = left.sparkSession.createDataFrame(carried, schema)
    own = F.last(F.when(F.col("_side") == 0, F.struct("_key", "_right")), ignorenulls=True).over(Window.partitionBy("_part").orderBy("_place"))
    met = every.withColumn("_own", own).filter("_side = 1").withColumn("_from", F.least(F.col("_part"), F.lit(after))).join(F.broadcast(table), "_from", "left")
    met = met.withColumn("_found", F.coalesce("_own", "_before"))
    return met.select("_left.*", F.when(F.col("_found._key") == F.col("_key"), F.col("_found._right")).alias("_met")).unionByName(lost)


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str] | None = None, tiles: int | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with row_number, rank, dense_rank, running ``sums`` (name to number's column) and ntile over the whole table in an order.

    As windows without PARTITION BY give them (rows up to the current one), by prefix sums over range partitions. Sums of whole numbers and
    decimals are exact; of doubles, they add up in another order.
    """
    sums = sums or {}
    keyed = df.select(F.struct("*").alias("_row"), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("_key"))
    placed = _placed(keyed, [F.col(f"_key.{n}") for n in keyed.schema["_key"].dataType.names], parts)
    whole = Window.partitionBy("_part").orderBy("_place")
    fresh = (~F.col("_key").eqNullSafe(F.lag("_key").over(whole))) | F.lag("_place").over(whole).isNull()
    told = placed.withColumn("_fresh", fresh.cast("long")).withColumn("_n", F.row_number().over(whole).cast("long"))
    told = materialize(told.withColumn("_dense", F.sum("_fresh").over(whole)).withColumn("_start", F.max(F.when(F.col("_fresh") == 1, F.col("_n"))).over(whole)).select(
        "*", *[F.sum(F.coalesce(F.col(f"_row.{c}"), F.lit(0))).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_sum{i}") for i, c in enumerate(sums.values())]
    ), "told")
    totals = told.groupBy("_part").agg(
        F.max("_n").alias("n"), F.max("_dense").alias("dense"), F.max("_start").alias("start"), F.min_by("_key", "_place").alias("low"), F.max_by("_key", "_place").alias("high"), *[F.max_by(f"_sum{i}", "_place").alias(f"s{i}") for i in range(len(sums))]
    ).orderBy("_part").collect()  # one row a partition
    carried, n, dense, start, high = [], 0, 0, 0, None
    add = [None] * len(sums)  # nothing before the first partition
    for r in totals:
        joined = n > 0 and str(r["low"]) == str(high)  # NaN equals itself here; the first rows go on with the ties of the partition before
        carried.append((r["_part"], n, dense - joined, start if joined else 0, *add))
        start = start if joined and r["dense"] == 1 else n + r["start"]
        n, dense, high = n + r["n"], dense - joined + r["dense"], r["high"]
        add = [r[f"s{i}"] if a is None else a + r[f"s{i}"] for i, a in enumerate(add)]
    kinds = [t.StructField(f"_add{i}", told.schema[f"_sum{i}"].dataType) for i in range(len(sums))]
    schema = t.StructType([t.StructField("_part", t.IntegerType()), *[t.StructField(c, t.LongType()) for c in ("_before", "_dense0", "_tied")], *kinds])
    both = told.join(F.broadcast(df.sparkSession.createDataFrame(carried, schema)), "_part")
    at = F.col("_before") + F.col("_n")
    # Of rows that are tied with those before their partition, the rank is the first one's.
    rank = F.when((F.col("_tied") > 0) & (F.col("_dense") == 1), F.col("_tied")).otherwise(F.col("_before") + F.col("_start"))
    out = [F.col("_row.*"), at.alias("row_number"), rank.alias("rank"), (F.col("_dense0") + F.col("_dense")).alias("dense_rank")]
    out += [(F.col(f"_sum{i}") + F.coalesce(F.col(f"_add{i}"), F.lit(0))).alias(name) for i, name in enumerate(sums)]
    if tiles:
        size, more = divmod(n, tiles)
        k, large = at - 1, more * (size + 1)
        tile = F.when(k < large, F.floor(k / (size + 1))).otherwise(more + F.floor((k - large) / max(size, 1)))
        out.append((tile + 1).cast("long").alias("ntile"))
    return both.select(*out)


def peer_frames(df: DataFrame, order: Sequence[str], preceding: int, following: int, sums: dict[str, str], count: str = "n", parts: int | None = None) -> DataFrame:
    """``df`` with ``count`` and ``sums`` (name to number's column) over GROUPS BETWEEN preceding AND following, without PARTITION BY.

    Rows of equal order columns are one group, made before anything is dealt out; groups are numbered over range partitions, and a frame is
    the difference of two running sums, so its width costs nothing. Negative bounds are allowed (``preceding=3, following=-1``: up to the group
    before). Sums of whole numbers and decimals are exact. Rows of a null in the order are a group; a frame
    without rows has count 0, one without numbers a null sum. Groups of ``HOT`` rows or more meet their frame by broadcast, so no group is one task's.
    """
    if preceding + following < 0:
        raise ValueError("the frame ends before it starts")
    keyed = df.select(F.struct("*").alias("_row"), F.struct(*[F.col(o) for o in order]).alias("_key"))
    own = {"_c": F.count("*")}
    for i, c in enumerate(sums.values()):
        own |= {f"_s{i}": F.sum(f"_row.{c}"), f"_k{i}": F.count(f"_row.{c}")}
    peers = keyed.groupBy("_key").agg(*[v.alias(f"{k}_own") for k, v in own.items()])
    ran = running(peers, ["_key"], {k: f"{k}_own" for k in own}, parts=parts)
    ran = materialize(ran.select("_key", F.col("_c_own").alias("_rows"), F.col("row_number").alias("_n"), F.struct(*own).alias("_upto")), "peers")
    last = F.lit(ran.agg(F.max("_n")).first()[0] or 0)
    ends = ran.select("_key", "_rows", F.least(F.col("_n") + following, last).alias("_high"), F.least(F.col("_n") - preceding - 1, last).alias("_low"))
    ends = ends.join(ran.select(F.col("_n").alias("_high"), F.col("_upto").alias("_to")), "_high", "left").join(ran.select(F.col("_n").alias("_low"), F.col("_upto").alias("_from")), "_low", "left")
    between = {k: F.coalesce(f"_to.{k}", F.lit(0)) - F.coalesce(f"_from.{k}", F.lit(0)) for k in own}
    values = [between["_c"].alias(count), *[F.when(between[f"_k{i}"] > 0, between[f"_s{i}"]).alias(name) for i, name in enumerate(sums)]]
    frames = materialize(ends.select("_key", "_rows", F.struct(*values).alias("_frame")), "frames")
    match = F.col("a._key").eqNullSafe(F.col("b._key"))
    hot = small(materialize(frames.filter(F.col("_rows") >= HOT), "hot"), shared.BROADCAST_BYTES // HOT_BYTES)
    few = keyed.alias("a").join(hot.alias("b"), match, "left_anti").alias("a").join(frames.filter(F.col("_rows") < HOT).alias("b"), match)
    many = keyed.alias("a").join(hot.alias("b"), match)
    return few.select("_row.*", "_frame.*").unionByName(many.select("_row.*", "_frame.*"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], parts: int | None = None) -> DataFrame:
    """(keys, p0, p1, ..): exact percentiles with linear interpolation of the numbers of each group.

    No group's values are held: rows are sorted once by group and value, and each share's two
    neighbours are found by their number, which is what stands before their partition and their place in it.
    Null values don't count; a group without others has nulls; a null key is a group of its own.
    """
    key = F.struct(*[F.col(k) for k in keys])
    rows = df.select(key.alias("_key"), F.col(value).cast("double").alias("_v"))
    groups = rows.groupBy("_key").agg(F.count("_v").alias("_n"))
    placed = _placed(rows.filter("_v IS NOT NULL"), ["_key", "_v"], parts)
    # A row a group and partition: a hot group has as many as there are partitions.
    own = placed.groupBy("_key", "_part").agg(F.count("*").alias("_here"), F.min("_place").alias("_first"))
    before = F.sum("_here").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_before", F.coalesce(before, F.lit(0))).join(groups, "_key")
    wanted = own.select("_key", "_part", "_first", "_before", "_here", F.posexplode(F.array(*[F.lit(float(s)) * (F.col("_n") - 1) for s in shares])).alias("_p", "_at"))
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_number")).filter("_number >= _before AND _number < _before + _here")
    wanted = wanted.select("_part", (F.col("_first") + F.col("_number") - F.col("_before")).alias("_place"), "_p", "_at", "_number")
    found = placed.join(wanted, ["_part", "_place"])
    near = found.groupBy("_key", "_p").agg(F.min_by("_v", "_number").alias("_low"), F.max_by("_v", "_number").alias("_high"), F.first(F.col("_at") - F.floor("_at")).alias("_rest"))
    told = near.withColumn("_x", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_rest"))
    told = told.groupBy("_key").agg(*[F.max(F.when(F.col("_p") == i, F.col("_x"))).alias(f"p{i}") for i in range(len(shares))])
    match = F.col("a._key").eqNullSafe(F.col("b._key"))
    return groups.alias("a").join(told.alias("b"), match, "left").select("a._key.*", *[f"p{i}" for i in range(len(shares))])

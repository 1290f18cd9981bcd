"""Close names for what didn't resolve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.functions import text as T
from catalens.shared import materialize, numbered

THRESHOLD, MOST = 0.6, 5
#: Edits of the rounds before the last, and identifiers up to which one round is enough.
ROUNDS, FEW = (1, 3), 32
SLACK = 1e-9
#: Names of one start up to which they are compared themselves, and rows of a key and side that meet in one task.
ALIKE, DEALT = 16, 1024
#: Stands for a character that an identifier hasn't; one that has it is compared with whole names.
OTHER = "\u0001"


def edits(longest: Column | str, threshold: float) -> Column:
    """The most edits that two names of this longer length may be apart."""
    return F.floor((F.expr(longest) if isinstance(longest, str) else longest) * F.lit(1 - threshold) + F.lit(SLACK)).cast("int")


def _cut(names: DataFrame, within: int, threshold: float) -> DataFrame:
    """Of a length _len: _e, the most edits of names of that length in a round, and _m, the number of their pieces.

    Pieces have about two characters, and there is at least one more than edits; _m is 0 where
    a name is too short for that.
    """
    cut = names.withColumn("_e", F.least(F.lit(within), edits(f"_len + {within}", threshold)))
    return cut.withColumn("_m", F.when(F.col("_len") <= F.col("_e"), 0).otherwise(F.greatest(F.col("_e") + 1, F.ceil(F.col("_len") / 2).cast("int"))))


_BEGIN, _WIDTH = "cast(floor(_i * _len / _m) AS int)", "cast(floor((_i + 1) * _len / _m) - floor(_i * _len / _m) AS int)"
_PIECES = "explode(IF(_m = 0, array(-1), sequence(0, _m - 1)))"


def segments(known: DataFrame, within: int, threshold: float) -> DataFrame:
    """(_len, _i, _piece, _b): of every name its rarest pieces, one more than edits that it may have.

    So many edits leave at least one of any so many pieces as it is; the rarest prune most.
    """
    cut = _cut(known.select("_b", F.length("_b").alias("_len")), within, threshold).withColumn("_i", F.expr(_PIECES))
    pieces = cut.select("_b", "_len", "_e", "_i", F.expr(f"IF(_i < 0, '', substring(_b, {_BEGIN} + 1, {_WIDTH}))").alias("_piece"))
    often = pieces.groupBy("_len", "_i", "_piece").agg(F.count("*").alias("_n"))
    ordered = pieces.join(often, ["_len", "_i", "_piece"]).groupBy("_b", "_len", "_e").agg(F.array_sort(F.collect_list(F.struct("_n", "_i", "_piece"))).alias("_all"))
    return ordered.select("_b", "_len", F.explode(F.expr("slice(_all, 1, _e + 1)")).alias("_x")).select("_len", "_x._i", "_x._piece", "_b")


def probes(wanted: DataFrame, within: int, threshold: float) -> DataFrame:
    """(_a, _len, _i, _piece): what of a name may be a piece of a name of each length, at the places that the edits allow.

    A piece that is moved by s has at least |s| edits before it, and as many behind it
    as the rest of the difference of lengths.
    """
    least, most = f"greatest(_n - {within}, cast(ceil(_n * {threshold} - {SLACK}) AS int))", f"least(_n + {within}, cast(floor(_n / {threshold} + {SLACK}) AS int))"
    lengths = wanted.select("_a", "_n").distinct().withColumn("_len", F.explode(F.expr(f"IF(_n = 0, array(0), sequence({least}, {most}))")))
    cut = _cut(lengths, within, threshold).withColumn("_own", F.least(F.lit(within), edits(F.greatest("_n", "_len"), threshold))).withColumn("_i", F.expr(_PIECES))
    moved = cut.withColumn("_s", F.explode(F.expr("IF(_i < 0, array(0), filter(sequence(-_own, _own), s -> abs(s) + abs(_n - _len - s) <= _own))")))
    placed = moved.filter(f"_i < 0 OR ({_BEGIN} + _s >= 0 AND {_BEGIN} + _s + {_WIDTH} <= _n)")
    return placed.select("_a", "_len", "_i", F.expr(f"IF(_i < 0, '', substring(_a, {_BEGIN} + _s + 1, {_WIDTH}))").alias("_piece"))


def _without(c: str, i: Column | str) -> Column:
    i = F.col(i) if isinstance(i, str) else i
    return F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))


def one_edit(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(_a, _b): all pairs of ``wanted`` (_a) and ``known`` (_b), each distinct, of at most one edit.

    Such names are equal, or one is the other without a character, or both are equal without the
    character at one place. So they share a key of (deletions of the shorter's side, place, rest);
    those that share one are as many as there are letters for a place, however many names there are.
    """
    lengths = lambda names, c: names.select(F.length(c).alias("_l")).distinct()

    def shorter(names: DataFrame, c: str) -> DataFrame:
        """_rest: each name without one of its characters, _i."""
        return names.withColumn("_i", F.explode(F.expr(f"sequence(1, length({c}))"))).select(c, "_i", _without(c, "_i").alias("_rest"))

    def rests(names: DataFrame, c: str) -> DataFrame:
        """As ``shorter``, but for places that make no difference."""
        return names.select(c, F.explode(F.array_distinct(F.transform(F.expr(f"sequence(1, length({c}))"), lambda i: _without(c, i)))).alias("_rest"))

    def of(names: DataFrame, c: str, others: DataFrame, more: int) -> DataFrame:
        """Those with a length that is so much more than one of the others."""
        return names.join(F.broadcast(others.select((F.col("_l") + more).alias("_l"))), F.length(c) == F.col("_l"), "left_semi")

    ours, theirs = lengths(wanted, "_a"), lengths(known, "_b")
    equal = wanted.join(known, F.col("_a") == F.col("_b"))
    added = wanted.join(rests(of(known, "_b", ours, 1), "_b"), F.col("_a") == F.col("_rest")).select("_a", "_b")
    taken = known.join(rests(of(wanted, "_a", theirs, 1), "_a"), F.col("_b") == F.col("_rest")).select("_a", "_b")
    other = shorter(of(wanted, "_a", theirs, 0).filter("_a <> ''"), "_a").join(shorter(of(known, "_b", ours, 0).filter("_b <> ''"), "_b"), ["_i", "_rest"])
    return reduce(DataFrame.unionByName, [equal, added, taken, other.filter("_a <> _b").select("_a", "_b")])


def _round(wanted: DataFrame, known: DataFrame, within: int, threshold: float, most: int) -> DataFrame:
    """The closest names of ``wanted`` (identifier, _a, _n, _k), all those within so many edits considered, and whether _more could come."""
    if within <= 1:
        met = one_edit(wanted.select("_a").distinct(), known.select("_b").distinct())
    else:
        met = probes(wanted, within, threshold).join(segments(known.select("_b").distinct(), within, threshold), ["_len", "_i", "_piece"]).select("_a", "_b").distinct()
    longest = F.greatest(F.length("_a"), F.length("_b"))
    met = met.withColumn("_most", F.least(F.lit(within), edits(longest, threshold))).withColumn("_apart", F.expr("levenshtein(_a, _b, _most)")).filter("_apart >= 0")
    met = met.withColumn("similarity", F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("_apart") / longest)).filter(F.col("similarity") >= threshold)
    best = wanted.join(met, "_a").join(known, "_b").groupBy("identifier", "_n", "_k", "candidate").agg(F.max("similarity").alias("similarity"))
    at = F.row_number().over(Window.partitionBy("identifier").orderBy(F.desc("similarity"), F.asc("candidate")))
    best = best.withColumn("rank", at).filter(F.col("rank") <= most)
    # A name of one more edit is at best that much longer.
    reach = F.lit(1.0) - F.lit(within + 1) / (F.col("_n") + F.lit(within + 1))
    return best.withColumn("_done", (F.col("rank") == most) & (F.col("similarity") > reach + SLACK))


def rank(asked: DataFrame, names: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """(identifier, candidate, similarity, rank): the closest of ``names`` (candidate, local) to each identifier.

    Names of one edit meet by their deletions, others by a segment index: a name is cut into pieces, of
    which some are left whole and nearly in place by a bounded number of edits. What the threshold allows is many edits for long
    names, so the first rounds look for few; an identifier whose last place is closer than any name
    of more edits can be is done. The last round takes the edits that the threshold allows.
    """
    wanted = asked.select("identifier").distinct().withColumn("_a", F.lower(T.local_name(F.col("identifier")))).withColumn("_n", F.length("_a"))
    wanted = wanted.withColumn("_k", edits(F.floor(F.col("_n") / F.lit(threshold) + F.lit(SLACK)), threshold)).filter("_a IS NOT NULL")
    known = names.select("candidate", F.lower("local").alias("_b")).filter("_b IS NOT NULL").distinct()
    first = F.row_number().over(Window.partitionBy("_b").orderBy("candidate"))
    known = known.withColumn("_at", first).filter(F.col("_at") <= most).drop("_at")  # names alike are as close: the first ones go before
    n, deepest = wanted.agg(F.count("*"), F.max("_k")).first()
    rounds = [*(r for r in ROUNDS if n > FEW and 2 * r < deepest), deepest or 0]
    done = []
    for within in rounds[:-1]:
        found = materialize(_round(wanted, known, within, threshold, most), "close")
        ready = found.filter("_done").select("identifier")
        done.append(found.join(ready, "identifier", "left_semi"))
        wanted = materialize(wanted.join(ready, "identifier", "left_anti"), "wanted")
        if wanted.isEmpty():
            break
    else:
        done.append(_round(wanted, known, rounds[-1], threshold, most))
    return reduce(DataFrame.unionByName, done).select("identifier", "candidate", F.round("similarity", 4).alias("similarity"), "rank")


def _open(level: int, threshold: float) -> Column:
    """How many last characters of a name of _len are left open: none at level 0, then 1, doubled up to the edits allowed and on to all."""
    if level == 0:
        return F.lit(0)
    e = F.greatest(edits("_len", threshold), F.lit(1)).cast("long")
    return F.least("_len", F.call_function("shiftright", F.shiftleft(e, level), F.length(F.bin(e)))).cast("int")


def _levels(known: DataFrame, threshold: float) -> int:
    """The first level at which names of all lengths are left open as a whole."""
    e = F.greatest(edits("_len", threshold), F.lit(1)).cast("long")
    return known.agg(F.max(F.length(F.bin(e)) + F.ceil(F.log2(F.greatest("_len", F.lit(1)) / e)))).first()[0] or 1


def _dealt(wanted: DataFrame, starts: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which both sides of a key of many rows are dealt to several tasks."""
    parts = lambda rows, n: rows.groupBy(*on).agg(F.ceil(F.count("*") / DEALT).alias(n))
    cells = parts(wanted, "_rows").join(parts(starts, "_columns"), on)
    ours = wanted.join(cells, on).withColumn("_row", F.expr("pmod(xxhash64(_a), _rows)")).withColumn("_column", F.expr("explode(sequence(0L, _columns - 1))"))
    theirs = starts.join(cells, on).withColumn("_column", F.expr("pmod(xxhash64(_start), _columns)")).withColumn("_row", F.expr("explode(sequence(0L, _rows - 1))"))
    cell = [*on, "_row", "_column"]
    # By number, as few bytes of long work would be put into one task.
    ours = ours.repartition(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)
    return ours.drop("_rows", "_columns").join(theirs.drop("_rows", "_columns"), cell).drop("_row", "_column")


def links(asked: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(identifier, from_name, to_name, names): all of ``names`` (candidate, local) that are close to each identifier.

    Names stand by length, then by letters. Those that follow each other and are all close make one row, of the
    first, the last and how many rows of ``names`` they are. Names alike but for case have one place and
    are told by their first candidate. An identifier that nothing is close to has no row.

    Names of a length and a start are judged at once: with a character that the identifier hasn't for each of
    the rest, the start is as far from it as any such name can be, and none is nearer than that less the
    rest. So all are close, or none is, or longer starts are looked at; the names of a start of few
    are compared themselves. So every name counts for every identifier, but most pairs are never made.
    """
    wanted = asked.select("identifier").distinct().withColumn("_a", F.lower(T.local_name(F.col("identifier")))).filter("_a IS NOT NULL")
    known = names.select("candidate", F.lower("local").alias("_b")).filter("_b IS NOT NULL").groupBy("_b").agg(F.min("candidate").alias("candidate"), F.count("*").alias("_names"))
    known = numbered(known.withColumn("_len", F.length("_b")), ["_len", "_b"], "_place").select("_b", "_len", F.struct("_place", "candidate").alias("_low"), "_names")
    known = materialize(known, "known")
    within = edits(F.greatest(F.length("_a"), "_len"), threshold)
    lengths = F.broadcast(known.select("_len").distinct())
    pairs = wanted.select("_a").distinct().join(lengths, F.abs(F.length("_a") - F.col("_len")) <= within).select("_a", "_len", within.alias("_k"), F.lit("").alias("_above"))
    pairs, run = materialize(pairs, "pairs"), ["_a", "_low", "_high", "_names"]
    found = []
    for level in reversed(range(_levels(known, threshold))):
        begin = lambda level: F.substring("_b", F.lit(1), F.col("_len") - _open(level, threshold))
        here = known.select("*", begin(level + 1).alias("_above"), begin(level).alias("_start")).join(pairs.select("_len", "_above").distinct(), ["_len", "_above"], "left_semi")
        starts = here.groupBy("_len", "_above", "_start").agg(F.min("_low").alias("_low"), F.max("_low").alias("_high"), F.sum("_names").alias("_names"), F.count("*").alias("_alike"))
        starts = materialize(starts.filter(F.col("_alike") > ALIKE), "starts")
        few = materialize(here.join(starts.select("_len", "_start"), ["_len", "_start"], "left_anti").withColumn("_high", F.col("_low")), "few")
        if not few.isEmpty():
            found.append(_dealt(pairs, few, ["_len", "_above"]).filter("levenshtein(_a, _b, _k) >= 0").select(*run))
        rest = _open(level, threshold)
        far = F.levenshtein("_a", F.concat("_start", F.repeat(F.lit(OTHER), rest)))
        met = _dealt(pairs, starts, ["_len", "_above"]).withColumn("_far", far).filter(F.col("_far") <= F.col("_k") + rest)
        met = materialize(met.select(*run, "_len", "_k", "_start", ((F.col("_far") <= F.col("_k")) & (F.instr("_a", OTHER) == 0)).alias("_all")), "met")
        found.append(met.filter("_all").select(*run))
        pairs = met.filter("NOT _all").select("_a", "_len", "_k", F.col("_start").alias("_above"))
        if pairs.isEmpty():
            break
    order = Window.partitionBy("_a").orderBy("_low")
    begun = F.coalesce(F.col("_low._place") > F.lag("_high._place").over(order) + 1, F.lit(True))
    runs = reduce(DataFrame.unionByName, found).withColumn("_begun", begun).withColumn("_run", F.sum(F.col("_begun").cast("int")).over(order))
    runs = runs.groupBy("_a", "_run").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_names").alias("names"))
    return wanted.join(runs, "_a").select("identifier", F.col("_low.candidate").alias("from_name"), F.col("_high.candidate").alias("to_name"), "names")


def column_names(columns: DataFrame) -> DataFrame:
    return columns.select(F.concat_ws(".", "schema", "table", "name").alias("candidate"), F.col("name").alias("local"))


def table_names(tables: DataFrame, views: DataFrame) -> DataFrame:
    """Tables, views and schema names."""
    both = tables.select("schema", "name").unionByName(views.select("schema", "name"))
    named = both.select(F.concat_ws(".", "schema", "name").alias("candidate"), F.col("name").alias("local"))
    return named.unionByName(both.select(F.col("schema").alias("candidate"), F.col("schema").alias("local")).distinct())


def names_of_views(spark: SparkSession, views: list[str]) -> tuple[DataFrame, DataFrame]:
    """(columns, tables) to suggest from, of the views of a session."""
    columns = [(f"{v}.{c}", c) for v in views for c in spark.table(v).columns]
    schema = "candidate string, local string"
    return spark.createDataFrame(columns, schema), spark.createDataFrame([(v, v) for v in views], schema)

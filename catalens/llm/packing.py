"""Hierarchical multi-length packing of token sequences.

A document is cut into full windows of ``window`` tokens and one rest. Rests are
routed to context tiers, powers of two: tier t takes rests over t/2 and up to t
tokens. Each tier is packed into windows of t tokens, largest rest first; the
gap of a window is filled from shorter rests, best fit first, and what no whole
rest fills is cut from the longest shorter one (or, where there is none, from
any), so that windows end exactly full. The last few windows may stay open.
Windows are gathered into step groups of equal token counts.

Rests of one length are alike, so the plan is made on the bounded histogram of
rest lengths: it moves *lots* (a length and a range of ranks), never documents.
A document finds its place by its rank among the rests of its length, a range
sort that splits a hot length among tasks.

Defined cases: a null text is empty and holds the end id only; repeated rows are
packed each for itself; an empty table gives an empty result; extra columns are
ignored; a text of any length is cut as often as needed.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import ship, slices
from catalens.shared import materialize, numbered

WINDOW = 2048
SMALLEST = 256
STEP_WINDOWS = 8
END_ID = 1
CACHE_WORDS = 600_000
NEW = object()
#: Bytes of texts that are encoded at once, or one text.
TEXT_BYTES = 4 << 20
PROBES = ["One two, Three  four's it's we'll 12 345 a1b2", "  leading and\n\ttrailing \r\n", "naïve Ünïcode ÉTÉ straße “quoted” – dash… 10€", "a.b;c!?(d)[e]{f}<g>@#$%^&*_+=~`|\\/", "snake_case CamelCase x==y 3.14 don't I'd you've they're I'm", ""]
#: Steps whose outcome for a plain lower-case word is known: the word, by the characters of its bytes.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_CUT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


# --- Token ids -------------------------------------------------------------


def plain_characters() -> tuple[frozenset[int], str]:
    """Code points that NFC and lower-casing treat one by one, and a pattern that cuts text of them into words."""
    ok = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x2122, 0xFFFD]
    ok = [c for c in ok if unicodedata.normalize("NFC", chr(c)) == chr(c) and c != 0x130]
    ok = [c for c in ok if ord(chr(c).lower()) in ok]  # the pattern has no letter beyond
    space = {*range(9, 14), 0x20, 0x85, 0xA0}
    letters = "".join(map(chr, (c for c in ok if unicodedata.category(chr(c))[0] == "L")))
    digits = "".join(map(chr, (c for c in ok if unicodedata.category(chr(c))[0] == "N")))
    spaces = "".join(map(chr, sorted(space)))
    quote = lambda s: "".join(f"\\u{ord(c):04x}" for c in s)
    letters, digits, spaces = quote(letters), quote(digits), quote(spaces)
    pattern = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+"
    return frozenset(ok), pattern


class Encoder:
    """Token ids of whole texts as little-endian bytes; runs between blanks, and their words, are looked up in bounded caches.

    Arrow cuts texts into runs and numbers the distinct ones, so that Python sees a run
    once for all texts of a call. Words never cross a blank.

    Texts with characters outside ``plain_characters``, or with the string of an added
    token, are given to the tokenizer whole; so are all texts of a tokenizer that cuts
    words otherwise, or doesn't fold case, which ``PROBES`` tell, or has an added token
    with a blank.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        plain, pattern = plain_characters()
        self.words = re.compile(pattern).findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[^" + "".join(f"\\u{c:04x}" for c in sorted(plain)) + "]", *map(re.escape, added)])).search
        # The bytes' characters, where all steps before the model but that one leave a plain lower-case word as it is.
        spec = json.loads(self.tokenizer.to_str())
        known = (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        moved = sorted({*range(256)} - {*map(ord, alphabet)})
        self.units = dict(zip(moved, alphabet[-len(moved) :])) if known else None
        self.end = np.array([end_id], self.kind).tobytes()
        self.cache: dict[str, bytes] = {}
        self.runs: dict[str, bytes | None] = {}  # None: not plain
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_words = True
        self.by_words = not any(len(t.split()) > 1 for t in added) and self.encode(PROBES) == [raw + self.end for raw in self.whole(PROBES)]
        self.cache.clear()
        self.runs.clear()

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by the model alone where it can be; else many words are encoded as one text and cut where words end."""
        out: list[bytes] = []
        if self.units:
            tokens, units = self.tokenizer.model.tokenize, self.units
            ids: list[int] = []
            ends = []
            for w in words:
                ids += [t.id for t in tokens(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(units))]
                ends.append(len(ids) * self.width)
            raw = np.array(ids, self.kind).tobytes()
            return [raw[a:b] for a, b in zip([0, *ends], ends)]
        groups = [words[i : i + 512] for i in range(0, len(words), 512)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
            if len(ends) != len(group):
                out += self.whole(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def of_runs(self, runs: list[str]) -> list[bytes | None]:
        """Ids of each of the distinct ``runs``, None of one that is not plain."""
        known, cache = self.runs, self.cache
        for kept in (known, cache):
            if len(kept) > CACHE_WORDS:
                kept.clear()
        found = list(map(known.get, runs, repeat(NEW)))
        at = [i for i, ids in enumerate(found) if ids is NEW]
        new = [runs[i] for i in at]
        cut = [r.lower() if self.units and r.isascii() and r.isalpha() else None if self.odd(r) else self.words(r.lower()) for r in new]
        words: set[str] = set()
        for w in cut:
            if w:
                words.add(w) if isinstance(w, str) else words.update(w)
        unknown = [w for w in words if w not in cache]
        cache.update(zip(unknown, self.each(unknown)))
        get = cache.__getitem__
        for i, run, w in zip(at, new, cut):
            found[i] = known[run] = None if w is None else get(w) if isinstance(w, str) else b"".join(map(get, w))
        return found

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text, then the end id."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([t and t.encode("utf-8", "replace").decode() for t in texts], pa.large_string())
        if not self.by_words:
            return [raw + self.end for raw in self.whole([t or "" for t in texts.to_pylist()])]
        lists = pc.ascii_split_whitespace(texts)
        runs = lists.flatten().dictionary_encode()
        of = runs.indices.to_numpy()
        found = self.of_runs(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        last = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        whole: dict[int, bytes] = {}
        if None in found:
            odd = np.flatnonzero(np.array([f is None for f in found])[of])
            rows = np.unique(np.searchsorted(last, odd, "right")).tolist()
            whole = dict(zip(rows, self.whole([texts[i].as_py() for i in rows])))
            found = [f or b"" for f in found]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        n = sizes[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(sizes) - sizes)[of] - ends[:-1], n)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(found), self.kind)[at].tobytes()
        cuts = (ends[np.concatenate([[0], last])] * self.width).tolist()
        return [(whole[i] if i in whole else raw[a:b]) + self.end for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    kept = sys.__dict__.setdefault("_catalens_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# --- The plan --------------------------------------------------------------


@dataclass
class Lot:
    """``count`` parts: of rests of ``length`` with ranks from ``rank``, what lies from ``start`` on."""

    length: int
    rank: int
    count: int
    start: int


class Plan:
    """Where every rest goes, made on the histogram of rest lengths."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, smallest: int = SMALLEST):
        self.window, self.smallest = window, smallest
        self.lots: dict[int, deque[Lot]] = defaultdict(deque)
        self.left: dict[int, int] = defaultdict(int)
        self.sizes: list[int] = []
        self.moves: list[tuple[int, ...]] = []
        self.next = 0
        self.tokens = 0
        for length, n in histogram.items():
            self.put(length, Lot(length, 0, n, 0))
        tiers = []
        t = window
        while t > smallest:
            tiers.append((t, t // 2))
            t //= 2
        for tier, least in [*tiers, (smallest, 0)]:
            self.pack(tier, least)

    def put(self, length: int, lot: Lot) -> None:
        if not self.left[length]:
            insort(self.sizes, length)
        self.left[length] += lot.count
        self.lots[length].append(lot)

    def take(self, length: int, count: int) -> list[Lot]:
        out = []
        self.left[length] -= count
        if not self.left[length]:
            self.sizes.remove(length)
        while count:
            lot = self.lots[length][0]
            n = min(count, lot.count)
            out.append(Lot(lot.length, lot.rank, n, lot.start))
            lot.rank += n
            lot.count -= n
            if not lot.count:
                self.lots[length].popleft()
            count -= n
        return out

    def largest(self, most: int, used: dict[int, int]) -> int:
        """The largest length up to ``most`` of which more than ``used`` are left, or 0."""
        i = bisect_right(self.sizes, most) - 1
        while i >= 0 and self.left[self.sizes[i]] <= used.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def pack(self, tier: int, least: int) -> None:
        while (first := self.largest(tier, {})) > least:
            used, parts, gap = {first: 1}, [(first, first, 1)], tier - first
            while gap:
                if whole := self.largest(gap, used):
                    n = min(gap // whole, self.left[whole] - used.get(whole, 0))
                    used[whole] = used.get(whole, 0) + n
                    parts.append((whole, whole, n))
                    gap -= whole * n
                    continue
                long = self.largest(tier // 2, used) or self.largest(tier, used)
                if not long:
                    break
                used[long] = used.get(long, 0) + 1
                parts.append((long, gap, 1))
                gap = 0
            self.fill(tier, parts, min(self.left[k] // n for k, n in used.items()))

    def fill(self, tier: int, parts: list[tuple[int, int, int]], times: int) -> None:
        """Make ``times`` windows of ``parts``: (length taken from, tokens of it used, how many)."""
        offset, back = 0, []
        for length, use, n in parts:
            for _ in range(n):
                at = self.next
                for lot in self.take(length, times):
                    self.moves.append((lot.length, lot.rank, lot.count, lot.start, use, at, offset, tier, self.tokens + (at - self.next) * tier))
                    at += lot.count
                    if use < length:
                        back.append((length - use, Lot(lot.length, lot.rank, lot.count, lot.start + use)))
                offset += use
        for length, lot in back:
            self.put(length, lot)
        self.next += times
        self.tokens += times * tier


# --- The operator ----------------------------------------------------------


def portions(batches: Iterable[pa.RecordBatch], most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each part have at most ``most`` bytes, or are one."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right"))
            yield b.slice(at, max(end - at, 1))
            at = max(end, at + 1)


def tokenized(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """row, doc_id, doc_tokens, the checksums of full windows and of the rest, and the rest's ids."""

    def encode(batches):
        enc = encoder(path)
        for b in portions(batches):
            rests, sums, ends, counts = [], [], [], []
            for raw in enc.encode(b.column("text")):
                ids = np.frombuffer(raw, enc.kind)
                cut = len(ids) // window * window
                wide = ids.astype("<u4").tobytes()
                sums.append([zlib.crc32(wide[4 * i : 4 * (i + window)]) for i in range(0, cut, window)])
                ends.append(zlib.crc32(wide[4 * cut :]))
                rests.append(raw[enc.width * cut :])
                counts.append(len(ids))
            cols = [b.column("row"), b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(ends, pa.int64()), pa.array(rests, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "doc_tokens", "sums", "rest_sum", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "row long, doc_id long, doc_tokens long, sums array<long>, rest_sum long, rest binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, smallest: int = SMALLEST) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    spark = docs.sparkSession
    tok = materialize(tokenized(docs, tokenizer, window), "tokens")
    lengths = tok.select("row", "doc_tokens", (F.col("doc_tokens") % window).cast("int").alias("rest_tokens"))
    ranked = numbered(lengths.filter("rest_tokens > 0").select("row", "rest_tokens"), ["rest_tokens", "row"])
    counts = {r[0]: (r[1], r[2]) for r in ranked.groupBy("rest_tokens").agg(F.min("idx"), F.count("*")).collect()}
    plan = Plan({k: n for k, (_, n) in counts.items()}, window, smallest)
    first = spark.createDataFrame([(k, a) for k, (a, _) in counts.items()] or [(0, 0)], "rest_tokens int, base long")
    moves = spark.createDataFrame(plan.moves or [(0,) * 9], "of int, from_rank long, n long, rel int, length int, at long, offset long, tier int, before long")
    spots = (
        ranked.join(F.broadcast(first), "rest_tokens").withColumn("rank", F.col("idx") - F.col("base"))
        .join(F.broadcast(moves), (F.col("of") == F.col("rest_tokens")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n")))
        .withColumn("nth", F.col("rank") - F.col("from_rank"))
        .select("row", "rel", "length", (F.col("at") + F.col("nth")).alias("sequence_id"), "offset", "tier", F.floor((F.col("before") + F.col("nth") * F.col("tier")) / F.lit(STEP_WINDOWS * window)).alias("step_group"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rel", "length", "sequence_id", "offset", "tier", "step_group"))).alias("spots"))
    )
    width = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"

    def sums(batches):
        for b in slices(batches):
            out = []
            for row, rest, total, spots_ in zip(b.column("row").to_pylist(), b.column("rest").to_pylist(), b.column("rest_sum").to_pylist(), b.column("spots").to_pylist()):
                if len(spots_) == 1:
                    out.append([total])
                    continue
                ids = np.frombuffer(rest, width).astype("<u4").tobytes()
                out.append([zlib.crc32(ids[4 * s["rel"] : 4 * (s["rel"] + s["length"])]) for s in spots_])
            cols = [b.column("row"), b.column("doc_id"), b.column("doc_tokens"), b.column("spots"), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "doc_tokens", "spots", "crcs"])

    spot = "array<struct<rel:int,length:int,sequence_id:bigint,offset:bigint,tier:int,step_group:bigint>>"
    rests = (
        tok.select("row", "doc_id", "doc_tokens", "rest_sum", "rest").join(spots.hint("merge"), "row")
        .mapInArrow(sums, f"row long, doc_id long, doc_tokens long, spots {spot}, crcs array<long>")
        .select("doc_id", "doc_tokens", F.explode(F.arrays_zip("spots", "crcs")).alias("p"))
        .select(
            "doc_id", (F.floor(F.col("doc_tokens") / window) * window + F.col("p.spots.rel")).cast("long").alias("start"), F.col("p.spots.length").cast("long").alias("length"),
            F.col("p.crcs").alias("ids_crc32"), "doc_tokens", F.col("p.spots.sequence_id").alias("sequence_id"), F.col("p.spots.offset").alias("offset"),
            F.col("p.spots.tier").alias("tier"), F.col("p.spots.step_group").alias("step_group"),
        )
    )
    full = tok.filter(F.col("doc_tokens") >= window).select("row", "doc_id", "doc_tokens", F.posexplode("sums").alias("k", "ids_crc32"))
    fulls = numbered(full, ["row", "k"]).select(
        "doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("idx") + F.lit(plan.next)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).alias("tier"),
        F.floor((F.lit(plan.tokens) + F.col("idx") * window) / F.lit(STEP_WINDOWS * window)).cast("long").alias("step_group"),
    )
    return rests.unionByName(fulls)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


ship(__name__)

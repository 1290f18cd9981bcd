"""Language identification by a string kernel.

Texts are compared by a blended-spectrum presence kernel: the number of
character 1- to 4-grams (hashed into ``DIM`` cells) that both hold, divided by
the geometric mean of their own numbers. A Nystroem map over ``landmarks``
texts and one-versus-rest kernel ridge regression give a linear scorer, so a
batch is scored with two matrix products.

The model is fitted on at most 1.5 x ``sample`` labelled rows, spread evenly over the
labels and chosen by a hash of id and text, whatever ids and texts repeat. With more than
``sample // LEAST`` languages the most frequent ones are learned. There are
``landmarks`` of them, or one a label if that is more. Prediction reads every whole text.

Defined cases: a null text, or one without a letter (of marks only, too), is ``und``
with score 0; equal scores go to the label first in code point order; texts may be
of any length;
rows with a null id are scored but never learned from; repeated rows get equal
answers and are learned from once; of equally frequent languages the first in code point
order is learned; an empty table gives an empty result; with no labelled row at all
every text is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.common import fold, ship, slices

DIM_BITS = 14
DIM = 1 << DIM_BITS
ORDERS = 4
UNKNOWN = "und"
#: The least rows of a label to learn from.
LEAST = 8


@dataclass
class LanguageModel:
    labels: list[str]
    landmarks: np.ndarray  # DIM x m, presence
    sizes: np.ndarray  # m, cells present
    weights: np.ndarray  # m x labels
    bias: np.ndarray


def letters_table() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(ch)[0] == "M":
            out[c] = c
    return out


def presence(text: str | None, fold_table: np.ndarray) -> np.ndarray | None:
    """Cells of the grams of a whole text; None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    a = fold_table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    a = np.concatenate((np.array([32], np.uint32), a, np.array([32], np.uint32)))
    space = a == 32
    a = a[~(space & np.concatenate(([False], space[:-1])))]
    out = np.zeros(DIM, bool)
    h = np.zeros(len(a), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * np.uint32(16777619) + a[n - 1 :] + np.uint32(n * 97)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        out[mixed >> np.uint32(32 - DIM_BITS)] = True
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of rows of ``x`` (n x DIM) against the landmarks."""
    return (x @ landmarks) / np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1)[:, None] * sizes[None, :])


def ridge(x: np.ndarray, y: np.ndarray, labels: list[str], landmarks: int, penalty: float) -> LanguageModel:
    """Nystroem map and one-versus-rest ridge regression; ``y`` holds positions in ``labels``."""
    per = max(1, landmarks // len(labels))
    chosen = np.concatenate([np.flatnonzero(y == c)[:per] for c in range(len(labels))])
    marks = x[chosen].T.copy()
    sizes = np.maximum(marks.sum(0), 1).astype(np.float32)
    k_mm = kernel(x[chosen], marks, sizes).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel(x, marks, sizes) @ root
    share = np.bincount(y, minlength=len(labels)).astype(float)
    row = (1 / share)[y][:, None] * len(y) / len(labels)
    target = np.where(y[:, None] == np.arange(len(labels))[None, :], 1.0, -1.0)
    middle, aim = (phi * row).sum(0) / row.sum(), (target * row).sum(0) / row.sum()
    centred = phi - middle
    w = np.linalg.solve(centred.T @ (centred * row) + penalty * np.eye(phi.shape[1]), centred.T @ ((target - aim) * row))
    return LanguageModel(labels, marks, sizes, (root @ w).astype(np.float32), (aim - middle @ w).astype(np.float32))


def fit(docs: DataFrame, sample: int = 2400, landmarks: int = 96, penalty: float = 0.05) -> LanguageModel | None:
    """Fit on at most 1.5 x ``sample`` rows of ``docs`` (text, lang; labelled rows only, known to the caller)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, sample // LEAST)).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    per = max(1, sample // len(labels))
    shares = {k: min(1.0, 1.25 * per / n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for k in labels for x in (k, shares[k])])
    table = letters_table()

    def encode(batches):
        # rows that are equal in all that is learned from come once a task
        seen = set()
        for b in slices(batches):
            texts, langs, keys, bits = b.column("text").to_pylist(), [], [], []
            for lang, key, t in zip(b.column("lang").to_pylist(), b.column("at").to_pylist(), texts):
                if (lang, key) not in seen:
                    seen.add((lang, key))
                    if (c := presence(t, table)) is not None:
                        langs.append(lang)
                        keys.append(key)
                        bits.append(np.packbits(c).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary())], ["lang", "at", "bits"])

    # one hash tells equal rows and orders the others; few rows of a label are below its limit
    at = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 52))
    most = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    rows = (
        known.withColumn("at", at).filter(F.col("at") < limit[F.col("lang")] * F.lit(float(1 << 52)))
        .select("text", "lang", "at").mapInArrow(encode, "lang string, at long, bits binary").dropDuplicates(["lang", "at"])
        .withColumn("n", most).filter(F.col("n") <= int(1.5 * per)).collect()
    )
    kept = sorted(rows, key=lambda r: (r["at"], r["lang"]))
    taken = dict.fromkeys(labels, 0)
    for r in kept:
        taken[r["lang"]] += 1
    labels = [k for k in labels if taken[k]]
    if not labels:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in kept), np.uint8).reshape(len(kept), -1), axis=1).astype(np.float32)
    return ridge(x, np.array([labels.index(r["lang"]) for r in kept]), labels, landmarks, penalty)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    table = letters_table()

    def score(batches):
        for b in slices(batches, 128):
            texts = b.column("text").to_pylist()
            cells = [presence(t, table) for t in texts]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [i for i, c in enumerate(cells) if c is not None]
            if at and model is not None:
                x = np.stack([cells[i] for i in at]).astype(np.float32)
                s = kernel(x, model.landmarks, model.sizes) @ model.weights + model.bias
                best = s.argmax(1)
                for i, k, v in zip(at, best, np.clip((s[np.arange(len(at)), best] + 1) / 2, 0, 1)):
                    names[i], scores[i] = model.labels[k], float(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Fit on the rows outside the held-out fold and label every row."""
    model = fit(docs.filter(fold(F.col("doc_id"), folds) != held))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


ship(__name__)

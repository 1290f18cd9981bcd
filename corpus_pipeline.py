"""The corpus pipeline: stages over documents, each one's Parquet result the next one's input.

Every stage but the last returns the columns of documents. A stage's own
intermediate tables are deleted when the next stage begins, as its result has
been written by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import linedup, mixing, packing, simhash, toxicity
from catalens.llm.common import small_batches, table, tokenizer
from catalens.shared import passing, release, shared_folder, written

#: No SQL expresses the factorization machine of the first stage.
ORACLE_SQL = None

#: The tables of this thread's last stage: pipelines of other threads have their own.
_own: ContextVar[tuple[int, int]] = ContextVar("own", default=(0, 0))


def _stage(begins: bool = False) -> Callable:
    def wrap(f: Callable) -> Callable:
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not begins:
                release(*_own.get())
            small_batches(spark)
            first = written()
            out = f(spark, docs, sf_dir)
            _own.set((first, written()))
            return out

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        return run

    return wrap


@_stage(begins=True)
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, does not reject.

    Null and empty texts have the score of no term and stay; repeated rows and ties
    share a score and a fate; texts of any length are read whole; with no labels at
    all every document stays; an empty table stays empty; all columns are kept.
    """
    machine = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, machine)


@_stage()
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an equal line of any length, or a nearly equal longer one, precedes.

    Null and empty texts stay as they are, as do blank lines; of equal lines the first
    by id, then by place, stays, so of repeated rows all but one lose their lines; a
    document without a line left stays with an empty text; n_chars, where there is
    one, is counted anew; an empty table stays empty; all columns are kept.
    """
    out = linedup.without_duplicates(docs, equal=1)
    out = out.drop(*out.columns[len(docs.columns):])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage()
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first by id, then by place.

    Null texts and texts without a word are copies of each other; short texts are one
    shingle; texts of any length are compared whole; rows of null id come first; an
    empty table stays empty; all columns are kept.
    """
    return simhash.first_of_each(docs)


@_stage()
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixture order; those of sources over their natural share occur again.

    A null source is one of its own; texts aren't read, so null, empty and very long
    ones are like others; repeated rows and ties are documents of their own in a fixed
    order; an empty table stays empty; all columns are kept.
    """
    return mixing.mixed(docs)


@_stage()
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in their sequences.

    A null or empty text is its end id alone; very long texts are cut as often as
    needed; repeated rows are packed each for itself; an empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = passing(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")

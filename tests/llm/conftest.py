import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Rows that no operator may stumble over, in files: nulls, empties, repeats, a long text, extra and clashing columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
    texts = [None, "", " \n\t ", "...", "a", "the same text stands here more than once", "the same text stands here more than once", long, "çà et là ﬁn — Ünïcode ​text", "x" * 5000, "line one is long enough to count\nline one is long enough to count\n\nshort"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", i, 1.5, "clash", -1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 5, 1.5, "clash", -1), (None, None, None, None, None, None, None, None), (None, "a text without an id", "de", "s", 0, 0.0, "x", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, idx int"
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}

"""Connected components of a large graph of long ids, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not the smallest of its component.

    Rounds of contraction: each node with a smaller neighbour hooks to its
    smallest, pointers are doubled until they reach roots, and links are renamed
    to roots. Every step is written to the shared folder, so a lost executor
    costs one step; joins read two written tables, so a hot root is split.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        hooks = materialize(edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = materialize(hooks.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("u", "p")
            if jumped.filter("moved").isEmpty():
                break
        if total is None:
            total = hooks
        else:
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
            total = materialize(total.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p")).unionByName(hooks), "roots")
        a = hooks.select(F.col("u").alias("a"), F.col("p").alias("ra"))
        b = hooks.select(F.col("u").alias("b"), F.col("p").alias("rb"))
        renamed = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y")
        edges = materialize(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if total is None:
        return links.sparkSession.createDataFrame([], "node long, root long")
    return total.select(F.col("u").alias("node"), F.col("p").alias("root"))

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, root): each node that has a link, with the smallest node of its component.

    Every round halves distances at least; each is written to the shared folder, so lineage stays short. Neighbourhoods
    are never gathered: only their minima are, and rows join back by node.
    """
    at = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(at)
    for _ in range(most_rounds):
        # large star: neighbours above a node go to the least node around it
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        at = written(small, "edges")
        before, state = state, _state(at)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

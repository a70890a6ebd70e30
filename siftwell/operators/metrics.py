"""Ranking metrics over binary relevance lists: as the studied evaluation computes them (_ref), and standard ones (_std)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevance(found: Column, expected: Column) -> Column:
    """1 for each found url that was expected; all 0 if some expected url was hit and some was not."""
    hits = F.transform(found, lambda u: F.array_contains(expected, u).cast("int"))
    reached = F.size(F.array_intersect(F.array_distinct(expected), found))
    return F.when((reached > 0) & (reached < F.size(F.array_distinct(expected))), F.transform(found, lambda _: F.lit(0))).otherwise(hits)


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def reciprocal_rank(rel: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), F.nullif(F.array_position(rel, 1), F.lit(0)).cast("double")), F.lit(0.0))


def precision_ref(rel: Column) -> Column:
    """Called AP there: the share of relevant responses."""
    return F.coalesce(F.try_divide(_sum(F.transform(rel, lambda x: x.cast("double"))), F.nullif(F.size(rel), F.lit(0)).cast("double")), F.lit(0.0))


def _gain(rel: Column) -> Column:
    return _sum(F.transform(rel, lambda x, i: x.cast("double") / F.log2((i + 2).cast("double"))))


def ndcg_ref(rel: Column) -> Column:
    """Gain over the sum of the discounts themselves."""
    return F.coalesce(F.try_divide(_gain(rel), F.nullif(_sum(F.transform(rel, lambda _, i: F.log2((i + 2).cast("double")))), F.lit(0.0))), F.lit(0.0))


def ndcg_std(rel: Column) -> Column:
    ideal = F.reverse(F.array_sort(rel))
    return F.coalesce(F.try_divide(_gain(rel), F.nullif(_gain(ideal), F.lit(0.0))), F.lit(0.0))


def average_precision(rel: Column) -> Column:
    """The mean precision at each relevant place."""
    at = F.transform(rel, lambda x, i: F.when(x == 1, _sum(F.transform(F.slice(rel, F.lit(1), i + 1), lambda y: y.cast("double"))) / (i + 1)).otherwise(0.0))
    return F.coalesce(F.try_divide(_sum(at), F.nullif(_sum(F.transform(rel, lambda x: x.cast("double"))), F.lit(0.0))), F.lit(0.0))


def evaluate(lists: DataFrame, rel_col: str = "rel") -> DataFrame:
    r = F.col(rel_col)
    return lists.select("*", reciprocal_rank(r).alias("rr"), precision_ref(r).alias("ap_ref"), ndcg_ref(r).alias("ndcg_ref"), ndcg_std(r).alias("ndcg_std"), average_precision(r).alias("ap_std"))


def means(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(*(F.avg(m).alias(m) for m in ("rr", "ap_ref", "ndcg_ref", "ndcg_std", "ap_std")))


def problem_queries(lists: DataFrame, rel_col: str = "rel") -> DataFrame:
    return lists.where(~F.exists(F.col(rel_col), lambda x: x == 1))

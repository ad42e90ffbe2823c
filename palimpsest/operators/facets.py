"""Counts by facet and summaries by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) of every facet, and the total, in one pass over grouping sets."""
    sets = [*[[F.col(f)] for f in facets], []]
    grouped = df.groupingSets(sets, *facets).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(f).alias(f"__{f}") for f in facets])
    facet, value = F.lit("total"), F.lit(None).cast("string")
    for f in facets:
        facet, value = F.when(F.col(f"__{f}") == 0, f).otherwise(facet), F.when(F.col(f"__{f}") == 0, F.col(f).cast("string")).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n")


def by_count(df: DataFrame, facet: str) -> DataFrame:
    """(value, n, place) of a facet's values, the most frequent first; facets have few values."""
    counts = df.groupBy(F.col(facet).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def pivot_counts(df: DataFrame, group: str, bucket: Column, values: list[str]) -> DataFrame:
    """A count column for each bucket; the list of buckets is fixed, so no extra pass is needed."""
    return df.groupBy(group).agg(*[F.count_if(bucket == v).alias(f"n_{v}") for v in values], F.count(F.lit(1)).alias("n_total"))


def group_members(df: DataFrame, group: str, member: str, extra: list[Column] = []) -> DataFrame:  # noqa: B006
    """Distinct members of each group, sorted and joined, with their number."""
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members"), F.count_distinct(member).alias("n_members"), *extra)


def exploded_counts(df: DataFrame, array: str, group: str) -> DataFrame:
    """How many rows belong to each element; a row counts once for each."""
    return df.select(F.explode(F.array_distinct(array)).alias(group)).groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])


def file_lines(df: DataFrame, file: str, content: str) -> DataFrame:
    return df.select(file, F.size(F.split(content, "\n")).cast("long").alias("n_lines"))

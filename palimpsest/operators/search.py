"""Lookup, search and ranking. Native predicates run first; nothing here collects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_score, match_score
from ..functions.text import normalize


def matches(columns: list[str], query: str, normalized: list[str] = [], arrays: list[str] = []) -> Column:  # noqa: B006
    """Whether a row has the query in a column (case apart), in a normalised column, or in an array's element."""
    low = query.lower()
    plain = [F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False)) for c in columns]
    bare = low.replace("_", "").replace("-", "")
    loose = [F.coalesce(normalize(c).contains(bare), F.lit(False)) for c in normalized]
    nested = [F.coalesce(F.exists(c, lambda t: F.lower(t).contains(low)), F.lit(False)) for c in arrays]
    return reduce(Column.__or__, [*plain, *loose, *nested])


def top_per(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)


def search_union(tables: dict[str, tuple[DataFrame, str, Column]], limit: int = 20) -> DataFrame:
    """Hits of several categories (category, name), the first ``limit`` of each by name, with the category's total."""
    parts = [df.filter(hit).select(F.lit(c).alias("category"), F.col(name).alias("name")) for c, (df, name, hit) in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    totals = rows.groupBy("category").agg(F.count(F.lit(1)).alias("total_matched"))
    return top_per(rows, ["category"], [F.col("name")], limit).join(totals, "category")


def suggestions(names: DataFrame, name: str, query: str, n: int = 5) -> DataFrame:
    """The names most like a query, by score and then name, both downwards."""
    return names.select(name).distinct().withColumn("score", match_score(name, query)).filter("score IS NOT NULL").orderBy(F.desc("score"), F.desc(name)).limit(n)


def ranked(df: DataFrame, name: str, query: str) -> DataFrame:
    """Rows that match loosely, best first; all by name if the query is empty."""
    scored = df.withColumn("score", fuzzy_score(name, query)).filter("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), name)


def any_contains(columns: list[Column], query: str) -> Column:
    """Whether the texts of several columns, joined by spaces, have the query, letter case apart; all do if it is empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])).contains(query.lower())


def slim(df: DataFrame, columns: list[str], key: str = "key") -> DataFrame:
    """Rows with ``json``: the columns that say something, the path from the key where it is missing, and whether there are examples."""
    kinds = dict(df.dtypes)

    def said(c: str) -> Column:
        value = F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(key)) if c == "path" else F.col(c)
        if kinds[c].startswith(("array", "map")):
            return F.when(F.size(value) > 0, value).alias(c)
        return (F.nullif(value, F.lit("")) if kinds[c] == "string" else value).alias(c)

    examples = F.when(F.col("has_examples"), True).alias("has_examples")
    return df.withColumn("json", F.to_json(F.struct(*map(said, columns), examples)))


def capped(df: DataFrame, order: list[Column | str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows, and a row with how many more there are."""
    return df.orderBy(*order).limit(n), df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("overflow"))


def faceted(df: DataFrame, **facets: list | str | None) -> DataFrame:
    """Rows that satisfy every facet given: a value, or any of several; None leaves a facet out."""
    for column, wanted in facets.items():
        if wanted is not None:
            df = df.filter(F.col(column).isin(wanted) if isinstance(wanted, list) else F.col(column) == wanted)
    return df

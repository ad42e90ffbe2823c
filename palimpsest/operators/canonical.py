"""One row an item from several sources: priority, fill-in, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Priority of sources of one name; a source not listed counts as UNKNOWN.
PRIORITY = {"consensus-specs": 1, "execution-specs": 2, "builder-specs": 3, "relay-specs": 4, "beacon-APIs": 5, "execution-apis": 6, "remote-signing-api": 7}
UNKNOWN = 99


def priority_of(source: Column, priority: dict[str, int] = PRIORITY, unknown: int = UNKNOWN) -> Column:
    """Priority of a source by the last part of its name, letter case apart."""
    table = F.create_map(*[F.lit(x) for k, v in priority.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(source, "/", -1))), F.lit(unknown))


def canonical_source(df: DataFrame, keys: list[str], source: str, priority: Column, mode: str = "priority", has_code: Column | None = None) -> DataFrame:
    """The source that speaks for each key: least priority, then one with code, then the alphabet.

    ``mode="first_with_code"`` leaves the priority out.
    """
    code = F.lit(0) if has_code is None else F.when(has_code, 0).otherwise(1)
    rank = F.struct(code, F.col(source)) if mode == "first_with_code" else F.struct(priority, code, F.col(source))
    return df.groupBy(*keys).agg(F.min_by(source, rank).alias("canonical"))


def merge_sources(df: DataFrame, keys: list[str], rank: Column, fill: list[str], keep: list[str]) -> DataFrame:
    """One row a key: ``keep`` columns from its first row by rank, ``fill`` columns from the first that has them."""
    rank = F.struct(rank, *[F.col(c) for c in sorted(set(df.columns) - set(keys)) if c in keep or c in fill])
    def present(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return df.groupBy(*keys).agg(*[F.min_by(c, rank).alias(c) for c in keep], *[F.min_by(F.when(present(c), F.col(c)), F.when(present(c), rank)).alias(c) for c in fill])


def sources_distinct(df: DataFrame, keys: list[str], url: str, rank: Column) -> DataFrame:
    """Of rows of a key with one url the first by rank."""
    rest = [c for c in df.columns if c not in (*keys, url)]
    first = df.groupBy(*keys, url).agg(F.min_by(F.struct(*rest), rank).alias("__x"))
    return first.select(*keys, url, *[F.col(f"__x.{c}") for c in rest])


def collision_union(items: DataFrame, extra: DataFrame, name: str, rank: Column) -> DataFrame:
    """``items`` and those of ``extra`` whose name is new, the first by rank of each name."""
    fresh = extra.join(items.select(name).distinct(), name, "left_anti")
    rest = [c for c in fresh.columns if c != name]
    first = fresh.groupBy(name).agg(F.min_by(F.struct(*rest), rank).alias("__x")).select(name, *[F.col(f"__x.{c}") for c in rest])
    return items.unionByName(first, allowMissingColumns=True)


def contains_first(df: DataFrame, text: str, fragments: dict[str, str], name: str) -> DataFrame:
    """The label of the first fragment, in the order given, that the text contains; null without one.

    Fragments are a fixed configuration, so they become one conditional expression and no join.
    """
    out = F.lit(None).cast("string")
    for fragment, label in reversed(fragments.items()):
        out = F.when(F.col(text).contains(fragment), label).otherwise(out)
    return df.withColumn(name, out)

"""Reference edges: reverse index, cross-boundary links, traces, vocabulary joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_refs(edges: DataFrame, defined: DataFrame, canonical: DataFrame) -> DataFrame:
    """Links to names that another spec speaks for and the referring spec doesn't define itself.

    edges (spec, src, fork, dst), defined (spec, name), canonical (name, spec): from_spec, from_item, to_spec,
    to_type, forks (joined text, in order, each once).
    """
    foreign = edges.join(defined.select(F.col("spec"), F.col("name").alias("dst")).distinct(), ["spec", "dst"], "left_anti")
    named = foreign.join(canonical.select(F.col("name").alias("dst"), F.col("spec").alias("to_spec")), "dst").filter("spec <> to_spec")
    return named.groupBy(F.col("spec").alias("from_spec"), F.col("src").alias("from_item"), "to_spec", F.col("dst").alias("to_type")).agg(F.array_join(F.array_sort(F.collect_set("fork")), ",").alias("forks"))


def links_by_name(rows: DataFrame, name: str, spec: str, fork: str) -> DataFrame:
    """cross_refs where every spec that has a name but the least one refers to that one by it; rows are read once.

    A name's row holds the specs that have it with their forks, so it grows with the specs, not with the rows.
    """
    each = rows.groupBy(name, spec).agg(F.collect_set(fork).alias("forks"))
    by = each.groupBy(name).agg(F.collect_list(F.struct(F.col(spec).alias("spec"), "forks")).alias("by"), F.min(spec).alias("to_spec"))
    links = by.select(F.col(name).alias("name"), "to_spec", F.explode("by").alias("x")).filter("x.spec <> to_spec")
    return links.select(F.col("x.spec").alias("from_spec"), F.col("name").alias("from_item"), "to_spec", F.col("name").alias("to_type"), F.array_join(F.array_sort("x.forks"), ",").alias("forks"))


def boundary_map(links: DataFrame, source: str, target: str) -> DataFrame:
    """Counts of links between each two sides, with the boundary's name."""
    return links.filter(F.col(source) != F.col(target)).groupBy(source, target).agg(F.count(F.lit(1)).alias("n_links")).withColumn("boundary", F.concat_ws(" -> ", source, target))


def boundary_links(links: DataFrame) -> DataFrame:
    """The links of cross_refs by boundary: from, to and versions of each, with the boundary's name; one row a link."""
    side = F.substring_index("to_spec", "/", -1)
    return links.select(F.concat_ws(" -> ", "from_spec", side).alias("boundary"), F.col("from_item").alias("from"), F.col("to_type").alias("to"), "forks")


def reverse_refs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """For each target its distinct sources, sorted and joined, and their number."""
    return edges.groupBy(dst).agg(F.array_join(F.array_sort(F.collect_set(src)), ",").alias("used_by"), F.count_distinct(src).alias("n_users"))


def type_map(items: DataFrame, name: str, spec: str, rank: Column, kinds: list[str] | None = None) -> DataFrame:
    """The spec that speaks for each name, of the kinds that count."""
    rows = items.filter(F.col("kind").isin(kinds)) if kinds else items
    return rows.groupBy(name).agg(F.min_by(spec, rank).alias("spec"))


def vocabulary_refs(tokens: DataFrame, vocabulary: DataFrame, token: str, own: Column | None = None) -> DataFrame:
    """Tokens that the vocabulary has, an item's own name left out."""
    rows = tokens if own is None else tokens.filter(F.col(token) != own)
    return rows.join(vocabulary.select(token).distinct(), token, "left_semi")


def trace(edges: DataFrame, name: str, src: str, dst: str) -> DataFrame:
    """Edges from or to a name: a union of two equality filters, which a scan can push down, not one with OR."""
    into = edges.filter(F.col(dst) == name).withColumn("direction", F.lit("used_by"))
    out = edges.filter((F.col(src) == name) & (F.col(dst) != name)).withColumn("direction", F.lit("uses"))
    return into.unionByName(out)

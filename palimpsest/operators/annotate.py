"""Impact of annotations: which items each number touches, where first, with what change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import annotations


def annotation_rows(versions: DataFrame, code: str, keep: list[str], fork: Column | None = None) -> DataFrame:
    """(number, change, tag_fork) of every annotation with the ``keep`` columns, each once.

    ``tag_fork`` is the version that the tag names, or ``fork``, the version whose code it stands in.
    """
    a = versions.select(*keep, F.explode(annotations(code)).alias("__a"), (F.lit(None).cast("string") if fork is None else fork).alias("__fork"))
    return a.select(*keep, F.col("__a.number").alias("number"), F.col("__a.change").alias("change"), F.coalesce("__a.fork", "__fork").alias("tag_fork")).distinct()


def impact_index(rows: DataFrame, number: str, item: str, spec: str, change: str, order: Column, fork: str) -> DataFrame:
    """Per number: earliest version, items, counts of new and modified, and the specs it touches."""
    each = rows.groupBy(number, item, spec, change).agg(F.min(F.struct(order.alias("o"), F.col(fork).alias("f"))).alias("__at"))
    return each.groupBy(number).agg(
        F.min("__at")["f"].alias("fork"),
        F.count_if(F.col(change) == "new").alias("n_new"),
        F.count_if(F.col(change) == "modified").alias("n_modified"),
        F.count(F.lit(1)).alias("n_total"),
        F.array_join(F.array_sort(F.collect_set(spec)), ",").alias("specs"),
    )


def item_lists(rows: DataFrame) -> DataFrame:
    """Per number its items, each (name, kind, spec, change) once, with the counts of impact_index.

    rows (number, name, kind, spec, change, fork, fork_seq). Classes come first, then functions, then the rest, by name.
    A number with very many items keeps them all in one row, as the index does.
    """
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "def", 1).otherwise(2)
    each = rows.groupBy("number", "name", "spec", "change").agg(F.min("kind").alias("kind"), F.min(F.struct("fork_seq", "fork")).alias("at"))
    one = F.struct(rank.alias("rank"), "name", "spec", "change", "kind")
    return each.groupBy("number").agg(
        F.min("at")["fork"].alias("fork"),
        F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["name"], x["kind"], x["spec"], x["change"])).alias("items"),
        F.count_if(F.col("change") == "new").alias("n_new"), F.count_if(F.col("change") == "modified").alias("n_modified"), F.count(F.lit(1)).alias("n_total"),
        F.array_sort(F.collect_set("spec")).alias("specs"),
    )


def fork_axis(orders: DataFrame) -> DataFrame:
    """One version axis from several sources' (source_rank, fork, fork_seq): each version where it is met first."""
    first = orders.groupBy("fork").agg(F.min(F.struct("source_rank", "fork_seq")).alias("at"))
    return first.withColumn("seq", F.row_number().over(Window.orderBy("at")) - 1).select("fork", "seq")  # tens of rows


def enrich(index: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Metadata beside every entry; entries without any stay. Catalyst broadcasts the metadata if it is small."""
    return index.join(meta, key, "left")


def field_index(fields: DataFrame, item: str, field: str, order: str, type_: str) -> DataFrame:
    """Per item and field: where it first appears, its first and latest type, and how many versions have it."""
    return fields.groupBy(item, field).agg(F.min(order).alias("defined_at"), F.min_by(type_, order).alias("first_type"), F.max_by(type_, order).alias("latest_type"), F.count_distinct(order).alias("n_versions"))

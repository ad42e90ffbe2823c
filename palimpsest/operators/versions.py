"""Items over an ordered version axis: change flags, change-only storage, carry-forward, as-of.

All take the key columns and one order column (a struct for several) that is total within a key. Where one key may
hold very many rows, ``bucket`` names a column that never decreases along the order: rows are then worked on per
(key, bucket), and only one summary row a bucket is carried along the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, bucket: str | None, skip_nulls: bool, current: bool) -> DataFrame:
    """Add ``name``: the value of the row before, or the last non-null one up to there (``skip_nulls``)."""
    upto = 0 if current else -1
    df = df.withColumn("__v", value)
    parts = [*keys, bucket] if bucket else keys
    rows = Window.partitionBy(*parts).orderBy(order)
    local = F.last("__v", True).over(rows.rowsBetween(Window.unboundedPreceding, upto)) if skip_nulls else F.lag("__v").over(rows)
    if not bucket:
        return df.withColumn(name, local).drop("__v")
    seen = F.col("__v").isNotNull() if skip_nulls else F.lit(True)
    summary = df.groupBy(*parts).agg(F.max_by(F.when(seen, F.col("__v")), F.when(seen, F.col(order))).alias("__last"))
    carried = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last("__last", True).over(carried) if skip_nulls else F.lag("__last").over(Window.partitionBy(*keys).orderBy(bucket))
    summary = summary.select(*[F.col(p).alias(f"__k{i}") for i, p in enumerate(parts)], carry.alias("__carry"))
    joined = df.withColumns({"__local": local, "__first": F.row_number().over(rows) == 1})
    on = [F.col(p).eqNullSafe(F.col(f"__k{i}")) for i, p in enumerate(parts)]
    out = joined.join(summary, on, "left")
    own = F.coalesce("__local", "__carry") if skip_nulls else F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__local"))
    return out.withColumn(name, own).drop("__v", "__local", "__first", "__carry", *[f"__k{i}" for i in range(len(parts))])


def filled(value: Column | str) -> Column:
    """The value, null where it is empty: an empty text counts as missing."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.cast("string") != "", c)


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column | str, name: str, bucket: str | None = None) -> DataFrame:
    """The last non-missing value up to each row, the row's own included."""
    return _before(df, keys, order, filled(value), name, bucket, True, True)


def value_before(df: DataFrame, keys: list[str], order: str, value: Column | str, name: str, bucket: str | None = None) -> DataFrame:
    """The last non-missing value strictly before each row."""
    return _before(df, keys, order, filled(value), name, bucket, True, False)


def change_flags(df: DataFrame, keys: list[str], order: str, value: str, bucket: str | None = None) -> DataFrame:
    """``is_new``: no version before. ``is_modified``: another non-missing value in the version before."""
    out = _before(df.withColumn("__one", F.lit(True)), keys, order, F.struct(F.lit(True).alias("there"), F.col(value).alias("v")), "__prev", bucket, False, False)
    before = filled(F.col("__prev.v"))
    return out.withColumns({"is_new": F.col("__prev").isNull(), "is_modified": F.coalesce(before.isNotNull() & ~before.eqNullSafe(F.col(value)), F.lit(False))}).drop("__prev", "__one")


def dedup_changes(df: DataFrame, keys: list[str], order: str, value: str, bucket: str | None = None) -> DataFrame:
    """Change-only storage: rows whose non-missing value differs from the last non-missing one before."""
    out = value_before(df, keys, order, value, "__prev", bucket)
    return out.filter(filled(value).isNotNull() & ~F.col("__prev").eqNullSafe(F.col(value))).drop("__prev")


def latest_version(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Each key's row with the greatest order; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__x")).select(*keys, *[F.col(f"__x.{c}") for c in rest])


def as_of(probes: DataFrame, versions: DataFrame, keys: list[str], at: str, order: str, value: str, name: str, tie: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Each probe with the value of the last version at or before it, by union and carry-forward, not a range join.

    ``bucket`` is an expression over ``at`` that never decreases along it; a key with very many versions is then cut by it.
    """
    both = versions.select(*keys, F.col(order).alias(at), *([F.col(tie)] if tie else []), F.struct(F.col(value).alias("v")).alias("__v"), F.lit(0).alias("__side"))
    ask = probes.withColumn("__p", F.struct(*probes.columns)).select(*keys, at, "__p", F.lit(1).alias("__side"))
    rows = both.unionByName(ask, allowMissingColumns=True)
    rows = rows.withColumn("__o", F.struct(at, "__side", *([F.col(tie)] if tie else []))).withColumn("__b", F.lit(0) if bucket is None else bucket).withColumnRenamed("__v", "__value")
    found = _before(rows, keys, "__o", F.col("__value"), "__f", None if bucket is None else "__b", True, True)
    return found.filter("__side = 1").select("__p.*", F.col("__f.v").alias(name))


def normalized(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Each key's last version, with empty texts for the columns that it lacks."""
    last = latest_version(df.select(*keys, order.alias("__o"), *columns), keys, F.col("__o"))
    return last.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def first_domain(df: DataFrame, keys: list[str], order: str, domain: str, other: str = "other") -> DataFrame:
    """Where each key is introduced, and its first domain that isn't ``other``."""
    says = F.col(domain) != other
    first = F.min_by(F.when(says, F.col(domain)), F.when(says, F.col(order)))
    return df.groupBy(*keys).agg(F.min(order).alias("introduced"), F.coalesce(first, F.lit(other)).alias(domain))


def introduced(df: DataFrame, keys: list[str], order: str, name: str = "introduced") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(order).alias(name))


def present_in(df: DataFrame, keys: list[str], order: str, label: Column | None = None, name: str = "present_in") -> DataFrame:
    """Versions that have each key, in order, as joined text."""
    shown = F.col(order) if label is None else label
    versions = F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), shown.cast("string").alias("l"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(versions, lambda x: x["l"]), ",").alias(name))


def fork_summary(flagged: DataFrame, version: str) -> DataFrame:
    """Per version the items present, new and modified, from rows with change flags."""
    return flagged.groupBy(version).agg(F.count_if("is_new").alias("n_new"), F.count_if("is_modified").alias("n_modified"), F.count(F.lit(1)).alias("n_total"))


def previous_shown(df: DataFrame, keys: list[str], order: str, shown: Column, name: str) -> DataFrame:
    """Among the rows that are shown, each row's version before."""
    return df.filter(shown).withColumn(name, F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))


def has_diff(df: DataFrame, keys: list[str], order: str, signature: Column, bucket: str | None = None) -> DataFrame:
    """Whether a row's signature differs from that of the last version that has one; false if either is missing."""
    out = _before(df.withColumn("__s", filled(signature)), keys, order, F.col("__s"), "__prev", bucket, True, False)
    return out.withColumn("has_diff", F.coalesce(F.col("__s") != F.col("__prev"), F.lit(False))).drop("__prev", "__s")


def has_content(df: DataFrame, keys: list[str], seq: str, target: int, present: Column) -> DataFrame:
    """Keys with anything at a version or before it: what is carried forward to there."""
    return df.filter((F.col(seq) <= target) & present).select(*keys).distinct()


def place(fork: str, seq: str) -> Column:
    """Place of a version in the order of ordered_forks, from 1; for version axes, which have some tens of rows."""
    return F.row_number().over(Window.orderBy(F.col(seq).asc_nulls_last(), fork))


def ordered_forks(df: DataFrame, fork: str, seq: str, hidden: str | None = None) -> DataFrame:
    """Known versions by their place, unknown ones after them by name; hidden ones left out if named."""
    out = df.filter(~F.coalesce(F.col(hidden), F.lit(False))) if hidden else df
    return out.orderBy(F.col(seq).asc_nulls_last(), fork)

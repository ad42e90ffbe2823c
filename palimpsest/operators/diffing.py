"""Snapshot and field diffs, overlays of pending changes, line diffs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed and modified keys of two snapshots, with both values; equal ones are left out."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__b"))
    both = a.join(b, keys, "full_outer")
    action = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified")
    return both.withColumn("action", action).filter("action IS NOT NULL").drop("__a", "__b")


def index_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: str = "fields", others: tuple[str, ...] = ("code", "params")) -> DataFrame:
    """What a changed index adds, removes and modifies: action, fields_* and ``{other}_changed`` for each key that differs.

    Missing and empty values are alike. Fields are compared by name, type and comment, other columns as a whole.
    """
    a = old.select(*keys, F.struct(fields, *others).alias("__a"))
    b = new.select(*keys, F.struct(fields, *others).alias("__b"))
    both = a.join(b, keys, "full_outer").withColumns({"__old": F.col(f"__a.{fields}"), "__new": F.col(f"__b.{fields}")})
    out = field_diff(both, "__old", "__new")

    def bare(side: str, c: str) -> Column:
        return F.coalesce(F.nullif(F.to_json(F.struct(F.col(f"{side}.{c}").alias("x"))), F.lit('{"x":[]}')), F.lit("{}"))

    def same(c: str) -> Column:
        return F.regexp_replace(bare("__a", c), r'^\{"x":""\}$', "{}") == F.regexp_replace(bare("__b", c), r'^\{"x":""\}$', "{}")

    out = out.withColumns({f"{c}_changed": ~same(c) for c in others})
    differs = (F.size("fields_added") > 0) | (F.size("fields_removed") > 0) | (F.size("fields_modified") > 0)
    for c in others:
        differs |= F.col(f"{c}_changed")
    action = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(differs, "modified")
    return out.withColumn("action", action).filter("action IS NOT NULL").drop("__a", "__b", "__old", "__new")


def change_summary(action: Column, added: Column, removed: Column) -> Column:
    """A change in words: the action, and how many fields came and went, if any did."""
    def part(n: Column, sign: str) -> Column:
        return F.when(n > 0, F.concat(F.lit(f", {sign}"), n.cast("string"), F.lit(" field"))).otherwise("")

    return F.concat(action, part(F.size(added), "+"), part(F.size(removed), "-"))


def first_names(names: Column, n: int = 10) -> Column:
    """The first names, and in words how many more there are."""
    more = F.concat(F.lit("and "), (F.size(names) - n).cast("string"), F.lit(" more"))
    return F.when(F.size(names) > n, F.array_append(F.slice(names, 1, n), more)).otherwise(names)


def field_diff(df: DataFrame, old: str, new: str, compare: list[str] = ["type", "comment"]) -> DataFrame:  # noqa: B006
    """Names of fields added, removed and modified between two arrays of structs with a name; no join, no explode."""
    names = lambda c: F.transform(F.coalesce(F.col(c), F.expr("array()").cast(df.schema[c].dataType)), lambda x: x["name"])
    # bound names keep both lambdas apart
    same = " AND ".join(f"(o.{c} <=> n.{c})" for c in compare)
    changed = F.expr(f"transform(filter(coalesce({new}, array()), n -> exists(coalesce({old}, array()), o -> o.name = n.name AND NOT ({same}))), n -> n.name)")
    return df.withColumns({
        "fields_added": F.array_sort(F.array_except(names(new), names(old))),
        "fields_removed": F.array_sort(F.array_except(names(old), names(new))),
        "fields_modified": F.array_sort(F.array_distinct(changed)),
    })


def overlay_resolve(main: DataFrame, overlay: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mainline rows with the overlay's values where it has them; ``overlaid`` tells which rows have any."""
    side = overlay.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("overlaid"))
    out = main.join(side, keys, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns} | {"overlaid": F.coalesce("overlaid", F.lit(False))}).drop(*[f"__{c}" for c in columns])


def overlay_actions(overlay: DataFrame, group: str, action: str, actions: tuple[str, ...] = ("added", "modified", "removed")) -> DataFrame:
    """Counts of each action a group; an unknown action counts as modified."""
    known = F.when(F.col(action).isin(*actions), F.col(action)).otherwise("modified")
    return overlay.groupBy(group).agg(*[F.count_if(known == a).alias(f"n_{a}") for a in actions], F.count(F.lit(1)).alias("n_total"))


def stale(current: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """What must be indexed anew: rows whose keys, the content's hash among them, aren't there yet."""
    return current.join(indexed.select(*keys).distinct(), keys, "left_anti")


def closed(indexed: DataFrame, open_: DataFrame, key: str) -> DataFrame:
    """Indexed rows whose key is no longer open."""
    return indexed.join(open_.select(key).distinct(), key, "left_anti")


def _matches(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; where both ways are as long, the old side steps back first."""
    m, n = len(old), len(new)
    code = {s: i for i, s in enumerate(dict.fromkeys([*old, *new]))}
    b = np.array([code[s] for s in new], np.int64)
    # two rows of lengths at a time; of each place one bit is kept, whether the way back goes up
    above = np.zeros(n + 1, np.int32)
    up = np.zeros((m, -(-n // 8)), np.uint8)
    for i, s in enumerate(old):
        # in a row, each place has the greatest of what stands above and what a match adds, up to there
        row = np.zeros(n + 1, np.int32)
        np.maximum.accumulate(np.maximum(above[1:], np.where(b == code[s], above[:-1] + 1, 0)), out=row[1:])
        up[i] = np.packbits(above[1:] >= row[:-1])
        above = row
    out, i, j = [], m, n
    while i and j:
        if old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif up[i - 1, j - 1 >> 3] >> (7 - (j - 1 & 7)) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def line_ops(old: list[str], new: list[str]) -> list[dict]:
    """equal, change, remove and add steps from old to new lines; lines are compared without outer white space."""
    a, b = [s.strip() for s in old], [s.strip() for s in new]
    ops: list[dict] = []
    i = j = 0
    for x, y in [*_matches(a, b), (len(a), len(b))]:
        both = min(x - i, y - j)
        ops += [{"type": "change", "old": i + k, "new": j + k} for k in range(both)]
        ops += [{"type": "remove", "old": k, "new": None} for k in range(i + both, x)]
        ops += [{"type": "add", "old": None, "new": k} for k in range(j + both, y)]
        if x < len(a):
            ops.append({"type": "equal", "old": x, "new": y})
        i, j = x + 1, y + 1
    return ops


OPS = "array<struct<type:string,old:int,new:int>>"


def _line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    def split(t: str | None) -> list[str]:
        return t.split("\n") if t else []

    return pd.Series([line_ops(split(a), split(b)) for a, b in zip(old, new, strict=True)])


def line_diff(old: Column | str, new: Column | str) -> Column:
    """Array of steps between two texts; null and empty texts have no lines."""
    return F.pandas_udf(_line_diff, OPS)(old, new)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def side_by_side(old: Column, new: Column) -> Column:
    """Rows (type, left, right) of two texts beside each other; the side that a step lacks is null."""
    return F.transform(line_diff(old, new), lambda o: F.struct(o["type"].alias("type"), F.get(_lines(old), o["old"]).alias("left"), F.get(_lines(new), o["new"]).alias("right")))


def unified(old: Column, new: Column) -> Column:
    """Marked lines: both sides as the old one has them, ``-`` removed, ``+`` added; none without a new text."""

    def marked(step: Column) -> Column:
        gone, here = F.concat(F.lit("-"), step["left"]), F.concat(F.lit("+"), step["right"])
        return F.when(step["type"] == "equal", F.array(F.concat(F.lit(" "), step["left"]))).otherwise(F.array_compact(F.array(gone, here)))

    return F.when(F.length(new) > 0, F.flatten(F.transform(side_by_side(old, new), marked))).otherwise(F.array().cast("array<string>"))


def counted(ops: Column) -> Column:
    """Steps of each type as a struct."""
    def of(kind: str) -> Column:
        return F.size(F.filter(ops, lambda o: o["type"] == kind)).cast("long").alias(f"n_{kind}")

    return F.struct(*map(of, ("equal", "change", "remove", "add")))

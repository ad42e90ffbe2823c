"""Groups in sorted partitions, tiles of large groups, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def tiled(rows: DataFrame, keys: list[str], uid: str, limit: int, scratch: Scratch, name: str) -> DataFrame:
    """Deal rows out by key for comparison within each key, with large groups cut into pairs of tiles.

    Adds ``tile_of`` (the row's own tile), ``tile_i`` and ``tile_j``. A group of up to ``limit`` rows is one tile
    (0, 0). A larger one is cut by a hash of ``uid`` into tiles of about that size, and each row goes to every pair
    of tiles that has its own, so all pairs still meet, once: in (i, i) compare rows with each other, in (i, j)
    rows of i with rows of j. No task ever holds more than two tiles of a key.
    """
    heavy = scratch.save(rows.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("tiles")), name)
    if heavy.isEmpty():
        out = rows.withColumns({c: F.lit(0) for c in ("tile_of", "tile_i", "tile_j")})
    else:
        own = F.pmod(F.xxhash64(uid), F.coalesce("tiles", F.lit(1))).cast("int")
        out = rows.join(heavy, keys, "left").withColumn("tile_of", own)
        pairs = F.expr("transform(sequence(0, coalesce(tiles, 1) - 1), t -> struct(least(tile_of, t) AS i, greatest(tile_of, t) AS j))")
        out = out.withColumn("pair", F.explode(pairs)).withColumns({"tile_i": F.col("pair.i"), "tile_j": F.col("pair.j")}).drop("pair", "tiles")
    deal = [*keys, "tile_i", "tile_j"]
    return out.repartition(*deal).sortWithinPartitions(*deal)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by integer keys, each with the bounds of its groups."""
    rest: list[pa.RecordBatch] = []

    def ready(table: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bounds = np.flatnonzero(change)
        if last:
            return table, np.append(bounds, table.num_rows), table.slice(table.num_rows)
        return table.slice(0, bounds[-1]), bounds, table.slice(bounds[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        table, bounds, left = ready(pa.Table.from_batches([*rest, batch]), False)
        rest = left.combine_chunks().to_batches()
        if len(bounds) > 1:
            yield table, bounds
    if rest:
        table, bounds, _ = ready(pa.Table.from_batches(rest), True)
        yield table, bounds


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of places a[i] and b[i] as stars with the same components: member and the component's least place."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node that links reach.

    Each round maps every node to its least neighbour (or itself), follows that map twice, and contracts the links;
    links inside one node go. The map never leaves a component and keeps its least node, so when no link is left
    every component is that node. Everything stays in tables; the driver only sees whether links remain.
    """
    left = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-links-0")
    roots: DataFrame | None = None
    step = 0
    while roots is None or not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        low = scratch.save(low, f"{name}-low-{step}")
        up = low.select(F.col("u").alias("p"), F.col("p").alias("q"))
        low = scratch.save(low.join(up, "p").select("u", F.col("q").alias("p")), f"{name}-up-{step}")
        to_a, to_b = low.select(F.col("u").alias("a"), F.col("p").alias("pa")), low.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = left.join(to_a, "a").join(to_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = scratch.save(moved, f"{name}-links-{step + 1}")
        if roots is None:
            roots = low.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = roots.join(low, roots.root == low.u, "left").select("node", F.coalesce("p", "root").alias("root"))
            roots = scratch.save(moved, f"{name}-roots-{step}")
        step += 1
    return roots

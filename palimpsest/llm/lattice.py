"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to blocks of eight dimensions, once for each table, and each block is decoded to its
nearest point of the E8 lattice; the points of a table name its cell. A vector also probes the neighbouring cells
that are nearest to it. Vectors that meet in a cell, one of them at home there, are brought there and compared by cosine. A pair that
meets more than once counts where it meets first, which both rows show by themselves, so no pairs are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship, task
from .graph import components, groups, stars, tiled
from .vectors import matrix, usable

#: Neighbouring cells that a vector probes in each table, and rows of a tile.
PROBES, TILE = 4, 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [[s / 2 for s in signs] for signs in product((1, -1), repeat=8) if math.prod(signs) == 1]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum (D8) to each row."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point to each row: the closer of the nearest in D8 and in D8 moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


class Hash:
    """Cells of unit vectors in every table, home first and then the probed ones."""

    def __init__(self, width: int, blocks: int, probes: int = PROBES, seed: int = 8):
        """Three tables a block; unit vectors are ``scale`` lattice units long, on average, in each block."""
        rng = np.random.default_rng([seed, width, blocks])
        tables, scale = 3 * blocks, 1.3 * math.sqrt(2 / blocks)
        self.blocks, self.probes = blocks, probes
        self.turn = [np.linalg.qr(rng.standard_normal((max(width, 8 * blocks), 8 * blocks)))[0][:width] * scale * math.sqrt(width / 8) for _ in range(tables)]
        self.shift = rng.uniform(0, 2, (tables, 8 * blocks))
        self.roots = roots()
        self.weight = rng.integers(1, 2**63, (tables, 8 * blocks), dtype=np.uint64) | np.uint64(1)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) of 64-bit cell names."""
        out = np.empty((len(unit), len(self.turn), 1 + self.probes), np.int64)
        for t, turn in enumerate(self.turn):
            x = (unit @ turn + self.shift[t]).reshape(-1, 8)
            point = nearest(x)
            off = (x - point) @ self.roots.T
            # the next cells: one block moves by one of the shortest vectors, those that cost least first
            off = off.reshape(len(unit), self.blocks * len(self.roots))
            next_ = np.argpartition(-off, self.probes, axis=1)[:, : self.probes]
            doubled = np.rint(2 * point).astype(np.int64).reshape(len(unit), 8 * self.blocks)
            home = (doubled.view(np.uint64) * self.weight[t]).sum(1, dtype=np.uint64)
            out[:, t, 0] = self._name(home)
            step = np.rint(2 * self.roots).astype(np.int64).view(np.uint64)
            by_root = np.stack([(step * self.weight[t, 8 * b : 8 * b + 8]).sum(1, dtype=np.uint64) for b in range(self.blocks)]).ravel()
            out[:, t, 1:] = self._name(home[:, None] + by_root[next_])
        return out

    @staticmethod
    def _name(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> np.uint64(31)) * _MIX
        return (x ^ x >> np.uint64(29)).view(np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; over their largest component first, so that no square leaves the range of a double."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def blocks_for(n: int) -> int:
    """Blocks of a table, so that cells stay small: two up to a million vectors, one more for each further thousandfold."""
    return 2 if n < 10**6 else 2 + math.ceil(math.log10(n / 10**6) / 3 + 1e-9)


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of cell tables (pairs, tables, 1 + probes): whether they meet in each table, in x's home or in y's."""
    return np.stack([(x[:, :, :1] == y).any(2), (y[:, :, :1] == x).any(2)], axis=2)


def near_duplicates(vectors: DataFrame, at_least: float = 0.95, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Links are pairs found with cosine >= ``at_least`` in double precision. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows without an id, link with nothing: no links, their own id as component.
    Equal vectors, repeated rows included, are one vector with a count and link with each other. Vectors of different
    sizes count as filled up with zeros. Labels and other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    ship(spark)
    rows = vectors.select("vec_id", "embedding")
    keyed = usable(rows).filter("exists(embedding, x -> x <> 0)").select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    distinct = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"), F.max(F.size("embedding")).alias("width"))
    distinct = scratch.save(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    facts = distinct.agg(F.max("width").alias("width"), F.count(F.lit(1)).alias("n")).first()
    if not facts["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width, blocks = facts["width"], blocks_for(facts["n"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Hash(width, blocks)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = by.cells(_unit(matrix(part.column("embedding"), width)))
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(found.reshape(len(found), -1).tolist(), pa.list_(pa.int64()))], names=["uid", "cells"])

    each = 1 + PROBES
    placed = scratch.save(distinct.select("uid", "embedding").mapInArrow(task(cells), "uid long, cells array<long>"), "cells")
    at = F.posexplode("cells").alias("place", "cell")
    codes = placed.select("uid", at).select("uid", (F.col("place") / each).cast("int").alias("t"), "cell", (F.col("place") % each == 0).alias("home"))
    # only vectors that meet another in a cell go there with their components
    meet = codes.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("any")).filter("m > 1 AND any").select("t", "cell")
    meeting = scratch.save(codes.join(meet, ["t", "cell"]).select("uid", "t", "cell", "home"), "meet")
    full = distinct.select("uid", "n", F.col("embedding").alias("v")).join(placed, "uid")
    dealt = tiled(meeting.join(full, "uid"), ["t", "cell"], "uid", TILE, scratch, "heavy")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups(batches, ["t", "cell", "tile_i", "tile_j"]):
            yield from _compare(table, bounds, at_least, width)

    # b is null in rows that count links of a, and the other end in links
    found = scratch.save(dealt.mapInArrow(task(compare), "a long, b long, n long"), "found")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("more"))
    root = components(found.filter("b IS NOT NULL").select("a", "b"), scratch, "lattice")
    rooted = distinct.select("h1", "h2", "uid", "n", "first").join(root, F.col("uid") == F.col("node"), "left").join(counts, "uid", "left")
    rooted = scratch.save(rooted.select("h1", "h2", "first", F.coalesce("root", "uid").alias("root"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("h1", "h2", "n_links", "component_id"), "named")
    linked = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    fine = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    alone = rows.filter(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _compare(table: pa.Table, bounds: np.ndarray, at_least: float, width: int) -> Iterator[pa.RecordBatch]:
    home = table.column("home").to_numpy()
    size = np.diff(bounds)
    some = np.flatnonzero((size > 1) & (np.add.reduceat(home.astype(np.int64), bounds[:-1]) > 0))
    if not len(some):
        return
    uid, n, t, cell = (table.column(c).to_numpy() for c in ("uid", "n", "t", "cell"))
    own, i, j = (table.column(c).to_numpy() for c in ("tile_of", "tile_i", "tile_j"))
    v, cells = (table.column(c).combine_chunks() for c in ("v", "cells"))
    cells = cells.flatten().to_numpy().reshape(len(cells), -1, 1 + PROBES)
    unit = _unit(matrix(v, width))
    counted: dict[str, list[np.ndarray]] = {"a": [], "n": [], "x": [], "y": []}
    for g in some:
        s = slice(bounds[g], bounds[g + 1])
        at_home = home[s]
        near = unit[s] @ unit[s].T >= at_least - 1e-9
        near &= at_home[:, None] | at_home[None, :]
        if i[s.start] != j[s.start]:
            near &= own[s][:, None] != own[s][None, :]
        x, y = np.nonzero(np.triu(near, 1))
        x, y = x + s.start, y + s.start
        fine = (uid[x] != uid[y]) & ((unit[x] * unit[y]).sum(1) >= at_least)
        x, y = x[fine], y[fine]
        for lo in range(0, len(x), 20_000):
            a, b = x[lo : lo + 20_000], y[lo : lo + 20_000]
            ca, cb = cells[a], cells[b]
            meets = _meet(ca, cb)
            here = t[s.start]
            first = ~meets[:, :here].any((1, 2))
            names = np.where(meets[:, here], np.stack([ca[:, here, 0], cb[:, here, 0]], 1), np.iinfo(np.int64).max)
            first &= names.min(1) == cell[s.start]
            a, b = a[first], b[first]
            if not len(a):
                continue
            counted["a"] += [uid[a], uid[b]]
            counted["n"] += [n[b], n[a]]
            member, root = stars(a, b)
            counted["x"].append(uid[member])
            counted["y"].append(uid[root])
    if counted["a"]:
        ids, at = np.unique(np.concatenate(counted["a"]), return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, np.concatenate(counted["n"]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(total)], names=["a", "b", "n"])
        x, y = np.concatenate(counted["x"]), np.concatenate(counted["y"])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], names=["a", "b", "n"])

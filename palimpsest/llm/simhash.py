"""SimHash near-duplicates, found over covering-code anchors.

Two fingerprints with at most three differing bits differ in at most one bit of their lower or of their upper 32
bits. For each half the anchors are the words of the Hamming code on 31 bits times the 32nd bit: a code of
covering radius 1, so every half has a home anchor within that radius, and a half that differs from it in one more
bit lies within radius plus threshold, 2, of the same anchor. Each fingerprint is replicated to the 17 anchors
there, at most, and compared per anchor with those at home in it. That finds every link. A crowded anchor is parted
further, by the bytes of the other half, where that saves comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, ship, task
from .graph import components, groups, stars, tiled

WIDTH = 3
THRESHOLD = 3
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of one anchor that are compared in one piece.
TILE = 1024


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bits that more than half of the shingles' hashes have; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()  # splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    stop = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], stop[: -width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(start, stop[width - 1 :].tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    over = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in carry), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4_000_000):
                fp = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*map(part.column, carry), pa.array(fp.view(np.int64))], names=[*carry, "fp"])

    return docs.select(*carry, "text").mapInArrow(task(run), schema)


def _syndromes() -> np.ndarray:
    """For each byte of a 31-bit word, the exclusive or of the (1-based) places of its set bits."""
    place = np.arange(1, 33)
    place[31] = 0  # the 32nd bit isn't part of the code
    return np.array([[np.bitwise_xor.reduce(np.append(place[8 * k : 8 * k + 8][[bool(v >> i & 1) for i in range(8)]], 0)) for v in range(256)] for k in range(4)])


def _flips() -> np.ndarray:
    """For each syndrome, masks that lead to the code words within distance 2, the home word first; 0 fills up."""
    out = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        masks = [1 << s - 1] + [1 << i - 1 | 1 << (i ^ s) - 1 for i in range(1, 32) if i < i ^ s and i != s]
        out[s, : len(masks)] = masks
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home anchor of each 32-bit half, and all 17 within radius plus threshold (some may repeat the home)."""
    table, flips = _syndromes(), _flips()
    of = np.bitwise_xor.reduce([table[k][half >> np.uint32(8 * k) & np.uint32(255)] for k in range(4)])
    words = half[:, None] ^ flips[of]
    words[of == 0, 1:] = words[of == 0, :1]
    other = words[:, :1] ^ np.uint32(1 << 31)
    return words[:, 0], np.concatenate([words, other], axis=1)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fp = batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(all_fp), 20_000):
            fp = all_fp[i : i + 20_000]
            for k in (0, 1):
                half = (fp >> np.uint64(32 * k)).astype(np.uint32)
                home, near = anchors(half)
                is_home = near == home[:, None]
                keep = ~is_home
                keep[:, 0] = True
                key = near.astype(np.int64) | np.int64(k << 32)
                wide = np.broadcast_to(fp.view(np.int64)[:, None], near.shape)
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(wide[keep]), pa.array(is_home[keep])], names=["anchor", "fp", "home"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in groups(batches, ["anchor", "part", "tile_i", "tile_j"]):
        fp, home = table.column("fp").to_numpy(), table.column("home").to_numpy()
        own, i, j = (table.column(c).to_numpy() for c in ("tile_of", "tile_i", "tile_j"))
        size = np.diff(bounds)
        with_home = np.add.reduceat(home.astype(np.int64), bounds[:-1]) > 0
        xs, ys = [], []
        for g in np.flatnonzero((size > 1) & with_home):
            s = slice(bounds[g], bounds[g + 1])
            v, at_home = fp[s], home[s]
            left = np.flatnonzero(at_home)
            near = np.bitwise_count(v[left].view(np.uint64)[:, None] ^ v.view(np.uint64)[None, :]) <= THRESHOLD
            if i[s.start] != j[s.start]:
                near &= own[s][left][:, None] != own[s][None, :]
            a, b = np.nonzero(near)
            a = left[a]
            other = v[a] != v[b]
            if other.any():
                member, root = stars(a[other], b[other])
                xs.append(v[member])
                ys.append(v[root])
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["a", "b"])


#: The bytes of the half that an anchor isn't of, each with its place.
_PARTS = "transform(sequence(0, 3), b -> 256 * b + cast(shiftrightunsigned(fp, if(anchor < 4294967296, 32, 0) + 8 * b) & 255 as int))"


def _narrowed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``part``, within which they are compared; -1 where an anchor isn't parted.

    Links differ in at most three of the four bytes of the other half, so a crowded anchor can be parted by the value of
    each byte and no link is lost. That is done where it halves the comparisons at least; fingerprints that are
    alike in most bytes stay together.
    """
    crowded = scratch.save(rows.groupBy("anchor").count().filter(F.col("count") > TILE).select("anchor", F.col("count").cast("double").alias("m")), "crowded")
    if crowded.isEmpty():
        return rows.withColumn("part", F.lit(-1))
    sizes = rows.join(crowded, "anchor").select("anchor", "m", F.explode(F.expr(_PARTS)).alias("part")).groupBy("anchor", "m", "part").count()
    work = sizes.groupBy("anchor", "m").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("work"))
    narrow = scratch.save(work.filter("2 * work < m * m").select("anchor", F.lit(True).alias("narrow")), "narrow")
    parts = F.when(F.col("narrow"), F.expr(_PARTS)).otherwise(F.array(F.lit(-1)))
    return rows.join(narrow, "anchor", "left").select("anchor", "fp", "home", F.explode(parts).alias("part"))


def _rooted(by_doc: DataFrame, first: Column, scratch: Scratch) -> DataFrame:
    """(fp, first, root) of each distinct fingerprint; ``first`` is an aggregate of its rows, root names the component."""
    distinct = scratch.save(by_doc.groupBy("fp").agg(first.alias("first")), "distinct")
    rows = distinct.select("fp").mapInArrow(task(_replicate), "anchor long, fp long, home boolean")
    dealt = tiled(_narrowed(rows, scratch), ["anchor", "part"], "fp", TILE, scratch, "heavy")
    links = dealt.mapInArrow(task(_compare), "a long, b long")
    roots = components(links, scratch, "simhash")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return scratch.save(rooted, "rooted")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the least doc_id of a component.

    Texts are lower-cased (A-Z) and cut into shingles of three words; null texts count as empty, and all texts
    without words share fingerprint 0 and so one component. Equal fingerprints meet once, as one fingerprint.
    Repeated rows each give a row; a component of null ids only has a null component_id. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    by_doc = scratch.save(fingerprints(docs), "fingerprints")
    rooted = _rooted(by_doc, F.min("doc_id"), scratch)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.save(rooted.join(least, "root").select("fp", "component_id"), "named")
    return by_doc.join(named, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row of each component, all columns: that with the least (doc_id, hash of the text), null ids last.

    Rows are known by hashes of id and text; of rows equal in both, the one with the least hash of all columns stays.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    hashes = F.xxhash64(F.col("doc_id").isNull(), "doc_id"), F.xxhash64("text")
    by_doc = scratch.save(fingerprints(docs.select("doc_id", "text", hashes[0].alias("k"), hashes[1].alias("t")), carry=("doc_id", "k", "t")), "fingerprints")
    rooted = _rooted(by_doc, F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "t", "k")), scratch)
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias("__k"), F.col("first.t").alias("__t"))
    every = [docs[f"`{c}`"] for c in docs.columns]
    kept = docs.select(F.struct(*every).alias("__row"), F.xxhash64(*every).alias("__all"), hashes[0].alias("__k"), hashes[1].alias("__t")).join(first, ["__k", "__t"], "left_semi")
    return kept.groupBy("__k", "__t").agg(F.min_by("__row", "__all").alias("__row")).select("__row.*")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row; cases as in near_duplicates."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

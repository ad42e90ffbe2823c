"""Best-fit packing of tokenized documents, planned over a histogram of lengths.

Only the counts of each length (at most one row a length) reach the driver. It packs counts, longest first: pieces
of one length go to the bins with the least room that still takes them, all bins of one history at once. The plan
is a list of runs: pieces of a length, from a rank on, fill a range of bins from an offset on. Pieces then take
their slots by their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import latin
from .common import Scratch, chunks, heavy, ship, task

CAPACITY = 2048
#: Bytes that a worker's table of words may take, about, and pieces of one length that are ranked in one go.
KEEP, RANKED = 120_000_000, 100_000
_LOWER = bytes(ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256))


class _Words(dict):
    """Ids of words that were met, as little-endian bytes.

    Two generations: beyond half of ``limit`` bytes the words become the elder ones, and the elder ones before go;
    a word that is met again among the elder is young again.
    """

    def __init__(self, encode: Callable[[str | bytes], list[int]], limit: int):
        self.encode, self.most, self.size, self.elder = encode, limit // 2, 0, {}

    def __missing__(self, word: str | bytes) -> bytes:
        ids = self.elder.get(word)
        if ids is None:
            found = array("I", self.encode(word))
            if sys.byteorder == "big":
                found.byteswap()
            ids = found.tobytes()
        self.size += len(word) + len(ids) + 200  # two objects and a place in the table
        if self.size > self.most:
            self.elder, self.size = self.copy(), 0
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space: words that were met are looked up.

    The tokenizer's own markers in a text are single ids, as by its default. Between them, Latin-1 texts are cut into
    the tokenizer's words here, lower-cased and composed already, and the model alone encodes those; other texts are
    cut at spaces and go through the whole tokenizer.
    """

    def __init__(self, config: str, limit: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        parts = json.loads(config)
        markers = {m["content"]: np.array([m["id"]], "<u4").tobytes() for m in parts["added_tokens"]}
        self.markers, self.between = markers, re.compile("|".join(map(re.escape, sorted(markers, key=len, reverse=True))))
        tokenize, letters = self.tokenizer.model.tokenize, _alphabet()
        whole = self.tokenizer.encode
        self.narrow_ids = _Words(lambda w: [t.id for t in tokenize(w.decode("latin-1").encode().decode("latin-1").translate(letters))], limit)
        self.wide_ids = _Words(lambda w: whole(w, add_special_tokens=False).ids, limit)
        # the tokenizer's own split of lower-cased text
        self.narrow = latin(("[L]+", "'s|'t|'re|'ve|'m|'ll|'d", "[N]", "[^SLN]+"))

    def _plain(self, text: str) -> bytes:
        try:
            return b"".join(map(self.narrow_ids.__getitem__, self.narrow(text.encode("latin-1").translate(_LOWER))))
        except UnicodeEncodeError:
            return b"".join(map(self.wide_ids.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            if not text:
                yield b""
            elif any(m in text for m in self.markers):
                found = self.between.findall(text)
                plain = map(self._plain, self.between.split(text))
                yield b"".join([next(plain), *(x for m, p in zip(found, plain, strict=True) for x in (self.markers[m], p))])
            else:
                yield self._plain(text)


def _alphabet() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _encoder(config: str) -> WordEncoder:
    return heavy(("packing", hash(config)), lambda: WordEncoder(config))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first bin, pieces a bin, offset) sorted by length and rank, and the number of bins."""
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # of room, ascending

    def put(size: int, first: int, count: int) -> None:
        if count and size:
            if size not in room:
                room[size] = []
                bisect.insort(sizes, size)
            room[size].append((first, count))

    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if (at := bisect.bisect_left(sizes, length)) < len(sizes):
                size = sizes[at]
                first, count = room[size].pop()
                if not room[size]:
                    del room[size], sizes[at]
            else:
                size, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            each = size // length
            used = min(count, -(-left // each))
            placed = min(left, used * each)
            runs.append((length, rank, first, each, capacity - size))
            full, over = divmod(placed, each)
            put(size - each * length, first, full)
            put(size - over * length, first + full, used - full)
            put(size, first + used, count - used)
            rank, left = rank + placed, left - placed
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 5), bins


def slots(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces, by length and rank within it."""
    run = runs[np.searchsorted(runs[:, 0] << 40 | runs[:, 1], length << 40 | rank, side="right") - 1]
    in_run = rank - run[:, 1]
    return run[:, 2] + in_run // run[:, 3], run[:, 4] + in_run % run[:, 3] * length


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text's ids with ``end`` appended, cut at ``capacity``."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, size = _encoder(config.value), end.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for part in chunks(batch, "text", 500_000):
                at, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encoder.encode(part.column("text").to_pylist())):
                    ids += last
                    for k in range(0, len(ids), size):
                        one = ids[k : k + size]
                        at.append(i), piece.append(k // size), length.append(len(one) // 4), crc.append(zlib.crc32(one))
                number = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(task(run), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every row's whole text packed into sequences of ``capacity`` ids.

    Null and empty texts are one piece of one id. Repeated rows are packed as often as they come; columns other
    than doc_id and text are ignored. Ranks are taken within (length, hashed bucket) and moved up by what earlier
    buckets of the length hold, so no task holds all pieces of a common length.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    cut = scratch.save(pieces(docs, capacity=capacity), "pieces")
    buckets, rows = 64, cut.count()
    while buckets * RANKED < rows:
        buckets *= 2
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = scratch.save(cut.groupBy("length", "bucket").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(histogram, capacity)[0])
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_, offset = slots(runs.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bin_), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = T.StructType([*cut.select(kept).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*kept, "rank").mapInArrow(task(place), schema)

"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

Words of one length bucket form the rows of a padded matrix of token ids. Each round every row merges its
leftmost pair of minimum rank: ranks come from a hashed pair table, the merged column is squeezed out of the
matrix, and rows without a pair left leave it. Words longer than the largest bucket merge by a heap, with the
same order of merges. A document is split by the tokenizer's pattern; each distinct word is encoded once per
batch and kept in a bounded table of the worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, heavy, ship, task

BUCKETS = (2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
_BUCKET = [next(b for b in BUCKETS if b >= n) for n in range(BUCKETS[-1] + 1)]
NONE = np.int32(2**31 - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a worker keeps.
KEEP = 800_000


class PairTable:
    """Open-addressed hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        left_over = np.arange(len(key))
        while len(left_over):
            s = slot[left_over]
            free = self.keys[s] == -1
            self.keys[s[free]] = key[left_over[free]]  # of several at one slot the last stays
            placed = self.keys[s] == key[left_over]
            self.ranks[s[placed]] = rank[left_over[placed]]
            left_over = left_over[~placed]
            slot[left_over] = (slot[left_over] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where the pair doesn't merge; a negative id never merges."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1) & (right >= 0) & (left >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            s = slot[open_]
            hit = self.keys[s] == key[open_]
            out[open_[hit]] = self.ranks[s[hit]]
            open_ = open_[~hit & (self.keys[s] != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBPE:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.split = regex.compile(pattern).findall
        self.narrow = _narrow(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(rank, np.int32))
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, r in self.ranks.items():
            by_id[r] = token
        self._bytes = _ragged(by_id)
        self._decimal = _ragged([b"%d " % i for i in range(size)])
        self.known: dict[str | bytes, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian int32 bytes."""
        out = [b""] * len(words)
        by_bucket: dict[int, list[int]] = {b: [] for b in BUCKETS}
        rows = [by_bucket[b] for b in _BUCKET]
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:  # a word that is a token is never merged from its bytes
                out[i] = whole.to_bytes(4, "little")
            elif len(w) >= len(rows):
                out[i] = self._by_heap(w)
            elif w:
                rows[len(w)].append(i)
        for width, rows in by_bucket.items():
            for start in range(0, len(rows), step := max(1, 2_000_000 // width)):
                self._matrix(width, rows[start : start + step], words, out)
        return out

    def _matrix(self, width: int, rows: list[int], words: list[bytes], out: list[bytes]) -> None:
        row = np.array(rows)
        size = np.array([len(words[i]) for i in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
        rank = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(at)), at]
            if len(done := np.flatnonzero(best == NONE)):
                for i, r, n in zip(row[done].tolist(), ids[done], size[done].tolist(), strict=True):
                    out[i] = r[:n].tobytes()
                going = best != NONE
                row, size, ids, rank, at, best = row[going], size[going], ids[going], rank[going], at[going], best[going]
            if not len(row):
                return
            n, width = ids.shape
            each = np.arange(n)
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            size = size - 1
            if width == 2:
                rank = np.full((n, 1), NONE, np.int32)
                continue
            keep = np.ones(rank.shape, bool)
            keep[each, np.minimum(at + 1, width - 2)] = False
            rank = rank[keep].reshape(n, width - 2)
            has = at > 0
            rank[each[has], at[has] - 1] = self.pairs.look_up(ids[each[has], at[has] - 1], best[has])
            has = at < width - 2
            rank[each[has], at[has]] = self.pairs.look_up(best[has], ids[each[has], at[has] + 1])

    def _by_heap(self, word: bytes) -> bytes:
        """The same merges for one long word, by a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(word)
        end = [*range(1, n + 1)]  # of the part that starts here, 0 once it is merged into the one before
        before = [*range(-1, n - 1)]
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
                heapq.heappush(heap, (r, b, i, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return np.array(ids, np.int32).tobytes()

    def _cut(self, text: str | None) -> list[str] | list[bytes]:
        """The pattern's matches; as Latin-1 bytes where the text has such characters only, which is faster to split."""
        if not text:
            return []
        if self.narrow is None:
            return self.split(text)
        try:
            return self.narrow(text.encode("latin-1"))
        except UnicodeEncodeError:
            return self.split(text)

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null: empty)."""
        cut = [self._cut(t) for t in texts]
        words = set().union(*cut)
        if new := [w for w in words if w not in self.known]:
            if len(self.known) + len(new) > KEEP:
                self.known.clear()
                new = list(words)
            plain = [(w.decode("latin-1") if isinstance(w, bytes) else w).encode() for w in new]
            self.known.update(zip(new, self.encode_words(plain), strict=True))
        ids = self.known.__getitem__
        for found in cut:
            yield np.frombuffer(b"".join(map(ids, found)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return _take(self._bytes, ids).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return _take(self._decimal, ids).tobytes()[:-1]


def latin(parts: tuple[str, ...]):
    """findall over Latin-1 bytes for alternatives in which [SLN] stand for the classes of white space, letters, numbers."""
    of = {c: "".join(re.escape(chr(i)) for i in range(256) if regex.match(p, chr(i))) for c, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    classes = [re.sub(r"[SLN](?=[SLN\]])", lambda m: of[m[0]], p) for p in parts]
    return re.compile("|".join(classes).encode("latin-1")).findall


def _narrow(pattern: str):
    """The public pattern over Latin-1 bytes; none for other patterns."""
    parts = (" ?[L]+", "'s|'t|'re|'ve|'m|'ll|'d", " ?[N]+", " ?[^SLN]+", "[S]+(?![^S])", "[S]+")
    return latin(parts) if pattern == public_tokenizers.PATTERN else None


def _ragged(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int32)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size, dtype=np.int32) - size, size


def _take(ragged: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    flat, start, size = ragged
    n = size[ids]
    stop = np.cumsum(n, dtype=np.int32 if len(ids) < 10_000_000 else np.int64)
    at = np.arange(stop[-1] if len(stop) else 0, dtype=stop.dtype)
    at += np.repeat(start[ids] - (stop - n), n)
    return flat[at]


def tokenizer(rank_file: bytes, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """One per worker and rank file."""
    return heavy(("bpe", hash(rank_file), pattern), lambda: ByteBPE(rank_file, pattern))


def encode_documents(docs: DataFrame, rank_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole ``text``: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Null texts count as empty (no tokens, the hashes of an empty string); repeated rows each give a row; columns
    other than doc_id and text are ignored. No shuffle: every partition is encoded where it is read.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks.value)
        for batch in batches:
            for part in chunks(batch, "text", 2_000_000):
                n, hashes, decoded, ids = [], [], [], []
                for x in bpe.encode_batch(part.column("text").to_pylist()):
                    n.append(len(x))
                    hashes.append(hashlib.sha256(bpe.decimal(x)).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(x)).hexdigest())
                    if with_ids:
                        ids.append(x)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(task(run), T.StructType(fields))

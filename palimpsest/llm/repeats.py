"""Suffix-array dedup: every byte covered by a 400-byte string that starts anywhere else goes.

Each window of 400 bytes has an anchor, its 64-byte gram of least hash, so equal windows have equal anchors at equal
places. Per document an anchor's windows make one stretch of text, its context. Anchors whose gram occurs more than
once bring their contexts together, a context that occurs in several places only once. There the contexts' suffixes
from the anchor on, and reversed prefixes up to it, are sorted; the common extensions of neighbours give the windows
that two contexts share. Windows that repeat within a document are found there.

Grams with very many different contexts are dealt out anew: the windows that begin in one part of the places around
the anchor have a longer string in common, so contexts meet by (part, that string). Parts are narrowed until a
group is small enough to be sorted, or is one window that all its contexts have. A context is in one group a part at
most, so rows stay in proportion to the contexts.

Contexts and windows count as equal by 128 bits of SHA-256 over their bytes, extensions by the bytes themselves; the
polynomial hashes only bring candidates together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship, task
from .graph import groups
from .suffixes import Suffixes, least_in, prefixes, windows

LENGTH, GRAM = 400, 64
#: Different contexts of one group that are sorted together; groups with more are dealt out by PARTS of their places.
TOGETHER, PARTS = 500, 4
#: Windows of a document that are searched in one go; longer documents are taken in stretches.
STRETCH = 1 << 20
_PLACE = 22  # bits for a place in a stretch, below the bits of a gram's hash


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Windows repeated within one stretch of a document, as spans (start, stop), and its anchors (gram, place, low, high).

    An anchor at a place stands for the windows that begin low to high from it, both at most 0. Of windows that
    repeat within the stretch, the first stands for all.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    prefix = prefixes(data)
    whole = windows(prefix, length)
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    first, repeated = np.ones(len(whole), bool), np.zeros(len(whole), bool)
    if same.any():
        raw = data.tobytes()
        a, b = order[:-1][same], order[1:][same]
        equal = np.array([raw[i : i + length] == raw[j : j + length] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        first[b[equal]] = False
        repeated[a[equal]] = repeated[b[equal]] = True
    del whole, order, same
    start, stop = _runs(np.flatnonzero(repeated), length)
    grams = windows(prefix, gram)
    key = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << _PLACE) - 1)
    at = (least_in(key, length - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    begin = np.flatnonzero(first)
    at = at[begin]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    place = at[head]
    return start, stop, grams[place].view(np.int64), place, begin[head] - place, begin[tail] - place


def _digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of SHA-256 of each part, as two signed longs."""
    both = np.frombuffer(b"".join([hashlib.sha256(x).digest()[:16] for x in parts]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _contexts(raw: bytes, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> list[bytes]:
    """Contexts with their bounds before them: equal where bytes and bounds are."""
    return [b"%d %d " % (i, j) + raw[p + i : p + j + length] for p, i, j in zip(place.tolist(), low.tolist(), high.tolist(), strict=True)]


def _runs(begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans covered by windows that begin at ascending places."""
    if not len(begin):
        return begin, begin
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > begin[:-1] + length]))
    return begin[new], begin[np.append(new[1:], len(begin)) - 1] + length


def shared(data: np.ndarray, bounds: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in groups of one gram, the least and greatest window place shared with another context.

    ``begin`` (and the end of the data) bound the contexts in ``data``; their anchors are ``-low`` further on.
    Where no window is shared the least is greater than the greatest.
    """
    anchor, end = begin[:-1] - low, begin[1:]
    right = Suffixes(data, anchor, end)
    left = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - anchor, len(data) - begin[:-1])
    sides = []
    for s in (right, left):
        order = s.sort(bounds)
        before = s.neighbours(order, bounds)
        after = np.append(before[1:], -1)
        most = np.empty(len(order), np.int64)
        most[order] = np.maximum(before, after)
        sides.append((order, before, most))
    (right_order, right_before, right_most), (left_order, left_before, left_most) = sides
    first, last = np.maximum(low, -left_most), np.minimum(high, right_most - length)
    size = np.diff(bounds)
    lonely = np.repeat(size < 2, size)
    first[lonely], last[lonely] = 1, 0
    hopeful = np.add.reduceat((first <= last).astype(np.int64), bounds[:-1]) > 0
    # two contexts share all that both extensions allow; of more, the best on either side need not be one and the same
    for g in np.flatnonzero((size > 2) & hopeful):
        s = slice(bounds[g], bounds[g + 1])
        _narrow(first[s], last[s], right_order[s] - s.start, right_before[s], left_order[s] - s.start, left_before[s], length)
    return first, last


def _narrow(first: np.ndarray, last: np.ndarray, right: np.ndarray, right_before: np.ndarray, left: np.ndarray, left_before: np.ndarray, length: int) -> None:
    """Move the bounds of one group's contexts inwards, in place, to window places that another context shares.

    A window at place o is shared by contexts with ``-o`` common bytes to the left and ``length + o`` to the right of
    the anchor: by those in one class of both sorted orders.
    """
    seen: dict[int, np.ndarray] = {}

    def at(o: int) -> np.ndarray:
        if o not in seen:
            classes = np.empty((2, len(first)), np.int64)
            classes[0, right] = np.cumsum(right_before < length + o)
            classes[1, left] = np.cumsum(left_before < -o)
            key = classes[0] * (len(first) + 1) + classes[1]
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            seen[o] = count[back] > 1
        return seen[o]

    for bound, step in ((first, 1), (last, -1)):
        open_ = first <= last
        while open_.any():
            for o in np.unique(bound[open_]).tolist():
                here = open_ & (bound == o)
                hit = at(o)
                open_ &= ~(here & hit)
                bound[here & ~hit] += step
            open_ &= first <= last


def _binary(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint8) for x in column.cast(pa.large_binary())]


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeats within documents and anchors; a row that a task meets again counts once more, and no more than that."""
    met: dict[tuple[int, int], int] = {}
    for batch in batches:
        out: list[list[np.ndarray]] = []
        rows = 0
        for k, t, data in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), _binary(batch.column("text")), strict=True):
            met[k, t] = met.get((k, t), 0) + 1
            if met[k, t] > 2:
                continue
            for begin in range(0, max(1, len(data) - length + 1), STRETCH):
                part = data[begin : begin + STRETCH + length - 1]
                start, stop, gram, place, low, high = anchors(part, length)
                n = len(start) + len(place)
                if not n:
                    continue
                c1, c2 = _digests(_contexts(part.tobytes(), place, low, high, length))
                zero = np.zeros(len(start), np.int64)
                out.append([np.full(n, k), np.full(n, t), np.arange(n) >= len(start), np.append(zero, gram), np.append(zero, c1), np.append(zero, c2), np.append(start, place) + begin, np.append(zero, low), np.append(stop - start - length, high)])
                rows += n
                if rows > 100_000:
                    yield _batch(out)
                    out, rows = [], 0
        if out:
            yield _batch(out)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a document is asked for; repeated rows give them once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for k, t, data, xs in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), _binary(batch.column("text")), batch.column("xs"), strict=True):
            if (k, t) in seen:
                continue
            seen.add((k, t))
            h, c1, c2, m, ask, a, low, high = (xs.values.field(i) for i in range(8))
            start = np.add(a, low).tolist()
            stop = (np.add(a, high) + length).tolist()
            yield pa.RecordBatch.from_arrays([h, h, c1, c2, m, ask, low, high, pa.array([data[i:j].tobytes() for i, j in zip(start, stop, strict=True)], pa.binary())], names=["g", "h", "c1", "c2", "m", "ask", "low", "high", "bytes"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, h, c1, c2) without those equal to the one before."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("g", "h", "c1", "c2")])
        new = np.concatenate([[last != tuple(keys[:, 0].tolist())], (keys[:, 1:] != keys[:, :-1]).any(0)])
        last = tuple(keys[:, -1].tolist())
        yield batch.filter(pa.array(new))


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For contexts of one group, the bounds of the windows that another has; those that needn't ask only bear witness."""
    for table, bounds in groups(_once(batches), ["g"]):
        low, high, ask = (table.column(x).to_numpy() for x in ("low", "high", "ask"))
        parts = table.column("bytes").to_pylist()
        i = 0
        while i < len(bounds) - 1:  # whole groups, about 2 MB of contexts at a time
            to = i + 1
            while to < len(bounds) - 1 and bounds[to + 1] - bounds[i] <= 4000:
                to += 1
            s = slice(bounds[i], bounds[to])
            begin = np.cumsum([0, *map(len, parts[s])])
            first, last = shared(np.frombuffer(b"".join(parts[s]), np.uint8), bounds[i : to + 1] - bounds[i], begin, low[s], high[s], length)
            hit = (first <= last) & ask[s]
            yield pa.RecordBatch.from_arrays([*(table.column(x).slice(s.start, s.stop - s.start).combine_chunks().filter(pa.array(hit)) for x in ("h", "c1", "c2")), pa.array(first[hit]), pa.array(last[hit])], names=["h", "c1", "c2", "low", "high"])
            i = to


def _split(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """Contexts by parts of their window places, ``step`` places each: with the string that windows of a part share as group."""
    for batch in batches:
        out: list[tuple] = []
        for row, (h, low, high, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h", "low", "high", "bytes")), strict=True)):
            for part in range(-high // step, -low // step + 1):  # places -part * step down to -(part + 1) * step + 1
                last, first = -part * step, -(part + 1) * step + 1
                lo, hi = max(low, first), min(high, last)
                core = raw[last - low : first + length - low]
                whole = raw[lo - low : hi + length - low]
                out.append((row, lo, hi, b"%d %d " % (h, part) + core, b"%d %d " % (lo, hi) + whole, whole))
        if out:
            row, low, high, core, hull, whole = zip(*out, strict=True)
            (g, _), (u1, u2) = _digests(list(core)), _digests(list(hull))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(u1), pa.array(u2), *(batch.column(c).take(pa.array(row)) for c in ("h", "c1", "c2", "ask")), pa.array(low), pa.array(high), pa.array(whole, pa.binary())],
                names=["g", "u1", "u2", "h", "c1", "c2", "ask", "low", "high", "bytes"],
            )


def spans(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(k, t, spans) of documents keyed (k, t, text): arrays of (start, stop) in bytes, of those that have any."""
    kinds = "k long, t long, anchor boolean, h long, c1 long, c2 long, a long, low long, high long"
    one, n = F.count(F.lit(1)), F.count(F.lit(1)).alias("n")
    long_enough = docs.filter(F.octet_length("text") >= length)
    found = scratch.save(long_enough.mapInArrow(task(lambda b: _found(b, length)), kinds), "anchors")
    many = scratch.save(found.filter("anchor").groupBy("h").count().filter("count > 1").select("h"), "many")
    met = scratch.save(found.filter("anchor").join(many, "h").select("h", "c1", "c2", "k", "t", "a", "low", "high"), "met")
    contexts = scratch.save(met.groupBy("h", "c1", "c2").agg(n, F.min(F.struct("k", "t", "a", "low", "high")).alias("at")), "contexts")
    sizes = scratch.save(contexts.groupBy("h").agg(one.alias("m")).filter("m > 1"), "sizes")
    asked = F.struct("h", "c1", "c2", "m", (F.col("n") == 1).alias("ask"), "at.a", "at.low", "at.high").alias("x")
    needed = contexts.join(sizes, "h").select("at.k", "at.t", asked).groupBy("k", "t").agg(F.collect_list("x").alias("xs"))
    cuts = long_enough.join(needed, ["k", "t"]).select("k", "t", "text", "xs").mapInArrow(task(lambda b: _cut(b, length)), "g long, h long, c1 long, c2 long, m long, ask boolean, low long, high long, bytes binary")
    cuts = scratch.save(cuts, "cuts", compression="zstd")
    bounds = ["h", "c1", "c2", "low", "high"]
    results = [contexts.filter("n > 1").select("h", "c1", "c2", "at.low", "at.high")]
    step, turn = 1 << (length - GRAM).bit_length(), 0  # powers of two, so parts lie within those before
    while True:
        light = cuts.filter(F.col("m") <= TOGETHER).select("g", *bounds, "ask", "bytes").repartition("g").sortWithinPartitions("g", "h", "c1", "c2")
        results.append(light.mapInArrow(task(lambda b: _compare(b, length)), "h long, c1 long, c2 long, low long, high long"))
        crowded = cuts.filter(F.col("m") > TOGETHER)
        if crowded.isEmpty():
            break
        step, turn = max(1, step // PARTS), turn + 1
        dealt = crowded.mapInArrow(task(lambda b, step=step: _split(b, length, step)), "g long, u1 long, u2 long, h long, c1 long, c2 long, ask boolean, low long, high long, bytes binary")
        dealt = scratch.save(dealt, f"dealt-{turn}", compression="zstd")
        # contexts that are one within the part share all its windows; one of them goes on, as a witness
        alike = dealt.groupBy("g", "u1", "u2").agg(n, *(F.first(c).alias(c) for c in (*bounds, "ask", "bytes")))
        alike = scratch.save(alike, f"alike-{turn}", compression="zstd")
        salt = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
        several = alike.filter("n > 1").select("g", "u1", "u2", salt)
        members = dealt.filter("ask").select("g", "u1", "u2", *bounds, F.pmod("c1", F.lit(16)).cast("int").alias("salt"))
        results.append(scratch.save(members.join(several, ["g", "u1", "u2", "salt"]).select(bounds), f"settled-{turn}"))
        sizes = alike.groupBy("g").agg(one.alias("m")).filter("m > 1").select("g", "m", salt)
        cuts = alike.withColumn("salt", F.pmod("u1", F.lit(16)).cast("int")).join(sizes, ["g", "salt"]).select("g", *bounds, "m", (F.col("ask") & (F.col("n") == 1)).alias("ask"), "bytes")
        cuts = scratch.save(cuts, f"cuts-{turn}", compression="zstd")
    result = results[0].select(bounds)
    for r in results[1:]:
        result = result.union(r.select(bounds))
    result = scratch.save(result.groupBy("h", "c1", "c2").agg(F.min("low").alias("low"), F.max("high").alias("high")), "shared")
    for name in ("cuts", *(f"{x}-{i}" for x in ("dealt", "alike", "cuts") for i in range(1, turn + 1))):
        scratch.drop(name)
    across = met.select("h", "c1", "c2", "k", "t", "a").join(result, ["h", "c1", "c2"]).select("k", "t", (F.col("a") + F.col("low")).alias("start"), (F.col("a") + F.col("high") + length).alias("stop"))
    within = found.filter("NOT anchor").select("k", "t", F.col("a").alias("start"), (F.col("a") + F.col("high") + length).alias("stop"))
    return scratch.save(across.union(within).groupBy("k", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")


def _batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["k", "t", "anchor", "h", "c1", "c2", "a", "low", "high"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _keyed(docs: DataFrame) -> tuple[list[Column], Column]:
    """Hashes that tell rows with different ids or texts apart, and the text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", text), F.xxhash64(text)], text


def _with_spans(docs: DataFrame, carry: Column, length: int, scratch: Scratch | None) -> DataFrame:
    """(row, text, spans) of every row; rows with equal ids and texts share their spans. ``carry`` becomes the struct ``row``."""
    scratch = scratch or Scratch(docs.sparkSession)
    ship(docs.sparkSession)
    (k, t), text = _keyed(docs)
    found = spans(docs.select(k.alias("k"), t.alias("t"), text.alias("text")), length, scratch)
    keyed = docs.select(carry.alias("row"), F.col("text"), k.alias("k"), t.alias("t"))
    return keyed.join(found, ["k", "t"], "left").select("row", "text", "spans")


def _kept(data: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merged([(s["start"], s["stop"]) for s in spans or []])
    bounds = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)), runs


def repeat_report(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts count as empty (nothing removed, the hash of no bytes). Rows repeated as a whole, with or without an id,
    are copies of each other, so texts of ``length`` bytes or more lose all of them; each gives a row. An empty table
    gives no rows. Columns other than doc_id and text are ignored. Documents of any length are searched in stretches.
    """
    source = _with_spans(docs, F.struct("doc_id"), length, scratch).select("row.doc_id", "text", "spans")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, s in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, runs = _kept(text or b"", s)
                rows.append((len(text or b""), len(text or b"") - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return source.mapInArrow(task(report), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """The same rows and columns with repeated bytes cut out of ``text``; a character that is cut in part goes whole.

    Null texts stay null, repeated rows stay rows, an empty table stays empty. Columns may have any names.
    """
    rest = [c for c in docs.columns if c != "text"]
    carry = F.struct(*(docs[f"`{c}`"] for c in rest)) if rest else F.struct(F.lit(0).alias("none"))
    source = _with_spans(docs, carry, length, scratch)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else _kept(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    cut = source.mapInArrow(task(trim), T.StructType([source.schema["row"], T.StructField("text", T.StringType())]))
    return cut.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))

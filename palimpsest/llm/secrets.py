"""Secret scans with DataFrame functions only.

Base spans come from fixed patterns; further candidate strings are scored by the Shannon entropy of a sliding
window, whose counts are updated by the character that leaves and the one that enters, against a limit for the
candidate's class of characters. Candidates on the allow list are suppressed. Positions are code points.

Arrays are copied when they grow and places in a text are found from its beginning, so folds go over chunks of items
and cuts over chunks of text: the work grows with the text and its spans, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in order, with pattern, group that is measured, and its least length. Runs are
#: written with their least length at once: a shorter run holds no match either way.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = ((0, ASSIGN, 2, 12), (1, r"AKIA[A-Z0-9]{14,}", 0, 18), (2, r"[0-9a-f]{16,}", 0, 16))
#: Candidate strings for the entropy test, characters of a window, least bits for each class of characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LEAST_BITS = {"hex": 2.8, "alnum": 3.6, "base64": 3.75}
#: What reads as words: runs of small letters, with a capital at most, or of capitals; short words between marks.
_WORD = r"(?:(?:[A-Z]?+[a-z]{3,}+|[A-Z]{3,}+)++[a-z]{0,2}+|[A-Za-z]{1,2}+)"
#: Suppressed: words joined by marks, with one number at most, plain numbers, UUIDs, and placeholders.
ALLOW = (
    rf"^[-_/+=]*+{_WORD}(?:[-_/+=]++{_WORD})*+[-_/+=]*+$",
    r"^[-_/+=0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"^(?:[-_/+=]*+{_WORD})*+[-_/+=]*+[0-9]{{1,4}}+(?:[-_/+=]*+{_WORD})*+[-_/+=]*+$",
    r"(?i)(example|sample|dummy|placeholder|x{6}|0{8}|1234567)",
)
#: Items that are folded in one go, and code points of a chunk of text.
CHUNK, NEAR = 256, 256
_SPANS = "array<struct<start:bigint,kind:int,stop:bigint,word:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, kind: str, value: Callable[[Column], Column], op: Callable[[Column, Column], Column]) -> Column:
    """(x, before) of each item of an array of ``kind``: ``before`` folds the values of the items before it, from 0."""
    zero, none = F.lit(0).cast("long"), F.expr(f"cast(array() AS array<struct<x:{kind},before:bigint>>)")

    def whole(all_: Column) -> Column:
        chunks = F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(CHUNK)), lambda i: F.slice(all_, i + 1, F.lit(CHUNK)))).otherwise(F.expr(f"cast(array() AS array<array<{kind}>>)"))
        return _let(chunks, by_chunk)

    def by_chunk(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda t, x: op(t, value(x))))
        starts = F.aggregate(totals, F.array(zero), lambda s, t: F.array_append(s, op(F.element_at(s, -1), t)))
        return _let(starts, lambda s: F.flatten(F.transform(chunks, lambda c, i: within(c, s[i]))))

    def within(chunk: Column, start: Column) -> Column:
        state = F.struct(start.alias("t"), none.alias("o"))
        return F.aggregate(chunk, state, lambda a, x: F.struct(op(a["t"], value(x)).alias("t"), F.array_append(a["o"], F.struct(x.alias("x"), a["t"].alias("before"))).alias("o")), lambda a: a["o"])

    return _let(items, whole)


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """The matches with their places: what lies between matches and the matches take turns."""
    p = F.lit(pattern)
    turns = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)))
    sized = F.transform(turns, lambda x: F.struct(
        F.char_length(x["0"]).cast("long").alias("gap"), F.coalesce(F.char_length(x["1"]), F.lit(0)).cast("long").alias("size"), F.coalesce(x["1"], F.lit("")).alias("word"),
        F.coalesce(F.char_length(x["2"]) >= least, F.lit(False)).alias("fine"),
    ))
    placed = _running(sized, "struct<gap:bigint,size:bigint,word:string,fine:boolean>", lambda x: x["gap"] + x["size"], lambda a, b: a + b)
    spans = F.transform(F.filter(placed, lambda r: r["x"]["fine"]), lambda r: F.struct(
        (r["before"] + r["x"]["gap"]).alias("start"), F.lit(kind).alias("kind"), (r["before"] + r["x"]["gap"] + r["x"]["size"]).alias("stop"), r["x"]["word"].alias("word"),
    ))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() AS {_SPANS})"))


def _rebuilt(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with its spans (sorted) replaced by ``fill`` of a span and of the greatest stop before it."""
    size = F.lit(NEAR).cast("long")

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        def part(c: Column) -> Column:
            low, high = F.greatest(a, c * size), F.least(b, (c + 1) * size)
            return F.substring(chunks[c.cast("int")], (low - c * size + 1).cast("int"), (high - low).cast("int"))

        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / size), F.floor((b - 1) / size)), part), "")).otherwise("")

    def build(chunks: Column, runs: Column) -> Column:
        end = F.element_at(runs, -1)
        last = F.greatest(end["before"], end["x"]["stop"])
        parts = F.transform(runs, lambda r: F.concat(cut(chunks, r["before"], r["x"]["start"]), fill(r["x"], r["before"])))
        return F.concat(F.array_join(parts, ""), cut(chunks, last, F.char_length(text).cast("long")))

    runs = _running(spans, _SPANS[6:-1], lambda x: x["stop"], F.greatest)
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{NEAR}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(_let(chunks, lambda c: _let(runs, lambda r: build(c, r))))


def _bits(word: Column) -> Column:
    """The greatest entropy in bits of any window of a candidate.

    The state holds the window's counts by character code and the sum of c * log2(c); a step takes one character
    out and one in, so two counts and four terms change.
    """
    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def best(code: Column) -> Column:
        first = F.slice(code, 1, WINDOW)
        counts = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.size(F.filter(first, lambda c: c == k)))
        steps = F.when(F.size(code) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(code) - WINDOW - 1), lambda i: F.struct(code[i].alias("out"), code[i + WINDOW].alias("into")))).otherwise(F.expr("cast(array() AS array<struct<out:int,into:int>>)"))
        return _let(counts, lambda n: F.aggregate(steps, start(n), move, lambda a: F.lit(F.log2(F.lit(WINDOW))) - a["least"] / WINDOW))

    def start(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda t, c: t + term(c))
        return F.struct(counts.alias("counts"), total.alias("total"), total.alias("least"))

    def move(a: Column, n: Column) -> Column:
        same, out, into = n["out"] == n["into"], a["counts"][n["out"]], a["counts"][n["into"]]
        total = a["total"] + F.when(same, F.lit(0.0)).otherwise(term(out - 1) - term(out) + term(into + 1) - term(into))
        counts = F.when(same, a["counts"]).otherwise(F.transform(a["counts"], lambda c, k: c + F.when(k == n["into"], 1).when(k == n["out"], -1).otherwise(0)))
        return F.struct(counts.alias("counts"), total.alias("total"), F.least(a["least"], total).alias("least"))

    return _let(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), F.ascii), best)


def _entropy(spans: Column) -> Column:
    """Of candidates those that no pattern allows and whose bits reach the limit of their class."""
    def kept(s: Column) -> Column:
        word = s["word"]
        least = F.when(word.rlike("^[0-9A-Fa-f]+$"), LEAST_BITS["hex"]).when(word.rlike("[+/_=-]"), LEAST_BITS["base64"]).otherwise(LEAST_BITS["alnum"])
        return F.when(reduce(Column.__or__, [word.rlike(p) for p in ALLOW]), False).otherwise(_bits(word) >= least)

    return F.filter(spans, kept)


def spans(text: Column) -> Column:
    """Array of (start, kind, stop, word), by start and then kind, over a whole text.

    Kinds are places in KINDS. A null text counts as empty and has no spans. Spans of different kinds may overlap, but
    candidates for entropy are sought in what the base spans leave of the text, so none overlaps a base span.
    """
    text = F.coalesce(text, F.lit(""))
    base = F.array_sort(F.concat(*(_found(text, *kind) for kind in BASE)))

    def with_more(b: Column) -> Column:
        left = _rebuilt(text, b, lambda s, before: F.repeat(F.lit("\n"), F.greatest(s["stop"] - F.greatest(s["start"], before), F.lit(0)).cast("int")))
        return F.array_sort(F.concat(b, _let(left, lambda t: _entropy(_found(t, 3, CANDIDATE, 0, WINDOW)))))

    return _let(base, with_more)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat(F.array(*map(F.lit, KINDS))[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, hash of the base spans, all spans as text, count of entropy spans.

    Null texts count as empty: no spans, the hash of an empty text. Repeated rows each give a row, an empty table gives
    none, other columns are ignored whatever their names. Texts of any length are scanned whole.
    """
    found = docs.select("doc_id", spans(F.col("text")).alias("found"))

    def of(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [of(k) for k in range(len(KINDS))]
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts[:3], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), counts[3])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span of ``text`` replaced by ``mark``; overlapping spans get one mark.

    Null texts stay null. Columns may have any names; only ``text`` changes.
    """
    masked = _let(spans(F.col("text")), lambda found: _rebuilt(F.col("text"), found, lambda s, before: F.when(s["start"] < before, "").otherwise(mark)))
    return docs.select(*(masked.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns))

"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are densities of a learned lexicon (whole words and word beginnings, with their strongest and summed log
odds), how close its hits stand to second-person words, and rates of capitals, punctuation and obfuscation. The
trees are grown in numpy from histograms, on a bounded, hashed sample of the labelled rows.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, held_out, ship, task

#: The bound on labelled documents that the model learns from, and the words of a document that count as near.
SAMPLE, NEAR = 12_000, 5
LIMIT = 0.3
#: Second-person words of the languages served.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr ihnen tu te toi ton ta tes vous votre vos usted ustedes ti tuyo vosotros".split())
#: Digits and marks that stand for letters in obfuscated words.
_LEET = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!|*]+[^\W\d_]+")
FEATURES = ("hits", "density", "distinct", "odds_sum", "odds_density", "odds_most", "stem_hits", "stem_density", "near_you", "near_share", "capitals", "all_caps", "punctuation", "exclaim", "obfuscated", "digits", "repeats", "length")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def stems(word: str) -> Iterator[str]:
    """Beginnings of a word that can enter the lexicon, marked apart from whole words."""
    for n in (5, 7):
        if len(word) > n:
            yield word[:n] + "*"


def lexicon(texts: list[str], labels: np.ndarray, least: int = 4, size: int = 400) -> dict[str, float]:
    """Words and beginnings with their log odds of label 1 by document, the strongest first."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, labels.tolist(), strict=True):
        words = set(words_of(text))
        seen[y].update(words | {s for w in words for s in stems(w)})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    odds = {w: np.log((k + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1)) for w, k in seen[1].items() if k >= least}
    best = sorted(((o, w) for w, o in odds.items() if o >= 1.5), key=lambda x: (-x[0] * np.sqrt(seen[1][x[1]]), x[1]))[:size]
    return {w: float(o) for o, w in best}


def features(text: str | None, lex: dict[str, float]) -> list[float]:
    text = text or ""
    words = words_of(text)
    n, length = max(1, len(words)), max(1, len(text))
    hit, of, stem_hits = [], [], 0
    get = lex.get
    for i, w in enumerate(words):
        o = get(w)
        if o is None and len(w) > 5:
            o = get(w[:5] + "*")
            if o is None and len(w) > 7:
                o = get(w[:7] + "*")
            stem_hits += o is not None
        if o is not None:
            hit.append(i)
            of.append(o)
    mixed = _MIXED.findall(text)
    obfuscated = sum(m.lower().translate(_LEET) in lex for m in mixed)
    you = [i for i, w in enumerate(words) if w in YOU] if hit else []
    near = 0
    if you:
        at = np.searchsorted(you, hit)
        last = np.array([-(10**9), *you, 10**9])
        near = int((np.minimum(np.array(hit) - last[at], last[at + 1] - np.array(hit)) <= NEAR).sum())
    upper = sum(map(str.isupper, text))
    shouted = sum(map(str.isupper, text.split()))
    marks = length - sum(map(len, words)) - text.count(" ") - text.count("\n")
    total = float(sum(of))
    return [
        len(hit), len(hit) / n, len({words[i] for i in hit}), total, total / n, max(of, default=0.0), stem_hits, stem_hits / n, near, near / max(1, len(hit)),
        upper / length, shouted / n, marks / length, text.count("!") / length, (obfuscated + 0.1 * len(mixed)) / n, sum(map(str.isdigit, text)) / length, 1 - len(set(words)) / n, np.log1p(len(words)),
    ]


class Trees:
    """Boosted regression trees for the logistic loss, grown from histograms of quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.trees: list[tuple[list[tuple[int, int, int, int]], list[float]]] = []
        mean = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        at = self._bin(x)
        margin = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(at, p - y, np.maximum(p * (1 - p), 1e-6), depth, bins, least)
            self.trees.append(tree)
            margin += rate * self._leaf(tree, at)
        self.rate = rate

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)

    @staticmethod
    def _grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int, least: float) -> tuple:
        nodes, values = [], []

        def grow(rows: np.ndarray, left: int) -> int:
            me = len(nodes)
            nodes.append((-1, 0, 0, 0))
            values.append(float(-g[rows].sum() / (h[rows].sum() + 1)))
            if not left or len(rows) < 2:
                return me
            k = at.shape[1]
            place = (at[rows] + np.arange(k) * bins).ravel()
            sg = np.bincount(place, np.repeat(g[rows], k), k * bins).reshape(k, bins).cumsum(1)
            sh = np.bincount(place, np.repeat(h[rows], k), k * bins).reshape(k, bins).cumsum(1)
            tg, th = sg[:, -1:], sh[:, -1:]
            gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
            gain[(sh < least) | (th - sh < least)] = 0
            f, b = divmod(int(gain.argmax()), bins)
            if gain[f, b] <= 1e-9:
                return me
            low = at[rows, f] <= b
            nodes[me] = (f, b, grow(rows[low], left - 1), grow(rows[~low], left - 1))
            return me

        grow(np.arange(len(g)), depth)
        return np.array(nodes), np.array(values)

    @staticmethod
    def _leaf(tree: tuple, at: np.ndarray) -> np.ndarray:
        nodes, values = tree
        node = np.zeros(len(at), int)
        while True:
            f = nodes[node, 0]
            going = f >= 0
            if not going.any():
                return values[node]
            low = at[np.arange(len(at)), np.maximum(f, 0)] <= nodes[node, 1]
            node = np.where(going, np.where(low, nodes[node, 2], nodes[node, 3]), node)

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = self._bin(x)
        return self.start + self.rate * sum(self._leaf(t, at) for t in self.trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by score: pool adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least and greatest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    xs = [x for b in blocks for x in ((b[2], b[0]), (b[3], b[0]))]
    return np.array([x for x, _ in xs]), np.array([v for _, v in xs])


class Model:
    """Lexicon, trees and calibration; a constant where the sample lacks one of the labels."""

    def __init__(self, texts: list[str], labels: np.ndarray, folds: int = 3):
        self.lex: dict[str, float] = {}
        self.trees = None
        self.rate = float(labels.mean()) if len(labels) else 0.0
        if len(set(labels.tolist())) < 2:
            return
        fold = np.arange(len(labels)) % folds
        x = np.zeros((len(labels), len(FEATURES)))
        for k in range(folds):  # a text's features come from a lexicon that hasn't seen its label
            rows = np.flatnonzero(fold != k)
            lex = lexicon([texts[i] for i in rows], labels[rows])
            for i in np.flatnonzero(fold == k):
                x[i] = features(texts[i], lex)
        margin = np.zeros(len(labels))
        for k in range(folds):
            margin[fold == k] = Trees(x[fold != k], labels[fold != k]).margin(x[fold == k])
        self.knots = isotonic(margin, labels)
        self.lex = lexicon(texts, labels)
        self.trees = Trees(x, labels)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.rate)
        margin = self.trees.margin(np.array([features(t, self.lex) for t in texts]))
        # calibrated, and still increasing in the margin within a step
        return np.clip(0.98 * np.interp(margin, *self.knots) + 0.02 / (1 + np.exp(-margin)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn ``toxic`` from labelled documents outside the held-out fold, ``sample`` of them at most, by hash.

    A document with several labels counts as toxic if one says so; null labels and ids don't count. Of rows that share an
    id the least text counts, null texts as empty ones; other columns are ignored. Without labels of both kinds the model
    is a constant, 0 for empty tables.
    """
    ship(docs.sparkSession)
    known = labels.filter(~held_out("doc_id", 4)).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its size is bounded by the parameter
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    # the texts of the sample are learned from in one task; the driver gets the model
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model([t for _, _, t in got], np.array([y for _, y, _ in got], int)))], pa.binary())], names=["model"])

    learned = rows.coalesce(1).mapInArrow(task(run), "model binary").first()
    return pickle.loads(learned["model"]) if learned else Model([], np.zeros(0, int))


def predict(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, more columns, score (0 to 1) and predicted (1 from LIMIT on) for every row, from its text alone.

    Null texts count as empty; repeated rows each give a row, an empty table gives none. Texts of any length are read
    whole; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    source = docs.select("doc_id", *more, "text")
    kept = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2_000_000):
                score = held.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], names=[*kept, "score", "predicted"])

    fields = [*source.drop("text").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return source.mapInArrow(task(run), T.StructType(fields))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model doesn't call toxic, with all their columns, whatever their names.

    Null texts count as empty; each of several repeated rows stays or goes as its text does.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2_000_000):
                yield part.filter(pa.array(held.value.score(part.column("text").to_pylist()) < LIMIT))

    return docs.mapInArrow(task(run), docs.schema)

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket are summed over the cluster from a bounded, hashed sample of the labelled rows; the
matrix of log probabilities, languages times buckets, is broadcast. Batches are scored sparsely: one array of
buckets for all characters of the batch, gathered from the matrix and added up per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, task

#: Buckets of n-grams, sizes of n-grams, and the bound on training documents of one language.
BITS, SIZES, PER_LANGUAGE = 15, (1, 3), 4000
#: Languages that the broadcast matrix may have, 128 MB of logarithms.
LANGUAGES = 1000
NOTHING = 1 << BITS
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and where each text's buckets begin; one space frames a text.

    Two zeros end a text, so no n-gram runs on into the next one; places of zeros have the bucket NOTHING.
    """
    frame = [f" {t.lower()} \0\0" for t in texts]
    code = np.frombuffer("".join(frame).encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.cumsum([len(t) for t in frame])
    out = np.empty((len(SIZES), len(code)), np.int32)
    for row, n in zip(out, SIZES, strict=True):
        mixed = code * np.uint32(0x9E3779B1)
        for i in range(1, n):  # the last n - 1 characters of all texts start shorter n-grams
            mixed[:-i] = (mixed[:-i] ^ (mixed[:-i] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[i:]
        mixed = (mixed + np.uint32(n)) * np.uint32(0x9E3779B1)
        row[:] = mixed >> np.uint32(32 - BITS)
    out[:, stop - 1] = out[:, stop - 2] = NOTHING
    return out, np.concatenate([[0], stop[:-1]])


class Model:
    def __init__(self, names: list[str], counts: np.ndarray, documents: np.ndarray):
        self.names = names
        total = counts.sum(1, keepdims=True)
        log = (np.log(counts + 0.5) - np.log(total + 0.5 * counts.shape[1])).T.astype(np.float32)
        self.log = np.concatenate([log, np.zeros((1, log.shape[1]), np.float32)])  # NOTHING says nothing
        self.prior = np.log(documents / documents.sum())

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability; UNKNOWN and 0 without a letter or a model."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and _LETTER(t)]
        if not rows or not self.names:
            return names, score
        at, start = buckets([texts[i] for i in rows])
        log = self.prior + sum(np.add.reduceat(self.log[b].astype(np.float64), start, axis=0) for b in at)
        best = log.argmax(1)
        score[rows] = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
        for i, k in zip(rows, best.tolist(), strict=True):
            names[i] = self.names[k]
        return names, score


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from (doc_id, text, lang); of each language a hashed sample of about ``per_language`` documents.

    Rows without a text or a language don't count, repeated rows count as often as they come; an empty table gives a
    model that knows no language. The matrix has a column of 32,768 logarithms for each language, LANGUAGES at most.
    """
    ship(labelled.sparkSession)
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()
    names = [r["lang"] for r in sizes]
    if len(names) > LANGUAGES:
        raise ValueError(f"{len(names)} languages; the matrix that is broadcast holds {LANGUAGES} at most")
    if not names:
        return Model([], np.zeros((0, 1 << BITS)), np.ones(0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text", 1_000_000):
                kinds = np.array([place[x] for x in part.column("lang").to_pylist()])
                texts = part.column("text").to_pylist()
                for k in np.unique(kinds).tolist():
                    at, _ = buckets([t for t, x in zip(texts, kinds, strict=True) if x == k])
                    counts[k] = counts.get(k, 0) + np.bincount(at.ravel(), minlength=NOTHING + 1)[:NOTHING]
        for k, n in counts.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, np.int32)), pa.array(b.astype(np.int32)), pa.array(n[b].astype(np.int64))], names=["k", "b", "n"])

    summed = labelled.filter(draw < share[F.col("lang")]).select("text", "lang").mapInArrow(task(run), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), 1 << BITS))
    counts[summed.k, summed.b] = summed.n
    return Model(names, counts, np.array([r["count"] for r in sizes], float))


def predict(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, more columns, lang_pred and score for every row; only the text enters the prediction.

    Null texts and texts without a letter get UNKNOWN and score 0; ties go to the first language by name. Repeated rows
    each give a row, an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    source = docs.select("doc_id", *more, "text")
    kept = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 500_000):
                names, score = held.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    schema = source.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(task(run), schema)

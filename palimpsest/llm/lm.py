"""Language-model scores of whole texts, beside a unigram base.

A word's first subword is predicted by causal attention over the first subwords of the words before it; its further
subwords follow from counts of the training words. Attention steps over every window of every training document.

Documents are dealt to blocks by a hash of their id and text. Each block asks for its distinct words with their counts
in its training documents; counts are summed over blocks by word and joined back to the blocks that asked, so a common
word costs one row a block. The counts of subwords come from the same table, once a word.
"""

from __future__ import annotations

import base64
import pickle
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import Attention, leaves
from .common import Scratch, chunks, heavy, held_out, ship, task
from .graph import groups

#: UTF-8 bytes of text in a block, documents that give the attention weights a start, words of one of them, steps.
BLOCK, TRAIN, EACH, STEPS = 8_000_000, 3000, 320, 400
#: Rate of the start and of the steps over all training texts, characters of text whose windows are mixed for them.
FIRST, RATE, MIXED = 0.01, 0.004, 1_000_000
#: Weights of attention over subwords and of the words before in the same document; the smoothed whole-word share has the rest.
MIX, RECENT = 0.9, 0.05
#: Distinct words that are encoded together, weights in one row, words that are scored in one go.
TOGETHER, PART, PIECE = 10_000, 8192, 200_000
#: Words whose leaves a task keeps.
MET = 400_000


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of texts, one text after another, by number in the order they come, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))  # at 0x20 and 0x09-0x0D
    flat = parts.flatten()
    there = pc.greater(pc.binary_length(flat), 0)  # texts that begin or end with white space have empty parts there
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    stop = np.cumsum(pc.list_value_length(parts).to_numpy())
    return flat.filter(there).dictionary_encode(), np.diff(before[stop], prepend=0)


def _bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def words_of(text: str | None) -> list[bytes]:
    return _bytes(split(pa.array([text], pa.string()))[0].dictionary_decode())


class Subwords:
    """Ids of a word and the space before it."""

    def __init__(self, rank_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1  # the id that the rank file leaves free
        self.first_byte, self.last_byte, self.size = np.zeros((3, self.end + 1), np.int64)
        for token, i in ranks.items():
            self.first_byte[i], self.last_byte[i], self.size[i] = token[0], token[-1], len(token)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one word after another, and how many each has."""
        text = [w.decode() for w in words]
        # a space goes with the word after it, so words split as they would alone; not so beside other white space
        alone = [] if " ".join(text).split() == text else [i for i, t in enumerate(text) if t.split() != [t]]
        cuts = sorted({*range(0, len(words), TOGETHER), len(words), *alone, *(i + 1 for i in alone)})
        ids, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in pairwise(cuts):
            got = self.encoding.encode_ordinary(f" {' '.join(text[a:b])}")
            got = np.fromiter(got, np.int64, len(got))
            stop = np.searchsorted(np.cumsum(self.size[got]), np.cumsum([len(w) + 1 for w in words[a:b]])) + 1
            ids.append(got)
            size.append(np.diff(stop, prepend=0))
        return np.concatenate(ids), np.concatenate(size)


def _subwords(rank_file: bytes) -> Subwords:
    return heavy(("subwords", hash(rank_file)), lambda: Subwords(rank_file))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block with their counts in its training documents."""
    for table, bounds in groups(batches, ["block"]):
        text, out, block = table.column("text"), table.column("held_out"), table.column("block")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            coded, size = split(text.slice(a, b - a).combine_chunks())
            learned = np.repeat(~out.slice(a, b - a).to_numpy(), size)
            words = coded.dictionary
            n = np.bincount(coded.indices.to_numpy()[learned], minlength=len(words))
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block[a].as_py(), np.int32)), part, pa.array(n[i : i + 50_000], pa.int64())], names=["block", "word", "n"])


def _earlier(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each word came before in its document."""
    key = doc * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    place = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def _inner(size: np.ndarray) -> np.ndarray:
    """Places of the words of texts with ``size`` words each, where each text has one more place at its end."""
    return np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)


class Spelling:
    """Probabilities of a word's further subwords, given its first, from the training words.

    Words with one first subword share (Witten and Bell) their tokens' mass with a chain for the words never seen: each
    subword by the last byte before it and its own first byte, then its share of the subwords that begin so.
    """

    def __init__(self, tokens: np.ndarray, types: np.ndarray, further: np.ndarray, joints: np.ndarray, first_byte: np.ndarray, last_byte: np.ndarray):
        """tokens, types: training tokens and distinct words by first id; further: times an id goes on with a word;
        joints: times a last byte is followed by a first byte, or by the end of the word (256)."""
        self.tokens, self.types, self.first_byte, self.last_byte = tokens, np.maximum(types, 1), first_byte, last_byte
        follows = joints + 0.1 * np.append(np.bincount(first_byte, minlength=256) > 0, True)
        self.joint = np.log10(np.maximum(follows, 1e-300) / follows.sum(1, keepdims=True))
        weight = further + 0.05
        self.share = np.log10(weight / np.bincount(first_byte, weight, 256)[first_byte])

    def rest(self, words: list[list[int]], counts: np.ndarray) -> np.ndarray:
        """log10 probability of the further subwords of words, given their first ones; ``counts`` are the words' own."""
        return self.rest_of(np.array([i for w in words for i in w], np.int64), np.array([len(w) for w in words], np.int64), counts)

    def rest_of(self, flat: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same for words as ``Subwords.of`` gives them."""
        begin = np.cumsum(size) - size
        after = np.full(len(flat), 256)
        inner = np.ones(len(flat), bool)
        inner[begin] = False
        goes_on = np.flatnonzero(inner)
        after[goes_on - 1] = self.first_byte[flat[goes_on]]
        chain = self.joint[self.last_byte[flat], after]
        chain[goes_on] += self.share[flat[goes_on]]
        chain = np.add.reduceat(chain, begin) if len(begin) else np.zeros(0)
        first = flat[begin]
        t = self.types[first]
        return np.log10((counts + t * 10.0 ** np.maximum(chain, -300)) / (self.tokens[first] + t))


class Scorer:
    """What scoring needs of the corpus besides word counts: the tree of first subwords, spelling, attention weights."""

    def __init__(self, tokens: np.ndarray, types: np.ndarray, further: np.ndarray, joints: np.ndarray, first_byte: np.ndarray, last_byte: np.ndarray):
        """Counts as for Spelling; the last of ``tokens`` is the end's."""
        self.end = len(tokens) - 1
        self.leaf, share, weight = leaves(tokens)
        self.share = share.astype(np.float32)
        self.spelling = Spelling(tokens, types, further, joints, first_byte, last_byte)
        self.model = Attention(weight)

    def texts(self, texts: pa.Array, sub: Subwords, met: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves of the words of texts, one after another, with an end each; where texts start and stop.

        ``met`` keeps leaves of words for the next texts.
        """
        coded, size = split(texts)
        words = _bytes(coded.dictionary)
        if len(met) > MET:
            met.clear()
        new = [w for w in words if w not in met]
        ids, n = sub.of(new)
        met.update(zip(new, self.leaf[ids[np.cumsum(n) - n]].tolist(), strict=True))
        leaf = np.fromiter(map(met.__getitem__, words), np.int32, len(words))
        stop = np.cumsum(size + 1)
        out = np.full(stop[-1] if len(stop) else 0, self.leaf[self.end], np.int32)
        out[_inner(size)] = leaf[coded.indices.to_numpy()]
        return out, stop - size - 1, stop

    def learn(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float, steps: int | None = None, seed: int = 6) -> None:
        """Steps over every window of ``texts``, in mixed order: once, or until there were ``steps``."""
        parts = [np.concatenate(x) for x in zip(*((w, there, text[at], c) for text, start, stop in texts for w, there, at, c in self.model.inputs(text, start, stop)), strict=True)]
        if not parts:
            return
        rng, n, size = np.random.default_rng(seed), len(parts[0]), 256
        each = -(-n // size)
        turns = (np.split(rng.permutation(n), range(size, n, size)) for _ in range(-(-(steps or each) // each)))
        batches = (tuple(x[rows] for x in parts) for turn in turns for rows in turn)
        self.model.train(batches, steps or each, rate)

    def score(self, ids: np.ndarray, size: np.ndarray, counts: np.ndarray, total: int, distinct: int, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of documents given as places in the words of ``ids`` and ``size``, ends included.

        A word has three probabilities: of its first subword under attention times its spelling, its smoothed share of
        the ``total`` training tokens (as in the base, where all words that training never saw are one), and its share of
        the words before it in the document; it counts with their weighted mean. ``counts`` has the training counts of the
        words, then of the end.
        """
        first = np.append(ids[np.cumsum(size) - size], self.end)
        rest = np.append(self.spelling.rest_of(ids, size, counts[:-1]), 0.0) + self.share[first]
        leaf, plain = self.leaf[first], (counts + 1) / (total + distinct + 1)
        out, i = [], 0
        while i < len(docs):
            j, n = i, 0
            while j < len(docs) and (j == i or n + len(docs[j]) <= PIECE):
                n += len(docs[j]) + 1
                j += 1
            at = np.concatenate([np.append(x, len(size)) for x in docs[i:j]])
            sizes = np.array([len(x) + 1 for x in docs[i:j]])
            stop = np.cumsum(sizes)
            start = stop - sizes
            own = self.model.log10(leaf[at], start, stop).astype(np.float64) + rest[at]
            recent = _earlier(at, np.repeat(np.arange(len(sizes)), sizes)) / np.maximum(1, np.arange(len(at)) - np.repeat(start, sizes))
            mixed = np.log10(MIX * 10.0 ** np.maximum(own, -300) + RECENT * recent + (1 - MIX - RECENT) * plain[at])
            out.append(np.add.reduceat(mixed, start))
            i = j
        return np.concatenate(out) if out else np.zeros(0)


def _weights(model: Attention, n: int) -> pa.RecordBatch:
    """The model's weights times n, and n, in parts."""
    flat = np.append(np.concatenate([x.ravel() for x in model.p.values()]).astype(np.float64), 1.0) * n
    parts = [flat[i : i + PART] for i in range(0, len(flat), PART)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "sum"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of parts, one held for each part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column("part").to_pylist(), batch.column("sum").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "sum"])


def score(docs: DataFrame, rank_path: str | None = None, fold: int = 7, block_bytes: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Null texts count as empty: one end token. Repeated rows count as often as they come, in training too, and each gives
    a row; an empty table gives none. Documents whose crc32(doc_id as text) mod ``fold`` is 2 are held out of all counts
    and of the attention weights. Those weights start from about TRAIN hashed training documents; then each task steps
    over every window of its training documents, and the mean of the tasks' weights counts, by windows. Word and subword
    counts cover every training document. Texts of any length are scored whole, in windows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    ship(spark)
    with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    end = len(ranks.value.split()) // 2
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id", fold).alias("held_out"))
    facts = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("held_out")).alias("docs")).first()
    blocks = max(1, -(-facts["bytes"] // block_bytes))
    source = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = source.repartition("block").sortWithinPartitions("block").mapInArrow(task(_count), "block int, word string, n long")
    asked = scratch.save(asked, "asked")
    once = scratch.save(asked.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "once")
    words = asked.select("block", "word").join(once, "word")
    total = once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_docs = facts["docs"]
    n, v = total["n"] + train_docs, total["v"] + (train_docs > 0)

    def subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by first id (tokens: 0, words: 1), of further ids (2), and of joints (3: last byte times 257 plus what follows)."""
        sub = _subwords(ranks.value)
        counts = np.zeros((4, max(end + 1, 256 * 257)), np.int64)
        for batch in batches:
            ids, size = sub.of(_bytes(batch.column("word")))
            begin, goes_on = np.cumsum(size) - size, np.ones(len(ids), bool)
            goes_on[begin] = False
            np.add.at(counts[0], ids[begin], batch.column("c").to_numpy())
            np.add.at(counts[1], ids[begin], 1)
            np.add.at(counts[2], ids[goes_on], 1)
            after = np.where(np.append(goes_on[1:], False), np.append(sub.first_byte[ids[1:]], 256), 256)
            np.add.at(counts[3], sub.last_byte[ids] * 257 + after, 1)
        kind, there = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(there), pa.array(counts[kind, there])], names=["kind", "id", "n"])

    # at most three rows an id and one a pair of bytes
    counted = once.select("word", "c").mapInArrow(task(subword_counts), "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((4, max(end + 1, 256 * 257)))
    counts[counted.kind, counted.id] = counted.n
    counts[0, end], counts[1, end] = train_docs, 1
    sub = _subwords(ranks.value)
    scorer = Scorer(*counts[:3, : end + 1], counts[3, : 256 * 257].reshape(256, 257), sub.first_byte, sub.last_byte)
    share = min(1.0, TRAIN / max(1, train_docs))
    sample = source.filter("NOT held_out").filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 20)) < share * (1 << 20)).select("text")
    held = spark.sparkContext.broadcast(scorer)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text a stretch, wherever its hash says."""
        met: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                leaf, _, _ = held.value.texts(batch.column("text").slice(i, 1), _subwords(ranks.value), met)
                at = zlib.crc32(leaf.tobytes()) % max(1, len(leaf) - EACH + 1)
                out.append(leaf[at : at + EACH])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["w"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(w for b in batches for w in b.column("w").to_pylist())
        own = pickle.loads(pickle.dumps(held.value))
        if got:
            stop = np.cumsum([len(w) for w in got])
            own.learn([(np.concatenate(got).astype(np.int32), stop - [len(w) for w in got], stop)], FIRST, STEPS)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own.model)], pa.binary())], names=["model"])

    trained = sample.mapInArrow(task(some), "w array<int>").coalesce(1).mapInArrow(task(fit), "model binary").first()
    scorer.model = pickle.loads(trained["model"]) if trained else scorer.model
    held = spark.sparkContext.broadcast(scorer)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = None, 0
        met: dict[bytes, int] = {}
        for batch in batches:
            for part in chunks(batch, "text", MIXED):
                own = own or pickle.loads(pickle.dumps(held.value))
                texts = own.texts(part.column("text"), _subwords(ranks.value), met)
                own.learn([texts], RATE)
                n += len(texts[0])
        if n:
            yield _weights(own.model, n)

    sums = source.filter("NOT held_out").select("text").mapInArrow(task(follow), "part int, sum binary").repartition("part").mapInArrow(task(_add), "part int, sum binary").collect()
    if sums:  # as many rows as the model has parts
        flat, p = np.concatenate([np.frombuffer(r["sum"]) for r in sorted(sums, key=lambda r: r["part"])]), scorer.model.p
        for k, part in zip(p, np.split(flat[:-1] / flat[-1], np.cumsum([x.size for x in p.values()])[:-1]), strict=True):
            p[k] = part.reshape(p[k].shape).astype(np.float32)
    held = spark.sparkContext.broadcast(scorer)

    def scored(texts: pa.Table, counts: pa.Table) -> pa.Table:
        sub, scorer = _subwords(ranks.value), held.value
        word = counts.column("word").combine_chunks()
        known = len(word)
        c = counts.column("c").to_numpy()
        log = np.log10(c + 1.0)
        coded, n_words = split(texts.column("text").combine_chunks())
        place = pc.fill_null(pc.index_in(coded.dictionary, word), -1).to_numpy().astype(np.int64)
        others = np.flatnonzero(place < 0)
        place[others] = known + np.arange(len(others))
        at = np.split(place[coded.indices.to_numpy()], np.cumsum(n_words)[:-1]) if len(n_words) else []
        n_known = [int((x < known).sum()) for x in at]
        base = [float(log[x[x < known]].sum()) for x in at]
        ids, size = sub.of(_bytes(word) + _bytes(coded.dictionary.take(pa.array(others))))
        c = np.concatenate([c, np.zeros(len(others)), [train_docs]])
        total = scorer.score(ids, size, c, n, v, at) if at else np.zeros(0)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array([len(x) for x in at], pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = source.groupBy("block").cogroup(words.select("block", "word", "c").groupBy("block")).applyInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    one_end = int(train_docs > 0)
    base = F.col("base") + float(np.log10(train_docs + 1)) - (F.col("n_tokens") + 1) * float(np.log10(n + v + 1))
    return rows.select("doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + one_end).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

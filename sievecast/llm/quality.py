"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, pieces_of, starts_of, summed, table, utf8

#: Word types are hashed to BUCKETS, their letter shapes to SHAPES; vectors have WIDTH dimensions, index vectors MARKS entries of +-1.
BUCKETS, SHAPES, WIDTH, MARKS = 8192, 512, 64, 4
#: Dimensions of the shapes' vectors, and of the words' own index vectors, by whose mean repetition shows.
SHAPE_WIDTH, OWN_WIDTH = 64, 64
#: Most labelled rows that the network is fitted on, in the order of a hash of their ids.
FIT_ROWS = 20_000
THRESHOLD = 0.3
_REMEMBERED = 600_000
_WORDS_AT_ONCE = 1 << 17
#: Words whose vectors are gathered at a time: few enough that they stay in a core's cache.
_ADDED_AT_ONCE = 1 << 11
_RUN = re.compile(r"(.)\1+", re.DOTALL)


class _Signs(dict):
    """Code point -> its sign in a word's shape: capitals, other letters and digits of any script are one sign each, all else itself."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else x
        return self[c]


_SIGNS = _Signs()


def shape(word: bytes) -> bytes:
    """Letters, capitals and digits as one sign each, runs as one: ``"Haus12"`` -> ``"Aa0"``."""
    return _RUN.sub(r"\1", word.decode("utf-8", "replace").translate(_SIGNS)).encode()


def _index_vectors(n: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random index vectors: places and signs of MARKS entries for each of n things."""
    draw = np.random.default_rng(seed)
    return np.argsort(draw.random((n, width)), axis=1)[:, :MARKS], draw.choice(np.array([-1, 1], np.float32), (n, MARKS))


def _dense(n: int, width: int, seed: int) -> np.ndarray:
    at, sign = _index_vectors(n, width, seed)
    out = np.zeros((n, width), np.float32)
    np.put_along_axis(out, at, sign, 1)
    return out


class WordIds:
    """Word -> bucket of the word and of its shape, as one number; remembers a bounded number of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array(list(map(known.__getitem__, words)), np.int64)
        except KeyError:
            pass
        if len(known) > _REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = crc32(w.lower()) % BUCKETS * SHAPES + crc32(shape(w)) % SHAPES
        return np.array(list(map(known.__getitem__, words)), np.int64)


def _runs(column: pa.Array, ids: WordIds) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, word ids, words of each text) for texts of up to _WORDS_AT_ONCE words at a time, or one longer text."""
    parts, lengths, first = [], [], 0
    for i, x in enumerate(utf8(column)):
        own = [ids(piece.split()) for piece in pieces_of(x)]
        n = sum(map(len, own))
        if parts and sum(lengths) + n > _WORDS_AT_ONCE:
            yield first, i, np.concatenate(parts), np.array(lengths)
            parts, lengths, first = [], [], i
        parts += own
        lengths.append(n)
    if parts:
        yield first, len(column), np.concatenate(parts), np.array(lengths)


def _add_words(sums: np.ndarray, w: np.ndarray, lengths: np.ndarray, of_word: np.ndarray, of_shape: np.ndarray, width: int) -> None:
    """Add to each text's row its words' vectors, its shapes' and, of the first ``width`` dimensions, neighbours' products, so many words at a time."""
    text, cut = np.repeat(np.arange(len(lengths)), lengths), of_word.shape[1]
    last, before = np.zeros(width, of_word.dtype), -1
    for c in range(0, len(w), _ADDED_AT_ONCE):
        some, of = w[c : c + _ADDED_AT_ONCE], text[c : c + _ADDED_AT_ONCE]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        words = of_word[some // SHAPES]
        products = np.empty((len(some), width), of_word.dtype)
        np.multiply(words[1:, :width], words[:-1, :width], out=products[1:])
        # a text's first word has no word before it, unless the text began in the part before
        products[starts] = 0
        if of[0] == before:
            products[0] = words[0, :width] * last
        last, before = words[-1, :width].copy(), of[-1]
        sums[of[starts], :cut] += np.add.reduceat(words, starts, axis=0)
        sums[of[starts], cut : cut + of_shape.shape[1]] += np.add.reduceat(of_shape[some % SHAPES], starts, axis=0)
        sums[of[starts], cut + of_shape.shape[1] :] += np.add.reduceat(products, starts, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, WIDTH): the sum of the index vectors of each word's neighbours over all texts, scaled to length 1.

    A task adds up one matrix, whatever it reads; the matrices are added up in groups of rows, exactly, as all sums are whole numbers.
    """
    schema = pa.schema([("slice", pa.int32()), ("sums", pa.binary())])
    rows = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total, any_text = WordIds(), np.zeros(BUCKETS * WIDTH), False
        at, sign = _index_vectors(BUCKETS, WIDTH, 1)
        for b in batches:
            any_text |= b.num_rows > 0
            for _, _, w, lengths in _runs(b.column(0), ids):
                bucket = w // SHAPES
                inside = np.ones(len(w), bool)
                inside[starts_of(lengths)[lengths > 0]] = False
                inner = np.flatnonzero(inside)
                for c in range(0, len(inner), _WORDS_AT_ONCE):
                    right = inner[c : c + _WORDS_AT_ONCE]
                    one, other = np.r_[bucket[right - 1], bucket[right]], np.r_[bucket[right], bucket[right - 1]]
                    total += np.bincount((one[:, None] * WIDTH + at[other]).ravel(), sign[other].ravel(), BUCKETS * WIDTH)
        if any_text:
            size = rows * WIDTH
            cuts = range(0, len(total), size)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([total[c : c + size].tobytes() for c in cuts], pa.binary())], schema=schema)

    ddl = "slice int, sums binary"
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for r in summed(docs.select("text").mapInArrow(run, ddl), "sums", np.float64).collect():
        out[r.slice * rows : (r.slice + 1) * rows] = np.frombuffer(r.sums).reshape(-1, WIDTH)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``doc_id, features array<float>``: mean word vector, mean product of neighbours' word vectors (how well words go together), mean shape vector, length of the mean index vector (repetition), log words."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shapes, own = WordIds(), _dense(SHAPES, SHAPE_WIDTH, 2), _dense(BUCKETS, OWN_WIDTH, 3)
        of_word = np.hstack([shared.value, own])
        for b in batches:
            doc_ids = b.column(0).cast(pa.int64())
            for first, end, w, lengths in _runs(b.column(1), ids):
                sums = np.zeros((len(lengths), 2 * WIDTH + OWN_WIDTH + SHAPE_WIDTH), np.float64)
                _add_words(sums, w, lengths, of_word, shapes, WIDTH)
                sums[:, :-WIDTH] /= np.maximum(lengths, 1)[:, None]
                sums[:, -WIDTH:] /= np.maximum(lengths - 1, 1)[:, None]
                repeats = np.linalg.norm(sums[:, WIDTH : WIDTH + OWN_WIDTH], axis=1) / MARKS**0.5
                f = np.column_stack([sums[:, :WIDTH], sums[:, -WIDTH:], sums[:, WIDTH + OWN_WIDTH : -WIDTH], repeats, repeats**2, np.log1p(lengths)]).astype(np.float32)
                offsets = pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1])
                yield pa.RecordBatch.from_arrays([doc_ids[first:end], pa.ListArray.from_arrays(offsets, pa.array(f.ravel()))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features array<float>")


@dataclass
class Network:
    """Standardised features -> tanh layer -> logit, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 0.003, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss of four rows of five; the fifth sets the temperature. Without two labels to tell apart, a constant."""
    n, d = x.shape
    draw = np.random.default_rng(seed)
    order = draw.permutation(n)
    tuned, train = order[: n // 5], order[n // 5 :]
    share = (y.sum() + 1) / (n + 2)
    net = Network(x.mean(axis=0) if n else np.zeros(d), np.maximum(x.std(axis=0), 1e-6) if n else np.ones(d), draw.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if n < 20 or y.min() == y.max():
        return net
    net.w2 = draw.normal(0, hidden**-0.5, hidden)
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - net.mean) / net.scale
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            to_h = g[:, None] * p[2] * (1 - h * h)
            t += 1
            for a, da, ma, va in zip(p, (z[rows].T @ to_h + decay * p[0], to_h.sum(axis=0), h.T @ g + decay * p[2], g.sum(keepdims=True)), m, v, strict=True):
                ma += 0.1 * (da - ma)
                va += 0.001 * (da * da - va)
                a -= rate * (ma / (1 - 0.9**t)) / (np.sqrt(va / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(p[3][0])
    logits = net.logits(x[tuned])
    grid = np.geomspace(0.3, 6, 40)
    loss = [np.logaddexp(0, -(2 * y[tuned] - 1) * logits / c).mean() for c in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (doc_id, text).

    Word vectors come from all texts. The network is fitted on labelled rows whose ``crc32(doc_id)``
    modulo 5 is not 0, at most ``rows`` of them (those first by a hash of their id); a null or
    contradictory label teaches nothing; of an id with several texts the least features count. Texts alone make a score: null texts count as empty, empty ones
    get a score as well. Rows that repeat come out as often; other columns are ignored; with nothing
    to learn from, scores are the share of label 1, or a half; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    features = materialize(pooled(docs, word_vectors(docs)), "pooled")
    usable = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id", 5) != 0))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most")
    sample = usable.select("doc_id", "quality").join(features.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fitted = features.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features")).toPandas().sort_values("doc_id")
    x = np.array(fitted["features"].to_list(), np.float64).reshape(len(fitted), -1) if len(fitted) else np.zeros((0, 2 * WIDTH + SHAPE_WIDTH + 3))
    shared = docs.sparkSession.sparkContext.broadcast(fit(x, fitted["quality"].to_numpy(np.float64)))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(shared.value.scores(f) if len(f) else [], pa.float64())], schema=schema)

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

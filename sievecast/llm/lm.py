"""LM scoring: a log-bilinear neural model with noise-contrastive estimation, over word classes.

The model predicts a token's class from the two classes before it: ``h = R[w1] C1 + R[w2] C2``, the
score of class w is ``h . Q[w] + b[w]``, and a softmax over all classes normalises it. The most
frequent words are a class each; every other word belongs to a class by its last letters, within
which its probability is its add-one share. So token probabilities are normalised, one unknown
word a class included. As h is linear in the two contexts, two products ``R C Q'`` of all classes
hold every score, and the normaliser is a table over pairs of contexts.

Texts are turned into classes once and dealt to shards by a hash of the row. How many shards there are
follows from the number of training tokens alone, so neither the tasks nor the files of the input
matter: a shard is trained on its rows in the order of their hashes, with a seed of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, fold, materialize, pieces_of, starts_of, summed, table, utf8

#: Classes: this many frequent words of their own, and groups of all other words by their last SUFFIX bytes.
OWN_WORDS, GROUPS, SUFFIX = 960, 64, 3
WIDTH, NOISE, BATCH, RATE, ROUNDS = 24, 128, 1024, 0.05, 2
#: Training tokens of the first shard. Of n times as many there are n ** SHARD_POWER shards, so that shards and what each learns from both grow.
SHARD_TOKENS, SHARD_POWER = 1 << 20, 0.75
#: Tokens of a text that are dealt together; a longer text goes to several shards, each piece as a text of its own.
PIECE = 1 << 16
#: Words whose counts every task holds; the counts of all others are joined. Bounds what is broadcast, not what counts.
HELD_WORDS = 1 << 17
#: Longest word (bytes) that is held, so that the held words are bounded in bytes too.
HELD_BYTES = 256
#: Different words that a task counts before it passes them on.
COUNTED_AT_ONCE = 300_000
#: The end of a text, as a token. No word is empty.
END = b""
_WORDS_AT_ONCE = 1 << 18
_LOOKED_UP = 1 << 12
_SLICE = 8192
_STEPS_AT_ONCE = 64


def _group(word: bytes) -> int:
    return OWN_WORDS + zlib.crc32(word[-SUFFIX:]) % GROUPS


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, c long`` over the texts of ``docs``, with one END a text. Tasks pass on sums of bounded dictionaries."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for b in batches:
            texts = utf8(b.column(0))
            counts[END] += len(texts)
            for x in texts:
                for piece in pieces_of(x.lower()):
                    counts.update(piece.split())
                    if len(counts) >= COUNTED_AT_ONCE:
                        yield rows()
        if counts:
            yield rows()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Parameters:
    context: np.ndarray  # R
    target: np.ndarray  # Q
    first: np.ndarray  # C1
    second: np.ndarray  # C2
    bias: np.ndarray

    @classmethod
    def initial(cls, unigram: np.ndarray, width: int, seed: int = 7) -> Parameters:
        draw = np.random.default_rng(seed)
        n = len(unigram)
        return cls(*(draw.normal(0, 0.3, (n, width)).astype(np.float32) for _ in range(2)), *(np.eye(width, dtype=np.float32) * x for x in (0.6, 0.4)), np.log(unigram).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.first, self.second, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> Parameters:
        cuts = np.cumsum([x.size for x in self.arrays()])[:-1]
        return Parameters(*(p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, cuts), self.arrays(), strict=True)))


@cache
def _places(rows: int, width: int) -> np.ndarray:
    return np.arange(rows * width).reshape(rows, width)


def _add_rows(out: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Add each of ``rows`` to the row of ``out`` that its id names; two neighbouring numbers at once where the width is even."""
    kind = out.dtype if out.shape[1] % 2 else np.complex64
    flat = out.view(kind)
    at = _places(1 << len(out).bit_length(), flat.shape[1]).take(ids, axis=0)  # few tables, as their sizes are powers of two
    np.add.at(flat.reshape(-1), at.reshape(-1), np.ascontiguousarray(rows).view(kind).reshape(-1))


class _Adagrad:
    """A table of parameters and its squares. Its other arrays are made once and used again by every step."""

    def __init__(self, x: np.ndarray):
        self.x, self.squares = x, np.full(x.shape, 1e-6, np.float32)
        self.gradient, self.spare = np.empty_like(x), np.empty_like(x)

    def move(self, rate: float) -> None:
        np.multiply(self.gradient, self.gradient, out=self.spare)
        self.squares += self.spare
        np.sqrt(self.squares, out=self.spare)
        np.divide(self.gradient, self.spare, out=self.spare)
        self.spare *= rate
        self.x += self.spare


class Trainer:
    """Adagrad steps of noise-contrastive estimation. A batch shares its noise words, so all products are matrix products.

    A word's vector and bias are one row, which the h of a token meets with a 1 at its end; C1 and C2 stand
    side by side. A batch has some thousand contexts but few different ones, so products with C1 and C2 are of
    these. The chance that a noise word is taken for a true one is ``(1 + tanh(score / 2)) / 2``; its halves are
    left to the products' results.
    """

    def __init__(self, start: Parameters, unigram: np.ndarray, noise: int = NOISE, rate: float = RATE, seed: int | tuple = 0):
        n, width = start.context.shape
        even = np.zeros((n, 1 - width % 2), np.float32)
        self.context, self.mix = _Adagrad(start.context.copy()), _Adagrad(np.concatenate([start.first, start.second], axis=1))
        self.words = _Adagrad(np.concatenate([start.target, start.bias[:, None], even], axis=1))
        self.p = Parameters(self.context.x, self.words.x[:, :width], self.mix.x[:, :width], self.mix.x[:, width:], self.words.x[:, width])
        self.cumulative, self.offset = np.cumsum(unigram), np.log(noise * unigram).astype(np.float32)
        self.noise, self.rate, self.draw, self.seen = noise, rate, np.random.default_rng(seed), 0
        self._arrays(0)

    def _arrays(self, size: int) -> None:
        width = self.p.context.shape[1]
        self.scores, self.h = np.empty((size, self.noise), np.float32), np.zeros((size, self.words.x.shape[1]), np.float32)
        self.h[:, width] = 1

    def step(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> None:
        size, (n, width) = len(w), self.p.context.shape
        if size != len(self.h):
            self._arrays(size)
        h, scores, half = self.h, self.scores, np.float32(0.5 / size)
        others = np.minimum(self.cumulative.searchsorted(self.draw.random(self.noise)), n - 1)
        used = np.zeros(n, bool)
        used[w1] = used[w2] = True
        used, number = np.flatnonzero(used), np.empty(n, np.int64)
        number[used] = np.arange(len(used))
        first, second = number.take(w1), number.take(w2)
        c = self.context.x.take(used, axis=0)
        mixed = c @ self.mix.x
        np.add(mixed[:, :width].take(first, axis=0), mixed[:, width:].take(second, axis=0), out=h[:, :width])
        own, rows = self.words.x.take(w, axis=0), self.words.x.take(others, axis=0)
        rows[:, width] -= self.offset.take(others)
        true = np.tanh((np.einsum("ij,ij->i", h, own) - self.offset.take(w)) / 2)
        true = ((1 - true) * half)[:, None]
        np.matmul(h, rows.T / 2, out=scores)  # the largest array of a step: all in place
        np.tanh(scores, out=scores)
        scores += 1
        to_h = scores @ rows[:, :width]
        to_h *= -half
        own *= true
        to_h += own[:, :width]
        to_others = h.T @ scores
        to_others *= -half
        self.words.gradient.fill(0)
        _add_rows(self.words.gradient, w, true * h)
        _add_rows(self.words.gradient, others, to_others.T)
        to_mixed = np.zeros((2, len(used), width), np.float32)
        _add_rows(to_mixed[0], first, to_h)
        _add_rows(to_mixed[1], second, to_h)
        to_mixed = np.concatenate([*to_mixed], axis=1)
        self.context.gradient.fill(0)
        self.context.gradient[used] = to_mixed @ self.mix.x.T
        np.matmul(c.T, to_mixed, out=self.mix.gradient)
        for x in (self.words, self.context, self.mix):
            x.move(self.rate)
        self.seen += size


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; before a text stand ends (class 0), and every text ends in one."""
    w1, w2 = np.zeros_like(ids), np.zeros_like(ids)
    w1[1:], w2[2:] = ids[:-1], ids[:-2]
    w2[starts] = 0
    return w2, w1


@dataclass
class WordTables:
    """What tasks know of words. ``place``: of the held words; arrays by place, and by group."""

    place: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    group_total: np.ndarray  # words + different words + 1, of each group
    unigram: np.ndarray
    tokens: int
    different: int

    @property
    def log_group(self) -> np.ndarray:
        return np.log10(self.group_total)

    def places(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(places, words whose counts aren't held) of words; places of the latter are -1."""
        get = self.place.get
        at = np.array([get(w, -1) for w in words], np.int32)
        return at, [words[i] for i in np.flatnonzero(at < 0).tolist()]

    def classes_at(self, at: np.ndarray, rare: list[bytes]) -> np.ndarray:
        """Classes of words by what :meth:`places` gives."""
        classes = self.classes[at] if len(self.classes) else np.zeros(len(at), np.int64)
        if rare:
            classes[at < 0] = [_group(w) for w in rare]
        return classes

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(places, classes, words whose counts aren't held) of words."""
        at, rare = self.places(words)
        return at, self.classes_at(at, rare), rare


def _texts(column: pa.Array, tables: WordTables) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(first text, end, places, classes, words of each text, words not held) of some _WORDS_AT_ONCE words, or one longer text.

    Words are looked up some _LOOKED_UP at a time, of several short texts together, so that few stand as objects at once.
    """
    texts = utf8(column)
    words, places, rare, lengths, first, n = [], [], [], [], 0, 0
    for i, x in enumerate(texts):
        lengths.append(1)
        for piece in pieces_of(x.lower()):
            own = piece.split()
            words += own
            lengths[-1] += len(own)
            if len(words) >= _LOOKED_UP:
                at, out = tables.places(words)
                places.append(at)
                rare += out
                words = []
        words.append(END)
        n += lengths[-1]
        if n >= _WORDS_AT_ONCE or i + 1 == len(texts):
            at, out = tables.places(words)
            at, rare = np.concatenate([*places, at]), rare + out
            yield first, i + 1, at, tables.classes_at(at, rare).astype(np.int32), np.array(lengths), rare
            words, places, rare, lengths, first, n = [], [], [], [], i + 1, 0


def word_tables(counts: DataFrame, held: int = HELD_WORDS) -> WordTables:
    """The most frequent words of up to HELD_BYTES come to the driver, at most ``held``; of all others only sums by group."""
    # by eighths of a power of two: few bins, of which the most frequent that together fit are held
    bin_ = F.floor(F.log2("c") * 8).cast("int")
    short = counts.filter(F.length("word") <= HELD_BYTES)
    by_bin = sorted(short.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.bin)
    fit = np.searchsorted(np.cumsum([r.n for r in by_bin]), held, side="right")
    least = by_bin[fit - 1].bin if fit else 1 << 30
    top = short.filter((bin_ >= least) | (F.length("word") == 0)).toArrow()
    c = dict(zip((bytes(w) for w in top["word"].to_pylist()), top["c"].to_pylist(), strict=True))
    c.setdefault(END, 0)
    words = [END, *sorted(c.keys() - {END}, key=lambda w: (-c[w], w))]
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    own = words[:OWN_WORDS]
    group = F.expr(f"crc32(substring(word, greatest(length(word) - {SUFFIX - 1}, 1), {SUFFIX})) % {GROUPS}").cast("int")
    by_group = counts.groupBy(group.alias("g")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    total = np.ones(GROUPS, np.int64)
    mass = np.zeros(OWN_WORDS + GROUPS)
    for r in by_group:
        total[r.g] += r.n + r.v
        mass[OWN_WORDS + r.g] += r.n
    for i, w in enumerate(own):  # own words are in no group
        if c[w] or w != END:
            total[_group(w) - OWN_WORDS] -= c[w] + 1
            mass[_group(w)] -= c[w]
        mass[i] = c[w]
    classes = np.array([i if i < OWN_WORDS else _group(w) for i, w in enumerate(words)], np.int64)
    unigram = (mass + 1) / (mass + 1).sum()
    return WordTables({w: i for i, w in enumerate(words)}, np.array([c[w] for w in words], np.int64), classes, total, unigram, int(totals[0] or 0), int(totals[1]))


def shards_for(tokens: int) -> int:
    """Number of shards for so many training tokens."""
    return max(1, round((tokens / SHARD_TOKENS) ** SHARD_POWER))


def sequences(docs: DataFrame, tables: WordTables) -> DataFrame:
    """``key long, piece int, classes binary``: the texts of ``docs`` as classes of 16 bits, in pieces; the key is a hash of the whole row."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("classes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for first, _, _, ids, lengths, _ in _texts(b.column(1), shared.value):
                pieces = -(-lengths // PIECE)
                of = np.repeat(np.arange(len(lengths)), pieces)
                number = np.arange(len(of)) - np.repeat(starts_of(pieces), pieces)
                cuts = np.r_[starts_of(lengths)[of] + number * PIECE, len(ids)] * 2
                data = ids.astype(np.uint16).tobytes()
                rows = [data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield batch_of(schema, keys[first + of], number, rows)

    return docs.select(F.xxhash64(*docs.columns), "text").mapInArrow(run, "key long, piece int, classes binary")


class _Shard:
    """A shard's tokens as they come, taken through SGD in full batches wherever texts begin and end."""

    def __init__(self, trainer: Trainer):
        self.trainer, self.waiting, self.n = trainer, [], 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.waiting.append((*contexts(ids, starts_of(lengths)), ids))
        self.n += len(ids)
        if self.n >= BATCH * _STEPS_AT_ONCE:
            self._steps(self.n - self.n % BATCH)

    def _steps(self, end: int) -> None:
        w2, w1, w = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        for i in range(0, end, BATCH):
            part = slice(i, min(i + BATCH, end))
            self.trainer.step(w2[part], w1[part], w[part])
        self.waiting, self.n = [(w2[end:], w1[end:], w[end:])], self.n - end

    def finish(self) -> Trainer:
        if self.n:
            self._steps(self.n)
        return self.trainer


def train(docs: DataFrame, tables: WordTables, rounds: int = ROUNDS, width: int = WIDTH) -> Parameters:
    """Every shard goes through SGD from the same start; their parameters are averaged by tokens, and the next of ``rounds`` starts from them.

    Parts are added in the order of shards, so reruns agree. Rows that are equal in all columns are in one shard.
    """
    spark, shards = docs.sparkSession, shards_for(tables.tokens)
    shared = spark.sparkContext.broadcast(tables.unigram)
    model = Parameters.initial(tables.unigram, width)
    schema = pa.schema([("slice", pa.int32()), ("shard", pa.int32()), ("tokens", pa.int64()), ("sums", pa.binary())])
    ddl = "slice int, shard int, tokens long, sums binary"
    rows = materialize(sequences(docs, tables), "classes")
    dealt = rows.select(F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int").alias("shard"), "key", "piece", "classes")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "piece", "classes").select("shard", "classes")
    for k in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            def parts(shard: int, trainer: Trainer) -> Iterator[pa.RecordBatch]:
                flat = trainer.p.flat().astype(np.float64) * trainer.seen
                for i, c in enumerate(range(0, len(flat), _SLICE)):
                    yield batch_of(schema, [i], [shard], [trainer.seen], [flat[c : c + _SLICE].tobytes()])

            at = own = None
            for b in batches:
                of = b.column(0).to_numpy()
                lengths = pc.binary_length(b.column(1)).to_numpy().astype(np.int64) // 2
                cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if of[x] != at:
                        if own:
                            yield from parts(at, own.finish())
                        at = int(of[x])
                        own = _Shard(Trainer(start.value, shared.value, seed=(k, at)))
                    ids = np.frombuffer(b"".join(b.column(1)[x:y].to_pylist()), np.uint16).astype(np.int64)
                    own.add(ids, lengths[x:y])
            if own:
                yield from parts(at, own.finish())

        sums = sorted(summed(dealt.mapInArrow(run, ddl), "sums", np.float64, "tokens", "shard").collect(), key=lambda r: r.slice)
        if sums:
            model = model.filled(np.concatenate([np.frombuffer(r.sums, np.float64) / r.tokens for r in sums]))
    discard(rows)
    return model


def log_tables(p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores by first context, scores by second with the bias, log normaliser by second and first), natural logs: batched matrix products."""
    near, far = (p.context @ p.first) @ p.target.T, (p.context @ p.second) @ p.target.T + p.bias
    z = np.empty((len(p.bias), len(p.bias)), np.float32)
    for w1 in range(len(p.bias)):
        s = far + near[w1]
        top = s.max(axis=1)
        z[:, w1] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return near, far, z


def token_log_probs(logs: tuple, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 of the normalised probability of each class in its context."""
    near, far, z = logs
    return (near[w1, w] + far[w2, w] - z[w2, w1]) / np.float32(np.log(10))


def score(docs: DataFrame, tables: WordTables, counts: DataFrame, model: Parameters) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` of rows (doc_id, held_out, text).

    Held words are scored where the text is. The others leave a row for each text and word, join the
    counts and come back as a sum a text. Rows are told apart by the task and place that wrote them, as
    ids may repeat; that table is written before it is read twice.
    """
    sc = docs.sparkSession.sparkContext
    shared, logs = sc.broadcast(tables), sc.broadcast(log_tables(model))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        log_count, log_group = np.log10(t.counts + 1), t.log_group
        places, base = np.arange(len(t.counts)), np.log10(t.tokens + t.different + 1)
        within = np.where(places < OWN_WORDS, 0.0, log_count - log_group[np.where(places < OWN_WORDS, 0, t.classes - OWN_WORDS)])
        row = TaskContext.get().partitionId() << 40

        for b in batches:
            ids, held = b.column(0).cast(pa.int64()), b.column(1)
            for first, end, at, classes, n, rare in _texts(b.column(2), t):
                starts, text = starts_of(n), np.repeat(np.arange(len(n), dtype=np.int32), n)
                w2, w1 = contexts(classes, starts)
                own, plain, known = np.zeros(len(n)), -n * base, np.zeros(len(n), np.int64)
                for c in range(0, len(at), _WORDS_AT_ONCE):
                    part = slice(c, c + _WORDS_AT_ONCE)
                    place, of, out = at[part], text[part], at[part] < 0
                    p = token_log_probs(logs.value, w2[part], w1[part], classes[part]).astype(np.float64)
                    p += np.where(out, -log_group[np.where(out, classes[part] - OWN_WORDS, 0)], within[place])
                    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    own[of[cuts]] += np.add.reduceat(p, cuts)
                    plain[of[cuts]] += np.add.reduceat(np.where(out, 0.0, log_count[place]), cuts)
                    known[of[cuts]] += np.add.reduceat(~out & (t.counts[place] > 0), cuts, dtype=np.int64)
                ends = np.r_[0, np.cumsum(np.add.reduceat(at < 0, starts, dtype=np.int64))]
                by_text = [Counter(rare[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                columns = [np.arange(row, row + len(n)), ids[first:end], held[first:end], n, known, plain, own, [list(c) for c in by_text], [list(c.values()) for c in by_text]]
                row += len(n)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, schema.types, strict=True)], schema=schema)

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, rare array<binary>, times array<int>"
    scored = materialize(docs.select("doc_id", "held_out", "text").mapInArrow(run, ddl), "lm")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    sums = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    out = scored.drop("rare", "times").join(sums, "row", "left")
    logs_ = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + logs_).alias("base_score"), (F.col("own") + logs_).alias("score"))


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learns from rows whose ``crc32(doc_id)`` modulo 7 is not 2 (a null id counts as empty text). A null
    text is empty: its one token is its end. A long text is read in pieces, as one sequence. Words never seen count 0 and share their group's spare
    place. Rows that repeat come out as often; other columns are ignored; an empty table gives an
    empty one. With nothing to learn from, the base gives each token probability 1 and the model its start.
    How the input is split makes no difference to the model, and none to a score but in the last digits of sums.
    """
    docs = docs.select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    learned = docs.filter("not held_out")
    counts = materialize(word_counts(learned), "words")
    tables = word_tables(counts)
    model = train(learned, tables, rounds)
    return score(docs, tables, counts, model).withColumn("train_tokens", F.lit(tables.tokens).cast("long"))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))

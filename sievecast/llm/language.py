"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, returning, starts_of, summed, table, text_slices

ORDERS, BUCKETS, SMOOTHING = (2, 3), 1 << 16, 0.5
UNKNOWN = "und"
#: Buckets summed in one group when the counts of all tasks meet.
SLICE = 4096
#: Most bytes of model that are broadcast; more languages get fewer buckets.
MODEL_BYTES = 256 << 20
_LETTER = regex.compile(r"\p{L}")


def _grams(parts: list[str], own: np.ndarray, orders: tuple[int, ...], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams that start at each character of the parts, laid end to end; the other result is where each part starts.

    Every part is followed by as many separators as keep it apart from the next; an n-gram that starts at
    a separator, or behind the first ``own`` characters of its part, gets the bucket after the last, which
    counts for nothing.
    """
    pad = max(orders) - 1
    joined = np.frombuffer(("\0" * pad).join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) for x in parts], np.int64)
    starts = starts_of(lengths + pad)
    apart = joined == 0
    for k in np.flatnonzero(own < lengths):
        apart[starts[k] + own[k] : starts[k] + lengths[k]] = True
    out = []
    for n in orders:
        h = np.full(len(joined), n, np.uint32)
        for i in range(n):
            h *= np.uint32(0x9E3779B1)
            h[: len(joined) - i] ^= joined[i:]
        h *= np.uint32(0x85EBCA6B)
        h = (h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)
        h[apart] = buckets
        out.append(h)
    return out, starts


def _parts(texts: list[str], tail: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(text, characters, how many of them count here), some ``at_once`` characters at a time. A long text comes in parts, each with the ``tail`` characters after it."""
    rows, parts, own, size = [], [], [], 0
    for k, x in enumerate(texts):
        x = x.lower()
        for at in range(0, max(1, len(x)), at_once):
            rows.append(k)
            parts.append(x[at : at + at_once + tail])
            own.append(min(at_once, len(x) - at))
            size += own[-1]
            if size >= at_once:
                yield np.array(rows), parts, np.array(own)
                rows, parts, own, size = [], [], [], 0
    if rows:
        yield np.array(rows), parts, np.array(own)


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob``: (languages, buckets + 1) with a last column of zeros; ``prior``: log share of documents."""

    languages: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods by language and text, n-grams of each text)."""
        logs, n = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts), np.int64)
        for rows, parts, own in _parts(texts, max(self.orders) - 1):
            grams, starts = _grams(parts, own, self.orders, self.log_prob.shape[1] - 1)
            np.add.at(n, rows, own * len(self.orders))
            for h in grams:
                for row, of_language in zip(logs, self.log_prob, strict=True):
                    np.add.at(row, rows, np.add.reduceat(of_language[h], starts, dtype=np.float64))
        return logs, n

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, their posterior probabilities, and the evidence: how much likelier, by natural log and n-gram, the text is in that language than where all buckets are equally likely.

        ``und``, 0 and 0 without a letter or without a model. Of equal posteriors the first language by code points wins.
        """
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        likelihood, n = self.logs(texts)
        logs = likelihood + self.prior[:, None]
        best = logs.argmax(axis=0)
        score = 1 / np.exp(logs - logs.max(axis=0)).sum(axis=0)
        evidence = likelihood[best, np.arange(len(texts))] / np.maximum(n, 1) + np.log(self.log_prob.shape[1] - 1)
        known = np.array([_LETTER.search(x) is not None for x in texts])
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, evidence, 0.0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and their posterior probabilities."""
        return self.judge(texts)[:2]


def train(labelled: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> LanguageModel:
    """Fit on every row of ``text, lang`` whose lang is not null.

    Each task keeps a dense count of buckets a language (bounded by languages x buckets) and sends
    slices of it; slices are summed by (language, slice). Only the summed matrix reaches the driver.
    Buckets are halved until the model of all languages fits in ``MODEL_BYTES``.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets: a power of two")
    known = labelled.filter("lang is not null").select("lang").distinct().count()
    while known * buckets * 4 > MODEL_BYTES and buckets > 2:
        buckets //= 2
    counted = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for some in text_slices(b.column(0)):
                langs = b.column(1)[some].to_pylist()
                for x in langs:
                    counts.setdefault(x, np.zeros(buckets + 1, np.int64))[buckets] += 1  # the last entry counts documents
                for rows, parts, own in _parts([x or "" for x in b.column(0)[some].to_pylist()], max(orders) - 1):
                    grams, starts = _grams(parts, own, orders, buckets)
                    of_part = [langs[r] for r in rows]
                    ids = {x: i for i, x in enumerate(dict.fromkeys(of_part))}
                    place = np.repeat([ids[x] for x in of_part], np.diff(np.r_[starts, len(grams[0])])) * (buckets + 1)
                    total = sum(np.bincount(place + h, minlength=len(ids) * (buckets + 1)) for h in grams).reshape(len(ids), -1)
                    for x, i in ids.items():
                        counts[x][:buckets] += total[i, :buckets]
        for x, own in counts.items():
            cuts = range(0, buckets + 1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([own[c : c + SLICE].tobytes() for c in cuts], pa.binary())], schema=counted)

    ddl = "lang string, slice int, counts binary"
    counts = labelled.filter("lang is not null").select("text", "lang").mapInArrow(returning(count), ddl)
    rows = summed(counts, "counts", np.int64).collect()
    langs = tuple(sorted({r.lang for r in rows}))
    if len(langs) * buckets * 4 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages of {buckets} buckets are over the {MODEL_BYTES} bytes to broadcast; give fewer buckets")
    matrix = np.zeros((len(langs), -(-(buckets + 1) // SLICE) * SLICE), np.int64)
    for r in rows:
        part = np.frombuffer(r.counts, np.int64)
        matrix[langs.index(r.lang), r.slice * SLICE : r.slice * SLICE + len(part)] = part
    n, documents = matrix[:, :buckets], matrix[:, buckets]
    log_prob = np.zeros((len(langs), buckets + 1), np.float32)
    log_prob[:, :buckets] = np.log((n + smoothing) / (n.sum(axis=1, keepdims=True) + smoothing * buckets)) if langs else 0
    return LanguageModel(langs, np.log(documents / max(1, documents.sum())), log_prob, orders)


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row plus ``lang_pred, score, evidence``. Only the column ``text`` is looked at, and goes to Python once; the model is broadcast, at most ``MODEL_BYTES``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, at = len(keep), keep.index(text) if text in keep else len(keep)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("evidence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in text_slices(b.column(at)):
                names, scores, evidence = shared.value.judge([x or "" for x in b.column(at)[some].to_pylist()])
                columns = [*(c[some] for c in b.columns[:kept]), pa.array(names, pa.string()), pa.array(scores), pa.array(evidence)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "evidence"])

    return (docs.select(*keep) if at < kept else docs.select(*keep, text)).mapInArrow(returning(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, evidence`` of every row of ``docs`` (doc_id, text, lang).

    Learns from rows with a lang whose ``crc32(doc_id)`` modulo 4 is not 2 (a null id counts as
    empty text); lang is not used otherwise. Null texts and texts without a letter, empty ones
    included, are ``und`` with score 0; with nothing to learn from, all are. Of equally likely languages
    the first by code points is named. Rows that repeat come out as often; other columns are ignored,
    whatever their names; an empty table gives an empty one. Texts are read whole, long ones part by part.
    """
    docs = docs.select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    model = train(docs.filter("not held_out"))
    return predict(docs, model, ("doc_id", "held_out"))


def accepted(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` without those that language ID rejects: no letter, or evidence below ``least``, so that no language explains the text better than chance.

    A short text that is likely in several languages stays. Null texts go, as they have no letter; rows
    that repeat stay as often; columns keep their names and values, whatever the names; an empty table
    gives an empty one. Where no row has a lang, nothing can be told, and every row with a letter goes too.
    """
    model = train(docs.filter(fold("doc_id", 4) != 2).select("text", "lang"))
    carried = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = predict(carried, model, tuple(carried.columns), f"c{docs.columns.index('text')}").filter((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= least))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))

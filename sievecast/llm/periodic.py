"""Runs of repeated words: dyadic blocks are searched in the windows beside them, by range successor in a wavelet tree over the suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, returning, table, text_slices, utf8
from .suffixes import FIRST, Numbered, sorted_levels

#: Words that a run has at least, and words of texts that are searched together.
SHORTEST, BATCH_WORDS = 12, 1 << 18
_KEPT = 400_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


class Wavelet:
    """A wavelet tree over an array of numbers, its levels one below the other: each has its bits, packed, with the ones before every 64."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            one = (values >> b & 1).astype(bool)
            packed = np.zeros((len(one) // 64 + 1) * 8, np.uint8)
            packed[: (len(one) + 7) // 8] = np.packbits(one, bitorder="little")
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((b, words, before, len(one) - int(before[-1])))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        return before[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers in [low, high) are below x."""
        n = np.zeros(len(low), np.int64)
        for b, words, before, zeros in self.levels:
            a, z = self._ones(words, before, low), self._ones(words, before, high)
            up = x >> b & 1 == 1
            n += np.where(up, (high - low) - (z - a), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + z, high - z)
        return n

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number in [low, high) that k others are below: with ``below(x)`` for k, the successor of x."""
        value = np.zeros(len(low), np.int64)
        for b, words, before, zeros in self.levels:
            a, z = self._ones(words, before, low), self._ones(words, before, high)
            down = (high - low) - (z - a)
            up = k >= down
            k = np.where(up, k - down, k)
            value |= np.where(up, 1 << b, 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + z, high - z)
        return value


class _Names:
    """Numbers of all stretches of 4, 8, 16 ... words, equal for equal ones: how far two places agree, by descent over the lengths."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.levels, self.suffixes = codes, [], np.zeros(0, np.int32)
        for length, suffixes, ranks in sorted_levels(codes):
            self.levels.append((length, ranks.copy()))
            self.suffixes = suffixes

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and b on are equal, a before b in one text. Nothing runs over its end: there is 0, where b comes first."""
        n = np.zeros(len(a), np.int64)
        for length, names in reversed(self.levels):
            n += np.where(names[a + n] == names[b + n], length, 0)
        for _ in range(FIRST - 1):
            n += self.codes[a + n] == self.codes[b + n]
        return n

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and b are equal; a comes first to the text's start."""
        n = np.zeros(len(a), np.int64)
        for length, names in reversed(self.levels):
            at = a - n - length
            n += np.where((at >= 0) & (names[np.maximum(at, 0)] == names[np.maximum(b - n - length, 0)]), length, 0)
        for _ in range(FIRST - 1):
            at = a - n - 1
            n += (at >= 0) & (self.codes[np.maximum(at, 0)] == self.codes[np.maximum(b - n - 1, 0)])
        return n


def _candidates(names: _Names, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, distances`` at which a dyadic block stands again in the windows beside it.

    A run of period q and at least 2q words has q and more places at which it equals what is q further, so
    a whole block of length B lies among them if q >= 2B - 1, and is found at the distances 2B - 1 to 4B - 2.
    Blocks of 4 stand every 3 words and so find all runs of 12 words whose period is below that, too. In a
    window of B places the occurrences of a block are one arithmetic progression: first, second and last say
    them all. Of three and more, those in the block's own run have multiples of its period as distances,
    and only what stands outside of it can be another period.
    """
    codes, n = names.codes, len(names.codes)
    often = np.bincount(names.levels[0][1], minlength=n)
    kept = often[names.levels[0][1][names.suffixes]] > 1  # a block that stands once has nothing to be searched
    place = np.concatenate([[0], np.cumsum(kept)])
    tree = Wavelet(names.suffixes[kept].astype(np.int64), max(1, n.bit_length()))
    for length, ranks in names.levels:
        stride, near, far = (FIRST - 1, 1, 4 * FIRST - 2) if length == FIRST else (length, 2 * length - 1, 4 * length - 2)
        sizes = often if length == FIRST else np.bincount(ranks, minlength=n)
        at = np.arange(0, n - length + 1, stride)
        at = at[sizes[ranks[at]] > 1]
        stop = ends[np.searchsorted(ends, at)] - length  # the last place of a block in the text
        at, stop = at[at <= stop], stop[at <= stop]
        low, high = place[ranks[at]], place[ranks[at] + sizes[ranks[at]]]
        last = np.minimum(at + far, stop)
        some = tree.below(low, high, at + near) < tree.below(low, high, np.maximum(last + 1, at + near))
        at, low, high, last = at[some], low[some], high[some], last[some]
        for shift in range(near, far + 1, length):
            final = np.minimum(at + min(shift + length - 1, far), last)
            a, z = tree.below(low, high, at + shift), tree.below(low, high, np.maximum(final + 1, at + shift))
            here = np.flatnonzero(a < z)
            i, lo, hi, a, z = at[here], low[here], high[here], a[here], z[here]
            if not len(i):
                continue
            x0 = tree.smallest(lo, hi, a)
            step = np.where(z - a > 1, tree.smallest(lo, hi, np.minimum(a + 1, z - 1)) - x0, 1)
            count, begin = z - a, np.zeros(len(i), np.int64)
            if length > FIRST:
                many = np.flatnonzero(count > 2)
                own = i[many] + step[many] + names.ahead(i[many], i[many] + step[many])
                begin[many] = np.clip((own - length - x0[many]) // step[many] + 1, 0, count[many])
            left = count - begin
            whose = np.repeat(np.arange(len(i)), left)
            k = np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left - begin, left)
            yield i[whose], x0[whose] + k * step[whose] - i[whose]


def runs_of(codes: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, stop, period`` of all runs of texts that stand one after another, each with a 0 behind it at ``ends``: maximal stretches of at least ``shortest`` words and twice their smallest period. In order of start, then period."""
    if shortest < SHORTEST:
        raise ValueError(f"shortest: at least {SHORTEST}, as blocks of {FIRST} words find them")
    names = _Names(codes)
    found = []
    for i, q in _candidates(names, ends):
        start, stop = i - names.back(i, i + q), i + q + names.ahead(i, i + q)
        good = stop - start >= np.maximum(shortest, 2 * q)
        found.append(np.unique(np.stack([start[good], stop[good], q[good]]), axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    # equal stretches: the smallest period is theirs, as the others are its multiples
    start, stop, period = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[first], stop[first], period[first]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _rows(doc_ids: list, parts: list[np.ndarray], lengths: list[int], names: list[bytes], shortest: int) -> pa.RecordBatch:
    """Runs and collapsed texts of gathered documents. ``parts`` are their codes, each document's with a 0 behind."""
    codes = np.concatenate(parts)
    sizes = np.array(lengths, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    start, stop, period = runs_of(codes, ends, shortest)
    doc = np.searchsorted(ends, start)
    change = np.zeros(len(codes) + 1, np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    kept = np.cumsum(change[:-1]) == 0
    texts = []
    for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
        texts.append(b" ".join([names[k - 1] for k in codes[a:z][kept[a:z]].tolist()]))
    offsets = np.searchsorted(doc, np.arange(len(lengths) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - begins[doc], stop - start, period)], fields=list(_RUN))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), runs).cast(pa.list_(_RUN)), pa.array(texts, pa.binary()).view(pa.string())], schema=_ARROW)


def repeated_runs(docs: DataFrame, shortest: int = SHORTEST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row of ``docs`` (doc_id, text).

    Words are parted by ASCII white space and numbered from 0. A run is a stretch of at least ``shortest``
    words and twice its smallest period, as long as it goes; ``runs`` has (start, length, period) of all, by
    start and period. ``collapsed`` has the words that no run has behind its first period, with single blanks.
    Texts are searched together, some ``batch_words`` at once, a longer one alone, in some 200 bytes a word.
    Nothing is shuffled.

    Null and empty texts have no runs and are empty. Repeated rows come out as often, null ids stay null; other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, ids, parts, lengths, n = Numbered(), [], [], [], 0
        for b in batches:
            for part in text_slices(b.column(1)):
                for doc_id, text in zip(b.column(0)[part.start : part.stop].to_pylist(), utf8(b.column(1)[part.start : part.stop]), strict=True):
                    own = [numbered.codes(p.split()) for p in pieces_of(text)]
                    ids.append(doc_id)
                    lengths.append(sum(map(len, own)))
                    parts += [*own, np.zeros(1, np.int32)]
                    n += lengths[-1] + 1
                    if n >= batch_words:
                        yield _rows(ids, parts, lengths, list(numbered), shortest)
                        ids, parts, lengths, n = [], [], [], 0
                        if len(numbered) > _KEPT:
                            numbered = Numbered()
        if ids:
            yield _rows(ids, parts, lengths, list(numbered), shortest)

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a tenth of the texts, chosen by crc32 of the id (null: empty), going on periodically from one of their words; these come with single blanks, the others as they are."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("long"))
    g = F.floor(F.col("h") / 10)
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))))
    periodic = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = repeated_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    out = out.withColumn("_best", best)
    start, length, period = F.col("_best.s"), -F.col("_best.l"), F.col("_best.p")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    milli = F.floor(1000 * length / period).cast("long")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))

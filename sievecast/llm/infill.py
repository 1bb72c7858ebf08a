"""Fill-in-middle: texts cut at two unit ends and put together in another order, found by arithmetic on 8 bytes at once."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, returning, table, text_slices

SEED = 42
#: Of 100 texts with a cut, how many stay as they are, and how many of the others have the suffix first.
PLAIN, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _each(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


_HIGH = _each(0x80)


def white_bytes(x: np.ndarray) -> np.ndarray:
    """The high bit of each byte of the words that is 0x20 or 0x09 to 0x0D. Sums of seven bits never carry into the next byte."""
    low = x & ~_HIGH
    control = (low + _each(0x80 - 0x09)) & ~(low + _each(0x80 - 0x0E))
    blank = ~((low ^ _each(0x20)) + _each(0x7F))
    return (control | blank) & ~x & _HIGH


class _Marks:
    """Marked bytes of little-endian words, with how many are marked before each word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bytes before ``at`` are marked."""
        word = at >> 3
        below = (np.uint64(1) << (at & 7).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th marked byte is, k from 1; anything for a k that there is none for."""
        word = np.minimum(np.searchsorted(self.before[1:], k), len(self.marks) - 1)
        left, x = k - self.before[word], self.marks[word]
        for _ in range(7):
            x = np.where(left > 1, x & (x - np.uint64(1)), x)
            left = left - 1
        lowest = x & (~x + np.uint64(1))
        return (word << 3) + (np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)


class Units:
    """The units of texts that lie one after another in ``data``: words with the white space before them, and white space at a text's end. ``bounds`` are the texts' starts and the last one's end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        padded = np.full((len(data) // 8 + 1) * 8, 0x20, np.uint8)
        padded[: len(data)] = data
        x = padded.view("<u8")
        white = white_bytes(x)
        following = white >> np.uint64(8)
        following[:-1] |= white[1:] << np.uint64(56)
        following[-1] |= np.uint64(0x80 << 56)
        ends = ~white & _HIGH & following
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << (last & 7).astype(np.uint64) * np.uint64(8))
        self._ends = _Marks(ends)
        self._chars = _Marks(_HIGH & ~(x & ~(x << np.uint64(1))))
        self._starts, self._first = bounds[:-1], self._ends.rank(bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self._first)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Of each text, the byte behind its first k units."""
        return np.where(k > 0, self._ends.select(np.maximum(self._first[:-1] + k, 1)) + 1, self._starts)

    def chars(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Code points between two bytes."""
        return self._chars.rank(stop) - self._chars.rank(start)


def _rearranged(doc_ids: pa.Array, texts: pa.Array, seed: int) -> pa.RecordBatch:
    column = pc.fill_null(texts.cast(pa.binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = (memoryview(buffer) if buffer is not None else memoryview(b""))[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    units = Units(np.frombuffer(data, np.uint8), bounds)
    n = units.counts()
    h = np.array([struct.unpack(">4I", sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16]) for i in doc_ids.to_pylist()], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    first, second = units.cut(cuts[:, 0]), units.cut(cuts[:, 1])
    prefix, middle = units.chars(bounds[:-1], first), units.chars(first, second)
    own = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    whole = data.tobytes()
    p, s, m = own
    forms, outputs = [], []
    for start, a, b, stop, (_, _, h3, h4) in zip(bounds[:-1].tolist(), first.tolist(), second.tolist(), bounds[1:].tolist(), h.tolist(), strict=True):
        if start == stop or h3 % 100 >= PLAIN or any(whole.find(x, start, stop) >= 0 for x in own):
            forms.append("plain")
            outputs.append(whole[start:stop])
        elif h4 % 100 < SUFFIX_FIRST:
            forms.append("spm")
            outputs.append(b"".join((s, whole[b:stop], p, whole[start:a], m, whole[a:b])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, whole[start:a], s, whole[b:stop], m, whole[a:b])))
    plain = np.array([f == "plain" for f in forms], bool)
    return batch_of(_ARROW, doc_ids.cast(pa.int64()), n, forms, pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(outputs, pa.binary()).view(pa.string()))


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs`` (doc_id, text).

    A text of n units is cut after two numbers of them, drawn from a hash of seed and doc_id, and put
    together as psm (prefix, suffix, middle, each behind its mark), spm (suffix, prefix, middle), or left plain.
    The units' ends are marked eight bytes at once, counted a word, found by a search of the counts and
    resolved in the word. Nothing is shuffled; texts are taken some 1 MB at once, a longer one alone.

    Null and empty texts have no unit and are plain and empty, texts with a mark in them plain. A null id
    draws as an empty one. Repeated rows come out as often; other columns are ignored, whatever their names;
    an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b.column(1)):
                yield _rearranged(b.column(0)[part.start : part.stop], b.column(1)[part.start : part.stop], seed)

    return docs.select("doc_id", "text").mapInArrow(returning(run), _SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made an output of, from output and form alone."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    inner = F.substr(head, F.lit(1 + len(PREFIX)))
    psm = F.concat(F.substring_index(inner, SUFFIX, 1), middle, F.substring_index(inner, SUFFIX, -1))
    spm = F.concat(F.substring_index(inner, PREFIX, -1), middle, F.substring_index(inner, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS k2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(k1, k2)], '') AS prefix, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle, array_to_string(u[greatest(k1, k2) + 1:], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

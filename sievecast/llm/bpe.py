"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece, BPE has one encoding, and so one last token. A token t that ends at i
and starts at j is that token if and only if the pair (last token of the prefix up to j, t) is
compatible: BPE would leave the two side by side. So ``last[i]`` follows from earlier entries, the
encoding is read off backwards, appends only add entries, and an edit only renews those near it.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returning, table, text_slices

#: Bytes of pieces and their ids in one generation of a Python worker's memory; pairs of tokens that it remembers.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 48 << 20, 300_000
#: Texts up to this long are searched whole, some at a time; of longer ones, so many pieces at a time.
_CHARACTERS_AT_ONCE, _PIECES_AT_ONCE = 1 << 19, 1 << 16
_ENTRY_BYTES = 180
_ID = struct.Struct("=i").pack


class Vocabulary:
    """Token ranks of a tiktoken file, with what prefix encoding needs of them."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        self.token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.longest = max(map(len, self.rank), default=0)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.beside_of: dict[int, dict[int, bool]] = {}
        self._pairs = 0
        #: Rank of each token, -1 for what only begins one: where a token's search can stop.
        self.begins = {token[:n]: -1 for token in self.rank for n in range(1, len(token))} | self.rank

    def merged(self, text: bytes, below: int | None = None) -> list[int]:
        """Plain BPE, by definition: the adjacent parts with the lowest rank merge, leftmost first. ``below``: only such ranks."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None and (below is None or r < below)), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        if token not in self._halves:
            parts = self.merged(self.token[token], token) if len(self.token[token]) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both leaves them side by side.

        Merges are undone from the last: at each moment the two tokens at the seam must not have
        merged before the merge that took one of them away. Of equal ranks, the left one goes first.
        """
        a, b, before = left, right, len(self.token) + 1
        while True:
            across = self.rank.get(self.token[a] + self.token[b])
            if across is not None and across < before:
                out = False
                break
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a and (a > b or not of_b):
                a, before = of_a[1], a
            elif of_b:
                b, before = of_b[0], b + 1
            else:
                out = True
                break
        self._pairs += 1
        if self._pairs > REMEMBERED_PAIRS:
            self.beside_of.clear()
            self._pairs = 1
        self.beside(left)[right] = out
        return out

    def beside(self, left: int) -> dict[int, bool]:
        """What is known of the tokens after this one."""
        return self.beside_of.setdefault(left, {})

    def encode_piece(self, piece: bytes) -> list[int]:
        return [self.rank[piece]] if piece in self.rank else Prefixes(self, piece).ids()


class Prefixes:
    """The last token of every prefix of a text of bytes; grows by ``append`` and follows ``replace``."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        old = len(self.text)
        self.text += more
        self.last += [-1] * len(more)
        self._tokens_from(max(0, old - self.vocabulary.longest), len(self.text), old)

    def follow(self, text: bytes) -> None:
        """Become the table of ``text``: the entries of what both texts begin with stay, the rest is appended."""
        own, same = self.text, len(commonprefix((self.text, text)))
        self.text = own[:same]
        del self.last[same + 1 :]
        self.append(text[same:])

    def _tokens_from(self, first: int, stop: int, known_to: int = 0) -> None:
        """From each place from ``first`` to ``stop``, enter the tokens that are the last of a prefix with no entry yet. All prefixes up to there, or to ``known_to``, have theirs."""
        v, text, last = self.vocabulary, self.text, self.last
        begins, beside, n = v.begins.get, v.beside_of.get, len(text)
        for start in range(first, stop):
            before = last[start]
            known = beside(before) or v.beside(before)
            for end in range((start if start > known_to else known_to) + 1, n + 1):
                token = begins(text[start:end])
                if token is None:
                    break
                if token >= 0 and last[end] < 0:
                    fits = known.get(token) if start else True
                    if v.compatible(before, token) if fits is None else fits:
                        last[end] = token
            if start < n and last[start + 1] < 0:
                raise ValueError(f"the vocabulary leaves the prefix of {start + 1} bytes without a token")

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for the bytes from start to end; returns how many prefixes were encoded anew.

        An entry depends on the entries and bytes of one longest token before it. After the edit, once as
        many entries in a row are what they were, all that follow are as well.
        """
        old_text, old, longest = self.text, self.last, self.vocabulary.longest
        self.text = old_text[:start] + new + old_text[end:]
        self.last = old[: start + 1] + [-1] * (len(self.text) - start)
        shift, same = len(new) - (end - start), 0
        for at in range(max(0, start - longest), len(self.text)):
            if at > start:
                same = same + 1 if at - shift > end and self.last[at] == old[at - shift] else 0
                if same >= longest:
                    self.last[at + 1 :] = old[at - shift + 1 :]
                    return at - start
            self._tokens_from(at, at + 1)
        return len(self.text) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece; a memory of pieces, bounded in bytes, serves words that repeat.

    Pieces are remembered in two generations: when the younger is full it becomes the older, and what is
    asked for again comes over, so frequent pieces stay.
    """

    def __init__(self, data: bytes, pattern: str, remembered: int = REMEMBERED_BYTES):
        self.vocabulary, self.pattern = Vocabulary(data), regex.compile(pattern)
        self.find, self.remembered = self.pattern.findall, remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._bytes = 0
        tokens = self.vocabulary.token
        self._tokens = pa.array(tokens, pa.large_binary())
        self._lengths = np.array([len(t) for t in tokens], np.int64)

    def _learn(self, pieces: set[str]) -> None:
        """Make sure that ``known`` has these pieces. New ones are encoded in sorted order, so each table follows from the one before."""
        new = pieces.difference(self.known)
        if not new:
            return
        if self._bytes > self.remembered:
            self.older, self.known, self._bytes = self.known, {}, 0
            new = pieces
        known, rank, table = self.known, self.vocabulary.rank, Prefixes(self.vocabulary)
        older = self.older
        for p, raw in sorted(((p, p.encode()) for p in new), key=lambda x: x[1]):
            ids = older.get(p)
            if ids is None:
                if raw in rank:
                    ids = _ID(rank[raw])
                else:
                    table.follow(raw)
                    ids = np.array(table.ids(), np.int32).tobytes() if len(raw) > 1000 else b"".join(map(_ID, table.ids()))
            known[p] = ids
            self._bytes += len(raw) + len(ids) + _ENTRY_BYTES

    def raw_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers. A long text's pieces are taken some at a time."""
        long = [len(x) > _CHARACTERS_AT_ONCE for x in texts]
        pieces = [() if far else self.find(x) for x, far in zip(texts, long, strict=True)]
        self._learn(set().union(*pieces))
        get = self.known.__getitem__
        out = [b"".join(map(get, x)) for x in pieces]
        for i, far in enumerate(long):
            if far:
                matches, parts = self.pattern.finditer(texts[i]), []
                while some := [m.group() for m in islice(matches, _PIECES_AT_ONCE)]:
                    self._learn(set(some))
                    parts.append(b"".join(map(self.known.__getitem__, some)))
                out[i] = b"".join(parts)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.raw_ids(texts)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """What each run of ids decodes to; run i is ``ids[cuts[i]:cuts[i + 1]]``. The tokens of all runs are laid end to end and cut anew."""
        offsets = np.r_[0, np.cumsum(self._lengths[ids])][cuts]
        data = self._tokens.take(pa.array(ids)).buffers()[2] if len(ids) else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data])


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary; kept from task to task."""
    key = (hash(data), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data, pattern)
    return _encoders[key]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary``: every whole text's token ids, and the bytes they decode to.

    The vocabulary file is read once and broadcast (a fixed size, a megabyte). No row depends on another,
    so nothing is shuffled. Null texts count as empty, and have no ids. A long text is searched some
    pieces at a time; one piece, a run without a break, is held whole with a table entry a byte. Equal
    texts get equal ids: of adjacent pairs of equal rank the left one merges first. Rows that repeat come
    out as often; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value, pattern)
        for b in batches:
            doc_ids = b.column(0).cast(pa.int64())
            for some in text_slices(b.column(1), _CHARACTERS_AT_ONCE):
                raw = own.raw_ids([x or "" for x in b.column(1)[some].to_pylist()])
                cuts = np.r_[0, np.cumsum([len(x) for x in raw])] // 4
                ids = np.frombuffer(b"".join(raw), np.int32)
                del raw
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([doc_ids[some], lists, own.decode_all(ids, cuts)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, ids array<int>, decoded binary")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

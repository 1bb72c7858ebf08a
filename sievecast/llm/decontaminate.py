"""Benchmark decontamination: suffix arrays of shards of the documents, in which every suffix of the benchmark is searched."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, discard, materialize, pieces_of, returning, table, text_slices, utf8
from .suffixes import Numbered, suffix_array

#: Words of a window.
WINDOW = 10
#: Words of the documents that one suffix array sorts, of the benchmark that one broadcast holds, and of an item that stay in one piece.
SHARD_WORDS, BLOCK_WORDS, PIECE_WORDS = 1 << 20, 1 << 18, 1 << 14
#: Bytes of words that one broadcast holds at most.
BLOCK_BYTES = 1 << 24
#: A longer word stands by its hash in the benchmark's blocks.
LONG_WORD = 64
_KEPT, _REMEMBERED = 400_000, 20_000
#: ASCII but digits and letters parts words; A-Z is lower-cased. As ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased texts.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _short(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\0" + sha256(word).digest()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    for b in batches:
        for part in text_slices(b.column(1)):
            yield from zip(b.column(0)[part.start : part.stop].to_pylist(), utf8(b.column(1)[part.start : part.stop]), strict=True)


def item_pieces(items: DataFrame, overlap: int) -> DataFrame:
    """``item_id string, start, n, words``: the words of each item (item_id, text) in pieces of PIECE_WORDS that overlap by ``overlap`` words; n words of a piece are its own. Items without a word have none; equal pieces of an id stand once."""
    schema = pa.schema([("item_id", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, text in _texts(batches):
            start, left = 0, []
            parts = [p.split() for p in pieces_of(text.translate(_LETTERS))]
            for k, words in enumerate(parts):
                left += map(_short, words)
                while len(left) > PIECE_WORDS + overlap or (k == len(parts) - 1 and left):
                    own = min(PIECE_WORDS, len(left))
                    if len(left) <= PIECE_WORDS + overlap:
                        own = len(left)
                    yield batch_of(schema, [name], [start], [own], [left[: own + overlap]])
                    left, start = left[own:], start + own

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(returning(run), "item_id string, start long, n long, words array<binary>").distinct()


@dataclass
class Block:
    """Some pieces of the benchmark, as one task needs them: for every suffix its words up to the piece's end, and for the first of equal windows its length and who has it."""

    words: list[bytes]
    codes: np.ndarray
    rest: np.ndarray
    window: np.ndarray
    owners: np.ndarray
    sets: list[list[str]]
    item: list[str]
    place: np.ndarray

    @classmethod
    def of(cls, pieces: pa.Table, size: int) -> Block:
        names, starts, own, lists = (pieces.column(c).combine_chunks() for c in ("item_id", "start", "n", "words"))
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        codes, n = flat.indices.to_numpy().astype(np.int32), int(lengths.sum())
        piece = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rest = lengths[piece] - at
        alone = (lengths[piece] < size) & (starts.to_numpy()[piece] == 0) & (own.to_numpy()[piece] == lengths[piece])
        length = np.where((rest >= size) & (at < own.to_numpy()[piece]), size, np.where(alone & (at == 0), lengths[piece], 0))
        begins = np.flatnonzero(length)
        rows = np.full((len(begins), size + 1), -1, np.int32)
        for k in range(size):
            inside = length[begins] > k
            rows[inside, k] = codes[begins[inside] + k]
        rows[:, size] = length[begins]
        _, first, kind = np.unique(rows.view([("", np.int32)] * (size + 1)).ravel(), return_index=True, return_inverse=True)
        holders = names.dictionary_encode()
        item = holders.indices.to_numpy()[piece[begins]]
        pairs = np.unique(kind.astype(np.int64) * max(len(holders.dictionary), 1) + item)
        kinds, members = pairs // max(len(holders.dictionary), 1), pairs % max(len(holders.dictionary), 1)
        named, known, sets = holders.dictionary.to_pylist(), {}, []
        owners = np.full(n, -1, np.int32)
        bounds = np.searchsorted(kinds, np.arange(len(first) + 1))
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            key = members[a:b].tobytes()
            if key not in known:
                known[key] = len(sets)
                sets.append([named[x] for x in members[a:b]])
            owners[begins[first[k]]] = known[key]
        window = np.zeros(n, np.int32)
        window[begins[first]] = length[begins[first]]
        return cls(flat.dictionary.to_pylist(), codes, rest.astype(np.int32), window, owners, sets, [named[k] for k in holders.indices.to_numpy()], np.stack([piece, starts.to_numpy()[piece] + at]))


@dataclass
class Blocks:
    """The benchmark's blocks, broadcast one by one, and the words of its longest piece."""

    parts: list[Broadcast]
    longest: int

    def __iter__(self) -> Iterator[Block]:
        for part in self.parts:
            yield part.value if len(self.parts) == 1 else part.load_from_path(part._path)


def blocks_of(items: DataFrame, size: int, block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """The benchmark (item_id, text) in blocks. Each is measured before it goes through the driver, alone, and none is over the bounds: a larger benchmark has more blocks, not larger ones."""
    pieces = materialize(item_pieces(items, size - 1), "pieces")
    weight = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.octet_length(w))
    sizes = pieces.select(F.xxhash64("item_id", "start", "words").alias("h"), F.size("words").cast("long").alias("n"), weight.alias("b"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
    count = max(1, -(-total.n // (block_words // 2)), -(-total.b // (block_bytes // 2))) if total.n > block_words or total.b > block_bytes else 1
    while count > 1:
        most = sizes.groupBy(F.pmod("h", F.lit(count)).alias("k")).agg(F.sum("n").alias("n"), F.sum("b").alias("b")).agg(F.max("n").alias("n"), F.max("b").alias("b")).first()
        if most.n <= max(block_words, 2 * (PIECE_WORDS + size)) and most.b <= max(block_bytes, 2 * LONG_WORD * (PIECE_WORDS + size)):
            break
        count *= 2
    context = items.sparkSession.sparkContext
    numbered = pieces.withColumn("_k", F.pmod(F.xxhash64("item_id", "start", "words"), F.lit(count)))
    parts = [context.broadcast(Block.of(numbered.filter(F.col("_k") == k).drop("_k").toArrow(), size)) for k in range(count)]
    discard(pieces)
    return Blocks(parts, total.longest)


def _bound(keys: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """Binary search, each in a stretch of its own: the first place in [low, high) whose key is not below (or is above) what is wanted. ``keys`` gives the keys of places."""
    low, high = low.copy(), high.copy()
    while True:
        live = low < high
        if not live.any():
            return low
        middle = np.where(live, (low + high) >> 1, 0)
        key = keys(middle)
        right = live & ((key <= wanted) if after else (key < wanted))
        low = np.where(right, middle + 1, low)
        high = np.where(live & ~right, middle, high)


class Searched:
    """A shard's words and their suffix array."""

    def __init__(self, codes: np.ndarray, numbered: Numbered, depth: int):
        self.suffixes = suffix_array(codes, depth)
        self.numbered = numbered
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(numbered) + 1))])
        self.codes = np.concatenate([codes, np.zeros(depth + 1, np.int32)])

    def search(self, block: Block) -> tuple[np.ndarray, ...]:
        """For every suffix of the block: how many of its words stand somewhere in the shard, and the stretch of the suffix array where; and the stretch of its window (empty where it has none)."""
        own = np.array([self.numbered.get(w, 0) for w in block.words] or [0], np.int64)
        words = own[block.codes]
        n = len(words)
        length, low, high, first, last = (np.zeros(n, np.int64) for _ in range(5))
        live = np.flatnonzero(words > 0)
        a, b = self.starts[words[live]], self.starts[words[live] + 1]
        depth = 1
        while True:
            found = a < b
            live, a, b = live[found], a[found], b[found]
            if not len(live):
                return length, low, high, first, last
            length[live], low[live], high[live] = depth, a, b
            whole = block.window[live] == depth
            first[live[whole]], last[live[whole]] = a[whole], b[whole]
            more = block.rest[live] > depth
            live, a, b = live[more], a[more], b[more]
            wanted = words[live + depth]
            known = wanted > 0
            live, a, b, wanted = live[known], a[known], b[known], wanted[known]
            keys = lambda at, depth=depth: self.codes[self.suffixes[at].astype(np.int64) + depth]
            a, b = _bound(keys, wanted, a, b, False), _bound(keys, wanted, a, b, True)
            depth += 1


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some stretches, and whose each is."""
    sizes = high - low
    whose = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - low, sizes), whose


@dataclass
class _Document:
    doc_id: object
    n_words: int = 0
    n_hit: int = 0
    longest: int = 0
    sets: set[tuple[int, int]] = field(default_factory=set)
    ended: bool = False


class _Shards:
    """Takes documents' words, sorts and searches them shard by shard. A document of several shards has each shard begin with the last words of the one before."""

    def __init__(self, blocks: Blocks, size: int, shard_words: int):
        self.blocks, self.size, self.shard_words = blocks, size, shard_words
        self.overlap = max(blocks.longest, size) - 1
        self.numbered, self.documents, self.sets = Numbered(), [], {}
        self._clear()

    def _clear(self) -> None:
        self.parts, self.segments, self.n = [], [], 0

    def words(self, doc: _Document, words: list[bytes]) -> None:
        if any(len(w) > LONG_WORD for w in words):
            words = [_short(w) for w in words]
        for k in range(0, len(words), self.shard_words):
            codes = self.numbered.codes(words[k : k + self.shard_words])
            if not self.segments or self.segments[-1][0] is not doc:
                self.segments.append([doc, self.n, 0, np.zeros(0, bool)])
            self.parts.append(codes)
            self.n += len(codes)
            self.segments[-1][2] += len(codes)
            doc.n_words += len(codes)
            if self.n >= self.shard_words:
                self.search(doc)

    def end(self, doc: _Document) -> None:
        doc.ended = True
        self.parts.append(np.zeros(1, np.int32))
        self.n += 1

    def search(self, going_on: _Document | None = None) -> None:
        """Search what is gathered; ``going_on`` is a document whose words go on."""
        if not self.segments:
            return self._clear()
        codes = np.concatenate(self.parts)
        shard = Searched(codes, self.numbered, max(self.blocks.longest, self.size))
        at = np.array([s[1] for s in self.segments])
        change, longest = np.zeros(len(codes) + self.size + 1, np.int32), np.zeros(len(codes), np.int32)
        for number, block in enumerate(self.blocks):
            length, low, high, first, last = shard.search(block)
            found = np.flatnonzero(last > first)
            places, whose = _spread(first[found], last[found])
            places = shard.suffixes[places].astype(np.int64)
            np.add.at(change, places, 1)
            np.add.at(change, places + block.window[found][whose], -1)
            pairs = np.unique((np.searchsorted(at, places, "right") - 1) * max(len(block.sets), 1) + block.owners[found][whose])
            for s, k in zip((pairs // max(len(block.sets), 1)).tolist(), (pairs % max(len(block.sets), 1)).tolist(), strict=True):
                self.segments[s][0].sets.add((number, k))
                self.sets.setdefault((number, k), block.sets[k])
            long = np.flatnonzero(length >= self.size)
            best = np.zeros(len(codes), np.int32)
            for n, a, b in sorted(set(zip(length[long].tolist(), low[long].tolist(), high[long].tolist(), strict=True))):
                best[a:b] = n
            longest[shard.suffixes] = np.maximum(longest[shard.suffixes], best)
        hit = np.cumsum(change[: len(codes)]) > 0
        carried = None
        for doc, start, n, before in self.segments:
            own = hit[start : start + n]
            own[: len(before)] |= before
            doc.longest = max(doc.longest, int(longest[start : start + n].max(initial=0)))
            if doc is going_on:
                keep = min(self.overlap, n)
                carried = codes[start + n - keep : start + n], own[n - keep :].copy()
                own = own[: n - keep]
            doc.n_hit += int(own.sum())
        self._clear()
        if len(self.numbered) > _KEPT:
            names = list(self.numbered)
            self.numbered = Numbered()
            if carried:
                carried = self.numbered.codes([names[k - 1] for k in carried[0].tolist()]), carried[1]
        if carried:
            self.parts, self.n, self.segments = [carried[0]], len(carried[0]), [[going_on, 0, len(carried[0]), carried[1]]]


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, longest`` of every row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Every task sorts its documents' words into suffix arrays of ``shard_words`` words and searches all
    suffixes of the benchmark in them; ``size`` consecutive words of an item are a window, and so is a
    whole item of fewer. n_hit words stand in an occurrence of a window; item_ids are the items that have
    one, distinct and in order; longest is the longest verbatim match of at
    least ``size`` words, counted to the end of a piece of an item (PIECE_WORDS). Nothing of
    the documents is shuffled. The benchmark is broadcast in blocks of bounded size, one in memory at once.

    Null and empty texts have no words and no hits; a text longer than a shard is searched in several that
    overlap, and holds 4 bytes a word. A null item_id counts as an empty one, items of equal id as one.
    Repeated rows come out as often, null ids stay null; other columns are ignored, whatever their names;
    an empty table on either side gives no hits.
    """
    blocks = blocks_of(items, size, block_words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("longest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, waiting, known = _Shards(blocks, size, shard_words), [], {}

        def rows(done: list[_Document]) -> pa.RecordBatch:
            out = []
            for d in done:
                key = frozenset(d.sets)
                if key not in known:
                    if len(known) > _REMEMBERED:
                        known.clear()
                    known[key] = sorted(set().union(*(shards.sets[k] for k in key)))
                out.append(known[key])
            return batch_of(schema, [d.doc_id for d in done], [d.n_words for d in done], [d.n_hit for d in done], out, [d.longest for d in done])

        for doc_id, text in _texts(batches):
            doc = _Document(doc_id)
            waiting.append(doc)
            for piece in pieces_of(text.translate(_LETTERS)):
                shards.words(doc, piece.split())
            shards.end(doc)
            if shards.n >= shard_words or len(waiting) >= shard_words:
                shards.search()
                yield rows(waiting)
                waiting.clear()
        shards.search()
        yield rows(waiting)

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, n_words long, n_hit long, item_ids array<string>, longest long")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that have a window of an item. Documents of one id go together, rows without an id stay only if no row without an id is hit."""
    hit = contaminated(docs, items, size).filter("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, sizes WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.k, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND p.t = v.t),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

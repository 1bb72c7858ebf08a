"""SimHash near-dedup: fingerprints over word shingles, linked by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialize, pieces_of, returning, starts_of, table, text_slices, utf8
from .components import connected_components

SHINGLE, RADIUS = 3, 2
#: A fingerprint has four blocks of 16 bits; two that differ in at most RADIUS = 2 bits agree in two blocks at least.
PAIRS = tuple(combinations(range(4), 2))
#: Buckets with more fingerprints than this are dealt again by the other 32 bits, in blocks of 8.
HOT_BUCKET = 4096
_HASHES_AT_ONCE, _BYTES_AT_ONCE = 1 << 17, 1 << 20


def _shingle_hashes(words: list[bytes], k: int) -> Iterator[np.ndarray]:
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    if len(words) < k:
        if words:
            yield np.array([digest(b" ".join(words))], np.uint64)
        return
    n = len(words) - k + 1
    for at in range(0, n, _HASHES_AT_ONCE):
        part = words[at : min(at + _HASHES_AT_ONCE, n) + k - 1]
        rows = zip(*(part[i:] for i in range(k)), strict=False)
        yield np.fromiter(map(digest, map(b" ".join, rows)), np.uint64, len(part) - k + 1)


def _ones_by_run(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each bit set: (runs, 64). Eight byte-wide counters share a word, for up to 255 hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
    starts, pieces = starts_of(lengths), (lengths + 254) // 255
    first = starts_of(pieces)
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + inner * 255
    return np.add.reduceat(np.add.reduceat(bits, cuts, axis=0).view(np.uint8).astype(np.int64), first, axis=0)


def fingerprints_of(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as uint64; a text without words has 0."""
    out = np.zeros(len(texts), np.uint64)
    waiting: list[tuple[int, np.ndarray]] = []

    def settle(rows: list[int], ones: np.ndarray, totals: np.ndarray) -> None:
        out[rows] = np.packbits(2 * ones > totals[:, None], axis=1).view(">u8").ravel()

    def flush() -> None:
        if waiting:
            lengths = np.array([len(h) for _, h in waiting])
            settle([i for i, _ in waiting], _ones_by_run(np.concatenate([h for _, h in waiting]), lengths), lengths)
            waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        if len(text) <= _BYTES_AT_ONCE:
            for h in _shingle_hashes(text.lower().split(), k):
                waiting.append((i, h))
                held += len(h)
            if held > _HASHES_AT_ONCE:
                flush()
                held = 0
        else:  # a long text, some words at a time; the last words of a piece begin the shingles of the next
            ones, total, tail = np.zeros((1, 64), np.int64), 0, []
            for piece in pieces_of(text, _BYTES_AT_ONCE):
                words = tail + piece.lower().split()
                if len(words) >= k:
                    for h in _shingle_hashes(words, k):
                        ones += _ones_by_run(h, np.array([len(h)]))
                        total += len(h)
                    words = words[len(words) - k + 1 :]
                tail = words
            if not total:
                for h in _shingle_hashes(tail, k):
                    ones, total = _ones_by_run(h, np.array([1])), 1
            settle([i], ones, np.array([total]))
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """``doc_id, fp`` and ``more``: every document's fingerprint as a long (its 64 bits)."""
    rows = docs.select("doc_id", "text", *more)
    schema = rows.drop("text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprints_of(utf8(b.column(1)[some]), shingle) for some in text_slices(b.column(1))]
            kept = [b.column(0), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64())], names=schema.names)

    return rows.mapInArrow(returning(run), schema)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 to a word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _close_lanes(planes: np.ndarray, words: np.ndarray, lanes: np.ndarray, step: int, radius: int) -> np.ndarray:
    """Places i, of the lanes set in these words, whose fingerprint differs from that of i + step in at most ``radius`` bits.

    A plane against itself, shifted by ``step`` places, gives one bit of difference of 64 pairs a word.
    Distances are counted with carry-save adders: a bitwise counter digit a word, saturating in ``over``.
    After every few planes, words whose lanes all exceed the radius are abandoned.
    """
    skip, shift = divmod(step, 64)
    last, digits = planes.shape[1] - 1, max(1, radius.bit_length())  # the last word of a plane is empty
    near, far = np.minimum(words + skip, last), np.minimum(words + skip + 1, last)
    at, over = np.arange(len(words)), ~lanes
    count = np.zeros((digits, len(at)), np.uint64)
    for k, plane in enumerate(planes):
        carry = plane[near[at]] >> np.uint64(shift)
        if shift:
            carry |= plane[far[at]] << np.uint64(64 - shift)
        carry ^= plane[words[at]]
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if k % 6 == 5 or k == 63:
            above = np.zeros(len(at), np.uint64)  # count > radius, compared from the highest digit down
            equal = np.full(len(at), ~np.uint64(0))
            for d in reversed(range(digits)):
                if radius >> d & 1:
                    equal &= count[d]
                else:
                    above |= equal & count[d]
                    equal &= ~count[d]
            over |= above
            alive = np.flatnonzero(over != ~np.uint64(0))
            if len(alive) < len(at):
                at, over, count = at[alive], over[alive], count[:, alive]
            if not len(at):
                break
    word, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64))
    return words[at][word] * 64 + lane


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of equal keys whose fingerprints link. ``keys`` is sorted.

    The bit planes of all rows are made once. Step s compares each row with the one s places on; only
    words with a row whose bucket reaches that far take part.
    """
    n = len(keys)
    new = np.r_[True, keys[1:] != keys[:-1]] if n else np.zeros(0, bool)
    end = np.r_[np.flatnonzero(new)[1:], n]
    left = np.repeat(end, np.diff(np.r_[np.flatnonzero(new), n])) - np.arange(n)  # rows from here to the bucket's end
    planes = np.hstack([_planes(fps), np.zeros((64, 1), np.uint64)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows, step = np.flatnonzero(left > 1), 1
    while len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] >> 6 != rows[:-1] >> 6])
        lanes = np.bitwise_or.reduceat(np.uint64(1) << (rows & 63).astype(np.uint64), first)
        hit = _close_lanes(planes, rows[first] >> 6, lanes, step, radius)
        found.append((hit, hit + step))
        step += 1
        rows = rows[left[rows] > step]
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))


def _first_agreement(a: np.ndarray, b: np.ndarray, blocks: tuple, width: int) -> np.ndarray:
    """The first pair of blocks in which both agree: the bucket that owns the link."""
    x, mask = a ^ b, np.uint64((1 << width) - 1)
    same = [(x >> np.uint64(width * i)) & mask == 0 for i in range(4)]
    return np.argmax([same[i] & same[j] for i, j in blocks], axis=0)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(combo, part, sub, rest, fp) in whole buckets, sorted -> links (a, b), each from the bucket that owns it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flush(k: np.ndarray) -> pa.RecordBatch | None:
        change = np.r_[False, (k[1:, :4] != k[:-1, :4]).any(axis=1)].cumsum()
        fps = k[:, 4].copy().view(np.uint64)
        i, j = close_pairs(change, fps)
        own = _first_agreement(fps[i], fps[j], PAIRS, 16) == k[i, 0]
        i, j = i[own], j[own]
        second = k[i, 2] >= 0
        if second.any():
            rest = [_rest_bits(fps[x], k[i, 0]) for x in (i, j)]
            own = ~second | (_first_agreement(*rest, PAIRS, 8) == k[i, 2])
            i, j = i[own], j[own]
        return batch_of(schema, k[i, 4], k[j, 4]) if len(i) else None

    held: list[np.ndarray] = []
    for b in batches:
        k = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
        if not len(k):
            continue
        held.append(k)
        if sum(map(len, held)) >= 1 << 17:
            k = np.concatenate(held)
            cut = np.flatnonzero((k[:, :4] != k[-1, :4]).any(axis=1))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut and (out := flush(k[:cut])) is not None:
                yield out
            held = [k[cut:]]
    if held and len(k := np.concatenate(held)) and (out := flush(k)) is not None:
        yield out


def _rest_bits(fps: np.ndarray, combo: np.ndarray) -> np.ndarray:
    """The two blocks that a bucket does not fix, as 32 bits."""
    out = np.zeros(len(fps), np.uint64)
    for c, pair in enumerate(PAIRS):
        lo, hi = (i for i in range(4) if i not in pair)
        at = combo == c
        out[at] = ((fps[at] >> np.uint64(16 * lo)) & np.uint64(0xFFFF)) | (((fps[at] >> np.uint64(16 * hi)) & np.uint64(0xFFFF)) << np.uint64(16))
    return out


def _bits(column: str, at: int, width: int):
    return F.shiftrightunsigned(F.col(column), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Distinct fingerprints ``fp`` -> pairs ``a, b`` that differ in at most two bits, each once.

    Six buckets a fingerprint: its values in two of four blocks. Buckets of one are dropped before
    Python sees them. In a bucket above ``hot_bucket`` rows, the other 32 bits again have four
    blocks of which two agree, so it is dealt over 6 x 65,536 smaller buckets, with no link lost.
    """
    deal = F.explode(F.array(*[F.struct(F.lit(c).alias("combo"), (F.shiftleft(_bits("fp", 16 * i, 16), 16).bitwiseOR(_bits("fp", 16 * j, 16))).alias("part"), (F.shiftleft(_bits("fp", 16 * hi, 16), 16).bitwiseOR(_bits("fp", 16 * lo, 16))).alias("rest")) for c, (i, j) in enumerate(PAIRS) for lo, hi in [[x for x in range(4) if x not in (i, j)]]]))
    dealt = fps.select("fp", deal.alias("d")).select("fp", "d.*")
    counts = dealt.groupBy("combo", "part").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = dealt.join(counts, ["combo", "part"])
    sub = F.explode(F.array(*[F.struct(F.lit(c).alias("sub"), (F.shiftleft(_bits("rest", 8 * i, 8), 8).bitwiseOR(_bits("rest", 8 * j, 8))).alias("rest_part")) for c, (i, j) in enumerate(PAIRS)]))
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest_part")))
    small = dealt.filter(F.col("n") <= hot_bucket).select("combo", "part", F.explode(whole).alias("s"), "fp")
    large = dealt.filter(F.col("n") > hot_bucket).select("combo", "part", sub.alias("s"), "fp")
    buckets = small.unionByName(large).select("combo", "part", "s.sub", "s.rest_part", "fp")
    buckets = buckets.repartition("combo", "part", "sub", "rest_part").sortWithinPartitions("combo", "part", "sub", "rest_part", "fp")
    return buckets.mapInArrow(returning(_link), "a long, b long")


def _classes(by_doc: DataFrame, hot_bucket: int) -> DataFrame:
    """``fp, component_id`` of every different fingerprint of (doc_id, fp)."""
    distinct = by_doc.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), hot_bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Only distinct fingerprints are compared and joined; copies follow theirs. ``component_id`` is the
    smallest ``doc_id`` reachable over links, the document itself included. Null texts count as
    empty; texts without words have fingerprint 0, linked like any other. Rows without ``doc_id``
    link too but give no component its id (null if there is no other). Repeated rows come out as
    often as they go in; other columns are ignored. An empty table gives an empty one.
    """
    by_doc = materialize(fingerprints(docs, shingle), "fingerprints")
    return by_doc.join(_classes(by_doc, hot_bucket), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row of ``docs`` for every component: the smallest by (doc_id, hash of the text), null ids last; of rows equal in both, one.

    Null ids link like others, so a copy without id goes where one with an id stays. Null texts count as
    empty. Columns keep their names and values; rows with an equal id and text are taken for one row, and
    which of them stays is open where other columns differ. An empty table gives an empty one.

    Which rows go is found on ids and hashes alone and written; texts are read once more and rows that
    go are left out by an anti join, whose small side Spark broadcasts if its measured size allows. So
    texts are shuffled only where many rows go.
    """
    id_, hash_ = F.col("doc_id"), F.col("text_hash")
    by_doc = materialize(fingerprints(docs, shingle, F.xxhash64("text").alias("text_hash")), "fingerprints")
    rows = by_doc.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("n"))
    rooted = materialize(rows.join(_classes(by_doc, hot_bucket).select("fp", "root"), "fp"), "rooted")
    key = F.struct(id_.isNull().alias("no_id"), id_.alias("id"), hash_.alias("hash"))
    first = rooted.groupBy("root").agg(F.min(key).alias("first"))
    rooted = rooted.join(first, "root").withColumn("stays", key == F.col("first"))
    # a row that stays once where it is there several times is taken out here and put back below
    out = materialize(rooted.filter("not stays or n > 1").select(id_.alias("_id"), hash_.alias("_hash"), "stays"), "gone")
    carried = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    same = own_id.eqNullSafe(F.col("_id")) & (F.xxhash64(own_text) == F.col("_hash"))
    once = carried.join(out, same, "left_anti")
    again = carried.join(out.filter("stays"), same).dropDuplicates(["_id", "_hash"]).select(*carried.columns)
    return once.unionByName(again).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

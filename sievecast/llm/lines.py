"""Line dedup: a segment-partition edit join over lines.

Two lines within ``threshold`` edits of each other: the shorter one's threshold + 1 segments cannot
all be touched, so one of them stands in the longer line, at a place that the lengths narrow down. Of
threshold + 2 segments two stand there, which tells lines apart that share one common segment.
Lines, segments and edits are of UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, returning, starts_of, table, text_slices, utf8
from .components import connected_components

#: Edits, and the shortest line (bytes) that may differ from its copy; of shorter ones only equal lines are copies.
THRESHOLD, SHORTEST = 2, 32
#: Lines of a bucket that are compared as one block; larger buckets are dealt again by two segments, and what is still larger is pairs of blocks.
BLOCK = 1024
#: Bits of the filter that tells which lines' texts to fetch; a fixed size, whatever the input.
FILTER_BITS = 1 << 24
_SLICE_BITS = 1 << 15
_BYTES_AT_ONCE, _REMEMBERED, _PAIRS_AT_ONCE = 1 << 20, 200_000, 8192
#: Segments of lines up to this length are hashed from prefix sums, all lines at a time; those of longer lines one by one.
_LONG = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _digest(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def _short_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _power_table() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for as many bytes as are hashed at a time."""
    steps = np.full((2, _BYTES_AT_ONCE + 2 * _LONG), _BASE, np.uint64)
    steps[1] = pow(_BASE, -1, 1 << 64)
    steps[:, 0] = 1
    return tuple(np.multiply.accumulate(x) for x in steps)


def _places(threshold: int, together: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(bytes that the indexed line is shorter, segments, their shifts in the longer line): where ``together`` of threshold + together segments can stand unchanged."""
    n, out = threshold + together, []
    for less in range(threshold + 1):
        for some in combinations(range(n), together):
            for shifts in product(range(-threshold, threshold + 1), repeat=together):
                steps = np.diff([0, *shifts, less])  # edits before, between and behind the segments
                if np.abs(steps).sum() <= threshold and (together > 1 or abs(shifts[0]) <= some[0] and abs(less - shifts[0]) <= threshold - some[0]):
                    out.append((less, some, shifts))
    return out


def segment_keys(lines: list[bytes], threshold: int = THRESHOLD, shortest: int = SHORTEST, together: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all index and probe entries. A key is made of the indexed length, the segments' numbers and their bytes; its lowest bit is 0 for index entries.

    A line is indexed under its own length and probes the indexes of lengths up to ``threshold`` below.
    """
    length = np.array([len(x) for x in lines], np.int64)
    parts = [_keys_from_sums(lines[a:b], length[a:b], a, threshold, shortest, together) for a, b in _portions(length)]
    for k in np.flatnonzero(length > _LONG).tolist():
        parts.append(_keys_of_long(lines[k], k, threshold, shortest, together))
    return tuple(np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, t) for i, t in ((0, np.int64), (1, np.uint64)))


def _portions(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lines whose bytes, longer lines left out, fit the table of powers."""
    ends, first = np.cumsum(np.where(length > _LONG + THRESHOLD, 0, length)), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + _BYTES_AT_ONCE, side="right")))
        yield first, end
        first = end


def _segment(at_length, segments: int, i: int):
    """(place, size) of segment i of lines of this length; the last ones are the longer ones."""
    short, longer = at_length // segments, segments - at_length % segments
    return i * short + np.maximum(0, i - longer), short + (i >= longer)


def _keys_from_sums(lines: list[bytes], length: np.ndarray, offset: int, threshold: int, shortest: int, together: int) -> tuple[np.ndarray, np.ndarray]:
    held = [x if len(x) <= _LONG + threshold else b"" for x in lines]
    data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64) + np.uint64(1)
    power, inverse = _power_table()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * power[: len(data)], out=sums[1:])
    starts, segments = starts_of(np.array([len(x) for x in held], np.int64)), threshold + together
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for less, some, shifts in _places(threshold, together):
        at_length = length - less
        own = np.flatnonzero((at_length >= max(shortest, segments)) & (at_length <= _LONG))
        key = (at_length[own] << 8).astype(np.uint64)
        fits = np.ones(len(own), bool)
        for i, shift in zip(some, shifts, strict=True):
            place, size = _segment(at_length[own], segments, i)
            fits &= (place + shift >= 0) & (place + shift + size <= length[own])
            first = np.where(fits, starts[own] + place + shift, 0)
            size = np.where(fits, size, 0)
            key = _mix(_mix(key + np.uint64(i + 1)) ^ _mix((sums[first + size] - sums[first]) * inverse[first]))
        rows.append(own[fits] + offset)
        keys.append((key[fits] & ~np.uint64(1)) | np.uint64(bool(less or any(shifts))))
    return np.concatenate(rows), np.concatenate(keys)


def _keys_of_long(line: bytes, row: int, threshold: int, shortest: int, together: int) -> tuple[np.ndarray, np.ndarray]:
    segments, keys, view = threshold + together, [], memoryview(line)
    for less, some, shifts in _places(threshold, together):
        at_length = len(line) - less
        if at_length > max(_LONG, shortest - 1):
            h = xxhash.xxh3_64(f"{at_length} {some}".encode())
            for i, shift in zip(some, shifts, strict=True):
                place, size = (int(x) for x in _segment(at_length, segments, i))
                if place + shift < 0 or place + shift + size > len(line):
                    break
                h.update(view[place + shift : place + shift + size])
            else:
                keys.append(h.intdigest() & (_MASK - 1) | bool(less or any(shifts)))
    return np.full(len(keys), row), np.array(keys, np.uint64)


def within(lines: list[bytes], i: np.ndarray, j: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether lines[i] and lines[j] are within ``threshold`` edits, for many pairs at a time.

    Common beginnings and ends go first. Then, bit-parallel: for each number of errors one word of bits,
    bit k for the diagonal k - threshold of the band; each byte of the second line moves all diagonals
    of all pairs at once. Pairs without a bit left are abandoned.
    """
    length = np.array([len(x) for x in lines], np.int64)
    out = np.zeros(len(i), bool)
    order = np.argsort(np.maximum(length[i], length[j]), kind="stable") if len(i) else np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        most = int(max(length[i[order[at]]], length[j[order[at]]]))
        n = max(1, min(_PAIRS_AT_ONCE, (1 << 22) // max(1, most)))
        rows = order[at : at + n]
        at += n
        rows = rows[np.abs(length[i[rows]] - length[j[rows]]) <= threshold]
        if len(rows):
            out[rows] = _within(lines, length, i[rows], j[rows], threshold)
    return out


def _within(lines: list[bytes], length: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    used, place = np.unique(np.r_[i, j], return_inverse=True)
    a, b = place[: len(i)], place[len(i) :]
    size, widest = length[used], int(length[used].max())
    left = np.zeros((len(used), widest), np.uint8)
    right = np.zeros((len(used), widest), np.uint8)
    for row, k in enumerate(used.tolist()):
        x = np.frombuffer(lines[k], np.uint8)
        left[row, : len(x)] = x
        right[row, widest - len(x) :] = x
    shorter = np.minimum(size[a], size[b])

    def common(x: np.ndarray) -> np.ndarray:
        return np.where(x.any(axis=1), x.argmax(axis=1), x.shape[1])

    head = np.minimum(common(left[a] != left[b]), shorter)
    tail = np.minimum(common((right[a] != right[b])[:, ::-1]), shorter - head)
    m, n = size[a] - head - tail, size[b] - head - tail
    out = np.zeros(len(i), bool)
    goal = (m - n + threshold).astype(np.uint8)
    band = np.uint8((1 << (2 * threshold + 1)) - 1)
    alive = np.arange(len(i))
    errors = np.zeros((threshold + 1, len(i)), np.uint8)
    for e in range(threshold + 1):  # before the first byte, only deletions: diagonals 0 to e
        errors[e] = sum(1 << (threshold + d) for d in range(e + 1))
    step = 0
    while len(alive):
        done = n[alive] == step
        if done.any():
            rows = alive[done]
            out[rows] = errors[threshold, done] >> goal[rows] & 1
            alive, errors = alive[~done], errors[:, ~done]
            if not len(alive):
                break
        byte = left[b[alive], head[alive] + step]
        match = np.zeros(len(alive), np.uint8)
        for k in range(2 * threshold + 1):
            y = step + k - threshold
            if y >= 0:
                inside = y < m[alive]
                at = np.minimum(head[alive] + y, widest - 1)
                match |= ((left[a[alive], at] == byte) & inside).astype(np.uint8) << np.uint8(k)
        fresh = np.empty_like(errors)
        fresh[0] = errors[0] & match
        for e in range(1, threshold + 1):
            fresh[e] = (errors[e] & match) | errors[e - 1] | (errors[e - 1] >> np.uint8(1)) | ((fresh[e - 1] << np.uint8(1)) & band)
        step += 1
        lives = fresh[threshold] != 0
        alive, errors = alive[lives], fresh[:, lives]
    return out


def _lines(batches: Iterator[pa.RecordBatch], column: int, shortest: int) -> Iterator[list[bytes]]:
    """Different lines of a megabyte at a time; a bounded memory keeps most repeats away."""
    seen: set[bytes] = set()
    out, size = [], 0
    for b in batches:
        for some in text_slices(b.column(column)):
            for text in utf8(b.column(column)[some]):
                for line in text.split(b"\n"):
                    if len(line) >= shortest and (d := _digest(line)) not in seen:
                        seen.add(d)
                        out.append(line)
                        size += len(line)
                        if size >= _BYTES_AT_ONCE:
                            yield out
                            out, size = [], 0
                if len(seen) > _REMEMBERED:
                    seen.clear()
    if out:
        yield out


def _entries(batches: Iterator[list[bytes]], threshold: int, shortest: int, together: int) -> Iterator[pa.RecordBatch]:
    for lines in batches:
        ids = np.array([_short_id(_digest(x)) for x in lines], np.int64)
        row, key = segment_keys(lines, threshold, shortest, together)
        for c in range(0, len(row), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(key[c : c + (1 << 17)].view(np.int64)), pa.array(ids[row[c : c + (1 << 17)]])], names=["key", "line_id"])


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, line) sorted by both -> those of buckets with an index entry and two different lines, once each.

    Index entries come first in a bucket, so whether there is one shows in its first row. At most one row
    of a bucket waits for a second line; nothing else is held from batch to batch.
    """
    bucket = last = waiting = None  # the open bucket, its last row, and its only row so far, if that is still to be passed on
    for b in batches:
        if not b.num_rows:
            continue
        key, line = (c.to_numpy() for c in b.columns)
        if waiting is not None:
            key, line = np.r_[waiting[0], key], np.r_[waiting[1], line]
            bucket = None
        own = key >> 1
        new = np.r_[own[0] != bucket if bucket is not None else True, own[1:] != own[:-1]]
        first = np.flatnonzero(np.r_[True, new[1:]])
        size = np.diff(np.r_[first, len(key)])
        indexed = key[first] & 1 == 0
        several = np.minimum.reduceat(line, first) != np.maximum.reduceat(line, first)
        if not new[0]:  # goes on from the batch before, where two different lines, or no index entry, have been seen
            indexed[0], several[0] = last[2], True
        keep = np.repeat(indexed & several, size)
        same = np.r_[not new[0] and last[0] == key[0] and last[1] == line[0], (key[1:] == key[:-1]) & (line[1:] == line[:-1])]
        bucket, waiting = own[-1], None
        last = (key[-1], line[-1], indexed[-1])
        if indexed[-1] and not several[-1]:
            waiting = (key[-1], line[-1])
        keep &= ~same
        yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array((key[keep] & 1) == 0), pa.array(line[keep])], names=["bucket", "indexed", "line_id"])


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int, rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups, equal in the first ``columns``, of some ``rows`` rows or megabytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= 1 << 24:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = np.column_stack([t.column(c).to_numpy() for c in range(columns)])
            before = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _connect(groups: Iterator[pa.Table], threshold: int) -> Iterator[pa.RecordBatch]:
    """Groups (bucket, first, second; block, indexed, line): verified links between lines of both blocks, as a spanning forest (digests a, b).

    Step s compares each line with the one s places on, in all groups at once; pairs that are connected by now are left out.
    """
    for t in groups:
        keys = np.column_stack([t.column(c).to_numpy() for c in range(3)])
        block, indexed, lines = t["block"].to_numpy(), t["indexed"].to_numpy(), t["line"].to_pylist()
        n = len(lines)
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        left = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n])) - np.arange(n)
        across = keys[:, 1] != keys[:, 2]
        root, edges, rows, step = np.arange(n), [], np.flatnonzero(left > 1), 1
        while len(rows):
            other = rows + step
            wanted = (indexed[rows] | indexed[other]) & (root[rows] != root[other]) & (~across[rows] | (block[rows] != block[other]))
            i, j = rows[wanted], other[wanted]
            if len(i):
                found = within(lines, i, j, threshold)
                for x, y in zip(i[found].tolist(), j[found].tolist(), strict=True):
                    edges.append((x, y))
                if found.any():
                    root = _united(root, i[found], j[found])
            step += 1
            rows = rows[left[rows] > step]
        digest = {k: _digest(lines[k]) for e in edges for k in e}
        yield pa.RecordBatch.from_arrays([pa.array([digest[e[k]] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after uniting the trees of i with those of j."""
    root = root.copy()
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where an id falls: a fixed size, whatever the input."""

    def fill(rows: pa.Table) -> pa.Table:
        bits = np.zeros(_SLICE_BITS, bool)
        bits[rows["bit"].to_numpy() % _SLICE_BITS] = True
        return pa.table({"slice": pa.array([rows["bit"][0].as_py() // _SLICE_BITS], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bit = F.pmod("line_id", F.lit(FILTER_BITS)).alias("bit")
    slices = ids.select(bit).distinct().withColumn("slice", F.floor(F.col("bit") / _SLICE_BITS)).groupBy("slice").applyInArrow(fill, "slice long, bits binary")
    for r in slices.collect():
        bits[r.slice * _SLICE_BITS // 8 : (r.slice + 1) * _SLICE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def line_links(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` (digests) that connect all different lines within ``threshold`` edits of each other, over chains of such."""
    sc = docs.sparkSession.sparkContext

    def buckets(entries: DataFrame) -> DataFrame:
        entries = entries.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "line_id")
        return materialize(entries.mapInArrow(returning(_shared_buckets), "bucket long, indexed boolean, line_id long"), "buckets")

    entries = lambda batches: _entries(_lines(batches, 0, shortest), threshold, shortest, 1)
    members = buckets(docs.select("text").mapInArrow(returning(entries), "key long, line_id long"))

    # the texts of those lines: a bit filter spares the shuffle most of the others
    wanted = members.select("line_id").distinct()
    passing = sc.broadcast(_bit_filter(wanted))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = passing.value
        for lines in _lines(batches, 0, shortest):
            ids = np.array([_short_id(_digest(x)) for x in lines], np.int64)
            b = ids % FILTER_BITS
            hit = np.flatnonzero(filter_[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([lines[k] for k in hit.tolist()], pa.binary())], names=["line_id", "line"])

    found = docs.select("text").mapInArrow(returning(texts), "line_id long, line binary").join(wanted, "line_id", "left_semi").distinct()

    # lines of buckets above a block are dealt again, by all pairs of one segment more
    large = members.groupBy("bucket").count().filter(F.col("count") > block).select("bucket")
    if not large.isEmpty():
        found, large = materialize(found, "texts"), materialize(large, "large")
        again = found.join(members.join(large, "bucket").select("line_id").distinct(), "line_id", "left_semi").select("line")
        pairs = lambda batches: _entries((b.column(0).slice(c, 1 << 12).to_pylist() for b in batches for c in range(0, b.num_rows, 1 << 12)), threshold, shortest, 2)
        members = members.join(large, "bucket", "left_anti").unionByName(buckets(again.mapInArrow(returning(pairs), "key long, line_id long")))

    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "bucket").withColumn("block", F.pmod(F.col("line_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", F.least("block", "_with").alias("first"), F.greatest("block", "_with").alias("second"), "block", "indexed", "line_id")
    placed = placed.join(found, "line_id").drop("line_id").repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    return placed.mapInArrow(returning(lambda batches: _connect(whole_groups(batches, 3), threshold)), "a binary, b binary")


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, digest`` of every line that is not blank. Lines are numbered from 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line_no", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0).cast(pa.int64()), b.column(1)
            for some in text_slices(b.column(2)):
                rows, numbers, digests = [], [], []
                for k, text in enumerate(utf8(b.column(2)[some]), some.start):
                    for number, line in enumerate(text.split(b"\n")):
                        if line.strip():
                            rows.append(k)
                            numbers.append(number)
                            digests.append(_digest(line))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(take), hashes.take(take), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(returning(run), "doc_id long, text_hash long, line_no int, digest binary")


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_hash, removed array<int>``: for every different (doc_id, text) with any, the numbers of its lines that repeat an earlier one.

    Lines form classes: equal ones of any length, those of ASCII white space alone left out, and lines
    of at least ``shortest`` bytes that are connected by links of at most ``threshold`` edits. Of each class the
    line with the smallest (doc_id, line number) stays, a null doc_id being last; the others repeat it.
    Rows that repeat (same id and text) stand for the same lines and keep the same. Null and empty texts
    have no lines to repeat. Lines are compared whole, however long. An empty table gives an empty one.
    """
    edges = line_links(docs, threshold, shortest, block)
    roots = connected_components(edges).select(F.col("node").alias("digest"), "root")
    lines = materialize(occurrences(docs), "lines")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("line_no"))
    by_digest = lines.groupBy("digest").agg(F.min(place).alias("place"), F.count("*").alias("n")).join(roots, "digest", "left")
    by_digest = materialize(by_digest.select("digest", F.coalesce("root", "digest").alias("root"), "place", "n"), "classes")
    first = by_digest.groupBy("root").agg(F.min("place").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    several = by_digest.join(first, "root").select("digest", "first")
    removed = lines.join(several, "digest").filter(place != F.col("first")).select("doc_id", "text_hash", "line_no").distinct()
    return removed.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``. A document of which no line but blank ones is left was a copy, and goes; see :func:`repeated_lines`.

    Other columns stay as they are, whatever their names; documents without a repeated line, null texts
    included, stay whole.
    """
    removed = repeated_lines(docs, threshold, shortest).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("removed").alias("_removed"))
    carried = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own_id, own_text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    joined = carried.join(removed, own_id.eqNullSafe(F.col("_id")) & (F.xxhash64(own_text) == F.col("_hash")), "left")
    # the kept numbers by one hash set, and the lines by number from an array that is made once: a text costs its lines
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    left = F.get(F.transform(F.array(F.split(own_text, "\n")), lambda lines: F.transform(kept(lines), lambda k: F.get(lines, k))), F.lit(0))
    text = F.when(F.col("_removed").isNull(), own_text).otherwise(F.array_join(left, "\n"))
    goes = F.col("_removed").isNotNull() & ~F.exists(left, lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    return joined.filter(~goes).select(*[(text if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = repeated_lines(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "removed")
    numbered = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = numbered.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("_n"), F.array_join(F.coalesce("removed", F.array().cast("array<int>")).cast("array<string>"), ",").alias("removed")).withColumn("n_removed", F.greatest("_n", F.lit(0).cast("long"))).drop("_n")


OP6_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
d AS (SELECT line, strlen(line) AS n, row_number() OVER (ORDER BY line) AS k FROM (SELECT DISTINCT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))),
e AS (SELECT a.k AS a, b.k AS b FROM d a JOIN d b ON a.k <> b.k AND a.n >= 32 AND b.n >= 32 AND b.n BETWEEN a.n - 2 AND a.n + 2 AND levenshtein(a.line, b.line) <= 2),
reach AS (SELECT k AS a, k AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS k, min(b) AS root FROM reach GROUP BY a),
o AS (SELECT l.doc_id, l.line_no, c.root, row_number() OVER (PARTITION BY c.root ORDER BY l.doc_id, l.line_no) AS r
      FROM l JOIN d ON l.line = d.line JOIN c ON d.k = c.k),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM o WHERE r > 1 GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id
"""

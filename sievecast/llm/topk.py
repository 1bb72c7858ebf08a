"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import returning, table

K, SCALE, EVERY = 10, 1024, 100
#: Rows of one index.
INDEX_ROWS = 1 << 15
#: Impacts are quantised to at most this many levels a dimension.
LEVELS = 32
#: The proof to stop is tried after each of so many equal shares of the postings.
TRIES = 12
_OUT = -(1 << 62)


class ImpactIndex:
    """Postings of integer vectors: for each dimension, rows in order of their quantised value, in segments of equal value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        span = int(vectors.max() - vectors.min()) if vectors.size else 0
        self.shift = max(0, span.bit_length() - LEVELS.bit_length() + 1)
        level = vectors >> self.shift
        rows = np.argsort(level, axis=0, kind="stable").astype(np.int32)
        self.rows, dims, lows, cuts = np.ascontiguousarray(rows.T), [], [], []
        for d in range(vectors.shape[1]):
            values, first = np.unique(level[rows[:, d], d], return_index=True)
            dims.append(np.full(len(values), d))
            lows.append(values << self.shift)
            cuts.append(np.column_stack([first, np.r_[first[1:], len(ids)]]))
        self.dim, self.low, self.cut = np.concatenate(dims), np.concatenate(lows), np.concatenate(cuts)
        self.high = self.low + (1 << self.shift) - 1

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of all rows that can be among the k best, rows with the query's id left out.

        A segment's impact is the most it can add above the least its dimension can add. Segments are
        processed by descending impact, each adding its quantised lower bound to the rows it lists. The
        search stops when the k-th best lower bound is above what all but the rows to be rescored can reach:
        what they have, plus the width of quantisation, plus the most that open segments can still add.
        """
        n, q = len(self.ids), query[self.dim]
        ends = np.sort([q * self.low, q * self.high], axis=0)
        least = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(least, self.dim, ends[0])
        impact, gain = ends[1] - least[self.dim], ends[0] - least[self.dim]
        order = np.argsort(-impact, kind="stable")
        most_open = np.zeros(len(query), np.int64)  # of each dimension, the impact of its next segment
        np.maximum.at(most_open, self.dim, impact)
        width = int((np.abs(query) * ((1 << self.shift) - 1)).sum())
        sums = np.zeros(n, np.int64)
        sums[self.ids == own] = _OUT
        size = self.cut[:, 1] - self.cut[:, 0]
        shares = np.searchsorted(np.cumsum(size[order]), np.arange(1, TRIES + 1) * (size.sum() / TRIES))
        next_try, kth = 0, min(k, n)
        # the next open segment of each dimension, in the order of processing
        by_dim = np.argsort(self.dim[order], kind="stable")
        after = np.zeros(len(order), np.int64)
        same = self.dim[order][by_dim][1:] == self.dim[order][by_dim][:-1]
        after[by_dim[:-1][same]] = impact[order][by_dim[1:][same]]
        open_sum = int(most_open.sum())
        possible = np.arange(n)
        for place, s in enumerate(order.tolist()):
            d = self.dim[s]
            if gain[s]:
                sums[self.rows[d, self.cut[s, 0] : self.cut[s, 1]]] += gain[s]
            open_sum += int(after[place] - impact[s])
            if next_try < TRIES and place >= shares[next_try]:
                next_try = int(np.searchsorted(shares, place, side="right"))
                bound = np.partition(sums, n - kth)[n - kth]
                reach = np.flatnonzero(sums + (width + open_sum) >= bound)
                if len(reach) <= 8 * k:
                    possible = reach
                    break
        else:
            bound = np.partition(sums, n - kth)[n - kth]
            possible = np.flatnonzero(sums + width >= bound)
        possible = possible[sums[possible] > _OUT // 2]
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return possible[best], scores[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, index_rows: int = INDEX_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the k best rows of ``vectors`` (both vec_id, embedding).

    Components become ``floor(scale * x)``; the score is the integer inner product, ties go to the
    smaller ``vec_id``. All rows are candidates but those with the query's own id. Vectors that are null
    or hold null or non-finite components take no part, nor rows without id; only vectors of equal
    length are compared; queries without a candidate have no rows. Repeated rows are candidates each. Ranks are
    by ``query_id``, as in the SQL: rows of ``queries`` that share an id share its k ranks, with all their candidates. Extra
    columns are ignored; an empty table gives an empty one. Scores must fit in 62 bits.

    Rows are dealt into indexes of some ``index_rows``. An index is built once, from the rows that come
    first in its group; the queries that follow stream through it and leave k rows each. Every query is
    sent to every index, every row to one. While there are fewer indexes than cores, queries are dealt
    over several copies of each, so that all cores search.
    """
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    take = lambda df: df.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0)).select("vec_id", whole.alias("v"))
    rows, asked = take(vectors), take(queries)
    indexes = max(1, -(-rows.count() // index_rows))
    copies = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // indexes))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("long")
    rows = rows.select(F.size("v").alias("width"), dealt(indexes).alias("index"), everywhere(copies).alias("copy"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = asked.select(F.size("v").alias("width"), everywhere(indexes).alias("index"), dealt(copies).alias("copy"), F.lit(1).alias("asks"), "vec_id", "v")
    keys = ["width", "index", "copy"]
    both = rows.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = index = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            columns = np.column_stack([c.to_numpy().astype(np.int64) for c in b.columns[:4]])
            ids = b.column(4).to_numpy()
            cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
            for first, last in zip(np.r_[0, cuts], np.r_[cuts, len(ids)], strict=True):
                if first == last:
                    continue
                own, asks = tuple(columns[first, :3]), columns[first, 3]
                if own != key:
                    key, index, held = own, None, []
                flat = b.column(5).slice(first, last - first).flatten().to_numpy().reshape(last - first, -1)
                if not asks:
                    held.append((ids[first:last], flat))
                    continue
                if index is None and held:
                    index, held = ImpactIndex(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if index is not None:
                    found = [(own_id, *index.search(own_id, query, k)) for own_id, query in zip(ids[first:last], flat, strict=True)]
                    sizes = [len(x) for _, x, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], sizes).astype(np.int64)), pa.array(index.ids[np.concatenate([x for _, x, _ in found])]), pa.array(np.concatenate([x for _, _, x in found]))], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(returning(run), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

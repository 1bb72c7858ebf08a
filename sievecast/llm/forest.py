"""Embedding near-dedup: a random-projection tree forest with spill, compared within leaves, verified and united."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize, table
from .components import connected_components

COSINE, TREES, LEAF = 0.98, 4, 1024
#: Vectors that the trees' directions and first cuts are fitted on, at most; all vectors are dealt to leaves.
FIT_ROWS = 50_000
#: Levels are fitted while that many of those reach each node; below, a level's cut in a node is the median of its last fitted ancestor's rows.
LEAST_ROWS = 8
#: Half the overlap at a cut, in deviations of a just-linked pair's difference along a random direction.
SPILL = 0.5
#: Rows of a leaf that are compared as one block; larger leaves are pairs of blocks, in as many tasks.
BLOCK = 1024


@dataclass
class Tree:
    """Cuts of a binary tree whose nodes are numbered as a heap: children of i are 2i + 1 and 2i + 2.

    ``direction`` is by level. ``cut`` has the first levels' nodes; ``below`` has, for each node where those end, a
    cut for every further level. So a tree's size is bounded by the fitted rows and grows with the depth only, not with the leaves.
    """

    direction: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    spill: float

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors, each as deep as ``depth`` says; a row within ``spill`` of a cut goes down both sides."""
        row, node, level, fitted = np.arange(len(x)), np.zeros(len(x), np.int64), 0, (len(self.cut) + 1).bit_length() - 1
        along = x @ self.direction.T
        out_row, out_node = [], []
        while len(row):
            done = depth[row] <= level
            out_row.append(row[done])
            out_node.append(node[done])
            row, node = row[~done], node[~done]
            if not len(row):
                break
            cut = self.cut[node] if level < fitted else self.below[(node + 1 >> level - fitted) - 2**fitted, level - fitted]
            side = along[row, level] - cut
            level += 1
            left, right = side < self.spill, side >= -self.spill
            row, node = np.r_[row[left], row[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
        return np.concatenate(out_row) if out_row else row, np.concatenate(out_node) if out_node else node


def grow(sample: np.ndarray, depth: int, spill: float, seed: int) -> Tree:
    """Recursive splits at the median of a random direction, one direction a level and tree.

    The sample sets the cuts, not the depth: levels are fitted while each node has LEAST_ROWS of its rows; deeper
    nodes take the median of their last fitted ancestor's rows along their own level's direction. So leaves stay
    small however many vectors there are, and no node below the fitted ones is ever listed.
    """
    draw, (n, d) = np.random.default_rng(seed), sample.shape
    direction = draw.normal(size=(max(1, depth), d))
    direction /= np.linalg.norm(direction, axis=1, keepdims=True)
    fitted = min(depth, max(0, (n // LEAST_ROWS).bit_length() - 1))
    along = sample @ direction.T
    order, starts, cuts = np.arange(n), np.array([0, n]), []
    for level in range(fitted):
        node = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = order[np.lexsort((along[order, level], node))]
        middle = (starts[:-1] + starts[1:]) // 2
        cuts.append((along[order[middle - 1], level] + along[order[middle], level]) / 2)
        starts = np.sort(np.r_[starts, middle])
    below = np.zeros((len(starts) - 1, depth - fitted))
    for i in range(len(below) if n else 0):
        below[i] = np.median(along[order[starts[i] : starts[i + 1]], fitted:depth], axis=0)
    return Tree(direction, np.concatenate(cuts) if cuts else np.zeros(0), below, spill)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows in double precision scaled to length 1; first by their largest component, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dealt(vectors: DataFrame, trees: list[Tree]) -> DataFrame:
    """(row id, label, vector as it came, all its leaves) for each leaf that a vector is in; ``depth`` 0 is one leaf, the same in any tree.

    Rows have a usable vector and ``depth``, that of their label. Leaves of all trees are numbered through; vectors of another length than the trees' are one leaf a length.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(trees)
    ddl = "id long, copies long, label long, leaf long, leaves array<long>, v binary"
    schema = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("label", pa.int64()), ("leaf", pa.int64()), ("leaves", pa.list_(pa.int64())), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.asarray(v) for v in _arrays(b.column(4))]
            depth = b.column(3).to_numpy()
            by_width: dict[int, list[int]] = {}
            for k, x in enumerate(raw):
                by_width.setdefault(len(x), []).append(k)
            for width, ks in by_width.items():
                ks = np.array(ks)
                own = np.zeros(len(ks), np.int64)
                at, leaf = [], []
                if shared.value and width == shared.value[0].direction.shape[1]:
                    own, x = depth[ks], _units(np.array([raw[k] for k in ks]))
                    split = np.flatnonzero(own > 0)
                    for t, tree in enumerate(shared.value if len(split) else []):
                        r, n = tree.leaves(x[split], own[split])
                        at.append(split[r])
                        leaf.append(n * len(shared.value) + t)
                whole = np.flatnonzero(own == 0)
                at, leaf = np.concatenate([*at, whole]), np.concatenate([*leaf, np.full(len(whole), -1 - width)])
                order = np.lexsort((leaf, at))
                at, leaf = at[order], leaf[order]
                cuts = np.searchsorted(at, np.arange(len(ks) + 1))
                lists = [leaf[cuts[i] : cuts[i + 1]] for i in range(len(ks))]
                take = pa.array(ks[at])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(3)), pa.array(leaf), pa.array([lists[i] for i in at], pa.list_(pa.int64())), pa.array([raw[ks[i]].tobytes() for i in at], pa.binary())], schema=schema)

    return vectors.select("id", "copies", F.col("label").cast("long").alias("label"), F.col("depth").cast("long").alias("depth"), "embedding").mapInArrow(run, ddl)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a column without nulls, as views of its values."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Sorted lists as rows of one array, filled up with distinct numbers that no leaf has."""
    lists = lists.combine_chunks()
    n, lengths = len(lists), lists.value_lengths().to_numpy()
    out = np.iinfo(np.int64).min + np.arange(n * lengths.max(), dtype=np.int64).reshape(n, -1)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _first_common(leaves: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest leaf that both of each pair are in."""
    common = (leaves[i][:, :, None] == leaves[j][:, None, :]).any(axis=2)
    return leaves[i, common.argmax(axis=1)]


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs make a spanning forest: links between members that are connected already add nothing to components."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            parent[b] = a
            keep[k] = True
    return keep


def _compare(parts: pa.Table, cosine: float, dtype: type) -> pa.Table:
    """One block, or two, of a leaf -> (id, other, links): counts of links that this leaf owns, and edges that connect them.

    A link belongs to the first leaf that both vectors are in, so it counts once however many trees find it.
    """
    block = parts["block"].to_numpy()
    first, second, leaf = parts["first"][0].as_py(), parts["second"][0].as_py(), parts["leaf"][0].as_py()
    ids, copies, leaves = parts["id"].to_numpy(), parts["copies"].to_numpy(), _padded(parts["leaves"])
    v = _units(np.frombuffer(b"".join(parts["v"].to_pylist()), dtype).reshape(len(ids), -1))
    one, two = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links, edges = np.zeros(len(ids), np.int64), []
    for at in range(0, len(one), 256):
        rows = one[at : at + 256]
        close = v[rows] @ v[two].T >= cosine
        i, j = np.nonzero(close)
        i, j = rows[i], two[j]
        if first == second:
            i, j = i[i < j], j[i < j]
        if len(i):
            own = np.concatenate([_first_common(leaves, i[c : c + 20_000], j[c : c + 20_000]) for c in range(0, len(i), 20_000)]) == leaf
            i, j = i[own], j[own]
            links += (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
            span = _spanning(i, j, len(ids))
            edges.append((ids[i[span]], ids[j[span]]))
    some = np.flatnonzero(links)
    a, b = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"id": np.r_[ids[some], a], "other": pa.array(np.r_[ids[some], b], mask=np.r_[np.ones(len(some), bool), np.zeros(len(b), bool)]), "links": np.r_[links[some], np.zeros(len(a), np.int64)]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of (vec_id, embedding, label).

    Linked: equal labels, not null, and a cosine of at least ``cosine`` in double precision, of two other
    rows. Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
    different lengths. ``n_links`` counts linked rows, ``component_id`` is the smallest ``vec_id``
    reachable by links, itself included; ``kept`` if that is the row's own.

    The trees' cuts are fitted on at most ``fit_rows`` vectors of labels that need cuts; every vector is dealt to
    leaves, as deep as the rows of its own label need, so labels of up to ``leaf`` rows are one leaf. The overlap at a cut is a deviation of a just-linked pair's difference
    along a random direction, so one cut parts such a pair with a chance of some 1.5 %, and a link is
    lost only where all trees part it. Found pairs are verified exactly. Leaves above ``block`` rows are compared block by block, in a task each.
    Exact copies are compared once: members of a group of equal vectors link all with all, and with
    what the one of them does. Repeated rows (equal ids) are copies like others and come out as often;
    null ids link but name no component. Extra columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    distinct = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    # written, so the ids stay what they are
    distinct = materialize(distinct.withColumns({"usable": F.coalesce(usable, F.lit(False)), "id": F.monotonically_increasing_id()}), "vectors")
    good = distinct.filter("usable")
    # only labels that are cut have a row; without a hint, Spark broadcasts them if they are few and splits a hot label if not
    cut = good.groupBy("label").count().filter(F.col("count") > leaf).select("label", F.ceil(F.log2(F.col("count") / leaf)).cast("int").alias("depth"))
    cut = materialize(cut, "depths")
    depth = cut.agg(F.max("depth")).first()[0] or 0
    planted = []
    if depth:
        sample = good.join(cut, "label", "left_semi").orderBy(F.xxhash64("embedding"), "id").limit(fit_rows).select("embedding").toArrow()["embedding"]
        widths = Counter(len(v) for v in sample)
        width = min(widths, key=lambda w: (-widths[w], w))
        x = _units(np.array([v for v in sample.to_pylist() if len(v) == width], np.float64))
        spill = float(SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(width))
        planted = [grow(x, depth, spill, t) for t in range(trees)]
    with_depth = good.join(cut, "label", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    dealt = materialize(_dealt(with_depth, planted), "leaves")
    dtype = np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64
    sizes = dealt.groupBy("label", "leaf").agg(F.count("*").alias("members")).filter("members > 1")
    sizes = sizes.select("label", "leaf", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    placed = dealt.join(sizes, ["label", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("id", "copies", "label", "leaf", "leaves", "v", "block", F.least("block", "_with").alias("first"), F.greatest("block", "_with").alias("second"))
    found = materialize(placed.groupBy("label", "leaf", "first", "second").applyInArrow(lambda t: _compare(t, cosine, dtype), "id long, other long, links long"), "links")
    links = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = distinct.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "usable", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    least = known.filter("usable").groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least, "root", "left")
    out = rows.join(known, rows["label"].eqNullSafe(known["_label"]) & rows["embedding"].eqNullSafe(known["_embedding"]))
    own = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    links = F.when(F.col("usable"), F.col("links") + F.col("copies") - 1).otherwise(F.lit(0))
    out = out.select("vec_id", links.cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

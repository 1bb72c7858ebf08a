"""Token counts: a separator scan over flat, unindexed token files, stitched across blocks by a prefix scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table, utf8

#: Token files hold 16-bit little-endian ids. 0 ends a document; words are hashed to all other ids.
END, IDS = 0, 1 << 16
#: Bytes of a file after which a task starts the next, and bytes that are scanned at once.
FILE_BYTES, BLOCK_BYTES = 1 << 28, 1 << 22
_REMEMBERED = 400_000


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_token_files(docs: DataFrame, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write the words of all texts as token files into shared storage; returns the folder and ``file, ordinal, doc_id``.

    A task writes its documents one after another, each followed by END, and starts a new file after
    ``file_bytes``. The files hold no index; which document comes n-th in which file is the second
    result. A task that runs again writes under new names, and only what finished tasks name is ever read.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, f"{shared_dir(spark)}/sievecast/tokens-{uuid.uuid4().hex}")
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_folder(folder)
        fs.create_dir(base, recursive=True)
        known: dict[bytes, int] = {}
        out = name = None
        size = ordinal = 0
        try:
            for b in batches:
                doc_ids = b.column(0).cast(pa.int64())
                files, ordinals = [], []
                for text in utf8(b.column(1)):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                        out, size, ordinal = fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20), 0, 0
                    words = text.split()
                    try:
                        ids = list(map(known.__getitem__, words))
                    except KeyError:
                        if len(known) > _REMEMBERED:
                            known.clear()
                        known.update((w, 1 + crc32(w) % (IDS - 1)) for w in set(words).difference(known))
                        ids = list(map(known.__getitem__, words))
                    ids.append(END)
                    data = np.array(ids, "<u2").tobytes()
                    out.write(data)
                    size += len(data)
                    files.append(name)
                    ordinals.append(ordinal)
                    ordinal += 1
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), doc_ids], schema=schema)
        finally:
            if out is not None:
                out.close()

    order = docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long")
    return folder, materialize(order, "order")


def scan_blocks(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, length) -> a row for each block: ``file, block, first, tokens, ends array<long>``, the places of END by file."""
    n = F.ceil(F.col("length") / block_bytes)
    blocks = files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("block"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("tokens", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_folder(folder)
        for b in batches:
            for name, length, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = block * block_bytes
                with fs.open_input_file(f"{base}/{name}") as f:
                    tokens = np.frombuffer(f.read_at(min(block_bytes, length - at), at), "<u2")
                ends = np.flatnonzero(tokens == END) + at // 2
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([at // 2]), pa.array([len(tokens)]), pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    return blocks.repartition("file", "block").mapInArrow(run, "file string, block long, first long, tokens long, ends array<long>")


def document_lengths(blocks: DataFrame) -> DataFrame:
    """Blocks of :func:`scan_blocks` -> ``file, ordinal, n_tokens`` of every document.

    The prefix scan: over the blocks before it, how many documents have ended, and where the last of
    them did. So a document that begins many blocks before its end is as long as it is. What stands
    after a file's last END is a document without end, if it has a token.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = blocks.withColumns(
        {
            "ended": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
            "opened": F.coalesce(F.max(F.try_element_at("ends", F.lit(-1)) + 1).over(before), F.lit(0)).cast("long"),
            "last": F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(),
        }
    )
    stop = F.col("first") + F.col("tokens")
    starts = F.concat(F.array("opened"), F.transform("ends", lambda e: e + 1))
    open_end = F.col("last") & (F.element_at(starts, -1) < stop)
    ends = F.when(open_end, F.concat("ends", F.array(stop))).otherwise(F.col("ends"))
    lengths = F.zip_with(F.slice(starts, F.lit(1), F.size(ends)), ends, lambda a, b: b - a)
    return s.select("file", "ended", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("ended") + F.col("k")).alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"))


def token_counts(docs: DataFrame, file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``docs`` (doc_id, text), counted in the token files written of them.

    Null and empty texts have 0 tokens. Rows that repeat come out as often; null ids stay null; other
    columns are ignored; an empty table gives an empty one. Texts are written whole; a file is read
    block by block, whatever its size.
    """
    if block_bytes % 2:
        raise ValueError("block_bytes: whole tokens")
    spark = docs.sparkSession
    folder, order = write_token_files(docs, file_bytes)
    written = order.select("file").distinct()
    if written.isEmpty():
        return order.select("doc_id", F.col("ordinal").alias("n_tokens"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "length")
    lengths = document_lengths(scan_blocks(listed.join(written, "file", "left_semi"), folder, block_bytes))
    # lengths come out of exploded arrays, whose size Spark underrates: never broadcast them
    return order.join(lengths.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
"""

"""Small helpers that the operators share: shared storage, texts from Arrow batches, held-out folds."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    A local session may leave it unset: its one machine is shared by itself, and a temporary folder
    serves. On a cluster there is no folder to guess, and an error says so.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return base.rstrip("/")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sievecast-")


#: Tables that :func:`materialize` has written in this process and nothing has discarded.
_written: list[DataFrame] = []


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievecast/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievecast_path = path
    _written.append(out)
    return out


def written() -> int:
    """How many tables are written and not discarded: a mark for :func:`discard_since`."""
    return len(_written)


def discard_since(mark: int, keep: DataFrame, before: DataFrame | None = None) -> None:
    """Discard what was written since a mark, but ``keep``, and the table ``before`` that it was made of: once ``keep`` is written, nothing reads them any more."""
    for df in [*_written[mark:], before]:
        if df is not None and df is not keep:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_sievecast_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _written[:] = [x for x in _written if x is not df]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(folds))


def word_count(column: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[slice]:
    """A column of texts in consecutive slices of some ``most`` bytes each; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(first, end)
        first = end


def returning(run: Callable) -> Callable:
    """``run`` for mapInArrow; when a task ends, what it has freed goes back to the system, as Python workers serve many tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Hand freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces_of(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of some ``most`` bytes, cut in ASCII white space; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        space = _SPACE.search(text, at + most)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.end()
    yield text[at:] if at else text


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def summed(parts: DataFrame, value: str, dtype: type, count: str | None = None, order: str | None = None) -> DataFrame:
    """``parts`` with the rows of equal keys made one: ``value`` is an array of ``dtype`` in binary, added up, and so is ``count``; all other columns are the key.

    Rows are dealt by key and sorted, and a task adds them up as they come: it holds one sum and one batch, however
    many tasks have sent parts. Parts of a key are added by ``order``, a whole number that the sum doesn't carry on;
    without it, in which order floats are added is open.
    """
    fields, at = parts.schema.names, parts.schema.names.index(value)
    keys = [c for c in fields if c not in (value, count, order)]
    places = [fields.index(c) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = schema = None
        n = 0

        def row() -> pa.RecordBatch:
            own = dict(zip(keys, key, strict=True)) | {value: total.tobytes(), count: n, order: 0}
            return pa.RecordBatch.from_arrays([pa.array([own[f.name]], f.type) for f in schema], schema=schema)

        for b in batches:
            schema = b.schema
            counts = b.column(fields.index(count)).to_pylist() if count else [0] * b.num_rows
            for i, k in enumerate(zip(*(b.column(p).to_pylist() for p in places), strict=True)):
                part = np.frombuffer(b.column(at)[i].as_buffer(), dtype)
                if k != key:
                    if key is not None:
                        yield row()
                    key, total, n = k, part.copy(), 0
                else:
                    total += part
                n += counts[i]
        if key is not None:
            yield row()

    out = parts.repartition(*keys).sortWithinPartitions(*keys, *([order] if order else [])).mapInArrow(returning(run), parts.schema)
    return out.drop(order) if order else out


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets at which runs of the given lengths begin."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out

"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, encoding, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecast.llm import bpe, language, lines, mixing, simhash
from sievecast.llm.common import discard_since, materialize, table, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a likely language, go.

    Null and empty texts have no letter and go; repeated rows stay as often; long texts are read in parts.
    An empty table gives an empty one, a table without any lang too. Other columns stay, whatever their names.
    """
    return language.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that repeat an earlier one go, and documents of which nothing else is left.

    Null and empty texts, and texts of blank lines alone, stay as they are. Rows of the same id and text keep
    the same lines. An empty table gives an empty one. Other columns stay, whatever their names.
    """
    return lines.deduplicate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: the smallest by (doc_id, hash of the text), null ids last.

    Null and empty texts are one group; rows equal in id and text count as one row, null ids too. An empty
    table gives an empty one. Other columns stay, whatever their names.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in training order; ties stand by doc_id.

    Null and empty texts have size 0 and are taken as their place says; null sources are one source, the
    last. Repeated rows count once each. An empty table gives an empty one. Other columns stay, whatever their names.
    """
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the hashes of them and of the bytes that they decode to.

    Null and empty texts have no ids; repeated rows come out as often; long texts are searched in parts. An
    empty table gives an empty one. Columns but doc_id are not carried on.
    """
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

#: SQL can't express language ID, XXH64 fingerprints or BPE. The tests hold the operators, not the whole pipeline, against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read back as the next one's input, and what it was made of discarded."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = written(), docs
        docs = materialize(stage(spark, before, sf_dir), name)
        discard_since(mark, docs, before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoding(path: str):
    """A byte-level encoding from a file of base64 tokens and ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, id_col: str, text_col: str, carry: list[str] = (), path: str | None = None, delivered: str | None = None) -> DataFrame:
    """(id, carry..., n_tokens): one row per id; null and empty texts have 0.

    Of several deliveries the last one by the column `delivered` counts (of equal ones, or
    without such a column, the largest).
    """
    path = path or tokenizer_path()
    given, carry = carry, [*carry, *(["_delivered"] if delivered else [])]
    when = [F.col(delivered).alias("_delivered")] if delivered else []
    rows = df.select(F.col(id_col).alias("id"), *given, *when, F.col(text_col).alias("text"))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        for b in batches:
            n = np.fromiter((len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *carry)), pa.array(n)], names=["id", *carry, "n_tokens"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *carry))
    best = rows.mapInArrow(size, f"{kinds}, n_tokens bigint").where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.struct(*carry[len(given):], "n_tokens", *given)).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in given], F.col("r.n_tokens").alias("n_tokens"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share.

    Unset, a temporary folder serves where all tasks run in this process (tests); elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"checkpoint-{os.getpid()}")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: Python work runs once, and a lost executor repeats none of it.

    The folder belongs to the cluster, which clears it like its checkpoints.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

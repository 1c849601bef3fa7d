"""Reading and writing the project's files: JSON lines, CSV, Parquet, NumPy tensors, reports."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = "source string, row_id string, language string, text string, is_enterprise_prompt boolean, task_family string"
PACKET_SCHEMA = "packet_row_id string, source_row_id string, prompt string, language string, task_family string, reference_text string"
ACTIVATION_SCHEMA = ("model_slug string, layer int, shard int, pos int, h array<float>, row_idx int, row_id string, source string, "
                     "language string, task_family string, is_enterprise_prompt boolean, token_idx int")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line that isn't blank; a broken line fails the read instead of giving nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ids stay text: the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def write_shards(df: DataFrame, path: str) -> None:
    """Activations by model, layer and shard, so that a reader of one layer opens its files only."""
    df.repartition("model_slug", "layer", "shard").sortWithinPartitions("model_slug", "layer", "shard", "pos").write.mode("overwrite").partitionBy("model_slug", "layer", "shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if not df.columns:
        raise FileNotFoundError(f"no shards in {path}")
    return df


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx ARRAY<INT>, h ARRAY<FLOAT>): every .npy array under a path, one row per vector of its last axis."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                lead = list(np.ndindex(*a.shape[:-1]))
                flat = a.reshape(len(lead), a.shape[-1]) if a.ndim else a.reshape(1, 1)
                for lo in range(0, len(lead), 4096):
                    yield pa.RecordBatch.from_pydict(
                        {"path": [name] * len(lead[lo: lo + 4096]), "idx": [list(x) for x in lead[lo: lo + 4096]], "h": list(flat[lo: lo + 4096])},
                        schema=pa.schema([("path", pa.string()), ("idx", pa.list_(pa.int32())), ("h", pa.list_(pa.float32()))]))

    return files.mapInArrow(rows, "path string, idx array<int>, h array<float>")


def read_checkpoint(spark: SparkSession, path: str) -> dict:
    """encoder (id, w, b), decoder (id, d) and the configuration of an autoencoder."""
    return {"encoder": spark.read.parquet(f"{path}/encoder"), "decoder": spark.read.parquet(f"{path}/decoder"), "config": spark.read.parquet(f"{path}/config").first().asDict()}


def write_checkpoint(spark: SparkSession, sae, path: str) -> None:
    enc = [(i, w.tolist(), float(b)) for i, (w, b) in enumerate(zip(sae.w, sae.b - sae.w @ sae.c))]
    spark.createDataFrame(enc, "id bigint, w array<float>, b float").write.mode("overwrite").parquet(f"{path}/encoder")
    spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(sae.d)], "id bigint, d array<float>").write.mode("overwrite").parquet(f"{path}/decoder")
    spark.createDataFrame([(sae.d.shape[1], sae.d.shape[0], sae.k)], "hidden int, dict_size int, k int").write.mode("overwrite").parquet(f"{path}/config")


# The columns that may hold the text, in order of preference.
TEXT_COLUMNS = ("continuation", "response", "generated_text", "global_continuation", "baseline_continuation")


def first_present(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of several paths that exists, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    for c in candidates:
        path = jvm.org.apache.hadoop.fs.Path(c)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return c
    return None


def read_continuations(spark: SparkSession, candidates: list[str]) -> DataFrame | None:
    """continuations() of the first CSV file that is there, all columns as text; None without one."""
    path = first_present(spark, candidates)
    return None if path is None else continuations(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def continuations(df: DataFrame) -> DataFrame:
    """(side, subtask, source_row_id, continuation) of a table with one of TEXT_COLUMNS; the side comes
    from the column `side` or else the prefix of packet_row_id; of equal keys the last by packet_row_id wins,
    without that column the last row."""
    text = next((c for c in TEXT_COLUMNS if c in df.columns), None)
    if text is None:
        raise ValueError(f"none of {', '.join(TEXT_COLUMNS)} among the columns")
    prefix = F.upper(F.left("packet_row_id", F.lit(2))) if "packet_row_id" in df.columns else F.lit(None).cast("string")
    side = F.coalesce(F.upper("side"), prefix) if "side" in df.columns else prefix
    # without an id, the order of the rows as they are read
    order = F.col("packet_row_id") if "packet_row_id" in df.columns else F.monotonically_increasing_id()
    keys = ["side", "subtask", "source_row_id"]
    rows = df.withColumn("side", side).withColumn("_order", order).where(F.col("side").isin("JA", "KO"))
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col("_order").alias("o"), F.col(text).alias("t"))).alias("m")).select(*keys, F.col("m.t").alias("continuation"))


def summary_json(sections: dict[str, DataFrame], files: list[str] = (), most: int = 10_000) -> str:
    """Small result tables as one JSON text; NaN becomes null, absent sections stay out."""
    out: dict = {"files": sorted(files)}
    for name, df in sections.items():
        rows = df.limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"{name} is no summary: over {most} rows")
        out[name] = json.loads(rows.to_json(orient="records", force_ascii=False))
    return json.dumps(out, ensure_ascii=False, indent=1, allow_nan=False)


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A one-column table of markdown lines, head first."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\n]", " "), F.lit("")) for c in columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "k int, line string")
    body = df.orderBy(*order).select(F.lit(2).alias("k"), row.alias("line"), *[F.col(c).alias(f"_{c}") for c in order])
    for f in body.schema[2:]:
        head = head.withColumn(f.name, F.lit(None).cast(f.dataType))
    return head.unionByName(body).orderBy("k", *[F.col(f"_{c}").asc_nulls_first() for c in order]).select("line")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

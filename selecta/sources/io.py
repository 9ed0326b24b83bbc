"""File sources and sinks.

Readers take explicit schemas; positions that the reference kept implicitly
(list index) become an explicit ``row_id``. A JSON array file is read in byte
ranges (:mod:`selecta.sources.json_array`).
"""

from __future__ import annotations

import hashlib
import json
from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selecta.session import path_exists
from selecta.sources.json_array import json_array_elements
from selecta.sources.tables import require_columns

INSTRUCTION_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()), T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()), T.StructField("source", T.StringType()),
])

FORMATS = ("csv", "json", "jsonl", "parquet")


def read_instructions(spark: SparkSession, path: str, fmt: str = "csv",
                      schema: T.StructType = INSTRUCTION_SCHEMA) -> DataFrame:
    """Instruction table by explicit format (Q1: a '.json' name may be CSV),
    with the required-column check before any job runs."""
    if fmt == "csv":
        df = spark.read.schema(schema).option("header", True).option("multiLine", True) \
            .option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        df = spark.read.schema(schema).option("multiLine", fmt == "json").json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"format must be one of {FORMATS} (pickle is replaced by parquet)")
    return require_columns(df, ["instruction", "input", "output", "source"])


def with_row_id(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Fix a row_id at ingest: by an order column if given (ties by the row's
    content), else by the place in the files: path, start of the split, then order in the split."""
    from selecta.operators.rank import global_rank
    if order_col:
        tie = F.xxhash64(*df.columns)
        return global_rank(df.withColumn("_t", tie), [F.col(order_col), F.col("_t")], "row_id").drop("_t")
    keyed = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
                      F.monotonically_increasing_id().alias("_m"))
    return global_rank(keyed, [F.col("_f"), F.col("_s"), F.col("_m")], "row_id").drop("_f", "_s", "_m")


def read_json_string_array(spark: SparkSession, path: str, value: str = "text") -> DataFrame:
    """S3: a JSON array of strings -> (row_id = position, value). The file is read in byte ranges."""
    parsed = F.from_json(F.concat(F.lit("["), F.col("element"), F.lit("]")), T.ArrayType(T.StringType()))
    return json_array_elements(spark, path).select("row_id", parsed[0].alias(value))


def read_jsonl_field(spark: SparkSession, path: str, field: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON Lines, one field."""
    schema = schema or T.StructType([T.StructField(field, T.StringType())])
    return spark.read.schema(schema).json(path).select(field)


def read_prompt_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of one-key maps {prompt: [responses]} -> (row_id, prompt, responses). The file is read in byte ranges."""
    parsed = F.from_json("element", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    e = F.element_at(F.map_entries(parsed), 1)
    return json_array_elements(spark, path).select("row_id", e["key"].alias("prompt"), e["value"].alias("responses"))


def write_selection(df: DataFrame, root: str, data_set: str, sample_type: str, n: int, seed: int,
                    ftype: str | None = None, validation: bool = False) -> str:
    """Gzip parquet under data_set/sample_type[/ftype]/n/seed (the
    layout the next job and S15 read back as partition columns)."""
    # every path has the same partition levels (ftype=none when a strategy
    # has no sub-type) so the whole tree reads back as one table
    parts = [f"data_set={data_set}", f"sample_type={sample_type}", f"ftype={ftype or 'none'}",
             f"n={n}", f"seed={seed}"]
    path = "/".join([root.rstrip("/"), "validation" if validation else "sampled", *parts])
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)
    return path


def read_selections(spark: SparkSession, root: str, validation: bool = False) -> DataFrame:
    """Every written selection with its partition values."""
    base = root.rstrip("/") + ("/validation" if validation else "/sampled")
    return spark.read.option("basePath", base).parquet(base)


def read_named_results(spark: SparkSession, root: str) -> DataFrame:
    """S15 / F9 by file name: the JSON string arrays ``root/<data_set>/<name>.json`` as one table
    (data_set, name, size, seed, row_id, text). ``size`` is the first number between underscores (or at the end) of
    the name, ``seed`` the number at its end if that is a later one; null where a name has none."""
    file = F.col("file")
    name = F.regexp_extract(file, r"([^/]+)\.json$", 1)

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")

    parsed = F.from_json(F.concat(F.lit("["), F.col("element"), F.lit("]")), T.ArrayType(T.StringType()))
    return json_array_elements(spark, root.rstrip("/") + "/*/*.json").select(
        F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("data_set"), name.alias("name"),
        number(r"_([0-9]{1,9})(?:_|$)").alias("size"), number(r"_[0-9]{1,9}_(?:.*_)?([0-9]{1,9})$").alias("seed"), "row_id", parsed[0].alias("text"))


def available_sizes(selections: DataFrame) -> DataFrame:
    """Distinct sizes, sorted."""
    return selections.select("n").distinct().orderBy("n")


def write_scores(df: DataFrame, path: str, score: str, id_col: str = "row_id") -> None:
    """One score per row, as parquet of (id, score)."""
    df.select(id_col, score).write.mode("overwrite").parquet(path)


def write_chunked(df: DataFrame, path: str, rows_per_file: int = 10_000_000) -> None:
    """Output in files of at most ``rows_per_file`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file) \
        .option("compression", "gzip").parquet(path)


def write_sample_files(sample: DataFrame, root: str) -> None:
    """One sample, three JSON Lines sinks (prompt / truth / row +
    metadata). The sample is written once to parquet and the three sinks
    read that copy, so they agree even if the sampling plan were re-run."""
    from selecta.functions.text import prompt_optional_input
    base = root.rstrip("/")
    sample.write.mode("overwrite").parquet(base + "/_sample")
    s = sample.sparkSession.read.parquet(base + "/_sample")
    s.select("row_id", prompt_optional_input("instruction", "input").alias("prompt")) \
        .write.mode("overwrite").json(base + "/prompts")
    s.select("row_id", F.col("output").alias("ground_truth")).write.mode("overwrite").json(base + "/ground_truth")
    s.select(F.col("row_id").alias("idx"), F.struct(*[c for c in s.columns if c != "row_id"]).alias("example")) \
        .write.mode("overwrite").json(base + "/examples")


def param_path(root: str, name: str, params: Mapping) -> str:
    """A materialised result's path carries a hash of its parameters."""
    h = hashlib.sha1(json.dumps(dict(params), sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{name}-{h}"


def cached(df_fn, spark: SparkSession, root: str, name: str, params: Mapping) -> DataFrame:
    """Read the materialised table if complete (``_SUCCESS``), else
    compute, write and read it back. Unlike a file-exists check, a changed
    parameter set gets a new path, so stale results are never reused."""
    path = param_path(root, name, params)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df_fn().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ingest_if_absent(df: DataFrame, path: str) -> None:
    """Write a dataset only when nothing is there yet."""
    df.write.mode("ignore").parquet(path)

"""Resumable, incremental batch generation on Structured Streaming.

A job reads a folder of prompt files, leaves out what it has done, generates the rest and
saves as it goes. Here it is a streaming job: the keys it has seen live in
the state store (RocksDB on the executors, so they need not fit in memory), the user
``Generator`` runs on executors through ``mapInPandas``, and every micro-batch writes a folder
of its own. A batch that ended half way is run again with the same rows and
overwrites its folder, so nothing is lost or doubled and no batch reads the output.
``trigger(availableNow=True)`` makes it a batch job that can be killed and restarted at any point.
"""

from __future__ import annotations

import hashlib
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selecta.functions.text import extract_response, strip_prompt_prefix
from selecta.session import path_exists

Generator = Callable[[pd.DataFrame], pd.DataFrame]


def pending(prompts: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``prompts`` whose key is not yet in ``done`` (left anti join)."""
    return prompts.join(done.select(key), key, "left_anti")


def run_generator(prompts: DataFrame, generator: Generator, out_schema: str) -> DataFrame:
    """Apply a user generator batch-wise on executors (Arrow batches)."""
    def gen(batches):
        for pdf in batches:
            yield generator(pdf)
    return prompts.mapInPandas(gen, out_schema)


def postprocess(df: DataFrame, text: str = "text", prompt: str = "prompt", mode: str = "marker") -> DataFrame:
    """P15 (after the response marker) or P16 (drop the echoed prompt)."""
    if mode == "marker":
        return df.withColumn(text, extract_response(text))
    return df.withColumn(text, strip_prompt_prefix(text, prompt))


def group_samples(samples: DataFrame, key: str = "row_id", order: str = "sample_no",
                  text: str = "text") -> DataFrame:
    """M5 (Q22): n sampled sequences per prompt back into one row per prompt,
    grouped by the real key (not by position // n)."""
    return samples.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]).alias("responses"),
        F.count(F.lit(1)).alias("n_samples"))


#: State store of the keys seen so far. A setting of Spark and its RocksDB provider.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_folder(out_dir: str, checkpoint: str) -> str:
    """Folder under ``out_dir`` of the job whose state is in ``checkpoint``."""
    return f"{out_dir.rstrip('/')}/run={hashlib.md5(checkpoint.rstrip('/').encode()).hexdigest()[:12]}"


def incremental_generate(spark: SparkSession, source_dir: str, source_schema: str, out_dir: str,
                         checkpoint: str, generator: Generator, out_schema: str, key: str = "row_id",
                         max_files_per_trigger: int | None = None) -> None:
    """Process every prompt file in ``source_dir`` not yet processed; resumable.

    The first row of a key is generated, later ones (in the same file or in one that comes later) are left out; null is
    a key. Rows are written below ``out_dir`` as ``run=<job>/batch=<n>``; readers see these as two more
    columns. ``checkpoint`` names the job: with a new one all is generated again, beside the
    earlier rows (leave out what other jobs have done with :func:`pending`). A
    checkpoint that is gone while its rows are there is refused, since its batches would overwrite them.
    The state keeps the number of shuffle partitions of the first run.
    """
    out = run_folder(out_dir, checkpoint)
    if path_exists(spark, out) and not path_exists(spark, f"{checkpoint.rstrip('/')}/metadata"):
        raise ValueError(f"{out} holds rows of this job, but its checkpoint {checkpoint} is gone")
    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    fresh = reader.parquet(source_dir).dropDuplicates([key])

    def batch(df: DataFrame, epoch_id: int) -> None:
        run_generator(df, generator, out_schema).write.mode("overwrite").parquet(f"{out}/batch={epoch_id}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        q = (fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)

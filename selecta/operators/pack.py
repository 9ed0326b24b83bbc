"""Sequence packing of formatted rows into fixed-size token blocks.

Rows are spread over ``shards`` by a seeded hash (so the running sum is a
window *per shard*, parallel, never one global ordered window); inside a
shard the order is the seeded key. Token count = whitespace tokens + 1
separator. A row occupying tokens [start, end) of its shard lands in blocks
floor(start/size) .. floor((end-1)/size): a long row spans several blocks
(one output row per (row, block)).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from selecta.functions.text import tokens
from selecta.operators.rank import seeded_key


def pack_sequences(df: DataFrame, text: str, seed: int = 2023, block_size: int = 4096,
                   shards: int | None = None, shard_rows: int = 1_000_000, id_col: str = "row_id") -> DataFrame:
    """Shards default to ceil(N / shard_rows): a shard's window is one sorted
    task of at most ~shard_rows rows, whatever the table size."""
    if shards is None:
        shards = max(1, math.ceil(df.count() / shard_rows))
    key = seeded_key(seed, id_col)
    shard = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
    t = df.select(id_col, shard.alias("shard"), key.alias("_k"),
                  (F.size(tokens(F.coalesce(F.col(text), F.lit("")))) + 1).cast("long").alias("n_tokens"))
    w = Window.partitionBy("shard").orderBy("_k", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_end", F.sum("n_tokens").over(w)).withColumn("_start", F.col("_end") - F.col("n_tokens"))
    blocks = F.sequence(F.floor(F.col("_start") / block_size), F.floor((F.col("_end") - 1) / block_size))
    return t.select(id_col, "shard", F.explode(blocks).alias("block"), "n_tokens", F.col("_start").alias("start")) \
        .withColumn("block", F.col("block").cast("long"))

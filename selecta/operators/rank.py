"""Seeded order, global ranks, exact-n samples, splits.

Randomness is a hash, not a generator: the order key of row r under seed s is
``md5(s || ':' || r)``, tie-broken by ``row_id``. Same seed, same rows -> same
result on any cluster size, any partitioning, and in DuckDB.

``global_rank`` gives a dense 0-based rank without ``row_number() over
(order by ...)`` (which plans ``Exchange SinglePartition``): range-partition
on the key once (persisted), count rows per partition (P rows), turn counts
into offsets (a P-entry literal map — bounded by the partition count, not by
the data), add the position inside the partition.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed: int, id_col: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(str(int(seed))), F.lit(":"), F.col(id_col).cast("string")))


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order_cols: list, rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """Append a 0-based rank by ``order_cols`` (must be a total order).

    The range-partitioned, sorted table is persisted once and both the
    per-partition counts and the positions are read from that one copy.
    (Two independent range exchanges may sample different bounds — the
    sampling seed depends on the RDD — and then counts and positions would
    disagree.) A lost cached partition is recomputed through the same RDD,
    hence the same bounds. The counts are P rows (P = partitions): they go
    to the driver and come back as a literal offset map.
    """
    n = _partitions(df, num_partitions)
    ranked = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    ).persist(StorageLevel.MEMORY_AND_DISK)
    counts = sorted((r["_pid"], r["_base"], r["_cnt"]) for r in ranked.groupBy("_pid").agg(
        F.min("_mid").alias("_base"), F.count(F.lit(1)).alias("_cnt")).collect())
    start = {}
    acc = 0
    for pid, base, cnt in counts:
        start[pid] = acc - base          # rank = _mid + start[_pid]
        acc += cnt
    if not start:
        return ranked.withColumn(rank_col, F.lit(None).cast("long")).drop("_pid", "_mid")
    shift = F.create_map(*[x for pid, v in start.items() for x in (F.lit(pid), F.lit(int(v)))])
    return (ranked.withColumn(rank_col, (F.col("_mid") + F.element_at(shift, F.col("_pid"))).cast("long"))
            .drop("_pid", "_mid"))


def seeded_rank(df: DataFrame, seed: int, id_col: str = "row_id", rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    keyed = df.withColumn("_key", seeded_key(seed, id_col))
    return global_rank(keyed, [F.col("_key"), F.col(id_col)], rank_col, num_partitions).drop("_key")


def sample_random_n(df: DataFrame, n: int, seed: int, id_col: str = "row_id",
                    check_size: bool = True) -> DataFrame:
    """Exactly n rows without replacement (TakeOrderedAndProject).

    Each partition keeps its n smallest keys, one task merges P*n rows: n is
    the selection size, so the merge is bounded by the request, not the data.
    """
    if check_size:
        total = df.count()
        if n > total:
            raise ValueError(f"cannot sample {n} rows from {total}")
    return (df.withColumn("_key", seeded_key(seed, id_col))
            .orderBy("_key", id_col).limit(n).drop("_key"))


def split_train_validation(df: DataFrame, seed: int, train_fraction: float = 0.8,
                           id_col: str = "row_id") -> DataFrame:
    """Exact seeded split: the first floor(f*N) rows of the seeded order train."""
    ranked = seeded_rank(df, seed, id_col)
    total = F.lit(df.count())
    cut = F.floor(total * F.lit(train_fraction))
    return ranked.withColumn(
        "split", F.when(F.col("rank") < cut, F.lit("train")).otherwise(F.lit("validation"))
    ).drop("rank")

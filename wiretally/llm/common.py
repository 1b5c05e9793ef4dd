"""Helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from wiretally.session import checkpointed, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: evaluated once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory of a worker process back, so that reused workers do not keep the peaks of earlier tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def extended(df: DataFrame, added: str) -> T.StructType:
    """Schema of a table with the columns of a DDL string behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return (F.crc32(key.cast("string").cast("binary")) % F.lit(folds)).cast("int")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Gapless numbers from 0 within each group of ``keys``, for groups of any size.

    Rows are dealt to ``buckets`` parts of their group by a hash of ``order``,
    numbered inside a part, and moved by the row counts of the parts before it.
    Rows that agree in ``order`` may swap numbers. ``keys`` must not be null.
    """
    parted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    return (
        parted.withColumn("_here", F.row_number().over(inside).cast("bigint") - 1)
        .join(starts, [*keys, "_part"])
        .withColumn(out, F.col("_start") + F.col("_here"))
        .drop("_part", "_here", "_start")
    )


def parts_for(rows: int, per_part: int, least: int = 16) -> int:
    return max(least, math.ceil(rows / per_part))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of an edge table (a, b): one row (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps; every step aggregates minima
    before it shuffles, so a node with very many neighbours is never collected.
    Each round is cut off by a reliable checkpoint.
    """
    spark = edges.sparkSession
    links = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    state = None
    for _ in range(rounds):
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(
            links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("r").alias("lo"))
        large = checkpointed(large.filter("hi <> lo").distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = (
            large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("r").alias("lo"))
            .union(low.select("hi", F.col("r").alias("lo")))
        )
        links = checkpointed(small.filter("hi <> lo").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        links.select("lo", "lo").distinct())

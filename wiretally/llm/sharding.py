"""Sharding by rendezvous hashing over weighted shards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.llm.common import numbered, parts_for


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard of a key: every shard draws a score from the hash of (key, shard), the highest wins.

    A shard with weight w wins a share of w / sum of weights. Because the score
    of a shard depends on nothing but key, shard and weight, one more shard
    takes keys only into itself, and a removed one gives only its own away. A
    null key is hashed like any other value.
    """
    def drawn(weight: Column, shard: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-weight / F.log(uniform)).alias("score"), (-shard).alias("back"))

    best = F.array_max(F.transform(F.lit([float(w) for w in weights]), drawn))
    return (-best["back"]).cast("int")


def shard_rows(rows: DataFrame, key: str = "doc_id", weights: list[float] | None = None, grown: float = 1.0,
               per_part: int = 50_000) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one more shard of weight ``grown``) and ``slot``.

    ``slot`` numbers the rows of a shard gaplessly from 0. Only the columns given
    are shuffled, so leave the text out or reduce it first. Rows with equal keys
    share a shard; an empty table gives no rows; columns of the table stay as
    they are, apart from these three, which are replaced.
    """
    weights = weights or [1.0] * 40
    placed = rows.withColumns({
        "shard": rendezvous(F.col(key), weights), "grown_shard": rendezvous(F.col(key), [*weights, grown]),
    }).drop("slot")
    return numbered(placed, ["shard"], [key], "slot", parts_for(rows.count(), per_part * len(weights), 64))


def sharded_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Shard, slot and size of every document under the law ``key``.

    Size is the UTF-8 length of the text plus 16; a null text counts no bytes
    and has no checksum. Very long texts leave the first task as two numbers.
    """
    text = F.col("text").cast("binary")
    narrow = documents.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_rows(narrow, "doc_id", [1.0] * shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

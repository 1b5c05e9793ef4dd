"""Order-dependent computations over documents of any length.

A window partitioned by document would put a document that holds a third of all
rows into one task. These helpers cut each document into segments of bounded
size, work inside the segments, and pass only one small row per segment between
them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.session import written


def segment_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def number_rows(df: DataFrame, keys: list[str], segment: str, order: list, index: str, total: str) -> DataFrame:
    """Zero-based position of each row in its document and the document's row count.

    ``segment`` must grow with the order. Rows are numbered inside (document,
    segment); the rows of earlier segments are added from a per-segment count.
    The input is stored first, so that rows and counts do not evaluate it twice.
    """
    df = written(df, "ordered")
    counts = df.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_n"))
    doc = W.partitionBy(*keys)
    before = counts.select(
        *keys,
        segment,
        F.coalesce(
            F.sum("_n").over(doc.orderBy(segment).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_n").over(doc).alias(total),
    )
    here = W.partitionBy(*keys, segment).orderBy(*order)
    return (
        df.withColumn("_here", F.row_number().over(here).cast("bigint") - 1)
        .join(before, [*keys, segment])
        .withColumn(index, F.col("_before") + F.col("_here"))
        .drop("_before", "_here")
    )


def with_halo(df: DataFrame, keys: list[str], position: str, size: int, before: int, after: int) -> tuple[DataFrame, W]:
    """Segment rows and copy the rows next to each border into the neighbour.

    Returns the rows with ``_seg`` and ``_own`` (false for border copies) and
    the window to use. A frame of at most ``before`` rows back and ``after``
    rows ahead sees the same rows as it would in the undivided document; drop
    the rows with ``_own = false`` after it. For row frames ``position`` must be
    dense; for range frames rows may be missing.
    """
    if max(before, after) > size:
        raise ValueError("segments must be longer than the frame")
    own = segment_of(F.col(position), size)
    offset = F.col(position) - own * size
    copies = F.filter(
        F.array(
            F.struct(own.alias("seg"), F.lit(True).alias("own")),
            F.when(offset >= size - before, F.struct((own + 1).alias("seg"), F.lit(False).alias("own"))),
            F.when((offset < after) & (own > 0), F.struct((own - 1).alias("seg"), F.lit(False).alias("own"))),
        ),
        lambda x: x.isNotNull(),
    )
    spread = (
        df.withColumn("_copy", F.explode(copies))
        .withColumn("_seg", F.col("_copy.seg"))
        .withColumn("_own", F.col("_copy.own"))
        .drop("_copy")
    )
    return spread, W.partitionBy(*keys, "_seg").orderBy(position)


def carry_last(df: DataFrame, keys: list[str], position: str, value: str, size: int, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row, however far back.

    Looked up inside the segment first; one row per segment carries the value
    over to the segments behind it.
    """
    parted = df.withColumn("_seg", segment_of(F.col(position), size))
    inside = W.partitionBy(*keys, "_seg").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    ends = parted.groupBy(*keys, "_seg").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))).alias("_e")
    )
    earlier = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_seg", F.last(F.col("_e.v"), ignorenulls=True).over(earlier).alias("_carried"))
    return (
        parted.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*keys, "_seg"])
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_seg", "_inside", "_carried")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_seg")


def text_parts(df: DataFrame, keys: list[str], position: str, content: str, size: int, separator: str = "\n") -> DataFrame:
    """Join rows to text in parts of ``size`` positions.

    The parts of a document, read in order and joined by the separator, are its
    whole text; no single task has to hold a whole document.
    """
    return (
        df.withColumn("part_no", segment_of(F.col(position), size))
        .groupBy(*keys, "part_no")
        .agg(F.sort_array(F.collect_list(F.struct(position, content))).alias("_rows"))
        .select(
            *keys,
            "part_no",
            F.size("_rows").cast("bigint").alias("n_rows"),
            F.array_join(F.transform("_rows", lambda r: r[content]), separator).alias("text"),
        )
    )

"""Block preparation: cleaning, table detection, image geometry, reading order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.functions import fixed as K
from wiretally.functions.ordered import number_rows, segment_of
from wiretally.functions.text import chars, lines_of, strip

PAGES_PER_SEGMENT = 64


def looks_like_table(content: Column) -> Column:
    """At least three lines, two fifths of them with a column separator."""
    lines = lines_of(strip(content))
    marked = F.filter(
        lines,
        lambda x: x.contains("\t")
        | x.contains("  |  ")
        | ((F.length(x) - F.length(F.replace(x, F.lit("  "), F.lit("")))) >= 6),
    )
    return (F.size(lines) >= K.TABLE_MIN_LINES) & (F.size(marked) / F.size(lines) >= K.TABLE_SHARE)


def clean_text_blocks(blocks: DataFrame, min_chars: int = K.MIN_TEXT_CHARS) -> DataFrame:
    """Trim text, drop short fragments, mark tables, count characters and lines."""
    text = strip(F.col("content"))
    return (
        blocks.filter(F.col("block_type") == "text")
        .withColumn("content", text)
        .filter(F.length("content") >= min_chars)
        .withColumn("block_type", F.when(looks_like_table(F.col("content")), "table").otherwise("text"))
        .withColumn("char_count", chars(F.col("content")))
        .withColumn("line_count", F.size(lines_of(F.col("content"))).cast("bigint"))
    )


def keep_large_images(blocks: DataFrame, min_area: int = K.MIN_IMAGE_AREA) -> DataFrame:
    """Image rows of enough pixels with the geometry of their box."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return (
        blocks.filter(F.col("block_type") == "image")
        .filter(F.col("img_width") * F.col("img_height") >= min_area)
        .withColumn("box_width", width)
        .withColumn("box_height", height)
        .withColumn("box_area", width * height)
    )


def prepare_blocks(blocks: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """Cleaned text and table rows together with the images worth keeping, which get the text of their ``captions``."""
    images = keep_large_images(blocks).drop("box_width", "box_height", "box_area")
    if captions is not None:
        from wiretally.operators.captions import enrich_images

        images = enrich_images(images, captions)
    return clean_text_blocks(blocks).unionByName(images, allowMissingColumns=True)


def place_blocks(blocks: DataFrame, pages_per_segment: int = PAGES_PER_SEGMENT) -> DataFrame:
    """Reading order inside the segments of a document: ``block_index`` from 0 per segment, and ``position_ratio`` as a
    struct (at, n) of that index and the segment's number of blocks, until the counts of the segments before are known.

    Blank blocks are left out after they have been counted; a segment that has no other keeps one of them. Rows without
    a source or a page have no place, as in ``order_blocks``.
    """
    here = W.partitionBy("source_file", "page_segment").orderBy("page_number", "y0", "x0", "block_no")
    whole = here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        blocks.filter(F.col("source_file").isNotNull() & F.col("page_number").isNotNull())
        .withColumn("page_segment", segment_of(F.col("page_number"), pages_per_segment))
        .withColumn("_held", F.coalesce(strip(F.col("content")) != "", F.lit(False)))
        .select("*", (F.row_number().over(here).cast("bigint") - 1).alias("block_index"), F.count(F.lit(1)).over(whole).alias("_n"),
                F.max("_held").over(whole).alias("_filled"))
        .filter(F.col("_held") | (~F.col("_filled") & (F.col("block_index") == 0)))
        .withColumn("position_ratio", F.struct(F.col("block_index").alias("at"), F.col("_n").alias("n")))
        .drop("_n", "_held", "_filled")
    )


def order_blocks(blocks: DataFrame, pages_per_segment: int = PAGES_PER_SEGMENT) -> DataFrame:
    """Reading order: index from 0 per document, row count and position ratio."""
    numbered = number_rows(
        blocks.withColumn("page_segment", segment_of(F.col("page_number"), pages_per_segment)),
        ["source_file"],
        "page_segment",
        ["page_number", "y0", "x0", "block_no"],
        "block_index",
        "total_blocks",
    )
    return numbered.withColumn(
        "position_ratio", F.round(F.col("block_index") / F.greatest(F.col("total_blocks") - 1, F.lit(1)), 3)
    )


def extraction_statistics(blocks: DataFrame) -> DataFrame:
    """Counts per kind, mean text length, pages and image formats per document."""
    kind = F.col("block_type")
    return blocks.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "text").alias("text_count"),
        F.count_if(kind == "table").alias("table_count"),
        F.count_if(kind == "image").alias("image_count"),
        F.round(F.coalesce(F.avg(F.when(kind == "text", F.length("content"))), F.lit(0.0)), 1).alias("avg_text_len"),
        F.countDistinct("page_number").alias("pages_covered"),
        F.array_join(F.array_sort(F.collect_set(F.when(kind == "image", F.col("img_format")))), ",").alias(
            "image_formats"
        ),
    )

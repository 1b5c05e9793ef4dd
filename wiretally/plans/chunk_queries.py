"""Registered queries over block preparation and chunking."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions.text import strip
from wiretally.operators import captions as CP, chunking as CH, prepare as PR
from wiretally.plans import recipes as R
from wiretally.plans.chunk_sql import (
    CHUNKS, EMBEDDING_TEXT, ENRICHED, MERGED, PREPARED, SPACE, chunks_sql, heading_sql, split_sql, type_sql,
)

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def ordered(spark, d):
    return PR.order_blocks(PR.prepare_blocks(R.blocks(spark, d)))


def enriched(spark, d):
    return CP.enrich_images(ordered(spark, d), R.captions(spark, d))


def chunks(spark, d):
    return CH.build_chunks(R.blocks(spark, d), captions=R.captions(spark, d))


@register("block_cleaning", "WITH " + PREPARED + """
SELECT source_file, block_no, content, char_count, line_count FROM prepared WHERE block_type <> 'image'""")
def block_cleaning(spark, d):
    return PR.clean_text_blocks(R.blocks(spark, d)).select(
        "source_file", F.col("block_no").cast("bigint").alias("block_no"), "content", "char_count", "line_count")


@register("table_detection", "WITH " + PREPARED + """
SELECT source_file, block_no, block_type FROM prepared WHERE block_type <> 'image'""")
def table_detection(spark, d):
    return PR.clean_text_blocks(R.blocks(spark, d)).select(
        "source_file", F.col("block_no").cast("bigint").alias("block_no"), "block_type")


@register("image_geometry", "WITH " + PREPARED + """
SELECT source_file, block_no, x1 - x0 AS box_width, y1 - y0 AS box_height, (x1 - x0) * (y1 - y0) AS box_area
FROM prepared WHERE block_type = 'image'""")
def image_geometry(spark, d):
    return PR.keep_large_images(R.blocks(spark, d)).select(
        "source_file", F.col("block_no").cast("bigint").alias("block_no"), "box_width", "box_height", "box_area")


@register("reading_order", "WITH " + PREPARED + """
SELECT source_file, block_no, block_index, total_blocks, position_ratio FROM ordered""")
def reading_order(spark, d):
    return ordered(spark, d).select(
        "source_file", F.col("block_no").cast("bigint").alias("block_no"), "block_index", "total_blocks",
        "position_ratio")


@register("merge_short_blocks", "WITH RECURSIVE " + MERGED + """
SELECT source_file, page_number, block_index, block_type, content, y0, x1, y1, merged FROM merged""")
def merge_short_blocks(spark, d):
    filled = enriched(spark, d).filter(strip(F.col("content")) != "")
    return CH.merge_short(filled).select(
        "source_file", F.col("page_number").cast("bigint").alias("page_number"), "block_index", "block_type",
        "content", "y0", "x1", "y1", "merged")


@register("split_long_blocks", "WITH RECURSIVE whole AS (SELECT doc_id, 'text' AS block_type, "
          f"trim(text, {SPACE}) AS content FROM documents), " + split_sql("whole", "doc_id") + """
SELECT doc_id, split_part, split_total, split_start, split_end, content FROM pieces""")
def split_long_blocks(spark, d):
    whole = R.table(spark, d, "documents").select(
        "doc_id", F.lit("text").alias("block_type"), strip(F.col("text")).alias("content"))
    return CH.split_long(whole).select(
        "doc_id", "split_part", "split_total", "split_start", "split_end", "content")


@register("semantic_types", "WITH " + ENRICHED + f"""
SELECT source_file, block_index, {type_sql('block_type', 'content')} AS chunk_type FROM enriched""")
def semantic_types(spark, d):
    return enriched(spark, d).select(
        "source_file", "block_index",
        CH.semantic_type(F.col("block_type"), F.col("content")).alias("chunk_type"))


@register("section_titles", CHUNKS + " SELECT source_file, chunk_index, section_title FROM chunks")
def section_titles(spark, d):
    return chunks(spark, d).select("source_file", "chunk_index", "section_title")


@register("final_chunks", CHUNKS + """
SELECT chunk_id, content, chunk_type, page_number, source_file, chunk_index, total_chunks, section_title,
  length(content) AS char_count, block_type AS original_type, y0 AS bbox_y0, position_ratio, block_char_count, merged
FROM chunks""")
def final_chunks(spark, d):
    return chunks(spark, d).select(
        "chunk_id", "content", "chunk_type", "page_number", "source_file", "chunk_index", "total_chunks",
        "section_title", "char_count", "original_type", "bbox_y0", "position_ratio", "block_char_count", "merged")


@register("chunk_overlaps", CHUNKS + " SELECT source_file, chunk_index, overlap_prev, overlap_next FROM chunks")
def chunk_overlaps(spark, d):
    return chunks(spark, d).select("source_file", "chunk_index", "overlap_prev", "overlap_next")


@register("embedding_text", CHUNKS + f" SELECT chunk_id, {EMBEDDING_TEXT} AS embedding_text FROM chunks")
def embedding_text(spark, d):
    return chunks(spark, d).select("chunk_id", CH.embedding_text().alias("embedding_text"))


@register("chunk_payload", CHUNKS + """
SELECT chunk_id, content, chunk_type, page_number, source_file, chunk_index, section_title,
  length(content) AS char_count, block_type AS meta_original_type,
  CASE WHEN merged THEN 'true' ELSE 'false' END AS meta_merged, split_part::VARCHAR AS meta_split_part,
  total_chunks::VARCHAR AS meta_total_chunks FROM chunks""")
def chunk_payload(spark, d):
    rows = CH.payload(chunks(spark, d))
    meta = F.col("metadata")
    return rows.select(
        *CH.PAYLOAD, meta["original_type"].alias("meta_original_type"), meta["merged"].alias("meta_merged"),
        meta["split_part"].alias("meta_split_part"), meta["total_chunks"].alias("meta_total_chunks"))


@register("chunk_selection", CHUNKS + """
SELECT chunk_id, chunk_type, page_number FROM chunks
WHERE chunk_type IN ('code_cli', 'heading', 'table') AND page_number IN (1, 2, 3, 5, 8)""")
def chunk_selection(spark, d):
    return CH.select_chunks(chunks(spark, d), ("code_cli", "heading", "table"), (1, 2, 3, 5, 8)).select(
        "chunk_id", "chunk_type", "page_number")


@register("extraction_statistics", "WITH " + PREPARED + """
SELECT source_file, count(*) AS total, count(*) FILTER (block_type = 'text') AS text_count,
  count(*) FILTER (block_type = 'table') AS table_count, count(*) FILTER (block_type = 'image') AS image_count,
  round(coalesce(avg(length(content)) FILTER (block_type = 'text'), 0.0), 1) AS avg_text_len,
  count(DISTINCT page_number) AS pages_covered,
  coalesce(string_agg(DISTINCT img_format, ',' ORDER BY img_format), '') AS image_formats
FROM prepared GROUP BY source_file""")
def extraction_statistics(spark, d):
    return PR.extraction_statistics(PR.prepare_blocks(R.blocks(spark, d)))


@register("chunk_statistics", CHUNKS + """
SELECT coalesce(chunk_type, 'all') AS chunk_type, count(*) AS n_chunks,
  round(avg(length(content)), 0)::BIGINT AS mean_chars, min(page_number) AS first_page, max(page_number) AS last_page
FROM chunks GROUP BY GROUPING SETS ((chunk_type), ())""")
def chunk_statistics(spark, d):
    return CH.chunk_statistics(chunks(spark, d))


REPORT = CHUNKS + """,
raw AS (SELECT source_file, max(page_number) AS pages, count(*) AS raw_blocks,
  count(*) FILTER (block_type = 'image') AS images_found FROM prepared GROUP BY source_file),
built AS (SELECT source_file, count(*) AS final_chunks, count(*) FILTER (chunk_type = 'image_desc') AS images_analysed,
  count(*) FILTER (chunk_type = 'text') AS n_text, count(*) FILTER (chunk_type = 'code_cli') AS n_cli,
  count(*) FILTER (chunk_type = 'heading') AS n_heading FROM chunks GROUP BY source_file),
report AS (SELECT raw.*, coalesce(images_analysed, 0) AS images_analysed, coalesce(final_chunks, 0) AS final_chunks,
  nullif(n_text, 0) AS n_text, nullif(n_cli, 0) AS n_cli, nullif(n_heading, 0) AS n_heading
  FROM raw LEFT JOIN built USING (source_file))"""


def report(spark, d):
    return CH.ingest_report(PR.prepare_blocks(R.blocks(spark, d)), chunks(spark, d))


@register("ingest_report", REPORT + " SELECT *, final_chunks AS points FROM report")
def ingest_report(spark, d):
    kinds = F.col("chunks_by_type")
    return report(spark, d).select(
        "source_file", "pages", "raw_blocks", "images_found", "images_analysed", "final_chunks",
        kinds["text"].alias("n_text"), kinds["code_cli"].alias("n_cli"), kinds["heading"].alias("n_heading"),
        "points")


@register("batch_ingest", REPORT + """
SELECT coalesce(source_file, 'TOTAL') AS source_file, count(*) FILTER (final_chunks > 0) AS successes,
  sum(raw_blocks)::BIGINT AS raw_blocks, sum(final_chunks)::BIGINT AS final_chunks, sum(final_chunks)::BIGINT AS points
FROM report GROUP BY ROLLUP (source_file)""")
def batch_ingest(spark, d):
    return CH.batch_report(report(spark, d))


@register("caption_parsing", "WITH " + R.LINES + ", " + R.CAPTIONS + """
SELECT source_file, block_no, description, category, key_elements, technical_terms, confidence FROM caps""")
def caption_parsing(spark, d):
    return R.captions(spark, d).select(
        "source_file", F.col("block_no").cast("bigint").alias("block_no"), "description", "category",
        F.array_join("key_elements", ", ").alias("key_elements"),
        F.array_join("technical_terms", ", ").alias("technical_terms"), "confidence")


@register("caption_enrichment", "WITH " + ENRICHED + """
SELECT source_file, block_no, content, vision_category, vision_confidence, vision_error FROM enriched
WHERE block_type = 'image'""")
def caption_enrichment(spark, d):
    return enriched(spark, d).filter("block_type = 'image'").select(
        "source_file", F.col("block_no").cast("bigint").alias("block_no"), "content", "vision_category",
        "vision_confidence", "vision_error")

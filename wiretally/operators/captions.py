"""Image captions: parsing of model responses at bulk, enrichment of image blocks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.functions import fixed as K
from wiretally.functions.text import strip


def section(text: Column, marker: str) -> Column:
    """Text behind the first occurrence of a marker, up to the next other marker."""
    rest = F.substring(text, F.instr(text, marker) + len(marker), F.length(text))
    ends = [F.nullif(F.instr(rest, m), F.lit(0)) for m in K.CAPTION_MARKERS if m != marker]
    end = F.coalesce(F.least(*ends), F.length(rest) + 1)
    return F.when(F.instr(text, marker) > 0, strip(F.substring(rest, F.lit(1), end - 1))).otherwise("")


def _list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), strip), lambda x: x != "")


def parse_captions(responses: DataFrame) -> DataFrame:
    """Response text to description, category, two lists and a confidence."""
    description, category, elements, terms, confidence = [
        section(F.col("response"), m) for m in K.CAPTION_MARKERS
    ]
    kind = F.lit(None).cast("string")
    for name in reversed(K.CAPTION_CATEGORIES):
        kind = F.when(F.col("_category").contains(name), name).otherwise(kind)
    number = F.col("_confidence").try_cast("double")
    return (
        responses.withColumn("_category", F.lower(category))
        .withColumn("_confidence", F.replace(confidence, F.lit(","), F.lit(".")))
        .withColumn("_description", description)
        .select(
            *responses.columns,
            F.when(F.col("_description") != "", F.col("_description"))
            .otherwise(strip(F.col("response"))).alias("description"),
            F.coalesce(kind, F.lit("unknown")).alias("category"),
            _list(elements).alias("key_elements"),
            _list(terms).alias("technical_terms"),
            F.when(number.isNull() | F.isnan(number), K.CAPTION_DEFAULT_CONFIDENCE)
            .otherwise(F.greatest(F.least(number, F.lit(1.0)), F.lit(0.0))).alias("confidence"),
        )
    )


def searchable_text() -> Column:
    return F.concat_ws(
        "\n\n",
        F.col("description"),
        F.when(F.size("key_elements") > 0, F.concat(F.lit("Éléments clés : "), F.array_join("key_elements", ", "))),
        F.when(F.size("technical_terms") > 0,
               F.concat(F.lit("Termes techniques : "), F.array_join("technical_terms", ", "))),
    )


def enrich_images(blocks: DataFrame, captions: DataFrame) -> DataFrame:
    """Give image blocks the text of their caption, or a placeholder on failure.

    ``captions`` has one row per (source_file, block_no) with parsed columns and
    an ``error`` column that is null on success.
    """
    ok = F.col("error").isNull() & (strip(F.col("description")) != "")
    text = captions.select(
        "source_file", "block_no", "category", "confidence", "error",
        F.when(ok, searchable_text()).alias("_caption"), F.lit(True).alias("_captioned"),
    )
    image = F.col("block_type") == "image"
    failed = F.concat(
        F.lit("[Image p."), F.col("page_number").cast("string"), F.lit(" — non analysée : "),
        F.coalesce("error", F.lit("None")), F.lit("]"),
    )
    return (
        blocks.join(text, ["source_file", "block_no"], "left")
        .withColumn("content", F.when(image & F.col("_captioned"), F.coalesce(F.col("_caption"), failed))
                    .otherwise(F.col("content")))
        .withColumn("vision_category", F.when(image & F.col("_caption").isNotNull(), F.col("category")))
        .withColumn("vision_confidence", F.when(image & F.col("_caption").isNotNull(), F.col("confidence")))
        .withColumn("vision_error", F.when(image & F.col("_captioned") & F.col("_caption").isNull(), F.col("error")))
        .drop("category", "confidence", "error", "_caption", "_captioned")
    )

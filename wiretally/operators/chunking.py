"""From ordered blocks to typed, overlapping, section-aware chunks."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.functions import fixed as K
from wiretally.functions.ordered import own_rows, with_halo
from wiretally.functions.rows import unfold
from wiretally.functions.text import chars, let, lines_of, strip
from wiretally.operators.prepare import PAGES_PER_SEGMENT, place_blocks, prepare_blocks
from wiretally.session import written

CHUNKS_PER_SEGMENT = 512


@dataclass(frozen=True)
class ChunkSettings:
    min_chars: int = K.MIN_CHUNK_CHARS
    max_chars: int = K.MAX_CHUNK_CHARS
    overlap: int = K.OVERLAP_CHARS
    cut_zone: int = K.CUT_ZONE_CHARS
    drop_contained_tails: bool = False


DEFAULTS = ChunkSettings()


def _joined(a: Column, b: Column) -> Column:
    """Block ``a`` extended by ``b``: kind and origin of the first, text of both."""
    return F.struct(
        a["block_index"].alias("block_index"),
        a["block_type"].alias("block_type"),
        F.concat(a["content"], F.lit("\n"), b["content"]).alias("content"),
        a["x0"].alias("x0"),
        a["y0"].alias("y0"),
        F.greatest(a["x1"], b["x1"]).alias("x1"),
        F.greatest(a["y1"], b["y1"]).alias("y1"),
        b["position_ratio"].alias("position_ratio"),
        b["block_char_count"].alias("block_char_count"),
        F.lit(True).alias("merged"),
    )


def merge_short(blocks: DataFrame, settings: ChunkSettings = DEFAULTS) -> DataFrame:
    """Let a short block absorb the blocks that follow it on the same page.

    Whatever precedes it, a block of ``min_chars`` or more always closes the
    block it ends up in, and so does an image. The page therefore falls into
    independent runs, and only a run of short blocks is folded in order.
    """
    page = W.partitionBy("source_file", "page_segment", "page_number").orderBy("block_index")
    is_image = F.col("block_type") == "image"
    closes = F.lag(is_image | (F.length("content") >= settings.min_chars)).over(page)
    starts = F.when(is_image | F.coalesce(closes, F.lit(True)), 1).otherwise(0)
    row = F.struct(
        "block_index", "block_type", "content", "x0", "y0", "x1", "y1", "position_ratio",
        F.col("char_count").alias("block_char_count"), F.lit(False).alias("merged"),
    )
    folded = F.aggregate(
        F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))),
        F.slice("rows", 1, 1),
        lambda done, b: F.when(
            F.length(F.element_at(done, -1)["content"]) < settings.min_chars,
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_joined(F.element_at(done, -1), b))),
        ).otherwise(F.concat(done, F.array(b))),
    )
    runs = (
        blocks.withColumn("content", F.coalesce(F.col("content"), F.lit("")))
        .withColumn("_starts", starts)
        .withColumn("_run", F.sum("_starts").over(page.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("source_file", "page_segment", "page_number", "_run")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
    )
    page_keys = ["source_file", "page_segment", "page_number"]
    return unfold(runs, page_keys, folded, "b").select(*page_keys, "b.*")


def split_windows(text: Column, settings: ChunkSettings = DEFAULTS) -> Column:
    """Array of (start, end, piece) windows over one long text.

    A window ends at ``max_chars`` or at the last line feed of its final zone;
    the next begins ``overlap`` characters before that end. The fold carries the
    next start, and each step moves on by a fixed least amount, which bounds the
    number of steps.
    """
    return let(F.struct(text.alias("t"), F.length(text).alias("n")), lambda x: _fold_windows(x["t"], x["n"], settings))


def _fold_windows(text: Column, total: Column, settings: ChunkSettings) -> Column:
    size, zone = settings.max_chars, settings.cut_zone
    least = size - zone - settings.overlap

    def advance(acc: Column, start: Column, cut: Column, piece: Column) -> Column:
        keep = (start < total) & (F.length(piece) > 0)
        if settings.drop_contained_tails:
            keep = keep & ((start == 0) | (start + settings.overlap < total))
        window = F.struct(start.alias("split_start"), F.least(cut, total).alias("split_end"), piece.alias("piece"))
        return F.struct(
            F.when(start < total, cut - settings.overlap).otherwise(start).alias("next"),
            F.when(keep, F.concat(acc["done"], F.array(window))).otherwise(acc["done"]).alias("done"),
        )

    def step(acc: Column, _: Column) -> Column:
        start = acc["next"]
        raw = F.substring(text, start + 1, F.lit(size))
        return F.when(start >= total, acc).otherwise(let(raw, lambda w: let(
            F.when(start + size < total, F.instr(F.reverse(F.substring(w, F.lit(size - zone + 1), F.lit(zone))), "\n"))
            .otherwise(0),
            lambda back: advance(acc, start, start + size - back,
                                 strip(F.when(back > 0, F.substring(w, F.lit(1), size - back)).otherwise(w))),
        )))

    first = F.struct(
        F.lit(0).alias("next"),
        F.array().cast("array<struct<split_start:int,split_end:int,piece:string>>").alias("done"),
    )
    steps = F.sequence(F.lit(1), (total / least).cast("int") + 1)
    return F.aggregate(steps, first, step, lambda acc: acc["done"])


def split_long(pieces: DataFrame, settings: ChunkSettings = DEFAULTS) -> DataFrame:
    """Cut long text into windows; other rows pass through with null split columns."""
    long_text = (F.col("block_type") == "text") & (F.length("content") > settings.max_chars)
    whole = F.array(
        F.struct(
            F.lit(None).cast("int").alias("split_start"),
            F.lit(None).cast("int").alias("split_end"),
            F.col("content").alias("piece"),
        )
    )
    part = F.when(F.col("_w.split_start").isNotNull(), F.col("_part").cast("bigint"))
    cut = F.when(long_text, split_windows(F.col("content"), settings)).otherwise(whole)
    counted = let(cut, lambda w: F.transform(w, lambda x: F.struct(
        x["split_start"].alias("split_start"), x["split_end"].alias("split_end"), x["piece"].alias("piece"),
        F.size(w).cast("bigint").alias("n"))))
    return (
        unfold(pieces, list(pieces.columns), counted, "_w", "_part")
        .withColumn("content", strip(F.col("_w.piece")))
        .withColumn("split_part", part)
        .withColumn("split_total", F.when(part.isNotNull(), F.col("_w.n")))
        .withColumn("split_start", F.col("_w.split_start").cast("bigint"))
        .withColumn("split_end", F.col("_w.split_end").cast("bigint"))
        .drop("_w", "_part")
    )


def semantic_type(block_type: Column, content: Column) -> Column:
    """image, table, heading, command line or text: the first rule that holds."""
    return _type_of(block_type, strip(content))


def _type_of(block_type: Column, text: Column) -> Column:
    return (
        F.when(block_type == "image", "image_desc")
        .when(block_type == "table", "table")
        .when((F.length(text) < K.HEADING_MAX_CHARS) & F.regexp_like(text, F.lit(K.HEADING)), "heading")
        .when((F.substring_index(text, "\n", 2) != text) & (F.regexp_count(text, F.lit(K.CLI_MARK)) >= 2), "code_cli")    # three lines
        .otherwise("text")
    )


def section_mark(content: Column) -> Column:
    """First line of a block that can serve as section title, else null."""
    return _mark_of(strip(content))


def _mark_of(text: Column) -> Column:
    return F.when((F.length(text) < K.TITLE_MAX_CHARS) & F.regexp_like(text, F.lit(K.HEADING)), strip(lines_of(text)[0]))


def place_chunks(pieces: DataFrame, settings: ChunkSettings = DEFAULTS) -> DataFrame:
    """Typed chunks with their place and context inside a segment, all in the segment's one task.

    ``_at`` is the place from 0 and ``_n`` the segment's number of chunks, ``_title`` the nearest section mark before (place,
    text). What the next and the previous segment need stands in the rows at the edges: ``_tail``, ``_head`` and, where it is the segment's
    last, ``_last_mark``.
    """
    here = W.partitionBy("source_file", "page_segment").orderBy("page_number", "block_index", "split_part")
    whole = here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    typed = pieces.withColumn("chunk_type", _type_of(F.col("block_type"), F.col("content"))).select(
        "*", _mark_of(F.col("content")).alias("_mark"), F.when(_prose(), F.col("content")).alias("_usable"))
    placed = typed.select(
        "*", (F.row_number().over(here).cast("bigint") - 1).alias("_at"), F.count(F.lit(1)).over(whole).alias("_rows"),
        F.lag("_usable").over(here).alias("_prev"), F.lead("_usable").over(here).alias("_next"))
    mark = F.when(F.col("_mark").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_mark").alias("text")))
    size, last = settings.overlap, F.col("_at") == F.col("_rows") - 1
    return placed.withColumn("_title", F.last(mark, ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1))).select(
        *[c for c in pieces.columns], "chunk_type", "_at", "_title",
        F.when(F.col("content") == "", 0).otherwise(F.col("_rows")).alias("_n"),
        F.when(_prose(), _tail(F.col("_prev"), size)).alias("overlap_prev"),
        F.when(_prose(), _head(F.col("_next"), size)).alias("overlap_next"),
        F.when(last, _tail(F.col("_usable"), size)).alias("_tail"),
        F.when(F.col("_at") == 0, _head(F.col("_usable"), size)).alias("_head"),
        F.when(last, F.coalesce(mark, F.col("_title"))).alias("_last_mark"),
    )


def number_chunks(placed: DataFrame) -> DataFrame:
    """Place, counts and context of stored chunks in their whole document.

    A document of one segment has them already. The others get those of their segments from a table with one short row for each,
    which is stored, so that the planner knows its size: where it is small, no chunk is shuffled.
    """
    held = F.col("_n") > 0
    segments = placed.groupBy("source_file", "page_segment").agg(
        F.max("_n").alias("_n"), F.max("position_ratio.n").alias("_blocks"), F.max("_tail").alias("_tail"),
        F.max("_head").alias("_head"), F.max("_last_mark").alias("_last_mark"))
    doc = W.partitionBy("source_file")
    order = doc.orderBy("page_segment")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mark = F.when(F.col("_last_mark").isNotNull(), F.struct(
        (F.col("_before") + F.col("_last_mark.at")).alias("at"), F.col("_last_mark.text").alias("text")))
    several = written(
        segments.withColumn("_segments", F.count(F.lit(1)).over(every)).filter(F.col("_segments") > 1)
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_blocks_before", F.coalesce(F.sum("_blocks").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(every))
        .withColumn("_total_blocks", F.sum("_blocks").over(every))
        .withColumn("_far_tail", F.last(F.when(held, F.struct("_tail")), ignorenulls=True).over(before)["_tail"])
        .withColumn("_far_head", F.first(F.when(held, F.struct("_head")), ignorenulls=True).over(after)["_head"])
        .withColumn("_far_mark", F.last(mark, ignorenulls=True).over(before))
        .select("source_file", "page_segment", "_before", "_blocks_before", "_total", "_total_blocks", "_far_tail", "_far_head",
                "_far_mark"), "segments")
    first, last = F.col("_at") == 0, F.col("_at") == F.col("_n") - 1
    start = F.coalesce("_before", F.lit(0))
    at = F.coalesce(start + F.col("_title.at"), F.col("_far_mark.at"))
    title = F.when(F.col("_title").isNotNull(), F.col("_title.text")).otherwise(F.col("_far_mark.text"))
    place = F.coalesce("_blocks_before", F.lit(0)) + F.col("position_ratio.at")
    blocks = F.coalesce("_total_blocks", F.col("position_ratio.n"))
    return (
        placed.filter(F.col("content") != "").join(several, ["source_file", "page_segment"], "left")
        .withColumn("chunk_index", start + F.col("_at"))
        .withColumn("total_chunks", F.coalesce("_total", "_n"))
        .withColumn("position_ratio", F.round(place / F.greatest(blocks - 1, F.lit(1)), 3))
        .withColumn("section_title", F.coalesce(F.when(F.col("chunk_index") - at <= K.TITLE_LOOK_BACK, title), F.lit("")))
        .withColumn("overlap_prev", F.coalesce("overlap_prev", F.when(first & _prose(), F.col("_far_tail")), F.lit("")))
        .withColumn("overlap_next", F.coalesce("overlap_next", F.when(last & _prose(), F.col("_far_head")), F.lit("")))
    )


def _prose() -> Column:
    return F.col("chunk_type").isin("text", "code_cli")


def _tail(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, strip(F.right(text, F.lit(size)))).otherwise(text)


def _head(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, strip(F.left(text, F.lit(size)))).otherwise(text)


def add_context(chunks: DataFrame, settings: ChunkSettings = DEFAULTS) -> DataFrame:
    """Section title carried forward, and text shared with the neighbours.

    Both look only a few rows around, so the document is cut into segments that
    overlap by those rows: one shuffle serves both, whatever the document length.
    """
    size = settings.overlap
    spread, doc = with_halo(
        chunks.withColumn("_mark", section_mark(F.col("content"))),
        ["source_file"], "chunk_index", CHUNKS_PER_SEGMENT, K.TITLE_LOOK_BACK, 1,
    )
    back = doc.rowsBetween(-K.TITLE_LOOK_BACK, -1)
    usable = F.when(_prose(), F.col("content"))
    before, after = F.lag(usable).over(doc), F.lead(usable).over(doc)
    return own_rows(
        spread.withColumn("section_title", F.coalesce(F.last("_mark", ignorenulls=True).over(back), F.lit("")))
        .withColumn("_prev", before)
        .withColumn("_next", after)
    ).select(
        *[c for c in chunks.columns],
        "section_title",
        F.when(_prose() & F.col("_prev").isNotNull(), _tail(F.col("_prev"), size)).otherwise("").alias("overlap_prev"),
        F.when(_prose() & F.col("_next").isNotNull(), _head(F.col("_next"), size)).otherwise("").alias("overlap_next"),
    )


def embedding_text() -> Column:
    """Text to index: section, type of structured chunks, previous overlap, content."""
    return F.concat_ws(
        "\n",
        F.when(F.col("section_title") != "", F.concat(F.lit("Section: "), F.col("section_title"))),
        F.when(F.col("chunk_type").isin("code_cli", "table"), F.concat(F.lit("Type: "), F.col("chunk_type"))),
        F.when(F.col("overlap_prev") != "", F.concat(F.lit("[contexte précédent]: "), F.col("overlap_prev"))),
        F.col("content"),
    )


def build_chunks(blocks: DataFrame, settings: ChunkSettings = DEFAULTS, captions: DataFrame | None = None) -> DataFrame:
    """Raw block table to final chunk table.

    Blocks are shuffled once, to the segments of their document, where they are ordered, merged, split, typed and given their
    context; the chunks are stored, and only short rows of the segments are combined for what lies beyond a segment.
    """
    placed = place_blocks(prepare_blocks(blocks, captions), PAGES_PER_SEGMENT)
    pieces = split_long(merge_short(placed, settings), settings)
    return final_columns(number_chunks(written(place_chunks(pieces, settings).drop("x0", "x1", "y1"), "chunks")))


def chunk_id() -> Column:
    """Repeatable identity, so that indexing a document twice changes nothing."""
    return F.sha2(F.concat_ws("|", "source_file", F.col("chunk_index").cast("string"), "content"), 256)


def final_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        chunk_id().alias("chunk_id"),
        "content",
        "chunk_type",
        F.col("page_number").cast("bigint").alias("page_number"),
        "source_file",
        "chunk_index",
        "total_chunks",
        "section_title",
        chars(F.col("content")).alias("char_count"),
        F.col("block_type").alias("original_type"),
        F.round("y0", 1).alias("bbox_y0"),
        "position_ratio",
        "block_char_count",
        "merged",
        "split_part",
        "split_total",
        "split_start",
        "split_end",
        "overlap_prev",
        "overlap_next",
    )


PAYLOAD = (
    "chunk_id", "content", "chunk_type", "page_number", "source_file", "chunk_index", "section_title", "char_count",
)


def payload(chunks: DataFrame) -> DataFrame:
    """Eight core fields and the rest as one metadata map."""
    rest = [c for c in chunks.columns if c not in PAYLOAD and not c.startswith("overlap_")]
    entries = F.filter(
        F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rest]),
        lambda e: e["value"].isNotNull(),
    )
    return chunks.select(*PAYLOAD, F.map_from_entries(entries).alias("metadata"))


def select_chunks(chunks: DataFrame, types=None, pages=None) -> DataFrame:
    if types is not None:
        chunks = chunks.filter(F.col("chunk_type").isin(*types))
    if pages is not None:
        chunks = chunks.filter(F.col("page_number").isin(*pages))
    return chunks


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Count, mean size and page span per type, with one row for all types."""
    return (
        chunks.groupingSets([[F.col("chunk_type")], []], F.col("chunk_type"))
        .agg(
            F.count(F.lit(1)).alias("n_chunks"),
            F.round(F.avg("char_count"), 0).cast("bigint").alias("mean_chars"),
            F.min("page_number").alias("first_page"),
            F.max("page_number").alias("last_page"),
        )
        .withColumn("chunk_type", F.coalesce("chunk_type", F.lit("all")))
    )


def ingest_report(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document: pages, blocks, images, chunks and chunks per type."""
    raw = blocks.groupBy("source_file").agg(
        F.max("page_number").cast("bigint").alias("pages"),
        F.count(F.lit(1)).alias("raw_blocks"),
        F.count_if(F.col("block_type") == "image").alias("images_found"),
    )
    per_type = chunks.groupBy("source_file", "chunk_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("chunk_type") == "image_desc") & (F.col("content") != "")).alias("described"),
    )
    built = per_type.groupBy("source_file").agg(
        F.sum("n").alias("final_chunks"),
        F.sum("described").alias("images_analysed"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_type", "n")))).alias("chunks_by_type"),
    )
    zero = F.lit(0).cast("bigint")
    return raw.join(built, "source_file", "left").select(
        "source_file", "pages", "raw_blocks", "images_found",
        F.coalesce("images_analysed", zero).alias("images_analysed"),
        F.coalesce("final_chunks", zero).alias("final_chunks"),
        "chunks_by_type",
        F.coalesce("final_chunks", zero).alias("points"),
    )


def batch_report(report: DataFrame) -> DataFrame:
    """Report rows by name plus one total row for the whole folder."""
    return (
        report.rollup("source_file")
        .agg(
            F.count_if(F.col("final_chunks") > 0).alias("successes"),
            F.sum("raw_blocks").alias("raw_blocks"),
            F.sum("final_chunks").alias("final_chunks"),
            F.sum("points").alias("points"),
        )
        .withColumn("source_file", F.coalesce("source_file", F.lit("TOTAL")))
    )

"""Incremental document ingest from a stream of block rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wiretally.operators.chunking import build_chunks
from wiretally.session import scratch_path
from wiretally.sources.tables import BLOCK_SCHEMA, INDEX_BUCKETS, accept_blocks, read_index, replace_sources, with_bucket

BLOCK_KEY = ("source_file", "page_number", "block_no")
#: Folders of a batch in the block store, by source.
BLOCK_BUCKETS = 256


def ingest_stream(blocks: DataFrame, index_path: str, manifest_path: str, state_path: str, captions: DataFrame | None = None):
    """Start the ingest: a document is in the index as soon as its first blocks are, and complete with its last.

    A micro-batch keeps its blocks in a folder of its own, in buckets of the source,
    and the list of its sources beside them. The documents of which it brings blocks
    not seen before are chunked anew from all their blocks and replaced in the index;
    blocks seen before change nothing. Earlier blocks are read only from the batches
    and buckets that hold a source of this batch, so the blocks read for a batch do
    not grow with the number of batches. ``captions`` gives image blocks their text,
    as in a batch ingest. A batch that is run again after a failure writes the same
    rows to the same places.
    """
    store = f"{manifest_path.rstrip('/')}-blocks"

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        keep_batch(rows, store, batch_id)
        held = first_seen(spark, store, batch_id)
        touched = held.filter(F.col("batch") == batch_id).select("source_file").distinct()
        whole = held.drop("batch").join(touched, "source_file", "left_semi")
        replace_sources(spark, index_path, build_chunks(whole, captions=captions), touched)
        buckets = with_bucket(touched, INDEX_BUCKETS).agg(F.collect_set("bucket")).first()[0]
        done = (
            read_index(spark, index_path, only=buckets).join(touched, "source_file", "left_semi").groupBy("source_file")
            .agg(F.count(F.lit(1)).alias("chunks_indexed"))
        )
        done.select(F.sha2("source_file", 256).alias("file_id"), F.col("source_file").alias("filename"),
                    F.current_timestamp().alias("ingested_at"), "chunks_indexed").write.mode("overwrite").parquet(
            f"{manifest_path}/batch={batch_id}")

    return blocks.writeStream.option("checkpointLocation", state_path).trigger(availableNow=True).foreachBatch(
        write).start()


def keep_batch(rows: DataFrame, store: str, batch_id: int) -> None:
    """Write the accepted blocks of a micro-batch and the list of its sources."""
    spark = rows.sparkSession
    accepted = with_bucket(accept_blocks(rows).select(*BLOCK_SCHEMA.fieldNames()), BLOCK_BUCKETS)
    accepted.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")
    (stored_blocks(spark, store).filter(F.col("batch") == batch_id).select("source_file", "bucket").distinct()
     .write.mode("overwrite").parquet(f"{store}-sources/batch={batch_id}"))


def stored_blocks(spark: SparkSession, store: str) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BLOCK_SCHEMA.fields)
    return spark.read.schema(f"{fields}, batch int, bucket int").option("basePath", store).parquet(store)


def sources_until(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    return spark.read.schema("source_file string, bucket int, batch int").option(
        "basePath", f"{store}-sources").parquet(f"{store}-sources").filter(F.col("batch") <= batch_id)


def folders_of_batch(spark: SparkSession, store: str, batch_id: int) -> tuple[list[int], list[int]]:
    """Batches and buckets that hold blocks of a source of this batch; found in the lists of sources."""
    listed = sources_until(spark, store, batch_id)
    mine = listed.filter(F.col("batch") == batch_id).select("source_file")
    return tuple(listed.join(mine, "source_file", "left_semi").agg(F.collect_set("batch"), F.collect_set("bucket")).first())


def blocks_of_batch(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """All blocks up to this batch of the sources it names, read from the folders that hold them."""
    batches, buckets = folders_of_batch(spark, store, batch_id)
    mine = sources_until(spark, store, batch_id).filter(F.col("batch") == batch_id).select("source_file")
    return stored_blocks(spark, store).filter(F.col("batch").isin(*batches) & F.col("bucket").isin(*buckets)).join(
        mine, "source_file", "left_semi")


def first_seen(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """Every block of this batch's sources once, from the first batch that has it, with the number of that batch."""
    held = blocks_of_batch(spark, store, batch_id)
    rest = [c for c in BLOCK_SCHEMA.fieldNames() if c not in BLOCK_KEY]
    return held.groupBy(*BLOCK_KEY).agg(F.min(F.struct("batch", *rest)).alias("b")).select(
        *[c if c in BLOCK_KEY else F.col("b")[c].alias(c) for c in BLOCK_SCHEMA.fieldNames()], F.col("b.batch").alias("batch"))


def current_manifest(spark: SparkSession, manifest_path: str) -> DataFrame:
    """The latest row of each document."""
    rows = spark.read.schema(
        "file_id string, filename string, ingested_at timestamp, chunks_indexed long, batch int").option(
        "basePath", manifest_path).parquet(manifest_path)
    fields = ("file_id", "ingested_at", "chunks_indexed")
    return rows.groupBy("filename").agg(F.max(F.struct("batch", *fields)).alias("m")).select(
        "filename", *[F.col("m")[c].alias(c) for c in fields])


def run_ingest(blocks: DataFrame, captions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ingest everything available; returns (chunks, manifest)."""
    spark = blocks.sparkSession
    paths = [scratch_path(spark, x) for x in ("chunks", "manifest", "ingest-state")]
    ingest_stream(blocks, *paths, captions=captions).awaitTermination()
    return read_index(spark, paths[0]), current_manifest(spark, paths[1])

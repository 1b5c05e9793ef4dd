"""Readers and writers: block tables, chunk JSON, chunk index, manifest."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wiretally.functions.text import base_name
from wiretally.session import scratch_path

BLOCK_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()), T.StructField("page_number", T.IntegerType()),
    T.StructField("block_no", T.IntegerType()), T.StructField("block_type", T.StringType()),
    T.StructField("x0", T.DoubleType()), T.StructField("y0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()),
    T.StructField("content", T.StringType()), T.StructField("img_width", T.IntegerType()),
    T.StructField("img_height", T.IntegerType()), T.StructField("img_format", T.StringType()),
])
CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("chunk_type", T.StringType()), T.StructField("page_number", T.LongType()),
    T.StructField("source_file", T.StringType()), T.StructField("chunk_index", T.LongType()),
    T.StructField("section_title", T.StringType()), T.StructField("char_count", T.LongType()),
    T.StructField("original_type", T.StringType()), T.StructField("bbox_y0", T.DoubleType()),
    T.StructField("position_ratio", T.DoubleType()), T.StructField("total_chunks", T.LongType()),
    T.StructField("block_index", T.LongType()), T.StructField("line_count", T.LongType()),
    T.StructField("merged", T.BooleanType()), T.StructField("split_part", T.LongType()),
    T.StructField("split_total", T.LongType()), T.StructField("split_start", T.LongType()),
    T.StructField("split_end", T.LongType()), T.StructField("vision_category", T.StringType()),
    T.StructField("vision_confidence", T.DoubleType()),
    T.StructField("vision_key_elements", T.ArrayType(T.StringType())),
    T.StructField("vision_terms", T.ArrayType(T.StringType())), T.StructField("vision_is_mock", T.BooleanType()),
    T.StructField("image_path", T.StringType()), T.StructField("img_index", T.LongType()),
    T.StructField("img_width", T.LongType()), T.StructField("img_height", T.LongType()),
    T.StructField("vision_description", T.StringType()), T.StructField("vision_searchable", T.StringType()),
    T.StructField("vision_tokens_used", T.LongType()), T.StructField("vision_error", T.StringType()),
])
KINDS = ("text", "image", "table")
INDEX_BUCKETS = 64
#: Codec of the index and of what is staged for it.
INDEX_CODEC = "zstd"


#: An input below this many bytes per core is spread over all cores.
SMALL_INPUT = 16 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores for a small input that lies in one or two files.

    A Parquet file with a single row group is read by one task, and row-wise text
    work would stay in it. Only inputs that the planner estimates at less than
    16 MB per core are redistributed; larger ones keep their scan partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < cores * SMALL_INPUT else df


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return accept_blocks(spark.read.schema(BLOCK_SCHEMA).format(fmt).load(path))


def accept_blocks(blocks: DataFrame) -> DataFrame:
    """Known kinds of PDF sources only; the source is reduced to its file name."""
    return (
        blocks.withColumn("source_file", base_name(F.col("source_file")))
        .filter(F.lower("source_file").endswith(".pdf") & F.col("block_type").isin(*KINDS))
    )


def write_chunk_json(chunks: DataFrame, path: str) -> None:
    """Flat JSON rows, one object per line, over as many files as partitions."""
    held = [f.name for f in CHUNK_SCHEMA.fields if f.name in chunks.columns]
    chunks.select(*held).write.mode("overwrite").json(path)


def read_chunk_json(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Chunk rows from JSON lines, or from files that hold one array each."""
    reader = spark.read.schema(CHUNK_SCHEMA)
    return (reader.option("multiLine", True) if arrays else reader).json(path)


# --- chunk index: a Parquet table in hash buckets of the source

def with_bucket(rows: DataFrame, buckets: int = INDEX_BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("source_file"), F.lit(buckets)).cast("int"))


def index_counts(chunks: DataFrame) -> DataFrame:
    good = F.col("chunk_id").isNotNull() & (F.coalesce("content", F.lit("")) != "")
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"),
                      F.count_if(~good).alias("error"))


def write_index(chunks: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Create the index. A fixed number of bucket folders, whatever the number of
    documents; a crowded bucket is written by many tasks."""
    with_bucket(_valid(chunks), buckets).write.mode("overwrite").option("compression", INDEX_CODEC).partitionBy("bucket").parquet(path)


def _valid(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("chunk_id").isNotNull() & (F.coalesce("content", F.lit("")) != ""))


def read_index(spark: SparkSession, path: str, source: str | None = None, buckets: int = INDEX_BUCKETS,
               only: list[int] | None = None) -> DataFrame:
    """The index; for one source only its bucket folder is read, for ``only`` those of the given buckets."""
    rows = spark.read.parquet(path).filter(F.col("chunk_id").isNotNull())
    if only is not None:
        rows = rows.filter(F.col("bucket").isin(*only))
    if source is not None:
        one = F.pmod(F.xxhash64(F.lit(source)), F.lit(buckets)).cast("int")
        rows = rows.filter((F.col("bucket") == one) & (F.col("source_file") == source))
    return rows.drop("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:           # no folder, or one without data files
        return False


def replace_sources(spark: SparkSession, path: str, chunks: DataFrame, sources: DataFrame,
                    buckets: int = INDEX_BUCKETS) -> None:
    """Upsert: all old rows of the given sources go, the new chunks come.

    Only the touched buckets are rewritten. Their new content is first written
    beside the index in the shared folder, then moved in by a dynamic partition
    overwrite; running the job again gives the same index. A marker row without
    chunk id stands in every touched bucket, so that one left without chunks is
    overwritten too; readers skip it.
    """
    named = with_bucket(sources.select("source_file").distinct(), buckets)
    touched = named.agg(F.collect_set("bucket")).first()[0]
    if not touched:
        return
    if not _exists(spark, path):
        write_index(chunks, path, buckets)
        return
    old = spark.read.parquet(path).filter(F.col("bucket").isin(*touched) & F.col("chunk_id").isNotNull())
    marker = spark.createDataFrame([(b,) for b in touched], "bucket int")
    kept = old.join(named.select("source_file"), "source_file", "left_anti")
    fresh = with_bucket(_valid(chunks), buckets)
    staged = scratch_path(spark, "index")
    kept.select(*old.columns).unionByName(fresh.select(*old.columns)).unionByName(
        marker, allowMissingColumns=True).write.option("compression", INDEX_CODEC).parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", INDEX_CODEC).partitionBy("bucket").parquet(path)


def not_indexed(blocks: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Blocks of documents the index does not hold yet."""
    return blocks if force else blocks.join(index.select("source_file").distinct(), "source_file", "left_anti")


# --- manifest

def append_manifest(rows: DataFrame, path: str) -> None:
    rows.select("file_id", "filename", "ingested_at", "chunks_indexed").write.mode("append").parquet(path)


def list_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("ingested_at"), F.asc("filename"))

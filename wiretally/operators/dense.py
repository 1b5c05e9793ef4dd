"""Vectors: default hashed embedding, exact and approximate cosine top-k."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from wiretally.functions.ranking import top_k
from wiretally.functions.rows import unfold
from wiretally.functions.text import tokens

#: Rows of a block in the blocked path; bounds the memory of one task. Fewer queries may make a block, to use all cores.
BLOCK_ROWS, LEAST_QUERIES = 32_768, 256
#: Rows a block of queries returns at most, and hits that are held before they are cut to the best.
BLOCK_OUT = 2_000_000
#: Terms that are counted at a time.
EMBED_TERMS = 1 << 18
#: Vectors and scores of one matrix product.
SLICE_ROWS, SLICE_SCORES = 2048, 1 << 19
#: Slack of a comparison before scores are rounded to six decimals.
ROUNDING = 2e-6


def hash_embed(df: DataFrame, text_col: str, out: str = "embedding", dim: int = 64) -> DataFrame:
    """Append the default embedding: feature hashing of the terms.

    Terms are hashed to buckets of one byte on the JVM. In slices of an Arrow batch the buckets, which stay in the
    batch's own memory, are counted and scaled to length 1. A text without terms gets zeros.
    """
    if not 0 < dim <= 32_768:
        raise ValueError("dim must be from 1 to 32768")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def count(buckets: pa.Array) -> pa.Array:
        flat, ends = buckets.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate(
            [[0], pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False)]))
        out = np.zeros((len(buckets), dim))
        first = 0
        while first < len(buckets):         # as many rows as hold EMBED_TERMS terms, one at least
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + EMBED_TERMS, "right")) - 1)
            rows = np.repeat(np.arange(last - first), np.diff(ends[first:last + 1]))
            out[first:last] = np.bincount(rows * dim + flat[ends[first]:ends[last]], minlength=(last - first) * dim).reshape(-1, dim)
            first = last
        norm = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
        np.divide(out, norm, out=out, where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype="int32") * dim, pa.int32()), pa.array(out.reshape(-1)))

    buckets = F.transform(
        tokens(F.col(text_col)),
        lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim).cast(
            "tinyint" if dim <= 128 else "smallint"),
    )
    return df.withColumn(out, count(buckets))


def embed_with(df: DataFrame, text_col: str, make_model: Callable[[], Callable], out: str = "embedding",
               batch: int = 32) -> DataFrame:
    """Append vectors from a user function ``list[str] -> array of vectors``.

    ``make_model`` runs once per task; the function sees ``batch`` texts a time.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            texts = frame[text_col].tolist()
            vectors = []
            for i in range(0, len(texts), batch):
                vectors.extend(np.asarray(model(texts[i : i + batch]), dtype="float64").tolist())
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def _unit(column: pd.Series) -> np.ndarray:
    m = np.vstack([np.asarray(v, dtype="float64") for v in column]) if len(column) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class Best:
    """The k best vectors of each query, among pieces of vectors that are added one after the other.

    Ranked by rounded score and id, as the global ranking is, so that the union of local results always holds the
    global result. ``low`` is a score that k vectors of the query are known to reach.
    """

    def __init__(self, q_ids, q_unit, v_ids, v_unit, k: int, skip_same: bool = False, floor: float | None = None, low=None):
        self.q_ids, self.q_unit, self.v_ids, self.v_unit = q_ids, q_unit, v_ids, v_unit
        self.k, self.skip_same, self.floor = k, skip_same, floor
        self.by_id = np.empty(len(v_ids), dtype="int64")
        self.by_id[np.argsort(v_ids, kind="stable")] = np.arange(len(v_ids))
        self.low = np.full(len(q_ids), -np.inf) if low is None else low
        self.held, self.n = [], 0

    def _kth(self, scores: np.ndarray, want: int) -> np.ndarray:
        """A score per row that ``want`` of its columns reach: the want-th highest of the maxima of groups of columns."""
        size = max(1, scores.shape[1] // (4 * want))
        n = scores.shape[1] // size
        best = scores[:, :n * size].reshape(len(scores), size, n).max(axis=1) if size > 1 else scores
        return np.partition(best, n - want, axis=1)[:, n - want]

    def add(self, rows: np.ndarray, start: int, stop: int):
        """Compare the queries ``rows`` with the vectors from start to stop, which stand in order of their ids."""
        want = self.k + self.skip_same
        for first in range(start, stop, SLICE_ROWS):
            vectors = self.v_unit[first:min(stop, first + SLICE_ROWS)].T
            step = max(1, SLICE_SCORES // vectors.shape[1])
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                scores = self.q_unit[part] @ vectors
                if scores.shape[1] >= want:
                    self.low[part] = np.maximum(self.low[part], self._kth(scores, want))
                hit = scores >= (self.low[part] - ROUNDING)[:, None]
                crowded = np.flatnonzero(hit.sum(axis=1) > 8 * want)        # mostly ties: the first of them by id do
                for r in crowded:
                    rounded = np.round(scores[r], 6)
                    kth = np.partition(rounded, len(rounded) - want)[len(rounded) - want]
                    above = np.flatnonzero(rounded > kth)
                    hit[r] = False
                    hit[r, above] = True
                    hit[r, np.flatnonzero(rounded == kth)[:want - len(above)]] = True
                row, column = np.nonzero(hit)
                self._hold(part[row], first + column, np.round(scores[row, column], 6))

    def _hold(self, row, place, score):
        keep = np.ones(len(row), dtype=bool)
        if self.skip_same:
            keep &= np.asarray(self.v_ids[place] != self.q_ids[row], dtype=bool)
        if self.floor is not None:
            keep &= score >= self.floor
        self.held.append((row[keep], place[keep], score[keep]))
        self.n += int(keep.sum())
        if self.n > 2 * max(BLOCK_OUT, self.k * len(self.q_ids)):
            self._cut()

    def _cut(self):
        row, place, score = (np.concatenate(x) for x in zip(*self.held)) if self.held else (
            np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        order = np.lexsort((self.by_id[place], -score, row))
        row, place, score = row[order], place[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last = nth == self.k - 1
        self.low[row[last]] = np.maximum(self.low[row[last]], score[last])
        keep = nth < self.k
        self.held, self.n = [(row[keep], place[keep], score[keep])], int(keep.sum())

    def frame(self) -> pd.DataFrame:
        self._cut()
        row, place, score = self.held[0]
        return pd.DataFrame({"query_id": self.q_ids[row], "vector_id": self.v_ids[place], "score": score})


NOTHING = {"query_id": [], "vector_id": [], "score": []}


def _pairs_schema(queries, vectors, query_id, vector_id) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType),
        T.StructField("vector_id", vectors.schema[vector_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def query_blocks(n, k: int, block: int, spark):
    """Into how many blocks n queries are cut: by rows, by the rows they return, and to give every core some."""
    most = max(1, min(block, BLOCK_OUT // k))
    return F.greatest(F.ceil(n / most), F.least(F.ceil(n / LEAST_QUERIES), F.lit(2 * spark.sparkContext.defaultParallelism)),
                      F.lit(1)).cast("int")


def _counts(df: DataFrame, cells: list[str], count: str, blocks) -> DataFrame:
    n = blocks(F.count(F.lit(1))).alias(count)
    return df.groupBy(*cells).agg(n) if cells else df.agg(n)


def _with_counts(df: DataFrame, counts: DataFrame, cells: list[str], count: str) -> DataFrame:
    return df.join(counts, cells) if cells else df.withColumn(count, counts.scalar())


def _blocked_search(queries, vectors, cells, schema, k, skip_same, floor, block) -> DataFrame:
    """Pair blocks of queries with blocks of vectors, cell by cell.

    Inputs have columns i, v and the cell columns (none: one cell for all). A
    cell of any size becomes a grid of blocks of about ``block`` rows; each task
    holds one pair of blocks and returns k rows per query.
    """
    by_rows = lambda n: F.ceil(n / block).cast("int")
    nq = _counts(queries, cells, "nq", by_rows if cells else lambda n: query_blocks(n, k, block, queries.sparkSession))
    nv = _counts(vectors, cells, "nv", by_rows)
    own = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))))

    def placed(df: DataFrame) -> DataFrame:
        return _with_counts(_with_counts(df, nq, cells, "nq"), nv, cells, "nv")

    qr = placed(queries).withColumn("qs", own("nq")).withColumn("vs", every("nv"))
    vr = placed(vectors).withColumn("vs", own("nv")).withColumn("qs", every("nq"))
    grid = [*cells, "qs", "vs"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(NOTHING)
        right = right.sort_values("i", kind="stable")
        best = Best(left["i"].to_numpy(), _unit(left["v"]), right["i"].to_numpy(), _unit(right["v"]), k, skip_same, floor)
        best.add(np.arange(len(left)), 0, len(right))
        return best.frame()

    return (
        qr.select("i", "v", *grid).groupBy(*grid).cogroup(vr.select("i", "v", *grid).groupBy(*grid))
        .applyInPandas(run, schema)
    )


def dense_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str, query_col: str, vector_id: str, vector_col: str,
    skip_same: bool = False, score_threshold: float | None = None,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine top-k per query: (query_id, vector_id, score, rank).

    Queries and vectors are cut into blocks by row counts and paired block by
    block; nothing passes through the driver, and the plan is the same at every size.
    """
    schema = _pairs_schema(queries, vectors, query_id, vector_id)
    found = _blocked_search(
        queries.select(F.col(query_id).alias("i"), F.col(query_col).alias("v")),
        vectors.select(F.col(vector_id).alias("i"), F.col(vector_col).alias("v")),
        [], schema, k, skip_same, score_threshold, block,
    )
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("vector_id")], k)


def approximate_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str, query_col: str, vector_id: str, vector_col: str,
    tables: int = 4, bucket_length: float = 0.5, seed: int = 7, skip_same: bool = False, block: int = BLOCK_ROWS,
) -> DataFrame:
    """Cosine top-k among vectors that share a random-projection bucket.

    Buckets come from the LSH transformer of Spark ML; a crowded bucket is cut
    into blocks like any other cell, so nothing is capped or dropped.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    schema = _pairs_schema(queries, vectors, query_id, vector_id)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    def unit(df, ident, col):
        return (
            df.select(F.col(ident).alias("i"), F.col(col).cast("array<double>").alias("v"))
            .withColumn("_n", norm)
            .filter(F.col("_n") > 0)
            .withColumn("f", array_to_vector(F.transform("v", lambda x: x / F.col("_n"))))
        )

    right = unit(vectors, vector_id, vector_col)
    model = BucketedRandomProjectionLSH(
        inputCol="f", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed
    ).fit(right)

    def celled(df):
        from pyspark.ml.functions import vector_to_array

        return (
            unfold(model.transform(df), ["i", "v"], "h", "_h", "table")
            .select("i", "v", "table", vector_to_array("_h")[0].cast("bigint").alias("bucket"))
        )

    found = _blocked_search(
        celled(unit(queries, query_id, query_col)), celled(right), ["table", "bucket"], schema, k, skip_same, None, block
    )
    once = found.groupBy("query_id", "vector_id").agg(F.max("score").alias("score"))
    return top_k(once, ["query_id"], [F.desc("score"), F.asc("vector_id")], k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours that the approximate search found."""
    hit = approximate.select("query_id", "vector_id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "vector_id"], "left").agg(
        F.count(F.lit(1)).alias("wanted"),
        F.count("_hit").alias("found"),
        F.round(F.count("_hit") / F.count(F.lit(1)), 4).alias("recall"),
    )

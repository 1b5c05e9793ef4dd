"""Exact top-k inner products by a three-phase uniform threshold."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wiretally.llm.common import saved

#: Score lists of a vector pair: the components are cut into this many parts.
PARTS = 4
PACKED = "block bigint, ids binary, vectors binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): components as floor(scale * x), x as double. Null vectors and vectors with null or
    non-finite components are left out; an empty vector stays and scores 0 with everything."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.filter(x.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Rows packed to blocks of at most ``size`` vectors; a shorter vector is filled with zeros."""
    def pack(batches):
        import pyspark

        ids, vectors, at = [], [], 0
        base = pyspark.TaskContext.get().partitionId() << 32

        def block():
            return pa.RecordBatch.from_arrays([
                pa.array([base + at], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                pa.array([np.concatenate(vectors).tobytes()], pa.binary())], ["block", "ids", "vectors"])

        held = 0
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            dense = np.zeros((len(column), width), np.int64)
            if width:
                dense[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            for start in range(0, len(column), size):
                part = slice(start, start + size)
                if held and held + len(dense[part]) > size:
                    yield block()
                    ids, vectors, held, at = [], [], 0, at + 1
                ids.append(batch.column(0).to_numpy()[part])
                vectors.append(dense[part])
                held += len(dense[part])
        if held:
            yield block()

    return rows.select("id", "v").mapInArrow(pack, PACKED)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles while sums stay below 2**53, else in 64-bit integers;
    an error where even those could not hold them."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("scores do not fit into 64 bits")
    return q @ c.T


def part_products(q: np.ndarray, c: np.ndarray, parts: int) -> list[np.ndarray]:
    return [products(q[:, cols], c[:, cols]) for cols in np.array_split(np.arange(q.shape[1]), parts)]


def unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), width)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
                scale: float = 256.0, block_rows: int = 2048, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Candidates and queries meet in blocks. A pair of blocks holds ``parts`` local
    score lists for each query, one for each part of the components.

    1. Every list gives its k best entries; their whole scores are read, and the
       k best of each query over all blocks set a cutoff that k candidates reach.
    2. The cutoffs go to all blocks of the query. A score of t or more needs a part
       of t / parts or more, so every list gives the entries that reach this.
    3. Whole scores are taken for those entries only; what reaches the cutoff is
       ranked. Nothing that belongs to the result can be missed.

    Ties go to the smaller id. The row's own id is no candidate; queries that are
    repeated as whole rows count once, repeated candidates each count. Fewer
    candidates than k give fewer rows, empty tables none.
    """
    spark = vectors.sparkSession
    candidates = saved(usable(vectors, id_col, vector_col, scale), "vectors")
    asked = saved(usable(queries, id_col, vector_col, scale).distinct(), "asked")
    width = max([df.agg(F.max(F.size("v"))).first()[0] or 0 for df in (candidates, asked)])
    right = saved(blocks(candidates, width, block_rows), "blocks")
    left = saved(blocks(asked, width, block_rows), "ask_blocks")
    n_left, n_right = left.count(), right.count()
    copies = max(1, -(-n_right // 64))
    named = left.select("block", (F.row_number().over(W.orderBy("block")) - 1).alias("n"))     # one number for each block of queries
    grid = (
        right.select("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_left - 1)))).alias("n"))
        .join(named.select("n", F.col("block").alias("ask")), "n")
        .withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int"))
    )

    def paired(asks: DataFrame) -> DataFrame:
        """One row for each pair of blocks. A block of queries is copied once for about 64 blocks of candidates,
        so that it is no hot key; the pairs then lie where their candidates are."""
        spread = asks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return grid.join(spread, ["ask", "copy"]).join(right, "block")

    asks = left.select(F.col("block").alias("ask"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def gather(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = unpack(row["q_ids"], row["q_vectors"], width)
                c_ids, c = unpack(row["ids"], row["vectors"], width)
                lists = part_products(q, c, parts)
                own = q_ids[:, None] == c_ids[None, :]
                total = sum(lists)
                low = np.iinfo(np.int64).min
                picked = np.zeros(own.shape, bool)
                best = min(k, len(c_ids))
                for scores in lists:
                    scores = np.where(own, low, scores)
                    np.put_along_axis(picked, np.argpartition(-scores.astype(float), best - 1, axis=1)[:, :best], True, axis=1)
                at, to = np.nonzero(picked & ~own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row["ask"])), pa.array(at.astype(np.int64)), pa.array(total[at, to])],
                    ["ask", "row", "score"])

    lists = paired(asks).select("ask", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(gather, "ask long, row long, score long")
    ordered = W.partitionBy("ask", "row").orderBy(F.desc("score"))
    cutoffs = (
        lists.withColumn("n", F.row_number().over(ordered)).filter(F.col("n") <= k)
        .groupBy("ask", "row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cutoff"))
        .groupBy("ask").agg(F.collect_list(F.struct("row", "cutoff")).alias("cutoffs"))   # at most block_rows entries
    )
    cut = asks.join(saved(cutoffs, "cutoffs"), "ask", "left")

    def collect(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = unpack(row["q_ids"], row["q_vectors"], width)
                c_ids, c = unpack(row["ids"], row["vectors"], width)
                cutoff = np.full(len(q_ids), np.iinfo(np.int64).min)
                for x in row["cutoffs"] or ():
                    if x["cutoff"] is not None:
                        cutoff[x["row"]] = x["cutoff"]
                share = np.where(cutoff > np.iinfo(np.int64).min, -(-cutoff // parts), cutoff)
                reach = np.zeros((len(q_ids), len(c_ids)), bool)
                for scores in part_products(q, c, parts):
                    reach |= scores >= share[:, None]
                at, to = np.nonzero(reach & (q_ids[:, None] != c_ids[None, :]))
                score = np.einsum("ij,ij->i", q[at], c[to])
                keep = score >= cutoff[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(keep.sum(), row["ask"])), pa.array(at[keep].astype(np.int64)),
                     pa.array(q_ids[at[keep]]), pa.array(c_ids[to[keep]]), pa.array(score[keep])],
                    ["ask", "row", "query_id", "vec_id", "score"])

    found = paired(cut).select("ask", "q_ids", "q_vectors", "cutoffs", "ids", "vectors").mapInArrow(
        collect, "ask long, row long, query_id long, vec_id long, score long")
    final = W.partitionBy("ask", "row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def embedding_neighbours(embeddings: DataFrame) -> DataFrame:
    """Top 5 of every vector whose id is divisible by 50, against all vectors."""
    return exact_top_k(embeddings, embeddings.filter(F.col("vec_id") % 50 == 0), 5)

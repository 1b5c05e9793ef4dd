"""Term postings, corpus statistics and BM25 top-k for batches of queries."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from wiretally.functions.packing import packed, unpacked
from wiretally.functions.ranking import top_k
from wiretally.functions.rows import unfold
from wiretally.functions.text import term_counts, tokens
from wiretally.session import written

#: Postings and queries of one block, and (query, chunk) sums that a task holds at a time; they bound its memory.
BLOCK_TERMS, BLOCK_QUERIES, CELLS = 1_000_000, 1024, 4_000_000
#: Packs of rows that make a block of postings.
PACKS = 16


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    use_idf: bool = True
    #: Leave out terms that occur in more than this share of the corpus (1.0 keeps all).
    max_term_share: float = 1.0


def postings(corpus: DataFrame, id_col: str, text_col: str, keep=()) -> DataFrame:
    """One row per (chunk, term) with its frequency and the chunk length.

    Counting happens in the row that holds the text, so no shuffle is needed.
    """
    counted = corpus.select(id_col, *keep, term_counts(tokens(F.col(text_col))).alias("_tc"))
    length = F.aggregate("_tc", F.lit(0).cast("bigint"), lambda n, t: n + t["tf"])
    return (
        unfold(counted.select(id_col, *keep, F.struct("_tc", length.alias("n")).alias("_c")),
               [id_col, *keep, F.col("_c.n").alias("chunk_len")], F.col("_c._tc"), "_t")
        .select(id_col, *keep, "chunk_len", F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"))
    )


def corpus_totals(corpus: DataFrame, text_col: str) -> DataFrame:
    """One row: number of chunks and their mean length in tokens."""
    n = F.size(tokens(F.col(text_col))).cast("bigint")
    return corpus.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(n).alias("mean_len"))


def idf(df_col, n_col):
    return F.log1p((n_col - df_col + 0.5) / (df_col + 0.5))


def term_statistics(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Document frequency and inverse document frequency of every term."""
    n = corpus_totals(corpus, text_col).select("n_chunks").scalar()
    return (
        postings(corpus, id_col, text_col)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .select("term", "df", F.round(idf(F.col("df"), n), 6).alias("idf"))
    )


def query_terms(queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    return unfold(queries, [query_id], F.array_distinct(tokens(F.col(text_col))), "term")


def sparse_scores(
    corpus: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str,
    keep=(), settings: Bm25 = Bm25(), statistics_corpus: DataFrame | None = None,
) -> DataFrame:
    """BM25 score of every chunk that shares a term with a query.

    The planner decides from measured sizes how the query terms meet the postings:
    few enough go to every task, otherwise both sides are shuffled by term and the
    runtime splits the partitions of frequent terms. ``statistics_corpus`` fixes document frequencies when
    ``corpus`` is a filtered part of a larger collection.
    """
    base = corpus if statistics_corpus is None else statistics_corpus
    totals = corpus_totals(base, text_col)
    n, mean_len = totals.select("n_chunks").scalar(), totals.select("mean_len").scalar()
    asked = query_terms(queries, query_id, query_text)
    frequency = (
        postings(base, id_col, text_col)
        .join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    if settings.max_term_share < 1.0:
        frequency = frequency.filter(F.col("df") <= n * settings.max_term_share)
    weight = idf(F.col("df"), n) if settings.use_idf else F.lit(1.0)
    weighted = asked.join(frequency, "term").select(query_id, "term", weight.alias("_w"))
    saturated = F.col("tf") * (settings.k1 + 1) / (
        F.col("tf") + settings.k1 * (1 - settings.b + settings.b * F.col("chunk_len") / mean_len)
    )
    return (
        postings(corpus, id_col, text_col, keep)
        .join(weighted, "term")
        .groupBy(query_id, id_col, *keep)
        .agg(F.round(F.sum(F.col("_w") * saturated), 6).alias("score"))
    )


def stored_terms(corpus: DataFrame, id_col: str, text_col: str, group: str | None = None) -> DataFrame:
    """i, g, n (tokens; null without a text), tc (term, tf): written, so that texts are tokenised once."""
    counted = corpus.select(
        F.col(id_col).alias("i"), (F.col(group) if group else F.lit("")).cast("string").alias("g"),
        F.col(text_col).isNotNull().alias("_held"), term_counts(tokens(F.col(text_col))).alias("tc"))
    length = F.aggregate("tc", F.lit(0).cast("bigint"), lambda n, t: n + t["tf"])
    return written(counted.select("i", "g", F.when(F.col("_held"), length).alias("n"), "tc"), "terms")


def _best_of_block(asked: pa.Table, chunks: pa.Table, k: int, names: list[str], types: list[pa.DataType]) -> pa.Table:
    """The k best chunks of each query and group among those of one block.

    Ranked by rounded score and id, as the global ranking is, so that the union of the blocks holds the global result.
    """
    size, out = chunks.num_rows, ([], [], [])
    one = lambda table, c: table[c].combine_chunks()
    if size and asked.num_rows:
        ids, groups = one(chunks, "i"), one(chunks, "g").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        by_id = np.empty(size, dtype="int64")
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(size)
        order = np.lexsort((by_id, groups))             # places: by group, then by id
        place = np.empty(size, dtype="int64")
        place[order] = np.arange(size)
        edges = np.flatnonzero(np.diff(groups[order], prepend=-1, append=-1))
        wanted = one(asked, "terms").flatten()
        vocabulary = pc.unique(wanted)
        term = pc.fill_null(pc.index_in(one(chunks, "terms").flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
        at = np.repeat(place, pc.list_value_length(one(chunks, "terms")).to_numpy(zero_copy_only=False))[term >= 0]
        part = one(chunks, "parts").flatten().to_numpy(zero_copy_only=False)[term >= 0]
        term = term[term >= 0]
        by_term = np.argsort(term, kind="stable")
        at, part, starts = at[by_term], part[by_term], np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1))
        codes = pc.index_in(wanted, vocabulary).to_numpy(zero_copy_only=False)
        weights = one(asked, "weights").flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(one(asked, "terms")).to_numpy(zero_copy_only=False))])
        step = max(1, CELLS // size)
        for first in range(0, asked.num_rows, step):
            sums = np.zeros((min(step, asked.num_rows - first), size))
            for r in range(len(sums)):
                for j in range(ends[first + r], ends[first + r + 1]):
                    own = slice(starts[codes[j]], starts[codes[j] + 1])
                    sums[r][at[own]] += weights[j] * part[own]
            rounded = np.round(sums, 6)
            for low, high in zip(edges[:-1], edges[1:]):
                cut = max(0, high - low - k)
                least = np.partition(rounded[:, low:high], cut, axis=1)[:, cut]
                for r in range(len(sums)):
                    found = low + np.flatnonzero((rounded[r, low:high] >= least[r]) & (sums[r, low:high] > 0))
                    found = found[np.argsort(-rounded[r][found], kind="stable")][:k]
                    out[0].append(np.full(len(found), first + r))
                    out[1].append(order[found])
                    out[2].append(rounded[r][found])
    if not out[0]:
        return pa.table([pa.array([], t) for t in types], names=names)
    query, chunk, score = (np.concatenate(x) for x in out)
    return pa.table([one(asked, "q").take(pa.array(query)), one(chunks, "g").take(pa.array(chunk)),
                     one(chunks, "i").take(pa.array(chunk)), pa.array(score)], names=names)


def sparse_best(
    corpus: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, query_id: str, query_text: str,
    group: str | None = None, settings: Bm25 = Bm25(), statistics_corpus: DataFrame | None = None,
) -> DataFrame:
    """BM25 scores (query, [group,] id, score) that hold the k best chunks of each query, or of each query and group.

    Chunks and queries are cut into blocks by their number of postings and rows, and paired block by block; chunks go to their
    blocks as packs of compressed rows. A task adds up
    the scores of one pair of blocks and returns k rows a query and group, so no row per (query, chunk) is ever shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    held = stored_terms(corpus, id_col, text_col, group)
    base = held if statistics_corpus is None else stored_terms(statistics_corpus, id_col, text_col)
    n, mean = base.agg(F.count(F.lit(1)), F.avg("n")).first()
    n_posts = held.agg(F.sum(F.size("tc"))).first()[0] or 0
    n_chunk_blocks, n_query_blocks = (max(1, -(-x // y)) for x, y in ((n_posts, BLOCK_TERMS), (queries.count(), BLOCK_QUERIES)))
    asked = query_terms(queries, query_id, query_text)
    frequency = (
        unfold(base, [], F.col("tc.term"), "term").join(asked.select("term").distinct(), "term", "left_semi")
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    if settings.max_term_share < 1.0:
        frequency = frequency.filter(F.col("df") <= n * settings.max_term_share)
    weight = idf(F.col("df"), F.lit(n)) if settings.use_idf else F.lit(1.0)
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    weighted = (
        asked.join(frequency, "term").groupBy(F.col(query_id).alias("q"))
        .agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("w")))).alias("t"))
        .select("q", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"),
                block("q", n_query_blocks).alias("qs"), every(n_chunk_blocks).alias("vs"))
    )
    id_type, query_type = corpus.schema[id_col].dataType, queries.schema[query_id].dataType
    rows = pa.schema([("i", to_arrow_type(id_type)), ("g", pa.string()), ("n", pa.int64()),
                      ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
    most = max(1, BLOCK_TERMS // PACKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole packs of rows go to a block, so that a pack is no smaller where there are many blocks."""
        sent = 7919 * TaskContext.get().partitionId()
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
                yield pa.record_batch([pa.array([sent % n_chunk_blocks], pa.int32()), pa.array(
                    [packed(pa.table(batch.slice(first, last - first)))], pa.binary())], names=["vs", "data"])
                first, sent = last, sent + 1

    def scored(data: pa.Table) -> pa.Table:
        chunks = pa.concat_tables([unpacked(x.as_buffer(), rows) for x in data["data"]] or [rows.empty_table()]).combine_chunks()
        tf, n = (chunks[c].combine_chunks() for c in ("tfs", "n"))
        size = pc.list_value_length(tf).to_numpy(zero_copy_only=False)
        norm = settings.k1 * (1 - settings.b + settings.b * n.to_numpy(zero_copy_only=False) / float(mean or 1))
        tfs = tf.flatten().to_numpy(zero_copy_only=False)
        part = tfs * (settings.k1 + 1) / (tfs + np.repeat(norm, size))
        ends = np.concatenate([[0], np.cumsum(size)]).astype("int32")
        return chunks.append_column("parts", pa.ListArray.from_arrays(pa.array(ends), pa.array(part)))

    chunks = held.filter(F.size("tc") > 0).select(
        "i", "g", "n", F.col("tc.term").alias("terms"), F.col("tc.tf").alias("tfs")).mapInArrow(
        pack, "vs int, data binary").withColumn("qs", every(n_query_blocks))
    names = [query_id, group or "_group", id_col, "score"]
    kinds = [query_type, T.StringType(), id_type, T.DoubleType()]
    schema, arrow = T.StructType([T.StructField(c, t) for c, t in zip(names, kinds)]), [to_arrow_type(t) for t in kinds]
    grid = ["qs", "vs"]
    # as many partitions as pairs of blocks ask for, so that what a task sorts does not grow with their number
    parts = 2 * n_chunk_blocks * n_query_blocks
    found = weighted.repartition(parts, *grid).groupBy(*grid).cogroup(chunks.repartition(parts, *grid).groupBy(*grid)).applyInArrow(
        lambda left, right: _best_of_block(left, scored(right), k, names, arrow), schema)
    return found if group else found.drop("_group")


def sparse_top_k(corpus, queries, k, id_col, text_col, query_id, query_text, settings: Bm25 = Bm25(),
                 statistics_corpus=None) -> DataFrame:
    best = sparse_best(corpus, queries, k, id_col, text_col, query_id, query_text, None, settings, statistics_corpus)
    return top_k(best, [query_id], [F.desc("score"), F.asc(id_col)], k)

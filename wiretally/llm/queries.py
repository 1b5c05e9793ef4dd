"""Registered queries of the training-data operators, each over its whole table with production parameters."""
from __future__ import annotations

from wiretally.llm import (
    alignment, decontamination, extraction, language, packing, pieces, quality, sharding, simhash, substrings, topk, toxicity, turns,
)
from wiretally.llm.common import table


def op1_sharding(spark, sf_dir):
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op4_substrings(spark, sf_dir):
    return substrings.document_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_extraction(spark, sf_dir):
    return extraction.page_texts(table(spark, sf_dir, "pages"))


def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_top_k(spark, sf_dir):
    return topk.embedding_neighbours(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark, sf_dir):
    return language.document_languages(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return alignment.aligned_documents(table(spark, sf_dir, "documents"))


def op12_pieces(spark, sf_dir):
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


def op13_turns(spark, sf_dir):
    return turns.conversation_reports(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_substrings": op4_substrings,
    "op5_quality": op5_quality,
    "op6_extraction": op6_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_top_k": op8_top_k,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_pieces": op12_pieces,
    "op13_turns": op13_turns,
}
ORACLES: dict[str, str] = {
    "op8_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5""",
}

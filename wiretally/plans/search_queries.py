"""Registered queries over the index: sparse, dense and hybrid retrieval, lookups, contexts."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import fixed as K
from wiretally.functions.rows import unfold
from wiretally.operators import cells as CE, chunking as CH, context as CX, dense as DE, fusion as FU, lookup as LK
from wiretally.operators import planning as PL, prepare as PR, sparse as SP, telemetry as TM
from wiretally.plans import recipes as R
from wiretally.plans.chunk_queries import chunks
from wiretally.plans.chunk_sql import CHUNKS, ENRICHED, SPACE, heading_sql, type_sql
from wiretally.plans.plan_queries import SCHEMA_SQL, TYPES_SQL, plan_ctes
from wiretally.plans.telemetry_queries import SUMMARY, data as captured
from wiretally.session import distilled, scratch_path, sent, written

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


WORD = r"'[\p{L}\p{N}]+'"


def bm25_sql(corpus, ident, text, queries, query_id, query_text, whole=None):
    """score CTE: BM25 of every (query, chunk) that share a term."""
    base = whole or corpus
    return f"""
tok AS (SELECT {ident}, unnest(regexp_extract_all(lower({text}), {WORD})) AS term FROM {corpus}),
post AS (SELECT {ident}, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT {ident}, len(regexp_extract_all(lower({text}), {WORD})) AS dl FROM {corpus}),
tot AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower({text}), {WORD}))) AS al FROM {base}),
dfreq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT {ident}, unnest(regexp_extract_all(lower({text}), {WORD}))
  AS term FROM {base}) GROUP BY term),
qt AS (SELECT DISTINCT {query_id}, unnest(regexp_extract_all(lower({query_text}), {WORD})) AS term FROM {queries}),
score AS (SELECT {query_id}, {ident}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score
  FROM qt JOIN post USING (term) JOIN dfreq USING (term) JOIN len USING ({ident}) CROSS JOIN tot GROUP BY ALL)"""


DOC_BM25 = bm25_sql("documents", "doc_id", "text", "benchmark", "item_id", "text")


def ranked_sql(source, key, ident, k, extra=""):
    return (f"SELECT {key}, {ident}, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {ident}) AS rank "
            f"FROM {source} QUALIFY rank <= {k}")


@register("postings", "WITH " + DOC_BM25 + " SELECT doc_id, term, tf, dl AS chunk_len FROM post JOIN len USING (doc_id)")
def postings(spark, d):
    return SP.postings(R.table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", "tf", "chunk_len")


@register("term_statistics", "WITH " + DOC_BM25 + """
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfreq CROSS JOIN tot""")
def term_statistics(spark, d):
    return SP.term_statistics(R.table(spark, d, "documents"), "doc_id", "text")


@register("corpus_totals", "WITH " + DOC_BM25 + " SELECT n AS n_chunks, round(al, 6) AS mean_len FROM tot")
def corpus_totals(spark, d):
    return SP.corpus_totals(R.table(spark, d, "documents"), "text").select(
        "n_chunks", F.round("mean_len", 6).alias("mean_len"))


def doc_sparse(spark, d, k):
    return SP.sparse_top_k(
        R.table(spark, d, "documents"), R.table(spark, d, "benchmark").withColumnRenamed("text", "query"), k,
        "doc_id", "text", "item_id", "query")


@register("sparse_top_k", "WITH " + DOC_BM25 + "\n" + ranked_sql("score", "item_id", "doc_id", 5))
def sparse_top_k(spark, d):
    return doc_sparse(spark, d, 5)


@register("sparse_top_k_filtered", "WITH part AS (SELECT * FROM documents WHERE lang IN ('en', 'fr')), "
          + bm25_sql("part", "doc_id", "text", "benchmark", "item_id", "text", whole="documents")
          + "\n" + ranked_sql("score", "item_id", "doc_id", 5))
def sparse_top_k_filtered(spark, d):
    docs = R.table(spark, d, "documents")
    return SP.sparse_top_k(
        docs.filter(F.col("lang").isin("en", "fr")), R.table(spark, d, "benchmark").withColumnRenamed("text", "query"),
        5, "doc_id", "text", "item_id", "query", statistics_corpus=docs)


COSINE = """
vec AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings),
score AS (SELECT a.vec_id AS query_id, b.vec_id AS vector_id, b.label,
  round(array_inner_product(a.v, b.v) / sqrt(array_inner_product(a.v, a.v) * array_inner_product(b.v, b.v)), 6) AS score
  FROM vec a CROSS JOIN vec b)"""


def vectors(spark, d):
    return R.table(spark, d, "embeddings")


@register("dense_top_k", "WITH " + COSINE + "\n" + ranked_sql("score", "query_id", "vector_id", 5))
def dense_top_k(spark, d):
    v = vectors(spark, d)
    return DE.dense_top_k(v, v, 5, "vec_id", "embedding", "vec_id", "embedding")


@register("dense_top_k_filtered", "WITH " + COSINE + """
SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
FROM score WHERE label IN (0, 1, 2) AND score >= 0.3 QUALIFY rank <= 5""")
def dense_top_k_filtered(spark, d):
    v = vectors(spark, d)
    return DE.dense_top_k(v, v.filter(F.col("label").isin(0, 1, 2)), 5, "vec_id", "embedding", "vec_id", "embedding",
                          score_threshold=0.3)


@register("similar_to_existing", "WITH " + COSINE + """
SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
FROM score WHERE query_id <> vector_id QUALIFY rank <= 10""")
def similar_to_existing(spark, d):
    """Every stored vector asks for its neighbours: the blocked path."""
    v = vectors(spark, d)
    return DE.dense_top_k(v, v, 10, "vec_id", "embedding", "vec_id", "embedding", skip_same=True)


# Cells around seeded centres, ranked for every vector; the number of probed cells finds 92 % of the sample's neighbours.
CELLS = "WITH " + COSINE + f""",
seed AS (SELECT vec_id AS cell FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id
  LIMIT (SELECT ceil(sqrt(count(*)))::BIGINT FROM embeddings)),
near AS (SELECT query_id, vector_id AS cell, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS place
  FROM score WHERE vector_id IN (SELECT cell FROM seed)),
home AS (SELECT query_id AS vector_id, cell FROM near WHERE place = 1),
truth AS ({ranked_sql('score', 'query_id', 'vector_id', 5)}),
sample AS (SELECT vec_id AS query_id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 1000),
probes AS (SELECT quantile_disc(place, 0.92) AS n FROM truth JOIN sample USING (query_id) JOIN home USING (vector_id)
  JOIN near USING (query_id, cell)),
probed AS (SELECT score.* FROM score JOIN home USING (vector_id) JOIN near USING (query_id, cell)
  WHERE place <= (SELECT n FROM probes)),
approx AS ({ranked_sql('probed', 'query_id', 'vector_id', 5)})"""


def vector_cells(spark, d):
    return CE.write_cells(vectors(spark, d), scratch_path(spark, "cells"), "vec_id", "embedding")


@register("pruned_similar", "WITH " + COSINE + """
SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
FROM score WHERE query_id <> vector_id QUALIFY rank <= 10""")
def pruned_similar(spark, d):
    """The neighbours of every stored vector, exact, over stored cells."""
    return CE.exact_top_k(vectors(spark, d), vector_cells(spark, d), 10, "vec_id", "embedding", skip_same=True)


@register("approximate_top_k", CELLS + " SELECT query_id, vector_id, score, rank FROM approx")
def approximate_top_k(spark, d):
    return CE.approximate_top_k(vectors(spark, d), vector_cells(spark, d), 5, "vec_id", "embedding")


@register("approximate_recall", CELLS + """
SELECT count(*) AS wanted, count(approx.rank) AS found, round(count(approx.rank) / count(*), 4) AS recall
FROM truth LEFT JOIN approx USING (query_id, vector_id)""")
def approximate_recall(spark, d):
    return DE.recall(approximate_top_k(spark, d), dense_top_k(spark, d))


def hash_sql(relation, ident, text, name):
    return f"""
{name}_t AS (SELECT {ident}, unnest(regexp_extract_all(lower({text}), {WORD})) AS term FROM {relation}),
{name}_b AS (SELECT {ident}, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS x
  FROM {name}_t GROUP BY ALL),
{name}_v AS (SELECT {ident}, b, x / sqrt(sum(x * x) OVER (PARTITION BY {ident})) AS x FROM {name}_b)"""


DENSE_DOCS = hash_sql("documents", "doc_id", "text", "dv") + "," + hash_sql("benchmark", "item_id", "text", "qv") + """,
cosine AS (SELECT item_id, doc_id, round(coalesce(sum(q.x * v.x), 0.0), 6) AS score
  FROM (SELECT item_id, doc_id FROM benchmark CROSS JOIN documents) LEFT JOIN qv_v q USING (item_id)
  LEFT JOIN dv_v v USING (doc_id, b) GROUP BY ALL)"""


@register("batch_embedding", "WITH " + hash_sql("documents", "doc_id", "text", "dv") + """
SELECT doc_id, pos, coalesce(round(x, 6), 0.0) AS x FROM documents CROSS JOIN range(64) r(pos)
LEFT JOIN (SELECT doc_id, b AS pos, x FROM dv_v) USING (doc_id, pos)""")
def batch_embedding(spark, d):
    return unfold(DE.hash_embed(R.table(spark, d, "documents"), "text"), ["doc_id"], "embedding", "x", "pos").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def doc_dense(spark, d, k):
    docs = DE.hash_embed(R.table(spark, d, "documents"), "text").select("doc_id", "embedding")
    asked = DE.hash_embed(R.table(spark, d, "benchmark"), "text").select("item_id", "embedding")
    return DE.dense_top_k(asked, docs, k, "item_id", "embedding", "doc_id", "embedding").select(
        F.col("query_id").alias("item_id"), F.col("vector_id").alias("doc_id"), "score", "rank")


def fusion_sql(depth, dense, sparse):
    return "WITH " + DOC_BM25 + "," + DENSE_DOCS + f""",
dl AS ({ranked_sql('cosine', 'item_id', 'doc_id', depth)}), sl AS ({ranked_sql('score', 'item_id', 'doc_id', depth)}),
fused AS (SELECT item_id, doc_id, round(coalesce({dense} / (60 + dl.rank), 0) + coalesce({sparse} / (60 + sl.rank), 0), 6)
  AS score FROM dl FULL OUTER JOIN sl USING (item_id, doc_id))
""" + ranked_sql("fused", "item_id", "doc_id", 5)


@register("hybrid_search", fusion_sql(10, "0.7::DOUBLE", "0.3::DOUBLE"))
def hybrid_search(spark, d):
    return FU.hybrid(doc_dense(spark, d, 10), doc_sparse(spark, d, 10), 5, "item_id", "doc_id")


@register("hybrid_search_unweighted", fusion_sql(15, "1.0::DOUBLE", "1.0::DOUBLE"))
def hybrid_search_unweighted(spark, d):
    return FU.hybrid_unweighted(doc_dense(spark, d, 15), doc_sparse(spark, d, 15), 5, "item_id", "doc_id")


# --- passages: typed, titled blocks with captions as a searchable collection


def passages(spark, d):
    # captions meet the images only; stored: what the first half has stored and shuffled goes before the second is shuffled
    typed = distilled(spark, lambda: PR.order_blocks(PR.prepare_blocks(R.blocks(spark, d), R.captions(spark, d))).select(
        "source_file", F.col("page_number").cast("bigint").alias("page_number"),
        F.col("block_index").alias("chunk_index"), "content",
        CH.semantic_type(F.col("block_type"), F.col("content")).alias("chunk_type")), "typed")
    return CH.add_context(typed).drop("overlap_prev", "overlap_next").withColumn(
        "chunk_id", F.concat_ws(":", "source_file", F.col("chunk_index").cast("string")))


def stored_passages(spark, d):
    return distilled(spark, lambda: passages(spark, d), "passages")


PASSAGES = "WITH RECURSIVE " + ENRICHED + f""",
marked AS (SELECT source_file, page_number, block_index AS chunk_index, content, {type_sql('block_type', 'content')}
    AS chunk_type, CASE WHEN {heading_sql('content')} AND length(content) < 150
    THEN trim(string_split(content, chr(10))[1], {SPACE}) END AS mark FROM enriched),
passages AS (SELECT * EXCLUDE (mark), source_file || ':' || chunk_index AS chunk_id,
  coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY chunk_index
    ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), '') AS section_title FROM marked)"""
MODAL = "CASE chunk_type WHEN 'image_desc' THEN 'image' WHEN 'table' THEN 'table' ELSE 'text' END"


def passage_hits(spark, d, asked, query_id, query_text):
    """The hits of each query that can be within the quota of their modality."""
    base = passages(spark, d).withColumn("modality", FU.modality(F.col("chunk_type")))
    return SP.sparse_best(base, asked, FU.LARGEST_QUOTA, "chunk_id", "content", query_id, query_text, group="modality")


@register("payload_filter", PASSAGES + """
SELECT chunk_id, chunk_type, page_number, section_title FROM passages
WHERE chunk_type IN ('text', 'table') AND page_number BETWEEN 2 AND 6 AND source_file = 'doc_7.pdf'
UNION ALL SELECT chunk_id, chunk_type, page_number, section_title FROM passages
WHERE chunk_type IN ('code_cli', 'text') AND section_title LIKE 'Step 7 Zone 16% planning' AND page_number >= 3""")
def payload_filter(spark, d):
    base = passages(spark, d)
    columns = ("chunk_id", "chunk_type", "page_number", "section_title")
    one = base.filter(FU.payload_filter(("text", "table"), "doc_7.pdf", (2, 6))).select(*columns)
    two = base.filter(FU.payload_filter(("code_cli", "text"), pages=(3, None))
                      & F.col("section_title").like("Step 7 Zone 16% planning")).select(*columns)
    return one.unionByName(two)


@register("quota_search", PASSAGES + "," + bm25_sql("passages", "chunk_id", "content", "benchmark", "item_id", "text") + f"""
SELECT item_id, chunk_id, {MODAL} AS modality, score,
  row_number() OVER (PARTITION BY item_id, {MODAL} ORDER BY score DESC, chunk_id) AS rank
FROM score JOIN passages USING (chunk_id)
QUALIFY rank <= CASE {MODAL} WHEN 'image' THEN 3 WHEN 'table' THEN 2 ELSE 5 END""")
def quota_search(spark, d):
    asked = R.table(spark, d, "benchmark").withColumnRenamed("text", "query")
    return FU.quota_top(passage_hits(spark, d, asked, "item_id", "query"), "item_id", "chunk_id").select(
        "item_id", "chunk_id", "modality", "score", "rank")


# --- fan-out: all variants of a question


def retrieval_plans(spark, d):
    return written(PL.plan_questions(R.retrieval_questions(spark, d), R.registry(spark, d)), "plans")


def fan_out(spark, d, plans, base):
    """Each distinct variant text is scored once; each plan searches in its own chunk types."""
    variants = written(FU.scoped_variants(
        PL.query_variants(plans.withColumn("scope", FU.search_scope()), keep=("scope",))), "variants")
    texts = variants.select("text_id", "variant_text").distinct()
    scores = distilled(spark, lambda: SP.sparse_best(
        base, texts, FU.LARGEST_QUOTA, "chunk_id", "content", "text_id", "variant_text", group="chunk_type"), "best")
    return FU.fan_out(variants, FU.scoped_hits(scores, variants, "chunk_id"), "question_id", "chunk_id", by="search_id")


def fanout_sql(asked, registry):
    return PASSAGES + "," + plan_ctes(asked, registry).removeprefix("WITH ").replace("enriched AS", "enriched_q AS") \
        .replace("FROM enriched\n", "FROM enriched_q\n") + f""",
types(intent, kinds) AS (SELECT * FROM {TYPES_SQL}),
scp AS (SELECT question_id, array_to_string(list_sort(list_distinct(string_split(
  kinds || CASE WHEN {SCHEMA_SQL} THEN ',image_desc' ELSE '' END, ','))), ',') AS scope FROM plan JOIN types USING (intent)),
sv AS (SELECT *, md5(variant_text) AS text_id, md5(variant_text || chr(10) || scope) AS search_id
  FROM variants JOIN scp USING (question_id)),
vtext AS (SELECT DISTINCT text_id, variant_text FROM sv),""" + bm25_sql(
        "passages", "chunk_id", "content", "vtext", "text_id", "variant_text") + f""",
hit AS (SELECT search_id, chunk_id, {MODAL} AS modality, score
  FROM score JOIN (SELECT DISTINCT text_id, search_id, scope FROM sv) USING (text_id) JOIN passages USING (chunk_id)
  WHERE list_contains(string_split(scope, ','), chunk_type)
  QUALIFY row_number() OVER (PARTITION BY search_id, {MODAL} ORDER BY score DESC, chunk_id)
    <= CASE {MODAL} WHEN 'image' THEN 3 WHEN 'table' THEN 2 ELSE 5 END),
firsts AS (SELECT question_id, chunk_id, modality, ordinal, score FROM sv JOIN hit USING (search_id)
  QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY ordinal) = 1),
results AS (SELECT *, row_number() OVER (PARTITION BY question_id, modality ORDER BY score DESC, chunk_id) AS rank
  FROM firsts QUALIFY rank <= CASE modality WHEN 'image' THEN 3 WHEN 'table' THEN 2 ELSE 8 END)"""


FANOUT = fanout_sql(R.RETRIEVAL_QUESTIONS, R.REGISTRY)
FIELD_FANOUT = fanout_sql(R.FIELD_QUESTIONS, R.CAPTURE_REGISTRY)


@register("multi_query_fan_out", FANOUT + " SELECT question_id, chunk_id, modality, ordinal, score, rank FROM results")
def multi_query_fan_out(spark, d):
    return fan_out(spark, d, retrieval_plans(spark, d), stored_passages(spark, d))


def results(spark, d, plans, base):
    body = base.select("chunk_id", "content", "chunk_type", "page_number", "section_title", "source_file")
    return body.join(sent(written(fan_out(spark, d, plans, base), "hits")), "chunk_id")


SHOWN = """,
shown AS (SELECT r.*, content, chunk_type, page_number, section_title, source_file FROM results r
  JOIN passages USING (chunk_id)),
entry AS (SELECT question_id, modality, rank, CASE WHEN rank = 1 THEN CASE modality
      WHEN 'text' THEN '=== TEXTE & COMMANDES CLI ===' WHEN 'image' THEN chr(10) || '=== SCHÉMAS & TOPOLOGIES ==='
      ELSE chr(10) || '=== TABLEAUX ===' END || chr(10) ELSE '' END
    || CASE modality WHEN 'text' THEN '[Source ' WHEN 'image' THEN '[Schéma ' ELSE '[Table ' END || rank || '] p.'
    || page_number || CASE WHEN modality = 'text' THEN ' | ' || chunk_type ELSE '' END || ' | score='
    || printf('%.2f', score) || CASE WHEN modality = 'text' THEN ' | '
      || CASE WHEN section_title = '' THEN 'N/A' ELSE section_title END ELSE '' END
    || chr(10) || content || chr(10) || '---' AS t FROM shown),
ctx AS (SELECT question_id, string_agg(t, chr(10) ORDER BY CASE modality WHEN 'text' THEN 0 WHEN 'image' THEN 1 ELSE 2
  END, rank) AS context FROM entry GROUP BY question_id)"""


def field_plans(spark, d):
    """Plans of the questions about captured devices, written once: every part of an answer follows them."""
    plans = PL.plan_questions(R.field_questions(spark, d), R.capture_registry(spark, d))
    return written(PL.referenced_document(plans, R.manifest(spark, d)), "plans")


def field_devices(plans):
    """(question_id, device_name, protos): the registered devices a question names."""
    return unfold(plans, ["question_id", "protos"], F.col("known"), "device_name")


def full_context(spark, d, plans, base):
    """Search results, overviews of the named devices and the referenced manual of every question, as rows."""
    search = CX.retrieval_context(results(spark, d, plans, base), "question_id")
    asked = field_devices(plans)
    # written: a filter on the text would be pushed below it and parse the session again
    overview = written(TM.summary_lines(captured(spark, d, asked)).select(
        "device_name", F.array_join("summary", "\n").alias("summary")), "overview")
    named = plans.select("question_id", F.col("referenced_file").alias("source_file")).filter("source_file IS NOT NULL")
    manuals = LK.manual_text(base.join(named.select("source_file").distinct(), "source_file", "left_semi"))
    return CX.context_rows(search, asked.join(overview, "device_name"), named.join(manuals, "source_file"))


FIELD_CONTEXT = """,
fdev AS (SELECT question_id, device AS device_name FROM known),
fsum AS (SELECT * FROM (""" + SUMMARY + """ SELECT device_name, summary FROM summary)),
fman AS (SELECT question_id, regexp_extract(question, '(doc_[0-9]+\\.pdf)', 1) AS source_file FROM asked),
qparts AS (
  SELECT question_id, 0 AS part, '' AS name, 0::BIGINT AS ord, context AS text FROM ctx
  UNION ALL SELECT question_id, 1, device_name, 0, summary FROM fdev JOIN fsum USING (device_name)
  UNION ALL SELECT question_id, 2, source_file, chunk_index // 256, string_agg(content, chr(10) ORDER BY chunk_index)
    FROM fman JOIN passages USING (source_file) WHERE content <> '' GROUP BY ALL)"""


@register("context_assembly", FIELD_FANOUT + SHOWN + FIELD_CONTEXT + """,
joined AS (SELECT question_id, part, left(CASE part WHEN 1 THEN string_agg(text, chr(10) || chr(10) ORDER BY name, ord)
    ELSE string_agg(text, chr(10) ORDER BY name, ord) END, CASE part WHEN 0 THEN 3000 WHEN 1 THEN 5000 ELSE 2000 END) AS t FROM qparts GROUP BY question_id, part),
three AS (SELECT question_id, concat_ws(chr(10) || chr(10), max(CASE WHEN part = 0 THEN '## Search results' || chr(10) || t END),
  max(CASE WHEN part = 1 THEN '## Devices' || chr(10) || t END),
  max(CASE WHEN part = 2 THEN '## Whole document' || chr(10) || t END)) AS context FROM joined GROUP BY question_id)
SELECT question_id, coalesce(context, 'Nothing was found.') AS context FROM asked LEFT JOIN three USING (question_id)""")
def context_assembly(spark, d):
    """Prompt contexts: search results, device overviews and the manual, each within its budget."""
    plans = field_plans(spark, d)
    rows = full_context(spark, d, plans, stored_passages(spark, d))
    return CX.prompt_context(plans, rows)


@register("citation_list", FANOUT + SHOWN + f"""
SELECT question_id, chunk_id, chunk_type AS type, page_number AS page, round(score, 3) AS score, source_file,
  section_title AS section, CASE WHEN length(trim(replace(content, chr(10), ' '), {SPACE})) > 60
    THEN left(trim(replace(content, chr(10), ' '), {SPACE}), 60) || '...'
    ELSE trim(replace(content, chr(10), ' '), {SPACE}) END AS preview,
  NULL AS device, NULL AS access_mode, NULL AS collected_at FROM shown
UNION ALL SELECT question_id, 'device_' || device, 'device_data', NULL, NULL, NULL, NULL, NULL, device,
  CASE WHEN CAST(substr(device, 2) AS INT) % 3 = 0 THEN 'ssh' ELSE 'file' END, '2024-01-01T00:00:00' FROM known""")
def citation_list(spark, d):
    plans = retrieval_plans(spark, d)
    named = unfold(plans.filter("target_scope = 'named'"), ["question_id"], "targets", "device_name")
    devices = named.withColumn(
        "access_mode", F.when(F.substring("device_name", 2, 10).cast("int") % 3 == 0, "ssh").otherwise("file")
    ).withColumn("collected_at", F.lit("2024-01-01T00:00:00"))
    found = results(spark, d, plans, stored_passages(spark, d))
    return CX.citations(found, devices, "question_id")


# --- lookups over final chunks


@register("point_lookups", CHUNKS + """
SELECT 'type' AS lookup, chunk_id FROM chunks WHERE chunk_type = 'table'
UNION ALL SELECT 'page', chunk_id FROM chunks WHERE page_number = 3
UNION ALL SELECT 'id', chunk_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_type = 'heading')""")
def point_lookups(spark, d):
    base = chunks(spark, d)
    wanted = base.filter("chunk_type = 'heading'").select("chunk_id")
    parts = [("type", LK.by_type(base, "table")), ("page", LK.by_page(base, 3)), ("id", LK.by_ids(base, wanted))]
    found = [rows.select(F.lit(name).alias("lookup"), "chunk_id") for name, rows in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("source_in_order", CHUNKS + """
SELECT source_file, page_number, chunk_index, chunk_type FROM chunks ORDER BY source_file, page_number, chunk_index, y0""")
def source_in_order(spark, d):
    """Sorted from a stored table: a range sort reads its input twice, and the chunk chain is evaluated once."""
    base = written(chunks(spark, d).select("source_file", "page_number", "chunk_index", "bbox_y0", "chunk_type"), "in-order")
    return LK.in_document_order(base).select("source_file", "page_number", "chunk_index", "chunk_type")


@register("manual_text", CHUNKS + """
SELECT source_file, chunk_index // 256 AS part_no, count(*) AS n_rows, string_agg(content, chr(10) ORDER BY chunk_index)
  AS text, 'all' AS variant FROM chunks GROUP BY ALL
UNION ALL SELECT source_file, chunk_index // 256, count(*), string_agg(content, chr(10) ORDER BY chunk_index), 'text'
FROM chunks WHERE chunk_type <> 'image_desc' GROUP BY ALL""")
def manual_text(spark, d):
    base = chunks(spark, d)
    return LK.manual_text(base).withColumn("variant", F.lit("all")).unionByName(
        LK.manual_text(base, with_images=False).withColumn("variant", F.lit("text")))


@register("collection_statistics", CHUNKS + """
SELECT CASE WHEN grouping(chunk_type) + grouping(source_file) = 2 THEN 'total' WHEN grouping(source_file) = 1 THEN 'type'
    ELSE 'source' END AS scope, coalesce(chunk_type, source_file, '') AS name, count(*) AS n_chunks,
  min(page_number) AS min_page, max(page_number) AS max_page
FROM chunks GROUP BY GROUPING SETS ((), (chunk_type), (source_file))""")
def collection_statistics(spark, d):
    return LK.collection_statistics(chunks(spark, d))

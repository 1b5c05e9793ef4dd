"""Retrieval against brute force."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretally.operators import context as CX, dense as DE, fusion as FU, sparse as SP


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = np.round(rng.normal(size=(300, 8)), 2)
    data[100:200] = data[7]          # a third of the vectors are copies
    data[250] = 0
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "i bigint, v array<double>")


def brute(data, k, skip=False):
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    unit = np.divide(data, norm, out=np.zeros_like(data), where=norm > 0)
    scores = np.round(unit @ unit.T, 6)
    out = set()
    for q in range(len(data)):
        order = [i for i in sorted(range(len(data)), key=lambda i: (-scores[q][i], i)) if not (skip and i == q)][:k]
        out |= {(q, i) for i in order}
    return out


def pairs(df):
    return {(r.query_id, r.vector_id) for r in df.collect()}


def test_blocked_search_equals_brute_force(vectors):
    data, df = vectors
    want = brute(data, 5)
    assert pairs(DE.dense_top_k(df, df, 5, "i", "v", "i", "v")) == want
    assert pairs(DE.dense_top_k(df, df, 5, "i", "v", "i", "v", block=37)) == want
    assert pairs(DE.dense_top_k(df, df, 4, "i", "v", "i", "v", skip_same=True, block=64)) == brute(
        data, 4, True)


def test_score_threshold(vectors):
    data, df = vectors
    rows = DE.dense_top_k(df, df, 300, "i", "v", "i", "v", score_threshold=0.9).collect()
    assert rows and all(r.score >= 0.9 for r in rows)


def test_one_crowded_bucket_gives_the_exact_result(vectors):
    data, df = vectors
    near = df.select("i", F.transform("v", lambda x: x + 60.0).alias("v"))     # one direction: one bucket
    got = pairs(DE.approximate_top_k(near, near, 3, "i", "v", "i", "v", tables=1, bucket_length=100.0, block=50))
    assert got == brute(data + 60.0, 3)


def test_user_function_embedding(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "i int, t string").repartition(2)
    seen = DE.embed_with(df, "t", lambda: lambda texts: [[float(len(t)), float(len(texts) <= 32)] for t in texts], "e")
    assert all(r.e == [float(r.i), 1.0] for r in seen.collect())


def test_bm25_equals_brute_force_with_a_frequent_term(spark):
    texts = ["the router the switch", "the vlan", "Éteindre the link", "", "the the the the", "switch vlan vlan"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    queries = spark.createDataFrame([(0, "The vlan"), (1, "éteindre"), (2, "nothing")], "q bigint, t string")
    tok = [re.findall(r"\w+", t.lower()) for t in texts]
    n, mean = len(tok), sum(map(len, tok)) / len(tok)
    want = {}
    for q, text in ((0, "the vlan"), (1, "éteindre"), (2, "nothing")):
        for i, words in enumerate(tok):
            score = 0.0
            for term in set(text.split()):
                tf, df = Counter(words)[term], sum(term in w for w in tok)
                if tf:
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if any(t in words for t in text.split()):
                want[q, i] = round(score, 6)
    got = {(r.q, r.i): r.score for r in SP.sparse_scores(
        corpus, queries.withColumnRenamed("t", "query"), "i", "t", "q", "query").collect()}
    assert got == pytest.approx(want)


def test_rank_fusion_by_hand(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, c string, rank int")
    sparse = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "q int, c string, rank int")
    rows = {r.c: r.score for r in FU.hybrid(dense, sparse, 3, "q", "c").collect()}
    assert rows == {"a": round(0.7 / 61, 6), "b": round(0.7 / 62 + 0.3 / 61, 6), "c": round(0.3 / 62, 6)}


def test_fan_out_keeps_the_first_score(spark):
    variants = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "question_id int, ordinal bigint, variant_text string")
    hits = spark.createDataFrame([("x", "c1", "text", 0.1), ("y", "c1", "text", 0.9), ("y", "c2", "table", 0.5)],
                                 "variant_text string, chunk_id string, modality string, score double")
    rows = {r.chunk_id: (r.score, r.ordinal) for r in FU.fan_out(variants, hits, "question_id", "chunk_id").collect()}
    assert rows == {"c1": (0.1, 0), "c2": (0.5, 1)}


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.range(10).select(F.lit("text").alias("chunk_type"), F.lit("d.pdf").alias("source_file"), F.col("id").alias("page_number"),
                           F.lit("").alias("section_title"), F.lit("x").alias("content")).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = spark.read.parquet(path).filter(FU.payload_filter(("text",), "d.pdf", (2, 4))).select(
        "page_number")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(page_number,2)" in plan


def test_searches_stay_in_the_types_of_their_plan(spark):
    """One text asked by two plans: each sees its own chunk types, ranked before the quota is applied."""
    plans = spark.createDataFrame([(1, ["text", "table"], False), (2, ["code_cli", "other"], True), (3, [], False)],
                                  "question_id int, chunk_types array<string>, needs_images boolean")
    scoped = plans.select("question_id", FU.search_scope().alias("scope"))
    assert {r.question_id: r.scope for r in scoped.collect()} == {1: "table,text", 2: "code_cli,image_desc", 3: ""}
    variants = FU.scoped_variants(scoped.withColumn("ordinal", F.lit(0)).withColumn("variant_text", F.lit("q")))
    scores = variants.select("text_id").distinct().crossJoin(spark.createDataFrame(
        [(f"c{i}", "code_cli", 9.0 - i) for i in range(7)] + [("t", "text", 1.0), ("b", "table", 0.5), ("i", "image_desc", 0.4)],
        "chunk_id string, chunk_type string, score double"))
    rows = FU.fan_out(variants, FU.scoped_hits(scores, variants, "chunk_id"), "question_id", "chunk_id", by="search_id").collect()
    assert {(r.question_id, r.chunk_id) for r in rows} == {(1, "t"), (1, "b"), (2, "i")} | {(2, f"c{i}") for i in range(5)}


def test_prompt_context_cuts_each_part_to_its_budget(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    search = spark.createDataFrame([(1, "s" * 4000), (2, None)], "question_id int, context string")
    devices = spark.createDataFrame([(1, "R2", "b" * 3000), (1, "R1", "a" * 3000), (2, "R1", "a")],
                                    "question_id int, device_name string, summary string")
    manual = spark.createDataFrame([(1, "d.pdf", n, "m") for n in range(3000)] + [(2, "d.pdf", 0, "")],
                                   "question_id int, source_file string, part_no int, text string")
    rows = CX.context_rows(search, devices, manual)
    got = {r.question_id: r.context for r in CX.prompt_context(questions, rows).collect()}
    field = ("a" * 3000 + "\n\n" + "b" * 3000)[:5000]
    assert got[1] == (CX.DOCUMENTATION + "s" * 3000 + "\n\n" + CX.FIELD + field + "\n\n" + CX.MANUAL
                      + "\n".join("m" * 3000)[:2000])
    assert got[2] == CX.FIELD + "a" and got[3] == CX.NOTHING_FOUND
    assert rows.filter("part = 2").count() == 3000


def test_best_of_blocks_hold_the_global_best(spark, monkeypatch):
    """Many small blocks, ties, groups and texts without words: the same hits as from all scores, and k rows a block at most."""
    for name, value in (("BLOCK_TERMS", 60), ("BLOCK_QUERIES", 2), ("CELLS", 64)):
        monkeypatch.setattr(SP, name, value)
    draw = random.Random(5)
    rows = [(f"c{i:03}", " ".join(draw.choices("abcdefgh", k=draw.choice([1, 2, 9]))), draw.choice(["x", "y"])) for i in range(90)]
    rows += [(f"d{i:03}", "a b a", "x") for i in range(60)] + [("e1", None, "x"), ("e2", "...", "y")]
    corpus = spark.createDataFrame(rows, "i string, t string, kind string").repartition(3)
    asked = spark.createDataFrame([(1, "a b"), (2, "h"), (3, "a c e z"), (4, "none"), (5, "b b g")], "q int, text string")
    every = SP.sparse_scores(corpus, asked, "i", "t", "q", "text", keep=("kind",)).collect()
    want = set()
    for q, kind in {(r.q, r.kind) for r in every}:
        best = sorted((-r.score, r.i) for r in every if (r.q, r.kind) == (q, kind))[:4]
        want |= {(q, kind, i, -s) for s, i in best}
    found = SP.sparse_best(corpus, asked, 4, "i", "t", "q", "text", group="kind")
    n_blocks = -(-sum(len(set((r[1] or "").replace(".", "").split())) for r in rows) // 60)
    assert n_blocks > 3 and found.count() <= 4 * 2 * 5 * n_blocks < len(every)
    ranked = SP.top_k(found, ["q", "kind"], [F.desc("score"), F.asc("i")], 4)
    assert {(r.q, r.kind, r.i, r.score) for r in ranked.collect()} == want
    single = {(r.q, r.i) for r in SP.sparse_top_k(corpus, asked, 3, "i", "t", "q", "text").collect()}
    assert single == {(q, i) for q in {r.q for r in every} for _, i in sorted((-r.score, r.i) for r in every if r.q == q)[:3]}


def test_default_embedding_counts_in_slices(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(DE, "EMBED_TERMS", 5)
    texts = ["a b a", None, "", "c " * 12, "d", "?!", "e f g h a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for dim in (8, 200):
        got = {r.i: r.embedding for r in DE.hash_embed(df, "t", dim=dim).collect()}
        for i, text in enumerate(texts):
            want = np.zeros(dim)
            for term in (text or "").replace("?!", "").split():
                want[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim] += 1
            assert np.allclose(got[i], want / (np.linalg.norm(want) or 1))
    plan = DE.hash_embed(df, "t")._jdf.queryExecution().toString()
    assert "tinyint" in plan            # one byte a term goes to Python

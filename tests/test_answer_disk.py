"""What the passages of an answer and the blocks of a BM25 search leave on disk and shuffle."""
import glob
import random

from wiretally.operators import captions as CP, sparse as SP
from wiretally.plans import search_queries as SQ
from wiretally.session import distilled, shared_folder

SMALL = "/root/testdata/sf0.001"


def held(spark, label):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/{label}-*"))


def test_passages_keep_no_table_that_was_stored_on_the_way(spark):
    before = {x: held(spark, x) for x in ("ordered", "typed", "passages")}
    rows = SQ.stored_passages(spark, SMALL)
    assert rows.count() and len(held(spark, "passages") - before["passages"]) == 1
    assert held(spark, "ordered") == before["ordered"] and held(spark, "typed") == before["typed"]


def test_chunks_go_to_their_blocks_as_packs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    corpus = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12)), "ab"[i % 2]) for i in range(150)], "i long, t string, kind string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(9)], "q long, text string")
    top = lambda: sorted(map(tuple, distilled(spark, lambda: SP.sparse_best(corpus, asked, 200, "i", "t", "q", "text", group="kind"), "best").collect()))
    whole = top()
    monkeypatch.setattr(SP, "BLOCK_TERMS", 90)
    monkeypatch.setattr(SP, "BLOCK_QUERIES", 4)
    plan = SP.sparse_best(corpus, asked, 200, "i", "t", "q", "text", group="kind")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and top() == whole
    want = {r[:4] for r in map(tuple, SP.sparse_scores(corpus, asked, "i", "t", "q", "text", keep=("kind",)).select("q", "kind", "i", "score").collect())}
    assert set(whole) == want


def test_captions_meet_images_only(spark, monkeypatch):
    given, whole = [], CP.enrich_images
    monkeypatch.setattr(CP, "enrich_images", lambda blocks, captions: given.append(blocks) or whole(blocks, captions))
    rows = SQ.passages(spark, SMALL)
    assert given and all(b.filter("block_type <> 'image'").isEmpty() for b in given)
    assert not rows.filter("chunk_type = 'image_desc' AND content <> ''").isEmpty()

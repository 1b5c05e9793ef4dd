"""Pairs of blocks are spread by their number, whatever the session's number of shuffle partitions is."""
import random

from wiretally.operators import sparse as SP


def test_partitions_grow_with_the_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    corpus = spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(12)], "item_id long, text string")
    whole = SP.sparse_top_k(corpus, asked, 5, "doc_id", "text", "item_id", "text").collect()
    monkeypatch.setattr(SP, "BLOCK_TERMS", 150)
    best = SP.sparse_best(corpus, asked, 5, "doc_id", "text", "item_id", "text")
    assert best.rdd.getNumPartitions() > 20
    cut = SP.sparse_top_k(corpus, asked, 5, "doc_id", "text", "item_id", "text").collect()
    assert sorted(cut) == sorted(whole) and len(whole) == 60

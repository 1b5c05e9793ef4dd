"""Chunking against plain re-implementations on small, awkward inputs."""
import random

from pyspark.sql import functions as F

from wiretally.operators import captions as CP, chunking as CH, prepare as PR
from wiretally.sources.tables import BLOCK_SCHEMA


def block(source, page, no, text, kind="text", y=None):
    return (source, page, no, kind, 0.0, float(no if y is None else y), 10.0, 5.0, text, 1000, 1000, "png")


def frame(spark, rows):
    return spark.createDataFrame(rows, BLOCK_SCHEMA)


def test_split_pieces_cover_the_text(spark):
    """Piece by piece: where it starts, where it ends, and that nothing but blanks lies outside."""
    rng = random.Random(5)
    texts = ["x" * n for n in (801, 949, 950, 951, 1400, 1450, 1451)]
    texts += ["".join(rng.choice("ab é\n  ") for _ in range(rng.randrange(801, 6000))).strip() for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r.i: [tuple(w) for w in r.w] for r in rows.select("i", CH.split_windows(F.col("t")).alias("w")).collect()}
    for i, text in enumerate(texts):
        pieces = got[i]
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        seen = set()
        for (start, end, piece), after in zip(pieces, pieces[1:] + [None]):
            assert piece == text[start:end].strip() and piece
            if end < len(text):
                breaks = [k for k in range(start + 700, start + 800) if text[k] == "\n"]
                assert end == (breaks[-1] if breaks else start + 800)
            else:
                assert end - start <= 800
            if after is not None and text[end - 150:after[0]].strip() == "":
                assert after[0] >= end - 150
            seen.update(range(start, end))
        assert all(text[k].isspace() for k in set(range(len(text))) - seen)


def test_contained_tail_can_be_dropped(spark):
    rows = spark.createDataFrame([("x" * 1400,)], "t string")
    keep = rows.select(F.size(CH.split_windows(F.col("t")))).first()[0]
    drop = rows.select(F.size(CH.split_windows(F.col("t"), CH.ChunkSettings(drop_contained_tails=True)))).first()[0]
    assert (keep, drop) == (3, 2)


def test_merged_blocks_rebuild_each_page(spark):
    rng = random.Random(9)
    rows, plain = [], {}
    for source, n in (("hot.pdf", 900), ("a.pdf", 60), ("b.pdf", 1)):
        for i in range(n):
            page = 1 + i // 7
            kind = rng.choice(["text"] * 5 + ["image"])
            text = "w" * rng.choice([20, 25, 79, 80, 81, 200])
            rows.append(block(source, page, i, text, kind))
            plain.setdefault((source, page), []).append((kind, text))
    ordered = PR.order_blocks(PR.prepare_blocks(frame(spark, rows)), pages_per_segment=3)
    got = {}
    for r in CH.merge_short(ordered).orderBy("source_file", "page_number", "block_index").collect():
        got.setdefault((r.source_file, r.page_number), []).append((r.block_type, r.content))
    assert got.keys() == plain.keys()
    for page, merged in got.items():
        assert "\n".join(t for _, t in merged) == "\n".join(t for _, t in plain[page])      # in order, nothing lost
        assert [t for k, t in merged if k == "image"] == [t for k, t in plain[page] if k == "image"]
        for (kind, text), (after, _) in zip(merged, merged[1:]):
            assert "image" in (kind, after) or len(text) >= 80                                  # a short text takes its neighbour
        for kind, text in merged:
            if kind != "image" and "\n" in text:
                assert len(text.rsplit("\n", 1)[0]) < 80                                       # and stops when it is long


def test_order_is_the_same_for_every_segment_size(spark):
    rows = [block("d.pdf", 1 + i // 4, i, f"block number {i:05d} with text", y=(i * 7) % 4) for i in range(400)]
    one, many = [
        sorted((r.block_no, r.block_index, r.total_blocks, r.position_ratio)
               for r in PR.order_blocks(PR.prepare_blocks(frame(spark, rows)), pages_per_segment=s).collect())
        for s in (10_000, 2)
    ]
    assert one == many
    assert sorted(r[1] for r in one) == list(range(400))


def test_title_look_back_is_nineteen_rows(spark, monkeypatch):
    monkeypatch.setattr(CH, "CHUNKS_PER_SEGMENT", 20)
    texts = ["Step 1 Prepare everything"] + [f"plain paragraph {i} " + "t" * 90 for i in range(45)]
    rows = [block("d.pdf", 1 + i, i, t) for i, t in enumerate(texts)]
    chunks = CH.build_chunks(frame(spark, rows)).orderBy("chunk_index").collect()
    titled = [c.chunk_index for c in chunks if c.section_title]
    assert titled == list(range(1, 20))
    assert chunks[1].section_title == "Step 1 Prepare everything"
    for before, after in zip(chunks[1:], chunks[2:]):
        assert after.overlap_prev == before.content[-150:].strip() and before.overlap_next == after.content[:150].strip()


def test_empty_and_single_block_documents(spark):
    rows = [block("empty.pdf", 1, 0, "   \n "), block("one.pdf", 1, 0, "only one block of text here")]
    chunks = CH.build_chunks(frame(spark, rows)).collect()
    assert [(c.source_file, c.chunk_index, c.total_chunks) for c in chunks] == [("one.pdf", 0, 1)]


def test_table_needs_three_lines_and_two_fifths(spark):
    texts = {"a\tb\nc\td\ne": True, "a\tb\nc\td": False, "a\tb\nc\nd\ne": False, "x  |  y\nq\nz  |  y\nw\nv": True,
             "a  b  c  d\nq\nr": False}
    got = {r.t: r.y for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", PR.looks_like_table(F.col("t")).alias("y")).collect()}
    assert got == texts


def test_caption_defaults(spark):
    responses = [("a", "free text only"), ("b", "DESCRIPTION: d\nCONFIANCE: 0,4"), ("c", "CATÉGORIE: screenshot\nCONFIANCE: nan"),
                 ("d", "DESCRIPTION: d CONFIANCE: -3 ÉLÉMENTS CLÉS: a, b,,")]
    rows = {r.source_file: r for r in CP.parse_captions(
        spark.createDataFrame(responses, "source_file string, response string")).collect()}
    assert (rows["a"].description, rows["a"].confidence, rows["a"].category) == ("free text only", 0.8, "unknown")
    assert rows["b"].confidence == 0.4
    assert rows["c"].category == "screenshot" and rows["c"].confidence == 0.8
    assert rows["d"].confidence == 0.0 and list(rows["d"].key_elements) == ["a", "b"]

"""The chunk chain: the same chunks as its steps taken one by one over whole documents, with the content shuffled once."""
import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wiretally.functions.ordered import number_rows
from wiretally.functions.text import strip
from wiretally.session import scratch_path
from wiretally.operators import captions as CP, chunking as CH, prepare as PR
from wiretally.sources import tables as TB
from test_chunking import block, frame


def step_by_step(blocks, captions):
    ordered = CP.enrich_images(PR.order_blocks(PR.prepare_blocks(blocks), 1000), captions)
    pieces = CH.split_long(CH.merge_short(ordered.filter(strip(F.col("content")) != "")))
    numbered = number_rows(pieces, ["source_file"], "page_segment", ["page_number", "block_index", "split_part"], "chunk_index", "total_chunks")
    typed = numbered.withColumn("chunk_type", CH.semantic_type(F.col("block_type"), F.col("content")))
    return CH.final_columns(CH.add_context(typed))


def awkward(rng):
    texts = ["Step 4 Zone 7 planning", "[S1]display vlan 3\n[S1]interface Vlanif3\n ip address", "word " * 30, "line of text " * 90,
             "[S1]display vlan 3 [S1]interface Vlanif3", "a\tb\nc\td\ne\tf", "short text here"]
    rows = []
    for source, pages in (("long.pdf", 40), ("gap.pdf", 25), ("one.pdf", 1), ("blank.pdf", 6)):
        for page in range(1, pages + 1):
            blank = source == "blank.pdf" or (source == "gap.pdf" and 6 <= page <= 12)      # whole segments without a text
            for no in range(rng.randrange(1, 5)):
                image = blank or rng.random() < 0.2
                text = "" if image else texts[1:][rng.randrange(6)] if rng.random() < 0.93 else texts[0]
                rows.append(block(source, page, page * 10 + no, text, "image" if image else "text"))
    return rows


def test_chain_equals_its_steps_over_whole_documents(spark, monkeypatch):
    rng = random.Random(31)
    blocks = frame(spark, awkward(rng))
    captions = spark.createDataFrame(
        [("long.pdf", p * 10 + n, f"Diagram {p}", "topology", ["S1"], ["OSPF"], 0.5, None if p % 3 else "failed")
         for p in range(1, 41) for n in range(2)],
        "source_file string, block_no int, description string, category string, key_elements array<string>, technical_terms array<string>, "
        "confidence double, error string")
    want = sorted(map(str, step_by_step(blocks, captions).collect()))
    assert len(want) > 80
    for pages in (1, 3, 1000):
        monkeypatch.setattr(CH, "PAGES_PER_SEGMENT", pages)
        assert sorted(map(str, CH.build_chunks(blocks, captions=captions).collect())) == want


def test_chunks_are_not_shuffled_after_they_are_stored(spark):
    chunks = CH.build_chunks(frame(spark, [block(f"d{i}.pdf", p, p, "w " * 60) for i in range(5) for p in range(1, 90)]))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort [" not in plan


def test_index_is_written_compactly(spark):
    path, new = scratch_path(spark, "idx"), frame(spark, [block("d1.pdf", 1, 0, "text of another version")])
    TB.write_index(CH.build_chunks(frame(spark, [block(f"d{i}.pdf", 1, 0, f"text of document number {i}") for i in range(9)])), path)
    for _ in range(2):
        files = glob.glob(path.removeprefix("file:") + "/bucket=*/*.parquet")
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}
        TB.replace_sources(spark, path, CH.build_chunks(new), spark.createDataFrame([("d1.pdf",)], "source_file string"))
    assert {r.content for r in TB.read_index(spark, path, "d1.pdf").collect()} == {"text of another version"}

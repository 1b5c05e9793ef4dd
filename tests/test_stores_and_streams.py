"""File sources, index replacement and streams with several micro-batches."""
import datetime as dt
import random

from pyspark.sql import functions as F

from wiretally.operators.chunking import build_chunks
from wiretally.session import scratch_path
from wiretally.sources import devices as DV, tables as TB
from wiretally.streaming import ingest as IN, telemetry as ST
from test_chunking import block, frame


def test_export_priority_on_real_files(spark, tmp_path):
    files = {"R1_full.txt": "[R1]display version\nV1\n", "R1_version.txt": "old", "r1.txt": "plain",
             "S2_vlans.txt": " v \n", "S2.txt": "plain", "S3.txt": "cfg\n", "notes.md": "no"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.device_name: dict(r.outputs) for r in DV.export_outputs(DV.read_export_files(spark, str(tmp_path))).collect()}
    assert got == {"R1": {"display version": "V1"}, "S2": {"display vlan": "v"},
                   "S3": {"display current-configuration": "cfg\n"}}


def test_chunk_json_arrays(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"chunk_id": "1", "content": "x", "merged": true, "vision_terms": ["a"]},\n {"chunk_id": "2"}]')
    rows = TB.read_chunk_json(spark, str(tmp_path / "c.json"), arrays=True).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.merged) for r in rows] == [("1", True), ("2", None)] and list(rows[0].vision_terms) == ["a"]


def test_replacing_sources_twice_changes_nothing_more(spark):
    rows = [block(f"d{i}.pdf", 1, 0, f"text of document number {i} before") for i in range(30)]
    path = scratch_path(spark, "idx")
    TB.write_index(build_chunks(frame(spark, rows)), path)
    new = [block("d3.pdf", 1, 0, "a completely different text body")]
    named = spark.createDataFrame([("d3.pdf",), ("d4.pdf",)], "source_file string")
    for _ in range(2):
        TB.replace_sources(spark, path, build_chunks(frame(spark, new)), named)
    held = {r.source_file: r.content for r in TB.read_index(spark, path).collect()}
    assert len(held) == 29 and "d4.pdf" not in held and held["d3.pdf"] == "a completely different text body"
    assert TB.read_index(spark, path, "d5.pdf").count() == 1
    assert TB.index_counts(build_chunks(frame(spark, rows))).first().asDict() == {"total": 30, "success": 30, "error": 0}


def test_sample_history_over_batches_equals_batch_form(spark, tmp_path):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 5), start + dt.timedelta(seconds=3 * i), i, float(i % 90), 1.0)
            for i in range(900)]
    schema = "device bigint, ts timestamp, event_id bigint, cpu double, memory double"
    for b in range(3):
        spark.createDataFrame(rows[b * 300:(b + 1) * 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = ST.run_to_table(ST.sample_history(stream), "update", "hist")
    assert table.select("batch_id").distinct().count() == 3
    got = {(r.device, r.event_id, r.rank) for r in ST.merge_history(table).collect()}
    want = {(r.device, r.event_id, r.rank) for r in ST.newest_samples(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and max(r[2] for r in got) == 40


def test_ingest_completes_documents_over_batches(spark, tmp_path):
    """Late parts of a document, a batch of known blocks only, and images with captions."""
    long = lambda t: t + " " + "words that fill the block so that it stays one chunk of its own " * 2
    first = [block(f"/a/d{i}.pdf", 1, 0, long(f"document {i} first page")) for i in range(3)]
    late = [block("/b/d1.pdf", 2, 1, long("document 1 second page")), block("x.txt", 1, 0, "not a pdf source at all, really")]
    image = [block("d2.pdf", 3, 7, "", "image")]
    src = str(tmp_path / "blocks")
    paths = [str(tmp_path / p) for p in ("index", "manifest", "state")]
    captions = spark.createDataFrame(
        [("d2.pdf", 7, "A picture of a rack with two switches", "schema", ["rack"], ["switch"], 0.9, 10, False, None)],
        "source_file string, block_no int, description string, category string, key_elements array<string>, "
        "technical_terms array<string>, confidence double, tokens_used bigint, is_mock boolean, error string")
    for rows in (first, late, first, image):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(TB.BLOCK_SCHEMA).parquet(src)
        IN.ingest_stream(stream, *paths, captions=captions).awaitTermination()
    held = {}
    for r in TB.read_index(spark, paths[0]).collect():
        held.setdefault(r.source_file, []).append(r.content)
    assert sorted(held) == ["d0.pdf", "d1.pdf", "d2.pdf"]
    assert len(held["d1.pdf"]) == 2 and any("second page" in c for c in held["d1.pdf"])
    assert any("picture of a rack" in c for c in held["d2.pdf"])
    assert [r.source_file for r in TB.read_index(spark, paths[0], "d1.pdf").select("source_file").distinct().collect()] == ["d1.pdf"]
    done = {r.filename: r.chunks_indexed for r in IN.current_manifest(spark, paths[1]).collect()}
    assert done == {k: len(v) for k, v in held.items()}


def test_same_file_name_in_two_folders(spark):
    rows = spark.createDataFrame(
        [("/a/R1_version.txt", dt.datetime(2024, 1, 1), "old"), ("/b/R1_version.txt", dt.datetime(2024, 1, 2), "new"), ("/b/R1_vlans.txt", None, "v")],
        "path string, modified timestamp, content string")
    got = {r.device_name: dict(r.outputs) for r in DV.export_outputs(rows).collect()}
    assert got == {"R1": {"display version": "new", "display vlan": "v"}}


def test_two_patches_give_one_entry(spark):
    from wiretally.operators.history import upsert_history

    rows = spark.createDataFrame([("1", "u", dt.datetime(2024, 1, 1), "a", "pending", False)],
                                 "id string, user_key string, created_at timestamp, answer string, status string, is_error boolean")
    patches = spark.createDataFrame([("1", "x", None, None, 1), ("1", "y", "done", None, 2)],
                                    "id string, answer string, status string, is_error boolean, patched_at int")
    got = upsert_history(rows, rows.limit(0), patches).collect()
    assert [(r.answer, r.status) for r in got] == [("y", "done")]


def test_last_status_keeps_values_and_shows_error(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 1, 5.0, 6.0, True, None), (1, t + dt.timedelta(1), 2, 9.0, 9.0, False, "x"), (2, t, 3, 1.0, 1.0, False, "y")]
    df = spark.createDataFrame(rows, "device bigint, ts timestamp, event_id bigint, cpu double, memory double, ok boolean, error string")
    got = {r.device: (r.cpu, r.status_error) for r in ST.last_status(df).collect()}
    assert got == {1: (5.0, "x"), 2: (None, "y")}


def test_skip_indexed_and_force(spark):
    rows = frame(spark, [block("a.pdf", 1, 0, "t"), block("b.pdf", 1, 0, "t")])
    index = spark.createDataFrame([("a.pdf",)], "source_file string")
    assert [r.source_file for r in TB.not_indexed(rows, index).collect()] == ["b.pdf"]
    assert TB.not_indexed(rows, index, force=True).count() == 2


def test_blocks_read_for_a_batch_do_not_grow_with_batches(spark, tmp_path):
    store = str(tmp_path / "blocks")
    rows = lambda batch: frame(spark, [block(f"d{batch * 3 + n}.pdf", p, 0, f"block {p} of {batch}") for n in range(3) for p in range(4)])
    for batch in range(6):
        IN.keep_batch(rows(batch), store, batch)
        batches, buckets = IN.folders_of_batch(spark, store, batch)
        assert batches == [batch] and 0 < len(buckets) <= 3
        assert IN.first_seen(spark, store, batch).count() == 12
    plan = IN.blocks_of_batch(spark, store, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan or "PartitionFilters: [(batch" in plan
    again = frame(spark, [block("d4.pdf", 9, 0, "late"), block("d4.pdf", 0, 0, "another text of a known place")])
    IN.keep_batch(again, store, 6)
    batches, buckets = IN.folders_of_batch(spark, store, 6)
    assert sorted(batches) == [1, 6] and len(buckets) == 1
    held = {(r.page_number, r.batch): r.content for r in IN.first_seen(spark, store, 6).collect()}
    assert held[(9, 6)] == "late" and held[(0, 1)] == "block 0 of 1" and len(held) == 5


def test_stream_over_a_table_in_part_files_and_in_one_file(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "event_id")
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "one" / "events.parquet")
    for kind in ("parts", "one"):
        rows.write.parquet(str(tmp_path / kind / "other.parquet"))
        table = ST.run_to_table(ST.event_stream(spark, str(tmp_path / kind)), "append", "events")
        assert sorted(r.event_id for r in table.collect()) == list(range(20))

"""The registered queries: complete, checkable, and without data-sized single tasks."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import normal

SF = "/root/testdata/sf0.001"
#: Training-data queries that SQL cannot state (tests/llm holds their brute-force versions); absent where those modules are.
NO_SQL = {
    "op1_sharding", "op2_simhash", "op3_packing", "op4_substrings", "op5_quality", "op6_extraction", "op7_decontamination",
    "op9_toxicity", "op10_language", "op11_alignment", "op12_pieces", "op13_turns", "pipeline",
}
SAMPLE = ["sparse_top_k", "pruned_similar", "approximate_recall", "merge_short_blocks", "final_chunks", "sub_queries", "parse_ospf_peers", "vlan_gap", "device_tree",
          "next_free_address", "load_trend_sliding"]


def test_every_query_has_check_sql():
    assert set(entry.queries()) - set(entry.oracle_sql()) == NO_SQL & set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["item_id", "doc_id", "score", "rank"] and rows.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "events", "embeddings", "nation", "region", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert got == normal(cur.fetchall(), names)


@pytest.mark.parametrize("name", ["final_chunks", "sparse_top_k", "vlan_gap", "similar_to_existing", "expected_vlans"])
def test_plans_hold_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_protocol_facts_cover_devices_that_no_question_names(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()["protocol_facts"](spark, SF)
    named = con.execute("SELECT count(DISTINCT n) FROM (SELECT unnest([item_id * 7, item_id * 7 + 1]) AS n FROM benchmark)").fetchone()[0]
    cur = con.execute(entry.oracle_sql()["protocol_facts"])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want, names)
    assert len({r[names.index("device_name")] for r in want}) > named


def test_source_in_order_sorts_a_stored_table(spark):
    """A range sort reads its input twice: what it reads is a table of five columns, not the chunk chain."""
    plan = entry.queries()["source_in_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Window" not in plan and "Aggregate" not in plan

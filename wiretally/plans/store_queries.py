"""Registered queries over sources, topology, history and streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import history as HI, telemetry as TM, topology as TP
from wiretally.plans import recipes as R
from wiretally.plans.chunk_queries import chunks
from wiretally.plans.chunk_sql import CHUNKS
from wiretally.plans import telemetry_queries as TQ
from wiretally.plans.telemetry_queries import FLEET, data
from wiretally.session import scratch_path
from wiretally.sources import devices as DV, tables as TB
from wiretally.streaming import ingest as IN, telemetry as ST

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- sources and sinks


@register("block_source", "WITH " + R.BLOCKS + """
SELECT source_file, block_no, block_type FROM blocks WHERE doc_id % 10 <> 9""")
def block_source(spark, d):
    """Blocks with full paths; every tenth source is not a PDF and is rejected."""
    raw = R.blocks(spark, d)
    i = F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint")
    path = F.when(i % 10 == 9, R._text("/in/b/doc_", i, ".txt")).otherwise(F.concat(F.lit("/in/a/"), F.col("source_file")))
    return TB.accept_blocks(raw.withColumn("source_file", path)).select(
        "source_file", F.col("block_no").cast("bigint").alias("block_no"), "block_type")


@register("chunk_json_round_trip", CHUNKS + """
SELECT chunk_id, content, chunk_type, page_number, source_file, chunk_index, section_title, length(content) AS char_count,
  block_type AS original_type, y0 AS bbox_y0, position_ratio, total_chunks, merged, split_part, split_total, split_start, split_end
FROM chunks""")
def chunk_json_round_trip(spark, d):
    path = scratch_path(spark, "chunk-json")
    TB.write_chunk_json(chunks(spark, d), path)
    return TB.read_chunk_json(spark, path).select(
        "chunk_id", "content", "chunk_type", "page_number", "source_file", "chunk_index", "section_title", "char_count",
        "original_type", "bbox_y0", "position_ratio", "total_chunks", "merged", "split_part", "split_total", "split_start",
        "split_end")


# A third of the devices has a full export and stray files, a third per-command files, a third one plain file.
@register("device_export_files", TQ.OUTPUTS + """
SELECT device_name, command, output FROM out JOIN dv USING (device_name) WHERE doc_id % 3 = 0
UNION ALL SELECT device_name, 'display cpu-usage', 'CPU Usage : 7%' FROM dv WHERE doc_id % 3 = 1
UNION ALL SELECT device_name, 'display current-configuration', 'sysname X' FROM dv WHERE doc_id % 3 = 1
UNION ALL SELECT device_name, 'display current-configuration', 'sysname Y' || chr(10) FROM dv WHERE doc_id % 3 = 2""")
def device_export_files(spark, d):
    base = R.sessions(spark, d).withColumn("i", F.substring("device_name", 2, 20).cast("bigint"))
    row = lambda suffix, text: F.struct(
        F.concat(F.lit("/exports/"), F.lower("device_name"), F.lit(f"{suffix}.txt")).alias("path"), text.alias("content"))
    files = F.array(
        F.when(F.col("i") % 3 == 0, row("_full", F.col("session_text"))),
        F.when(F.col("i") % 3 < 2, row("_cpu", F.lit("CPU Usage : 7%\n"))),
        F.when(F.col("i") % 3 < 2, row("_config", F.lit("sysname X\n"))),
        row("", F.lit("sysname Y\n")))
    rows = base.select(F.explode(F.filter(files, lambda x: x.isNotNull())).alias("f")).select("f.*")
    return TM.command_outputs(DV.export_outputs(rows))


@register("registry_defaults", "WITH " + R.REGISTRY + """
SELECT upper(name) AS name, lower(coalesce(type, 'switch')) AS type, mgmt_ip, coalesce(mgmt_interface, 'Vlanif1') AS mgmt_interface,
  CAST(NULL AS VARCHAR) AS username, CAST(NULL AS VARCHAR) AS password,
  coalesce(port, CASE WHEN lower(coalesce(protocol, 'ssh')) = 'telnet' THEN 23 ELSE 22 END)::BIGINT AS port, 30::BIGINT AS timeout,
  lower(coalesce(protocol, 'ssh')) AS protocol, coalesce(description, '') AS description FROM registry""")
def registry_defaults(spark, d):
    return DV.complete_registry(R.registry(spark, d))


@register("manifest_append_list", "WITH " + R.MANIFEST + " SELECT file_id, filename, ingested_at, chunks_indexed FROM manifest")
def manifest_append_list(spark, d):
    path, rows = scratch_path(spark, "manifest"), R.manifest(spark, d)
    even = F.pmod(F.xxhash64("file_id"), F.lit(2)) == 0
    TB.append_manifest(rows.filter(even), path)
    TB.append_manifest(rows.filter(~even), path)
    return TB.list_manifest(spark, path)


@register("index_replace", CHUNKS + """
SELECT source_file, chunk_index, CASE WHEN CAST(regexp_extract(source_file, '([0-9]+)', 1) AS BIGINT) % 4 = 0
  THEN 'v2 ' ELSE '' END || content AS content FROM chunks""")
def index_replace(spark, d):
    """Index everything, then re-index every fourth document with changed content."""
    path, base = scratch_path(spark, "index"), chunks(spark, d)
    TB.write_index(base, path)
    again = base.filter(F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint") % 4 == 0).withColumn(
        "content", F.concat(F.lit("v2 "), F.col("content")))
    TB.replace_sources(spark, path, again, again)
    return TB.read_index(spark, path).select("source_file", "chunk_index", "content")


@register("index_counts", CHUNKS + " SELECT count(*) AS total, count(*) AS success, 0::BIGINT AS error FROM chunks")
def index_counts(spark, d):
    return TB.index_counts(chunks(spark, d))


@register("skip_indexed", "WITH " + R.BLOCKS + " SELECT source_file, count(*) AS n FROM blocks WHERE doc_id % 2 = 1 GROUP BY ALL")
def skip_indexed(spark, d):
    raw = R.blocks(spark, d)
    held = raw.filter(F.regexp_extract("source_file", r"(\d+)", 1).cast("bigint") % 2 == 0)
    return TB.not_indexed(raw, held).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@register("snapshot_export", TQ.SUMMARY + TQ.CONTENTS + f"""
SELECT device_name, device_type, mgmt_ip, access_mode, {TQ.CONTENT_COLUMNS}, cpu AS cpu_usage, memory AS memory_usage,
  true AS is_complete, summary FROM dv JOIN met USING (device_name) {TQ.CONTENT_JOINS} JOIN summary USING (device_name)""")
def snapshot_export(spark, d):
    """Written snapshots read back: every section's records and the text overview."""
    path, full = scratch_path(spark, "snapshots"), data(spark, d)
    DV.write_snapshots(full, path)
    overview = spark.read.parquet(f"{path}/summary")
    return DV.read_snapshots(spark, path, full).select(
        "device_name", "device_type", "mgmt_ip", "access_mode", *TQ.contents(), "cpu_usage", "memory_usage", "is_complete",
    ).join(overview, "device_name")


# --- topology

TREE = "WITH RECURSIVE " + R.REGISTRY + """,
node AS (SELECT upper(name) AS node, upper(parent_device) AS p, ordinal, CASE WHEN type = 'router' THEN 'router' ELSE 'switch' END
  AS kind FROM registry),
root AS (SELECT node FROM node WHERE kind = 'router' ORDER BY ordinal LIMIT 1),
edge AS (SELECT n.node, n.kind, n.ordinal, CASE WHEN n.node = (SELECT node FROM root) THEN NULL
  ELSE coalesce((SELECT q.node FROM node q WHERE q.node = n.p), (SELECT node FROM root)) END AS parent FROM node n),
tree AS (SELECT node, kind, parent, 0::BIGINT AS depth, lpad(ordinal::VARCHAR, 12, '0') AS path FROM edge WHERE parent IS NULL
  UNION ALL SELECT e.node, e.kind, e.parent, t.depth + 1, t.path || '/' || lpad(e.ordinal::VARCHAR, 12, '0')
  FROM edge e JOIN tree t ON e.parent = t.node)"""


@register("device_tree", TREE + " SELECT node, kind, parent, depth, path FROM tree")
def device_tree(spark, d):
    return TP.flatten_tree(R.registry(spark, d))


_ROLE = "coalesce(nullif(description, ''), nullif(parent_interface, ''), nullif(mgmt_interface, ''), nullif(type, ''))"


@register("node_state", "WITH " + R.REACHABILITY + f"""
SELECT r.name, CASE WHEN reachable THEN 'online' WHEN NOT reachable THEN 'offline' ELSE 'warning' END AS state,
  CASE WHEN parent_interface IS NOT NULL AND link_mode IS NOT NULL
    THEN concat_ws(' · ', {_ROLE}, parent_interface, link_mode) ELSE {_ROLE} END AS role,
  CASE WHEN type = 'router' THEN 'router' ELSE 'switch' END AS kind
FROM registry r LEFT JOIN reach USING (name)""")
def node_state(spark, d):
    return TP.node_state(R.registry(spark, d), R.reachability(spark, d))


@register("reachability_summary", "WITH " + R.REACHABILITY + """
SELECT count(*) FILTER (reachable) AS reachable, count(*) AS total, round(count(*) FILTER (reachable) / count(*), 6) AS ratio,
  CASE WHEN bool_and(reachable) THEN 'all devices answer'
    ELSE count(*) FILTER (reachable) || '/' || count(*) || ' devices answer' END AS label, 'ok' AS status FROM reach""")
def reachability_summary(spark, d):
    return TP.reachability_summary(R.reachability(spark, d))


# Subnets of the nations as /24, of the regions as /30 around their router (full range: falls back to a gap).
@register("next_free_address", "WITH " + R.REGISTRY + """,
num AS (SELECT split_part(mgmt_ip, '.', 2)::INT AS b, split_part(mgmt_ip, '.', 3)::INT AS c, split_part(mgmt_ip, '.', 4)::INT AS x
  FROM registry WHERE name NOT LIKE 'r%'),
used AS (SELECT DISTINCT b, c, x FROM num),
agg AS (SELECT b, c, max(x) AS m FROM used GROUP BY ALL)
SELECT '10.' || b || '.' || c AS subnet, '10.' || b || '.' || c || '.' || CASE WHEN m < 255 THEN m + 1 ELSE 0 END AS next_address FROM agg
UNION ALL SELECT 'r' || r_regionkey, '10.' || r_regionkey || '.0.255' FROM region
UNION ALL SELECT 'full' || n_nationkey, '172.16.' || n_nationkey || '.2' FROM nation""")
def next_free_address(spark, d):
    reg = R.registry(spark, d)
    part = F.regexp_extract("mgmt_ip", r"^(\d+\.\d+\.\d+)", 1)
    nation, region = R.table(spark, d, "nation"), R.table(spark, d, "region")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    subnets = (
        nation.select(R._text("10.", F.col("n_regionkey"), ".", n).alias("subnet"),
                      R._text("10.", F.col("n_regionkey"), ".", n, ".0").alias("first"), F.lit(24).alias("prefix"))
        .unionByName(region.select(R._text("r", r).alias("subnet"), R._text("10.", r, ".0.252").alias("first"),
                                   F.lit(30).alias("prefix")))
        .unionByName(nation.select(R._text("full", n).alias("subnet"), R._text("172.16.", n, ".0").alias("first"),
                                   F.lit(29).alias("prefix"))))
    ips = lambda *hosts: F.explode(F.array(*[R._text("172.16.", n, f".{h}") for h in hosts]))
    used = (
        reg.filter("name NOT LIKE 'r%'").select(part.alias("subnet"), "mgmt_ip")
        .unionByName(region.select(R._text("r", r).alias("subnet"), R._text("10.", r, ".0.254").alias("mgmt_ip")))
        .unionByName(nation.select(R._text("full", n).alias("subnet"), ips(1, 7, 3, "x").alias("mgmt_ip"))))
    return TP.next_free_address(subnets, used)


@register("bulk_additions", "WITH " + R.REGISTRY + """,
prop AS (SELECT c_custkey AS k, 's' || (c_custkey + 1000) AS name FROM customer),
names AS (SELECT DISTINCT upper(name) AS n FROM registry)
SELECT name, 'conflict' AS outcome, 'device ' || name || ' is already there' AS note, NULL::BIGINT AS n_fields FROM prop
WHERE upper(name) IN (SELECT n FROM names)
UNION ALL SELECT name, 'added', 'new switch', 4 + (k % 2 = 0)::INT FROM prop
WHERE upper(name) NOT IN (SELECT n FROM names)""")
def bulk_additions(spark, d):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    proposed = R.table(spark, d, "customer").select(
        R._text("s", k + 1000).alias("name"), F.lit("switch").alias("type"), F.lit("ssh").alias("protocol"),
        R._text("10.9.0.", k % 250).alias("mgmt_ip"), F.when(k % 2 == 0, "R0").otherwise("").alias("parent_device"),
        none.alias("parent_interface"), none.alias("link_mode"))
    added, conflicts = TP.add_devices(proposed, R.registry(spark, d))
    return conflicts.select("name", F.lit("conflict").alias("outcome"), F.col("error").alias("note"),
                            F.lit(None).cast("bigint").alias("n_fields")).unionByName(
        added.select("name", F.lit("added").alias("outcome"), F.col("fields")["description"].alias("note"),
                     F.size("fields").cast("bigint").alias("n_fields")))


# --- history


@register("history_search", "WITH " + R.HISTORY + """,
st AS (SELECT *, CASE WHEN status = 'pending' THEN 'pending' WHEN is_error THEN 'error' ELSE 'done' END AS state FROM history)
SELECT id, state, 'done' AS search FROM st WHERE state = 'done' AND (contains(lower(question), 'the') OR contains(lower(answer), 'the'))
UNION ALL SELECT id, state, 'audit' FROM st WHERE health_report_requested""")
def history_search(spark, d):
    rows = R.history(spark, d)
    return HI.search_history(rows, " The ", "done").select("id", "state", F.lit("done").alias("search")).unionByName(
        HI.search_history(rows, audits_only=True).select("id", "state", F.lit("audit").alias("search")))


@register("history_upsert", "WITH " + R.HISTORY + """,
patched AS (SELECT id, user_key, created_at, CASE WHEN conv_id % 7 = 0 THEN 'patched' ELSE answer END AS answer,
  CASE WHEN conv_id % 7 = 0 THEN 'done' ELSE status END AS status FROM history)
SELECT id, user_key, answer, status, row_number() OVER (PARTITION BY user_key ORDER BY created_at DESC, id DESC) AS rank
FROM patched QUALIFY rank <= 20""")
def history_upsert(spark, d):
    rows = R.history(spark, d)
    conv = F.split("id", "-")[0].cast("bigint")
    patches = rows.filter(conv % 7 == 0).select(
        "id", F.lit("patched").alias("answer"), F.lit("done").alias("status"), F.lit(None).cast("boolean").alias("is_error"))
    return HI.upsert_history(rows.filter(conv % 2 == 0), rows.filter(conv % 2 == 1), patches).select(
        "id", "user_key", "answer", "status", "rank")


@register("dashboard", "WITH " + R.MANIFEST + "," + R.HISTORY + "," + R.REACHABILITY + """
SELECT (SELECT count(*) FROM manifest) AS documents, (SELECT sum(chunks_indexed)::BIGINT FROM manifest) AS total_chunks,
  (SELECT count(*) FROM history WHERE health_report_requested) AS reports, (SELECT count(*) FROM history) AS conversations,
  (SELECT count(*) FROM history WHERE is_error) AS errors, count(*) FILTER (reachable) AS devices_reachable,
  count(*) AS devices_total, floor(count(*) FILTER (reachable) / count(*) * 100 + 0.5)::INT || '%' AS conformity,
  CASE WHEN count(*) FILTER (reachable) / count(*) >= 0.95 THEN 'live' WHEN bool_or(reachable) THEN 'warn' ELSE 'neutral' END
    AS conformity_tone,
  CASE WHEN (SELECT bool_or(is_error) FROM history) THEN 'warn' END AS conversation_tone FROM reach""")
def dashboard(spark, d):
    talk = R.history(spark, d)
    return HI.dashboard(R.manifest(spark, d), talk.filter("health_report_requested"), talk, R.reachability(spark, d))


@register("dashboard_recent", "WITH " + R.HISTORY + """
(SELECT 'activity' AS list, id FROM history ORDER BY created_at DESC, id DESC LIMIT 5)
UNION ALL (SELECT 'report', id FROM history WHERE health_report_requested ORDER BY created_at DESC, id DESC LIMIT 3)""")
def dashboard_recent(spark, d):
    talk = R.history(spark, d)
    return HI.recent(talk, "created_at", "id", 5).select(F.lit("activity").alias("list"), "id").unionByName(
        HI.recent(talk.filter("health_report_requested"), "created_at", "id", 3).select(F.lit("report").alias("list"), "id"))


@register("document_list", "WITH " + R.MANIFEST + """
SELECT filename, ingested_at, chunks_indexed FROM manifest WHERE contains(filename, '_1') ORDER BY chunks_indexed DESC, filename""")
def document_list(spark, d):
    return HI.document_list(R.manifest(spark, d), " DOC_1", "chunks").select("filename", "ingested_at", "chunks_indexed")


@register("document_total", "WITH " + R.MANIFEST + " SELECT sum(chunks_indexed)::BIGINT AS total_chunks FROM manifest")
def document_total(spark, d):
    return HI.total_chunks(R.manifest(spark, d))


# --- streams and their batch forms

SAMPLES = """WITH sam AS (SELECT user_id AS device, ts, event_id, round(value % 100, 2) AS cpu, round((value * 7) % 100, 2) AS memory,
  event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'collection failed: ' || event_id END AS error FROM events)"""
NEWEST = SAMPLES + """
SELECT device, event_id, cpu, memory, row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) AS rank
FROM (SELECT *, max(ts) OVER (PARTITION BY device) AS latest FROM sam WHERE ok)
WHERE ts >= latest - INTERVAL {seconds} SECONDS QUALIFY rank <= {keep}"""
DAYS = 2 * 86400


def samples(spark, d):
    return ST.samples_of(R.table(spark, d, "events"))


@register("sample_history", NEWEST.format(seconds=600, keep=40))
def sample_history(spark, d):
    return ST.newest_samples(samples(spark, d).filter("ok")).select("device", "event_id", "cpu", "memory", "rank")


@register("sample_history_stream", NEWEST.format(seconds=DAYS, keep=3))
def sample_history_stream(spark, d):
    """The keyed stream with a wide window and a short list, so that both limits bite."""
    stream = ST.samples_of(ST.event_stream(spark, d)).filter("ok")
    updates = ST.run_to_table(ST.sample_history(stream, seconds=DAYS, keep=3), "update", "history")
    return ST.merge_history(updates, seconds=DAYS, keep=3).select("device", "event_id", "cpu", "memory", "rank")


def trend_sql(source):
    return SAMPLES + f"""
SELECT w AS window_start, device, count(*) AS n, round(avg(cpu), 4) AS avg_cpu, max(cpu) AS max_cpu, round(avg(memory), 4)
  AS avg_memory, max(memory) AS max_memory, max(cpu) > 70 AS cpu_warn, max(memory) > 80 AS memory_warn FROM ({source})
GROUP BY ALL"""


SLIDING = """SELECT *, time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(15 * k) AS w FROM sam CROSS JOIN range(4) r(k)"""
TUMBLING = "SELECT *, date_trunc('hour', ts) AS w FROM sam"


@register("load_trend", trend_sql(TUMBLING))
def load_trend(spark, d):
    return ST.trend(samples(spark, d))


@register("load_trend_sliding", trend_sql(SLIDING))
def load_trend_sliding(spark, d):
    return ST.trend(samples(spark, d), "1 hour", "15 minutes")


@register("load_trend_stream", trend_sql(TUMBLING))
def load_trend_stream(spark, d):
    stream = ST.samples_of(ST.event_stream(spark, d)).withWatermark("ts", "10 minutes")
    return ST.latest_rows(ST.run_to_table(ST.trend(stream), "update", "trend"), ["window_start", "device"])


STATUS = SAMPLES + """,
good AS (SELECT device, ts, cpu, memory FROM sam WHERE ok QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) = 1),
last AS (SELECT device, error FROM sam QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) = 1)
SELECT device, g.ts AS last_good_at, cpu, memory, error AS status_error FROM last LEFT JOIN good g USING (device)"""


@register("last_status", STATUS)
def last_status(spark, d):
    return ST.last_status(samples(spark, d))


@register("last_status_stream", STATUS)
def last_status_stream(spark, d):
    stream = ST.samples_of(ST.event_stream(spark, d))
    return ST.latest_rows(ST.run_to_table(ST.last_status(stream), "update", "status"), ["device"])


@register("alert_stream", "WITH " + R.CAPTURE + FLEET + " SELECT device_name, alert FROM quick")
def alert_stream(spark, d):
    """Alerts of snapshots arriving as a stream of session texts."""
    sessions = R.sessions_from(ST.event_stream(spark, d, "documents"))
    arriving = TM.assemble(TM.outputs_map(sessions))
    return ST.run_to_table(ST.alert_stream(arriving), "append", "alerts").select("device_name", "alert")


@register("ingest_stream", CHUNKS + """
SELECT source_file AS filename, count(*) AS chunks_indexed FROM chunks GROUP BY source_file""")
def ingest_stream(spark, d):
    """Documents arriving as a stream of blocks, images with their captions."""
    return IN.run_ingest(R.blocks_from(ST.event_stream(spark, d, "documents")), R.captions(spark, d))[1].select(
        "filename", "chunks_indexed")

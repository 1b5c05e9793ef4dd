"""Registered queries over manuals and captures: expectations, gaps, alerts, reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import fixed as K
from wiretally.functions.text import strip
from wiretally.operators import compliance as CO, context as CX, expectations as EX, telemetry as TM
from wiretally.plans import recipes as R, search_queries as SQ
from wiretally.plans.telemetry_queries import FLEET, SUMMARY, data as captured
from wiretally.session import written

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


W = "WITH " + R.MANUAL


def data(spark, d, **kw):
    """Assembled captures, each with the manual it is checked against."""
    return captured(spark, d, **kw).withColumn(
        "source_file", F.concat(F.lit("doc_"), F.expr("substring(device_name, 2)"), F.lit(".pdf")))


def snapshots(spark, d):
    return R.snapshots(spark, d).withColumn(
        "source_file", F.concat(F.lit("doc_"), F.expr("substring(device_name, 2)"), F.lit(".pdf")))


@register("device_names", W + """,
raw AS (SELECT device_name AS n, device_name AS want FROM dv UNION ALL SELECT lower(device_name) || '-gw-x', device_name FROM dv
  UNION ALL SELECT 'LSW' || (doc_id % 4), CASE doc_id % 4 WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' ELSE 'LSW' || (doc_id % 4) END FROM dv)
SELECT n AS raw_name, want AS device FROM raw""")
def device_names(spark, d):
    names = R.sessions(spark, d).select("device_name", F.substring("device_name", 2, 20).cast("bigint").alias("i"))
    raw = F.array("device_name", F.concat(F.lower("device_name"), F.lit("-gw-x")), R._text("LSW", F.col("i") % 4))
    return names.select(F.explode(raw).alias("raw_name")).withColumn("device", EX.normal_name(F.col("raw_name")))


@register("expected_vlans", W + " SELECT source_file, device, vlan::BIGINT AS vlan FROM evl")
def expected_vlans(spark, d):
    return EX.expected_vlans(R.manual(spark, d)).withColumn("vlan", F.col("vlan").cast("bigint"))


@register("expected_routes", W + " SELECT source_file, line_no, device, network, mask, next_hop FROM ert")
def expected_routes(spark, d):
    return EX.expected_routes(R.manual(spark, d))


@register("expected_host_names", W + " SELECT source_file, device, host_name FROM ehn")
def expected_host_names(spark, d):
    return EX.expected_host_names(R.manual(spark, d))


@register("expected_interfaces", W + " SELECT source_file, device, interface FROM eif")
def expected_interfaces(spark, d):
    return EX.expected_interfaces(R.manual(spark, d))


def switch_manual(spark, d):
    """Manual with lines that start with a switch name, which open the blocks."""
    head = F.regexp_extract("line", r"^Equipement (\S+)", 1)
    return R.manual(spark, d).withColumn(
        "line", F.when(head != "", F.concat(F.lit("S"), F.expr("line_no % 3"), F.lit(" "), F.col("line")))
        .otherwise(F.col("line")))


@register("manual_device_blocks", W + """,
sm AS (SELECT source_file, line_no, CASE WHEN kind = 'dev' THEN 'S' || (line_no % 3) || ' ' || line ELSE line END AS line,
  kind FROM man),
blk AS (SELECT *, max(CASE WHEN kind = 'dev' THEN line_no END) OVER (PARTITION BY source_file ORDER BY line_no) AS block FROM sm),
dev AS (SELECT source_file, 'S' || (block % 3) AS device, max(block) AS block FROM blk GROUP BY source_file, 'S' || (block % 3))
SELECT source_file, device, 0::BIGINT AS part_no, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY line_no) AS text
FROM blk JOIN dev USING (source_file, block) GROUP BY source_file, device""")
def manual_device_blocks(spark, d):
    return EX.manual_blocks(switch_manual(spark, d))


GAPS = W + """,
rvl AS (SELECT DISTINCT source_file, device_name AS device, id::INT AS vlan FROM vla JOIN dsrc USING (device_name) WHERE id <> '1'),
cmp AS (SELECT coalesce(e.source_file, r.source_file) AS source_file, coalesce(e.device, r.device) AS device,
    coalesce(e.vlan, r.vlan) AS vlan, CASE WHEN r.vlan IS NULL THEN 'missing' ELSE 'extra' END AS kind
  FROM evl e FULL OUTER JOIN (SELECT * FROM rvl WHERE (source_file, device) IN (SELECT (source_file, device) FROM evl)) r
    ON e.source_file = r.source_file AND e.device = r.device AND e.vlan = r.vlan
  WHERE e.vlan IS NULL OR r.vlan IS NULL),
vgap AS (SELECT source_file, device, kind, string_agg(vlan::VARCHAR, ', ' ORDER BY vlan) AS vlans, CASE kind WHEN 'missing'
  THEN device || ' : VLANs [' || string_agg(vlan::VARCHAR, ', ' ORDER BY vlan) || '] are documented and not configured.' || chr(10)
    || '   Fix: [' || device || '] vlan batch '
    || string_agg(vlan::VARCHAR, ' ' ORDER BY vlan)
  ELSE device || ' : VLANs [' || string_agg(vlan::VARCHAR, ', ' ORDER BY vlan) || '] are configured and '
    || 'not documented.' END AS discrepancy FROM cmp GROUP BY source_file, device, kind),
hgap AS (SELECT source_file, device, device || '-OLD' AS real_name, host_name,
  device || ' : Hostname differs.' || chr(10) || '   documented: ''' || host_name || '''' || chr(10)
  || '   configured: ''' || device || '-OLD''' || chr(10) || '   Fix: [' || device || '-OLD] sysname '
  || host_name AS discrepancy FROM ehn JOIN dsrc USING (source_file) WHERE doc_id % 4 = 1),
dwn AS (SELECT source_file, itf.device_name AS device, j, name AS interface FROM itf JOIN dsrc USING (device_name)
  WHERE contains(phy_state, 'down')),
mtext AS (SELECT source_file, string_agg(lower(line), chr(10) ORDER BY line_no) AS t FROM man GROUP BY source_file),
igap AS (SELECT source_file, device, interface, device || ' : Interface ' || interface
  || ' is down; the documents name it.' AS discrepancy
  FROM dwn JOIN mtext USING (source_file) WHERE contains(t, lower(interface))),
rtext AS (SELECT device_name AS device, string_agg(destination || ' ' || nexthop, chr(10)) AS t FROM rou GROUP BY device_name),
rgap AS (SELECT source_file, ert.device, network, mask, next_hop, ert.device || ' : Route ' || network || '/' || mask
  || ' through ' || next_hop || ' is documented and not in the routing table.' || chr(10) || '   Fix: [' || ert.device
  || '] ip route-static ' || network || ' ' || mask || ' ' || next_hop AS discrepancy
  FROM ert JOIN dsrc USING (source_file) JOIN rtext ON rtext.device = ert.device
  WHERE ert.device = dsrc.device_name AND NOT contains(t, network)),
gap AS (SELECT source_file, device, 'vlan' AS rule, discrepancy FROM vgap UNION ALL SELECT source_file, device, 'hostname',
  discrepancy FROM hgap UNION ALL SELECT source_file, device, 'interface', discrepancy FROM igap
  UNION ALL SELECT source_file, device, 'route', discrepancy FROM rgap)"""


#: Outputs that the gaps read as text; all other sections are read parsed.
READ_AS_TEXT = ("display current-configuration", "display ip routing-table")


def read_once(spark, d):
    """Captures and manual lines as gaps and alerts read them: rendered, split and parsed once, then stored."""
    texts = F.map_filter("outputs", lambda command, _: command.isin(*READ_AS_TEXT))
    parsed = data(spark, d, keep_outputs=True).select(
        "source_file", "device_name", "interfaces", "vlans", "ospf_peers", "cpu_usage", texts.alias("outputs"))
    return written(parsed, "captures"), written(R.manual(spark, d), "manual")


def vlan_gaps(full, manual):
    return CO.vlan_gap(EX.expected_vlans(manual), CO.real_vlans(full))


def host_name_gaps(full, manual):
    return CO.host_name_gap(EX.expected_host_names(manual), full)


def route_gaps(full, manual):
    return CO.missing_routes(EX.expected_routes(manual), full)


def gaps(full, manual):
    return CO.all_discrepancies(vlan_gaps(full, manual), host_name_gaps(full, manual), CO.documented_but_down(full, manual),
                                route_gaps(full, manual))


@register("vlan_gap", GAPS + " SELECT source_file, device, kind, vlans, discrepancy FROM vgap")
def vlan_gap(spark, d):
    return vlan_gaps(data(spark, d), R.manual(spark, d)).withColumn(
        "vlans", F.array_join(F.transform("vlans", lambda v: v.cast("string")), ", "))


@register("host_name_gap", GAPS + " SELECT source_file, device, real_name, host_name, discrepancy FROM hgap")
def host_name_gap(spark, d):
    return host_name_gaps(snapshots(spark, d), R.manual(spark, d))


@register("documented_interface_down", GAPS + " SELECT source_file, device, interface, discrepancy FROM igap")
def documented_interface_down(spark, d):
    return CO.documented_but_down(written(data(spark, d).select("source_file", "device_name", "interfaces"), "captures"),
                                  R.manual(spark, d))


@register("missing_static_routes", GAPS + " SELECT source_file, device, network, mask, next_hop, discrepancy FROM rgap")
def missing_static_routes(spark, d):
    return route_gaps(snapshots(spark, d), R.manual(spark, d))


# --- alerts

ALERTS = GAPS + """,
flag AS (SELECT source_file, bool_or(trim(line) <> '') AS has_ref, bool_or(contains(lower(line), 'ospf')) AS osp_doc FROM man
  GROUP BY source_file),
dlist AS (SELECT d.source_file, d.device, count(*) AS n, count(e.interface) AS n_crit,
    array_to_string(list(d.interface ORDER BY j)[1:5], ', ') AS first5,
    string_agg(d.interface, ', ' ORDER BY j) FILTER (e.interface IS NOT NULL) AS crit,
    array_to_string((list(d.interface ORDER BY j) FILTER (e.interface IS NULL))[1:5], ', ') AS free5
  FROM dwn d LEFT JOIN eif e ON e.source_file = d.source_file AND e.device = d.device AND e.interface = d.interface GROUP BY ALL),
ex AS (SELECT DISTINCT source_file, device FROM eif),
dinfo AS (SELECT dl.*, ex.device IS NULL AND coalesce(has_ref, false) AS blind FROM dlist dl LEFT JOIN ex USING (source_file, device)
  LEFT JOIN flag USING (source_file)),
alert AS (
  SELECT source_file, met.device_name AS device, 1::BIGINT AS ord, 'warning' AS severity, 'performance' AS category,
    'CPU load of ' || met.device_name || ' at ' || printf('%.1f', cpu) || '%' AS message, '' AS detail
    FROM met JOIN dsrc USING (device_name) WHERE cpu > 70
  UNION ALL SELECT source_file, device, 2, 'critical', 'anomaly', 'Interfaces DOWN on ' || device
    || ' (nothing documented to compare with)', 'Named: ' || first5 FROM dinfo WHERE blind
  UNION ALL SELECT source_file, device, 3, 'critical', 'anomaly', 'Interfaces DOWN on ' || device
    || ' that the documents need', 'Named: ' || crit FROM dinfo WHERE NOT blind AND n_crit > 0
  UNION ALL SELECT source_file, device, 4, 'info', 'info', (n - n_crit) || ' DOWN on ' || device
    || ' that no document names', 'Named: ' || free5 FROM dinfo WHERE NOT blind AND n > n_crit
  UNION ALL SELECT source_file, device_name, 5, 'critical', 'anomaly', 'OSPF neighbours of ' || device_name,
    'Not full: [' || string_agg('''' || router_id || '''', ', ' ORDER BY j) || ']' FROM osp JOIN dsrc USING (device_name)
    WHERE NOT contains(lower(state), 'full') GROUP BY source_file, device_name)"""


def alerts(full, manual):
    return CO.device_alerts(full, EX.expected_interfaces(manual), CO.reference_flags(manual))


@register("device_alerts", ALERTS + " SELECT source_file, device, ord, severity, category, message, detail FROM alert")
def device_alerts(spark, d):
    return alerts(*read_once(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))


@register("alert_texts", ALERTS + """
SELECT device, ord, CASE severity WHEN 'info' THEN 'informative' ELSE 'actionable' END AS report_group,
  CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟡' ELSE '🔵' END || ' [' || upper(severity) || '] ' || message
  || chr(10) || '   device: ' || device || CASE WHEN detail <> '' THEN chr(10) || '   detail: ' || detail ELSE '' END
  AS text FROM alert""")
def alert_texts(spark, d):
    return CO.split_alerts(alerts(*read_once(spark, d))).select("device", F.col("ord").cast("bigint").alias("ord"), "report_group", "text")


FACTS = W + """,
nb AS (SELECT device_name, count(*) AS n, count(*) FILTER (contains(lower(state), 'full')) AS ok FROM osp GROUP BY ALL),
bb AS (SELECT device_name, count(*) AS n, count(*) FILTER (contains(lower(state), 'established')) AS ok FROM bgp GROUP BY ALL),
vv AS (SELECT device_name, string_agg(interface || ' group ' || vrid || ' is ' || state, ', ' ORDER BY j) AS t
  FROM vrr GROUP BY ALL),
ss AS (SELECT device_name, count(*) AS n, count(*) FILTER (state = 'FORWARDING') AS f FROM stp GROUP BY ALL),
ll AS (SELECT device_name, count(*) AS n, array_to_string(list(neighbor_device ORDER BY j)[1:3], ', ') AS t FROM lld GROUP BY ALL),
f0 AS (
  SELECT device_name, 'OSPF' AS protocol, CASE WHEN doc_id % 2 = 0 THEN 'OSPF runs as process 1: ' || ok
    || ' in state FULL' || CASE WHEN n > ok THEN ', ' || (n - ok) || ' not in FULL' ELSE '' END || '.'
    ELSE 'OSPF does not run.' END AS f FROM dv JOIN nb USING (device_name)
  UNION ALL SELECT device_name, 'BGP', CASE WHEN doc_id % 5 = 0 THEN 'BGP runs in AS 65001: ' || ok
    || ' in state ESTABLISHED' || CASE WHEN n > ok THEN ', ' || (n - ok) || ' not in ESTABLISHED' ELSE '' END
    || '.' ELSE 'BGP does not run.' END FROM dv JOIN bb USING (device_name)
  UNION ALL SELECT device_name, 'VRRP', 'VRRP: ' || t || '.' FROM vv
  UNION ALL SELECT device_name, p, p || ' ports: ' || n || ' listed, ' || f || ' forwarding.' FROM ss
    CROSS JOIN (VALUES ('STP'), ('RSTP'), ('MSTP')) v(p)
  UNION ALL SELECT device_name, 'LLDP', 'LLDP neighbours: ' || n || ' found (' || t || ').' FROM ll
  UNION ALL SELECT device_name, 'DHCP', CASE WHEN doc_id % 7 = 0 THEN 'DHCP is named in the '
    || 'configuration.' ELSE 'DHCP is not named in the configuration.' END FROM dv
  UNION ALL SELECT device_name, p, p || ' is not named in the configuration.' FROM dv
    CROSS JOIN (VALUES ('RIP'), ('ACL')) v(p)
  UNION ALL SELECT device_name, p, p || ' has no rule.' FROM dv CROSS JOIN (VALUES ('LACP'), ('VLAN'), ('VRP'), ('SNMP'), ('SSH'), ('TELNET'),
    ('NAT'), ('QOS'), ('MPLS')) v(p)),
fact AS (SELECT device_name, protocol, device_name || ' : ' || f AS fact FROM f0)"""


#: Protocols each question mentions, and the registered devices it names.
MENTIONED = f""",
{R.FIELD_QUESTIONS},
qword AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(upper(question), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM asked),
qdev AS (SELECT question_id, device_name FROM qword JOIN dv ON w = device_name WHERE doc_id % 11 <> 10),
qfact AS (SELECT question_id, device_name, protocol, fact FROM qdev JOIN fact USING (device_name)
  JOIN qword USING (question_id) WHERE w = protocol)"""


@register("protocol_facts", FACTS + " SELECT device_name, protocol, fact FROM fact")
def protocol_facts(spark, d):
    """What every captured device says on every protocol; ``final_answer`` takes the named devices and mentioned protocols."""
    return CO.protocol_facts(data(spark, d, keep_outputs=True), list(K.PROTOCOLS))


# --- per question: each benchmark question consults two captured devices


def consulted(spark, d):
    i = F.col("item_id") * 7
    name = lambda x: F.concat(F.when(x % 3 == 0, "R").otherwise("S"), x.cast("string"))
    return R.table(spark, d, "benchmark").select(
        F.col("item_id").alias("question_id"), F.explode(F.array(name(i), name(i + 1))).alias("device_name")
    ).join(R.sessions(spark, d).select("device_name"), "device_name", "left_semi")


CONSULTED = """,
con AS (SELECT question_id, device_name FROM (SELECT item_id AS question_id,
  unnest([item_id * 7, item_id * 7 + 1]) AS doc_id FROM benchmark) JOIN dv USING (doc_id))"""


def doc_results(spark, d):
    """Hits with bounded scores: cosine results above a floor, so some questions have few."""
    return SQ.doc_dense(spark, d, 5).filter("score >= 0.6").select(
        F.col("item_id").alias("question_id"), "doc_id", "score", "rank")


QUALITY = SQ.DENSE_DOCS + """,
res AS (SELECT item_id AS question_id, doc_id, score FROM (SELECT * FROM cosine
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5) WHERE score >= 0.6),
qst AS (SELECT item_id AS question_id, count(score) AS n, coalesce(avg(score), 0.0) AS mean FROM benchmark LEFT JOIN res
  ON question_id = item_id GROUP BY item_id),
qual AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, mean * n / 3) END AS quality,
  CASE WHEN n = 0 THEN 1::BIGINT ELSE 0 END + CASE WHEN n = 1 THEN 1 ELSE 0 END + CASE WHEN n > 0 AND mean < 0.35 THEN 1 ELSE 0 END
    AS n_alerts, CASE WHEN n = 0 OR mean < 0.35 THEN 1 ELSE 0 END AS n_warn FROM qst)"""


def quality(spark, d):
    questions = R.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    return CO.retrieval_quality(questions, doc_results(spark, d))


@register("retrieval_quality", "WITH " + QUALITY + """
SELECT question_id, n AS n_chunks, round(mean, 6) AS mean_score, round(quality, 6) AS quality, n_alerts,
  CASE WHEN n = 0 THEN 'The search found nothing' WHEN n = 1 THEN 'Results found: 1' END AS first_alert
FROM qual""")
def retrieval_quality(spark, d):
    return quality(spark, d).select(
        "question_id", F.col("n_chunks").cast("bigint").alias("n_chunks"), F.round("mean_score", 6).alias("mean_score"),
        F.round("quality", 6).alias("quality"), F.size("alerts").cast("bigint").alias("n_alerts"),
        F.get("alerts", F.lit(0))["message"].alias("first_alert"))


SUM = ALERTS + CONSULTED + "," + QUALITY + """,
da AS (SELECT device, count(*) AS a, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w
  FROM alert GROUP BY device),
dg AS (SELECT device, count(*) AS g FROM gap GROUP BY device),
agg AS (SELECT question_id, count(*) AS devices, sum(coalesce(a, 0)) AS a, sum(coalesce(c, 0)) AS c, sum(coalesce(w, 0)) AS w,
  sum(coalesce(g, 0)) AS g FROM con LEFT JOIN da ON da.device = device_name LEFT JOIN dg ON dg.device = device_name GROUP BY ALL),
total AS (SELECT question_id, quality, n AS n_chunks, coalesce(devices, 0) AS devices_checked,
  (coalesce(a, 0) + n_alerts)::BIGINT AS alerts_count, coalesce(c, 0) AS criticals, coalesce(w, 0) + n_warn AS warnings,
  coalesce(g, 0)::BIGINT AS discrepancies FROM qual LEFT JOIN agg USING (question_id)),
conf AS (SELECT *, round(greatest(0.0, least(1.0, quality + CASE WHEN devices_checked > 0 THEN 0.2 ELSE 0 END
  - 0.1 * criticals - 0.05 * warnings - 0.05 * discrepancies)), 9)::DOUBLE AS score FROM total),
lvl AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM conf)"""


def summary(spark, d):
    read = read_once(spark, d)
    return CO.question_summary(quality(spark, d), consulted(spark, d), alerts(*read), gaps(*read))


@register("confidence", SUM + """
SELECT question_id, round(score, 6) AS confidence_score, level AS confidence FROM lvl""")
def confidence(spark, d):
    return CO.confidence(summary(spark, d)).select(
        "question_id", F.round("confidence_score", 6).alias("confidence_score"), "confidence")


@register("validation_rollup", SUM + """
SELECT question_id, round(quality, 2) AS rag_quality, n_chunks AS rag_chunks, devices_checked, alerts_count, discrepancies FROM lvl""")
def validation_rollup(spark, d):
    return CO.validation_rollup(summary(spark, d))


@register("recommendations", SUM + """
SELECT question_id, 0::BIGINT AS stage, device, 'Look at the links of ' || device || '' AS advice
  FROM con JOIN alert ON device = device_name WHERE severity = 'critical' AND contains(message, 'DOWN')
UNION ALL SELECT question_id, 0, device, 'Mend the OSPF neighbours of ' || device || ''
  FROM con JOIN alert ON device = device_name WHERE severity = 'critical' AND contains(message, 'OSPF')
UNION ALL SELECT question_id, 0, device, 'Watch the CPU load of ' || device FROM con JOIN alert ON device = device_name
  WHERE contains(message, 'CPU')
UNION ALL SELECT DISTINCT question_id, 1, '', 'Create the missing VLANs and look at the port modes'
  FROM con JOIN gap ON device = device_name WHERE contains(discrepancy, 'VLAN')
UNION ALL SELECT DISTINCT question_id, 2, '', 'Set the documented host names' FROM con
  JOIN gap ON device = device_name WHERE contains(discrepancy, 'Hostname')
UNION ALL SELECT question_id, 3, '', 'Index more documents' FROM lvl WHERE level = 'low'""")
def recommendations(spark, d):
    read = read_once(spark, d)
    found, warned = written(gaps(*read), "gaps"), written(alerts(*read), "alerts")
    asked = consulted(spark, d)
    confident = CO.confidence(CO.question_summary(quality(spark, d), asked, warned, found))
    return CO.recommendations(asked, warned, found, confident).withColumn("stage", F.col("stage").cast("bigint"))


@register("corrective_commands", GAPS + """
SELECT source_file, rule, CASE rule WHEN 'hostname' THEN device || '-OLD' ELSE device END AS device,
  trim(split_part(discrepancy, '] ', CASE rule WHEN 'vlan' THEN 3 ELSE 2 END)) AS command, 'pending' AS status
FROM gap WHERE contains(discrepancy, 'Fix:')""")
def corrective_commands(spark, d):
    return CO.corrective_commands(gaps(*read_once(spark, d))).select(
        "source_file", "rule", "device", "command", "status")


@register("remediation_counts", GAPS + """
SELECT count(*) FILTER (contains(discrepancy, 'Fix:')) AS pending, 0::BIGINT AS applied FROM gap""")
def remediation_counts(spark, d):
    return CO.remediation_counts(CO.corrective_commands(gaps(*read_once(spark, d))))


@register("audit_report", SUMMARY + FLEET + """,
al AS (SELECT device_name, string_agg(alert, chr(10) ORDER BY o) AS t FROM quick GROUP BY device_name)
SELECT device_name, '# Audit of ' || device_name || chr(10) || chr(10) || '## Collected' || chr(10)
  || summary || chr(10) || chr(10) || '## Documented' || chr(10) || 'Manuel doc_'
  || substr(device_name, 2) || '.pdf' || chr(10) || chr(10) || '## To look at' || chr(10)
  || 'VLANs against the documents' || chr(10) || 'links against the plan' || chr(10)
  || 'OSPF neighbours and routes' || chr(10) || 'CPU and memory load'
  || coalesce(chr(10) || chr(10) || '## Alerts' || chr(10) || t, '') AS report
FROM summary LEFT JOIN al USING (device_name)""")
def audit_report(spark, d):
    full = data(spark, d)
    lines = TM.summary_lines(full.withColumn("quick", TM.quick_alerts()))
    return CO.audit_report(lines, F.concat(F.lit("Manuel "), F.col("source_file")), F.col("quick"))


FINAL = ALERTS + "," + FACTS[len(W) + 1:] + MENTIONED + f""",
qctx AS (SELECT * FROM ({SQ.FIELD_FANOUT + SQ.SHOWN + SQ.FIELD_CONTEXT} SELECT * FROM qparts))"""


@register("final_answer", FINAL + """
SELECT question_id, 0::BIGINT AS section, '' AS device, 0::BIGINT AS ord, 'Question: ' || question || chr(10) AS text FROM asked
UNION ALL SELECT question_id, 1, name, ord, CASE part WHEN 0 THEN '## Search results' || chr(10) ELSE '' END || text FROM qctx
UNION ALL SELECT question_id, 2, device, ord, CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟡' ELSE '🔵' END
  || ' [' || upper(severity) || '] ' || message || chr(10) || '   device: ' || device
  || CASE WHEN detail <> '' THEN chr(10) || '   detail: ' || detail ELSE '' END FROM qdev JOIN alert ON device = device_name
UNION ALL SELECT question_id, 3, device_name, 0, '  . ' || fact FROM qfact
UNION ALL SELECT question_id, 4, device, 0, '  ⚠ ' || discrepancy FROM qdev JOIN gap ON device = device_name""")
def final_answer(spark, d):
    """Question, retrieved context, alerts, facts on the mentioned protocols and gaps: all of the question's own devices."""
    plans = SQ.field_plans(spark, d)
    asked = SQ.field_devices(plans)
    context = SQ.full_context(spark, d, plans, SQ.stored_passages(spark, d))
    facts = CO.mentioned_facts(data(spark, d, devices=asked, keep_outputs=True), asked)
    read = read_once(spark, d)
    found, warned = written(gaps(*read), "gaps"), written(alerts(*read), "alerts")
    rows = CO.final_answer(plans.select("question_id", "question"), context, asked, warned, facts, found)
    return rows.withColumn("section", F.col("section").cast("bigint")).withColumn("ord", F.col("ord").cast("bigint"))

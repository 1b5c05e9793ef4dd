"""Registered queries over the question log."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import fixed as K
from wiretally.functions.rows import unfold
from wiretally.operators import planning as P
from wiretally.plans import recipes as R

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _quoted(words):
    return ["'" + w.replace("'", "''") + "'" for w in words]


def _any_sql(column, words):
    return "(" + " OR ".join(f"contains({column}, {w})" for w in _quoted(words)) + ")"


def _values(rows):
    def one(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("{vendor}", K.VENDOR).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


INTENT_SQL = "CASE " + " ".join(
    f"WHEN {_any_sql('lower(question)', words)} THEN '{name}'" for name, words in K.INTENT_RULES
) + " ELSE 'unknown' END"
STRATEGY_SQL = """CASE WHEN intent IN ('diagnostic', 'optimization', 'health_report', 'design_update') THEN 'hybrid'
  WHEN intent = 'status_check' AND n_dev > 0 THEN 'device_only' WHEN intent = 'status_check' THEN 'hybrid'
  WHEN intent IN ('configuration', 'comparison') AND n_dev > 0 THEN 'hybrid' WHEN intent = 'audit' THEN 'comparison'
  ELSE 'rag_only' END"""
LIVE_SQL = "intent IN ('diagnostic', 'optimization', 'health_report', 'status_check')"
SCHEMA_SQL = _any_sql("lower(question)", K.SCHEMA_WORDS)


def plan_ctes(asked, registry=R.REGISTRY):
    """Question attributes as relations: rules are joined, not evaluated in place."""
    return f"""WITH {registry}, {asked},
base AS (SELECT *, {INTENT_SQL} AS intent FROM asked),
word AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(upper(question), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM asked),
known AS (SELECT DISTINCT question_id, w AS device FROM word JOIN (SELECT DISTINCT upper(name) AS w FROM registry) USING (w)),
loose AS (SELECT DISTINCT question_id, w AS device FROM word WHERE regexp_full_match(w, '[SR][0-9]+')
  AND question_id NOT IN (SELECT question_id FROM known)),
device AS (SELECT *, true AS registered FROM known UNION ALL SELECT *, false FROM loose),
dev AS (SELECT question_id, count(*) AS n_dev FROM device GROUP BY ALL),
proto AS (SELECT question_id, ord, p FROM word JOIN {_values([(i, p) for i, p in enumerate(K.PROTOCOLS)])} v(ord, p)
  ON w = p),
vl AS (SELECT question_id, 'VLAN' || unnest(regexp_extract_all(question, '(?i)VLAN\\s*(\\d+)', 1)) AS v,
  unnest(range(len(regexp_extract_all(question, '(?i)VLAN\\s*(\\d+)', 1)))) AS pos FROM asked),
vlan AS (SELECT question_id, v, min(pos) AS pos FROM vl GROUP BY ALL),
ifc AS (SELECT question_id, unnest(regexp_extract_all(question,
  '(?i)(?:GigabitEthernet|GE|FastEthernet|FE|Ethernet|Vlanif|Eth-Trunk|LoopBack)\\s*[\\d/.]+')) AS i,
  unnest(range(len(regexp_extract_all(question,
  '(?i)(?:GigabitEthernet|GE|FastEthernet|FE|Ethernet|Vlanif|Eth-Trunk|LoopBack)\\s*[\\d/.]+')))) AS pos FROM asked),
iface AS (SELECT question_id, i, min(pos) AS pos FROM ifc GROUP BY ALL),
plan AS (SELECT b.*, coalesce(n_dev, 0) AS n_dev, {STRATEGY_SQL} AS strategy,
  EXISTS (SELECT 1 FROM known k WHERE k.question_id = b.question_id) AS has_known
  FROM base b LEFT JOIN dev USING (question_id)),
rules(intent, trigger, ord, text) AS (SELECT * FROM {_values(
    [(i, p, n, t) for p, by in K.PROTOCOL_QUERIES.items() for i, ts in by.items() for n, t in enumerate(ts)]
    + [(i, '#vlan', n, t) for i, ts in K.VLAN_QUERIES.items() for n, t in enumerate(ts)]
    + [(i, '#iface', n, t) for i, ts in K.INTERFACE_QUERIES.items() for n, t in enumerate(ts)]
    + [(i, '#intent', n, t) for i, ts in K.INTENT_QUERIES.items() for n, t in enumerate(ts)])}),
context(ord, word, n, text) AS (SELECT * FROM {_values(
    [(o, w, n, t) for o, (w, ts) in enumerate(K.CONTEXT_QUERIES) for n, t in enumerate(ts)])}),
raw AS (
  SELECT question_id, 1 AS grp, proto.ord AS a, rules.ord AS b, text FROM base JOIN proto USING (question_id)
    JOIN rules ON trigger = p AND rules.intent = base.intent
  UNION ALL SELECT question_id, 2, pos, 0, '{K.VENDOR} ' || v || ' configuration' FROM base JOIN vlan USING (question_id)
    WHERE intent = 'configuration'
  UNION ALL SELECT DISTINCT question_id, 2, 0, rules.ord, text FROM base JOIN vlan USING (question_id)
    JOIN rules ON trigger = '#vlan' AND rules.intent = base.intent
  UNION ALL SELECT DISTINCT question_id, 3, 0, rules.ord, text FROM base JOIN iface USING (question_id)
    JOIN rules ON trigger = '#iface' AND rules.intent = base.intent
  UNION ALL SELECT question_id, 4, ord, n, text FROM base JOIN context ON contains(lower(question), word)
  UNION ALL SELECT question_id, 5, 0, rules.ord, text FROM base JOIN rules ON trigger = '#intent' AND rules.intent = base.intent),
filled AS (SELECT * FROM raw UNION ALL
  SELECT question_id, 6, 0, n, t FROM base CROSS JOIN {_values(list(enumerate(K.DEFAULT_QUERIES)))} d(n, t)
  WHERE question_id NOT IN (SELECT question_id FROM raw)),
once AS (SELECT question_id, text, min(grp * 1000000 + a * 1000 + b) AS o FROM filled GROUP BY ALL),
sub AS (SELECT question_id, text, row_number() OVER (PARTITION BY question_id ORDER BY o) AS n FROM once
  QUALIFY n <= 6),
first_two AS (SELECT upper(name) AS device FROM registry ORDER BY 1 LIMIT 2),
target AS (SELECT question_id, device, row_number() OVER (PARTITION BY question_id ORDER BY device) AS dn FROM (
  SELECT question_id, device FROM known
  UNION ALL SELECT question_id, device FROM plan CROSS JOIN first_two
    WHERE NOT has_known AND strategy IN ('hybrid', 'device_only', 'comparison')) QUALIFY dn <= 2),
proto_two AS (SELECT question_id, p, row_number() OVER (PARTITION BY question_id ORDER BY ord) AS pn FROM proto
  QUALIFY pn <= 2),
audit AS (
  SELECT question_id, dn * 100 + n AS o, device || t AS text FROM plan JOIN target USING (question_id)
    CROSS JOIN {_values([(n, t.removeprefix('{d}')) for n, t in enumerate(K.AUDIT_QUERIES)])} q(n, t) WHERE {LIVE_SQL}
  UNION ALL SELECT question_id, 1000 + pn * 100, '{K.VENDOR} ' || p || ' configuration manuel exigences' FROM proto_two
  UNION ALL SELECT question_id, 1000 + pn * 100 + dn, device || ' ' || p || ' état configuration'
    FROM proto_two JOIN target USING (question_id)),
enriched AS (SELECT question_id, question || CASE WHEN contains(lower(question), lower('{K.VENDOR}')) THEN '' ELSE ' {K.VENDOR} VRP' END
  || CASE WHEN {_any_sql('lower(question)', K.NETWORK_WORDS)} THEN '' ELSE ' network configuration' END AS text FROM asked),
variants AS (
  SELECT question_id, text AS variant_text, row_number() OVER (PARTITION BY question_id ORDER BY part, o) - 1 AS ordinal
  FROM (SELECT question_id, text, 0 AS part, 0 AS o FROM enriched
    UNION ALL SELECT question_id, text, 1, n FROM sub WHERE n <= 3
    UNION ALL SELECT question_id, text, 2, o FROM audit))"""


TYPES_SQL = _values([(i, ",".join(t)) for i, t in K.CHUNK_TYPES.items()])
PLAN = plan_ctes(R.QUESTIONS)


def plans(spark, d):
    return P.plan_questions(R.question_log(spark, d), R.registry(spark, d))


@register("intent_classification", PLAN + " SELECT question_id, intent FROM base")
def intent_classification(spark, d):
    return R.question_log(spark, d).select("question_id", P.intent(F.col("question")).alias("intent"))


_HEALTH = _any_sql("lower(question)", K.HEALTH_WORDS)


@register("health_override", PLAN + f"""
SELECT question_id, CASE WHEN {_HEALTH} THEN 'health_report' ELSE intent END AS intent,
  CASE WHEN {_HEALTH} AND intent <> 'health_report' THEN 'hybrid' ELSE strategy END AS strategy,
  {LIVE_SQL} OR {_HEALTH} AS needs_live FROM plan""")
def health_override(spark, d):
    base = plans(spark, d)
    intent, strategy, live = P.health_override(
        F.col("question"), F.col("intent"), F.col("strategy"), F.col("needs_live"))
    return base.select("question_id", intent.alias("intent"), strategy.alias("strategy"), live.alias("needs_live"))


@register("entity_extraction", PLAN + """
SELECT question_id,
  coalesce((SELECT string_agg(device, ',' ORDER BY device) FROM device d WHERE d.question_id = a.question_id), '') AS devices,
  coalesce((SELECT string_agg(v, ',' ORDER BY pos) FROM vlan d WHERE d.question_id = a.question_id), '') AS vlans,
  coalesce((SELECT string_agg(p, ',' ORDER BY ord) FROM proto d WHERE d.question_id = a.question_id), '') AS protos,
  coalesce((SELECT string_agg(i, ',' ORDER BY pos) FROM iface d WHERE d.question_id = a.question_id), '') AS ifaces
FROM asked a""")
def entity_extraction(spark, d):
    found = P.extract_entities(R.question_log(spark, d), R.registry(spark, d))
    return found.select(
        "question_id", F.array_join(F.array_sort("devices"), ",").alias("devices"),
        F.array_join("vlans", ",").alias("vlans"), F.array_join("protos", ",").alias("protos"),
        F.array_join("ifaces", ",").alias("ifaces"))


# Proposals of a model: right names, unregistered names, uncited names, loose VLAN forms.
@register("entity_validation", f"""WITH {R.REGISTRY}, {R.QUESTIONS},
prop AS (SELECT question_id, question, 's' || (c_custkey + 1000) AS d1, 'S' || c_nationkey AS d2, c_nationkey AS v
  FROM asked JOIN customer ON question_id = c_custkey),
names AS (SELECT DISTINCT upper(name) AS n FROM registry),
flags AS (SELECT *, upper(d1) IN (SELECT n FROM names) AS r1, upper(d2) IN (SELECT n FROM names) AS r2,
  list_contains(regexp_extract_all(upper(question), '[\\p{{L}}\\p{{N}}_]+'), upper(d1)) AS c1,
  list_contains(regexp_extract_all(upper(question), '[\\p{{L}}\\p{{N}}_]+'), upper(d2)) AS c2 FROM prop)
SELECT question_id,
  concat_ws(',', CASE WHEN r1 AND c1 THEN upper(d1) END, CASE WHEN r2 AND c2 AND upper(d2) <> upper(d1) THEN upper(d2) END)
    AS mentioned_devices,
  'VLAN' || v AS mentioned_vlans,
  trim(CASE WHEN r1 AND NOT c1 THEN '' ELSE d1 || ' ' END || CASE WHEN r2 AND NOT c2 THEN '' ELSE d2 || ' ' END
    || 'configuration VRP') AS enriched_query
FROM flags""")
def entity_validation(spark, d):
    customer = R.table(spark, d, "customer")
    k, v = F.col("c_custkey"), F.col("c_nationkey")
    d1, d2 = R._text("s", k + 1000), R._text("S", v)
    proposals = R.question_log(spark, d).join(customer, F.col("question_id") == k).select(
        "question_id", "question", F.array(d1, d2, d1).alias("proposed_devices"),
        F.array(R._text("vlan ", v), R._text("VLAN", v), R._text("Vlanif", v)).alias("proposed_vlans"),
        F.concat_ws("  ", d1, d2, F.lit("configuration VRP")).alias("enriched_query"))
    return P.validate_entities(proposals, R.registry(spark, d)).select(
        "question_id", F.array_join("mentioned_devices", ",").alias("mentioned_devices"),
        F.array_join("mentioned_vlans", ",").alias("mentioned_vlans"), "enriched_query")


@register("strategy_decision", PLAN + """
SELECT question_id, strategy, CASE WHEN has_known THEN 'named'
  WHEN strategy IN ('hybrid', 'device_only', 'comparison') THEN 'all' ELSE 'none' END AS target_scope,
  coalesce((SELECT string_agg(device, ',' ORDER BY device) FROM target t WHERE t.question_id = p.question_id), '')
    AS first_targets
FROM plan p""")
def strategy_decision(spark, d):
    return plans(spark, d).select(
        "question_id", "strategy", "target_scope",
        F.coalesce(F.array_join(F.slice("targets", 1, 2), ","), F.lit("")).alias("first_targets"))


@register("plan_attributes", PLAN + f""",
types(intent, kinds) AS (SELECT * FROM {TYPES_SQL})
SELECT question_id, kinds || CASE WHEN {SCHEMA_SQL} AND NOT contains(kinds, 'image_desc') THEN ',image_desc' ELSE '' END
    AS chunk_types,
  {LIVE_SQL} AS needs_live, {SCHEMA_SQL} OR contains(kinds, 'image_desc') AS needs_images,
  CASE WHEN length(question) < 50 THEN 'low' WHEN length(question) > 150 THEN 'high' ELSE 'medium' END AS complexity,
  CASE WHEN {LIVE_SQL} THEN 5::BIGINT ELSE 3 END AS estimated_sources
FROM plan JOIN types USING (intent)""")
def plan_attributes(spark, d):
    return plans(spark, d).select(
        "question_id", F.array_join("chunk_types", ",").alias("chunk_types"), "needs_live", "needs_images",
        "complexity", "estimated_sources")


@register("query_enrichment", PLAN + " SELECT question_id, text AS enriched_query FROM enriched")
def query_enrichment(spark, d):
    return R.question_log(spark, d).select("question_id", P.enrich(F.col("question")).alias("enriched_query"))


@register("sub_queries", PLAN + " SELECT question_id, n, text AS sub_query FROM sub")
def sub_queries(spark, d):
    return unfold(plans(spark, d), ["question_id"], "sub_queries", "sub_query", "n").withColumn(
        "n", F.col("n").cast("bigint") + 1)


@register("audit_expansion", PLAN + """
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY o) AS n, text AS audit_query FROM audit""")
def audit_expansion(spark, d):
    return unfold(plans(spark, d), ["question_id"], "audit_queries", "audit_query", "n").withColumn(
        "n", F.col("n").cast("bigint") + 1)


@register("referenced_document", PLAN + f""", {R.MANIFEST}
SELECT question_id, coalesce(nullif(regexp_extract(question, '(?i)([\\p{{L}}\\p{{N}}_\\-]+\\.pdf)', 1), ''),
  CASE WHEN {LIVE_SQL} OR strategy IN ('hybrid', 'comparison', 'rag_only')
    THEN (SELECT filename FROM manifest ORDER BY ingested_at DESC, filename DESC LIMIT 1) END) AS referenced_file
FROM plan""")
def referenced_document(spark, d):
    return P.referenced_document(plans(spark, d), R.manifest(spark, d)).select("question_id", "referenced_file")

"""Query-log analytics: intent, entities, strategy, enrichment, expansion.

Rules are expressions over one question row. Only device names need a join: the
registry grows with the network, so names are matched by equality on their first
word instead of trying every name on every question.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.functions import fixed as K
from wiretally.functions.rows import unfold
from wiretally.functions.text import all_matches, contains_any, let, lookup, strip


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def intent(question: Column) -> Column:
    """First rule with a keyword inside the lower-cased question."""
    q = F.lower(question)
    chain = F.lit("unknown")
    for name, words in reversed(K.INTENT_RULES):
        chain = F.when(contains_any(q, words), name).otherwise(chain)
    return chain


def health_override(question: Column, found: Column, strategy: Column, live: Column) -> list[Column]:
    """Intent, strategy and live flag after the health keywords had their say."""
    forced = contains_any(F.lower(question), K.HEALTH_WORDS) & (found != "health_report")
    return [
        F.when(forced, "health_report").otherwise(found),
        F.when(forced, "hybrid").otherwise(strategy),
        F.when(forced, True).otherwise(live),
    ]


def whole_word(text: Column, name: Column) -> Column:
    """True where the name stands in the text with word borders at both ends; both in upper case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b")))


def known_devices(questions: DataFrame, registry: DataFrame, key: str, text: str) -> DataFrame:
    """(key, known): registry names that occur as whole words, in name order.

    A name is found by its first run of word characters, then the whole name,
    blanks and other characters included, is looked for in the text.
    """
    first = F.regexp_extract("_name", r"(?U)\w+", 0)
    names = registry.select(F.upper("name").alias("_name")).distinct().withColumn("_first", first).filter(F.col("_first") != "")
    words = F.array_distinct(all_matches(F.upper(F.col(text)), r"(?U)\w+"))
    maybe = unfold(questions, [key], words, "_first").join(names, "_first").groupBy(key).agg(F.collect_set("_name").alias("_maybe"))
    return (
        questions.select(key, F.upper(F.col(text)).alias("_upper")).join(maybe, key)
        .groupBy(key).agg(F.max(F.struct("_upper", "_maybe")).alias("_q"))
        .select(key, F.array_sort(F.filter("_q._maybe", lambda n: whole_word(F.col("_q._upper"), n))).alias("known"))
        .filter(F.size("known") > 0)
    )


def protocols(question: Column) -> Column:
    return F.filter(
        F.array(*[F.when(F.regexp_like(question, F.lit(rf"(?iU)\b{p}\b")), p) for p in K.PROTOCOLS]),
        lambda x: x.isNotNull(),
    )


def extract_entities(questions: DataFrame, registry: DataFrame, key: str = "question_id") -> DataFrame:
    """Append devices, vlans, protos and ifaces, each without duplicates."""
    q = F.col("question")
    pattern = F.array_distinct(F.transform(all_matches(q, r"(?iU)\b([SR]\d+)\b", 1), F.upper))
    return (
        questions.join(known_devices(questions, registry, key, "question"), key, "left")
        .withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        .withColumn("devices", F.when(F.size("known") > 0, F.col("known")).otherwise(pattern))
        .withColumn("vlans", F.array_distinct(
            F.transform(all_matches(q, r"(?i)VLAN\s*(\d+)", 1), lambda m: F.concat(F.lit("VLAN"), m))))
        .withColumn("protos", protocols(q))
        .withColumn("ifaces", F.array_distinct(all_matches(q, K.QUESTION_INTERFACE)))
    )


def validate_entities(proposals: DataFrame, registry: DataFrame, key: str = "question_id") -> DataFrame:
    """Check entities proposed by a model against registry and question.

    Input columns: question, enriched_query, proposed_devices, proposed_vlans.
    Devices stay if registered and literally cited; VLAN strings are normalised;
    names of registered but uncited devices are removed from the enriched text.
    """
    names = registry.select(F.upper("name").alias("_name")).distinct()
    cited = F.filter("proposed_devices", lambda d: whole_word(F.upper("question"), F.upper(d)))
    valid = (
        unfold(proposals, [key], cited, "_raw", "_pos")
        .withColumn("_name", F.upper("_raw"))
        .join(names, "_name", "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_v"))
        .select(key, F.array_distinct(F.transform("_v", lambda x: x["_name"])).alias("mentioned_devices"))
    )
    foreign = (
        known_devices(proposals, registry, key, "enriched_query").withColumnRenamed("known", "_found")
        .join(known_devices(proposals, registry, key, "question"), key, "left")
        .select(key, F.array_except("_found", F.coalesce("known", F.array().cast("array<string>"))).alias("_foreign"))
    )
    none = F.array().cast("array<string>")
    vlan = lambda v: F.when(
        F.regexp_like(v, F.lit(r"(?i)VLAN\s*\d+")),
        F.concat(F.lit("VLAN"), F.regexp_extract(v, r"(?i)VLAN\s*(\d+)", 1)),
    )
    cleaned = F.aggregate(
        "_foreign", F.col("enriched_query"),
        lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?iU)\b\Q"), n, F.lit(r"\E\b")), F.lit("")),
    )
    return (
        proposals.join(valid, key, "left").join(foreign, key, "left")
        .withColumn("mentioned_devices", F.coalesce("mentioned_devices", none))
        .withColumn("_foreign", F.coalesce("_foreign", none))
        .withColumn("mentioned_vlans", F.array_distinct(
            F.filter(F.transform("proposed_vlans", vlan), lambda x: x.isNotNull())))
        .withColumn("enriched_query", strip(F.regexp_replace(cleaned, r"(?U)\s+", " ")))
        .drop("_foreign")
    )


def strategy(found: Column, has_devices: Column) -> Column:
    return (
        F.when(found.isin("diagnostic", "optimization", "health_report", "design_update"), "hybrid")
        .when(found == "status_check", F.when(has_devices, "device_only").otherwise("hybrid"))
        .when(found.isin("configuration", "comparison"), F.when(has_devices, "hybrid").otherwise("rag_only"))
        .when(found == "audit", "comparison")
        .otherwise("rag_only")
    )


def chunk_types(question: Column, found: Column) -> Column:
    types = lookup(K.CHUNK_TYPES, found)
    wanted = contains_any(F.lower(question), K.SCHEMA_WORDS) & ~F.array_contains(types, "image_desc")
    return F.when(wanted, F.concat(types, lit_array(["image_desc"]))).otherwise(types)


def complexity(question: Column) -> Column:
    n = F.length(question)
    return F.when(n < 50, "low").when(n > 150, "high").otherwise("medium")


def branded(texts, vendor: str):
    """Search texts, or a table of them, with the vendor's name filled in."""
    if isinstance(texts, dict):
        return {k: branded(v, vendor) for k, v in texts.items()}
    return tuple(t.replace("{vendor}", vendor) for t in texts)


def enrich(question: Column, vendor: str = K.VENDOR) -> Column:
    q = F.lower(question)
    return F.concat_ws(
        " ", question,
        F.when(~q.contains(vendor.lower()), f"{vendor} VRP"),
        F.when(~contains_any(q, K.NETWORK_WORDS), "network configuration"),
    )


PROTOCOL_TABLE = {f"{p} {i}": texts for p, by in K.PROTOCOL_QUERIES.items() for i, texts in by.items()}


def sub_queries(question: Column, found: Column, protos: Column, vlans: Column, ifaces: Column, vendor: str = K.VENDOR) -> Column:
    """Ordered, distinct search texts for a question, six at most."""
    none = F.array().cast("array<string>")
    for_vlans = F.when(
        found == "configuration",
        F.transform(vlans, lambda v: F.concat(F.lit(f"{vendor} "), v, F.lit(" configuration"))),
    ).otherwise(F.when(F.size(vlans) > 0, lookup(branded(K.VLAN_QUERIES, vendor), found)).otherwise(none))
    q = F.lower(question)
    context = [F.when(q.contains(w), lit_array(branded(texts, vendor))).otherwise(none) for w, texts in K.CONTEXT_QUERIES]
    gathered = F.array_distinct(F.concat(
        F.flatten(F.transform(protos, lambda p: lookup(branded(PROTOCOL_TABLE, vendor), F.concat_ws(" ", p, found)))),
        for_vlans,
        F.when(F.size(ifaces) > 0, lookup(branded(K.INTERFACE_QUERIES, vendor), found)).otherwise(none),
        *context,
        lookup(branded(K.INTENT_QUERIES, vendor), found),
    ))
    return let(gathered, lambda g: F.slice(
        F.when(F.size(g) > 0, g).otherwise(lit_array(branded(K.DEFAULT_QUERIES, vendor))), 1, K.MAX_SUB_QUERIES))


def audit_queries(targets: Column, protos: Column, live: Column, vendor: str = K.VENDOR) -> Column:
    """Extra searches: per target device when live data is needed, and per protocol."""
    first = F.slice(targets, 1, 2)
    per_device = F.flatten(F.transform(
        first, lambda d: F.array(*[F.concat(d, F.lit(t.removeprefix("{d}"))) for t in K.AUDIT_QUERIES])))
    per_protocol = F.flatten(F.transform(
        F.slice(protos, 1, 2),
        lambda p: F.concat(
            F.array(F.concat(F.lit(f"{vendor} "), p, F.lit(" configuration manuel exigences"))),
            F.transform(first, lambda d: F.concat_ws(" ", d, p, F.lit("état configuration"))),
        )))
    return F.concat(F.when(live, per_device).otherwise(F.array().cast("array<string>")), per_protocol)


def plan_questions(questions: DataFrame, registry: DataFrame, key: str = "question_id", vendor: str = K.VENDOR) -> DataFrame:
    """One plan row per question.

    A plan that concerns every device says so in ``target_scope``; the device
    list itself is not copied into each question. ``targets`` then holds the two
    first names, which is all that the search expansion uses.
    """
    first_two = (
        registry.select(F.upper("name").alias("_n")).distinct().orderBy("_n").limit(2)
        .agg(F.array_sort(F.collect_list("_n"))).scalar()
    )
    q, found = F.col("question"), F.col("intent")
    planned = (
        extract_entities(questions.withColumn("intent", intent(F.col("question"))), registry, key)
        .withColumn("strategy", strategy(found, F.size("devices") > 0))
        .withColumn("target_scope", F.when(F.size("known") > 0, "named").when(
            F.col("strategy").isin("hybrid", "device_only", "comparison"), "all").otherwise("none"))
        .withColumn("targets", F.when(F.col("target_scope") == "all", first_two).otherwise(F.col("known")))
        .withColumn("chunk_types", chunk_types(q, found))
        .withColumn("needs_live", found.isin(*K.LIVE_INTENTS))
        .withColumn("needs_images", F.array_contains("chunk_types", "image_desc"))
        .withColumn("complexity", complexity(q))
        .withColumn("estimated_sources", F.when(F.col("needs_live"), 5).otherwise(3).cast("bigint"))
        .withColumn("enriched_query", enrich(q, vendor))
        .withColumn("sub_queries", sub_queries(q, found, F.col("protos"), F.col("vlans"), F.col("ifaces"), vendor))
    )
    return planned.withColumn("audit_queries", audit_queries(F.col("targets"), F.col("protos"), F.col("needs_live"), vendor))


def query_variants(plans: DataFrame, key: str = "question_id", keep=()) -> DataFrame:
    """(key, *keep, ordinal, variant_text): enriched text, three sub-queries, expansions."""
    texts = F.concat(F.array("enriched_query"), F.slice("sub_queries", 1, 3), F.col("audit_queries"))
    return unfold(plans, [key, *keep], texts, "variant_text", "ordinal").withColumn(
        "ordinal", F.col("ordinal").cast("bigint"))


def referenced_document(plans: DataFrame, manifest: DataFrame) -> DataFrame:
    """File named in the question, else the latest upload where the plan wants one."""
    named = F.nullif(F.regexp_extract("question", r"(?iU)([\w\-]+\.pdf)", 1), F.lit(""))
    latest = manifest.agg(F.max(F.struct("ingested_at", "filename"))["filename"]).scalar()
    wants = F.col("needs_live") | F.col("strategy").isin("hybrid", "comparison", "rag_only")
    return plans.withColumn("referenced_file", F.coalesce(named, F.when(wants, latest)))

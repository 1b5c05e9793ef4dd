"""Conversation history, document list and dashboard figures."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiretally.functions import fixed as K
from wiretally.functions.ranking import top_k

SHOWN_ENTRIES = 6


def with_state(history: DataFrame) -> DataFrame:
    return history.withColumn("state", F.when(F.col("status") == "pending", "pending").when(
        F.coalesce("is_error", F.lit(False)), "error").otherwise("done"))


def search_history(history: DataFrame, text: str = "", state: str = "all", audits_only: bool = False) -> DataFrame:
    found = with_state(history)
    if state != "all":
        found = found.filter(F.col("state") == state)
    if audits_only:
        found = found.filter("health_report_requested")
    q = text.strip().lower()
    return found.filter(F.lower("question").contains(q) | F.lower("answer").contains(q))


def upsert_history(history: DataFrame, added: DataFrame, patches: DataFrame, cap: int = K.HISTORY_CAP) -> DataFrame:
    """New entries, then patches by id, then the newest ``cap`` entries per user.

    ``patches`` has an id and nullable answer, status and is_error, and may have
    ``patched_at``. Of several patches for an id the latest counts (the greatest
    where no time is given), so an id stays one row.
    """
    columns = ("answer", "status", "is_error")
    when = [F.col("patched_at")] if "patched_at" in patches.columns else []
    latest = patches.groupBy("id").agg(F.max(F.struct(*when, *columns)).alias("_p"))
    both = history.unionByName(added).join(
        latest.select("id", *[F.col(f"_p.{c}").alias(f"_{c}") for c in columns]), "id", "left")
    for c in columns:
        both = both.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return top_k(both, ["user_key"], [F.desc("created_at"), F.desc("id")], cap)


def dashboard(files: DataFrame, reports: DataFrame, history: DataFrame, reachability: DataFrame) -> DataFrame:
    """One row of figures; every part is one aggregate."""
    ratio = F.when(F.col("devices_total") > 0, F.col("devices_reachable") / F.col("devices_total")).otherwise(0.0)
    reach = reachability.agg(F.count_if("reachable").alias("r"), F.count(F.lit(1)).alias("t"))
    talk = history.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("e"))
    base = files.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks_indexed"), F.lit(0)).alias("total_chunks"))
    return (
        base.withColumn("reports", reports.agg(F.count(F.lit(1))).scalar())
        .withColumn("conversations", talk.select("n").scalar())
        .withColumn("errors", talk.select("e").scalar())
        .withColumn("devices_reachable", reach.select("r").scalar())
        .withColumn("devices_total", reach.select("t").scalar())
        .withColumn("conformity", F.when(F.col("devices_total") > 0, F.concat(
            F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%"))).otherwise("N/A"))
        .withColumn("conformity_tone", F.when(ratio >= 0.95, "live").when(ratio > 0, "warn").otherwise("neutral"))
        .withColumn("conversation_tone", F.when(F.col("errors") > 0, "warn"))
    )


def recent(rows: DataFrame, time_col: str, id_col: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(time_col), F.desc(id_col)).limit(n)


SORTS = {
    "recent": [F.desc, "ingested_at"], "oldest": [F.asc, "ingested_at"], "name": [F.asc, "filename"],
    "chunks": [F.desc, "chunks_indexed"],
}


def document_list(files: DataFrame, text: str = "", sort: str = "recent") -> DataFrame:
    direction, column = SORTS[sort]
    found = files.filter(F.lower("filename").contains(text.strip().lower()))
    key = F.coalesce(column, F.lit(0)) if column == "chunks_indexed" else F.col(column)
    return found.orderBy(direction(key), F.asc("filename"))


def total_chunks(files: DataFrame) -> DataFrame:
    return files.agg(F.sum(F.coalesce("chunks_indexed", F.lit(0))).alias("total_chunks"))

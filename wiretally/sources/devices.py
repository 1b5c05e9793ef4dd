"""Readers and writers for device exports, registry and snapshots."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wiretally.functions import fixed as K
from wiretally.functions.text import base_name, strip
from wiretally.operators.telemetry import split_session, summary_lines
from wiretally.session import written

# Fixed defaults of the registry.
PORT, TELNET_PORT, TIMEOUT, PROTOCOL = 22, 23, 30, "ssh"
TYPE, MGMT_INTERFACE = "switch", "Vlanif1"


def read_export_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, content): each export file as one value."""
    return (
        spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
                F.col("value").alias("content"))
    )


def export_outputs(files: DataFrame) -> DataFrame:
    """(device_name, outputs) from export files.

    A full session file wins over per-command files, and those over a plain
    configuration file. Where several files give one command of a device, the one
    modified last counts, then the one with the greatest path.
    """
    name = F.regexp_replace(base_name(F.col("path")), r"\.txt$", "")
    kinds = "|".join(K.EXPORT_SUFFIXES)
    suffix = F.regexp_extract(name, rf"_(full|{kinds})$", 1)
    pairs = []
    for s, c in K.EXPORT_SUFFIXES.items():
        pairs += [F.lit(s), F.lit(c)]
    command = F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit("display current-configuration"))
    single = F.when(suffix == "", F.col("content")).otherwise(strip(F.col("content")))
    entries = F.when(suffix == "full", split_session(F.col("content"))).otherwise(
        F.array(F.struct(command.alias("command"), single.alias("output"))))
    modified = F.col("modified") if "modified" in files.columns else F.lit(None).cast("timestamp")
    rows = files.select(
        F.struct(modified.alias("modified"), "path").alias("version"),
        F.upper(F.regexp_replace(name, rf"_(full|{kinds})$", "")).alias("device_name"),
        F.when(suffix == "full", 0).when(suffix != "", 1).otherwise(2).alias("priority"), entries.alias("entries"))
    best = rows.groupBy("device_name").agg(F.min("priority").alias("priority"))
    newest = (
        rows.join(best, ["device_name", "priority"]).select("device_name", "version", F.explode("entries").alias("e"))
        .groupBy("device_name", "e.command").agg(F.max_by("e.output", "version").alias("output"))
    )
    return newest.groupBy("device_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("command", "output")))).alias("outputs"))


def complete_registry(devices: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Registry rows with names in upper case and defaults filled in. Access data has no default: null where neither row nor ``defaults`` gives it."""
    d = {"username": None, "password": None, "port": PORT, "timeout": TIMEOUT, "protocol": PROTOCOL, **(defaults or {})}
    held = lambda c, kind="string": F.col(c) if c in devices.columns else F.lit(None).cast(kind)
    protocol = F.lower(F.coalesce(held("protocol"), F.lit(d["protocol"])))
    return devices.select(
        F.upper("name").alias("name"),
        F.lower(F.coalesce(held("type"), F.lit(TYPE))).alias("type"),
        "mgmt_ip",
        F.coalesce(held("mgmt_interface"), F.lit(MGMT_INTERFACE)).alias("mgmt_interface"),
        F.coalesce(held("username"), F.lit(d["username"]).cast("string")).alias("username"),
        F.coalesce(held("password"), F.lit(d["password"]).cast("string")).alias("password"),
        F.coalesce(held("port", "int"), F.when(protocol == "telnet", TELNET_PORT).otherwise(d["port"]))
        .cast("bigint").alias("port"),
        F.coalesce(held("timeout", "int"), F.lit(d["timeout"])).cast("bigint").alias("timeout"),
        protocol.alias("protocol"),
        F.coalesce(held("description"), F.lit("")).alias("description"),
    )


SNAPSHOT_FIELDS = (
    "device_name", "device_type", "mgmt_ip", "access_mode", "collected_at", "version_info", "interfaces", "vlans",
    "routes", "ospf_peers", "stp_ports", "bgp_peers", "vrrp_groups", "lldp_neighbors", "cpu_usage", "memory_usage",
    "errors", "is_complete",
)


def write_snapshots(data: DataFrame, path: str) -> None:
    """Snapshots as JSON objects of 18 fields, and the text overview beside them. Both read a stored table, so that texts are parsed once."""
    held = written(data.select(*SNAPSHOT_FIELDS), "snapshots")
    held.write.mode("overwrite").json(f"{path}/json")
    summary_lines(held).select("device_name", F.array_join("summary", "\n").alias("summary")).write.mode(
        "overwrite").parquet(f"{path}/summary")


def read_snapshots(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.select(*SNAPSHOT_FIELDS).schema).json(f"{path}/json")

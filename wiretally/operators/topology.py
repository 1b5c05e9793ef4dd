"""Device hierarchy, reachability and address planning."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.session import checkpointed


def _parents(devices: DataFrame) -> DataFrame:
    """(node, parent, ordinal, kind): parent is null where it is not a known device."""
    nodes = devices.select(
        F.upper("name").alias("node"), F.upper("parent_device").alias("_p"), "ordinal",
        F.when(F.lower("type") == "router", "router").otherwise("switch").alias("kind"))
    known = nodes.select(F.col("node").alias("_p"), F.col("node").alias("parent"))
    return nodes.join(known, "_p", "left").drop("_p")


def flatten_tree(devices: DataFrame) -> DataFrame:
    """Rows (node, kind, parent, depth, path): sorting by path gives the pre-order.

    The root is the first router, else the first device without a valid parent,
    else the first; orphans hang below it. Each round doubles the length of the
    known chain above a node, so a chain of depth n takes log2(n) rounds, each a
    join on the node name. Nodes on or below a cycle never reach the root; they
    are left when a round resolves nothing, and are dropped.
    """
    linked = _parents(devices)
    rank = F.when(F.col("kind") == "router", 0).when(F.col("parent").isNull(), 1).otherwise(2)
    first = linked.agg(
        F.min(F.struct(rank.alias("r"), "ordinal", "node")).alias("f"), F.max(F.length(F.col("ordinal").cast("string"))).alias("w")).first()
    if first["f"] is None:
        return linked.select("node", "kind", "parent", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("path"))
    width = max(12, first["w"])
    root, root_path = F.lit(first["f"]["node"]), F.lit(str(first["f"]["ordinal"]).rjust(width, "0") + "/")
    own = F.lpad(F.col("ordinal").cast("string"), width, "0")
    # what hangs below the root is known without a join, however much it is
    state = checkpointed(
        linked.select("node", "kind", F.when(F.col("node") != root, F.coalesce("parent", root)).alias("parent"), own.alias("path"))
        .select(
            "node", "kind", "parent", F.when(F.col("parent") != root, F.col("parent")).alias("above"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
            F.when(F.col("parent") == root, F.concat(root_path, "path")).otherwise(F.col("path")).alias("path")))
    open_before = state.filter("above IS NOT NULL").count()
    while open_before:
        step = state.select(F.col("node").alias("above"), F.col("above").alias("_above"), F.col("depth").alias("_depth"),
                            F.col("path").alias("_path"))
        moved = state.filter("above IS NOT NULL").join(step, "above").select(
            "node", "kind", "parent", F.col("_above").alias("above"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.concat_ws("/", "_path", "path").alias("path"))
        state = checkpointed(state.filter("above IS NULL").unionByName(moved))
        left = state.filter("above IS NOT NULL").count()
        if left >= open_before:
            break
        open_before = left
    return state.filter("above IS NULL").select("node", "kind", "parent", F.col("depth").cast("bigint").alias("depth"),
                                                "path")


def _filled(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def node_state(devices: DataFrame, reachability: DataFrame) -> DataFrame:
    """State and role label of each node. ``reachability`` is (name, reachable)."""
    role = _filled("description", "parent_interface", "mgmt_interface", "type")
    both = _filled("parent_interface").isNotNull() & _filled("link_mode").isNotNull()
    return devices.join(reachability, "name", "left").select(
        "name",
        F.when(F.col("reachable"), "online").when(~F.col("reachable"), "offline").otherwise("warning").alias("state"),
        F.when(both, F.concat_ws(" · ", role, "parent_interface", "link_mode")).otherwise(role).alias("role"),
        F.when(F.lower("type") == "router", "router").otherwise("switch").alias("kind"))


def reachability_summary(reachability: DataFrame, services_ok: bool = True) -> DataFrame:
    reach, total = F.col("reachable"), F.col("total")
    return reachability.agg(F.count_if("reachable").alias("reachable"), F.count(F.lit(1)).alias("total")).select(
        "reachable", "total",
        F.when(total > 0, F.round(reach / total, 6)).otherwise(0.0).alias("ratio"),
        F.when((total > 0) & (reach == total), "all devices answer")
        .when(total > 0, F.concat(reach.cast("string"), F.lit("/"), total.cast("string"),
                                  F.lit(" devices answer")))
        .otherwise("no device known").alias("label"),
        F.lit("ok" if services_ok else "degraded").alias("status"))


def address_number(ip: Column) -> Column:
    """Dotted quad as a number; null when it is not a valid address."""
    octets = F.transform(F.split(ip, r"\.", -1), lambda x: F.when(
        F.regexp_like(x, F.lit(r"^(?:0|[1-9]\d{0,2})$")), x.cast("bigint")))
    good = (F.size(octets) == 4) & ~F.exists(octets, lambda x: x.isNull() | (x > 255))
    return F.when(good, F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))


def address_text(number: Column) -> Column:
    part = lambda s: (F.shiftright(number, s) % 256).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def next_free_address(subnets: DataFrame, devices: DataFrame) -> DataFrame:
    """Per subnet (first, prefix): highest used address plus one, else the first gap.

    ``devices`` is (subnet, mgmt_ip). Gaps are found by an anti-join of successors
    with the used addresses, so a crowded subnet is spread over many tasks.
    """
    size = F.pow(F.lit(2.0), 32 - F.col("prefix")).cast("bigint")
    bounds = subnets.withColumn("_low", address_number(F.col("first"))).withColumn("_high", F.col("_low") + size - 1)
    used = (
        devices.select("subnet", address_number(F.col("mgmt_ip")).alias("a")).filter(F.col("a").isNotNull())
        .join(bounds, "subnet").filter(F.col("a").between(F.col("_low"), F.col("_high"))).select("subnet", "a").distinct()
    )
    top = used.groupBy("subnet").agg(F.max("a").alias("_top"))
    candidates = used.select("subnet", (F.col("a") + 1).alias("a")).unionByName(
        bounds.select("subnet", (F.col("_low") + 1).alias("a"))).distinct()
    gaps = (
        candidates.join(used, ["subnet", "a"], "left_anti").join(bounds, "subnet")
        .filter((F.col("a") > F.col("_low")) & (F.col("a") < F.col("_high")))
        .groupBy("subnet").agg(F.min("a").alias("_gap"))
    )
    after = F.when(F.col("_top") < F.col("_high"), F.col("_top") + 1)
    return (
        bounds.join(top, "subnet", "left").join(gaps, "subnet", "left")
        .select("subnet", address_text(F.coalesce(after, F.col("_gap"), F.col("_low") + 1)).alias("next_address"))
    )


NEW_FIELDS = ("type", "protocol", "mgmt_ip", "parent_device", "parent_interface", "link_mode")


def add_devices(proposed: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(additions, conflicts). Additions carry only their non-empty fields, as a map."""
    names = registry.select(F.upper("name").alias("_n")).distinct()
    keyed = proposed.withColumn("_n", F.upper("name"))
    conflict = keyed.join(names, "_n", "left_semi").select(
        "name", F.concat(F.lit("device "), F.col("name"), F.lit(" is already there")).alias("error"))
    fields = F.filter(
        F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in NEW_FIELDS]
                + [F.struct(F.lit("description").alias("key"), F.concat(
                    F.lit("new "), F.col("type")).alias("value"))]),
        lambda e: e["value"].isNotNull() & (e["value"] != ""))
    fresh = keyed.join(names, "_n", "left_anti").select("name", F.map_from_entries(fields).alias("fields"))
    return fresh, conflict

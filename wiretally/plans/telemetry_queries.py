"""Registered queries over device captures: text is rendered, parsed back and compared."""
from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import fixed as K
from wiretally.functions.rows import unfold
from wiretally.operators import telemetry as TM
from wiretally.plans import recipes as R
from wiretally.plans.plan_queries import _values

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


W = "WITH " + R.CAPTURE


def section(name, cte, columns):
    @register("parse_" + name, W + f" SELECT device_name, {columns} FROM {cte}")
    def run(spark, d):
        return TM.parsed(R.snapshots(spark, d), name).drop("collected_at", "access_mode")


section("interfaces", "itf", "name, phy_state, pro_state, state, ip")
section("vlans", "vla", "id, type, ports")
section("routes", "rou", "destination, protocol, nexthop, interface")
section("ospf_peers", "osp", "router_id, address, interface, state")
section("bgp_peers", "bgp", 'peer_ip, "as", up_down, state, prefixes')
section("vrrp_groups", "vrr", "interface, vrid, state, virtual_ip, priority")
section("stp_ports", "stp", "mstid, port, role, state, protection")
section("lldp_neighbors", "lld", "local_interface, neighbor_device, neighbor_interface, expire")


def _listing(command, head, row, groups="jl"):
    """One output of every device as SQL: head and the rows of its lines in order, trimmed."""
    return (f"SELECT device_name, '{command}' AS command, trim('{head}' || string_agg({row}, '' ORDER BY j), ' ' || chr(10)) AS output"
            f" FROM {groups} GROUP BY device_name")


_NL = " || chr(10)"
OUTPUTS = W + """,
out AS (
SELECT device_name, 'display version' AS command, 'VRP (R) software, Version 5.' || (doc_id % 9) || chr(10) || 'Acme AR' || (doc_id % 40)
  || CASE device_type WHEN 'router' THEN ' Router' ELSE ' Switch' END || ' uptime is ' || n_lines || ' days'
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Last reboot reason : power off' ELSE '' END AS output FROM dv
UNION ALL SELECT device_name, 'display cpu-usage', 'CPU Usage : ' || (n_lines % 100) || '.5% Max: 99%' FROM dv
UNION ALL SELECT device_name, 'display memory-usage', CASE WHEN doc_id % 6 = 5 THEN 'No data' WHEN doc_id % 6 = 4
  THEN (n_chars % 100) || '% of memory' ELSE 'Memory Using Rate: ' || (n_chars % 100) || '%' END FROM dv
UNION ALL SELECT device_name, 'display current-configuration', 'sysname ' || device_name
  || CASE WHEN dv.doc_id % 4 = 1 THEN '-OLD' ELSE '-CORE' END || chr(10) || '#' || chr(10)
  || CASE WHEN dv.doc_id % 2 = 0 THEN 'ospf 1' || chr(10) || '#' || chr(10) ELSE '' END
  || CASE WHEN dv.doc_id % 5 = 0 THEN 'bgp 65001' || chr(10) || '#' || chr(10) ELSE '' END
  || CASE WHEN dv.doc_id % 7 = 0 THEN 'dhcp enable' || chr(10) ELSE '' END || t
  FROM dv JOIN (SELECT device_name, string_agg('interface ' || port || chr(10) || CASE WHEN h % 3 = 0 THEN ' ip address 10.'
    || (h % 256) || '.' || j || '.1 255.255.255.0' ELSE ' description link' END || chr(10) || '#', chr(10) ORDER BY j) AS t
    FROM jl GROUP BY device_name) USING (device_name)
UNION ALL """ + " UNION ALL ".join([
    _listing("display interface brief", "Interface                   PHY   Protocol' || chr(10) || '",
             "port || '   ' || phy || '    ' || pro" + _NL),
    _listing("display vlan", "VID  Type    Ports' || chr(10) || '1    common  UT:GE0/0/1(U)' || chr(10) || '",
             "(2 + h % 4000) || '    ' || (['common', 'super', 'sub'])[j % 3 + 1] || '  UT:GE0/0/' || (j % 48) || '(U)'" + _NL),
    _listing("display ip routing-table", "Destination/Mask Proto Pre Cost Flags NextHop Interface' || chr(10) || '",
             "'10.' || (h % 256) || '.' || j || '.0/24  ' || (['Direct', 'Static', 'OSPF', 'RIP', 'BGP', 'ISIS'])[j % 6 + 1]"
             " || '  60  0  RD  10.0.0.' || (j % 250) || '  ' || port" + _NL),
    _listing("display ospf peer", "Router-Id Pri State Up Address Interface' || chr(10) || '",
             "'10.1.' || j || '.' || (h % 250) || ' 1 ' || nbr || '/DR 30 10.0.' || j || '.2 ' || port" + _NL,
             "(SELECT * FROM jl WHERE doc_id % 5 = 0)"),
    _listing("display ospf peer", " OSPF Process 1 with Router ID 10.9.9.9' || chr(10) || '",
             "CASE WHEN j % 3 = 0 THEN ' Area 0.0.0.0 interface 10.0.' || j || '.1(' || port || ')''s neighbors' || chr(10) ELSE '' END"
             " || ' Router ID: 10.1.' || j || '.' || (h % 250) || '   Address: 10.0.' || j || '.2' || chr(10)"
             " || CASE WHEN h % 6 = 5 THEN '' ELSE '   State: ' || nbr || '  Mode:Nbr is Master' || chr(10) END",
             "(SELECT * FROM jl WHERE doc_id % 5 <> 0)"),
    _listing("display bgp peer", "Peer V AS MsgRcvd MsgSent OutQ Up/Down State PfxRcd' || chr(10) || '",
             "'192.168.' || j || '.' || (h % 250) || '  4 ' || (65000 + j) || '  10  10  0 00:05:23 ' || CASE WHEN h % 3 = 0 THEN 'Idle'"
             " ELSE 'Established' END || CASE WHEN h % 2 = 0 THEN '  ' || (h % 100) ELSE '' END" + _NL),
    _listing("display vrrp", "",
             "'Vlanif' || (2 + h % 4000) || ' | Virtual Router ' || (j + 1) || chr(10) || CASE WHEN h % 4 = 3 THEN '' ELSE ' State : '"
             " || CASE WHEN j % 2 = 0 THEN 'Master' ELSE 'Backup' END || chr(10) END || ' Virtual IP : 10.' || (h % 256) || '.' || j"
             " || '.254' || chr(10) || CASE WHEN j % 3 = 2 THEN '' ELSE ' Priority : ' || (100 + j) || chr(10) END"),
    _listing("display stp brief", " MSTID  Port                        Role  STP State     Protection' || chr(10) || '",
             "'   0    ' || port || '  ' || CASE WHEN j = 0 THEN 'ROOT' ELSE 'DESI' END || '  ' || CASE WHEN h % 3 = 0 THEN 'discarding'"
             " ELSE 'FORWARDING' END || CASE WHEN h % 2 = 0 THEN '  BPDU' ELSE '' END" + _NL),
    _listing("display lldp neighbor brief", "Local Intf     Neighbor Dev       Neighbor Intf     Exptime' || chr(10) || '",
             "port || '  S' || h || '  GE0/0/' || (j % 48) || '  ' || (60 + j) || 's'" + _NL),
]) + ")"


@register("session_split", OUTPUTS + " SELECT device_name, command, output FROM out")
def session_split(spark, d):
    """Every output whole, of all twelve commands."""
    return TM.command_outputs(R.snapshots(spark, d)).select("device_name", "command", "output")


@register("parse_version", W + """
SELECT device_name, '5.' || (doc_id % 9) AS vrp_version, 'AR' || (doc_id % 40) AS hardware, n_lines || ' days' AS uptime,
  CASE WHEN doc_id % 2 = 0 THEN 'power off' END AS reboot_cause, NULL::VARCHAR AS compile_date, NULL::VARCHAR AS patch_version FROM dv""")
def parse_version(spark, d):
    return TM.parsed(R.snapshots(spark, d), "version_info").drop("collected_at", "access_mode")


@register("parse_load", W + " SELECT device_name, cpu AS cpu_usage, memory AS memory_usage FROM met")
def parse_load(spark, d):
    return R.snapshots(spark, d).select(
        "device_name", TM.SECTIONS["cpu_usage"]().alias("cpu_usage"), TM.SECTIONS["memory_usage"]().alias("memory_usage"))


def data(spark, d, devices=None, **kw):
    """Assembled snapshots with registry columns; of the named ``devices`` only, where these are given."""
    shots = R.snapshots(spark, d)
    if devices is not None:
        shots = shots.join(devices.select("device_name").distinct(), "device_name", "left_semi")
    return TM.assemble(shots, **kw).withColumn(
        "device_type", F.when(F.col("device_name").startswith("R"), "router").otherwise("switch")
    ).withColumn("_i", F.substring("device_name", 2, 20).cast("bigint")).withColumn(
        "mgmt_ip", R._text("10.7.", F.floor(F.col("_i") / 250) % 250, ".", F.col("_i") % 250)).drop("_i")


#: Sections of a snapshot: (name, relation with their rows, fields in order).
LISTS = (
    ("interfaces", "itf", ("name", "phy_state", "pro_state", "state", "ip")),
    ("vlans", "vla", ("id", "type", "ports")),
    ("routes", "rou", ("destination", "protocol", "nexthop", "interface")),
    ("ospf_peers", "osp", ("router_id", "address", "interface", "state")),
    ("bgp_peers", "bgp", ("peer_ip", "as", "up_down", "state", "prefixes")),
    ("vrrp_groups", "vrr", ("interface", "vrid", "state", "virtual_ip", "priority")),
    ("stp_ports", "stp", ("mstid", "port", "role", "state", "protection")),
    ("lldp_neighbors", "lld", ("local_interface", "neighbor_device", "neighbor_interface", "expire")),
)
#: Per device the size of each section and a hash of all its records in order.
CONTENTS = ",\n" + ",\n".join(
    f"""c_{name} AS (SELECT device_name, count(*) AS n_{name}, md5(string_agg({" || '|' || ".join(f'"{f}"' for f in fields)},
  chr(10) ORDER BY j)) AS {name}_md5 FROM {cte} GROUP BY device_name)""" for name, cte, fields in LISTS)
CONTENT_COLUMNS = ", ".join(f"n_{name}, {name}_md5" for name, _, _ in LISTS)
CONTENT_JOINS = " ".join(f"JOIN c_{name} USING (device_name)" for name, _, _ in LISTS)


def contents():
    """Size and hash of the records of each section, as columns."""
    def text(fields):
        return lambda x: F.concat_ws("|", *[x[f] for f in fields])

    columns = []
    for name, _, fields in LISTS:
        columns += [F.size(name).cast("bigint").alias("n_" + name),
                    F.md5(F.array_join(F.transform(name, text(fields)), "\n").cast("binary")).alias(name + "_md5")]
    return columns


@register("snapshot_assembly", W + CONTENTS + f"""
SELECT device_name, {CONTENT_COLUMNS}, '5.' || (dv.doc_id % 9) AS vrp_version, n_lines || ' days' AS uptime, cpu AS cpu_usage,
  memory AS memory_usage, true AS is_complete, 0::BIGINT AS n_errors FROM dv JOIN met USING (device_name) {CONTENT_JOINS}""")
def snapshot_assembly(spark, d):
    return data(spark, d).select(
        "device_name", *contents(), "version_info.vrp_version", "version_info.uptime", "cpu_usage", "memory_usage", "is_complete",
        F.size("errors").cast("bigint").alias("n_errors"))


@register("source_preference", W + """
SELECT device_name, CASE WHEN doc_id % 11 = 10 THEN 'error' WHEN doc_id % 2 = 1 THEN 'file'
    WHEN doc_id % 4 = 0 THEN 'telnet' ELSE 'ssh' END AS access_mode,
  CASE WHEN doc_id % 11 = 10 THEN NULL WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN NULL
    WHEN doc_id % 2 = 1 THEN '2024-01-01T00:00:00' ELSE '2024-01-02T00:00:00' END AS collected_at,
  CASE WHEN doc_id % 11 = 10 THEN '''' || device_name || ''' is not in the registry' END AS error FROM dv""")
def source_preference(spark, d):
    """Even devices have a live capture; files exist except for odd routers."""
    base = R.sessions(spark, d).select("device_name", "collected_at", F.substring("device_name", 2, 20).cast("bigint").alias("i"))
    files = base.filter("NOT (i % 2 = 1 AND i % 3 = 0)").withColumn("source", F.lit("file"))
    live = base.filter("i % 2 = 0").withColumn("source", F.lit("live")).withColumn(
        "collected_at", F.lit("2024-01-02T00:00:00"))
    return TM.preferred_source(
        base.select(F.lower("device_name").alias("device_name")), files.unionByName(live).drop("i"),
        R.capture_registry(spark, d)).select("device_name", "access_mode", "collected_at", "error")


_PLAN_ROWS = [("switch", n, c) for n, c in enumerate(K.SWITCH_COMMANDS)] + [
    ("router", n, c) for n, c in enumerate(K.ROUTER_COMMANDS)]


@register("collection_plan", W + f""",
cmds(t, o, c) AS (SELECT * FROM {_values(_PLAN_ROWS)}),
extra(p, c) AS (SELECT * FROM {_values(list(K.PROTOCOL_COMMANDS.items()))}),
prot AS (SELECT device_name, device_type, (['OSPF', 'BGP', 'VRRP', 'MSTP', 'LLDP', 'NAT'])[doc_id % 6 + 1] AS p, 100 AS o
  FROM dv UNION ALL SELECT device_name, device_type, 'stp', 101 FROM dv),
allc AS (SELECT device_name, c, o FROM dv JOIN cmds ON t = device_type
  UNION ALL SELECT device_name, c, o FROM prot JOIN extra ON upper(prot.p) = extra.p),
one AS (SELECT device_name, c, min(o) AS o FROM allc GROUP BY ALL)
SELECT device_name, row_number() OVER (PARTITION BY device_name ORDER BY c = 'display cpu-usage', o) AS n, c AS command
FROM one""")
def collection_plan(spark, d):
    i = F.substring("device_name", 2, 20).cast("int")
    names = F.array(*[F.lit(p) for p in ("OSPF", "BGP", "VRRP", "MSTP", "LLDP", "NAT")])
    devices = R.sessions(spark, d).select(
        "device_name", F.when(F.col("device_name").startswith("R"), "router").otherwise("switch").alias("type"),
        F.array(F.element_at(names, i % 6 + 1), F.lit("stp")).alias("protos"))
    return TM.collection_plan(devices)


_PAD = "CASE WHEN length({0}) >= {1} THEN {0} ELSE rpad({0}, {1}, ' ') END"
SUMMARY = W + f""",
shown AS (SELECT *, row_number() OVER (PARTITION BY device_name ORDER BY contains(phy_state, 'up') DESC, j) AS r FROM itf),
line AS (
  SELECT device_name, 0 AS s, 0 AS o, '# State of ' || device_name || chr(10) || 'type: '
    || device_type || chr(10) || 'address: ' || mgmt_ip || chr(10) || 'source: ' || upper(access_mode) || ' ('
    || CASE access_mode WHEN 'ssh' THEN 'live SSH' ELSE 'export file' END || ')' || chr(10)
    || 'collected: 2024-01-01T00:00:00' || chr(10) || 'system: 5.' || (doc_id % 9) || chr(10) || 'hardware: AR'
    || (doc_id % 40) || chr(10) || 'uptime: ' || n_lines || ' days' || chr(10) || 'last restart: '
    || CASE WHEN doc_id % 2 = 0 THEN 'power off' ELSE 'N/A' END AS t FROM dv
  UNION ALL SELECT device_name, 1, 0, 'cpu: ' || printf('%.1f', cpu) || '% ' || CASE WHEN cpu > 70 THEN '⚠' ELSE '✓' END
  FROM met
  UNION ALL SELECT device_name, 1, 1, 'memory: ' || printf('%.1f', memory) || '% '
    || CASE WHEN memory > 80 THEN '⚠' ELSE '✓' END FROM met WHERE memory IS NOT NULL
  UNION ALL SELECT device_name, 2, 0, chr(10) || '## Interfaces: ' || n_lines FROM dv
  UNION ALL SELECT device_name, 2, r, '  ' || CASE WHEN contains(state, 'up') THEN '✓' ELSE '✗' END || ' '
    || {_PAD.format('name', 22)} || ' ' || {_PAD.format('ip', 16)} || ' ' || state FROM shown WHERE r <= 15
  UNION ALL SELECT device_name, 2, 99, '  and ' || (n_lines - 15) || ' more' FROM dv
  WHERE n_lines > 15
  UNION ALL SELECT device_name, 3, -2, chr(10) || '## VLANs: ' || (n_lines + 1) FROM dv
  UNION ALL SELECT device_name, 3, j, '  VLAN ' || {_PAD.format('id', 5)} || ' ' || ports FROM vla WHERE j < 5
  UNION ALL SELECT device_name, 4, -1, chr(10) || '## Routes: ' || n_lines FROM dv
  UNION ALL SELECT device_name, 4, j, '  ' || {_PAD.format('destination', 20)} || ' via ' || {_PAD.format('nexthop', 15)}
    || ' [' || protocol || ']' FROM rou WHERE j < 6
  UNION ALL SELECT device_name, 5, -1, chr(10) || '## OSPF neighbours: ' || n_lines FROM dv
  UNION ALL SELECT device_name, 5, j, '  ' || CASE WHEN contains(lower(state), 'full') THEN '✓' ELSE '⚠' END || ' '
    || {_PAD.format('router_id', 15)} || ' via ' || {_PAD.format('interface', 15)} || ' ' || state FROM osp
  UNION ALL SELECT device_name, 6, -1, chr(10) || '## STP ports: ' || n_lines FROM dv
  UNION ALL SELECT device_name, 6, j, '  ' || CASE WHEN state = 'FORWARDING' THEN '✓' ELSE '⚠' END || ' '
    || {_PAD.format('port', 25)} || ' Role=' || {_PAD.format('role', 6)} || ' State=' || state || ' Protection='
    || protection FROM stp WHERE j < 10),
summary AS (SELECT device_name, string_agg(t, chr(10) ORDER BY s, o) AS summary FROM line GROUP BY device_name)"""


@register("device_summary", SUMMARY + " SELECT device_name, summary FROM summary")
def device_summary(spark, d):
    return TM.summary_lines(data(spark, d)).select("device_name", F.array_join("summary", "\n").alias("summary"))


FLEET = """,
down AS (SELECT device_name, count(*) AS n_down, array_to_string(list(name ORDER BY j)[1:5], ', ') AS first_five FROM itf
  WHERE contains(phy_state, 'down') GROUP BY ALL),
bad AS (SELECT device_name, count(*) AS n_bad FROM osp WHERE NOT contains(lower(state), 'full') GROUP BY ALL),
quick AS (SELECT device_name, 0 AS o, 'CPU load ' || printf('%.1f', cpu) || '%' AS alert FROM met
    WHERE cpu > 70
  UNION ALL SELECT device_name, 1, 'links down: ' || first_five FROM down
  UNION ALL SELECT device_name, 2, 'OSPF neighbours not full: ' || n_bad FROM bad)"""


@register("quick_alerts", W + FLEET + " SELECT device_name, alert FROM quick")
def quick_alerts(spark, d):
    return unfold(data(spark, d), ["device_name"], TM.quick_alerts(), "alert")


@register("fleet_summary", W + FLEET + """,
fleet AS (SELECT device_name, mgmt_ip, access_mode, (SELECT count(*) FROM quick q WHERE q.device_name = dv.device_name)
  AS n_alerts FROM dv)
SELECT device_name, mgmt_ip, access_mode, true AS is_complete, n_alerts, NULL::BIGINT AS n_collected FROM fleet
UNION ALL SELECT 'TOTAL', NULL, NULL, true, sum(n_alerts)::BIGINT, count(*) FROM fleet""")
def fleet_summary(spark, d):
    fleet = TM.fleet_summary(data(spark, d))
    totals = TM.fleet_totals(fleet).select(
        F.lit("TOTAL").alias("device_name"), F.lit(None).cast("string").alias("mgmt_ip"),
        F.lit(None).cast("string").alias("access_mode"), (F.col("collected") == F.col("devices")).alias("is_complete"),
        F.col("alerts").alias("n_alerts"), F.col("collected").alias("n_collected"))
    return fleet.withColumn("n_collected", F.lit(None).cast("bigint")).unionByName(totals)


@register("display_rank", W + """
SELECT device_name, 'interface' AS kind, row_number() OVER (PARTITION BY device_name ORDER BY contains(state, 'down'), j)
  AS rank, name, CASE WHEN ip = '' THEN '—' ELSE ip END AS detail, state AS value FROM itf QUALIFY rank <= 10
UNION ALL SELECT device_name, 'route', j + 1, destination, protocol, nexthop FROM rou WHERE j < 8""")
def display_rank(spark, d):
    return TM.display_rank(data(spark, d))

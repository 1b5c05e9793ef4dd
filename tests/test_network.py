"""Telemetry parsing, expectations, compliance and topology on golden cases."""
import pytest
from pyspark.sql import functions as F

from wiretally.functions.ordered import carry_last
from wiretally.operators import compliance as CO, expectations as EX, planning as PL, telemetry as TM, topology as TP

SESSION = """# export
[S1]display cpu-usage
CPU Usage : 1%
<S1>display interface brief
Interface PHY Protocol
GigabitEthernet0/0/1  *down  down
MEth0/0/1  up  up
GE0/0/2 up down
[S1]display ospf peer
10.0.0.9 1 Full/DR 30 10.0.0.2 GE0/0/1
[S1]display current-configuration
sysname S1-X
interface GE0/0/2
 description nothing
interface GigabitEthernet0/0/1
 ip address 10.1.1.1 255.255.255.0
[S1]display cpu-usage
CPU Usage : 91.5%
[S1]display memory-usage
Memory Usage: 1.2.3%
[S1]display vrrp
Vlanif99 | Virtual Router 1
 State : Master
Vlanif100 | Virtual Router 2
 Priority : 90
[S1]
"""


@pytest.fixture(scope="module")
def device(spark):
    rows = spark.createDataFrame([("S1", "2024-01-01", "file", SESSION)],
                                 "device_name string, collected_at string, access_mode string, session_text string")
    return TM.assemble(TM.outputs_map(rows), keep_outputs=True).first()


def test_session_and_sections(device):
    assert device.outputs["display cpu-usage"] == "CPU Usage : 91.5%"
    assert device.cpu_usage == 91.5
    assert [(i.name, i.phy_state, i.ip) for i in device.interfaces] == [
        ("GigabitEthernet0/0/1", "*down", "10.1.1.1/255.255.255.0"), ("GE0/0/2", "up", "")]
    assert [(p.router_id, p.state, p.address) for p in device.ospf_peers] == [("10.0.0.9", "Full", "10.0.0.2")]
    assert [(g.interface, g.vrid, g.state, g.priority) for g in device.vrrp_groups] == [
        ("Vlanif99", "1", "Master", ""), ("Vlanif100", "2", "unknown", "90")]
    assert device.memory_usage is None and list(device.errors) == ["memory_usage: could not convert 1.2.3"]


def lines(spark, text, source="m.pdf"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(text)], "source_file string, line_no bigint, line string")


@pytest.mark.parametrize("size", [11, 4096])
def test_proximity_windows(spark, monkeypatch, size):
    monkeypatch.setattr(EX, "LINES_PER_SEGMENT", size)
    text = ["Le switch S1-CORE-SWITCH et LSW2"] + [""] * 9 + ["VLAN 10"] + ["VLAN 4095, 1"] + ["vlan batch 7 8 to 9"]
    text += ["S3 : VLANs 30, 40 et 50", "GE 0/0/1", "x", "y", "Eth-Trunk 5", "R1 vlan 77", "vlanif 20"]
    manual = lines(spark, text)
    got = sorted((r.device, r.vlan) for r in EX.expected_vlans(manual).collect())
    assert got == [("S1", 10), ("S2", 10), ("S3", 30), ("S3", 40), ("S3", 50)]
    assert sorted((r.device, r.interface) for r in EX.expected_interfaces(manual).collect()) == [
        ("R1", "vlanif20"), ("S3", "GigabitEthernet0/0/1")]


def test_ranges_can_be_expanded(spark):
    manual = lines(spark, ["S4 vlan batch 3 to 6"])
    assert [r.vlan for r in EX.expected_vlans(manual).collect()] == [3]
    assert sorted(r.vlan for r in EX.expected_vlans(manual, True).collect()) == [3, 4, 5, 6]


def test_host_names_over_lines_and_later_pattern_wins(spark):
    manual = lines(spark, ["sysname", "S7-A", "S8 sysname S8-OLD", "le nom est : S8-NEW", "hostname PC1"])
    assert {(r.device, r.host_name) for r in EX.expected_host_names(manual).collect()} == {("S7", "S7-A"), ("S8", "S8-NEW")}


def test_host_name_far_behind_its_keyword(spark):
    lines = ["sysname"] + ["", "  "] * 20 + ["S7-A", "text"]
    manual = spark.createDataFrame([("m", i, t) for i, t in enumerate(lines)], "source_file string, line_no bigint, line string")
    assert {(r.device, r.host_name) for r in EX.expected_host_names(manual).collect()} == {("S7", "S7-A")}


def test_carry_crosses_segments(spark):
    rows = spark.createDataFrame([("k", i, i if i in (0, 7) else None) for i in range(50)], "k string, p bigint, v bigint")
    got = {r.p: r.o for r in carry_last(rows, ["k"], "p", "v", 4, "o").collect()}
    assert got == {i: (0 if i < 7 else 7) for i in range(50)}


def test_manual_blocks_last_block_wins(spark):
    manual = lines(spark, ["intro about S9", "S1 first", "a", "S2 x", "S1 second", "b"])
    got = {r.device: r.text for r in EX.manual_blocks(manual).collect()}
    assert got == {"S9": "intro about S9", "S1": "S1 second\nb", "S2": "S2 x"}


def test_substring_rules_are_exact(spark):
    names = CO.mentioned_names(lines(spark, ["port GigabitEthernet0/0/10 and XGE1/0"]), F.lit(30))
    held = {r[0] for r in names.select("_name").collect()}
    assert "gigabitethernet0/0/1" in held and "ge1/0" in held and "gigabitethernet0/0/2" not in held
    quads = spark.range(1).select(CO.networks_in(F.lit("210.1.2.30/24 x 1.2.3.4.5")).alias("q")).first().q
    text = "210.1.2.30/24 x 1.2.3.4.5"
    assert {"210.1.2.30", "10.1.2.3", "0.1.2.3", "2.3.4.5"} <= set(quads) and all(q in text for q in quads)


@pytest.mark.parametrize("quality,level", [(0.45, "medium"), (0.75, "high"), (0.4499, "low"), (0.7499, "medium")])
def test_confidence_borders(spark, quality, level):
    row = spark.createDataFrame([(1, quality, 0, 0, 0, 0)],
                                "question_id int, quality double, devices_checked int, criticals int, warnings int, discrepancies int")
    assert CO.confidence(row).first().confidence == level


def test_corrective_commands_in_free_text(spark):
    text = "a. Fix: `[s1] vlan batch 1 2;` Fix: [R1-X] sysname R1.  "
    rows = CO.corrective_commands(spark.createDataFrame([(text,)], "discrepancy string")).orderBy("n").collect()
    assert [(r.device, r.command) for r in rows] == [("S1", "vlan batch 1 2"), ("R1-X", "sysname R1")]


def test_device_names_with_punctuation_in_questions(spark):
    reg = spark.createDataFrame([("s1-core",), ("S1",), ("sw.2",)], "name string")
    q = spark.createDataFrame([(1, "état de S1-CORE, xS1 et SW.2."), (2, "S10 ?")], "question_id int, question string")
    got = {r.question_id: (list(r.devices), list(r.known)) for r in PL.extract_entities(q, reg).collect()}
    assert got == {1: (["S1", "S1-CORE", "SW.2"], ["S1", "S1-CORE", "SW.2"]), 2: (["S10"], [])}


def devices(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, type string, parent_device string, ordinal int")


def test_names_of_any_characters_and_long_hyphenated_runs(spark):
    reg = spark.createDataFrame([("core switch/1",), ("R(2)x",), ("S1",)], "name string")
    run = "-".join(f"w{i}" for i in range(3000))
    q = spark.createDataFrame([(1, "state of Core Switch/1 now"), (2, f"{run} S1"), (3, "is r(2)X up"), (4, "S10 or S1x")],
                              "question_id int, question string")
    got = {r.question_id: list(r.known) for r in PL.extract_entities(q, reg).collect()}
    assert got == {1: ["CORE SWITCH/1"], 2: ["S1"], 3: ["R(2)X"], 4: []}


def test_tree_order_with_long_ordinals(spark):
    rows = [("R", "router", None, 10**14), ("b", "switch", "R", 2 * 10**13), ("a", "switch", "R", 10**13 + 5), ("c", "switch", "a", 3)]
    table = spark.createDataFrame(rows, "name string, type string, parent_device string, ordinal bigint")
    got = [r.node for r in TP.flatten_tree(table).orderBy("path").collect()]
    assert got == ["R", "A", "C", "B"]


def test_tree_with_chain_orphans_and_cycle(spark):
    rows = [("a", "switch", "b"), ("b", "switch", "a"), ("r", "router", None)]
    rows += [(f"n{i}", "switch", f"N{i - 1}" if i else "R") for i in range(9)] + [("o", "switch", "lost")]
    tree = {r.node: r.depth for r in TP.flatten_tree(devices(spark, rows)).collect()}
    assert tree == {"R": 0, "O": 1, **{f"N{i}": i + 1 for i in range(9)}}


def test_tree_without_router(spark):
    tree = {r.node: r.parent for r in TP.flatten_tree(devices(spark, [("a", "switch", "b"), ("b", "switch", None)])).collect()}
    assert tree == {"B": None, "A": "B"}


def test_addresses(spark):
    nets = spark.createDataFrame([("n", "10.0.0.0", 29), ("empty", "10.0.1.0", 24), ("full", "10.0.2.0", 30)],
                                 "subnet string, first string, prefix int")
    used = spark.createDataFrame([("n", "10.0.0.7"), ("n", "10.0.0.1"), ("n", "bad"), ("n", "10.0.0.01"), ("n", "10.9.9.9"),
                                  ("full", "10.0.2.1"), ("full", "10.0.2.2"), ("full", "10.0.2.3")], "subnet string, mgmt_ip string")
    got = {r.subnet: r.next_address for r in TP.next_free_address(nets, used).collect()}
    assert got == {"n": "10.0.0.2", "empty": "10.0.1.1", "full": "10.0.2.1"}


def test_gaps_and_alerts_read_captures_that_are_parsed_once(spark):
    from wiretally.plans import compliance_queries as CQ

    for name in ("remediation_counts", "device_alerts"):
        read = CQ.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert read and not [f for f in read if f.endswith("documents.parquet")]


def test_words_that_spare_a_pattern_ignore_the_case_as_the_pattern_does(spark):
    lines = spark.createDataFrame([(1, "vLaN 12 et Vlanif30"), (2, "rien"), (3, None)], "n int, line string")
    got = {r.n: r.v for r in lines.select("n", EX.vlan_ids(F.col("line")).alias("v")).collect()}
    assert got[1] == [12, 30] and got[2] == [] and not got[3]
    manual = spark.createDataFrame([("m", 0, "ſysname S4-A"), ("m", 1, "S5 : `S5-X`")], "source_file string, line_no long, line string")
    assert {(r.device, r.host_name) for r in EX.expected_host_names(manual).collect()} == {("S4", "S4-A"), ("S5", "S5-X")}

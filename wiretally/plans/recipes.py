"""Input tables of the domain, derived from the driver tables.

Every recipe is a per-row rendering of one driver table (no grouping, no subset),
so it grows with that table; the SQL text beside it gives the same rows to the
check engine. Values depend on line lengths and positions only, which both
engines compute alike.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wiretally.functions.rows import unfold
from wiretally.sources.tables import spread_small


#: Tables with per-row text or vector work.
HEAVY = ("documents", "conversations", "customer", "benchmark", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(rows) if name in HEAVY else rows


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p (line position from 0), line, h (line length)."""
    return lines_from(table(spark, sf_dir, "documents"))


def lines_from(documents: DataFrame) -> DataFrame:
    return (
        unfold(documents, ["doc_id"], F.split("text", "\n", -1), "line", "p")
        .withColumn("h", F.length("line"))
    )


LINES = """ln AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS line
  FROM documents),
lh AS (SELECT *, length(line) AS h FROM ln)"""

# --------------------------------------------------------------------------- blocks


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from(table(spark, sf_dir, "documents"))


def blocks_from(documents: DataFrame) -> DataFrame:
    """Positioned page blocks. Each document line is a text block; by its position
    a heading, a command-line block, a table or an image stands beside it."""
    p, h = F.col("p"), F.col("h").cast("string")
    ps = p.cast("string")
    none = F.lit(None).cast("int")

    def block(slot: int, kind: str, content: Column, width: Column = none, height: Column = none) -> Column:
        return F.struct(
            F.lit(slot).alias("slot"), F.lit(kind).alias("block_type"), content.alias("content"),
            width.alias("img_width"), height.alias("img_height"),
        )

    heading = F.concat(F.lit("Step "), ps, F.lit(" Zone "), h, F.lit(" planning"))
    cli = F.concat(F.lit("[S1]display vlan "), ps, F.lit("\n[S1]interface Vlanif"), ps,
                   F.lit("\n ip address 10.0.0."), (p % 250).cast("string"), F.lit(" 24"))
    grid = F.concat(F.lit("Name\tPort\tState\nlink"), ps, F.lit("\tGE0/0/"), (p % 48).cast("string"),
                    F.lit("\tup\nsize\t"), h, F.lit("\tok"))
    slots = F.array(
        F.when(p % 7 == 0, block(0, "text", heading)),
        block(1, "text", F.col("line")),
        F.when(p % 5 == 3, block(2, "text", cli)),
        F.when(p % 13 == 12, block(3, "text", grid)),
        F.when(p % 11 == 10, block(4, "image", F.lit(""), (200 + (p * 37) % 400).cast("int"),
                                   (300 + (F.col("h") * 13) % 500).cast("int"))),
    )
    return (
        unfold(lines_from(documents), ["doc_id", "p", "line", "h"], F.filter(slots, lambda s: s.isNotNull()), "s")
        .select(
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"),
            (F.floor(p / 5) + 1).cast("int").alias("page_number"),
            (p * 8 + F.col("s.slot")).cast("int").alias("block_no"),
            F.col("s.block_type").alias("block_type"),
            F.lit(50.0).alias("x0"),
            ((p % 5) * 100 + F.col("s.slot") * 10).cast("double").alias("y0"),
            (F.lit(550.0) - F.col("s.slot") * 20).alias("x1"),
            ((p % 5) * 100 + F.col("s.slot") * 10 + 9).cast("double").alias("y1"),
            F.col("s.content").alias("content"),
            F.col("s.img_width").alias("img_width"),
            F.col("s.img_height").alias("img_height"),
            F.when(F.col("s.block_type") == "image", F.when(p % 2 == 0, "png").otherwise("jpeg")).alias("img_format"),
        )
    )


BLOCKS = LINES + """,
slots AS (
  SELECT doc_id, p, h, 0 AS slot, 'text' AS block_type, 'Step ' || p || ' Zone ' || h || ' planning' AS content
  FROM lh WHERE p % 7 = 0
  UNION ALL SELECT doc_id, p, h, 1, 'text', line FROM lh
  UNION ALL SELECT doc_id, p, h, 2, 'text', '[S1]display vlan ' || p || chr(10) || '[S1]interface Vlanif' || p
    || chr(10) || ' ip address 10.0.0.' || (p % 250) || ' 24' FROM lh WHERE p % 5 = 3
  UNION ALL SELECT doc_id, p, h, 3, 'text', 'Name' || chr(9) || 'Port' || chr(9) || 'State' || chr(10) || 'link' || p
    || chr(9) || 'GE0/0/' || (p % 48) || chr(9) || 'up' || chr(10) || 'size' || chr(9) || h || chr(9) || 'ok'
  FROM lh WHERE p % 13 = 12
  UNION ALL SELECT doc_id, p, h, 4, 'image', '' FROM lh WHERE p % 11 = 10),
blocks AS (
  SELECT doc_id, 'doc_' || doc_id || '.pdf' AS source_file, 1 + p // 5 AS page_number, p * 8 + slot AS block_no,
    block_type, 50.0::DOUBLE AS x0, ((p % 5) * 100 + slot * 10)::DOUBLE AS y0, (550 - slot * 20)::DOUBLE AS x1,
    ((p % 5) * 100 + slot * 10 + 9)::DOUBLE AS y1, content,
    CASE WHEN slot = 4 THEN 200 + (p * 37) % 400 END AS img_width,
    CASE WHEN slot = 4 THEN 300 + (h * 13) % 500 END AS img_height,
    CASE WHEN slot = 4 THEN CASE WHEN p % 2 = 0 THEN 'png' ELSE 'jpeg' END END AS img_format
  FROM slots)"""


def caption_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-marker responses, one per image block. Categories, list lengths and
    number formats vary with the position; some responses lack a section."""
    p, h = F.col("p"), F.col("h")
    hs = h.cast("string")
    category = F.when(p % 3 == 0, "network_topology").when(p % 3 == 1, "Flow_Diagram (guess)").otherwise("photo")
    confidence = (
        F.when(h % 4 == 0, F.concat(F.lit("0,"), (h % 10).cast("string")))
        .when(h % 4 == 1, "1.7").when(h % 4 == 2, "high").otherwise("0.65")
    )
    full = F.concat(
        F.lit("DESCRIPTION:\nDiagram of zone "), hs, F.lit(".\n\nCATÉGORIE:\n"), category,
        F.lit("\n\nÉLÉMENTS CLÉS:\nS"), hs, F.lit(", link "), p.cast("string"), F.lit(", ,trunk\n\nTERMES TECHNIQUES:\n"),
        F.when(h % 2 == 0, "OSPF, VLAN").otherwise(""), F.lit("\n\nCONFIANCE:\n"), confidence,
    )
    loose = F.concat(F.lit("  An unstructured remark about "), hs, F.lit(" lines \n"))
    return (
        document_lines(spark, sf_dir)
        .filter(p % 11 == 10)
        .select(
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"),
            (p * 8 + 4).cast("int").alias("block_no"),
            F.when(h % 5 == 0, loose).otherwise(full).alias("response"),
            F.when(h % 9 == 4, "quota exceeded").alias("error"),
        )
    )


# The caption columns themselves, for the check: derived from the rule, not parsed.
CAPTIONS = """caps AS (
  SELECT 'doc_' || doc_id || '.pdf' AS source_file, p * 8 + 4 AS block_no,
    CASE WHEN h % 5 = 0 THEN 'An unstructured remark about ' || h || ' lines' ELSE 'Diagram of zone ' || h || '.' END
      AS description,
    CASE WHEN h % 5 = 0 THEN 'unknown' WHEN p % 3 = 0 THEN 'network_topology' WHEN p % 3 = 1 THEN 'flow_diagram'
      ELSE 'unknown' END AS category,
    CASE WHEN h % 5 = 0 THEN '' ELSE 'S' || h || ', link ' || p || ', trunk' END AS key_elements,
    CASE WHEN h % 5 = 0 OR h % 2 = 1 THEN '' ELSE 'OSPF, VLAN' END AS technical_terms,
    CASE WHEN h % 5 = 0 THEN 0.8 WHEN h % 4 = 0 THEN (h % 10) / 10.0 WHEN h % 4 = 1 THEN 1.0 WHEN h % 4 = 2 THEN 0.8
      ELSE 0.65 END::DOUBLE AS confidence,
    CASE WHEN h % 9 = 4 THEN 'quota exceeded' END AS error
  FROM lh WHERE p % 11 = 10)"""


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wiretally.operators.captions import parse_captions

    return parse_captions(caption_responses(spark, sf_dir)).drop("response")


# --------------------------------------------------------------------------- registry and questions


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device registry rows as written by hand: many fields absent."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    n, r, s = F.col("n_nationkey"), F.col("n_regionkey"), F.col("s_suppkey")
    null = F.lit(None).cast("string")
    regions = table(spark, sf_dir, "region").select(
        _text("r", F.col("r_regionkey")).alias("name"), F.lit("router").alias("type"),
        F.lit("Telnet").alias("protocol"), _text("10.", F.col("r_regionkey"), ".0.254").alias("mgmt_ip"),
        F.lit("GigabitEthernet0/0/0").alias("mgmt_interface"), F.lit(None).cast("int").alias("port"),
        null.alias("parent_device"), null.alias("parent_interface"), null.alias("link_mode"),
        F.col("r_name").alias("description"), F.col("r_regionkey").alias("ordinal"),
    )
    nations = nation.select(
        _text("S", n).alias("name"), F.lit("switch").alias("type"), null.alias("protocol"),
        _text("10.", r, ".", n, ".1").alias("mgmt_ip"), null.alias("mgmt_interface"),
        F.when(n % 4 == 0, 2222).alias("port"), _text("R", r).alias("parent_device"),
        _text("GE0/0/", n).alias("parent_interface"), F.lit("trunk").alias("link_mode"),
        F.when(n % 3 == 0, F.col("n_name")).alias("description"), (n + 100).alias("ordinal"),
    )
    suppliers = supplier.join(nation, F.col("s_nationkey") == n).select(
        _text("S", s + 1000).alias("name"), F.when(s % 2 == 0, "Switch").alias("type"),
        F.when(s % 3 == 0, "telnet").alias("protocol"), _text("10.", r, ".", n, ".", s % 250 + 2).alias("mgmt_ip"),
        F.when(s % 5 == 0, "Vlanif99").alias("mgmt_interface"), F.when(s % 6 == 0, 2023).alias("port"),
        F.when(s % 17 == 0, "LOST").otherwise(_text("s", n)).alias("parent_device"),
        F.when(s % 2 == 0, _text("GE0/0/", s % 48)).alias("parent_interface"),
        F.when(s % 4 == 0, "access").alias("link_mode"), F.when(s % 7 == 0, "edge").alias("description"),
        (s + 1000).alias("ordinal"),
    )
    return regions.unionByName(nations).unionByName(suppliers)


REGISTRY = """registry AS (
  SELECT 'r' || r_regionkey AS name, 'router' AS type, 'Telnet' AS protocol, '10.' || r_regionkey || '.0.254' AS mgmt_ip,
    'GigabitEthernet0/0/0' AS mgmt_interface, NULL::INT AS port, NULL::VARCHAR AS parent_device,
    NULL::VARCHAR AS parent_interface, NULL::VARCHAR AS link_mode, r_name AS description, r_regionkey AS ordinal FROM region
  UNION ALL SELECT 'S' || n_nationkey, 'switch', NULL, '10.' || n_regionkey || '.' || n_nationkey || '.1', NULL,
    CASE WHEN n_nationkey % 4 = 0 THEN 2222 END, 'R' || n_regionkey, 'GE0/0/' || n_nationkey, 'trunk',
    CASE WHEN n_nationkey % 3 = 0 THEN n_name END, n_nationkey + 100 FROM nation
  UNION ALL SELECT 'S' || (s_suppkey + 1000), CASE WHEN s_suppkey % 2 = 0 THEN 'Switch' END,
    CASE WHEN s_suppkey % 3 = 0 THEN 'telnet' END,
    '10.' || n_regionkey || '.' || n_nationkey || '.' || (s_suppkey % 250 + 2),
    CASE WHEN s_suppkey % 5 = 0 THEN 'Vlanif99' END, CASE WHEN s_suppkey % 6 = 0 THEN 2023 END,
    CASE WHEN s_suppkey % 17 = 0 THEN 'LOST' ELSE 's' || n_nationkey END,
    CASE WHEN s_suppkey % 2 = 0 THEN 'GE0/0/' || (s_suppkey % 48) END, CASE WHEN s_suppkey % 4 = 0 THEN 'access' END,
    CASE WHEN s_suppkey % 7 = 0 THEN 'edge' END, s_suppkey + 1000
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

# Question templates: {p} protocol, {d} device, {v} VLAN number, {k} customer.
TEMPLATES = (
    "Pourquoi {p} est down sur {d} ?",
    "Audit des VLAN {v} et VLAN {v} puis vlan{k} sur {d}",
    "Comment configurer {p} sur {d} interface GE 0/0/{v}",
    "état des interfaces de {d}",
    "Expliquer {p} et la topologie",
    "rapport de santé de {d}",
    "How to setup VLAN{v} on GigabitEthernet0/0/{v} according to doc_{k}.pdf",
    "ping perte latence réseau entre {d} et R1",
    "Ajouter un nouveau switch {d}",
    "différence entre {p} et RSTP",
    "optimisation des performances dhcp mac arp",
    "Panne {p} VLAN {v} Vlanif{v} route sur {d} et S1",
)


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per customer from the templates, and the user turns as noise."""
    from wiretally.functions import fixed as K

    k, v = F.col("c_custkey"), F.col("c_nationkey")
    protocol = F.element_at(F.array(*[F.lit(p) for p in K.PROTOCOLS]), (v % len(K.PROTOCOLS) + 1).cast("int"))
    fields = {"{p}": protocol, "{d}": _text("S", k + 1000), "{v}": v.cast("string"), "{k}": k.cast("string")}
    chosen = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (k % len(TEMPLATES) + 1).cast("int"))
    for mark, value in fields.items():
        chosen = F.replace(chosen, F.lit(mark), value)
    asked = table(spark, sf_dir, "customer").select(k.alias("question_id"), chosen.alias("question"))
    spoken = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000_000).alias("question_id"), F.col("text").alias("question"))
    return asked.unionByName(spoken)


def _list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _question_sql() -> str:
    from wiretally.functions import fixed as K

    body = f"({_list_sql(TEMPLATES)})[c_custkey % {len(TEMPLATES)} + 1]"
    for mark, value in (
        ("{p}", f"({_list_sql(K.PROTOCOLS)})[c_nationkey % {len(K.PROTOCOLS)} + 1]"),
        ("{d}", "'S' || (c_custkey + 1000)"), ("{v}", "c_nationkey::VARCHAR"), ("{k}", "c_custkey::VARCHAR"),
    ):
        body = f"replace({body}, '{mark}', {value})"
    return f"""asked AS (
  SELECT c_custkey AS question_id, {body} AS question FROM customer
  UNION ALL SELECT conv_id * 1000 + turn + 1000000000000, text FROM conversations WHERE role = 'user')"""


QUESTIONS = _question_sql()


def retrieval_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that search for a benchmark passage and name a registered device."""
    i = F.col("item_id")
    opening = F.element_at(
        F.array(*[F.lit(t) for t in ("Pourquoi OSPF est down sur ", "Audit des VLAN 10 sur ",
                                     "configure BGP interface sur ", "état de ")]), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(
        i.alias("question_id"), F.concat(opening, _text("S", i % 10 + 1000), F.lit(" ? "), F.col("text")).alias("question"))


RETRIEVAL_QUESTIONS = """asked AS (
  SELECT item_id AS question_id, (['Pourquoi OSPF est down sur ', 'Audit des VLAN 10 sur ',
    'configure BGP interface sur ', 'état de '])[item_id % 4 + 1] || 'S' || (item_id % 10 + 1000) || ' ? ' || text AS question
  FROM benchmark)"""


def field_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about two captured devices, two protocols and a manual, with a benchmark passage; every fifth names no protocol."""
    from wiretally.functions import fixed as K

    i = F.col("item_id")
    names = F.array(*[F.lit(p) for p in K.PROTOCOLS])
    protocol = lambda n: F.element_at(names, (n % len(K.PROTOCOLS) + 1).cast("int"))
    device = lambda n: F.concat(F.when(n % 3 == 0, "R").otherwise("S"), n.cast("string"))
    opening = F.element_at(F.array(*[F.lit(t) for t in ("état de ", "Pourquoi panne ", "Audit de ", "configure ")]), (i % 4 + 1).cast("int"))
    about = F.when(i % 5 == 4, "").otherwise(F.concat(protocol(i), F.lit(" et "), F.lower(protocol(i * 5 + 3)), F.lit(" ")))
    return table(spark, sf_dir, "benchmark").select(i.alias("question_id"), F.concat(
        opening, about, F.lit("sur "), device(i * 7), F.lit(" et "), device(i * 7 + 1), _text(" selon doc_", i * 7, ".pdf ? "),
        F.col("text")).alias("question"))


def _field_sql() -> str:
    from wiretally.functions import fixed as K

    names = _list_sql(K.PROTOCOLS)
    device = lambda n: f"CASE WHEN ({n}) % 3 = 0 THEN 'R' ELSE 'S' END || ({n})"
    return f"""asked AS (
  SELECT item_id AS question_id, (['état de ', 'Pourquoi panne ', 'Audit de ', 'configure '])[item_id % 4 + 1]
    || CASE WHEN item_id % 5 = 4 THEN '' ELSE ({names})[item_id % {len(K.PROTOCOLS)} + 1] || ' et '
      || lower(({names})[(item_id * 5 + 3) % {len(K.PROTOCOLS)} + 1]) || ' ' END
    || 'sur ' || {device('item_id * 7')} || ' et ' || {device('item_id * 7 + 1')} || ' selon doc_' || (item_id * 7) || '.pdf ? '
    || text AS question FROM benchmark)"""


FIELD_QUESTIONS = _field_sql()


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest row per document."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.md5(_text("file_", i).cast("binary")).alias("file_id"), _text("doc_", i, ".pdf").alias("filename"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (i * 7919) % 100_000).alias("ingested_at"),
        F.floor(F.col("n_chars") / 800).alias("chunks_indexed"),
    )


MANIFEST = """manifest AS (
  SELECT md5('file_' || doc_id) AS file_id, 'doc_' || doc_id || '.pdf' AS filename,
    TIMESTAMP '2024-01-01' + to_seconds((doc_id * 7919) % 100000) AS ingested_at, n_chars // 800 AS chunks_indexed
  FROM documents)"""


# --------------------------------------------------------------------------- device captures


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_from(table(spark, sf_dir, "documents"))


def sessions_from(documents: DataFrame) -> DataFrame:
    """One exported session per document: its lines become the rows of each command.

    Line j of length h gives one interface, VLAN, route and so on. The CPU
    command appears twice, the first time with a stale value.
    """
    def rows(head: str, line: str) -> str:
        return f"concat('{head}', array_join(transform(ls, (h, j) -> {line}), ''))"

    port = "concat('GigabitEthernet0/', j div 48, '/', j % 48)"
    phy = "CASE WHEN h % 4 = 0 THEN 'down' WHEN h % 7 = 1 THEN '*down' ELSE 'up' END"
    pro = "CASE WHEN h % 4 = 0 OR h % 7 = 1 OR h % 5 = 0 THEN 'down' ELSE 'up' END"
    state = "element_at(array('Full', 'Init', '2-Way', 'Full'), h % 4 + 1)"
    parts = {
        "display version": "concat('VRP (R) software, Version 5.', doc_id % 9, '\\nAcme AR', doc_id % 40, ' ', "
                           "CASE WHEN doc_id % 3 = 0 THEN 'Router' ELSE 'Switch' END, ' uptime is ', size(ls), ' days\\n',"
                           "CASE WHEN doc_id % 2 = 0 THEN 'Last reboot reason : power off\\n' ELSE '' END)",
        "display interface brief": rows("Interface                   PHY   Protocol\\n",
                                        f"concat({port}, '   ', {phy}, '    ', {pro}, '\\n')"),
        "display current-configuration": "concat('sysname ', name, CASE WHEN doc_id % 4 = 1 THEN '-OLD' ELSE '-CORE' END,"
            " '\\n#\\n', CASE WHEN doc_id % 2 = 0 THEN 'ospf 1\\n#\\n' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN "
            "'bgp 65001\\n#\\n' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN 'dhcp enable\\n' ELSE '' END, "
            f"array_join(transform(ls, (h, j) -> concat('interface ', {port}, '\\n', CASE WHEN h % 3 = 0 THEN "
            "concat(' ip address 10.', h % 256, '.', j, '.1 255.255.255.0\\n') ELSE ' description link\\n' END, '#\\n')), ''))",
        "display vlan": rows("VID  Type    Ports\\n1    common  UT:GE0/0/1(U)\\n",
                             "concat(2 + h % 4000, '    ', element_at(array('common', 'super', 'sub'), j % 3 + 1), "
                             "'  UT:GE0/0/', j % 48, '(U)\\n')"),
        "display ip routing-table": rows("Destination/Mask Proto Pre Cost Flags NextHop Interface\\n",
            "concat('10.', h % 256, '.', j, '.0/24  ', element_at(array('Direct', 'Static', 'OSPF', 'RIP', 'BGP', 'ISIS'), "
            f"j % 6 + 1), '  60  0  RD  10.0.0.', j % 250, '  ', {port}, '\\n')"),
        "display ospf peer": "CASE WHEN doc_id % 5 = 0 THEN " + rows("Router-Id Pri State Up Address Interface\\n",
            f"concat('10.1.', j, '.', h % 250, ' 1 ', {state}, '/DR 30 10.0.', j, '.2 ', {port}, '\\n')")
            + " ELSE " + rows(" OSPF Process 1 with Router ID 10.9.9.9\\n",
            "concat(CASE WHEN j % 3 = 0 THEN concat(' Area 0.0.0.0 interface 10.0.', j, '.1(', " + port + ", ')', chr(39), "
            "'s neighbors\\n') ELSE '' END, ' Router ID: 10.1.', j, '.', h % 250, '   Address: 10.0.', j, '.2\\n', "
            "CASE WHEN h % 6 = 5 THEN '' ELSE concat('   State: ', " + state + ", '  Mode:Nbr is Master\\n') END)") + " END",
        "display bgp peer": rows("Peer V AS MsgRcvd MsgSent OutQ Up/Down State PfxRcd\\n",
            "concat('192.168.', j, '.', h % 250, '  4 ', 65000 + j, '  10  10  0 00:05:23 ', "
            "CASE WHEN h % 3 = 0 THEN 'Idle' ELSE 'Established' END, CASE WHEN h % 2 = 0 THEN concat('  ', h % 100) ELSE '' END,"
            " '\\n')"),
        "display vrrp": rows("", "concat('Vlanif', 2 + h % 4000, ' | Virtual Router ', j + 1, '\\n', "
            "CASE WHEN h % 4 = 3 THEN '' ELSE concat(' State : ', CASE WHEN j % 2 = 0 THEN 'Master' ELSE 'Backup' END, '\\n') END,"
            " ' Virtual IP : 10.', h % 256, '.', j, '.254\\n', "
            "CASE WHEN j % 3 = 2 THEN '' ELSE concat(' Priority : ', 100 + j, '\\n') END)"),
        "display stp brief": rows(" MSTID  Port                        Role  STP State     Protection\\n",
            f"concat('   0    ', {port}, '  ', CASE WHEN j = 0 THEN 'ROOT' ELSE 'DESI' END, '  ', "
            "CASE WHEN h % 3 = 0 THEN 'discarding' ELSE 'FORWARDING' END, CASE WHEN h % 2 = 0 THEN '  BPDU' ELSE '' END, '\\n')"),
        "display lldp neighbor brief": rows("Local Intf     Neighbor Dev       Neighbor Intf     Exptime\\n",
            f"concat({port}, '  S', h, '  GE0/0/', j % 48, '  ', 60 + j, 's\\n')"),
        "display cpu-usage": "concat('CPU Usage : ', size(ls) % 100, '.5% Max: 99%\\n')",
        "display memory-usage": "CASE WHEN doc_id % 6 = 5 THEN 'No data\\n' WHEN doc_id % 6 = 4 THEN concat(n_chars % 100, '% of memory\\n') "
                                "ELSE concat('Memory Using Rate: ', n_chars % 100, '%\\n') END",
    }
    stale = "concat('[', name, ']display cpu-usage\\nCPU Usage : 1%\\n')"
    text = f"concat('# export of ', name, '\\n', {stale}, " + ", ".join(
        f"'[', name, ']{command}\\n', {body}" for command, body in parts.items()) + ", '[', name, ']\\n')"
    return (
        documents
        .select("doc_id", "n_chars", F.transform(F.split("text", "\n", -1), F.length).alias("ls"))
        .withColumn("name", F.expr("concat(CASE WHEN doc_id % 3 = 0 THEN 'R' ELSE 'S' END, doc_id)"))
        .select(F.col("name").alias("device_name"), F.lit("2024-01-01T00:00:00").alias("collected_at"),
                F.expr("CASE WHEN doc_id % 3 = 0 THEN 'ssh' ELSE 'file' END").alias("access_mode"),
                F.expr(text).alias("session_text"))
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wiretally.operators.telemetry import outputs_map

    return outputs_map(sessions(spark, sf_dir))


def capture_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the captured devices; every eleventh is missing from it."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").filter(i % 11 != 10).select(
        F.concat(F.when(i % 3 == 0, "R").otherwise("S"), i.cast("string")).alias("name"),
        F.when(i % 3 == 0, "router").otherwise("switch").alias("type"),
        F.when(i % 4 == 0, "telnet").otherwise("ssh").alias("protocol"),
        _text("10.7.", F.floor(i / 250) % 250, ".", i % 250).alias("mgmt_ip"))


CAPTURE_REGISTRY = """registry AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'R' ELSE 'S' END || doc_id AS name FROM documents WHERE doc_id % 11 <> 10)"""


# Rows the parsers must find, straight from the line lengths.
CAPTURE = LINES + """,
dv AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'R' ELSE 'S' END || doc_id AS device_name,
  len(string_split(text, chr(10))) AS n_lines, CASE WHEN doc_id % 3 = 0 THEN 'router' ELSE 'switch' END AS device_type,
  '10.7.' || ((doc_id // 250) % 250) || '.' || (doc_id % 250) AS mgmt_ip,
  CASE WHEN doc_id % 3 = 0 THEN 'ssh' ELSE 'file' END AS access_mode FROM documents),
jl AS (SELECT device_name, lh.doc_id, p AS j, h, 'GigabitEthernet0/' || (p // 48) || '/' || (p % 48) AS port,
  CASE WHEN h % 4 = 0 THEN 'down' WHEN h % 7 = 1 THEN '*down' ELSE 'up' END AS phy,
  CASE WHEN h % 4 = 0 OR h % 7 = 1 OR h % 5 = 0 THEN 'down' ELSE 'up' END AS pro,
  (['Full', 'Init', '2-Way', 'Full'])[h % 4 + 1] AS nbr FROM lh JOIN dv USING (doc_id)),
itf AS (SELECT device_name, doc_id, j, port AS name, phy AS phy_state, pro AS pro_state, phy || '/' || pro AS state,
  CASE WHEN h % 3 = 0 THEN '10.' || (h % 256) || '.' || j || '.1/255.255.255.0' ELSE '' END AS ip FROM jl),
vla AS (SELECT device_name, doc_id, -1 AS j, '1' AS id, 'common' AS type, 'UT:GE0/0/1(U)' AS ports FROM dv
  UNION ALL SELECT device_name, doc_id, j, (2 + h % 4000)::VARCHAR, (['common', 'super', 'sub'])[j % 3 + 1],
  'UT:GE0/0/' || (j % 48) || '(U)' FROM jl),
rou AS (SELECT device_name, doc_id, j, '10.' || (h % 256) || '.' || j || '.0/24' AS destination,
  (['Direct', 'Static', 'OSPF', 'RIP', 'BGP', 'ISIS'])[j % 6 + 1] AS protocol, '10.0.0.' || (j % 250) AS nexthop,
  port AS interface FROM jl),
osp AS (SELECT device_name, doc_id, j, '10.1.' || j || '.' || (h % 250) AS router_id, '10.0.' || j || '.2' AS address,
  CASE WHEN doc_id % 5 = 0 THEN port ELSE 'GigabitEthernet0/' || ((j - j % 3) // 48) || '/' || ((j - j % 3) % 48) END
    AS interface,
  CASE WHEN doc_id % 5 <> 0 AND h % 6 = 5 THEN '' ELSE nbr END AS state FROM jl),
bgp AS (SELECT device_name, doc_id, j, '192.168.' || j || '.' || (h % 250) AS peer_ip, (65000 + j)::VARCHAR AS "as",
  '00:05:23' AS up_down, CASE WHEN h % 3 = 0 THEN 'Idle' ELSE 'Established' END AS state,
  CASE WHEN h % 2 = 0 THEN (h % 100)::VARCHAR ELSE '0' END AS prefixes FROM jl),
vrr AS (SELECT device_name, doc_id, j, 'Vlanif' || (2 + h % 4000) AS interface, (j + 1)::VARCHAR AS vrid,
  CASE WHEN h % 4 = 3 THEN 'unknown' WHEN j % 2 = 0 THEN 'Master' ELSE 'Backup' END AS state,
  '10.' || (h % 256) || '.' || j || '.254' AS virtual_ip,
  CASE WHEN j % 3 = 2 THEN '' ELSE (100 + j)::VARCHAR END AS priority FROM jl),
stp AS (SELECT device_name, doc_id, j, '0' AS mstid, port, CASE WHEN j = 0 THEN 'ROOT' ELSE 'DESI' END AS role,
  CASE WHEN h % 3 = 0 THEN 'DISCARDING' ELSE 'FORWARDING' END AS state,
  CASE WHEN h % 2 = 0 THEN 'BPDU' ELSE 'NONE' END AS protection FROM jl),
lld AS (SELECT device_name, doc_id, j, port AS local_interface, 'S' || h AS neighbor_device,
  'GE0/0/' || (j % 48) AS neighbor_interface, (60 + j) || 's' AS expire FROM jl),
met AS (SELECT device_name, doc_id, n_lines % 100 + 0.5::DOUBLE AS cpu,
  CASE WHEN doc_id % 6 = 5 THEN NULL ELSE (n_chars % 100)::DOUBLE END AS memory FROM dv)"""


# --------------------------------------------------------------------------- manuals


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual line table: requirement lines per document line, by its position.

    Some requirements differ from the captured device (shifted, left out, added),
    and long manuals have stretches without any device name.
    """
    parts = """flatten(transform(ls, (h, j) -> filter(array(
      CASE WHEN j % 23 = 0 THEN concat('Equipement ', name, '-CORE-SWITCH',
        CASE WHEN doc_id % 4 = 1 THEN concat(' et S', doc_id + 1) ELSE '' END, ' :') END,
      CASE WHEN j % 6 <> 5 THEN concat('  VLAN ', 2 + h % 4000 + CASE WHEN j % 9 = 8 THEN 100 ELSE 0 END) END,
      CASE WHEN j % 8 = 6 THEN concat('vlan batch ', 2 + h % 4000, ' ', 2 + (h + 1) % 4000) END,
      CASE WHEN j % 4 = 1 THEN concat('ip route-static 10.', (h + CASE WHEN j % 12 = 5 THEN 1 ELSE 0 END) % 256, '.', j,
        '.0 255.255.255.0 10.0.0.', j % 250) END,
      CASE WHEN j % 5 = 0 THEN concat('Uplink GE 0/', j div 48, '/', j % 48, ' actif') END,
      CASE WHEN j % 7 = 3 THEN '  ' END,
      CASE WHEN j % 10 = 4 THEN concat('sysname ', name, '-CORE') END,
      CASE WHEN j % 13 = 6 THEN 'ospf area 0 network' END,
      CASE WHEN j % 9 = 2 THEN concat('port GigabitEthernet0/', j div 48, '/', j % 48, ' access') END
    ), x -> x IS NOT NULL)))"""
    named = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.transform(F.split("text", "\n", -1), F.length).alias("ls"))
        .withColumn("name", F.expr("concat(CASE WHEN doc_id % 3 = 0 THEN 'R' ELSE 'S' END, doc_id)"))
    )
    return unfold(named, [_text("doc_", F.col("doc_id"), ".pdf").alias("source_file")], F.expr(parts), "line",
                  "line_no").withColumn("line_no", F.col("line_no").cast("bigint"))


MANUAL = CAPTURE + """,
man0 AS (
  SELECT doc_id, device_name, j, h, 0 AS slot, 'dev' AS kind, 'Equipement ' || device_name || '-CORE-SWITCH'
    || CASE WHEN doc_id % 4 = 1 THEN ' et S' || (doc_id + 1) ELSE '' END || ' :' AS line FROM jl WHERE j % 23 = 0
  UNION ALL SELECT doc_id, device_name, j, h, 1, 'vlan', '  VLAN ' || (2 + h % 4000 + CASE WHEN j % 9 = 8 THEN 100 ELSE 0 END)
    FROM jl WHERE j % 6 <> 5
  UNION ALL SELECT doc_id, device_name, j, h, 2, 'batch', 'vlan batch ' || (2 + h % 4000) || ' ' || (2 + (h + 1) % 4000)
    FROM jl WHERE j % 8 = 6
  UNION ALL SELECT doc_id, device_name, j, h, 3, 'route', 'ip route-static 10.' || ((h + CASE WHEN j % 12 = 5 THEN 1 ELSE 0 END)
    % 256) || '.' || j || '.0 255.255.255.0 10.0.0.' || (j % 250) FROM jl WHERE j % 4 = 1
  UNION ALL SELECT doc_id, device_name, j, h, 4, 'ge', 'Uplink GE 0/' || (j // 48) || '/' || (j % 48) || ' actif' FROM jl
    WHERE j % 5 = 0
  UNION ALL SELECT doc_id, device_name, j, h, 5, 'blank', '  ' FROM jl WHERE j % 7 = 3
  UNION ALL SELECT doc_id, device_name, j, h, 6, 'sys', 'sysname ' || device_name || '-CORE' FROM jl WHERE j % 10 = 4
  UNION ALL SELECT doc_id, device_name, j, h, 7, 'ospf', 'ospf area 0 network' FROM jl WHERE j % 13 = 6
  UNION ALL SELECT doc_id, device_name, j, h, 8, 'port', 'port GigabitEthernet0/' || (j // 48) || '/' || (j % 48) || ' access'
    FROM jl WHERE j % 9 = 2),
man AS (SELECT *, 'doc_' || doc_id || '.pdf' AS source_file,
  row_number() OVER (PARTITION BY doc_id ORDER BY j, slot) - 1 AS line_no FROM man0),
named AS (SELECT doc_id, line_no, device_name AS device FROM man WHERE kind IN ('dev', 'sys')
  UNION ALL SELECT doc_id, line_no, 'S' || (doc_id + 1) FROM man WHERE kind = 'dev' AND doc_id % 4 = 1),
lastd AS (SELECT *, max(CASE WHEN kind IN ('dev', 'sys') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no)
  AS dev_line FROM man),
near AS (SELECT l.*, n.device, l.line_no - l.dev_line AS dist FROM lastd l JOIN named n
  ON n.doc_id = l.doc_id AND n.line_no = l.dev_line),
evl AS (SELECT DISTINCT source_file, device, vlan FROM (
    SELECT source_file, device, dist, 2 + h % 4000 + CASE WHEN j % 9 = 8 THEN 100 ELSE 0 END AS vlan FROM near WHERE kind = 'vlan'
    UNION ALL SELECT source_file, device, dist, 2 + h % 4000 FROM near WHERE kind = 'batch'
    UNION ALL SELECT source_file, device, dist, 2 + (h + 1) % 4000 FROM near WHERE kind = 'batch')
  WHERE dist <= 10 AND device NOT LIKE 'R%' AND vlan BETWEEN 2 AND 4094),
ert AS (SELECT source_file, line_no, device, '10.' || ((h + CASE WHEN j % 12 = 5 THEN 1 ELSE 0 END) % 256) || '.' || j || '.0'
  AS network, '255.255.255.0' AS mask, '10.0.0.' || (j % 250) AS next_hop FROM near WHERE kind = 'route' AND dist <= 10),
eif AS (SELECT DISTINCT source_file, device, 'GigabitEthernet0/' || (j // 48) || '/' || (j % 48) AS interface FROM near
  WHERE kind IN ('ge', 'port') AND dist <= 3),
ehn AS (SELECT DISTINCT source_file, device_name AS device, device_name || '-CORE' AS host_name FROM man WHERE kind = 'sys'),
dsrc AS (SELECT *, 'doc_' || doc_id || '.pdf' AS source_file FROM dv)"""


# --------------------------------------------------------------------------- history and reachability


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn t with assistant turn t + 1 as one history entry."""
    talk = table(spark, sf_dir, "conversations")
    c = F.col("conv_id")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"], "left").select(
        _text(c, "-", F.col("turn")).alias("id"), F.floor(c / 10).alias("user_key"), "question",
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.timestamp_seconds(F.lit(1_704_067_200) + c * 3600 + F.col("turn") * 60).alias("created_at"),
        F.when(c % 5 == 0, "pending").otherwise("done").alias("status"), (c % 5 == 1).alias("is_error"),
        (c % 3 == 0).alias("health_report_requested"))


HISTORY = """history AS (
  SELECT u.conv_id || '-' || u.turn AS id, u.conv_id // 10 AS user_key, u.conv_id, u.text AS question,
    coalesce(a.text, '') AS answer, TIMESTAMP '2024-01-01' + to_seconds(u.conv_id * 3600 + u.turn * 60) AS created_at,
    CASE WHEN u.conv_id % 5 = 0 THEN 'pending' ELSE 'done' END AS status, u.conv_id % 5 = 1 AS is_error,
    u.conv_id % 3 = 0 AS health_report_requested
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability of the registered devices; some are unknown."""
    return registry(spark, sf_dir).filter("ordinal % 5 <> 4").select("name", (F.col("ordinal") % 5 < 3).alias("reachable"))


REACHABILITY = REGISTRY + """,
reach AS (SELECT name, ordinal % 5 < 3 AS reachable FROM registry WHERE ordinal % 5 <> 4)"""

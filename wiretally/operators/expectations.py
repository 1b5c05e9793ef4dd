"""Expected configuration mined from manual text.

Input is a line table (source_file, line_no, line). A fact on a line belongs to
the devices named on the nearest line at most some lines back. Only lines that
name a device or hold a fact take part in the shuffle, and a manual of any
length is cut into segments that overlap by the window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.functions import fixed as K
from wiretally.functions.ordered import carry_last, number_rows, own_rows, segment_of, text_parts, with_halo
from wiretally.functions.rows import unfold
from wiretally.functions.text import all_matches, strip

LINES_PER_SEGMENT = 4096


def normal_name(raw: Column) -> Column:
    """Alias if there is one, else the leading S or R number, else upper case."""
    key = F.lower(strip(raw))
    pairs = []
    for alias, name in K.DEVICE_ALIASES.items():
        pairs += [F.lit(alias), F.lit(name)]
    number = F.nullif(F.upper(F.regexp_extract(key, r"^([sr]\d+)", 1)), F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), number, F.upper(raw))


def devices_on(line: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(line, K.DEVICE_NAME, 1), normal_name))


def holding(text: Column, word: str, found: Column) -> Column:
    """An array that is empty where ``word`` (upper case) does not occur: no pattern is tried there.

    Upper case, as patterns that ignore the case also take the long s for an s.
    """
    return F.when(F.contains(F.upper(text), F.lit(word)), found).otherwise(F.array())


def vlan_ids(line: Column, expand_ranges: bool = False) -> Column:
    """VLAN numbers in any of the four notations, 2 to 4094."""
    batches = F.flatten(F.transform(all_matches(line, K.MANUAL_VLAN_BATCH, 1), lambda m: F.split(strip(m), r"\s+")))
    lists = F.flatten(F.transform(all_matches(line, K.MANUAL_VLAN_LIST, 1), lambda m: all_matches(m, r"\d+")))
    texts = F.concat(batches, all_matches(line, K.MANUAL_VLAN, 1), all_matches(line, K.MANUAL_VLANIF, 1), lists)
    ids = F.transform(texts, lambda t: t.try_cast("int"))
    if expand_ranges:
        pattern = r"(?i)\b(\d{1,4})\s+to\s+(\d{1,4})\b"
        spans = F.transform(all_matches(line, pattern), lambda m: F.sequence(
            F.least(F.regexp_extract(m, pattern, 1).cast("int"), F.regexp_extract(m, pattern, 2).cast("int")),
            F.greatest(F.regexp_extract(m, pattern, 1).cast("int"), F.regexp_extract(m, pattern, 2).cast("int"))))
        ids = F.concat(ids, F.when(F.lower(line).contains("vlan"), F.flatten(spans)).otherwise(
            F.array().cast("array<int>")))
    found = F.array_distinct(F.filter(ids, lambda v: (v >= K.VLAN_MIN) & (v <= K.VLAN_MAX)))
    return holding(line, "VLAN", found)


def by_proximity(manual: DataFrame, facts: Column, window: int) -> DataFrame:
    """(source_file, line_no, device, fact) for every fact near a device name."""
    text = strip(F.col("line"))
    marked = (
        manual.withColumn("line", text)
        .filter(F.col("line") != "")
        .select("source_file", "line_no", devices_on(F.col("line")).alias("_devs"), facts.alias("_facts"))
        .filter((F.size("_devs") > 0) | (F.size("_facts") > 0))
    )
    spread, order = with_halo(marked, ["source_file"], "line_no", LINES_PER_SEGMENT, window, 0)
    active = F.last(F.when(F.size("_devs") > 0, F.col("_devs")), ignorenulls=True).over(order.rangeBetween(-window, 0))
    return (
        own_rows(spread.withColumn("_active", active))
        .filter(F.col("_active").isNotNull() & (F.size("_facts") > 0))
        .select("source_file", "line_no", F.explode("_active").alias("device"), "_facts")
        .select("source_file", "line_no", "device", F.explode("_facts").alias("fact"))
    )


def expected_vlans(manual: DataFrame, expand_ranges: bool = False) -> DataFrame:
    """Distinct (source_file, device, vlan); routers never receive VLANs."""
    found = by_proximity(manual, vlan_ids(F.col("line"), expand_ranges), K.VLAN_WINDOW)
    return (
        found.filter(~F.regexp_like("device", F.lit(r"^R\d+$")))
        .select("source_file", "device", F.col("fact").alias("vlan"))
        .distinct()
    )


def expected_routes(manual: DataFrame) -> DataFrame:
    part = lambda m, i: F.regexp_extract(m, K.MANUAL_ROUTE, i)
    facts = F.transform(all_matches(F.col("line"), K.MANUAL_ROUTE), lambda m: F.struct(
        part(m, 1).alias("network"), part(m, 2).alias("mask"), part(m, 3).alias("next_hop")))
    facts = holding(F.col("line"), "ROUTE-STATIC", facts)
    return by_proximity(manual, facts, K.ROUTE_WINDOW).select("source_file", "line_no", "device", "fact.*")


def interface_name(match: Column) -> Column:
    """Short prefixes are written out: GE, FE, Eth."""
    prefix = F.regexp_extract(match, K.MANUAL_INTERFACE, 1)
    key = F.replace(F.lower(prefix), F.lit("-"), F.lit(""))
    full = prefix
    for short, name in K.INTERFACE_PREFIXES.items():
        full = F.when(key == short, name).otherwise(full)
    return F.concat(full, F.regexp_extract(match, K.MANUAL_INTERFACE, 2))


def expected_interfaces(manual: DataFrame) -> DataFrame:
    facts = F.array_distinct(F.transform(all_matches(F.col("line"), K.MANUAL_INTERFACE), interface_name))
    return (
        by_proximity(manual, facts, K.INTERFACE_WINDOW)
        .select("source_file", "device", F.col("fact").alias("interface"))
        .distinct()
    )


#: A host-name phrase has fewer words than this, so it lies on as many lines that are not blank.
PHRASE_LINES = 5


def expected_host_names(manual: DataFrame) -> DataFrame:
    """Per device the last name given by the last pattern that gives one.

    White space inside a phrase may be any number of blank lines: they are left out, and
    the other lines are numbered anew.
    """
    written = number_rows(
        manual.filter(F.regexp_like("line", F.lit(r"(?U)\S"))).withColumn("_segment", segment_of(F.col("line_no"), LINES_PER_SEGMENT)),
        ["source_file"], "_segment", ["line_no"], "_at", "_lines")
    spread, order = with_halo(written, ["source_file"], "_at", LINES_PER_SEGMENT, 0, PHRASE_LINES)
    phrase = F.concat_ws("\n", "line", *[F.lead("line", i).over(order) for i in range(1, PHRASE_LINES + 1)])

    def named(number: int, pattern: str) -> Column:
        names = holding(F.col("_phrase"), K.HOST_NAME_MARKS[number], all_matches(F.col("_phrase"), pattern, 1))
        return F.transform(names, lambda m, i: F.struct(
            F.lit(number).alias("pattern_no"), F.col("line_no").alias("line_no"), i.alias("pos"), m.alias("name")))

    hits = F.flatten(F.array(*[named(n, p) for n, p in enumerate(K.HOST_NAME_PATTERNS)]))
    return (
        unfold(own_rows(spread.withColumn("_phrase", phrase)), ["source_file"], hits, "_h")
        .withColumn("device", normal_name(F.col("_h.name")))
        .filter(F.regexp_like("device", F.lit(r"^[SR]\d+$")))
        .groupBy("source_file", "device")
        .agg(F.max("_h")["name"].alias("host_name"))
    )


def manual_blocks(manual: DataFrame) -> DataFrame:
    """Text of the last block of each switch, in bounded parts.

    A block starts at a line that begins with a switch name, and belongs to the
    first switch name it holds.
    """
    starts = F.when(F.regexp_like("line", F.lit(r"(?i)^S\d+")) | (F.col("line_no") == 0), F.col("line_no"))
    blocks = carry_last(manual.withColumn("_start", starts), ["source_file"], "line_no", "_start",
                        LINES_PER_SEGMENT, "block")
    name = F.upper(F.regexp_extract("line", r"(?iU)\b(S\d+)\b", 1))
    owner = (
        blocks.withColumn("_name", name).filter(F.col("_name") != "")
        .groupBy("source_file", "block")
        .agg(F.min(F.struct("line_no", "_name"))["_name"].alias("device"))
    )
    last = owner.groupBy("source_file", "device").agg(F.max("block").alias("block"))
    lines = blocks.join(last, ["source_file", "block"]).withColumn("_at", F.col("line_no") - F.col("block"))
    return text_parts(lines, ["source_file", "device"], "_at", "line", LINES_PER_SEGMENT)

"""Cheapest repair of conversations that lost, repeated or broke turns.

A conversation must read system?, then user and assistant in turn. Every turn is
a table of costs between the four states a conversation can be in (nothing yet,
after system, after user, after assistant). The cheapest edits are found by
divide and conquer: costs from the front and costs from the back meet in the
middle, the crossing is fixed, and both halves are solved alike. Costs carry the
rank of their edits among the edits of the other states, so ties are settled
without keeping any edits. A run of turns is again such a table, so long
conversations are cut into segments, and the same meeting in the middle joins
the segments of a partition and the partitions of a conversation.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wiretally.llm.common import saved

#: A segment ends after this many turns or characters.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 1_000_000
# Costs of the edits and of leaving a truncated turn, and the faults.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT_OFF = 0, 1, 2, 3
#: States: nothing yet, after system, after user, after assistant.
STATES = range(4)
INITIALS = "sua"
BLANKS = " \t\n\x0b\x0c\r"
ENDLESS = 1 << 60
#: Edits and cost that close a conversation from each state.
CLOSING = ("", "II", "I", "")
CLOSED = tuple((INSERT * len(e), e) for e in CLOSING)


def following(state: int) -> int:
    """State after an inserted or re-roled turn: user unless a user spoke last."""
    return 3 if state == 2 else 2


def kept(state: int, initial: int) -> int | None:
    """State after a turn that keeps its role, None where it must not stand."""
    allowed = {0: (0,), 1: (0, 1, 3), 2: (2,)}.get(initial, ())
    return initial + 1 if state in allowed else None


@lru_cache(None)
def turn_table(code: int) -> tuple[list, list]:
    """Cost and edits from state to state of one turn; insertions lie in front of it. ``code``: fault and initial."""
    fault, initial = divmod(code, 4)
    cost, edits = ([[bad] * 4 for _ in STATES] for bad in (ENDLESS, ""))
    for start in STATES:
        state, price, done = start, 0, ""
        for _ in range(4):
            ways = [(price + DELETE, done + "D", state)]
            if fault in (FINE, CUT_OFF):
                left = price + (TRUNCATED if fault == CUT_OFF else 0)
                ways.append((left + REROLE, done + "R", following(state)))
                to = kept(state, initial)
                if to is not None:
                    ways.append((left, done + "K", to))
            for total, letters, to in ways:
                if (total, letters) < (cost[start][to], edits[start][to]) or cost[start][to] == ENDLESS:
                    cost[start][to], edits[start][to] = total, letters
            state, price, done = following(state), price + INSERT, done + "I"
    return cost, edits


def forward(tables, starts=STATES) -> dict[int, list[tuple[int, int]]]:
    """Per start: cheapest cost to each state and the rank of its edits among those of all starts and states."""
    vectors = {a: [(0, 0) if s == a else (ENDLESS, 0) for s in STATES] for a in starts}
    for cost, edits in tables:
        best = {a: [min((v[s][0] + cost[s][t], v[s][1], edits[s][t]) for s in STATES) for t in STATES]
                for a, v in vectors.items()}
        order = {e: n for n, e in enumerate(sorted({b[1:] for row in best.values() for b in row if b[0] < ENDLESS}))}
        vectors = {a: [(b[0], order[b[1:]]) if b[0] < ENDLESS else (ENDLESS, 0) for b in row] for a, row in best.items()}
    return vectors


def backward(tables, end) -> list[tuple[int, int]]:
    """Per state in front: cheapest cost to ``end`` (cost and rank of each last state) and the rank of its edits."""
    vector = end
    for cost, edits in reversed(tables):
        best = [min((cost[s][t] + vector[t][0], edits[s][t], vector[t][1]) if max(cost[s][t], vector[t][0]) < ENDLESS
                    else (ENDLESS, edits[s][t], vector[t][1]) for t in STATES) for s in STATES]
        order = {e: n for n, e in enumerate(sorted({b[1:] for b in best if b[0] < ENDLESS}))}
        vector = [(b[0], order[b[1:]]) if b[0] < ENDLESS else (ENDLESS, 0) for b in best]
    return vector


def fixed(state: int):
    """The end vector that allows one state only; the end of a conversation for a negative one."""
    return list(CLOSED) if state < 0 else [(0, 0) if s == state else (ENDLESS, 0) for s in STATES]


def crossings(tables, start: int, end) -> list[int]:
    """State behind each table on the cheapest way, of the cheapest ways the one whose edits come first."""
    if len(tables) == 1:
        cost, edits = tables[0]
        return [min((t for t in STATES), key=lambda t: (cost[start][t] + end[t][0], edits[start][t], end[t][1])
                    if max(cost[start][t], end[t][0]) < ENDLESS else (ENDLESS, edits[start][t], end[t][1]))]
    middle = len(tables) // 2
    left, right = tables[:middle], tables[middle:]
    front, back = forward(left, (start,))[start], backward(right, end)
    state = min((s for s in STATES if max(front[s][0], back[s][0]) < ENDLESS),
                key=lambda s: (front[s][0] + back[s][0], front[s][1], back[s][1]))
    return crossings(left, start, fixed(state)) + crossings(right, state, end)


def joined(tables) -> tuple[list, list]:
    """One table for a run of tables."""
    found = forward(tables)
    return [[found[s][t][0] for t in STATES] for s in STATES], [[found[s][t][1] for t in STATES] for s in STATES]


def edits_of(codes: bytes, start: int, end: int) -> list[str]:
    """Edits of each turn of a segment between two states; ``end`` < 0 closes the conversation and may add one entry."""
    tables = [turn_table(c) for c in codes]
    states = [start, *(crossings(tables, start, fixed(end)) if tables else [])]
    out = [t[1][a][b] for t, a, b in zip(tables, states, states[1:])]
    return out + [CLOSING[states[-1]]] if end < 0 else out


@lru_cache(50_000)
def short_edits(codes: bytes) -> list[str]:
    return edits_of(codes, 0, -1)


def repaired(edits: list[str], roles: list[str], texts: list[str], start: int) -> list[tuple]:
    """(edit, role, text, index of the turn or None) of every edit in order; deleted turns keep their own role."""
    out, state = [], start
    for n, letters in enumerate(edits):
        for letter in letters:
            if letter == "D":
                out.append(("D", roles[n], texts[n], n))
                continue
            if letter == "K":
                state = INITIALS.index(roles[n][0]) + 1
                out.append(("K", roles[n], texts[n], n))
                continue
            state = following(state)
            role = "assistant" if state == 3 else "user"
            out.append((letter, role, texts[n], n) if letter == "R" else (letter, role, "", None))
    return out


def turn_key(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).hexdigest()


def coded(roles: list[str], texts: list[str], earlier=frozenset()) -> bytes:
    """First fault and role initial of each turn; ``earlier`` holds keys of turns seen before the segment."""
    seen, out = set(), bytearray()
    for role, text in zip(roles, texts):
        shown = text.rstrip(BLANKS)
        again = (role, text) in seen or bool(earlier) and turn_key(role, text) in earlier
        seen.add((role, text))
        fault = BLANK if not shown else DUPLICATE if again else FINE if shown[-1] in ".!?" else CUT_OFF
        initial = INITIALS.find(role[0]) if role else -1
        out.append(4 * fault + (initial if initial >= 0 else 3))
    return bytes(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage of a fixed rule on crc32 of ``conv_id:turn``; nulls of role and text are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), blank("role").alias("role"),
                                blank("text").alias("text"), draw.alias("_d"))
    return rows.filter("_d <> 0").select(
        "conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))


SEGMENT = "conv_id bigint, part int, no int, alone boolean, turns array<bigint>, roles array<string>, texts array<string>"


def segments(turns: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Turns in order of conv_id and turn (nulls first; equal turns by role and text), packed into segments.

    The order is a range partitioning of all turns, so one conversation may lie
    in many partitions; rows that agree in everything are dealt by a row number.
    (part, no) orders the segments of a conversation. ``alone`` is true for a
    segment that is known to be a whole conversation.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("_copy")]
    placed = turns.withColumn("_row", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order, F.asc("_row")).sortWithinPartitions(*order, F.asc("_row"))
    arrow = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("alone", pa.bool_()),
                       ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches):
        part = TaskContext.get().partitionId()
        conv, first, no, rows, chars, out, waiting = None, None, 0, [], 0, [], 0
        begun = False

        def close(whole):
            nonlocal no, rows, chars, waiting
            turns, roles, texts = map(list, zip(*rows))
            out.append({"conv_id": conv, "part": part, "no": no, "alone": whole, "turns": turns, "roles": roles, "texts": texts})
            waiting += chars
            no, rows, chars = no + 1, [], 0

        def sent():
            nonlocal out, waiting
            batch = pa.RecordBatch.from_pylist(out, schema=arrow)
            out, waiting = [], 0
            return batch

        for batch in batches:
            for c, turn, role, text in zip(*(batch.column(n).to_pylist() for n in range(4))):
                if begun and c != conv:
                    if rows:
                        close(no == 0 and not first)
                    first, no = False, 0
                elif rows and (len(rows) >= size or chars + len(text) > SEGMENT_CHARS):
                    close(False)
                if not begun:
                    begun, first = True, True
                conv = c
                rows.append((turn, role, text))
                chars += len(text)
                if len(out) >= 2000 or waiting > 8_000_000:
                    yield sent()
        if rows:
            close(False)
        if out:
            yield sent()

    return ranged.select("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENT)


def by_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """Rows -> rows by a function on dictionaries, some hundred rows a time."""
    kind = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches):
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = [out for row in batch.slice(at, 512).to_pylist() for out in fn(row)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, kind)


def key_of(conv: str = "conv_id") -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null"))


PLACE = ["conv", "part", "no"]


def endpoints(parted: DataFrame) -> DataFrame:
    """State in front of and behind every segment of the conversations that have several: conv, part, no, codes, start, end.

    Turns seen in an earlier segment are found by (conversation, turn) keys, one
    per segment, so a turn repeated all over a conversation is one row per
    segment. Tables of segments are joined within a partition, then over the
    partitions; the crossings go the same way back. No list is longer than the
    segments of one partition or the number of partitions.
    """
    keys = saved(by_rows(parted.select(*PLACE, "roles", "texts"), lambda r: [
        {**{c: r[c] for c in PLACE}, "key": k} for k in {turn_key(a, b) for a, b in zip(r["roles"], r["texts"])}],
        "conv string, part int, no int, key string"), "turn-keys")
    here = F.struct("part", "no")
    first = keys.groupBy("conv", "key").agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    earlier = (keys.join(first.drop("_n"), ["conv", "key"]).filter(here > F.col("_first"))
               .groupBy(*PLACE).agg(F.collect_list("key").alias("earlier")))

    def summed(r):
        codes = coded(r["roles"], r["texts"], frozenset(r["earlier"] or ()))
        cost, rank = joined([turn_table(c) for c in codes])
        return [{**{c: r[c] for c in PLACE}, "codes": codes, "cost": cost, "rank": rank}]

    tables = saved(by_rows(
        parted.select(*PLACE, "roles", "texts").join(earlier, PLACE, "left"), summed,
        "conv string, part int, no int, codes binary, cost array<array<bigint>>, rank array<array<bigint>>"), "turn-tables")

    def ordered(at):
        return F.array_sort(F.collect_list(F.struct(at, "cost", "rank"))).alias("runs")

    def over(r):
        return [(x["cost"], x["rank"]) for x in r["runs"]]

    def whole(r):
        cost, rank = joined(over(r))
        return [{"conv": r["conv"], "part": r["part"], "cost": cost, "rank": rank}]

    within = saved(by_rows(tables.groupBy("conv", "part").agg(ordered("no")), lambda r: [
        {**x, "runs": r["runs"]} for x in whole(r)],
        "conv string, part int, cost array<array<bigint>>, rank array<array<bigint>>, "
        "runs array<struct<no: int, cost: array<array<bigint>>, rank: array<array<bigint>>>>"), "turn-runs")

    def ends(r, at):
        states = crossings(over(r), r["start"], fixed(r["end"]))
        last = len(states) - 1
        return [{"conv": r["conv"], at: x[at], "start": a, "end": b if n < last else min(r["end"], b)}
                for n, (x, a, b) in enumerate(zip(r["runs"], [r["start"], *states], states))]

    parts = by_rows(
        within.groupBy("conv").agg(ordered("part")).withColumns({"start": F.lit(0), "end": F.lit(-1)}),
        lambda r: ends(r, "part"), "conv string, part int, start int, end int")
    places = by_rows(
        within.select("conv", "part", "runs").join(parts, ["conv", "part"]),
        lambda r: [{**x, "part": r["part"]} for x in ends(r, "no")], "conv string, part int, no int, start int, end int")
    return places.join(tables.select(*PLACE, "codes"), PLACE)


SOLVED = SEGMENT + ", codes binary, edits array<string>, start int"


def solved_segments(conversations: DataFrame, damage: bool = True, size: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of all conversations with the fault code of each turn and its edits.

    ``edits`` has one string per turn, insertions in front of the turn's own
    letter; the last segment of a conversation has one more, the insertions
    behind it. ``damage=False`` repairs the turns as they are.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = damaged(conversations) if damage else conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), blank("role"), blank("text"), F.lit(0).alias("_copy"))
    cut = saved(segments(turns, size), "segments")

    def alone(r):
        codes = coded(r["roles"], r["texts"])
        return [{**r, "codes": codes, "edits": short_edits(codes), "start": 0}]

    def between(r):
        return [{**{k: v for k, v in r.items() if k not in ("conv", "end")}, "edits": edits_of(r["codes"], r["start"], r["end"])}]

    parted = cut.filter(~F.col("alone")).withColumn("conv", key_of())
    return by_rows(cut.filter("alone"), alone, SOLVED).unionByName(
        by_rows(parted.join(endpoints(parted), PLACE), between, SOLVED))


def repaired_turns(conversations: DataFrame, damage: bool = True, size: int = SEGMENT_ROWS) -> DataFrame:
    """Every edit as a row: conv_id, part, no, at (its order), edit, fault, turn, role, text.

    Inserted turns have no turn number; deleted ones keep role and text, and are
    to be left out by who wants the repaired conversation.
    """
    names = ("", "blank", "duplicate", "truncated")

    def rows(r):
        return [{"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "at": at, "edit": edit, "role": role, "text": text,
                 "turn": None if n is None else r["turns"][n], "fault": None if n is None else names[r["codes"][n] // 4]}
                for at, (edit, role, text, n) in enumerate(repaired(r["edits"], r["roles"], r["texts"], r["start"]))]

    return by_rows(solved_segments(conversations, damage, size), rows,
                   "conv_id bigint, part int, no int, at int, edit string, fault string, turn bigint, role string, text string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


class Report:
    """Numbers of one conversation, fed with its segments in order."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.audit, self.hash, self.lines = conv_id, dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), 0
        self.low = self.high = self.initial = None
        self.distinct = 0

    def add(self, r) -> None:
        codes = r["codes"]
        for n, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT_OFF, "truncated")):
            self.counts[name] += sum(c // 4 == n for c in codes)
        for role in r["roles"]:
            if self.initial is not None:
                self.counts["illegal"] += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        for turn in r["turns"]:
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.distinct += turn != self.high
                self.high = turn
        edits = "".join(r["edits"])
        self.audit.append(edits)
        for edit, role, text, n in repaired(r["edits"], r["roles"], r["texts"], r["start"]):
            self.counts["cost"] += COST[edit] + (TRUNCATED if edit in "KR" and codes[n] // 4 == CUT_OFF else 0)
            if edit != "D":
                self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
                self.lines += 1

    def row(self) -> dict:
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.distinct
        return {"conv_id": self.conv_id, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def conversation_reports(conversations: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conv_id of the table after the fixed damage: faults, cost, audit and hash of the cheapest repair.

    Nulls of role and text are one space; rows with a null conv_id are one
    conversation, a null turn comes first and does not count for gaps. Equal
    turns are ordered by role and text, repeated rows are turns of their own. A
    conversation without turns after the damage has zeros, an empty audit and
    the hash of nothing. Other columns, whatever their names, are not read; an
    empty table gives no rows. Whole conversations of one segment are reported
    where they lie; the segments of the others pass one task in order, which
    holds one segment at a time and the audit.
    """
    kind = T.StructType.fromDDL(REPORT)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, report, out = to_arrow_schema(kind), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if report is None or report.conv_id != r["conv_id"]:
                        if report is not None:
                            out.append(report.row())
                        report = Report(r["conv_id"])
                    report.add(r)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if report is not None:
            yield pa.RecordBatch.from_pylist([*out, report.row()], schema=arrow)

    solved = saved(solved_segments(conversations, True, size), "solved")
    parted = solved.filter(~F.col("alone"))
    streamed = parted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    gone = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.max(draw).alias("_d")).filter("_d = 0")
    zeros = gone.select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS], F.lit("").alias("audit"),
                        F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return solved.filter("alone").mapInArrow(run, kind).unionByName(streamed.mapInArrow(run, kind)).unionByName(zeros)

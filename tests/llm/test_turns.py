"""Conversation repair against a search that keeps whole edit strings, and the query against plain Python."""
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wiretally.llm import queries, turns

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def least_edits(codes):
    """(cost, edits) of the cheapest repair, by strings kept for every state."""
    step = lambda s: 3 if s == 2 else 2

    def inserted(held):
        for _ in range(4):
            for s, (cost, edits) in list(held.items()):
                new = (cost + 5, edits + "I")
                if step(s) not in held or new < held[step(s)]:
                    held[step(s)] = new
        return held

    held = {0: (0, "")}
    for code in codes:
        fault, initial = divmod(code, 4)
        ways = []
        for s, (cost, edits) in inserted(dict(held)).items():
            ways.append((s, cost + 2, edits + "D"))
            if fault in (0, 3):
                cost += 5 * (fault == 3)
                ways.append((step(s), cost + 1, edits + "R"))
                to = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((initial, s))
                if to is not None:
                    ways.append((to, cost, edits + "K"))
        held = {}
        for s, cost, edits in ways:
            held[s] = min(held.get(s, (cost, edits)), (cost, edits))
    held = inserted(held)
    return min(held[s] for s in (0, 3) if s in held)


CODES = st.lists(st.sampled_from([0, 1, 2, 3, 4, 8, 12, 13, 14, 15]), max_size=14).map(bytes)


@settings(max_examples=300, deadline=None)
@given(CODES)
def test_edits_are_the_cheapest_and_first(codes):
    assert "".join(turns.edits_of(codes, 0, -1)) == least_edits(codes)[1]


@settings(max_examples=200, deadline=None)
@given(CODES.filter(len), st.integers(1, 4))
def test_segments_meet_as_turns_do(codes, size):
    parts = [codes[i:i + size] for i in range(0, len(codes), size)]
    tables = [turns.joined([turns.turn_table(c) for c in part]) for part in parts]
    states = [0, *turns.crossings(tables, 0, turns.fixed(-1))]
    ends = [*states[1:-1], -1]
    assert "".join("".join(turns.edits_of(*x)) for x in zip(parts, states, ends)) == least_edits(codes)[1]


def expected(rows):
    """The contract in plain Python."""
    out = []
    for conv in {r[0] for r in rows}:
        held = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv),
                                          key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
            role, text = " " if role is None else role, " " if text is None else text
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if draw == 0:
                continue
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            held += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, faults = set(), [], Counter()
        for _, role, text in held:
            shown = re.findall("[^\x20\x09-\x0D]", text)
            fault = 1 if not shown else 2 if (role, text) in seen else 0 if shown[-1] in ".!?" else 3
            seen.add((role, text))
            faults[fault] += 1
            codes.append(4 * fault + ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3))
        cost, edits = least_edits(codes)
        numbers = [t for t, _, _ in held if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        lines, at, state = [], 0, 0
        for e in edits:
            new = "assistant" if state == 2 else "user"
            if e == "K":
                lines.append(":".join(held[at][1:]))
                state = "sua".index(held[at][1][0]) + 1
            elif e in "RI":
                lines.append(f"{new}:{held[at][2] if e == 'R' else ''}")
                state = 3 if new == "assistant" else 2
            at += e != "I"
        out.append((conv, gaps, faults[1], faults[2], faults[3], illegal, cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def reported(df, size=turns.SEGMENT_ROWS):
    found = turns.conversation_reports(df, size).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(map(tuple, found.collect()), key=str)


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_turns(spark, SF).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("size", [3, turns.SEGMENT_ROWS])
def test_long_conversations_nulls_ties_and_repeats(spark, size):
    draw = random.Random(4)
    rows = [(1, t, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(["Yes.", "no", "Why?", " \n", f"t {t}!"]))
            for t in range(400)]
    rows += [(2, t // 3, "user" if t % 2 else "assistant", "same.") for t in range(60)]
    rows += [(None, None, None, None), (None, 3, "user", "x"), (3, None, "assistant", "a."), (3, None, "user", "é!"),
             (4, 7, "tool", ""), (5, 1, "", "ok."), (6, -4, "user", "y" * 300_000 + "."), (6, 9, "user", " .")]
    rows += [(n, 0, "user", "one.") for n in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert reported(df, size) == expected(rows)


def test_clashing_columns_and_empty_tables(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    wide = df.withColumns({c: F.lit("x") for c in ("part", "no", "conv", "codes", "_d", "_copy", "audit", "alone")})
    assert reported(wide) == reported(df)
    assert reported(df.limit(0)) == []


def test_repaired_turns_spell_the_hash(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    edits = turns.repaired_turns(df, size=2).collect()
    held = {}
    for r in sorted(edits, key=lambda r: (r.conv_id, r.part, r.no, r.at)):
        audit, lines = held.setdefault(r.conv_id, ([], []))
        audit.append(r.edit)
        if r.edit != "D":
            lines.append(f"{r.role}:{r.text}")
    want = {r.conv_id: (r.audit, r.repaired_sha256) for r in turns.conversation_reports(df).collect() if r.audit}
    assert {c: ("".join(a), hashlib.sha256("\n".join(t).encode()).hexdigest()) for c, (a, t) in held.items()} == want

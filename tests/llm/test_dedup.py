"""Near-duplicate classes and repeated passages against brute force."""
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wiretally.llm import simhash, substrings
from wiretally.llm.suffixes import suffix_array

TABLE = "doc_id long, text string"
WORDS = ["alpha", "beta", "gamma", "delta", "été", "zeta"]


def test_suffix_array():
    draw = random.Random(3)
    for _ in range(1500):
        letters = draw.choice([b"ab", b"abc", b"a", bytes(range(256)), b"\0\1"])
        text = bytes(draw.choice(letters) for _ in range(draw.randint(0, 60))) * draw.randint(1, 3)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_golay_keys():
    patterns = simhash.error_patterns()
    draw = np.random.default_rng(0)
    a = draw.integers(0, 1 << 23, 2000)
    for errors in (0, 1, 2):
        b = a.copy()
        for i in range(len(b)):
            for bit in draw.choice(23, errors, replace=False):
                b[i] ^= 1 << int(bit)
        near = [[set(r[r >= 0]) for r in simhash.nearby_codewords(x, patterns)] for x in (a, b)]
        assert all(x & y for x, y in zip(*near))
    f = draw.integers(0, 2**63, 1000).astype(np.uint64)
    g = f.copy()
    for i in range(len(g)):
        for bit in draw.choice(64, 4, replace=False):
            g[i] ^= np.uint64(1 << int(bit))
    keys = []
    for x in (f, g):
        held = [set() for _ in x]
        for row, key in zip(*(v.tolist() for v in simhash.fuzzy_keys(x, patterns))):
            held[row].add(key)
        keys.append(held)
    assert all(x & y for x, y in zip(*keys))


def brute_classes(rows):
    def fingerprint(text):
        words = [w for w in bytes(c if c not in b"\x20\x09\x0a\x0b\x0c\x0d" else 32 for c in (text or "").encode().lower()).split(b" ") if w]
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[i] != label[j] and bin(fps[i] ^ fps[j]).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc, _), k in zip(rows, label):
        if doc is not None:
            least[k] = min(doc, least.get(k, doc))
    return sorted(((d, f"{f:016x}", least.get(k)) for (d, _), f, k in zip(rows, fps, label)), key=str)


def test_classes(spark):
    draw = random.Random(5)
    base = [" ".join(draw.choice(WORDS) for _ in range(120)) for _ in range(12)]
    rows = [(i, None if i == 3 else "" if i == 4 else " \t\n" if i == 5 else draw.choice(base) + f" tail {i % 3}") for i in range(60)]
    rows += [(7, "A b"), (7, "A b"), (None, "a B"), (90, "x"), (91, "Äb c d e")]
    got = simhash.near_duplicate_classes(spark.createDataFrame(rows, TABLE).repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows)
    assert simhash.near_duplicate_classes(spark.createDataFrame([], TABLE)).count() == 0


def test_one_stays(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    long = [" ".join(draw.sample(words, 300)) for _ in range(5)]
    rows = [(10 * i, t, "s", i) for i, t in enumerate(long)]
    rows += [(10 * i + 1, t.replace(t.split()[40], "other", 1), "s", 0) for i, t in enumerate(long)]      # one edit each
    rows += [(100 + i, long[0], "s", 1) for i in range(20)]
    rows += [(0, long[0], "s", 1), (None, long[1], "s", 2), (500, None, "s", 3), (501, "", None, 4), (502, "only me", "s", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    kept = simhash.without_near_duplicates(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=lambda x: (x is None, x)) == [0, 10, 20, 30, 40, 500, 502, None]
    assert simhash.without_near_duplicates(table.limit(0)).count() == 0


def brute_kept(rows, words=5, similarity=0.8):
    """Ids that stay: in order of doc_id, what is not near to one that stays."""
    def shingles(text):
        found = text.lower().split()
        return {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))}

    stays = []
    for doc, text in sorted(rows):
        mine = shingles(text)
        if not any(len(mine & s) >= similarity * len(mine | s) for _, s in stays):
            stays.append((doc, mine))
    return [doc for doc, _ in stays]


def test_every_group_of_a_vocabulary_is_judged(spark):
    """Twelve texts with the same words in another order, each with exact and near copies."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(draw.sample(words, 300)) for _ in range(12)]
    rows = [(i + 100 * c, t if c % 2 == 0 else t.replace(t.split()[20 * c], "other", 1)) for i, t in enumerate(base) for c in range(4)]
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, TABLE).repartition(4)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(12)) == brute_kept(rows)


def test_near_copies_of_a_missing_text_are_not_paired_as_rows(spark):
    """Copies of one text, most of them not near to each other: blocks hold a row a text, and the result is that of brute force."""
    draw = random.Random(10)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for doc in range(240):
        text = list(base)
        for at in draw.sample(range(80), 2 if doc % 3 else 1):
            text[at] = f"n{doc}x{at}"
        rows.append((doc, " ".join(text)))
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, TABLE).repartition(4)).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows)
    left = spark.range(4000).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("key"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("low"))
    ahead = left.filter("node < 128").select("key", F.col("node").alias("least"))
    widths = spark.range(4000).select(F.col("id").alias("node"), F.lit(60).cast("bigint").alias("width"))
    texts, leaders = simhash.comparison_blocks(left, ahead, widths, 64)
    assert texts.select("node").distinct().count() == texts.count() == 4000
    assert leaders.count() == 128 * texts.select("block").distinct().count() <= 128 * 4


def test_near_duplicates_by_all_shingles(spark):
    """Long texts with similarities close above and below 0.8: decided as brute force does."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for group in range(12):
        base = draw.sample(words, 600)
        rows.append((100 * group, " ".join(base)))
        for edits in range(8, 19):                                  # each edit takes five shingles: 0.87 to 0.73
            text = list(base)
            for at in range(edits):
                text[10 + 30 * at] = f"new{group}x{edits}x{at}"
            rows.append((100 * group + edits, " ".join(text)))
    draw.shuffle(rows)
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, TABLE).repartition(4)).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows)


def brute_repeats(rows, span=50):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - span + 1):
                first[data[i:i + span]] = min(first.get(data[i:i + span], doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if doc is not None:
            for i in range(len(data) - span + 1):
                if first[data[i:i + span]] < doc:
                    gone[i:i + span] = b"\1" * span
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, y in zip(data, gone) if not y)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [64, 2])
def test_repeats(spark, hot, monkeypatch):
    """Also with every frequent minimizer dealt window by window."""
    monkeypatch.setattr(substrings, "HOT_BATCHES", hot)
    draw = random.Random(1)
    base = [" ".join(draw.choice(WORDS) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(120):
        text, kind, at = draw.choice(base), draw.random(), draw.randint(0, 200)
        if kind < 0.3:
            text = text[:at] + str(i) + text[at:]
        elif kind < 0.5:
            text = str(i * 7919) * 9 + text[at:at + 70] + str(i)
        elif kind < 0.65:
            text = None if kind < 0.6 else ""
        elif kind < 0.75:
            text = "a" * draw.randint(40, 200)
        elif kind < 0.9:
            text = "".join(draw.choice("ab") for _ in range(300))
        rows.append((i if i % 17 else (None if i % 2 else i // 2), text))
    got = substrings.document_repeats(spark.createDataFrame(rows, TABLE).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_cleaned_keeps_columns(spark):
    text = "é" * 40 + " " + "passage of text that stands in both documents " * 2
    rows = [(1, text, "a", len(text)), (2, "new " + text + "end", "b", 4 + len(text) + 3), (3, None, "c", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars long")
    got = {r.doc_id: r for r in substrings.cleaned(table).collect()}
    assert got[1].text == text and got[1].kept == "a"
    assert got[2].text == "new end" and got[2].n_chars == 7
    assert got[3].text is None
    assert substrings.cleaned(table.limit(0)).count() == 0

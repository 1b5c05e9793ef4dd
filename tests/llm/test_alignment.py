"""Alignment of two tokenizers against a merge of their token ends and a count over all links."""
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wiretally.llm import alignment, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def expected(rows):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    held, counts = [], Counter()
    for doc_id, text in rows:
        found = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            left = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in a]
            right = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i)
                     else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                i = j = p = q = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if p <= q:
                        p, i = p + len(left[i]), i + 1
                        group[0].append(a[i - 1])
                    else:
                        q, j = q + len(right[j]), j + 1
                        group[1].append(b[j - 1])
                    if p == q:
                        found.append(group)
                        group = ([], [])
        links = Counter((x, y) for g in found for x in g[0] for y in g[1])
        counts.update(links.keys())
        held.append((doc_id, found, links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, found, links in held:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in found)
        out.append((doc_id, sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), sum(links.values()),
                    sum(n for l, n in links.items() if counts[l] == top[l[0]]), sum(n * counts[l] for l, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=str)


ODD = [(1, None), (2, ""), (3, "▁x"), (None, " a  b"), (None, " a  b"), (4, "don't\n\n\tThe <|endoftext|> <s> ½²3 x²³4 中文😀 a,b  "),
       (5, "x" * 3000), (5, "中" * 500), (6, "　a b   c\x1c d \x85e"), (7, "'s 'll it's 't\n 's"), (8, " "), (9, "\n")]


def test_query_against_plain_counting(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_alignment(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


@pytest.mark.parametrize("sent", [1_000_000, 20, 0])
def test_counts_sent_or_joined(spark, sent):
    rows = ODD + [(100 + n, f"word {n % 7} and more, {'x' * (n % 5)}") for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("x") for c in ("pairs", "n_a", "rest", "_row", "pair", "n", "best")}).repartition(5)
    got = alignment.aligned_documents(df, pairs_sent=sent).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.aligned_documents(df).collect() == []


def test_groups_lie_on_the_bytes(spark):
    rows = alignment.alignments(spark.createDataFrame(ODD, "doc_id bigint, text string")).collect()
    held = alignment.aligner(None, None)
    for r, (_, text) in zip(rows, ODD):
        raw = (" " + (text or "")).encode()
        for g in r.groups:
            assert b"".join(held.a.bytes[i] for i in g.a_ids) == raw[g.start:g.end]
            assert b"".join(held.b.bytes[i] for i in g.b_ids) == raw[g.start:g.end]
        assert (r.groups[-1].end == len(raw)) if r.groups else (not text or "▁" in text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab éÜſ_ 12 .,'!-\n\t\r  z")), max_size=30))
def test_both_engines_cut_plain_texts_alike(text):
    assert alignment.PLAIN.fullmatch(text) and alignment.PLAIN_FINE.findall(text) == alignment.FINE.findall(text)
    assert "".join(alignment.FINE.findall(text)) == text

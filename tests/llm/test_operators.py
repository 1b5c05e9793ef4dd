"""Sharding, packing, extraction, decontamination, search and the classifiers on small tables."""
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wiretally.llm import decontamination, extraction, language, packing, quality, sharding, topk, toxicity

DOCS = "doc_id long, text string"


# --- sharding

def test_shards(spark):
    rows = [(i, f"é{i}") for i in range(3000)] + [(5, "again"), (None, None), (None, "x")]
    got = sharding.sharded_documents(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    assert len(got) == len(rows)
    slots, of = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 40
    texts = dict(rows[:3000])
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 16
               for r in got if r.doc_id is not None and r.doc_id != 5)
    assert any(r["size"] == 16 and r.text_crc32 is None for r in got)
    assert sharding.sharded_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_weights(spark):
    rows = spark.range(20000).withColumnRenamed("id", "doc_id")
    counts = {r.shard: r["count"] for r in sharding.shard_rows(rows, weights=[1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.72 < counts[1] / 20000 < 0.78


# --- packing

def test_ids_equal_the_plain_call():
    path = public_tokenizers.path("byte_bpe_50k.json")
    untouched, mine = Tokenizer.from_file(path), packing.encoder(path)
    for text in ("plain words", "plain <|endoftext|>words<|endoftext|><|endoftext| >", "<|endoftext|>", "<|endoftext|", "é ₂<|endoftext|> x"):
        ids = untouched.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_new_words_go_straight_to_the_merges(monkeypatch):
    """Plain texts need no call of the whole tokenizer, and have its ids: any characters, long words, a small memory."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    untouched, mine = Tokenizer.from_file(path), packing.WordEncoder(path)
    monkeypatch.setattr(packing, "WORDS_KEPT", 50)
    monkeypatch.setattr(mine, "packed", None)
    draw = random.Random(4)
    chars = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(192, 215), *range(216, 247), *range(248, 384))]
    for text in ["", " ", "x" * 200, *("".join(draw.choices(chars, k=draw.randint(1, 60))) for _ in range(300))]:
        ids = untouched.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_and_places(spark):
    draw = random.Random(2)
    odd = ["", None, " x ₂ \x1c y<|endoftext|>", "don't 'll  \n\n  tail   ", "a" * 3000, "naïve Straße 12 ½ ŉ _x_"]
    texts = odd + [" ".join(draw.choice(["word", "and", "12", "x,y", "Ünder"]) for _ in range(draw.randint(1, 6000))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(0, ""), (None, "null id")]
    got = packing.packed_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        if i == 0:
            continue
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 2048 for r in mine[1:]) and mine[0].start == 0
        for r in mine:
            part = ids[r.start:r.start + r.length]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 2048) + 1
    assert packing.packed_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 40)) for i in range(50)], DOCS)
    pieces = packing.token_pieces(docs)
    placed = packing.packed_pieces(pieces)
    whole = {r.sequence_id: r.ids for r in packing.sequence_ids(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == r.ids


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    draw = random.Random(seed)
    counts = {draw.randint(1, 100): draw.randint(1, 400) for _ in range(draw.randint(1, 40))}
    bins, seen = {}, {}
    for length, rank, n, first, offset in packing.best_fit_plan(counts, 100):
        for i in range(n):
            seen.setdefault(length, []).append(rank + i)
            bins.setdefault(first + i, []).append((offset, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100


# --- extraction

def test_extraction(spark):
    page = ("<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body><header>Site <a href=1>home</a></header>"
            "<div class='cookie-notice'>We use cookies for all of our readers here</div><main><h1>Head &amp; line</h1>"
            "<p class=ad>Buy now<p>Long  text &lt;b&gt; he<b>re</b></p><ul><li>one</li></ul><aside>side</aside>"
            "<form><label>Mail</label><input></form></main><section id=comments><p>great article indeed</p></section><footer>f</footer>")
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "no markup at all but a line of eleven plain words here"), (5, "u", "<p>cut off <b")]
    got = {r.page_id: r for r in extraction.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line Long text <b> here one" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert got[4].text.startswith("no markup")
    clash = spark.createDataFrame([("x", 5, "<article>a b</article>")], "text string, n_chars int, html string")
    assert extraction.extract_main(clash).first()["text"] == "a b"
    assert extraction.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_respects_marks():
    tree = extraction.labelled_tree()
    for words in (1, 5, 40, 200):
        row = lambda main, page, shell, comment: extraction.decide(tree, np.array([[words, 0, 20, 0, 20, 0, 0, main, page, shell, comment]], float))[0]
        assert row(1, 1, 0, 0) and not row(0, 1, 0, 0) and not row(1, 1, 1, 0) and not row(0, 0, 0, 1) and not row(0, 0, 1, 0)


# --- decontamination

def test_templates_and_slots(spark):
    items = spark.createDataFrame(
        [(9, "So Tom has 12 apples and gives 5 apples to Ann. How many apples does Tom keep in the end?"), (10, None), (11, "a b"),
         (12, "short item of six words here")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "So Tom has 12 apples and gives 5 apples to Ann. How many apples does Tom keep in the end?", 1),
        (2, "Intro. So Bob has 7 apples and gives 3 apples to Sue. How many apples does Bob keep in the end? Thanks", 1),
        (3, "So Bob has 7 apples and gives 3 apples to Sue. How many apples does Joe keep in the end?", 1),      # Tom is two people
        (4, None, 1), (5, "", 1), (6, "x", 1), (6, "x", 1), (7, "before short item of six words here after", 1), (None, "short item of six words here", 1),
        (8, "a clean text about pears and plums that have nothing to do with it", 1)], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 9), (2, 9), (7, 12)}
    kept = decontamination.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, 5, 6, 6, None, 8], key=str)
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0

def test_exact_copies_of_placeholders_and_short_items(spark):
    items = spark.createDataFrame(
        [(1, "12 + 30 = 42, 7 * 8 = 56, 81 / 9 = 9 and 5 kg = 5000 g"), (2, "visit Paris Rome Madrid Berlin Vienna Prague Lisbon Oslo Athens"),
         (3, "1 2 3 4 5 6"), (4, "zebra quagga okapi")], "item_id long, text string")
    docs = spark.createDataFrame([(10 * r.item_id, f"Some words before {r.text} and after") for r in items.collect()] + [
        (21, "they will visit paris rome madrid berlin vienna prague lisbon oslo athens in may"), (31, "1 2 3 4 5 7"), (41, "zebra okapi quagga"),
        (51, "13 + 31 = 43, 8 * 9 = 57, 82 / 8 = 8 and 6 kg = 6000 g")], DOCS)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(10, 1), (20, 2), (21, 2), (30, 3), (40, 4)}


def test_only_texts_with_hits_are_moved(spark):
    """Values of slots are read from the texts that are asked for; the others meet a broadcast list, at any size."""
    docs = spark.createDataFrame([(i, f"Tom paid {i} dollars for {i} apples in May and left") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Tom paid 3 dollars for 3 apples in May and left")], "item_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = decontamination.contaminated(docs, items)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [row" in plan and "LeftSemi" in plan
        assert {r.doc_id for r in found.collect()} == set(range(40))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_question_marks_and_first_words(spark):
    items = spark.createDataFrame(
        [(1, "what makes the sea so very salty?"), (2, "Where do all the rivers go?"), (3, "Is it late?? Then tell us the way home now")], "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "what makes the sea so very salty?\nThe rivers do"), (11, "So what makes the sea so very salty"), (12, "what makes the sea so very salty?? Nobody knows"),
        (20, "Question Where do all the rivers go?\nAnswer: to the sea"), (21, "Q: Where do all the rivers go"), (22, "Well. Where do all the rivers go?"),
        (30, "Is it late?\nThen tell us the way home now")], DOCS)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(10, 1), (11, 1), (12, 1), (20, 2), (21, 2), (22, 2), (30, 3)}



# --- search

def test_top_k(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=16)]) for i in range(400)]
    rows[7] = (7, rows[8][1])
    rows += [(1000, None), (1001, [float("nan")] * 16), (1002, [float("inf")] * 16), (1003, [None] * 16), (1004, []), (1005, [1.0, 2.0]), (20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.exact_top_k(table, table.filter("vec_id % 50 = 0 or vec_id = 20"), 5, block_rows=64).collect()
    usable = [(i, np.floor(256 * np.array(v + [0.0] * (16 - len(v))))) for i, v in rows if v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    want = set()
    for q, v in dict((i, v) for i, v in usable if i % 50 == 0 or i == 20).items():
        best = sorted(((-int(v @ c), i) for i, c in usable if i != q))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.exact_top_k(table.limit(0), table.limit(0)).count() == 0
    few = table.filter("vec_id in (0, 1, 2)")
    assert topk.exact_top_k(few, few.filter("vec_id = 0")).count() == 2


def test_top_k_large_numbers(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [-3e6, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_top_k(table, table.filter("vec_id = 0")).orderBy("rank").collect()]
    a = int(3e6) * 256
    assert got == [(0, 1, 1, a * a + 256 * 512), (0, 2, 2, -a * a + 256 * 768)]


# --- classifiers

def corpus(spark, n=900):
    draw = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(["the", "of", "and", "stone", "river", "light", "house", "green", "walks"]) for _ in range(draw.randint(20, 80))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            words[3:3] = ["vilest", "scoundrel"]
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, None), (n + 1, "", None), (n + 2, "the the", None), (None, "the of", "en")]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels + [(n + 9, None, None)], "doc_id long, quality int, toxic int"), labels)


def held_out(got, labels, which):
    truth = {r[0]: r[which] for r in labels}
    rows = [r for r in got if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows)


def test_quality(spark):
    docs, labels, truth = corpus(spark)
    got = quality.document_quality(docs, labels).collect()
    assert len(got) == docs.count() and held_out(got, truth, 1) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unlabelled = quality.document_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality.document_quality(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.document_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and held_out(got, truth, 2) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.document_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.document_toxicity(docs.limit(0), labels).count() == 0


def brute_evidence(docs, labels, stress, k=15):
    """doc_id -> [(id, cosine)]: every document against every labelled one outside fold 0, in plain Python."""
    words = {i: Counter(t for w in (text or "").split() for t in toxicity.terms_of(w)) for i, text in docs.items()}
    known = {i: y for i, y in labels.items() if i in docs and zlib.crc32(str(i).encode()) % 5}
    rate = sum(known.values()) / len(known)
    chi = {}
    for t in {t for i in known for t in words[i]}:
        n = sum(t in words[i] for i in known)
        value = (sum(known[i] for i in known if t in words[i]) - n * rate) ** 2 / (n * rate * (1 - rate))
        if n >= 3 and value > toxicity.LEAST_CHI:
            chi[t] = value
    vocabulary = {t for i in known for t in words[i] if not t.endswith("*")} | set(chi)
    df = Counter(t for c in words.values() for t in c)
    worth = {t: math.log1p(len(docs) / df[t]) * (1 + stress * max(0, 1 - toxicity.LEAST_CHI / chi.get(t, 1))) for t in vocabulary}

    def unit(i):
        v = {t: (1 + math.log(n)) * worth[t] for t, n in words[i].items() if t in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: unit(i) for i in docs}
    out = {}
    for i, v in vectors.items():
        cosines = ((round(sum(x * vectors[j].get(t, 0) for t, x in v.items()), 9), j) for j in known if j != i)
        out[i] = sorted(((c, j) for c, j in cosines if c > 0), key=lambda e: (-e[0], e[1]))[:k]
    return out


def test_toxicity_evidence_equals_brute_force(spark):
    """Every word of an example counts, however rare; no document is evidence for itself; repeated labels are one example."""
    draw = random.Random(12)
    docs, labels = {}, {}
    for i in range(260):
        words = [draw.choice("the of and stone river light house green walks".split()) for _ in range(draw.randint(3, 25))]
        words += [f"w{draw.randrange(3000)}q" for _ in range(4)] + ["Scoundrels!"] * (i % 6 == 0)
        docs[i], labels[i] = " ".join(words), int(i % 6 == 0)
    copied = next(i for i in docs if labels[i] and zlib.crc32(str(i).encode()) % 5)
    docs[300], docs[301], docs[302], docs[303] = docs[copied], "", None, "unseenword"
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, y string, slice int")
    known = spark.createDataFrame([*labels.items(), (6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.document_toxicity(table, known).collect()}
    want = brute_evidence(docs, labels, toxicity.STRESS)
    assert set(got) == set(docs)
    for i, row in got.items():
        assert i not in row.evidence
        assert np.allclose(row.cosines, [c for c, _ in want[i]], atol=1e-7), i
        assert {e for e, c in zip(row.evidence, row.cosines) if c > want[i][-1][0] + 1e-6} == {
            e for c, e in want[i] if c > want[i][-1][0] + 1e-6}
    assert got[300].cosines[0] == pytest.approx(1) and got[301].evidence == got[302].evidence == got[303].evidence == []


def test_toxicity_sample_stays_bounded_under_repeated_ids(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0)] * 5, "doc_id long, toxic int")
    rows = toxicity.drawn_examples(docs, labels, 20).collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 3


def test_block_max_search_is_exact():
    draw = np.random.default_rng(1)
    rows = [(i, float(i % 2), sorted(draw.choice(40, 6, replace=False).tolist()), draw.integers(1, 5, 6).tolist()) for i in range(700)]
    index = toxicity.BlockMaxIndex(rows, draw.random(40) + 0.1)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for q in range(60):
        terms, weights = index.weigh(sorted(draw.choice(40, 5, replace=False).tolist()), [1, 2, 1, 1, 3])
        cosine = np.round(dense[:, terms] @ weights, 12)
        want = sorted((-c, int(i)) for c, i in zip(cosine, index.ids) if c > 0)[:15]
        at, got = index.search(terms, weights, 15)
        assert [int(index.ids[a]) for a in at] == [i for _, i in want] and got.tolist() == pytest.approx([-c for c, _ in want])


def test_language(spark):
    draw = random.Random(3)
    vocabulary = {"en": "the house of a river and light with green stone".split(), "de": "das haus der fluss und licht mit grünem stein".split()}
    rows = []
    for i in range(400):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(draw.choice(vocabulary[lang]) for _ in range(draw.randint(4, 300))), lang, "x"))
    rows += [(500, None, "en", "x"), (501, "12 !!", "en", "x"), (502, "", None, "x"), (None, "the house", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, narrow string")
    got = {r.doc_id: r for r in language.document_languages(docs).collect()}
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.document_languages(docs.limit(0)).count() == 0

"""Near-duplicate classes: SimHash fingerprints linked through fuzzy keys of the binary Golay code."""
from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wiretally.llm.common import components, parts_for, release, saved

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Generator polynomial of the (23, 12) Golay code, a fixed value.
GENERATOR = 0b110001110101
#: Bits of a fingerprint: two segments of 23 bits and one of 18, filled up with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
BITS = 4
#: Keys in a block of the pairing step.
BLOCK_KEYS = 500_000
#: MinHash keys of the near-duplicate stage: number of keys, values in a key, and a factor for each value.
BANDS, ROWS = 24, 4
FACTORS = np.random.default_rng(42).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Texts of a key that are compared with the others in one round, at most; Spark limits them before the shuffle.
MOST_AHEAD = 512
#: Shingles of the texts in a block of the comparison, about.
BLOCK_SHINGLES = 65_536


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a whole text: a bit is 1 where over half of the shingle hashes have it."""
    found = WORD.findall((text or "").encode("utf-8", "replace").lower())
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    at, to = starts[:n].tolist(), (ends[words - 1:] if len(found) >= words else ends[-1:]).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(at, to)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 65_536):
        held = hashes[part:part + 65_536]
        ones += np.unpackbits(held.view(np.uint8).reshape(len(held), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(documents: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number. Null and blank texts have fingerprint 0."""
    def fingerprints(batches):
        for batch in batches:
            known: dict = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = fingerprint_of(text, words)
                out.append(known[text])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])
            release()

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(fingerprints, "doc_id bigint, fp bigint")


def syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns of weight 4 or less: one, or one of weight 3 and
    five of weight 4. Short rows repeat their first entry."""
    table: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)])
        for s, p in zip(syndrome(patterns).tolist(), patterns.tolist()):
            table[s].append(p)
    return np.array([(row + row[:1] * 6)[:6] for row in table])


def nearby_codewords(words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Index of every codeword at distance 4 or less from each 23-bit word, six columns, -1 where there
    are fewer. Words at distance 2 or less share one: the word between them lies within 3 of a codeword."""
    errors = patterns[syndrome(words)]
    index = (words[:, None] ^ errors) >> 11
    index[:, 1:][errors[:, 1:] == errors[:, :1]] = -1
    return index


def fuzzy_keys(fps: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) so that fingerprints at 4 or fewer differing bits share a key.

    Let a <= b <= c be the errors of the three segments. If a = 0 then b <= 2:
    one segment is equal and another shares a codeword. Otherwise a = b = 1 and
    c <= 2: all three share a codeword.
    """
    parts = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [nearby_codewords(p, patterns) for p in parts]
    rows, keys = [], []

    def add(kind: int, value: np.ndarray, valid: np.ndarray) -> None:
        at, col = np.nonzero(valid)
        rows.append(at)
        keys.append(value[at, col] | kind << 40)

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind, parts[i][:, None] << 12 | near[j], near[j] >= 0)
                kind += 1
    pair = (near[0][:, :, None] << 12 | near[1][:, None, :]).reshape(len(fps), 36)
    valid = ((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :]).reshape(len(fps), 36)
    triple = (pair[:, :, None] << 12 | near[2][:, None, :]).reshape(len(fps), 216)
    add(kind, triple, (valid[:, :, None] & (near[2] >= 0)[:, None, :]).reshape(len(fps), 216))
    return np.concatenate(rows), np.concatenate(keys)


def linked(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of what is connected by pairs that share a key and differ in at most ``bits`` bits.

    Pairs are taken at growing distance in the sorted list, all keys at a time, and
    only as labels: no pair is kept, and memory is that of the list.
    """
    order = np.lexsort((fps, keys))
    keys, (nodes, at) = keys[order], np.unique(fps[order], return_inverse=True)
    label = np.arange(len(nodes))
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    left = np.repeat(sizes, sizes) - (np.arange(len(keys)) - np.repeat(starts, sizes)) - 1    # later rows of the same key
    here = np.flatnonzero(left > 0)
    step = 1
    while len(here):
        a, b = at[here], at[here + step]
        close = (np.bitwise_count(nodes[a] ^ nodes[b]) <= bits) & (label[a] != label[b])
        a, b = a[close], b[close]
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            a, b = a[open_ := label[a] != label[b]], b[open_]
        step += 1
        here = here[left[here] >= step]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def fingerprint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at ``bits`` (at most 4) or fewer differing bits.

    ``fps`` has distinct values. Each task sends the keys of its fingerprints to
    blocks by a hash of the key; a block gives one edge for each fingerprint it
    links, so the output is bounded by the input whatever the size of a class.
    """
    if bits > BITS:
        raise ValueError("the keys find fingerprints at 4 or fewer differing bits")
    n = fps.count()
    blocks = max(64, math.ceil(n * 182 / BLOCK_KEYS))

    def send(batches):
        patterns = error_patterns()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(whole), 4096):
                held = whole[start:start + 4096]
                row, key = fuzzy_keys(held, patterns)
                block = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                order = np.argsort(block, kind="stable")
                cuts = np.searchsorted(block[order], np.arange(blocks + 1))
                key, value = key[order], held[row[order]]
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)),
                     pa.array([key[cuts[b]:cuts[b + 1]].tobytes() for b in some], pa.binary()),
                     pa.array([value[cuts[b]:cuts[b + 1]].tobytes() for b in some], pa.binary())], ["block", "keys", "fps"])
            release()

    def pair(group: pa.Table) -> pa.Table:
        release()
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.int64)
        values = np.frombuffer(b"".join(group["fps"].to_pylist()), np.uint64)
        a, b = linked(keys, values, bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return fps.select("fp").mapInArrow(send, "block int, keys binary, fps binary").groupBy("block").applyInArrow(
        pair, "a bigint, b bigint")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicate_classes(documents: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    ``component_id`` is the smallest doc_id reachable over links of ``bits`` or
    fewer differing bits, the document's own included; null only where all ids of
    the class are null. Equal fingerprints meet as one value before anything is
    paired, so thousands of copies cost what one costs. An empty table gives no rows.
    """
    fps = saved(with_fingerprint(documents, words), "fingerprints")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct, bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def shingles_of(text: str | None, words: int) -> tuple[bytes, np.ndarray]:
    """Words of a text in lower case joined by blanks, and the sorted different 64-bit hashes of its shingles."""
    found = WORD.findall((text or "").encode("utf-8", "replace").lower())
    joined = b" ".join(found)
    if not found:
        return joined, np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:max(1, len(found) - words + 1)]
    last = ends[words - 1:] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return joined, np.unique(np.fromiter((digest(joined[x:y], 42) for x, y in zip(starts.tolist(), last.tolist())), np.uint64, len(starts)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys of ``BANDS`` groups of ``ROWS`` MinHash values; two texts of Jaccard similarity s share none with
    probability (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8 and less above. A text without words has no key."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, part:part + 4096] * FACTORS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def near_pairs(texts: pa.Table, leaders: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, node) of all texts with ``similarity`` or more in common with a leader of a smaller id.

    Both tables have (node, n, shingles). Shingles of all leaders are sorted once; a text counts the leaders of its own.
    """
    def flat(table):
        lists = table["shingles"].combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False), table["n"].to_numpy(), table["node"].to_numpy()

    held, sizes, ids = flat(leaders)
    whose = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(held, kind="stable")
    held, whose = held[order], whose[order]
    shingles, lengths, nodes = flat(texts)
    low, high = np.searchsorted(held, shingles, "left"), np.searchsorted(held, shingles, "right")
    least, near, start = [], [], 0
    for node, n in zip(nodes.tolist(), lengths.tolist()):
        a, counts = low[start:start + n], high[start:start + n] - low[start:start + n]
        start += n
        ends = np.cumsum(counts)
        at = np.repeat(a - ends + counts, counts) + np.arange(counts.sum())
        both = np.bincount(whose[at], minlength=len(ids))
        found = np.unique(ids[(both >= similarity * (n + sizes.astype(np.int64) - both)) & (ids < node)])
        least.append(found)
        near.append(np.full(len(found), node, np.int64))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(least or none), np.concatenate(near or none)


def comparison_blocks(left: DataFrame, ahead: DataFrame, widths: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(node, block, slice) of the texts and of the leaders they are compared with; a row is a text or a leader of a block, never a pair.

    ``left`` has (key, node, low), low the least node of the key; ``ahead`` (key, least); ``widths`` (node, width), the
    shingles of a node. Texts with the same least neighbour share a block or, if they have more than
    ``BLOCK_SHINGLES``, several; the leaders of a block are cut into slices of that size, and its texts meet each.
    """
    homes = left.groupBy("node").agg(F.min("low").alias("home")).join(widths, "node")
    size = F.lit(BLOCK_SHINGLES)
    parts = homes.groupBy("home").agg(F.ceil(F.sum("width") / size).alias("parts"))
    block = F.when(F.col("parts") <= 1, F.pmod(F.xxhash64("home"), F.lit(blocks))).otherwise(
        F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))))
    placed = saved(homes.join(parts, "home").select("node", block.alias("block")), "placed")
    led = left.join(placed, "node").select("key", "block").distinct().join(ahead, "key").select(
        "block", F.col("least").alias("node")).distinct()
    led = saved(led.join(widths, "node"), "led")
    slices = led.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("width") / size)).alias("slices"))
    leaders = led.join(slices, "block").select("node", "block", F.pmod(F.xxhash64("node"), F.col("slices")).alias("slice"))
    texts = placed.join(slices, "block").select("node", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    return texts, leaders


def redundant_ids(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_ids whose text is near to that of a document with a smaller doc_id that stays.

    Texts of equal words meet first, in one aggregation. Candidates are texts that share a MinHash key; they are
    near if the Jaccard similarity of all their shingles of ``words`` words is ``similarity`` or more, counted on the
    whole texts. In each round the least texts of every key are compared with all others of the key, block by block
    inside tasks, which return near pairs only. A text that is among them in all its keys and near to no smaller one is kept for good and takes what is near to it. The number
    of least texts doubles from round to round, and rounds go on until every text is judged.
    """
    def sketch(batches):
        for batch in batches:
            known: dict = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    joined, hashes = shingles_of(text, words)
                    known[text] = xxhash.xxh128_digest(joined), np.array(band_keys(hashes), np.uint64).view(np.int64)
                out.append(known[text])
            digests, keys = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "keys"])
            release()

    def shingles(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                held = batch.slice(start, 256)
                sets = [shingles_of(text, words)[1].view(np.int64) for text in held.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [held.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
                    ["node", "n", "shingles"])
            release()

    def crowded(keyed):
        several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
        return keyed.join(several.select("key", "low"), "key")

    def compare(texts: pa.Table, leaders: pa.Table) -> pa.Table:
        release()
        least, node = near_pairs(texts, leaders, similarity)
        return pa.table({"least": pa.array(least, pa.int64()), "node": pa.array(node, pa.int64())})

    known = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = saved(known.mapInArrow(sketch, "doc_id bigint, digest binary, keys array<bigint>"), "sketches")
    kinds = saved(sketches.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "kinds")
    left = saved(crowded(kinds.select("node", F.explode("keys").alias("key"))).distinct(), "left")
    sets = saved(
        known.join(left.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        .mapInArrow(shingles, "node bigint, n int, shingles array<bigint>"), "shingles")
    widths = saved(sets.groupBy("node").agg(F.sum("n").alias("width")), "widths")
    blocks = parts_for(widths.agg(F.sum("width")).first()[0] or 0, BLOCK_SHINGLES, 64)
    dropped = None
    front = 1
    while not left.isEmpty():
        order = W.partitionBy("key").orderBy("node")
        ahead = saved(left.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= front).select("key", F.col("node").alias("least")), "ahead")
        texts, leaders = comparison_blocks(left, ahead, widths, blocks)
        near = saved(
            texts.join(sets, "node").groupBy("block", "slice").cogroup(leaders.join(sets.alias("led"), "node").select(
                *leaders.columns, F.col("led.n").alias("n"), F.col("led.shingles").alias("shingles")).groupBy("block", "slice"))
            .applyInArrow(compare, "least bigint, node bigint").distinct(), "near")
        # among the least in all its keys: all its pairs were compared in this round
        whole = left.groupBy("node").agg(F.count(F.lit(1)).alias("has")).join(
            ahead.groupBy(F.col("least").alias("node")).agg(F.count(F.lit(1)).alias("seen")), "node").filter("has = seen")
        stays = saved(whole.join(near, "node", "left_anti").select("node"), "stays")
        gone = saved(near.join(stays.select(F.col("node").alias("least")), "least", "left_semi").select("node").distinct(), "gone")
        dropped = gone if dropped is None else dropped.union(gone)
        left = saved(crowded(saved(left.select("key", "node").join(stays.union(gone), "node", "left_anti"), "unjudged")), "left")
        front = min(2 * front, MOST_AHEAD)
    kept = kinds.select("digest", "node")
    if dropped is not None:
        kept = kept.join(dropped, "node", "left_anti")
    kept = kept.select("digest", F.col("node").alias("doc_id"))
    return sketches.select("doc_id", "digest").join(kept, ["digest", "doc_id"], "left_anti").select("doc_id").distinct()


def without_near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without those that are near to a smaller doc_id that stays.

    Of rows that share a doc_id and a text one stays; rows that share a doc_id with
    different texts stay or go together. Rows with null doc_id stay. Empty texts are
    near to each other, so one of them stays. An empty table gives none.
    """
    gone = redundant_ids(documents, words, similarity)
    known = documents.filter(F.col("doc_id").isNotNull())
    repeated = saved(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated")
    kept = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    if repeated.isEmpty():
        return kept
    columns = [c for c in documents.columns if c not in ("doc_id", "text")]
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *columns)).alias("_r"))
    return kept.join(repeated, "doc_id", "left_anti").select(*documents.columns).unionByName(
        once.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_r")[c].alias(c) for c in documents.columns]))

"""Alignment of two tokenizers over the same bytes, and how often their ids stand for each other.

Both encodings of a text cover the same bytes. The ends of their tokens are
dictionaries from end to index; ends that both have cut the text into groups,
and within a group every token of one side is linked to every token of the
other. Texts are cut where both sides always have an end; such stretches are
aligned once and remembered, so a document is a row of known stretches.
"""
from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, functions as F

from wiretally.llm.common import release, saved
from wiretally.llm.pieces import model

#: Stretches of at most this many characters are remembered, this many new ones and as many older ones.
STRETCH_CHARS, STRETCHES_KEPT = 48, 250_000
#: Id pairs whose counts are sent to every task; the counts of all other pairs are joined by a shuffle.
PAIRS_SENT = 1_000_000
#: Stretches between places where both sides end a token: after a run of letters, and before a single space between
#: a character that is no white space and a letter.
FINE = regex.compile(r" ?\p{L}+|\P{L}+?(?<=\S)(?= \p{L})|\P{L}+\p{L}*")
#: The same on texts of these characters alone, by the faster engine.
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ſ]*")
PLAIN_FINE = re.compile(r" ?[^\W\d_]+|[\W\d_]+?(?<=\S)(?= [^\W\d_])|[\W\d_]+[^\W\d_]*")
SPACED = regex.compile(r"(?<=\S)(?= \S)")
STATS = struct.Struct("<3q")
_loaded: dict = {}


class ByteModel:
    """Byte-level merges of a tokenizer file; strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of.update((chr(256 + n), b) for n, b in enumerate(b for b in range(256) if b not in shown))
        special = {t["content"] for t in held["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.bytes = {i: token for token, i in ranks.items()}
        self.sizes = {i: len(token) for token, i in ranks.items()}
        self.encoding = tiktoken.Encoding("held", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


def ends(sizes: list[int]) -> dict[int, int]:
    """Cumulative end of each token -> how many tokens end by there."""
    return dict(zip(accumulate(sizes), range(1, len(sizes) + 1)))


def groups(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> list[tuple[list[int], list[int]]]:
    """Slices of both id lists between ends that both sides have."""
    if len(a) == 1 or len(b) == 1:
        return [(a, b)]
    left, right = ends(a_sizes), ends(b_sizes)
    out, i, j = [], 0, 0
    for end in sorted(left.keys() & right.keys()):
        out.append((a[i:left[end]], b[j:right[end]]))
        i, j = left[end], right[end]
    return out


def links(group: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """(pair, how many links) of a group, each pair of ids once: first id << 32 | second id."""
    a, b = group
    if len(a) == 1 == len(b):
        return [(a[0] << 32 | b[0], 1)]
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        return [(x << 32 | y, 1) for x in a for y in b]
    many = Counter(b)
    return [(x << 32 | y, n * m) for x, n in Counter(a).items() for y, m in many.items()]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteModel(path_a, public_tokenizers.PATTERN), model(path_b)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        #: A model that changes more than spaces sees whole texts.
        self.cut = "whole" if self.b.map.units or self.b.users or self.b.trim or not self.b.prefix else self.b.cut

    def stretches(self, text: str) -> list[str]:
        """Parts of a text that begins with a space."""
        if self.cut == "letters":
            return (PLAIN_FINE if PLAIN.fullmatch(text) else FINE).findall(text)
        return SPACED.split(text) if self.cut == "spaces" else [text]

    def pieces(self, stretches: list[str]) -> list[list[int]]:
        """Ids of the second side. A whole text is normalised as the model does, a stretch has its spaces already."""
        if self.cut == "whole":
            return self.b.ids([self.b.plain(s[1:]) for s in stretches])
        return self.b.ids([s.replace(" ", self.b.space) for s in stretches])

    def aligned(self, stretch: str, b: list[int]) -> tuple:
        """(groups as text, packed numbers of ids and groups, packed pairs, packed link counts); one field if bytes differ."""
        a, spelled = self.a.ids(stretch), self.b.bytes
        right = [spelled[i] for i in b]
        if None in right or b"".join(right) != stretch.encode("utf-8"):
            return ()
        size = self.a.sizes
        cut = groups(a, b, [size[i] for i in a], list(map(len, right)))
        held = links(cut[0]) if len(cut) == 1 else [x for g in cut for x in links(g)]
        text = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in cut])
        pairs, counts = zip(*held)
        return text, STATS.pack(len(a), len(b), len(cut)), array("q", pairs).tobytes(), array("q", counts).tobytes()

    def rows(self, text: str) -> list[tuple] | None:
        """Aligned stretches of a text, None where the two sides spell different bytes."""
        parts = self.stretches(" " + text)
        if len(self.known) > STRETCHES_KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [s for s in set(parts) if s not in known]
        if new:
            again = [s for s in new if s in older]
            known.update(zip(again, map(older.__getitem__, again)))
            new = [s for s in new if s not in older]
            for stretch, b in zip(new, self.pieces(new) if new else ()):
                known[stretch] = self.aligned(stretch, b)
        found = list(map(known.__getitem__, parts))
        for s in new:
            if len(s) > STRETCH_CHARS:
                del known[s]
        return None if () in found else found


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    key = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


def alignments(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Groups of every text: doc_id, groups (array of a_ids, b_ids, first byte, byte behind; bytes of space + text).

    A null or empty text, or one whose sides spell different bytes (the second
    model replaces a character, or knows it as a space), has no groups.
    """
    def run(batches):
        held = aligner(path_a, path_b)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                at, row = 0, []
                for found in (held.rows(text) or []) if text else []:
                    for part in found[0].split(";"):
                        a, b = ([int(i) for i in side.split(",")] for side in part.split("|"))
                        end = at + sum(len(held.a.bytes[i]) for i in a)
                        row.append({"a_ids": a, "b_ids": b, "start": at, "end": end})
                        at = end
                rows.append(row)
            kind = pa.list_(pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
                                       ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "groups"])
            release()

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, groups array<struct<a_ids: array<int>, b_ids: array<int>, start: bigint, end: bigint>>")


LINKED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary"


def linked_documents(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Numbers of each document, and its distinct id pairs with their link counts, packed (``unpacked`` reads them)."""
    def run(batches):
        held = aligner(path_a, path_b)
        for batch in batches:
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = []
            for text in batch.column(1).to_pylist():
                found = held.rows(text) if text else None
                if not found:
                    rows.append((0, 0, 0, 0, "", b""))
                    continue
                stats = np.frombuffer(b"".join([f[1] for f in found]), "<i8").reshape(-1, 3).sum(axis=0)
                pairs = np.frombuffer(b"".join([f[2] for f in found]), "<i8")
                counts = np.frombuffer(b"".join([f[3] for f in found]), "<i8")
                order = np.argsort(pairs)
                pairs = pairs[order]
                first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
                each = np.add.reduceat(counts[order], first)
                packed = np.concatenate([np.diff(pairs[first], prepend=0), each]).astype("<i8").tobytes()
                digest = hashlib.sha256(";".join([f[0] for f in found]).encode()).hexdigest()
                rows.append((*map(int, stats), int(counts.sum()), digest, pack(packed)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
            release()

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, LINKED)


def unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (first id << 32 | second id, ascending) and their link counts."""
    if not packed:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8")
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def pair_counts(linked: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(pair, n): how many documents hold each id pair linked. Counted in the task that reads, then added up."""
    def run(batches):
        def counted(parts):
            keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            return keys[first], np.add.reduceat(n[order], first) if len(keys) else n

        def sent(part):
            return pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64())], ["pair", "n"])

        held, waiting, rows = [], [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                keys = unpacked(packed)[0]
                waiting.append((keys, np.ones(len(keys), "i8")))
                rows += len(keys)
                if rows > flush:
                    held = [counted(held + waiting)]
                    waiting, rows = [], 0
                    if len(held[0][0]) > flush:
                        yield sent(held.pop())
            release()
        if held or waiting:
            yield sent(counted(held + waiting))

    return linked.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """Least power of two such that at most ``most`` pairs have that count or more."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}
    power, total = max(sizes, default=-1) + 1, 0
    while power > 0 and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power


def aligned_documents(documents: DataFrame, path_a: str | None = None, path_b: str | None = None,
                      pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, or one whose sides spell different bytes, has zeros
    and an empty string. Repeated rows count as documents of their own, null
    doc_id included; further columns, whatever their names, are not read. An
    empty table gives no rows. Texts are encoded once. The counts of at most
    ``pairs_sent`` frequent pairs go to every task (16 bytes each), links of all
    other pairs are joined by pair: each of those is rare by construction, so no
    key of that join is hot.
    """
    spark = documents.sparkSession
    linked = saved(linked_documents(documents, path_a, path_b), "linked")
    counts = saved(pair_counts(linked), "pair-counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    marked = counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    least = frequent_from(counts, pairs_sent)
    frequent = marked.filter(F.col("n") >= least).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(
        frequent.column(c).to_numpy().astype(kind) for c, kind in (("pair", "i8"), ("n", "i8"), ("best", "?"))))

    def score(batches):
        keys, n, best = sent.value
        for batch in batches:
            rows, rest = [], []
            for packed in batch.column("pairs").to_pylist():
                pairs, each = unpacked(packed)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                rows.append((int(each[hit][best[at[hit]]].sum()), int((each[hit] * n[at[hit]]).sum())))
                rest.append([{"pair": p, "times": t} for p, t in zip(pairs[~hit].tolist(), each[~hit].tolist())])
            columns = [batch.column(c) for c in names]
            columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum", "rest"])
            release()

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = LINKED.rsplit(",", 1)[0] + ", n_best bigint, count_sum bigint, rest array<struct<pair: bigint, times: bigint>>"
    scored = linked.mapInArrow(score, kinds).withColumn("_row", F.monotonically_increasing_id())
    if least == 1:      # every pair was sent
        return scored.select(*names[:-1], "n_best", "count_sum", "groups_sha256")
    scored = saved(scored, "scored")
    rare = (
        scored.select("_row", F.explode("rest").alias("r")).select("_row", "r.*")
        .join(marked.filter(F.col("n") < least), "pair")
        .groupBy("_row").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("_best"),
                             F.sum(F.col("times") * F.col("n")).alias("_sum"))
    )
    return scored.join(rare, "_row", "left").select(
        *names[:-1], (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")

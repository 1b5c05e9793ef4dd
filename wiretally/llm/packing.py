"""Best-fit packing of token sequences, planned on the histogram of lengths."""
from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from wiretally.llm.common import numbered, parts_for, release, saved

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
#: Words of at most this many characters are remembered; the memory is emptied when full.
WORD_CHARS, WORDS_KEPT = 48, 300_000
#: Characters on which the split below is the tokenizer's own; other texts go to the tokenizer whole.
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ſ]*")
WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters by which the vocabulary writes the bytes: printable ones stand for themselves, the others for 256 and up.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip([b for b in range(256) if b not in PRINTABLE], range(256, 512)))
_loaded: dict = {}


class WordEncoder:
    """Ids of a text as packed little-endian unsigned integers.

    The vocabulary merges only inside the words of its split pattern, so ids of
    words are kept and a text is the concatenation of its words' ids. A new word goes
    straight to the merges, its bytes written as the vocabulary writes them. A text that
    holds the string of an added token goes to the tokenizer whole, which gives it that token's own id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.merges = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or self.added.search(text):
            return self.packed([text])[0]
        words, known = WORD.findall(text), self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > WORDS_KEPT:
                known.clear()
            here: dict[str, bytes] = {}
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    if w not in here:
                        here[w] = self.merged(w)
                    found[i] = here[w]
            known.update((w, ids) for w, ids in here.items() if len(w) <= WORD_CHARS)
        return b"".join(found)

    def merged(self, word: str) -> bytes:
        ids = [t.id for t in self.merges(word.encode().decode("latin-1").translate(BYTES))]
        return struct.pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces (start, length) of n tokens: all full but the first, which may be shorter."""
    pieces = max(1, -(-n // capacity))
    first = n - (pieces - 1) * capacity
    return [(0, first)] + [(first + i * capacity, capacity) for i in range(pieces - 1)]


def token_pieces(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0,
                 with_ids: bool = True) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and packed ``ids``.

    A null or empty text is the end id alone. Equal texts of a batch are encoded
    once. ``with_ids=False`` leaves the ids null, for plans that need lengths only.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    end = struct.pack("<I", end_id)

    def pieces(batches):
        encode = encoder(path).encode
        for batch in batches:
            seen: dict[str, list] = {}
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if text not in seen:
                    ids = encode(text) + end
                    seen[text] = [
                        (i, start, n, zlib.crc32(part := ids[4 * start:4 * (start + n)]), part if with_ids else None)
                        for i, (start, n) in enumerate(cut(len(ids) // 4, capacity))
                    ]
                rows += [(doc_id, *p) for p in seen[text]]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            release()

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pieces, PIECE_SCHEMA)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns runs (length, first_rank, n, first_sequence, offset): the pieces of
    that length with ranks first_rank .. first_rank + n - 1 lie at ``offset`` of
    the sequences first_sequence ... Sequences that are filled alike stay one
    interval, so the plan's size depends on the number of lengths and not on the
    number of pieces.
    """
    plan, sequences = [], 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)   # room left -> intervals (first sequence, n)
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if free[r]), None)
            if room is None:
                room, many = capacity, -(-left // (capacity // length))
                first, sequences = sequences, sequences + many
            else:
                first, many = free[room].pop()
            each = room // length
            filled = min(many, left // each)
            if filled == 0:
                filled, each = 1, left
            for layer in range(each):
                plan.append((length, rank, filled, first, capacity - room + layer * length))
                rank += filled
            left -= filled * each
            free[room - each * length].append((first, filled))
            if many > filled:
                free[room].append((first + filled, many - filled))
    return plan


def packed_pieces(pieces: DataFrame, capacity: int = 2048, plan_rows: int = 1_000_000) -> DataFrame:
    """Adds sequence_id and offset to pieces that carry doc_id, piece and length (1 .. capacity).

    The histogram has at most ``capacity`` rows. Pieces take planned places by
    their rank within their length; ranks are dealt in parts, so a length that
    holds a third of all pieces is many tasks. The plan is broadcast: its size
    follows from the number of lengths and is checked against ``plan_rows``;
    beyond that it is joined by a shuffle.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("pieces must have 1 .. capacity tokens")
    plan = best_fit_plan(counts, capacity)
    planned = spark.createDataFrame(plan, "length bigint, _rank bigint, _n bigint, _sequence bigint, offset bigint")
    if len(plan) <= plan_rows:
        planned = F.broadcast(planned)
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "_at", parts_for(sum(counts.values()), 100_000, 64))
    return (
        ranked.join(planned, (ranked.length == planned.length) & (F.col("_at") >= F.col("_rank"))
                    & (F.col("_at") < F.col("_rank") + F.col("_n")))
        .drop(planned.length)
        .withColumn("sequence_id", F.col("_sequence") + F.col("_at") - F.col("_rank"))
        .drop("_at", "_rank", "_n", "_sequence")
    )


def packed_documents(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Places of all documents' pieces. Lengths and checksums are computed once and kept in the shared folder."""
    narrow = token_pieces(documents, capacity, tokenizer, with_ids=False).drop("ids")
    return packed_pieces(saved(narrow, "pieces"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequence_ids(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids) from placed pieces that kept their ids.

    A sequence holds at most ``capacity`` tokens, so each group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))

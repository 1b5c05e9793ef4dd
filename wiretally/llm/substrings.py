"""Exact removal of repeated passages: every byte under a string that also starts in an earlier document.

Documents are kept in batches. Windows of ``span`` bytes are named by their minimizer, the
seed of SEED bytes with the least hash; equal windows have equal minimizers. Three exchanges follow:

1. batches send the minimizers they hold to blocks by hash; blocks answer which of them occur in
   documents with different ids;
2. batches cut the text around those to pieces (the windows of one minimizer lie side by side) and
   send every distinct piece once, with the smallest id that has it; blocks build the suffix
   array of the pieces that share windows and answer the smallest id of every window;
3. batches mark what is covered by a window with a smaller id.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wiretally.llm.common import extended, release, saved
from wiretally.llm.suffixes import suffix_array

SPAN, SEED = 50, 24
BATCH_BYTES, SLICE = 3_000_000, 1 << 19
#: Entries of a block and the least number of blocks; batches in which a minimizer makes its windows be dealt one by one.
BLOCK_ENTRIES, LEAST_BLOCKS, HOT_BATCHES = 500_000, 256, 64
LARGEST = np.iinfo(np.int64).max


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def hashed(padded: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes at each place, taken by eights; the last eight may overlap."""
    eights = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    value = np.zeros(len(at), np.uint64)
    for step in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        value = mixed(value + np.ascontiguousarray(eights[at + step]).view(np.uint64).ravel())
    return value


def minimizers(padded: np.ndarray, offsets: np.ndarray, valid: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, n) of every run of windows with one minimizer, in text order: bytes from the run's first window to
    the seed, and windows in the run. ``valid`` tells the documents that take part."""
    least, counts = [], []
    seeds = span - SEED + 1
    for a, e, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist()):
        if not ok:
            continue
        for begin in range(a, e - span + 1, SLICE):
            stop = min(begin + SLICE, e - span + 1)               # windows begin .. stop - 1
            seed_at = np.arange(begin, stop + seeds - 1)
            key = hashed(padded, seed_at, SEED) & np.uint64(~0x3FFFFF & 0xFFFFFFFFFFFFFFFF) | (seed_at - begin).astype(np.uint64)
            done = 1
            while done * 2 <= seeds:
                key = np.minimum(key[:len(key) - done], key[done:])
                done *= 2
            if seeds > done:
                key = np.minimum(key[:len(key) - (seeds - done)], key[seeds - done:])
            at = (key & np.uint64(0x3FFFFF)).astype(np.int64)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            least.append((at[first] - first).astype(np.uint8))
            counts.append(np.diff(np.append(first, len(at))).astype(np.uint8))
    none = np.zeros(0, np.uint8)
    return np.concatenate([none, *least]), np.concatenate([none, *counts])


class Batch:
    """A batch of documents as it lies in the batch table."""

    def __init__(self, row: dict, span: int):
        self.key = row["batch"]
        table = pa.ipc.open_stream(row["rows"]).read_all().combine_chunks()
        self.rows = table
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        text = text.cast(pa.large_binary()).fill_null(b"")
        self.offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        begin = int(self.offsets[0]) if len(text) else 0
        self.data = np.zeros(int(self.offsets[-1]) - begin + 64, np.uint8)
        if len(self.data) > 64:
            self.data[:-64] = np.frombuffer(text.buffers()[2], np.uint8, len(self.data) - 64, begin)
        self.offsets = self.offsets - begin
        ids = table.column("doc_id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.span = span

    def cut(self, seed: bytes, counts: bytes) -> None:
        """Places of the runs from their lengths."""
        self.n = np.frombuffer(counts, np.uint8).astype(np.int64)
        each = np.where(self.known, np.maximum(0, np.diff(self.offsets) - self.span + 1), 0)
        ends = np.cumsum(each)
        window = np.cumsum(self.n) - self.n
        self.doc = np.searchsorted(ends, window, side="right")
        self.start = self.offsets[self.doc] + window - (ends - each)[self.doc]
        self.hash = hashed(self.data, self.start + np.frombuffer(seed, np.uint8), SEED) >> np.uint64(16)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, inverse, several): the batch's minimizers in order, and which lie in documents with different ids."""
        hashes, inverse = np.unique(self.hash, return_inverse=True)
        low, high = np.full(len(hashes), LARGEST), np.full(len(hashes), -LARGEST)
        np.minimum.at(low, inverse, self.ids[self.doc])
        np.maximum.at(high, inverse, self.ids[self.doc])
        return hashes, inverse, low != high

    def pieces(self, several: np.ndarray, hot: np.ndarray) -> dict:
        """Distinct pieces around the chosen runs, and where each occurs.

        A run is one piece; a run with a hot minimizer is one piece for each of its windows.
        """
        whole = np.flatnonzero(several & ~hot)
        split = np.flatnonzero(several & hot)
        reps = self.n[split]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        at = np.concatenate([self.start[whole], np.repeat(self.start[split], reps) + inner])
        n = np.concatenate([self.n[whole], np.ones(len(inner), np.int64)])
        doc = np.concatenate([self.doc[whole], np.repeat(self.doc[split], reps)])
        key = np.concatenate([mixed(self.hash[whole]), hashed(self.data, at[len(whole):], self.span)])
        source, seen = self.data.tobytes(), {}
        which = np.fromiter((seen.setdefault(source[a:b], len(seen)) for a, b in zip(at.tolist(), (at + n + self.span - 1).tolist())),
                            np.int64, len(at))
        first = np.full(len(seen), len(at))
        np.minimum.at(first, which, np.arange(len(at)))
        least = np.full(len(seen), LARGEST)
        np.minimum.at(least, which, self.ids[doc])
        return {"at": at, "doc": doc, "which": which, "texts": list(seen), "n": n[first], "key": key[first], "least": least}


def packed_hashes(values: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as differences, byte planes and zstandard."""
    steps = np.diff(values, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T[:6].tobytes())


def unpacked_hashes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def cuts_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Where the ascending 48-bit hashes of each block begin and end."""
    edges = np.array([(b << 48) // blocks + (1 if (b << 48) % blocks else 0) for b in range(blocks)] + [1 << 48], np.uint64)
    return np.searchsorted(hashes, edges)


def batched(documents: DataFrame, span: int) -> DataFrame:
    """The batch table: whole rows of about BATCH_BYTES of text, with the minimizer runs of their windows."""
    def build(batches):
        import pyspark

        key = pyspark.TaskContext.get().partitionId() << 32
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes = np.asarray(batch.column(at).cast(pa.large_binary()).fill_null(b"").buffers()[1])
            sizes = np.frombuffer(sizes, np.int64)[: len(batch) + 1] if len(batch) else np.zeros(1, np.int64)
            begin = 0
            while begin < len(batch):
                end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + BATCH_BYTES, side="right")) - 1)
                sink = pa.BufferOutputStream()
                part = pa.Table.from_batches([batch.slice(begin, end - begin)])
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(part)
                rows = sink.getvalue().to_pybytes()
                held = Batch({"batch": key, "rows": rows}, span)
                seed, n = minimizers(held.data, held.offsets, held.known, span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([rows], pa.binary()), pa.array([seed.tobytes()], pa.binary()),
                     pa.array([n.tobytes()], pa.binary()), pa.array([len(n)])], ["batch", "rows", "seed", "n", "runs"])
                key, begin = key + 1, end
                release()

    return documents.mapInArrow(build, "batch long, rows binary, seed binary, n binary, runs long")


def opened(row: dict, span: int) -> Batch:
    batch = Batch(row, span)
    batch.cut(row["seed"], row["n"])
    return batch


def answered(batch: Batch, answers: list[dict], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of the batch have a repeated minimizer, and which a hot one."""
    hashes, inverse, _ = batch.distinct()
    cuts = cuts_of(hashes, blocks)
    several, hot = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    for a in answers:
        part = slice(cuts[a["block"]], cuts[a["block"] + 1])
        several[part], hot[part] = unbits(a["several"], part.stop - part.start), unbits(a["hot"], part.stop - part.start)
    return several[inverse], hot[inverse]


def dealt(pieces: dict, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in the order of their blocks, and the blocks' bounds."""
    block = (pieces["key"] >> np.uint64(20)).astype(np.int64) % blocks
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def least_of_windows(texts: list[bytes], least: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, value): smallest id of every window of the distinct pieces, piece after piece.

    Windows that occur in one piece only have its id. Stretches of windows that may
    occur in several (by hash, which loses none) go into one suffix array; suffixes
    with the same ``span`` bytes, compared as they are, share their smallest id.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    each = lengths - span + 1
    first = np.concatenate([[0], np.cumsum(each)])
    data = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), each)
    at = begin[owner] + np.arange(first[-1]) - first[owner]
    value = least[owner]
    hashes = hashed(data, at, span)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    shared = np.zeros(len(at), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    if not shared.any():
        return first, value
    # maximal stretches of shared windows inside a piece, equal ones once
    edge = shared & ~(np.concatenate([[False], shared[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]]))
    heads = np.flatnonzero(edge)
    places = np.flatnonzero(shared)
    stretch = np.searchsorted(heads, places, side="right") - 1
    windows = np.bincount(stretch, minlength=len(heads))
    source, seen = data.tobytes(), {}
    which = np.fromiter((seen.setdefault(source[a:b], len(seen)) for a, b in zip(at[heads].tolist(), (at[heads] + windows + span - 1).tolist())),
                        np.int64, len(heads))
    ids = np.full(len(seen), LARGEST)
    np.minimum.at(ids, which, least[owner[heads]])
    parts = list(seen)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = b"\0".join(parts)                                   # a zero byte in a text only shifts order, not equality
    part_at = np.cumsum(size + 1) - size - 1
    part_of = np.repeat(np.arange(len(parts)), size - span + 1)
    base = np.concatenate([[0], np.cumsum(size - span + 1)])
    start = part_at[part_of] + np.arange(base[-1]) - base[part_of]
    number = np.full(len(joined) + 1, -1)
    number[start] = np.arange(len(start))
    sorted_windows = number[suffix_array(joined)]
    sorted_windows = sorted_windows[sorted_windows >= 0]
    view = np.lib.stride_tricks.as_strided(np.frombuffer(joined + bytes(64), np.uint8), (len(joined), span), (1, 1))
    group = np.zeros(len(start), np.int64)
    for a in range(1, len(sorted_windows), 100_000):             # compare neighbours in the suffix array
        here = sorted_windows[a:a + 100_000]
        group[a:a + len(here)] = (view[start[here]] != view[start[sorted_windows[a - 1:a - 1 + len(here)]]]).any(axis=1)
    group = np.cumsum(group)
    smallest = np.full(group[-1] + 1, LARGEST)
    np.minimum.at(smallest, group, ids[part_of[sorted_windows]])
    of_window = np.empty(len(start), np.int64)
    of_window[sorted_windows] = smallest[group]
    inside = places - heads[stretch]
    value[places] = np.minimum(value[places], of_window[base[which[stretch]] + inside])
    return first, value


def without_repeats(documents: DataFrame, span: int = SPAN, digests: bool = False, as_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and ``spans`` (begin and length of the removed runs) to every row, and
    puts the remaining bytes into ``kept``, or with ``as_text`` what can be read of them; with ``digests`` only doc_id and kept_sha256 are returned with the counts.

    A byte goes if a ``span``-byte string over it also starts in a document with a
    smaller doc_id; all is judged on the input. Null text counts as empty. A
    shorter text, and a row with null doc_id, loses nothing and takes nothing.
    Rows that share a doc_id are not smaller than each other. All columns of the
    input stay; those named like the added ones are replaced.

    A minimizer that many batches hold is dealt by whole windows, so no block
    gathers all surroundings of a frequent line; copies of a piece within a batch
    are sent once.
    """
    added = ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")
    rows = documents.select("doc_id", "text") if digests else documents.drop(*added)
    table = saved(batched(rows, span), "batches")
    runs = table.agg(F.sum("runs")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(runs / BLOCK_ENTRIES))

    def send_minimizers(batches):
        for arrow in batches:
            for i in range(len(arrow)):
                batch = opened(arrow.slice(i, 1).to_pylist()[0], span)
                hashes, _, several = batch.distinct()
                cuts = cuts_of(hashes, blocks)
                some = np.flatnonzero(np.diff(cuts))
                part = [slice(cuts[b], cuts[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.key)),
                     pa.array([packed_hashes(hashes[p]) for p in part], pa.binary()),
                     pa.array([bits(several[p]) for p in part], pa.binary())], ["block", "batch", "hashes", "several"])
                release()

    def find_repeated(group: pa.Table) -> pa.Table:
        release()
        lists = [unpacked_hashes(x) for x in group["hashes"].to_pylist()]
        own = np.concatenate([unbits(f, len(h)) for f, h in zip(group["several"].to_pylist(), lists)])
        _, inverse, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        flagged = np.bincount(inverse, own) > 0
        several, hot = ((n > 1) | flagged)[inverse], (n >= HOT_BATCHES)[inverse]
        ends = np.cumsum([len(h) for h in lists])
        return pa.table({
            "batch": group["batch"], "block": group["block"],
            "several": pa.array([bits(x) for x in np.split(several, ends[:-1])], pa.binary()),
            "hot": pa.array([bits(x) for x in np.split(hot, ends[:-1])], pa.binary())})

    first = saved(
        table.select("batch", "rows", "seed", "n").mapInArrow(send_minimizers, "block int, batch long, hashes binary, several binary")
        .groupBy("block").applyInArrow(find_repeated, "batch long, block int, several binary, hot binary"), "repeated")

    def send_pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        out = []
        for row in left.to_pylist():
            batch = opened(row, span)
            pieces = batch.pieces(*answered(batch, right.to_pylist(), blocks))
            order, cuts = dealt(pieces, blocks)
            for b in np.flatnonzero(np.diff(cuts)):
                held = order[cuts[b]:cuts[b + 1]]
                out.append((int(b), batch.key, squeeze(pieces["n"][held].astype(np.uint8).tobytes()),
                            squeeze(b"".join(pieces["texts"][i] for i in held)), squeeze(pieces["least"][held].tobytes())))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "batch", "n", "texts", "least"])

    def compare_pieces(group: pa.Table) -> pa.Table:
        release()
        seen: dict[bytes, int] = {}
        which, leasts = [], []
        for n, data, low in zip(group["n"].to_pylist(), group["texts"].to_pylist(), group["least"].to_pylist()):
            size = np.frombuffer(unsqueeze(n), np.uint8).astype(np.int64) + span - 1
            data, end = unsqueeze(data), np.cumsum(size)
            which.append(np.fromiter((seen.setdefault(data[a:b], len(seen)) for a, b in zip((end - size).tolist(), end.tolist())),
                                     np.int64, len(size)))
            leasts.append(np.frombuffer(unsqueeze(low), np.int64))
        least = np.full(len(seen), LARGEST)
        np.minimum.at(least, np.concatenate(which), np.concatenate(leasts))
        begin, value = least_of_windows(list(seen), least, span)
        # runs of windows with one value inside a piece
        change = np.append(True, value[1:] != value[:-1])
        change[begin[:-1]] = True
        heads = np.flatnonzero(change)
        length = np.diff(np.append(heads, len(value)))
        run_of = np.searchsorted(heads, begin)                   # first run of each piece
        out = []
        for mine in which:
            n = run_of[mine + 1] - run_of[mine]
            runs = np.repeat(run_of[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((squeeze(n.astype(np.uint8).tobytes()), squeeze(length[runs].astype(np.uint8).tobytes()), squeeze(value[heads[runs]].tobytes())))
        n, length, low = zip(*out)
        return pa.table({"batch": group["batch"], "block": group["block"], "n": pa.array(n, pa.binary()),
                         "length": pa.array(length, pa.binary()), "low": pa.array(low, pa.binary())})

    held = table.select("batch", "rows", "seed", "n")
    second = (
        held.groupBy("batch").cogroup(first.groupBy("batch"))
        .applyInArrow(send_pieces, "block int, batch long, n binary, texts binary, least binary")
        .groupBy("block").applyInArrow(compare_pieces, "batch long, block int, n binary, length binary, low binary")
    )

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        release()
        out = []
        for row in left.to_pylist():
            batch = opened(row, span)
            pieces = batch.pieces(*answered(batch, [a for a in answers if a["several"] is not None], blocks))
            order, cuts = dealt(pieces, blocks)
            count = np.zeros(len(pieces["texts"]), np.int64)
            parts = sorted((a for a in answers if a["length"] is not None), key=lambda a: a["block"])
            for a in parts:
                count[order[cuts[a["block"]]:cuts[a["block"] + 1]]] = np.frombuffer(unsqueeze(a["n"]), np.uint8)
            length = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(unsqueeze(a["length"]), np.uint8).astype(np.int64) for a in parts)])
            low = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(unsqueeze(a["low"]), np.int64) for a in parts)])
            begin = np.empty(len(order), np.int64)               # first run of each piece, in the order of the answers
            begin[order] = np.cumsum(count[order]) - count[order]
            inside = np.cumsum(length) - length
            n = count[pieces["which"]]
            runs = np.repeat(begin[pieces["which"]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(pieces["at"], n) + inside[runs] - np.repeat(inside[begin[pieces["which"]]] if len(inside) else begin[pieces["which"]], n)
            gone = low[runs] < np.repeat(batch.ids[pieces["doc"]], n)
            cover = np.zeros(len(batch.data) + 1, np.int32)
            np.add.at(cover, at[gone], 1)
            np.add.at(cover, (at + length[runs] + span - 1)[gone], -1)
            out.append(marked(batch, np.cumsum(cover)[:len(batch.data) - 64] > 0))
        return pa.concat_tables(out)

    def marked(batch: Batch, removed: np.ndarray) -> pa.Table:
        columns = {k: [] for k in added}
        source = batch.data.tobytes()
        for a, e in zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist()):
            flags = removed[a:e]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
            spans = edges.reshape(-1, 2)
            kept = source[a:e] if not len(spans) else batch.data[a:e][~flags].tobytes()
            columns["n_bytes"].append(e - a)
            columns["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            columns["n_spans"].append(len(spans))
            if digests:
                columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            else:
                columns["kept"].append(kept.decode("utf-8", "ignore") if as_text else kept)
                columns["spans"].append([{"begin": int(x), "length": int(y - x)} for x, y in spans])
        result = batch.rows.select(["doc_id"]) if digests else batch.rows
        for name, values in columns.items():
            if name in kinds:
                result = result.append_column(name, pa.array(values, kinds[name]))
        return result

    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64()} | (
        {"kept_sha256": pa.string()} if digests else
        {"spans": pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64())])), "kept": pa.string() if as_text else pa.binary()})
    schema = extended(
        rows.select("doc_id") if digests else rows,
        "n_bytes long, n_removed long, n_spans long, " + (
            "kept_sha256 string" if digests else "spans array<struct<begin:long,length:long>>, kept " + ("string" if as_text else "binary")))
    answers = second.unionByName(first, allowMissingColumns=True)
    return held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(mark, schema)


def document_repeats(documents: DataFrame) -> DataFrame:
    return without_repeats(documents.withColumn("doc_id", F.col("doc_id").cast("bigint")), digests=True)


def cleaned(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of a document table with repeated passages taken out of ``text`` and ``n_chars`` counted anew.

    A removed run may begin or end inside a character; what is left of one is dropped.
    Null texts stay null.
    """
    inner = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(documents.columns)}     # no name can clash
    marked = without_repeats(documents.select(
        *[F.col(f"`{c}`").alias(name) for c, name in inner.items()]).withColumn("doc_id", F.col("doc_id").cast("bigint")), span, as_text=True)
    changed = F.col("n_removed") > 0
    out = marked.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in inner:
        n = inner["n_chars"]
        out = out.withColumn(n, F.when(changed, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*[F.col(name).alias(c) for c, name in inner.items()])

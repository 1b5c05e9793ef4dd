"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network."""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretally.llm.common import extended, fold_of, release

SYMBOLS, DIMENSIONS, SEED = 8192, 32, 7
#: Symbols that stand for a kind of word; the others are hashes of lower-case words.
BREAK, UPPER, NUMBER, AGAIN, SEEN, FIRST = 0, 1, 2, 3, 4, 16
EDGES = re.compile(r"([\W_]*)(.*?)([\W_]*)", re.S)
WORDS_KEPT = 300_000


def hashed(word: str) -> int:
    return FIRST + zlib.crc32(word.lower().encode("utf-8", "replace")) % (SYMBOLS - FIRST)


class Known(dict):
    """Symbols of the blank-separated words met so far in this process: that of the word itself plus
    SYMBOLS times that of the marks around it (0: none)."""

    def __missing__(self, word: str) -> int:
        before, core, after = EDGES.fullmatch(word).groups()
        if not core:
            found = hashed(word)
        else:
            kind = NUMBER if core.isdigit() else UPPER if len(core) > 1 and core.isupper() else hashed(core)
            found = kind + (SYMBOLS * hashed(before + after) if before or after else 0)
        self[word] = found
        return found


_known = Known()


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a whole text, marks behind their word; a word that repeats its predecessor is AGAIN,
    repeats of earlier three-word sequences are counted by as many SEEN at the end."""
    words = (text or "").split()
    if len(_known) > WORDS_KEPT:
        _known.clear()
    both = np.fromiter(map(_known.__getitem__, words), np.int64, len(words))
    plain = both % SYMBOLS
    row = np.stack([plain, both // SYMBOLS], axis=1)
    row[1:, 0][both[1:] == both[:-1]] = AGAIN
    row = row.ravel()
    row = row[row != BREAK]
    if len(plain) > 3:
        triple = (plain[:-2] * SYMBOLS + plain[1:-1]) * SYMBOLS + plain[2:]
        triple.sort()
        row = np.concatenate([row, np.full(np.count_nonzero(triple[1:] == triple[:-1]), SEEN)])
    return row


def index_vectors() -> np.ndarray:
    """Sparse ternary index vector of each symbol; the break has none."""
    drawn = np.random.default_rng(SEED).choice([-1, 0, 1], (SYMBOLS, DIMENSIONS), p=[0.125, 0.75, 0.125]).astype(np.float32)
    drawn[BREAK] = 0
    return drawn


def slices(batches, rows: int = 500):
    """The texts of Arrow batches in short lists."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.column(0).slice(at, rows).to_pylist()
        release()


def context_sums(documents: DataFrame) -> DataFrame:
    """(symbol, n, c0 ..): how often each symbol occurs in all texts, and the sum of the index vectors of
    the two words on either side. Every task adds up its own documents and gives a row for each symbol
    it has met; sums of whole numbers do not depend on their order."""
    names = [f"c{i}" for i in range(DIMENSIONS)]

    def count(batches):
        index = index_vectors()
        sums, n = np.zeros((SYMBOLS, DIMENSIONS)), np.zeros(SYMBOLS, np.int64)
        gap = np.zeros(2, np.int64)
        for texts in slices(batches):
            parts = [gap]
            for text in texts:
                parts += [symbols(text), gap]
            row = np.concatenate(parts)
            for start in range(2, len(row) - 2, 100_000):
                stop = min(start + 100_000, len(row) - 2)
                near = np.zeros((stop - start, DIMENSIONS), np.float32)
                for step in (-2, -1, 1, 2):
                    near += np.roll(index, step, axis=1)[row[start + step:stop + step]]
                here = row[start:stop]
                n += np.bincount(here, minlength=SYMBOLS)
                for d in range(DIMENSIONS):
                    sums[:, d] += np.bincount(here, near[:, d], SYMBOLS)
        n[BREAK] = 0
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(n[met]), *(pa.array(sums[met, d]) for d in range(DIMENSIONS))], ["symbol", "n", *names])

    schema = "symbol long, n long, " + ", ".join(f"{c} double" for c in names)
    return documents.select("text").mapInArrow(count, schema).groupBy("symbol").agg(
        F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


def word_vectors(documents: DataFrame) -> np.ndarray:
    """One row for each symbol: its unit context vector without the common direction, and the same
    weighted down for frequent symbols. At most SYMBOLS rows reach the driver."""
    rows = np.array([tuple(r) for r in context_sums(documents).collect()], float).reshape(-1, DIMENSIONS + 2)
    vectors, n = np.zeros((SYMBOLS, DIMENSIONS)), np.zeros(SYMBOLS)
    at = rows[:, 0].astype(int)
    vectors[at], n[at] = rows[:, 2:], rows[:, 1]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    vectors = unit(vectors)
    total = max(1.0, n.sum())
    vectors[at] = unit(vectors[at] - (n[:, None] * vectors).sum(0) / total)
    rare = 1e-3 / (1e-3 + n / total)
    return np.concatenate([vectors, vectors * rare[:, None]], axis=1).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of a whole text; zeros where it has no word."""
    row = symbols(text)
    if not len(row):
        return np.zeros(vectors.shape[1], np.float32)
    which, n = np.unique(row, return_counts=True)
    return (n.astype(np.float32) @ vectors[which]) / len(row)


class Network:
    """Two layers over standardised features; probabilities at a temperature fitted on rows left out of training."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4):
        self.hidden, self.epochs, self.rate, self.decay = hidden, epochs, rate, decay
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Network":
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        self.w1 = draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden))
        self.b1, self.w2, self.b2 = np.zeros(self.hidden), draw.normal(0, self.hidden ** -0.5, self.hidden), 0.0
        left = draw.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
        train, target = (x[~left] - self.mean) / self.spread, y[~left]
        moments = [[0.0, 0.0] for _ in range(4)]
        step = 0
        for _ in range(self.epochs):
            order = draw.permutation(len(target))
            for at in range(0, len(order), 128):
                rows = order[at:at + 128]
                h = np.tanh(train[rows] @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - target[rows]) / len(rows)
                back = np.outer(error, self.w2) * (1 - h * h)
                slopes = [train[rows].T @ back + self.decay * self.w1, back.sum(0), h.T @ error + self.decay * self.w2, error.sum()]
                step += 1
                for i, (name, g) in enumerate(zip(("w1", "b1", "w2", "b2"), slopes)):
                    moments[i][0] = 0.9 * moments[i][0] + 0.1 * g
                    moments[i][1] = 0.999 * moments[i][1] + 0.001 * g * g
                    change = moments[i][0] / (1 - 0.9 ** step) / (np.sqrt(moments[i][1] / (1 - 0.999 ** step)) + 1e-8)
                    setattr(self, name, getattr(self, name) - self.rate * change)
        if left.any():
            z, t = self.logits(x[left]), y[left]
            loss = lambda c: np.mean(np.logaddexp(0, z / c) - t * z / c)
            self.temperature = min(np.geomspace(0.3, 10, 60), key=loss)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5) -> DataFrame:
    """(text, y) of about ``rows`` labelled documents outside fold 0, drawn by a hash of the id.

    The drawn labels, at most a few more than ``rows``, go to the tasks that read the documents.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != 0)).select(
        "doc_id", F.col(label).cast("double").alias("y"))
    n = known.count()
    if n > rows:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.lit(int(2**53 * rows / n)))
    return documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000):
    """(word vectors of all documents, network of the labelled sample). ``rows`` bounds what is fitted on.

    Without labelled rows of both kinds the network is None.
    """
    vectors = word_vectors(documents)

    def pool(batches):
        for batch in batches:
            x = [pooled(t, vectors).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1)], ["x", "y"])

    sample = labelled_sample(documents, labels, label, rows).mapInArrow(pool, "x array<float>, y double").collect()
    sample.sort(key=lambda r: (r["y"], r["x"]))            # the order of tasks must not change the fit
    y = np.array([r["y"] for r in sample])
    if len(set(y)) < 2:
        return vectors, None
    return vectors, Network().fit(np.array([r["x"] for r in sample], float), y)


def score_quality(documents: DataFrame, vectors: np.ndarray, network: Network | None) -> DataFrame:
    """Adds ``score``, the calibrated probability of label 1, to any table with a text column.

    Null and empty texts are scored as texts without words; without a network every score is 0.5.
    """
    def score(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if network is None or not texts:
                values = np.full(len(texts), 0.5)
            else:
                values = network.probability(np.array([pooled(t, vectors) for t in texts], float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, "score"])
            release()

    kept = documents.drop("score")
    return kept.mapInArrow(score, extended(kept, "score double"))


def document_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    vectors, network = train(documents, labels)
    scored = score_quality(documents.select("doc_id", "text"), vectors, network)
    return scored.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))

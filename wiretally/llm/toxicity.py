"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""
from __future__ import annotations

from collections import Counter
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wiretally.llm.common import fold_of, release, saved

PREFIXES = (5, 6, 7, 8)
EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»„“”‘’¿¡…"
WORDS_KEPT = 200_000
SCORES_KEPT = 20_000
BLOCK = 64
SLICE = 4096
LEAST_CHI = 12.0
STRESS = 20.0


def terms_of(word: str) -> list[str]:
    """A word in lower case without marks at its ends, and its beginnings of 5 to 8 letters."""
    word = word.strip(EDGE).lower()
    return ([word] if word else []) + [word[:n] + "*" for n in PREFIXES if len(word) > n]


class TermIds(dict):
    """Ids of the vocabulary's terms in each word met so far in this process."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple:
        if len(self) > WORDS_KEPT:
            self.clear()
        found = tuple(self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary)
        self[word] = found
        return found


def drawn_examples(documents: DataFrame, labels: DataFrame, rows: int, folds: int = 5) -> DataFrame:
    """(doc_id, y, text) of about ``rows`` labelled documents outside fold 0, drawn by a hash of the id.

    Repeated rows of a doc_id are one example: the higher label, the least text.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != 0)).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("double").alias("y"))
    n = known.count()
    if n > rows:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.lit(int(2**53 * rows / n)))
    return documents.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(known), "doc_id").groupBy(
        "doc_id", "y").agg(F.min("text").alias("text"))


def telling_terms(sample: DataFrame, least_chi: float = LEAST_CHI) -> dict[str, float]:
    """Terms that tell the labels apart, with their chi-squared value over the documents of a labelled sample.

    ``sample`` has text and y. Every task counts its own documents; the terms that
    reach the driver are bounded by the sample.
    """
    def count(batches):
        for batch in batches:
            n, toxic = Counter(), Counter()
            total = hits = 0
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(chain.from_iterable(map(terms_of, set((text or "").split()))))
                n.update(found)
                total, hits = total + 1, hits + y
                if y:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*n, None], pa.string()), pa.array([*n.values(), total], pa.int64()),
                 pa.array([*(toxic[t] for t in n), int(hits)], pa.int64())], ["term", "n", "hits"])

    counts = saved(sample.select("text", "y").mapInArrow(count, "term string, n long, hits long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits")), "terms")
    whole = counts.filter("term IS NULL").first()
    if whole is None or not 0 < whole["hits"] < whole["n"]:
        return {}
    rate = whole["hits"] / whole["n"]
    scored = counts.filter("term IS NOT NULL AND n >= 3").withColumn(
        "chi", F.pow(F.col("hits") - F.col("n") * rate, F.lit(2)) / (F.col("n") * rate * (1 - rate)))
    return {r["term"]: r["chi"] for r in scored.filter(F.col("chi") > least_chi).select("term", "chi").collect()}


def term_counts(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, terms, counts): the vocabulary's terms of every whole text with their counts.

    Every task adds its document frequencies, one row for each ``SLICE`` terms, with the number of that slice in
    ``slice`` (null for documents).
    """
    size = len(vocabulary)

    def count(batches):
        words = TermIds(vocabulary)
        seen = np.zeros(size, np.int32)
        for batch in batches:
            terms, counts = [], []
            for text in batch.column(1).to_pylist():
                found = np.fromiter(chain.from_iterable(map(words.__getitem__, (text or "").split())), np.int32)
                at, n = np.unique(found, return_counts=True)
                seen[at] += 1
                terms.append(at)
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
                 pa.nulls(len(terms), pa.int32())], ["doc_id", "terms", "counts", "slice"])
            release()
        parts = [seen[i:i + SLICE] for i in range(0, size, SLICE)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.list_(pa.int32())),
             pa.array(parts, pa.list_(pa.int32())), pa.array(range(len(parts)), pa.int32())],
            ["doc_id", "terms", "counts", "slice"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        count, "doc_id bigint, terms array<int>, counts array<int>, slice int")


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' frequency rows; each slice is summed in one task as a stream."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = counts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                sums[at] = sums[at] + values if at in sums else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["slice", "counts"])

    rows = counted.filter("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(
        add, "slice int, counts array<bigint>").collect()                   # one row for each SLICE terms
    total = np.zeros(size)
    for r in rows:
        total[r["slice"] * SLICE:r["slice"] * SLICE + len(r["counts"])] = r["counts"]
    return total


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges given by start and size, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class BlockMaxIndex:
    """Labelled examples as postings in blocks of ``BLOCK`` examples with the largest weight of each block.

    ``worth`` is the weight of each term beside its count. ``search`` is exact: the blocks with the
    highest bounds give a k-th best score, then every block whose bound reaches it is opened. Terms
    of an eighth of the examples also keep their postings as full rows, for queries that open many blocks.
    """

    def __init__(self, rows: list[tuple], worth: np.ndarray):
        self.worth = worth
        unit = [(self.weigh(t, c), i, y) for i, y, t, c in rows]
        # examples with the same heaviest term lie together, which makes the bounds tight
        unit.sort(key=lambda r: (int(r[0][0][np.argmax(r[0][1])]) if len(r[0][0]) else -1, r[1]))
        self.vectors = [u[0] for u in unit]
        self.ids = np.array([u[1] for u in unit], np.int64)
        self.place = {int(i): at for at, i in enumerate(self.ids)}
        self.y = np.array([u[2] for u in unit], float)
        self.blocks = max(1, -(-len(unit) // BLOCK))
        sizes = np.array([len(v[0]) for v in self.vectors], np.int64)
        term = np.concatenate([v[0] for v in self.vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([v[1] for v in self.vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(len(unit), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")           # by term, then by example
        self.at, self.weight = example[order].astype(np.int64), weight[order]
        cell, first = np.unique(term[order] * self.blocks + self.at // BLOCK, return_index=True)
        self.block = cell % self.blocks
        self.first = np.append(first, len(order))         # postings of each (term, block)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cell // self.blocks, np.arange(len(worth) + 1))    # (term, block) of each term

        spans = np.searchsorted(term[order], np.arange(len(worth) + 1))
        frequent = np.flatnonzero(np.diff(spans) * 8 >= max(1, len(unit)))
        self.row = np.full(len(worth), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.full = np.zeros((len(frequent), len(unit)))
        for at, t in enumerate(frequent):
            part = slice(spans[t], spans[t + 1])
            self.full[at, self.at[part]] = self.weight[part]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}       # not needed by a search

    def weigh(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        terms = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.worth[terms] if len(terms) else np.zeros(0)
        norm = np.sqrt((w * w).sum())
        return terms, w / norm if norm else w

    def scores(self, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Inner products with all examples, of the given (term, block) cells."""
        sizes = self.first[cells + 1] - self.first[cells]
        at = spread(self.first[cells], sizes)
        return np.bincount(self.at[at], np.repeat(weights, sizes) * self.weight[at], minlength=len(self.ids))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest by falling cosine, ties to the smaller id; cosine 0 is no neighbour."""
        sizes = self.cells[terms + 1] - self.cells[terms]
        cells, each = spread(self.cells[terms], sizes), np.repeat(weights, sizes)
        block = self.block[cells]
        bound = np.bincount(block, each * self.most[cells], minlength=self.blocks)
        early = np.argsort(-bound, kind="stable")[:1 + -(-k // BLOCK)]
        chosen = np.zeros(self.blocks, bool)
        chosen[early] = True
        score = self.scores(cells[chosen[block]], each[chosen[block]])
        if but >= 0:
            score[but] = 0
        cutoff = np.partition(score, -k)[-k] if len(score) > k else 0.0
        more = (bound > 0) & (bound >= cutoff - 1e-9) & ~chosen
        if more.any():
            if more.sum() * 4 > self.blocks:
                row = self.row[terms]
                rare = np.repeat(row < 0, sizes)
                score = weights[row >= 0] @ self.full[row[row >= 0]] + self.scores(cells[rare], each[rare])
            else:
                score += self.scores(cells[more[block]], each[more[block]])
            if but >= 0:
                score[but] = 0
        score = np.round(score, 12)
        at = np.flatnonzero(score > 0)
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], -k)[-k]]
        at = at[np.lexsort((self.ids[at], -score[at]))][:k]
        return at, score[at]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, each pulled a little towards the mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []                     # sum of x, sum of y, n
    for a, b in zip(x[order], y[order]):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    mean = y.mean() if len(y) else 0.5
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + mean) / (p[2] + 1) for p in pools])


class Neighbours:
    """Distance-weighted votes of the k nearest examples, calibrated on the examples themselves, each left out in turn."""

    def __init__(self, index: BlockMaxIndex, k: int = 15):
        self.index, self.k = index, k
        votes = np.array([self.vote(*index.vectors[i], i)[0] for i in range(len(index.ids))])
        held = votes >= 0
        self.knots = isotonic(votes[held], index.y[held]) if held.any() else None
        rest = index.y[~held]
        self.prior = float((rest.sum() + 1) / (len(rest) + 2)) if len(rest) else float(index.y.mean()) if len(index.y) else 0.5

    def vote(self, terms, weights, but: int = -1):
        """Vote of the neighbours, -1 if there are none, and who they are."""
        if not len(terms) or not len(self.index.ids):
            return -1.0, (), ()
        at, cosine = self.index.search(terms, weights, self.k, but)
        if not len(at):
            return -1.0, (), ()
        near = cosine ** 2
        return float(near @ self.index.y[at] / near.sum()), self.index.ids[at], cosine

    def score(self, terms, counts, doc_id=None):
        """Score and evidence; a document that is an example itself has no vote on its own score."""
        vote, ids, cosine = self.vote(*self.index.weigh(terms, counts), self.index.place.get(doc_id, -1))
        if vote < 0 or self.knots is None:
            return self.prior, [], []
        x, y = self.knots
        p = float(np.interp(vote, x, y))
        return min(1.0, max(0.0, 0.98 * p + 0.02 * vote)), [int(i) for i in ids], [float(c) for c in cosine]


def document_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = 20_000,
                      examples: int = 3000, folds: int = 5, stress: float = STRESS) -> DataFrame:
    """Score, decision and evidence for every document.

    About ``examples`` labelled documents outside fold 0 are indexed with every word they have; document frequencies
    are counted over all documents. The TF-IDF weight of a term is multiplied by up to 1 + ``stress`` the better it
    tells the labels apart (chi-squared over about ``rows`` labelled documents, which also chooses the beginnings of
    words that count as terms). A text that is null, empty or has no word of an example has no neighbours; its
    score is the rate of such examples. Repeated rows of a doc_id are one example. No example votes on its own
    score. Without labels of both kinds every score is 0.5. ``evidence`` lists the ids and cosines of the nearest
    examples. Other columns of the input are not read.
    """
    def bags(batches):
        for batch in batches:
            found = [Counter(filter(None, (w.strip(EDGE).lower() for w in (t or "").split()))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string()))],
                ["doc_id", "y", "words"])

    chi = telling_terms(drawn_examples(documents, labels, rows, folds))
    held = saved(drawn_examples(documents, labels, examples, folds).mapInArrow(
        bags, "doc_id bigint, y double, words array<string>"), "examples")
    words = [r[0] for r in held.select(F.explode("words")).distinct().collect()]        # words of about ``examples`` texts
    vocabulary = {t: i for i, t in enumerate(sorted({*words, *chi}))}
    counted = saved(term_counts(documents, vocabulary), "term_counts")
    texts = counted.filter("slice IS NULL")
    n = texts.count()
    worth = np.log1p(n / np.maximum(document_frequencies(counted, len(vocabulary)), 1))
    for term, value in chi.items():
        worth[vocabulary[term]] *= 1 + stress * max(0.0, 1 - LEAST_CHI / value)
    drawn = texts.join(F.broadcast(held.select("doc_id", "y")), "doc_id").groupBy("doc_id", "y").agg(
        F.min(F.struct("terms", "counts")).alias("t")).select("doc_id", "y", "t.terms", "t.counts").collect()
    rows_held = sorted(tuple(r) for r in drawn)                                          # about ``examples`` rows
    model = Neighbours(BlockMaxIndex(rows_held, worth)) if chi and len({r[1] for r in rows_held}) == 2 else None

    def score(batches):
        known: dict = {}
        for batch in batches:
            out = []
            terms, counts = batch.column(1), batch.column(2)
            for doc_id, t, c in zip(batch.column(0).to_pylist(), terms, counts):
                if model is None:
                    out.append((0.5, [], []))
                    continue
                t, c = t.values.to_numpy(), c.values.to_numpy()
                if doc_id in model.index.place:
                    out.append(model.score(t, c, doc_id))
                    continue
                key = blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest()
                if key not in known:
                    if len(known) > SCORES_KEPT:
                        known.clear()
                    known[key] = model.score(t, c)
                out.append(known[key])
            scores, ids, cosines = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())),
                 pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "cosines"])

    scored = texts.select("doc_id", "terms", "counts").mapInArrow(
        score, "doc_id bigint, score double, evidence array<bigint>, cosines array<double>")
    return scored.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "cosines")

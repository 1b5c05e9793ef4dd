"""Language identification by compressed size under per-language dictionaries."""
from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

from wiretally.llm.common import extended, fold_of, release

LETTER = regex.compile(r"\p{L}")


def dictionaries(labelled: DataFrame, rows: int = 1500, chars: int = 120, size: int = 112_000) -> dict[str, bytes]:
    """Raw-content dictionary of each language from a bounded sample of its labelled texts.

    ``labelled`` has text and lang. Of a language with n rows about ``rows`` are
    drawn by a hash of the text, each gives a piece of at most ``chars``
    characters, and ``size`` bytes of pieces are kept. Only languages are
    counted exactly; no task or the driver sees more than the sample.
    """
    held = labelled.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    counts = held.groupBy("lang").count().collect()     # one row for each language
    if not counts:
        return {}
    rates = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, float(rows) / n)])
    drawn = (F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(2**53)))
    sample = (
        held.filter(drawn < rates[F.col("lang")])
        .select("lang", F.lower(F.expr(f"substring(text, greatest(1, length(text) div 2 - {chars // 2}), {chars})")).alias("piece"))
        .distinct()
    )
    pieces: dict[str, list[str]] = {}
    for lang, piece in sample.orderBy("lang", F.xxhash64("piece")).collect():
        pieces.setdefault(lang, []).append(piece)
    return {lang: "\n".join(p).encode()[:size] for lang, p in pieces.items()}


def identify(documents: DataFrame, learned: dict[str, bytes], margin: float = 0.02, short: int = 1000,
             tail: int = 1500) -> DataFrame:
    """Adds lang_pred, score and narrow: the language whose dictionary gives the smallest output.

    Whole texts are compressed. A text of fewer than ``short`` bytes is too small
    to compress by itself, so it follows the last ``tail`` bytes of the learned
    text and its size is the growth of the output. ``score`` is the share of a
    soft minimum over the sizes. Where the two smallest sizes differ
    by less than ``margin`` of the smaller one, ``narrow`` is true: a caller that
    prefers no answer to a doubtful one rejects these. Ties go to the language
    that comes first in the alphabet. A text that is null or has no letter is
    ``und`` with score 0; without learned languages every text is ``und``.
    """
    names = sorted(learned)

    def predict(batches):
        params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_dict_id=False)
        coders = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(learned[n][:-tail] or learned[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                compression_params=params) for n in names]
        ends = [learned[n][-tail:] for n in names]
        bare = [len(c.compress(end)) for c, end in zip(coders, ends)]

        def one(text):
            if text is None or not names or not LETTER.search(text):
                return "und", 0.0, False
            data = text.lower().encode()
            if len(data) < short:
                sizes = [len(c.compress(end + data)) - n for c, end, n in zip(coders, ends, bare)]
            else:
                sizes = [len(c.compress(data)) for c in coders]
            least = min(sizes)
            # sizes in bytes differ by units of 8 bits; long texts saturate
            weights = [math.exp(-min(50.0, float(s - least))) for s in sizes]
            second = min([s for i, s in enumerate(sizes) if i != sizes.index(least)], default=None)
            narrow = second is not None and second - least < margin * least
            return names[sizes.index(least)], 1.0 / sum(weights), narrow

        for batch in batches:
            known: dict = {}
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                if text not in known:
                    known[text] = one(text)
                rows.append(known[text])
            lang, score, narrow = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())],
                [*batch.schema.names, "lang_pred", "score", "narrow"])
            release()

    kept = documents.drop("lang_pred", "score", "narrow")
    return kept.mapInArrow(predict, extended(kept, "lang_pred string, score double, narrow boolean"))


def document_languages(documents: DataFrame) -> DataFrame:
    """Predicted language of every document, learned from texts outside the held-out quarter."""
    fold = F.coalesce(fold_of(F.col("doc_id"), 4), F.lit(0))
    learned = dictionaries(documents.filter(fold != 2).select("text", "lang"))
    narrow = documents.select("doc_id", (fold == 2).alias("held_out"), "text")
    return identify(narrow, learned).select("doc_id", "held_out", "lang_pred", "score", "narrow")

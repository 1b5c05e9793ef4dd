"""Benchmark decontamination: windows of typed templates and of plain words, joined by hash and checked for consistent slots.

DataFrame and SQL functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretally.llm.common import saved

#: Tokens in a window; the fewest tokens of a benchmark item that is also searched for with other values.
WINDOW, LEAST = 8, 5
#: Template windows of the benchmark that may be sent to every task (about 100 bytes each).
BROADCAST_WINDOWS = 500_000
#: Text hashes that may be sent to every task (8 bytes each).
BROADCAST_ROWS = 1_000_000
TOKEN_WORD = r"\d+(?:[.,:/]\d+)*|\p{L}+"
TOKEN = TOKEN_WORD + r"|[.!?\n]+"
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz gram grams kilogram kilograms ton tons "
    "ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent degree degrees kmh mph "
    "hz khz mhz ghz w kw kwh v volt volts a amp amps watt watts joule joules j n pa bar psi kb mb gb tb byte bytes bit bits").split()


def is_mark(token: Column) -> Column:
    """Whether a raw token is a run of marks or line ends: ``?`` alone of them sorts above the digits."""
    return (token < "0") | token.startswith("?")


def template(text: Column) -> Column:
    """Raw tokens, template tokens and an array of (t, v, l), each made from the one before: the template token, where it is a placeholder the value it stands for, and the word in lower case.

    Numbers become ``<number>``; units behind a number ``<unit>``; words with a
    capital followed by small letters that do not begin a sentence ``<name>``.
    Other words are put in lower case. Marks and line ends only part sentences.
    """
    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def kind(word: Column, i: Column) -> Column:
        low = F.get(F.col("_low"), i)
        before = F.get(raw_here, i - 1)
        number = (word <= "9~") & (word >= "0")
        name = (word != low) & (F.length(word) > 1) & (i > 0) & ~is_mark(before) \
            & (F.substring(word, 2, 1_000_000) == F.substring(low, 2, 1_000_000))
        unit = low.isin(UNITS) & (i > 0) & (before <= "9~") & (before >= "0")
        return F.when(number, "<number>").when(unit, "<unit>").when(name, "<name>").otherwise(low)

    def with_value(t: Column, i: Column) -> Column:
        low = F.get(F.col("_low"), i)
        return F.struct(t.alias("t"), F.when(t.startswith("<"), low).alias("v"), low.alias("l"))

    raw_here = F.col("_raw")
    return raw, F.transform(raw_here, kind), F.filter(F.transform(F.col("_kinds"), with_value), lambda x: ~is_mark(x["l"]))


def with_template(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_t`` (template tokens), ``_v`` (their values) and ``_l`` (the words); null text has none."""
    raw, kinds, pairs = template(F.col(text))
    return (
        rows.withColumn("_raw", F.coalesce(raw, F.array().cast("array<string>")))
        .withColumn("_low", F.transform("_raw", F.lower))
        .withColumn("_kinds", kinds)
        .withColumn("_pairs", pairs)
        .withColumn("_t", F.col("_pairs")["t"]).withColumn("_v", F.col("_pairs")["v"]).withColumn("_l", F.col("_pairs")["l"])
        .drop("_raw", "_low", "_kinds", "_pairs")
    )


def hashed(column: str, size: int, at: Column) -> Column:
    """(h, at) of the window of ``size`` tokens at each place of ``at``."""
    return F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(size), *[F.get(F.col(column), i + k) for k in range(size)]).alias("h"), i.alias("at")))


def windows(size: int, column: str = "_t") -> Column:
    """Hashes of all windows of ``size`` tokens, with their places; null if there are fewer tokens."""
    n = F.size(column) - size
    return F.when(n >= 0, hashed(column, size, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))))


def word_windows(size: int) -> Column:
    """Hashes of the words of all windows that have a placeholder. Without one they are those of the template."""
    n = F.size("_l") - size
    places = F.filter(F.transform("_v", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(
        places, lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.least(i, F.greatest(n, F.lit(0)))))))
    return F.when(n >= 0, hashed("_l", size, starts))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(h, size, item_id, item_at, n_windows, slots) of every window of every item.

    An item shorter than the window is one window. The words of every window are
    searched for, so exact copies are found whatever they consist of. Its template
    is searched for too where at least half are words, and the item has ``least``
    tokens. An item that begins with a capital has its first template window twice,
    the first word as a word and as a name: in a document it may follow a mark or
    any word. ``slots`` lists the offsets and values of the placeholders.
    """
    word = F.regexp_extract("text", TOKEN_WORD, 0)
    low = F.lower(word)
    begins = (word != low) & (F.length(word) > 1) & (F.substring(word, 2, 1_000_000) == F.substring(low, 2, 1_000_000))
    items = saved(
        with_template(benchmark.select("item_id", "text")).filter(F.size("_t") > 0)
        .select("item_id", "_t", "_v", "_l", begins.alias("begins"), F.lit(False).alias("named")), "items")
    rest = F.lit(1_000_000)
    named = items.filter("begins").select(
        "item_id", F.concat(F.array(F.lit("<name>")), F.slice("_t", F.lit(2), rest)).alias("_t"),
        F.concat(F.slice("_l", 1, 1), F.slice("_v", F.lit(2), rest)).alias("_v"), "_l", "begins", F.lit(True).alias("named"))
    out = None
    for size in sorted({min(r[0], window) for r in items.select(F.size("_t")).distinct().collect()}):
        of_size = (F.size("_t") == size) if size < window else (F.size("_t") >= size)
        for column, fitting in (("_t", items.unionByName(named).filter(of_size)), ("_l", items.filter(of_size))):
            one = (
                fitting.withColumn("w", F.explode(windows(size, column))).filter(~F.col("named") | (F.col("w.at") == 0))
                .withColumn("_slot", F.slice("_v", F.col("w.at") + 1, F.lit(size)))
                .select(
                    F.col("w.h").alias("h"), F.lit(size).alias("size"), "item_id", F.col("w.at").alias("item_at"),
                    (F.size("_t") - size + 1).alias("n_windows"),
                    F.filter(F.transform("_slot", lambda v, i: F.struct(i.alias("off"), v.alias("value"))), lambda s: s["value"].isNotNull()).alias("slots"))
            )
            if column == "_t":
                one = one.filter(F.size("slots") * 2 <= size).filter(F.lit(size >= least))
            else:
                one = one.filter((F.size("slots") > 0) | F.lit(size < least))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return items.sparkSession.createDataFrame(
            [], "h long, size int, item_id long, item_at int, n_windows int, slots array<struct<off:int,value:string>>")
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.5, run: int = 6) -> DataFrame:
    """(doc_id, item_id, doc_at, n_matched, n_windows, coverage, n_slots) of every benchmark item found in a document.

    An item is found at a place where ``run`` of its windows or ``share`` of them
    (whichever is less) match on one diagonal, and its slots are consistent: a
    value of the item stands for one value of the document throughout. So an exact
    copy is found, also in other case, and one with other numbers, names or units; a text that merely
    has the same shape with values mixed up is not. A document that is null, empty
    or shorter than an item holds nothing of it; rows with null doc_id are skipped.
    The best place of each (document, item) is returned, rows that repeat a doc_id together.
    """
    spark = documents.sparkSession
    wanted = saved(benchmark_windows(benchmark, window), "windows")
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_WINDOWS else wanted
    empty = spark.createDataFrame([], "doc_id long, row long, doc_at int, item_id long, item_at int, n_windows int, slots array<struct<off:int,value:string>>")
    known = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    read = with_template(known.withColumn("row", F.xxhash64("text"))).select("doc_id", "row", "_t", "_v", "_l")
    hits = empty
    if sizes:
        every = F.concat(*[F.coalesce(w, F.array().cast("array<struct<h:bigint,at:int>>")) for s in sizes for w in (windows(s), word_windows(s))])
        hits = (
            read.select("doc_id", "row", F.explode(every).alias("w"))
            .select("doc_id", "row", F.col("w.h").alias("h"), F.col("w.at").alias("doc_at"))
            .join(small, "h")
            .select("doc_id", "row", "doc_at", "item_id", "item_at", "n_windows", "slots")
        )
    hits = saved(hits, "hits").distinct()
    place = ["doc_id", "row", "item_id", (F.col("doc_at") - F.col("item_at")).alias("start")]
    enough = (
        hits.groupBy(*place, "n_windows").agg(F.count_distinct("item_at").alias("n_matched"))
        .filter((F.col("n_matched") >= F.least(F.lit(run), F.ceil(F.col("n_windows") * share))))
    )
    with_slots = hits.filter(F.size("slots") > 0).select("*", (F.col("doc_at") - F.col("item_at")).alias("start")).join(
        enough.select("doc_id", "row", "item_id", "start"), ["doc_id", "row", "item_id", "start"], "left_semi")
    asked = with_slots.groupBy("doc_id", "row").agg(F.collect_set(F.struct("item_id", "start", "doc_at", "slots")).alias("asked"))
    asked = saved(asked, "asked")
    rows = asked.select("row").distinct()
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows    # only texts that are asked for are moved
    asked_texts = known.withColumn("row", F.xxhash64("text")).join(rows, "row", "left_semi").dropDuplicates(["doc_id", "row"])
    values = (
        with_template(asked_texts.join(asked, ["doc_id", "row"]))
        .select("doc_id", "row", "_l", F.explode("asked").alias("a"))
        .select("doc_id", "row", "a.item_id", "a.start", F.explode(F.transform("a.slots", lambda s: F.struct(
            s["value"].alias("item_value"), F.get(F.col("_l"), F.col("a.doc_at") + s["off"]).alias("doc_value")))).alias("s"))
    )
    slots = values.groupBy("doc_id", "row", "item_id", "start", "s.item_value").agg(
        F.count_distinct("s.doc_value").alias("n")).groupBy("doc_id", "row", "item_id", "start").agg(
        F.count(F.lit(1)).alias("n_slots"), F.max("n").alias("most"))
    good = enough.join(slots, ["doc_id", "row", "item_id", "start"], "left").filter(F.coalesce("most", F.lit(1)) == 1)
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        "n_matched", (-F.col("start")).alias("back"), "n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))).alias("b"))
    return best.select(
        "doc_id", "item_id", (-F.col("b.back")).alias("doc_at"), "b.n_matched", "b.n_windows",
        (F.col("b.n_matched") / F.col("b.n_windows")).alias("coverage"), "b.n_slots")


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without doc_id stay."""
    found = contaminated(documents, benchmark).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti").select(*documents.columns)

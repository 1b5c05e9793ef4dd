"""String helpers shared by all operators.

Patterns carry explicit flags: ``(?U)`` where word characters must include
accented letters, ``(?d)`` so that only a line feed ends a line.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters a Unicode-aware trim removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Trim all white space on both ends (Spark's ``trim`` only removes spaces)."""
    return F.btrim(c, F.lit(BLANKS))


def chars(c: Column) -> Column:
    return F.length(c).cast("bigint")


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when the pattern does not match."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def extract_or(c: Column, pattern: str, default: str, group: int = 1) -> Column:
    return F.coalesce(extract(c, pattern, group), F.lit(default))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return all_matches(F.lower(c), r"[\p{L}\p{N}]+")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+)$", 1)


def pad(c: Column, width: int) -> Column:
    """Left-justify without ever cutting the value."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def contains_any(c: Column, words) -> Column:
    """True when at least one of a fixed list of words occurs in the text."""
    test = F.lit(False)
    for w in words:
        test = test | c.contains(w)
    return test


def let(value: Column, body) -> Column:
    """Bind an expression to a name inside one row.

    The optimizer copies an expression into every place that refers to it once;
    inside a lambda that would evaluate it per element. A bound value is
    evaluated once per row.
    """
    return F.transform(F.array(value), body)[0]


def lookup(table: dict, key: Column) -> Column:
    """Constant map of string arrays; an empty array for unknown keys."""
    pairs = []
    for k, values in table.items():
        pairs += [F.lit(k), F.array(*[F.lit(v) for v in values])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.array().cast("array<string>"))


def term_counts(tok: Column) -> Column:
    """Array of (term, tf) for one array of tokens.

    The tokens are sorted and the run starts subtracted, so counting stays in
    the row that holds the text: no shuffle by (text, term).
    """
    ordered = F.sort_array(tok)
    return F.transform(
        F.transform(
            F.array(F.struct(ordered.alias("s"))),
            lambda h: F.struct(
                h["s"].alias("s"),
                F.when(
                    F.size(h["s"]) > 0,
                    F.filter(
                        F.sequence(F.lit(1), F.greatest(F.size(h["s"]), F.lit(1))),
                        lambda i: (i == 1)
                        | (F.get(h["s"], i - 1) != F.get(h["s"], F.greatest(i - 2, F.lit(0)))),
                    ),
                )
                .otherwise(F.array().cast("array<int>"))
                .alias("starts"),
            ),
        ),
        lambda h: F.transform(
            h["starts"],
            lambda p, i: F.struct(
                F.get(h["s"], p - 1).alias("term"),
                (F.coalesce(F.get(h["starts"], i + 1), F.size(h["s"]) + 1) - p).cast("bigint").alias("tf"),
            ),
        ),
    )[0]

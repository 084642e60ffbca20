"""Text functions as native column expressions.

Two white-space sets, two comparison keys and two sets of edge signs are kept apart on purpose: the writer of a result
and its checker must not share a mistake.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, and the narrow set that ends a sentence: fixed values.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NARROW = r"[ \t\n\r]"
#: Signs that stand for one quotation mark or one dash when spans are compared: fixed values.
QUOTES = "'\"\u2018\u2019\u201a\u201c\u201d\u201e\u00ab\u00bb\u0060\u00b4"
DASHES = "-\u2013\u2014\u2212"

def trim_ws(c: Column) -> Column:
    """Without Unicode white space at the ends (``trim`` takes spaces alone)."""
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


def is_blank(c: Column) -> Column:
    return trim_ws(c) == ""


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; case and signs stay."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def estimate_tokens(c: Column) -> Column:
    """``characters * 10 div 36 + 1``."""
    return F.floor(F.length(c) * 10 / 36).cast("bigint") + 1


#: A token counter turns a text column into a count column.
Counter = Callable[[Column], Column]


def count_words(c: Column) -> Column:
    """A counter of white-space separated words."""
    return F.when(squash(c) == "", F.lit(0)).otherwise(F.size(F.split(squash(c), " "))).cast("bigint")


def low(c: Column) -> Column:
    """Simple lower case, a character for each; of two signs the full one depends on more or is longer."""
    return F.lower(F.replace(F.replace(c, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def high(c: Column) -> Column:
    """Simple upper case, a character for each: those whose upper case is longer (as of \u00df) stay."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)), "")


def writer_key(c: Column) -> Column:
    """Lower-cased letters and decimal digits: what the writer takes for the same statement."""
    return F.regexp_replace(low(c), r"[^\p{L}\p{Nd}]+", "")


def checker_key(c: Column) -> Column:
    """Lower-cased letters and numbers of all kinds: what the checker takes for the same statement."""
    return F.regexp_replace(low(c), r"[^\p{L}\p{N}]+", "")


def fold(c: Column) -> Column:
    """A span in comparable form: one quotation mark, one dash, simple lower case, single spaces."""
    return low(F.translate(squash(c), QUOTES[0] + QUOTES[2:] + DASHES[1:], '"' * (len(QUOTES) - 1) + "-" * (len(DASHES) - 1)))


def trim_fold_edges(c: Column) -> Column:
    """A folded span without spaces and the writer's edge signs at its ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[ \".,;:!?()\[\]-]+", ""), r"[ \".,;:!?()\[\]-]+$", "")


def shorten(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis where some are left out."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def took(ms: Column) -> Column:
    """A duration for people."""
    return F.when(ms < 1000, F.format_string("%d ms", ms.cast("bigint"))).otherwise(F.format_string("%.1f s", ms / 1000.0))


def shout(c: Column) -> Column:
    """ASCII letters in upper case."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row: a generator of one row stands between it and its uses, into
    which the optimizer would else write the whole expression, also into lambdas that run for every element of an array."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def folded(text: Column) -> Column:
    """A text made ready for searches, ``struct<hay, lead, runs>``: its folded form, how many characters of white space
    come before that, and for every longer run of white space, by its place in the folded form, how many characters are gone."""
    body, several = trim_ws(text), f"{WS}{{2,}}"
    gaps = F.transform(F.regexp_extract_all(body, F.lit(several), F.lit(0)), F.length)
    state = "struct<at:int,runs:array<struct<at:int,extra:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,extra:int>>").alias("runs")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["0"]
        run = F.struct(at.alias("at"), (x["1"] - 1).alias("extra"))
        return F.struct((at + 1).alias("at"), F.array_append(acc["runs"], run).alias("runs")).cast(state)

    pieces = F.transform(F.split(body, several), F.length)
    # one piece more than gaps: the last is not followed by one
    runs = F.aggregate(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(gaps)).alias("0"), gaps.alias("1")), start, step, lambda acc: acc["runs"])
    none = F.array().cast("array<struct<at:int,extra:int>>")
    lead = F.length(text) - F.length(F.regexp_replace(text, f"^{WS}+", ""))
    return F.struct(fold(text).alias("hay"), lead.alias("lead"), F.when(body.rlike(several), runs).otherwise(none).alias("runs"))

"""Quoted spans found in text as it is: location, exact characters, line and column.

A span is compared in folded form (see :func:`attesta.functions.text.fold`). A text is folded once for all its spans; each
is then one native string search. What was found is given back in the text's own characters: folding keeps the number of
characters except in runs of white space, so a place in the folded text is a place in the text plus what the runs before it lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import fold, folded, let, trim_fold_edges


def _place(ready: Column, at: Column) -> Column:
    """Where a character of the folded text is in the text."""
    lost = F.aggregate(F.filter(ready["runs"], lambda r: r["at"] < at), F.lit(0), lambda n, r: n + r["extra"])
    return ready["lead"] + at + F.when(F.size(ready["runs"]) > 0, lost).otherwise(0)


def _search(text: Column, ready: Column, q: Column) -> Column:
    """``struct<text, at>`` of the leftmost characters that fold to ``q``, or null."""

    def made(at: Column, spot: Column) -> Column:
        size = _place(ready, at + F.length(q) - 2) - spot + 1
        return F.struct(F.substring(text, spot + 1, size).alias("text"), spot.alias("at"))

    found = F.when(q != "", F.instr(ready["hay"], q))
    return let(found, lambda at: F.when(at > 0, let(_place(ready, at - 1), lambda spot: made(at, spot))))


def locate(text: Column, span: Column, ready: Column | None = None) -> Column:
    """``struct<text, at>`` of a span in a text (its own characters, and where they start, from 0), or null: the whole span
    is sought first, then without the signs at its ends. ``ready`` is :func:`folded` of the text, where that is at hand."""
    if ready is None:
        return let(folded(text), lambda made: locate(text, span, made))
    return let(fold(span), lambda q: F.coalesce(_search(text, ready, q), _search(text, ready, trim_fold_edges(q))))


def find(text: Column, span: Column, ready: Column | None = None) -> Column:
    """The exact characters of a span, or null."""
    return locate(text, span, ready)["text"]


def position(text: Column, at: Column) -> Column:
    """``struct<line, column>``, both from 1, of a character offset; only a line feed ends a line."""

    def made(before: Column) -> Column:
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
        column = F.length(F.substring_index(before, "\n", -1)) + 1
        return F.struct(line.cast("int").alias("line"), column.cast("int").alias("column"))

    return F.when(at.isNotNull(), let(F.substring(text, F.lit(1), at), made))

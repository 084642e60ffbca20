"""Claims of a text judged in Arrow batches: what a row's array of claims shares is worked out once, and each claim is a few string searches.

Column expressions within arrays are interpreted and walk the text sign by sign; over long texts that took most of a job's time.
The text functions here give what those of the same name in :mod:`attesta.functions.text` and :mod:`attesta.operators.spans` give.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from attesta.functions.text import DASHES, QUOTES
from attesta.session import ship

#: Rows in a batch: long texts must not add up to much memory.
BATCH_ROWS = 512
WS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS, _SEVERAL = re.compile(f"[{WS}]+"), re.compile(f"[{WS}]{{2,}}")
_UNEVEN = re.compile(f"[{WS.replace(' ', '')}]|  ")
_SIGNS = str.maketrans(QUOTES + DASHES, '"' * len(QUOTES) + "-" * len(DASHES))
_EDGES = ' ".,;:!?()[]-'


def squash(s: str) -> str:
    return (_RUNS.sub(" ", s) if _UNEVEN.search(s) else s).strip(" ")


def low(s: str) -> str:
    """Simple lower case, a character for each."""
    return s.lower() if s.isascii() else s.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()


def fold(s: str) -> str:
    return low(squash(s).translate(_SIGNS))


class Folded:
    """A text made ready for searches: its folded form, and where the characters of that are in the text."""

    def __init__(self, text: str):
        body = text.strip(WS)
        self.text, self.hay, self.lead = text, fold(text), len(text) - len(text.lstrip(WS))
        runs = [(m.start(), len(m[0]) - 1) for m in _SEVERAL.finditer(body)]
        self.lost = [0, *accumulate(n for _, n in runs)]
        self.at = [at - gone for (at, _), gone in zip(runs, self.lost, strict=False)]  # by place in the folded form

    def place(self, at: int) -> int:
        return self.lead + at + self.lost[bisect_left(self.at, at)]

    def _search(self, q: str) -> tuple[str, int] | None:
        at = self.hay.find(q) if q else -1
        if at < 0:
            return None
        spot = self.place(at)
        return self.text[spot : self.place(at + len(q) - 1) + 1], spot

    def locate(self, span: str) -> tuple[str, int] | None:
        """The text's own characters for a span, and where they start: the whole span is sought first, then without the signs at its ends."""
        q = fold(span)
        return self._search(q) or self._search(q.strip(_EDGES))


def position(text: str, at: int) -> dict[str, int]:
    """Line and column, both from 1, of a character offset."""
    return {"line": text.count("\n", 0, at) + 1, "column": at - text.rfind("\n", 0, at)}


#: From a row's text and the wanted fields of its structs, a list each, the new fields of each struct.
Judge = Callable[[str | None, list[list]], Iterable[tuple]]


def judged(df: DataFrame, array: str, text: str, wanted: list[str], new: StructType, judge: Judge) -> DataFrame:
    """``df`` without ``text``, with the fields of ``new`` put on (or in place of those of that name in) each struct of ``array``."""
    ship(df.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kind = df.schema[array].dataType.elementType
    names = [f.name for f in kind if f.name not in new.names] + new.names
    made = ArrayType(StructType([f for f in kind if f.name not in new.names] + list(new)))
    kept = [f for f in df.schema if f.name != text]
    schema = StructType([StructField(f.name, made) if f.name == array else f for f in kept])
    columns = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new]
        for batch in batches:
            lists = batch.column(array)
            each = lists.flatten()
            fields = dict(zip([f.name for f in each.type], each.flatten(), strict=True))
            values = [fields[k].to_pylist() for k in wanted]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            offsets, out = [0, *accumulate(sizes)], []
            for row, begin, end in zip(batch.column(text).to_pylist(), offsets, offsets[1:], strict=False):
                if end > begin:
                    out.extend(judge(row, [v[begin:end] for v in values]))
            for k, (name, t) in enumerate(zip(new.names, types, strict=True)):
                fields[name] = pa.array([x[k] for x in out], t)
            structs = pa.StructArray.from_arrays([fields[n] for n in names], names)
            mask = lists.is_null() if lists.null_count else None
            whole = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=mask)
            yield pa.RecordBatch.from_arrays([whole if c == array else batch.column(c) for c in columns], columns)

    return df.mapInArrow(run, schema)

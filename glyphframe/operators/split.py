"""Splitting text into pieces, words and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.functions import kernels
from glyphframe.functions.dialect import java_regex, literal_text, quote
from glyphframe.functions.patterns import Pattern, as_pattern, fixed, text, value
from glyphframe.operators.extract import padded
from glyphframe.operators.locate import coll_mark, coll_marked, coll_spans, invert_match, needs_kernel, python_pattern, segment_texts, str_locate_all

ANY = str | Column | Pattern
#: All line terminators of Unicode.
LINE_END = "\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]"


def _limit(n: int | float | None) -> int:
    if n is None or n == float("inf"):
        return -1
    if n != int(n) or n < 1:
        raise ValueError(f"`n` must be a number of 1 or more, not {n}.")
    return int(n)


def str_split(string, pattern: ANY, n: int | float | None = None, simplify: bool = False) -> Column:
    """Pieces between matches, at most ``n``; the last has the rest.  An array with one null for null.

    With ``simplify`` exactly ``n`` pieces, filled up with "".
    """
    s, p, limit = text(string), as_pattern(pattern), _limit(n)
    if p.kind == "bound":
        pieces = segment_texts(s, p)
        if limit > 0:
            before = F.slice(pieces, 1, limit - 1)
            rest = F.array_join(F.slice(pieces, limit, F.greatest(F.size(pieces), F.lit(1))), "")
            pieces = F.when(F.size(pieces) >= limit, F.concat(before, F.array(rest))).otherwise(pieces)
    elif p.static and not p.text:
        pieces = F.array(F.lit(None).cast("string"))
    elif p.kind == "coll":
        pieces = F.split(coll_marked(s, p), coll_mark(s, p), -1)
        if limit > 0:
            spans = F.slice(coll_spans(s, p), 1, limit - 1) if limit > 1 else F.array().cast("array<struct<start:int,end:int>>")
            gaps = invert_match(spans)
            pieces = F.transform(gaps, lambda g: s.substr(F.greatest(g["start"], F.lit(1)), F.when(g["end"] < 0, F.length(s)).otherwise(g["end"] - F.greatest(g["start"], F.lit(1)) + 1)))
    elif needs_kernel(p):
        body = python_pattern(p)
        pieces = kernels.mapped(kernels.STRINGS, lambda t: kernels.split(body, t, limit), s)
    else:
        pieces = F.split(s, value(java_regex(p)), limit)
    pieces = F.when(s.isNull(), F.array(F.lit(None).cast("string"))).otherwise(pieces)
    return padded(pieces, limit) if simplify else pieces


def str_split_1(df: DataFrame, string, pattern: ANY, name: str = "piece") -> DataFrame:
    """The pieces of a table's only text as rows, in order."""
    if df.limit(2).count() != 1:
        raise ValueError("`string` must be a single string.")
    return df.select(F.explode(str_split(string, pattern)).alias(name))


def str_split_fixed(string, pattern: ANY, n: int) -> Column:
    """Exactly ``n`` pieces, filled up with "" (null for null)."""
    s = text(string)
    return F.when(s.isNotNull(), str_split(s, pattern, n=n, simplify=True)).otherwise(F.array_repeat(F.lit(None).cast("string"), n))


def str_split_i(string, pattern: ANY, i: int) -> Column:
    """Piece ``i``, from the end if negative; null if there is none."""
    if i != int(i):
        raise ValueError(f"`i` must be a whole number, not {i}.")
    if i == 0:
        raise ValueError("`i` must not be 0.")
    pieces = str_split(string, pattern, n=i + 1 if i > 0 else None)
    return F.try_element_at(pieces, F.lit(int(i)))


def word(string, start: int | Column = 1, end: int | Column | None = None, sep: ANY | None = None) -> Column:
    """Words ``start`` to ``end`` with what is between them; negative numbers count from the end; null past the end."""
    s, p = text(string), as_pattern(fixed(" ") if sep is None else sep)
    literal = literal_text(p)
    if literal and isinstance(start, int) and start > 0 and end in (None, start):  # no more is split than is needed
        pieces = F.split(s, quote(literal), start + 1)
        return F.try_element_at(pieces, F.lit(start))
    if literal and len(literal) == 1 and isinstance(start, int) and start == -1 and end in (None, -1):
        return F.substring_index(s, literal, -1)
    first, last = value(start), value(start if end is None else end)
    pieces = F.split(s, quote(literal), -1) if literal else None
    gaps = None if literal else invert_match(str_locate_all(s, p))
    n = F.size(pieces) if literal else F.size(gaps)
    first = F.when(first < 0, first + n + 1).otherwise(first)
    last = F.when(last < 0, last + n + 1).otherwise(last)
    known = (first <= n) & (last <= n)
    first = F.greatest(first, F.lit(1))
    if literal:
        found = F.array_join(F.slice(pieces, first, F.greatest(last - first + 1, F.lit(0))), literal)
    else:
        a = F.greatest(F.get(gaps, first - 1)["start"], F.lit(1))
        b = F.get(gaps, last - 1)["end"]
        found = s.substr(a, F.greatest(F.when(b < 0, F.length(s)).otherwise(b) - a + 1, F.lit(0)))
    return F.when(s.isNotNull() & known, found)


def split_lines(string, drop_last: bool = False) -> Column:
    """Lines of a text by any Unicode terminator; ``drop_last`` leaves out an empty line at the end."""
    s = text(string)
    pieces = F.split(s, LINE_END, -1)
    if not drop_last:
        return pieces
    return F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1)))).otherwise(pieces)

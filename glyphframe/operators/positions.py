"""Substrings by position (1-based code points; negative from the end), and their replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphframe.functions.patterns import text, value


def _bounds(s: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """0-based start, and end, within the text."""
    n = F.length(s)
    first = F.when(start >= 0, F.greatest(start - 1, F.lit(0))).otherwise(F.greatest(n + start, F.lit(0)))
    last = F.when(end >= 0, F.least(end, n)).otherwise(n + end + 1)
    return F.least(first, n), last


def str_sub(string, start: int | Column = 1, end: int | Column = -1, length: int | Column | None = None) -> Column:
    """Code points ``start`` to ``end``, or ``length`` of them; "" if there are none; null for null."""
    s, a, b = text(string), value(start).cast("int"), value(end).cast("int")
    if length is not None:
        size = value(length).cast("int")
        last = a + size - 1
        b = F.when(size <= 0, F.lit(0)).when((a < 0) & (last >= 0), F.lit(-1)).otherwise(last)
        if_none = size <= 0
    else:
        if_none = F.lit(False)
    first, last = _bounds(s, a, b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((last > first) & ~if_none, s.substr(first + 1, last - first)).otherwise(F.when(s.isNotNull(), F.lit("")))


def str_sub_replace(string, start: int | Column, end: int | Column = -1, value_: str | Column | None = None, omit_na: bool = False) -> Column:
    """The text with ``start`` to ``end`` replaced; a range that ends before it starts is an insertion.

    Null if anything is null; with ``omit_na`` the text as it was.
    """
    s, a, b, new = text(string), value(start).cast("int"), value(end).cast("int"), value(value_).cast("string")
    first, last = _bounds(s, a, b)
    last = F.greatest(last, first)
    out = F.concat(s.substr(F.lit(1), first), new, s.substr(last + 1, F.length(s)))
    out = F.when(a.isNotNull() & b.isNotNull(), out)
    return F.coalesce(out, s) if omit_na else out


def str_sub_all(string, ranges: Column | list[tuple[int, int]]) -> Column:
    """Several ranges (start, end) of each text, as an array."""
    s = text(string)
    return F.transform(_ranges(ranges), lambda r: str_sub(s, r["start"], r["end"]))


def _ranges(ranges: Column | list[tuple[int, int]]) -> Column:
    if isinstance(ranges, Column):
        return ranges
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ranges])


def str_sub_replace_all(string, ranges: Column | list[tuple[int, int]], values: Column | list[str]) -> Column:
    """The text with sorted, disjoint ranges replaced; a range before the end of an earlier one is an error."""
    s, spans = text(string), _ranges(ranges)
    new = values if isinstance(values, Column) else F.array(*map(F.lit, values))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first, last = _bounds(s, x["r"]["start"], x["r"]["end"])
        first = F.when(first < acc["at"], F.raise_error(F.lit("ranges must be sorted and must not overlap")).cast("int")).otherwise(first)
        last = F.greatest(last, first)
        return F.struct(last.alias("at"), F.concat(acc["out"], s.substr(acc["at"] + 1, first - acc["at"]), x["v"]).alias("out"))

    pairs = F.zip_with(spans, new, lambda r, v: F.struct(r.alias("r"), v.alias("v")))
    return F.aggregate(pairs, zero, step, lambda acc: F.concat(acc["out"], s.substr(acc["at"] + 1, F.length(s))))


def str_trunc(string, width: int, side: str = "right", ellipsis: str = "...") -> Column:
    """At most ``width`` code points, with an ellipsis for what is left out."""
    if side not in ("right", "left", "center"):
        raise ValueError(f"`side` must be right, left or center, not {side!r}.")
    room = width - len(ellipsis)
    if room < 0:
        raise ValueError(f"`width` ({width}) is shorter than `ellipsis` ({len(ellipsis)}).")
    s, n = text(string), F.length(text(string))
    left = room if side == "right" else 0 if side == "left" else -(-room // 2)
    right = room - left
    short = F.concat(F.substring(s, 1, left), F.lit(ellipsis), s.substr(n - right + 1, F.lit(right)) if right else F.lit(""))
    return F.when(n > width, short).otherwise(s)


def str_reverse(string) -> Column:
    """Code points in reverse."""
    return F.reverse(text(string))

"""Length, display width, padding, white space and line filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions import kernels
from glyphframe.functions.patterns import text, value

#: ASCII and Latin letters with accents, which are one column each (controls none).
NARROW = r"^[\x00-\x7F\u00C0-\u024F]*\z"
SPACES = r"\p{IsWhite_Space}"
SIDES = ("left", "right", "both")


def _side(side: str) -> str:
    if side not in SIDES:
        raise ValueError(f"`side` must be one of {', '.join(SIDES)}, not {side!r}.")
    return side


def str_length(string) -> Column:
    """Code points."""
    return F.length(text(string))


def str_width(string) -> Column:
    """Columns in a terminal; ASCII and Latin letters never leave the JVM."""
    s = text(string)
    # a kernel gets null instead of text that has none but letters of one column
    narrow = F.rlike(s, F.lit(NARROW))
    wide = kernels.mapped(T.IntegerType(), kernels.width, F.when(~narrow, s))
    return F.when(narrow, F.length(F.regexp_replace(s, r"[\x00-\x1F\x7F]", ""))).otherwise(wide)


def str_pad(string, width: int | Column, side: str = "left", pad: str | Column = " ", use_width: bool = True) -> Column:
    """Filled up to at least ``width`` columns (code points unless ``use_width``); never cut."""
    s, side = text(string), _side(side)
    if isinstance(pad, str):
        size = kernels.width(pad) if use_width else len(pad)
        if size != 1:
            raise ValueError("`pad` must be one column wide." if use_width else "`pad` must be a single character.")
    have = str_width(s) if use_width else F.length(s)
    missing = F.greatest(value(width) - have, F.lit(0))
    left = missing if side == "left" else F.lit(0) if side == "right" else F.floor(missing / 2).cast("int")
    filler = value(pad)
    if isinstance(pad, Column):
        size = str_width(pad) if use_width else F.length(pad)
        filler = F.when(pad.isNull() | (size == 1), pad).otherwise(F.raise_error(F.lit("`pad` must be one column wide." if use_width else "`pad` must be a single character.")))
    return F.concat(F.call_function("repeat", filler, left.cast("int")), s, F.call_function("repeat", filler, (missing - left).cast("int")))


def str_trim(string, side: str = "both") -> Column:
    """Without Unicode white space at the ends."""
    left, right = f"^{SPACES}+", f"{SPACES}+\\z"
    pattern = {"left": left, "right": right, "both": f"{left}|{right}"}[_side(side)]
    return F.regexp_replace(text(string), pattern, "")


def str_squish(string) -> Column:
    """Without white space at the ends; runs of it within are one space."""
    return str_trim(F.regexp_replace(text(string), f"{SPACES}+", " "))


def str_wrap(string, width: int = 80, indent: int = 0, exdent: int = 0, whitespace_only: bool = True) -> Column:
    """Words in lines of at most ``width`` columns, as even as they can be."""
    for name, x in (("width", width), ("indent", indent), ("exdent", exdent)):
        if x != int(x):
            raise ValueError(f"`{name}` must be a whole number, not {x}.")
    w, a, b = max(1, int(width)), int(indent), int(exdent)
    return kernels.mapped(T.StringType(), lambda t: kernels.fill(t, w, a, b, whitespace_only), text(string))


def str_dup(string, times: int | Column, sep: str | None = None) -> Column:
    """The text ``times`` times, with ``sep`` between; "" for 0, null for a negative or missing number."""
    if sep is not None and not isinstance(sep, str):
        raise TypeError("`sep` must be a single string.")
    s, n = text(string), value(times).cast("int")
    out = F.array_join(F.array_repeat(s, n), sep) if sep else F.call_function("repeat", s, n)
    return F.when(s.isNotNull() & (n >= 0), out)

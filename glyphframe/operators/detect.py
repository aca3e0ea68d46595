"""Predicates over text, and the filters built on them."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.functions.dialect import java_regex, literal_text
from glyphframe.functions.patterns import Pattern, collation_of, plain, searchable, text, value
from glyphframe.functions.storage import columns, with_position

ANY = str | Column | Pattern


_NATIVE = {"any": F.contains, "start": F.startswith, "end": F.endswith}
_ANCHORED = {"any": ("", ""), "start": ("\\A(?:", ")"), "end": ("(?:", ")\\z")}
_WRAPPED = {"any": ("", ""), "start": ("^(", ")"), "end": ("(", ")$")}


def _around(body: str | Column, ends: tuple[str, str]) -> str | Column:
    return ends[0] + body + ends[1] if isinstance(body, str) else F.concat(F.lit(ends[0]), body, F.lit(ends[1]))


def _found(s: Column, p: Pattern, where: str) -> Column:
    """``where``: any, start or end."""
    if p.kind == "coll":
        name = collation_of(p)
        return _nonempty(p, _NATIVE[where](F.collate(s, name), F.collate(value(p.text), name)))
    exact = literal_text(p)
    if exact is not None and (p.kind == "fixed" or where != "end"):
        return _nonempty(p, _NATIVE[where](s, F.lit(exact)))  # reaches the scan; a regular expression does not
    if p.kind == "fixed":
        if not p.static and not p.get("ignore_case"):
            return _nonempty(p, _NATIVE[where](s, p.text))
        return _nonempty(p, F.rlike(s, value(_around(java_regex(p), _ANCHORED[where]))))
    return F.rlike(s, value(java_regex(p.with_text(_around(p.text, _WRAPPED[where])))))


def _nonempty(p: Pattern, result: Column) -> Column:
    """Empty fixed or collated patterns give null."""
    if p.static:
        return result if p.text else F.lit(None).cast("boolean")
    return F.when(p.text != "", result)


def _negated(result: Column, negate: bool) -> Column:
    return ~result if negate else result


def str_detect(string, pattern: ANY, negate: bool = False) -> Column:
    """Whether the pattern occurs; null for null."""
    return _negated(_found(text(string), searchable(pattern), "any"), negate)


def str_starts(string, pattern: ANY, negate: bool = False) -> Column:
    """Whether the text starts with the pattern."""
    return _negated(_found(text(string), searchable(pattern), "start"), negate)


def str_ends(string, pattern: ANY, negate: bool = False) -> Column:
    """Whether the text ends with the pattern; a regular expression may stand before a last newline."""
    return _negated(_found(text(string), searchable(pattern), "end"), negate)


#: Fixed patterns: a wildcard that neither a backslash nor a bracket protects.
ANY_TEXT, ANY_CHARACTER = r"(?<!\\|\[)%(?!\])", r"(?<!\\|\[)_(?!\])"


def like_to_regex(pattern: str) -> str:
    """``%`` and ``_`` as wildcards unless escaped by a backslash or in brackets; all else stays a regular expression."""
    return "^" + re.sub(ANY_CHARACTER, ".", re.sub(ANY_TEXT, ".*", pattern)) + "$"


def _like(string, pattern, flags: str) -> Column:
    p = plain(pattern)
    if isinstance(p, str):
        return F.rlike(text(string), F.lit(flags + like_to_regex(p)))
    body = F.regexp_replace(F.regexp_replace(p, ANY_TEXT, ".*"), ANY_CHARACTER, ".")
    return F.rlike(text(string), F.concat(F.lit(flags + "^"), body, F.lit("$")))


def str_like(string, pattern: str | Column, ignore_case: bool | None = None) -> Column:
    """SQL-like wildcards; other metacharacters keep their meaning as a regular expression."""
    if ignore_case is not None:
        warnings.warn("`ignore_case` of str_like() is deprecated; use str_ilike()", DeprecationWarning, stacklevel=2)
    return _like(string, pattern, "(?iu)" if ignore_case else "")


def str_ilike(string, pattern: str | Column) -> Column:
    """``str_like`` without regard to case."""
    return _like(string, pattern, "(?iu)")


def str_equal(x, y, locale: str = "en", ignore_case: bool = False, **options) -> Column:
    """Equality under a collation, canonical equivalence included; can be a join key."""
    from glyphframe.operators.ordering import equality_key

    own = lambda v: equality_key(v, locale, ignore_case, **options)
    return own(text(x)) == own(y if isinstance(y, Column) else F.lit(y))


def str_subset(df: DataFrame, string, pattern: ANY, negate: bool = False) -> DataFrame:
    """Rows whose text matches; null never does."""
    return df.where(F.coalesce(str_detect(string, pattern, negate), F.lit(False)))


def str_which(df: DataFrame, string, pattern: ANY, order_by, negate: bool = False, index: str = "index") -> DataFrame:
    """1-based positions (in the order of ``order_by``) of the rows whose text matches."""
    hit = F.coalesce(str_detect(text(string), pattern, negate), F.lit(False))
    keys = columns(order_by)
    # nothing but the keys and the answer is shuffled
    narrow = df.select(*[k.alias(f"__o{i}") for i, k in enumerate(keys)], hit.alias("__hit"))
    return with_position(narrow, [f"__o{i}" for i in range(len(keys))], index).where("__hit").select(index)


__all__ = ["like_to_regex", "str_detect", "str_ends", "str_equal", "str_ilike", "str_like", "str_starts", "str_subset", "str_which"]

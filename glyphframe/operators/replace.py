"""Replacing and removing matches."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions import kernels
from glyphframe.functions.dialect import facts, fix_replacement, fix_replacement_column, flags, java_regex, shift_groups, shift_replacement, to_java
from glyphframe.functions.patterns import Pattern, as_pattern, searchable, text, value
from glyphframe.operators.locate import MARK, coll_first, coll_length, coll_spans, invert_match, needs_kernel, python_pattern

ANY = str | Column | Pattern


class per_batch:  # noqa: N801
    """Marks a replacement function that takes and returns a pandas Series of matches."""

    def __init__(self, fn: Callable[[pd.Series], pd.Series]):
        self.fn = fn


def _checked(replacement) -> None:
    if replacement is not None and not isinstance(replacement, (str, Column, per_batch)) and not callable(replacement):
        raise TypeError("`replacement` must be a string, a Column or a function.")


def _java_replacement(p: Pattern, replacement: str | Column, by: int = 0) -> Column:
    if isinstance(replacement, Column):
        return fix_replacement_column(replacement)
    fixed = fix_replacement(replacement)
    limit = facts(p).groups if p.static else 9
    used = [int(d) for d in _references(fixed)]
    if used and max(used) > limit:
        raise ValueError(f"`replacement` refers to group {max(used)}; the pattern has {limit}.")
    return F.lit(shift_replacement(fixed, by) if by else fixed)


def _references(fixed: str) -> list[str]:
    out, i = [], 0
    while i < len(fixed) - 1:
        if fixed[i] == "\\":
            i += 2
            continue
        if fixed[i] == "$":
            out.append(fixed[i + 1])
        i += 1
    return out


def _parts(fixed: str) -> list[str | int]:
    """Text and group numbers of a fixed replacement."""
    out: list[str | int] = []
    i = 0
    while i < len(fixed):
        if fixed[i] == "$":
            out.append(int(fixed[i + 1]))
            i += 2
            continue
        i += fixed[i] == "\\"
        out.append(fixed[i : i + 1])
        i += 1
    return out


def _null_if_matched(s: Column, p: Pattern) -> Column:
    from glyphframe.operators.detect import str_detect

    return F.when(str_detect(s, p), F.lit(None)).otherwise(s).cast("string")


def _with_nulls(s: Column, p: Pattern, replacement, result: Column) -> Column:
    """A null replacement makes a row null only if the pattern matches."""
    if not isinstance(replacement, Column):
        return result
    return F.when(replacement.isNull(), _null_if_matched(s, p)).otherwise(result)


def _first_regex(p: Pattern) -> Column:
    """A pattern from the text's start to the end of the first match: group 1 is what goes before, group 2 the match."""
    if p.static and not p.get("literal"):
        java = to_java(p.text)
        return F.lit(flags(p, java) + r"\A((?s:.*?))(" + shift_groups(java, 2) + ")")
    return F.concat(F.lit(r"\A((?s:.*?))("), value(java_regex(p)), F.lit(")"))


def _first_replacement(p: Pattern, replacement: str | Column) -> Column:
    """A replacement for ``_first_regex``: group references move up by two."""
    if isinstance(replacement, str):
        return F.concat(F.lit("$1"), _java_replacement(p, replacement, 2))
    moved = F.regexp_replace(fix_replacement_column(replacement), r"(?<!\\)\$(\d)", MARK + "$1")
    for d in range(10):
        moved = F.replace(moved, F.lit(f"{MARK}{d}"), F.lit(f"${d + 2}"))
    return F.concat(F.lit("$1"), moved)


def str_replace(string, pattern: ANY, replacement) -> Column:
    r"""Replace the first match; ``\1`` to ``\9`` and ``\0`` refer to groups."""
    _checked(replacement)
    s, p = text(string), searchable(pattern)
    if callable(replacement) or isinstance(replacement, per_batch):
        return _by_function(s, p, replacement, every=False)
    if p.static and not p.text:
        return F.lit(None).cast("string")
    if replacement is None:
        return _null_if_matched(s, p)
    r = value(replacement)
    if p.kind == "regex":
        return _with_nulls(s, p, replacement, F.regexp_replace(s, _first_regex(p), _first_replacement(p, replacement)))
    if p.kind == "coll":
        at = coll_first(s, p)
        size = coll_length(s, p, at)
    elif p.get("ignore_case"):
        java = value(java_regex(p))
        at = F.when(F.rlike(s, java), F.length(F.get(F.split(s, java, 2), F.lit(0))) + 1).otherwise(0)
        size = F.length(value(p.text))
    else:
        at, size = F.call_function("locate", value(p.text), s, F.lit(1)), F.length(value(p.text))
    new = F.concat(s.substr(F.lit(1), at - 1), r, s.substr(at + size, F.length(s)))
    result = F.when(at > 0, new).otherwise(s)
    return _with_nulls(s, p, replacement, result)


def str_replace_all(string, pattern: ANY | Mapping, replacement=None) -> Column:
    """Replace all matches.  A mapping of patterns to replacements is applied one after the other."""
    if isinstance(pattern, Mapping):
        return reduce(lambda s, pair: str_replace_all(s, pair[0], pair[1]), pattern.items(), text(string))
    _checked(replacement)
    s, p = text(string), searchable(pattern)
    if callable(replacement) or isinstance(replacement, per_batch):
        return _by_function(s, p, replacement, every=True)
    if p.static and not p.text:
        return F.lit(None).cast("string")
    if replacement is None:
        return _null_if_matched(s, p)
    r = value(replacement)
    if p.kind == "coll":
        from glyphframe.functions.patterns import collation_of

        name = collation_of(p)
        result = F.collate(F.replace(F.collate(s, name), F.collate(value(p.text), name), F.collate(r, name)), "UTF8_BINARY")
    elif p.kind == "fixed" and not p.get("ignore_case"):
        result = F.replace(s, value(p.text), r)
    elif p.kind == "fixed":
        literal = F.regexp_replace(r, r"([\\$])", "\\\\$1")
        result = F.regexp_replace(s, value(java_regex(p)), literal)
    elif needs_kernel(p) and isinstance(replacement, str):
        _java_replacement(p, replacement)  # checks its groups
        body, parts = python_pattern(p), _parts(fix_replacement(replacement))
        result = kernels.mapped(T.StringType(), lambda t: kernels.substituted(body, t, parts, True), s)
    else:
        result = F.regexp_replace(s, value(java_regex(p)), _java_replacement(p, replacement))
    return _with_nulls(s, p, replacement, result)


def _by_function(s: Column, p: Pattern, replacement, every: bool) -> Column:
    if isinstance(replacement, per_batch):
        if p.kind == "coll" or not p.static:
            raise NotImplementedError("per_batch() needs a regular expression or fixed text given as a string; a function of a Column takes any pattern.")
        body, fn = python_pattern(p), replacement.fn

        @F.pandas_udf(T.StringType())
        def run(texts: pd.Series) -> pd.Series:
            return kernels.replace_batch(texts, body, fn, every)

        return run(s)
    if needs_kernel(p):
        body = python_pattern(p)

        def pieces(t: str) -> list[list[str]]:
            found = kernels.spans(body, t)[: None if every else 1]
            ends = [0, *(b for _, b in found)]
            return [[t[a:b] for a, b in zip(ends, [*(a for a, _ in found), len(t)])], [t[a:b] for a, b in found]]

        found = kernels.mapped(T.ArrayType(kernels.STRINGS), pieces, s)
        gaps, hits = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    elif p.kind == "coll":
        spans = coll_spans(s, p) if every else F.slice(coll_spans(s, p), 1, 1)
        hits = F.transform(spans, lambda x: s.substr(x["start"], x["end"] - x["start"] + 1))
        begin = lambda g: F.greatest(g["start"], F.lit(1))
        gaps = F.transform(invert_match(spans), lambda g: s.substr(begin(g), F.when(g["end"] < 0, F.length(s)).otherwise(g["end"]) - begin(g) + 1))
    else:
        java = value(java_regex(p))
        gaps = F.split(s, java, -1 if every else 2)
        hits = F.regexp_extract_all(s, java, F.lit(0))
        hits = hits if every else F.slice(hits, 1, 1)
    parts = F.zip_with(gaps, F.transform(hits, replacement), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(s.isNotNull(), F.array_join(parts, ""))


def str_remove(string, pattern: ANY) -> Column:
    return str_replace(string, pattern, "")


def str_remove_all(string, pattern: ANY) -> Column:
    return str_replace_all(string, pattern, "")


def str_replace_na(string, replacement: str = "NA") -> Column:
    if not isinstance(replacement, str):
        raise TypeError("`replacement` must be a single string.")
    return F.coalesce(text(string), F.lit(replacement))


def replace_charclass(string, charclass: str, replacement: str, merge: bool = False) -> Column:
    """Replace the code points of a set such as ``[a-f]`` or ``\\p{Lu}``; ``merge`` makes runs one."""
    java = to_java(charclass)
    return F.regexp_replace(text(string), java + ("+" if merge else ""), F.regexp_replace(F.lit(replacement), r"([\\$])", "\\\\$1"))


__all__ = ["as_pattern", "per_batch", "replace_charclass", "str_remove", "str_remove_all", "str_replace", "str_replace_all", "str_replace_na"]

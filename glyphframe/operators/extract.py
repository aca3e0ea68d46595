"""Extracting matches and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions import kernels
from glyphframe.functions.dialect import facts, java_regex
from glyphframe.functions.patterns import Pattern, as_pattern, text, value
from glyphframe.operators.locate import coll_first, coll_length, coll_spans, is_characters, needs_kernel, python_pattern, segment_texts, str_count

ANY = str | Column | Pattern


def str_extract(string, pattern: ANY, group: int | str | None = None) -> Column:
    """The first match, or one of its groups; null if there is none."""
    if group is not None:
        found = str_match(string, pattern)
        return found[group if isinstance(group, str) else _field_names(as_pattern(pattern))[group]]
    s, p = text(string), as_pattern(pattern)
    if p.kind == "bound":
        return F.when(F.length(s) > 0, F.regexp_extract(s, r"(?s)\X", 0)) if is_characters(p) else F.get(segment_texts(s, p), F.lit(0))
    if p.static and not p.text:
        return F.lit(None).cast("string")
    if p.kind == "coll":
        at = coll_first(s, p)
        return F.when(at > 0, s.substr(at, coll_length(s, p, at)))
    if p.kind == "fixed" and not p.get("ignore_case"):
        return F.when(F.contains(s, value(p.text)) & (F.length(value(p.text)) > 0), value(p.text))
    java = java_regex(p)
    if isinstance(java, str):
        return F.when(F.rlike(s, F.lit(java)), F.regexp_extract(s, java, 0))
    return F.when(F.rlike(s, java), F.coalesce(F.regexp_substr(s, java), F.lit("")))


def str_extract_all(string, pattern: ANY, simplify: bool = False, width: int | None = None) -> Column:
    """All matches; an array with one null for null.  ``simplify`` pads with "" to ``width``."""
    s, p = text(string), as_pattern(pattern)
    if p.kind == "bound":
        found = segment_texts(s, p)
    elif p.static and not p.text:
        found = F.array(F.lit(None).cast("string"))
    elif p.kind == "coll":
        found = F.transform(coll_spans(s, p), lambda x: s.substr(x["start"], x["end"] - x["start"] + 1))
    elif p.kind == "fixed" and not p.get("ignore_case"):
        found = F.array_repeat(value(p.text), str_count(s, p))
    elif needs_kernel(p):
        body = python_pattern(p)
        found = kernels.mapped(kernels.STRINGS, lambda t: [t[a:b] for a, b in kernels.spans(body, t)], s)
    else:
        found = F.regexp_extract_all(s, value(java_regex(p)), F.lit(0))
    found = F.when(s.isNull(), F.array(F.lit(None).cast("string"))).otherwise(found)
    return padded(found, width) if simplify else found


def padded(pieces: Column, width: int | None) -> Column:
    """Exactly ``width`` elements, filled up with ""."""
    if width is None:
        raise ValueError("`simplify` needs a `width`; `simplify()` finds it for a whole table.")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i < F.size(pieces), F.get(pieces, i)).otherwise(F.lit("")))


def simplify(df: DataFrame, pieces: Column, prefix: str = "v") -> DataFrame:
    """``df`` with the elements of an array as columns, as many as the longest has, filled up with ""."""
    width = df.agg(F.max(F.size(pieces))).first()[0] or 0
    return df.select("*", *[F.when(F.size(pieces) > i, F.get(pieces, F.lit(i))).otherwise(F.lit("")).alias(f"{prefix}{i + 1}") for i in range(width)])


def _regex_only(pattern: ANY) -> Pattern:
    p = as_pattern(pattern)
    if p.kind != "regex" or not p.static:
        raise TypeError("`pattern` must be a regular expression given as a string.")
    return p


def _field_names(p: Pattern) -> list[str]:
    return ["match", *(name or f"g{i}" for i, name in enumerate(facts(p).names, 1))]


def str_match(string, pattern: ANY) -> Column:
    """The first match and its groups, a struct (match, g1 or the group's name, ...); null in all if there is none."""
    s, p = text(string), _regex_only(pattern)
    names, f = _field_names(p), facts(p)
    if f.optional:
        first = F.get(_kernel_groups(s, p, every=False), F.lit(0))
        return F.struct(*[F.get(first, F.lit(i)).alias(n) for i, n in enumerate(names)])
    java = java_regex(p)
    hit = F.rlike(s, F.lit(java))
    return F.struct(*[F.when(hit, F.regexp_extract(s, java, i)).alias(n) for i, n in enumerate(names)])


def str_match_all(string, pattern: ANY) -> Column:
    """All matches with their groups, an array of structs; one struct of nulls for null."""
    s, p = text(string), _regex_only(pattern)
    names, f = _field_names(p), facts(p)
    if f.optional or needs_kernel(p):
        found = F.transform(_kernel_groups(s, p, every=True), lambda m: F.struct(*[F.get(m, F.lit(i)).alias(n) for i, n in enumerate(names)]))
    else:
        java = F.lit(java_regex(p))
        columns = [F.regexp_extract_all(s, java, F.lit(i)).alias(n) for i, n in enumerate(names)]
        found = F.arrays_zip(*columns)
        found = F.transform(found, lambda m: F.struct(*[m[n].alias(n) for n in names]))
    missing = F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in names]))
    return F.when(s.isNull(), missing).otherwise(found)


def _kernel_groups(s: Column, p: Pattern, every: bool) -> Column:
    body = python_pattern(p)
    return kernels.mapped(T.ArrayType(kernels.STRINGS), lambda t: kernels.groups(body, t, every), s)

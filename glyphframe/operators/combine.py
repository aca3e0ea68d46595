"""Joining texts, in a row and over rows, and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphframe.functions.patterns import text, value
from glyphframe.functions.storage import columns


def str_c(*strings, sep: str = "", ignore_null: bool = False) -> Column:
    """Texts of a row joined by ``sep``; null if one is null (or without nulls, with ``ignore_null``).

    ``None`` as an argument is left out.  Strings are literals here, Columns are columns.
    """
    if not isinstance(sep, str):
        raise TypeError("`sep` must be a single string.")
    parts = [value(x).cast("string") for x in strings if x is not None]
    if not parts:
        return F.lit("")
    if ignore_null:
        return F.concat_ws(sep, *parts)
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit(sep), p] if sep else [p]
    return F.concat(*out)


def str_flatten(string, collapse: str = "", last: str | None = None, na_rm: bool = False, order_by=None, na_empty: bool = False, omit_empty: bool = False) -> Column:
    """An aggregate: all texts of a group joined in the order of ``order_by``.

    Null if one is null, unless ``na_rm`` leaves nulls out or ``na_empty`` takes them as "".
    ``last`` replaces the last separator.  "" for no texts.
    """
    if not isinstance(collapse, str) or not (last is None or isinstance(last, str)):
        raise TypeError("`collapse` and `last` must be single strings.")
    if order_by is None:
        raise ValueError("rows have no order of their own; `order_by` is needed.")
    s = text(string)
    s = F.coalesce(s, F.lit("")) if na_empty else s
    kept = F.when(s != "", s) if omit_empty else s
    keys = [k.alias(f"k{i}") for i, k in enumerate(columns(order_by))]
    rows = F.array_sort(F.collect_list(F.when(kept.isNotNull(), F.struct(*keys, kept.alias("s")))))
    texts = F.transform(rows, lambda x: x["s"])
    joined = F.array_join(texts, collapse)
    if last is not None:
        n = F.size(texts)
        joined = F.when(n >= 2, F.concat(F.array_join(F.slice(texts, 1, n - 1), collapse), F.lit(last), F.element_at(texts, -1))).otherwise(joined)
    return joined if na_rm or na_empty else F.when(F.count(F.lit(1)) > F.count(s), F.lit(None)).otherwise(joined)


def str_flatten_comma(string, last: str | None = None, na_rm: bool = False, order_by=None) -> Column:
    """``str_flatten`` with ", "; a comma at the front of ``last`` is left out between just two."""
    whole = str_flatten(string, ", ", last, na_rm, order_by)
    if not last or not re.match(r",", last):
        return whole
    two = str_flatten(string, ", ", last[1:], na_rm, order_by)
    return F.when(F.count(text(string)) == 2, two).otherwise(whole)


def _pieces(template: str) -> list[tuple[str, str]]:
    """("text", ...) and ("expr", ...) of a ``{expression}`` template; doubled braces are braces."""
    out, i, start = [], 0, 0
    literal = ""
    while i < len(template):
        if template[i : i + 2] in ("{{", "}}"):
            literal += template[i]
            i += 2
        elif template[i] == "{":
            depth, start = 1, i + 1
            i += 1
            while i < len(template) and depth:
                depth += {"{": 1, "}": -1}.get(template[i], 0)
                i += 1
            if depth:
                raise ValueError("`template` has an expression without its closing brace.")
            out += [("text", literal), ("expr", template[start : i - 1])]
            literal = ""
        else:
            literal += template[i]
            i += 1
    return [p for p in [*out, ("text", literal)] if p[1]]


def trimmed(template: str) -> str:
    """Without a first and last empty line and without the indentation that all further lines share."""
    lines = template.split("\n")
    if len(lines) > 1:
        if not lines[0].strip():
            lines = lines[1:]
            skip = 0
        else:
            skip = 1
        if lines and not lines[-1].strip():
            lines = lines[:-1]
        own = [len(x) - len(x.lstrip(" \t")) for x in lines[skip:] if x.strip()]
        cut = min(own, default=0)
        lines = lines[:skip] + [x[cut:] for x in lines[skip:]]
    return "\n".join(lines)


def str_glue(*templates: str, sep: str = "", na: str | None = "NA", trim: bool = True, **values) -> Column:
    """Text with ``{expression}``s of Spark SQL; names of ``values`` stand for these (Columns or literals).

    A null value becomes ``na``, or makes the whole null if ``na`` is None.
    """
    parts = []
    template = sep.join(templates)
    for kind, body in _pieces(trimmed(template) if trim else template):
        if kind == "text":
            parts.append(F.lit(body))
        else:
            name = body.strip()
            x = (value(values[name]) if name in values else F.expr(name)).cast("string")
            parts.append(x if na is None else F.coalesce(x, F.lit(na)))
    return F.concat(*parts) if parts else F.lit("")


#: On a DataFrame's columns; the same, since expressions name columns.
str_glue_data = str_glue

_PLACEHOLDER = re.compile(r"\$(?:\[(.*?)\])?\{")


def str_interp(template: str | list[str], **values) -> Column:
    """Text with ``${expression}`` and ``$[format]{expression}``, expressions of Spark SQL, formats as in ``printf``."""
    if isinstance(template, (list, tuple)):
        template = "".join(template)
    if not isinstance(template, str):
        raise TypeError("`template` must be a string.")
    starts = list(_PLACEHOLDER.finditer(template))
    parts, at = [], 0
    for i, m in enumerate(starts):
        until = starts[i + 1].start() if i + 1 < len(starts) else len(template)
        depth, end = 0, None
        for j in range(m.end() - 1, until):
            depth += {"{": 1, "}": -1}.get(template[j], 0)
            if depth == 0:
                end = j
                break
        if end is None or end == m.end():
            raise ValueError("Invalid template string for interpolation.")
        body = template[m.end() : end].strip()
        parts.append(F.lit(template[at : m.start()]))
        x = value(values[body]) if body in values else F.expr(body.replace("{", "(").replace("}", ")"))
        parts.append(F.format_string("%" + m[1], x) if m[1] else x.cast("string"))
        at = end + 1
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)

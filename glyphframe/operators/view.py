"""Showing texts with their matches and unusual white space."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.functions.patterns import Pattern, as_pattern, text
from glyphframe.functions.storage import with_position
from glyphframe.operators.detect import str_detect
from glyphframe.operators.encoding import escape_unicode
from glyphframe.operators.extract import str_extract_all
from glyphframe.operators.locate import segment_texts
from glyphframe.operators.replace import str_replace_all

ODD_SPACE = r"[\p{IsWhite_Space}&&[^ \n]]+"


def highlighted(string, pattern: str | Column | Pattern | None = None, use_escapes: bool = False, html: bool = False) -> Column:
    """Text with ``<...>`` around matches and ``{...}`` around white space other than spaces and newlines."""
    s = text(string)
    before, after = ("<span class='match'>", "</span>") if html else ("<", ">")
    if pattern is not None:
        p = as_pattern(pattern)
        if p.kind == "bound":
            s = F.array_join(F.transform(segment_texts(s, p), lambda x: F.concat(F.lit(before), x, F.lit(after))), "")
        elif p.kind == "coll":
            # the matched text, not the pattern, is shown; each distinct form is replaced once
            forms = F.array_distinct(str_extract_all(s, p))
            s = F.aggregate(forms, s, lambda acc, x: F.replace(acc, x, F.concat(F.lit(before), x, F.lit(after))))
        else:
            s = str_replace_all(s, p, lambda m: F.concat(F.lit(before), m, F.lit(after)))
    if use_escapes:
        return F.replace(escape_unicode(s), F.lit("\\u001b"), F.lit("\u001b"))
    wrap = ("<span class='special'>", "</span>") if html else ("{", "}")
    mark = (lambda m: F.concat(F.lit(wrap[0]), m, F.lit(wrap[1]))) if html else (lambda m: F.concat(F.lit("{"), escape_unicode(m), F.lit("}")))
    return str_replace_all(s, ODD_SPACE, mark)


class View:
    """Selected rows as a lazy table (id, text); printing shows the first ``n``."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def lines(self, n: int = 20) -> list[str]:
        shown = self.rows.orderBy("id").limit(n).collect()
        if not shown:
            return ["x Empty `string` provided."]
        width = max(len(f"[{r['id']}]") for r in shown)
        out = []
        for r in shown:
            body = "NA" if r["text"] is None else r["text"]
            out += f"{f'[{r["id"]}]':>{width}} | {body}".replace("\n", f"\n{' ' * width} | ").split("\n")
        more = self.rows.count() - len(shown)
        return [*out, f"... and {more} more"] if more > 0 else out

    def html(self, n: int = 20) -> str:
        items = [f"  <li><pre>{'NA' if r['text'] is None else r['text']}</pre></li>" for r in self.rows.orderBy("id").limit(n).collect()]
        return "<ul>\n" + "\n".join(items) + "\n</ul>"

    def __str__(self) -> str:
        return "\n".join(self.lines())


def str_view(df: DataFrame, string, pattern: str | Column | Pattern | None = None, order_by=None, match: bool | None = True, html: bool = False, use_escapes: bool = False) -> View:
    """Rows that match (all with ``match=None``, the others with ``match=False``), with matches marked."""
    if order_by is None:
        raise ValueError("rows have no order of their own; `order_by` is needed.")
    s = text(string)
    placed = with_position(df.withColumn("__s", s), order_by, "id")
    if pattern is not None and match is not None and as_pattern(pattern).kind != "bound":
        hit = F.coalesce(str_detect(F.col("__s"), pattern), F.lit(False))
        placed = placed.where(hit if match else ~hit)
    return View(placed.select("id", highlighted(F.col("__s"), pattern, use_escapes, html).alias("text")))


def str_view_all(df: DataFrame, string, pattern=None, order_by=None, match: bool | None = None, **options) -> View:
    """Deprecated: ``str_view`` that shows all rows."""
    warnings.warn("str_view_all() is deprecated; use str_view()", DeprecationWarning, stacklevel=2)
    return str_view(df, string, pattern, order_by, match, **options)



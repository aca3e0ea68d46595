"""Patterns: regular expressions, fixed text, collated text and text boundaries.

A pattern is plan-time configuration.  Its text is a Python string (one pattern for all rows) or a
Column (one pattern a row); everything else is an option.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

REGEX_OPTIONS = {"literal", "unix_lines"}
#: Options of the regular-expression engine that Java's engine has no equivalent of.
REGEX_UNSUPPORTED = {"uword", "error_on_unknown_escapes", "time_limit", "stack_limit"}
COLL_OPTIONS = {"strength", "numeric", "uppercase_first", "alternate_shifted", "case_level", "french", "normalization"}
BOUNDARY_TYPES = ("character", "line_break", "sentence", "word")
BOUNDARY_OPTIONS = {
    "locale", "skip_word_none", "skip_word_number", "skip_word_letter", "skip_word_kana", "skip_word_ideo",
    "skip_line_soft", "skip_line_hard", "skip_sentence_term", "skip_sentence_sep",
}


@dataclass(frozen=True, eq=False)
class Pattern:
    kind: str  # "regex", "fixed", "coll" or "bound"
    text: str | Column | None
    options: dict[str, Any] = field(default_factory=dict)

    def get(self, name: str, default: Any = None) -> Any:
        return self.options.get(name, default)

    def with_text(self, text: str | Column) -> Pattern:
        """The same kind and options for another text."""
        return replace(self, text=text)

    @property
    def static(self) -> bool:
        return isinstance(self.text, str)


def _checked(text: Any, what: str = "pattern") -> str | Column:
    if isinstance(text, (str, Column)):
        return text
    if text is None:
        raise ValueError(f"`{what}` can't be missing.")
    raise TypeError(f"`{what}` must be a string or a Column, not {type(text).__name__}.")


def regex(pattern: str | Column, ignore_case: bool = False, multiline: bool = False, comments: bool = False, dotall: bool = False, **options: Any) -> Pattern:
    """A regular expression."""
    for name in options:
        if name in REGEX_UNSUPPORTED and options[name]:
            raise NotImplementedError(f"regex option `{name}` is not supported.")
        if name not in REGEX_OPTIONS | REGEX_UNSUPPORTED:
            warnings.warn(f"unknown regex option `{name}` is ignored", stacklevel=2)
    own = {"ignore_case": ignore_case, "multiline": multiline, "comments": comments, "dotall": dotall}
    return Pattern("regex", _checked(pattern), own | {k: v for k, v in options.items() if k in REGEX_OPTIONS})


def fixed(pattern: str | Column, ignore_case: bool = False, overlap: bool = False) -> Pattern:
    """Text that is compared byte by byte (by simple upper-case mapping with ``ignore_case``)."""
    return Pattern("fixed", _checked(pattern), {"ignore_case": ignore_case, "overlap": overlap})


def coll(pattern: str | Column, ignore_case: bool = False, locale: str = "en", **options: Any) -> Pattern:
    """Text that is compared by the rules of a locale."""
    for name in options:
        if name not in COLL_OPTIONS:
            warnings.warn(f"unknown collator option `{name}` is ignored", stacklevel=2)
    options.setdefault("strength", 2 if ignore_case else 3)
    return Pattern("coll", _checked(pattern), {"ignore_case": ignore_case, "locale": locale} | options)


def boundary(type: str = "character", skip_word_none: bool | None = None, **options: Any) -> Pattern:  # noqa: A002
    """Boundaries between characters, words, sentences or possible line breaks."""
    if type not in BOUNDARY_TYPES:
        raise ValueError(f"`type` must be one of {', '.join(BOUNDARY_TYPES)}, not {type!r}.")
    for name in options:
        if name not in BOUNDARY_OPTIONS:
            warnings.warn(f"unknown boundary option `{name}` is ignored", stacklevel=2)
    return Pattern("bound", None, {"type": type, "skip_word_none": type == "word" if skip_word_none is None else skip_word_none} | options)


def as_pattern(pattern: str | Column | Pattern) -> Pattern:
    """Plain text is a regular expression; the empty text stands for character boundaries."""
    if isinstance(pattern, Pattern):
        return pattern
    text = _checked(pattern)
    return boundary("character") if isinstance(text, str) and text == "" else regex(text)


def type_of(pattern: str | Column | Pattern) -> str:
    """The dispatch tag: empty, bound, fixed, coll or regex."""
    return "empty" if isinstance(pattern, str) and pattern == "" else as_pattern(pattern).kind


def opts(pattern: str | Column | Pattern) -> dict[str, Any]:
    return dict(as_pattern(pattern).options)


def searchable(pattern: str | Column | Pattern) -> Pattern:
    """A pattern for verbs that take neither the empty text nor boundaries."""
    if isinstance(pattern, str) and pattern == "":
        raise ValueError('`pattern` can\'t be the empty string (`""`).')
    p = as_pattern(pattern)
    if p.kind == "bound":
        raise ValueError("`pattern` can't be a boundary.")
    return p


def plain(pattern: Any) -> str | Column:
    """A pattern for verbs that take no modifiers."""
    if isinstance(pattern, Pattern):
        raise TypeError("`pattern` must be a plain string, not a pattern object.")
    return _checked(pattern)


def text(column: Any) -> Column:
    """A column, or a column's name, as text."""
    c = F.col(column) if isinstance(column, str) else column
    if not isinstance(c, Column):
        raise TypeError(f"`string` must be a Column or a column's name, not {type(column).__name__}.")
    return c.cast("string")


def value(x: Any) -> Column:
    """A Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def collation(locale: str = "en", strength: int = 3, case_level: bool = False, **options: Any) -> str:
    """The name of the collation for a locale and a strength.

    ``normalization`` is always on, and ``uppercase_first`` changes the order alone.  Options that change what is equal and that
    no collation has are an error here; ``equality_key`` has two of them.
    """
    for name in ("french", "numeric", "alternate_shifted"):
        if options.get(name):
            raise NotImplementedError(f"collator option `{name}` has no Spark collation.")
    if strength not in (1, 2, 3):
        raise NotImplementedError(f"collator strength {strength} has no Spark collation.")
    base = locale.split("_")[0].split("-")[0] or "UNICODE"
    suffix = {3: "", 2: "_CI", 1: "_AI" if case_level else "_CI_AI"}[strength]
    return f"{base}{suffix}"


def collation_of(p: Pattern) -> str:
    own = {k: v for k, v in p.options.items() if k != "ignore_case"}
    return collation(**own)

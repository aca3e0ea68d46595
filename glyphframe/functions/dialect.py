"""Regular expressions: from the ICU dialect to Java's (and Python's), and what can be told of them beforehand."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphframe.functions.patterns import Pattern

#: POSIX class names and the properties they stand for.
POSIX = {
    "alpha": r"\p{IsAlphabetic}",
    "lower": r"\p{IsLowercase}",
    "upper": r"\p{IsUppercase}",
    "punct": r"\p{IsPunctuation}",
    "digit": r"\p{IsDigit}",
    "xdigit": r"\p{XDigit}",
    "alnum": r"\p{IsAlphabetic}\p{IsDigit}",
    "space": r"\p{IsWhite_Space}",
    "blank": r"\p{Zs}\t",
    "cntrl": r"\p{Cc}",
    "graph": r"\p{L}\p{M}\p{N}\p{P}\p{S}",
    "print": r"\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}",
}
#: Property names that Java spells differently.
PROPERTIES = {
    "whitespace": "IsWhite_Space",
    "white_space": "IsWhite_Space",
    "alphabetic": "IsAlphabetic",
    "uppercase": "IsUppercase",
    "lowercase": "IsLowercase",
    "ideographic": "IsIdeographic",
    "letter": "L",
    "mark": "M",
    "number": "N",
    "punctuation": "P",
    "symbol": "S",
    "separator": "Z",
}
META = set(".^$\\|*+?{}[]()")
_PROPERTY = re.compile(r"\\([pP])\{\^?([^}]*)\}")


def quote(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join("\\" + c if c in META or c in "&~#-" else c for c in text)


def quote_column(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def fold_fixed(text: str) -> str:
    """Fixed text without regard to case: simple upper mapping, under which the dotted capital I is no i."""
    return "(?iu)" + "".join(("(?!(?-i:\u0130))" if c in "iI\u0131" else "") + quote(c) for c in text)


def to_java(pattern: str) -> str:
    """An ICU regular expression in Java's dialect: set differences, POSIX sets and property names."""

    def name(m: re.Match) -> str:
        negated = (m[1] == "P") != m[0].startswith(f"\\{m[1]}{{^")
        known = PROPERTIES.get(m[2].strip().lower(), m[2])
        return f"\\{'P' if negated else 'p'}{{{known}}}"

    pattern = _PROPERTY.sub(name, pattern)
    pattern = re.sub(r"\[:(\^?)(\w+):\]", lambda m: f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]] if m[2] in POSIX else m[0], pattern)
    return _differences(pattern)


def _differences(pattern: str) -> str:
    """``[A--B]`` as ``[A&&[^B]]``; ``--`` outside sets stays."""
    out, depth, i, pending = [], 0, 0, []
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            depth += 1
            pending.append(0)
        elif c == "]" and depth:
            depth -= 1
            out.append("]" * pending.pop())
        elif depth and pattern.startswith("--", i):
            out.append("&&[^")
            pending[-1] += 1
            i += 2
            if i < len(pattern) and pattern[i] == "[":  # [A--[B]] needs no second bracket
                out[-1] = "&&[^"
            continue
        out.append(c)
        i += 1
    return "".join(out)


def flags(p: Pattern, java: str) -> str:
    """Flags in front of a Java pattern; Unicode classes only where a class depends on them."""
    own = "".join(f for f, name in (("iu", "ignore_case"), ("m", "multiline"), ("x", "comments"), ("s", "dotall"), ("d", "unix_lines")) if p.get(name))
    if re.search(r"\\[wWsSdDbB]|\\p\{(Lower|Upper|Alpha|Alnum|Punct|Space|Digit)\}", java):
        own += "U"
    return f"(?{own})" if own else ""


def java_regex(p: Pattern) -> str | Column:
    """What Spark's regular-expression functions take for a regex or fixed pattern."""
    if isinstance(p.text, Column):
        if p.kind == "fixed":
            return F.concat(F.lit("(?iu)"), quote_column(p.text)) if p.get("ignore_case") else quote_column(p.text)
        warnings.warn("a regular expression in a column is compiled for every row", stacklevel=3)
        own = flags(p, r"\w")
        return F.concat(F.lit(own), p.text)
    if p.kind == "fixed":
        body = fold_fixed(p.text) if p.get("ignore_case") else quote(p.text)
        return f"(?={body})" if p.get("overlap") else body
    if p.get("literal"):
        return flags(p, "") + quote(p.text)
    java = to_java(p.text)
    return flags(p, java) + java


def literal_text(p: Pattern) -> str | None:
    """The text that a static pattern matches literally, if that is all it does."""
    if not p.static or p.get("ignore_case") or p.get("comments"):
        return None
    if p.kind == "fixed":
        return None if p.get("overlap") else p.text
    if p.kind != "regex":
        return None
    if p.get("literal") or not META & set(p.text):
        return p.text
    plain = re.sub(r"\\([^\w\s])", r"\1", p.text)
    return plain if re.fullmatch(r"(?:[^.^$\\|*+?{}\[\]()]|\\[^\w\s])*", p.text) else None


@dataclass(frozen=True)
class Facts:
    """What is known of a regular expression before it runs."""

    groups: int
    names: tuple[str | None, ...]  # of groups 1, 2, ...
    optional: bool  # a group may take no part in a match
    may_be_empty: bool


def facts(p: Pattern) -> Facts:
    """Facts of a static pattern; where they can't be told, the careful answer."""
    if p.kind == "fixed" or p.get("literal"):
        return Facts(0, (), False, p.text == "" or bool(p.get("overlap")))
    names = group_names(p.text)
    try:
        tree = _parsed(p)
    except (re.error, RecursionError, OverflowError):
        return Facts(len(names), names, bool(names), True)
    return Facts(len(names), names, _optional(tree), tree.getwidth()[0] == 0)


def group_names(pattern: str) -> tuple[str | None, ...]:
    out, i, in_set = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            in_set += 1
        elif c == "]" and in_set:
            in_set -= 1
        elif c == "(" and not in_set:
            m = re.match(r"\((?:\?<([A-Za-z][A-Za-z0-9]*)>|(?!\?))", pattern[i:])
            if m:
                out.append(m[1])
        i += 1
    return tuple(out)


def _parsed(p: Pattern):
    plain = _PROPERTY.sub(r"\\w", p.text)
    plain = re.sub(r"\[:\^?\w+:\]", r"\\w", plain)
    plain = re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", plain).replace("\\X", ".").replace("\\R", "\\n").replace("\\h", "\\s")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return re._parser.parse(plain, re.VERBOSE if p.get("comments") else 0)


def _optional(tree, inside: bool = False) -> bool:
    found = False
    for op, arg in tree:
        name = str(op)
        if name == "SUBPATTERN":
            found = found or (arg[0] is not None and inside) or _optional(arg[-1], inside)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            found = found or _optional(arg[2], inside or arg[0] == 0)
        elif name == "BRANCH":
            found = found or any(_optional(x, True) for x in arg[1])
        elif name in ("ASSERT", "ASSERT_NOT"):
            found = found or _optional(arg[1], inside or name == "ASSERT_NOT")
        elif name == "ATOMIC_GROUP":
            found = found or _optional(arg, inside)
    return found


def shift_groups(java: str, by: int) -> str:
    """Back references of a pattern, moved by ``by`` groups."""
    return re.sub(r"\\(\\|\d+)", lambda m: m[0] if m[1] == "\\" else f"\\{int(m[1]) + by}", java)


def fix_replacement(replacement: str) -> str:
    r"""From ``\1`` and literal ``$`` to the engine's ``$1`` and ``\$``; a lone ``\`` at the end goes."""
    out, i = [], 0
    while i < len(replacement):
        c = replacement[i]
        if c == "$":
            out.append("\\$")
        elif c == "\\":
            ahead = replacement[i + 1 : i + 2]
            if ahead.isdigit():
                out.append("$" + ahead)
            elif ahead == "$":
                out.append("\\\\$")
            elif ahead:
                out.append("\\" + ahead)
            i += 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


def fix_replacement_column(replacement: Column) -> Column:
    """``fix_replacement`` for replacements in a column."""
    escaped = F.replace(replacement, F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(escaped, r"(?<!\\)((?:\\\\)*)\\(\d)", "$1\\$$2")


def shift_replacement(replacement: str, by: int) -> str:
    """Group references of a fixed replacement, moved by ``by`` groups."""
    return re.sub(r"(\\.)|\$(\d)", lambda m: m[1] or f"${int(m[2]) + by}", replacement, flags=re.DOTALL)

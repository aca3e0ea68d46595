"""What Spark's expressions cannot say, as Arrow-batched functions: text boundaries, display width,
line filling, and regular expressions with empty matches or groups that take no part.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
import regex as _re  # has Unicode properties and grapheme clusters
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions.boundaries import WHITE, greek_sentences, line_breaks, sentences, space_breaks, words

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
STRINGS = T.ArrayType(T.StringType())


def mapped(kind: T.DataType, fn: Callable, *columns: Column) -> Column:
    """``fn`` of each row's values in batches; null where the first value is null."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        rows = zip(*series)
        return pd.Series([None if row[0] is None or row[0] != row[0] else fn(*row) for row in rows], dtype=object)

    return run(*columns)


# Regular expressions


def python_regex(pattern: str, ignore_case: bool = False, multiline: bool = False, comments: bool = False, dotall: bool = False) -> str:
    """The same pattern for Python's engine."""
    own = "".join(f for f, on in (("i", ignore_case), ("m", multiline), ("x", comments), ("s", dotall)) if on)
    body = re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)
    body = re.sub(r"\\p\{Is(\w+)\}", r"\\p{\1}", body)
    sets = "(?V1)" if "&&" in body else ""
    return sets + (f"(?{own})" if own else "") + body


def substituted(pattern: str, text: str, parts: list[str | int], every: bool) -> str:
    """Matches replaced by text and groups (numbers, 0 for the match)."""
    fill = lambda m: "".join(p if isinstance(p, str) else m.group(p) or "" for p in parts)
    return _re.sub(pattern, fill, text, count=0 if every else 1)


def spans(pattern: str, text: str) -> list[tuple[int, int]]:
    """Start and end of all matches."""
    return [m.span() for m in _re.finditer(pattern, text)]


def split(pattern: str, text: str, n: int) -> list[str]:
    """At most ``n`` pieces (all if ``n`` is not positive), empty ones included."""
    out, at = [], 0
    for a, b in spans(pattern, text):
        if 0 < n <= len(out) + 1:
            break
        if a == b and a == len(text):
            break
        out.append(text[at:a])
        at = b
    return [*out, text[at:]]


def groups(pattern: str, text: str, every: bool) -> list[list[str | None]]:
    """Matches with their groups; a group that takes no part is null."""
    found = ([m.group(0), *m.groups()] for m in _re.finditer(pattern, text))
    return list(found) if every else list(found)[:1]


def replaced(pattern: str, text: str, fn: Callable[[pd.Series], pd.Series], every: bool) -> str:
    found = spans(pattern, text)
    found = found if every else found[:1]
    new = list(fn(pd.Series([text[a:b] for a, b in found], dtype=object))) if found else []
    if len(new) != len(found):
        raise ValueError(f"the replacement function returned {len(new)} values for {len(found)} matches")
    if not all(isinstance(x, str) for x in new):
        raise TypeError("the replacement function must return strings")
    out, at = [], 0
    for (a, b), x in zip(found, new):
        out += [text[at:a], x]
        at = b
    return "".join([*out, text[at:]])


def replace_batch(texts: pd.Series, pattern: str, fn: Callable[[pd.Series], pd.Series], every: bool) -> pd.Series:
    """All matches of a batch go to ``fn`` as one series, and its values into their places."""
    found = [[] if t is None else (spans(pattern, t) if every else spans(pattern, t)[:1]) for t in texts]
    flat = pd.Series([t[a:b] for t, own in zip(texts, found) for a, b in own], dtype=object)
    new = list(fn(flat)) if len(flat) else []
    if len(new) != len(flat):
        raise ValueError(f"the replacement function returned {len(new)} values for {len(flat)} matches")
    if not all(isinstance(x, str) for x in new):
        raise TypeError("the replacement function must return strings")
    values, out = iter(new), []
    for t, own in zip(texts, found):
        parts, at = [], 0
        for a, b in own:
            parts += [t[at:a], next(values)]
            at = b
        out.append(None if t is None else "".join([*parts, t[at:]]))
    return pd.Series(out, dtype=object)


# Boundaries


def characters(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "") for m in _re.finditer(r"\X", text)]


SEGMENTERS = {"character": characters, "word": words, "sentence": sentences, "sentence_el": greek_sentences, "line_break": line_breaks}


def segments(text: str, kind: str, skipped: frozenset[str]) -> list[tuple[int, int]]:
    """Spans of the segments whose class is not skipped."""
    return [(a, b) for a, b, label in SEGMENTERS[kind](text) if label not in skipped]


def segment_count(text: str, kind: str, skipped: frozenset[str]) -> int:
    return sum(label not in skipped for _, _, label in SEGMENTERS[kind](text))


# Display width

_ZERO = frozenset({"Me", "Mn", "Cf", "Cc"})
#: Emoji without a presentation of their own that a joiner may join.
JOINABLE = frozenset(map(ord, "\u2620\u2640\u2642\u2695\u2696\u26a7\u2708\u2744\u2764\U0001f32b\U0001f5e8"))


_widths: dict[str, int] = {}
_joining: dict[str, bool] = {}


def char_width(c: str) -> int:
    """Columns that a character takes in a terminal, on its own."""
    if c not in _widths:
        _widths[c] = _char_width(c)
    return _widths[c]


def _char_width(c: str) -> int:
    o = ord(c)
    if o == 0xAD:
        return 1
    if o == 0x200B or 0xFE00 <= o <= 0xFE0F or 0x1160 <= o <= 0x11FF or 0xD7B0 <= o <= 0xD7FB:
        return 0
    category = unicodedata.category(c)
    if category in _ZERO or _re.match(r"\p{Emoji_Modifier}", c):
        return 0
    wide = unicodedata.east_asian_width(c)
    if wide in "FW" or category == "So" or wide == "N" and _re.match(r"\p{Emoji_Presentation}", c):
        return 2
    return 1


def joins(c: str) -> bool:
    """Whether a character after a joiner belongs to the emoji before it."""
    if c not in _joining:
        _joining[c] = ord(c) in JOINABLE or bool(_re.match(r"[\p{Emoji_Modifier}\p{Emoji_Presentation}]", c))
    return _joining[c]


def width(text: str) -> int:
    """Display width; an emoji after a joiner and the second half of a flag take no columns."""
    total, previous = 0, ""
    for c in text:
        if previous == "\u200d" and joins(c):
            previous = c
        elif "\U0001f1e6" <= previous <= "\U0001f1ff" and "\U0001f1e6" <= c <= "\U0001f1ff":
            previous = ""
        else:
            total += char_width(c)
            previous = c
    return total


# Line filling

_BLANK = re.compile("[ \t\n\x0b\x0c\r\x85\u2028\u2029]+")
#: Spaces of printable ASCII text where a line may break: not behind an opening bracket, and not before what closes or ends.
_ASCII_BREAK = re.compile(r"(?<![(\[{]) (?![)\]}!?/]|[,.:;](?![0-9]))")


def fill(text: str, columns: int, indent: int, exdent: int, whitespace_only: bool) -> str:
    """Words in lines of at most ``columns``, as even as they can be: the squared room that is left is least.

    The last line and words longer than a line cost nothing; of equal ways the one with the longer last line is taken.
    """
    columns = max(1, columns)
    text = _BLANK.sub(" ", text.lstrip("\ufeff")).strip(WHITE)
    if not text:
        return ""
    if text.isascii() and text.isprintable() and whitespace_only:
        words = _ASCII_BREAK.split(text)
        sizes, gaps = [len(w) for w in words], [" "] * (len(words) - 1) + [""]
    else:
        text = unicodedata.normalize("NFC", text)
        stops = space_breaks(text) if whitespace_only else [b for _, b, _ in line_breaks(text)]
        whole = [text[a:b] for a, b in zip([0, *stops], stops)]
        words = [w[:-1] if w[-1] in WHITE else w for w in whole]
        gaps = [a[len(b) :] for a, b in zip(whole, words)]
        sizes = [len(w) if w.isascii() and w.isprintable() else width(w) for w in words]
    n = len(words)
    # columns of all words before one, with the gaps behind them
    before = [0, *itertools.accumulate(s + char_width(g) if g else s for s, g in zip(sizes, gaps))]
    least, starts, low = [0] * n, [0] * n, 1
    for j in range(n):
        end = before[j] + sizes[j]
        if end <= columns - indent or j == 0:
            least[j] = max(0, columns - indent - end) ** 2
            continue
        need = end - columns + exdent  # a line from word i to here fits if as much is before it
        while low < j and before[low] < need:
            low += 1
        if j == n - 1 or before[low] < need:
            costs = least[low - 1 : j]
        else:
            costs = [c + (b - need) ** 2 for c, b in zip(least[low - 1 : j], before[low : j + 1])]
        least[j] = min(costs)
        starts[j] = low + costs.index(least[j])
    lines, j = [], n - 1
    while j >= 0:
        i = starts[j]
        body = "".join(itertools.chain.from_iterable(zip(words[i:j], gaps[i:j]))) + words[j]
        lines.append(" " * (exdent if i else indent) + body)
        j = i - 1
    return "\n".join(reversed(lines))


# Other


@functools.cache
def beside_marks() -> str:
    """Marks that stand neither above a letter nor on their own, as a set."""
    return "[" + "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c) not in (0, 230)) + "]"


def _lower(text: str, language: str) -> str:
    if language in ("tr", "az"):
        return re.sub(f"I({beside_marks()}*)\u0307", r"i\1", text).translate({0x49: "\u0131", 0x130: "i"}).lower()
    if language == "lt":
        out = []
        for k, c in enumerate(text):
            ahead = next((x for x in map(unicodedata.combining, text[k + 1 :]) if x in (0, 230)), 0) if c in "IJ\u012e" else 0
            out.append(c + "\u0307" if ahead else LITHUANIAN.get(c, c))
        return "".join(out).lower()
    return text.lower()


#: Capitals whose small letters keep a dot in Lithuanian.
LITHUANIAN = {"\u00cc": "i\u0307\u0300", "\u00cd": "i\u0307\u0301", "\u0128": "i\u0307\u0303"}


def _titled(part: str, language: str, starts: Callable[[str], bool]) -> str:
    """The first character that may start it in title case, what follows lower."""
    k = next((k for k, c in enumerate(part) if starts(c)), len(part))
    first, rest = part[k : k + 1], part[k + 1 :]
    title = "\u0130" if first == "i" and language in ("tr", "az") else first.title()
    if language in ("tr", "az") and first == "I":
        rest = re.sub(f"^({beside_marks()}*)\u0307", r"\1", rest)
    if language == "nl":  # an acute stands on both letters or on none
        both = _re.match(r"[jJ](?!\p{M})" if first in "iI\u0131" else r"[jJ](?=\u0301(?!\p{M}))" if first in "\u00ed\u00cd" else r"(?!)", rest)
        if first in "iI\u0131" and _re.match(r"\u0301[jJ]\u0301(?!\p{M})", rest):
            title, rest = title + "\u0301J", rest[2:]
        elif both and first:
            title, rest = title + "J", rest[1:]
    # a letter before the rest tells whether a sigma ends a word
    return part[:k] + title + _lower(("a" if first.isalpha() else " ") + rest, language)[1:]


def sentence_case(text: str, language: str = "") -> str:
    """The first letter of each sentence in title case, all else lower, by the language's rules."""
    find = greek_sentences if language == "el" else sentences
    starts = lambda c: unicodedata.category(c)[0] in "LNS" or unicodedata.category(c) == "Co"
    return "".join(_titled(text[a:b], language, starts) for a, b, _ in find(text))


def title_case(text: str, language: str = "") -> str:
    """The same by words."""
    starts = lambda c: unicodedata.category(c)[0] in "LNS" or unicodedata.category(c) == "Co"
    return "".join(_titled(text[a:b], language, starts) for a, b, _ in words(text))


#: Marks that Greek letters bear; the first ones are accents.
GREEK_ACCENTS = "\u0300\u0301\u0342\u0302\u0303\u0311"
GREEK_MARKS = GREEK_ACCENTS + "\u0308\u0304\u0306\u0313\u0314\u0343\u0344\u0345"


def _cased(text: Iterable[str]) -> bool:
    """Whether the first character that matters for case is a cased letter."""
    return next((bool(_re.match(r"\p{Cased}", c)) for c in text if not _re.match(r"\p{Case_Ignorable}", c)), False)


def greek_upper(text: str) -> str:
    """Greek capitals have no accents but the dialytika, which also marks an iota or upsilon after an accented vowel.

    The word "or", an eta with an accent that stands alone, keeps it.  Other marks stay, and a subscript iota is a capital one.
    """
    out, i, n = [], 0, len(text)
    accent, written = False, False  # of the vowel before; whether as a mark of its own
    while i < n:
        c = text[i]
        whole = unicodedata.normalize("NFD", c)
        base = whole[0]
        if not (("\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff" or c == "\u2126") and base.isalpha()):
            out.append(c.upper())
            i, accent = i + 1, False
            continue
        j = i + 1
        while j < n and text[j] in GREEK_MARKS:
            j += 1
        own, marks = whole[1:], text[i + 1 : j].replace("\u0344", "\u0308\u0301")
        capital = base.upper()
        vowel = capital in "\u0391\u0395\u0397\u0399\u039f\u03a5\u03a9"
        inside, outside = any(m in own for m in GREEK_ACCENTS), any(m in marks for m in GREEK_ACCENTS)
        dots, dots_written = "\u0308" in own, "\u0308" in marks
        if accent and capital in "\u0399\u03a5" and not (dots or dots_written):
            dots, dots_written = not written, written
        subscripts = (own + marks).count("\u0345")
        alone = capital == "\u0397" and (inside or outside) and not subscripts and not _cased(text[k] for k in range(i - 1, -1, -1)) and not _cased(text[k] for k in range(j, n))
        out.append((unicodedata.normalize("NFC", capital + "\u0308") if dots and capital in "\u0399\u03a5" else "\u0389" if alone and inside else capital)
                   + ("\u0308" if dots_written else "") + ("\u0301" if alone and not inside else "") + "\u0399" * subscripts)
        accent, written = vowel and (inside or outside) and not (dots or dots_written), not inside
        i = j
    return "".join(out)

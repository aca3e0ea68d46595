"""Upper, lower, title and sentence case, and the cases of identifiers."""

from __future__ import annotations

import functools
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions import kernels
from glyphframe.functions.patterns import text
from glyphframe.operators.layout import str_trim

TURKIC = ("tr", "az")
#: Fixed pattern: where a word of an identifier ends.
WORD_BREAK = (
    r"[^\p{L}\p{N}]+"
    r"|(?<=\p{Ll})(?=\p{Lu})"
    r"|(?<=\p{L})(?=\p{N})"
    r"|(?<=\p{N})(?=\p{L})"
    r"|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
)


def _language(locale: str) -> str:
    if not isinstance(locale, str):
        raise TypeError("`locale` must be a single string.")
    return locale.replace("-", "_").split("_")[0].lower()


@functools.cache
def _marks() -> tuple[str, str, str]:
    """Sets of soft-dotted letters, marks above a letter, and marks elsewhere, for Java's expressions."""
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF]
    dotted = [c for c in points if regex.match(r"\p{Soft_Dotted}", c)]
    above = [c for c in points if unicodedata.combining(c) == 230]
    beside = [c for c in points if unicodedata.combining(c) not in (0, 230)]
    return tuple("[" + "".join(rf"\x{{{ord(c):X}}}" for c in own) + "]" for own in (dotted, above, beside))


def lithuanian_lower(s: Column) -> Column:
    """A small i or j keeps its dot under a further mark above it."""
    _, above, beside = _marks()
    s = F.regexp_replace(s, f"([IJ\u012e])(?={beside}*+{above})", "$1\u0307")
    for capital, small in kernels.LITHUANIAN.items():
        s = F.replace(s, F.lit(capital), F.lit(small))
    return F.lower(s)


def lithuanian_upper(s: Column) -> Column:
    """Capitals lose the dot that a soft-dotted letter keeps under a mark."""
    dotted, _, beside = _marks()
    return F.upper(F.regexp_replace(s, f"({dotted}{beside}*+)\u0307", "$1"))


def str_to_upper(string, locale: str = "en") -> Column:
    """Upper case by the full mapping and the language's rules."""
    s = text(string)
    if _language(locale) == "el":
        greek = F.rlike(s, F.lit(r"[\u0370-\u03FF\u1F00-\u1FFF]"))
        return F.when(greek, kernels.mapped(T.StringType(), kernels.greek_upper, F.when(greek, s))).otherwise(F.upper(s))
    if _language(locale) == "lt":
        return lithuanian_upper(s)
    return F.upper(F.translate(s, "iı", "İI") if _language(locale) in TURKIC else s)


def str_to_lower(string, locale: str = "en") -> Column:
    s = text(string)
    if _language(locale) == "lt":
        return lithuanian_lower(s)
    if _language(locale) not in TURKIC:
        return F.lower(s)
    return F.lower(F.translate(F.regexp_replace(s, f"I({_marks()[2]}*+)\u0307", "i$1"), "Iİ", "ıi"))


def str_to_title(string, locale: str = "en") -> Column:
    """Each word with a capital, by Unicode word boundaries."""
    language = _language(locale)
    name = language if language in TURKIC else "UNICODE"
    s = text(string)
    titled = F.collate(F.initcap(F.collate(s, name)), "UTF8_BINARY")
    # the languages whose words need more than a capital
    special = {"nl": r"[iI\u0131\u00ed\u00cd]\u0301?[jJ]", "lt": r"[\u00cc\u00cd\u0128IJ\u012eij\u012f]"}.get(language)
    if special is None:
        return titled
    has = F.rlike(s, F.lit(special))
    return F.when(has, kernels.mapped(T.StringType(), lambda t: kernels.title_case(t, language), F.when(has, s))).otherwise(titled)


def str_to_sentence(string, locale: str = "en") -> Column:
    """Each sentence with a capital."""
    language = _language(locale)
    return kernels.mapped(T.StringType(), lambda t: kernels.sentence_case(t, language), text(string))


def to_words(string) -> Column:
    """Words of an identifier in lower case, with spaces between."""
    return str_trim(F.lower(F.regexp_replace(text(string), WORD_BREAK, " ")))


def str_to_camel(string, first_upper: bool = False) -> Column:
    titled = F.replace(str_to_title(to_words(string)), F.lit(" "), F.lit(""))
    if first_upper:
        return titled
    return F.concat(F.lower(F.substring(titled, 1, 1)), titled.substr(F.lit(2), F.length(titled)))


def str_to_snake(string) -> Column:
    return F.replace(to_words(string), F.lit(" "), F.lit("_"))


def str_to_kebab(string) -> Column:
    return F.replace(to_words(string), F.lit(" "), F.lit("-"))

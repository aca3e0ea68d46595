"""Counting and locating matches.  Positions are 1-based, inclusive code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions import kernels
from glyphframe.functions.dialect import facts, java_regex, quote, to_java
from glyphframe.functions.patterns import Pattern, as_pattern, collation_of, text, value

ANY = str | Column | Pattern
#: Stands for a match while text is split under a collation; a private-use character.
MARK = "\ue000"
#: All private-use characters of the basic plane: a row that has ``MARK`` gets the first of these that it does not have.
PRIVATE = "".join(map(chr, range(0xE000, 0xF900)))
#: Characters that a collation may ignore, and the most characters that one is equivalent to.
IGNORED = r"[\p{M}\p{Cf}\p{Cc}]"
MOST_FOR_ONE = 18
ALONE = r"^[\x00-\u02FF\u0370-\u0482\u1E00-\u1FFF]*\z"
#: Text of ASCII and Latin letters with accents, and its words by the Unicode rules; a connector alone is none.
LATIN = r"^[\x00-\x7F\u00C0-\u024F&&[^\u00D7\u00F7]]*\z"
_LETTER = r"[A-Za-z\u00C0-\u024F]"
LATIN_WORD = rf"(?!_(?![0-9_]|{_LETTER}))(?:[0-9_A-Za-z\u00C0-\u024F]++|(?<={_LETTER})[.':](?={_LETTER})|(?<=[0-9])[.,';](?=[0-9]))++"
SPAN_TYPE = "struct<start:int,end:int>"
SPANS_TYPE = "array<struct<start:int,end:int>>"
_WORD_CLASSES = {"skip_word_none": "none", "skip_word_number": "number", "skip_word_letter": "letter", "skip_word_kana": "kana", "skip_word_ideo": "ideo"}
_OTHER_CLASSES = {"skip_line_soft": "soft", "skip_line_hard": "hard", "skip_sentence_term": "term", "skip_sentence_sep": "sep"}


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def no_span() -> Column:
    return span(F.lit(None), F.lit(None))


def skipped(p: Pattern) -> frozenset[str]:
    """Classes of segments that a boundary pattern leaves out."""
    names = _WORD_CLASSES if p.get("type") == "word" else _OTHER_CLASSES
    return frozenset(label for option, label in names.items() if p.get(option))


def segmenter(p: Pattern) -> str:
    """Which kernel finds the boundaries; of the locales only Greek has sentences of its own."""
    greek = str(p.get("locale") or "").replace("-", "_").split("_")[0].lower() == "el"
    return "sentence_el" if greek and p.get("type") == "sentence" else p.get("type")


def is_characters(p: Pattern) -> bool:
    return p.kind == "bound" and p.get("type") == "character"


def segment_spans(s: Column, p: Pattern) -> Column:
    """0-based spans of boundary segments, by a kernel."""
    kind, out = segmenter(p), skipped(p)
    return kernels.mapped(kernels.SPAN, lambda t: [{"start": a, "end": b} for a, b in kernels.segments(t, kind, out)], s)


def segment_texts(s: Column, p: Pattern) -> Column:
    if is_characters(p):
        return F.regexp_extract_all(s, F.lit(r"(?s)\X"), F.lit(0))
    kind, out = segmenter(p), skipped(p)
    return kernels.mapped(kernels.STRINGS, lambda t: [t[a:b] for a, b in kernels.segments(t, kind, out)], s)


def needs_kernel(p: Pattern) -> bool:
    """Whether matches can be empty, so that splitting does not tell where they are."""
    return p.static and p.kind in ("regex", "fixed") and facts(p).may_be_empty


def python_pattern(p: Pattern) -> str:
    own = {k: bool(p.get(k)) for k in ("ignore_case", "multiline", "comments", "dotall")}
    if p.kind == "fixed":
        body = quote(p.text)
        return kernels.python_regex(f"(?={body})" if p.get("overlap") else body, own["ignore_case"])
    return kernels.python_regex(to_java(p.text), **own)


def regex_spans(s: Column, p: Pattern) -> Column:
    """All spans of a regex or fixed pattern: pieces between matches and the matches tell their places."""
    if needs_kernel(p):
        body = python_pattern(p)
        return kernels.mapped(kernels.SPAN, lambda t: [{"start": a + 1, "end": b} for a, b in kernels.spans(body, t)], s)
    java = value(java_regex(p))
    hits = F.regexp_extract_all(s, java, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS_TYPE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        return F.struct((first + x["size"]).alias("at"), F.concat(acc["out"], F.array(span(first + 1, first + x["size"]))).alias("out"))

    pairs = F.zip_with(F.slice(F.split(s, java, -1), 1, F.greatest(F.size(hits), F.lit(1))), hits, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size")))
    pairs = F.filter(pairs, lambda x: x["size"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def coll_length(s: Column, p: Pattern, start: Column) -> Column:
    """Length of the collated match at ``start``: the longest stretch there that equals the pattern.

    A stretch has at most ``MOST_FOR_ONE`` characters for each of the pattern, and any number of marks and controls.  Between
    printable ASCII texts the lengths are the same.
    """
    name, pattern = collation_of(p), value(p.text)
    size = F.greatest(F.length(pattern), F.lit(1))
    rest = s.substr(start, F.length(s))
    longest = F.concat(F.lit(f"^{IGNORED}*(?:(?!{IGNORED})(?s:.){IGNORED}*){{0,"), (size * MOST_FOR_ONE).cast("string"), F.lit("}"))
    sizes = F.sequence(F.lit(1), F.greatest(F.length(F.regexp_substr(rest, longest)), F.lit(1)))
    same = F.filter(sizes, lambda n: F.collate(s.substr(start, n), name) == F.collate(pattern, name))
    plain = F.rlike(s, F.lit(r"^[ -~]*\z")) & F.rlike(pattern, F.lit(r"^[ -~]*\z"))
    return F.when(plain, F.length(pattern)).otherwise(F.coalesce(F.array_max(same), F.length(pattern)))


def coll_first(s: Column, p: Pattern) -> Column:
    """Start of the first collated match; 0 if there is none."""
    name = collation_of(p)
    return F.call_function("locate", F.collate(value(p.text), name), F.collate(s, name), F.lit(1))


def coll_mark(s: Column, p: Pattern) -> Column:
    """A private-use character that neither the text nor the pattern has."""
    both = F.concat(s, value(p.text))
    free = F.call_function("translate", F.lit(PRIVATE), both, F.lit(""))
    return F.when(F.contains(both, F.lit(MARK)), F.substring(free, 1, 1)).otherwise(F.lit(MARK))


def coll_marked(s: Column, p: Pattern) -> Column:
    """Text with every collated match as ``coll_mark``."""
    name = collation_of(p)
    return F.collate(F.replace(F.collate(s, name), F.collate(value(p.text), name), F.collate(coll_mark(s, p), name)), "UTF8_BINARY")


def coll_spans(s: Column, p: Pattern) -> Column:
    name, n = collation_of(p), _fixed_count(coll_marked(s, p), coll_mark(s, p))
    start = F.struct(F.lit(1).alias("at"), F.array().cast(SPANS_TYPE).alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at = F.call_function("locate", F.collate(value(p.text), name), F.collate(s, name), acc["at"])
        end = at + coll_length(s, p, at) - 1
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(span(at, end))).alias("out"))

    rounds = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, step, lambda acc: acc["out"])


def _fixed_count(s: Column, p: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, p, F.lit("")))) / F.length(p)).cast("int")


def str_count(string, pattern: ANY = "") -> Column:
    """Number of matches (of segments, for boundaries)."""
    s, p = text(string), as_pattern(pattern)
    if p.kind == "bound":
        if not is_characters(p):
            kind, out = segmenter(p), skipped(p)
            if (kind, out) != ("word", {"none"}):
                return kernels.mapped(T.IntegerType(), lambda t: kernels.segment_count(t, kind, out), s)
            latin = F.rlike(s, F.lit(LATIN))  # a kernel gets null instead of such text
            others = kernels.mapped(T.IntegerType(), lambda t: kernels.segment_count(t, kind, out), F.when(~latin, s))
            return F.when(latin, F.regexp_count(s, F.lit(LATIN_WORD))).otherwise(others)
        # letters of these blocks stand alone, but for a carriage return before a newline
        simple = F.length(s) - (F.length(s) - F.length(F.replace(s, F.lit("\r\n"), F.lit("")))) / 2
        return F.when(F.rlike(s, F.lit(ALONE)), simple.cast("int")).otherwise(F.regexp_count(s, F.lit(r"(?s)\X")))
    if p.static and not p.text:
        return F.lit(None).cast("int")
    if p.kind == "coll":
        return _fixed_count(coll_marked(s, p), coll_mark(s, p))
    if p.kind == "fixed" and not p.get("ignore_case") and not p.get("overlap"):
        return _fixed_count(s, F.when(value(p.text) != "", value(p.text)))
    if needs_kernel(p) and p.kind == "regex":  # Java also finds empty matches within surrogate pairs
        return F.size(regex_spans(s, p))
    return F.regexp_count(s, value(java_regex(p)))


def str_locate(string, pattern: ANY) -> Column:
    """(start, end) of the first match; null in both if there is none."""
    s, p = text(string), as_pattern(pattern)
    if p.kind == "bound":
        if is_characters(p):
            return F.when(F.length(s) > 0, span(F.lit(1), F.length(F.regexp_extract(s, r"(?s)\X", 0)))).otherwise(no_span())
        first = F.get(segment_spans(s, p), F.lit(0))
        return F.when(first.isNotNull(), span(first["start"] + 1, first["end"])).otherwise(no_span())
    if p.static and not p.text:
        return no_span()
    if p.kind == "coll":
        at = coll_first(s, p)
        return F.when(at > 0, span(at, at + coll_length(s, p, at) - 1)).otherwise(no_span())
    if p.kind == "fixed" and not p.get("ignore_case"):
        at = F.call_function("locate", value(p.text), s, F.lit(1))
        return F.when((at > 0) & (F.length(value(p.text)) > 0), span(at, at + F.length(value(p.text)) - 1)).otherwise(no_span())
    if needs_kernel(p):
        return F.coalesce(F.get(regex_spans(s, p), F.lit(0)), no_span())
    java = value(java_regex(p))
    at = F.length(F.get(F.split(s, java, 2), F.lit(0))) + 1
    return F.when(F.rlike(s, java), span(at, at + F.length(F.regexp_extract(s, java_regex(p), 0)) - 1 if p.static else at + F.length(F.regexp_substr(s, java)) - 1)).otherwise(no_span())


def str_locate_all(string, pattern: ANY) -> Column:
    """(start, end) of all matches; an array with one null pair for null."""
    s, p = text(string), as_pattern(pattern)
    if p.kind == "bound":
        spans = F.transform(segment_spans(s, p), lambda x: span(x["start"] + 1, x["end"]))
    elif p.static and not p.text:
        spans = F.array(no_span())
    elif p.kind == "coll":
        spans = coll_spans(s, p)
    else:
        spans = regex_spans(s, p)
    return F.when(s.isNull(), F.array(no_span())).otherwise(spans)


def invert_match(spans: Column) -> Column:
    """What lies between matches: from 0 before the first to -1 after the last."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"] + 1))
    ends = F.concat(F.transform(spans, lambda x: x["start"] - 1), F.array(F.lit(-1)))
    return F.zip_with(starts, ends, span)


__all__ = ["invert_match", "str_count", "str_locate", "str_locate_all"]

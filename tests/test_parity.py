"""Expressions in the JVM against the Python kernels, on random text."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphframe import api as s
from glyphframe.functions import kernels
from glyphframe.functions.dialect import to_java
from glyphframe.operators.locate import python_pattern

ALPHABET = "aab1 -.\né\u0301\U0001f60aZ"
PATTERNS = ["a", "a+", "[ab]1?", r"\d", r"\s+", "(a)(b)", "a|b1", r"\.", "[^a]", "(?<x>a)b", "b.", r"\p{L}+", r"[\p{L}--[b]]", "[[:alpha:]]+", r"\w+"]
EMPTY = ["a*", "(?=b)", r"x?", "$"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(20)
    rows = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 14))) for _ in range(150)] + [None]
    return spark.createDataFrame(list(enumerate(rows)), "i int, s string").cache()


@pytest.mark.parametrize("pattern", PATTERNS)
def test_regex(texts, pattern):
    body = python_pattern(s.regex(pattern))
    rows = texts.select(
        "s",
        s.str_locate_all("s", pattern).alias("spans"),
        s.str_extract_all("s", pattern).alias("hits"),
        s.str_split("s", pattern).alias("pieces"),
        s.str_split("s", pattern, n=2).alias("two"),
        s.str_count("s", pattern).alias("n"),
        s.str_extract("s", pattern).alias("first"),
        s.str_locate("s", pattern).alias("span"),
        s.str_replace("s", pattern, r"<\0>").alias("once"),
        s.str_replace_all("s", pattern, lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("each"),
    ).collect()
    for r in rows:
        t = r["s"]
        if t is None:
            assert r["hits"] == [None] and r["pieces"] == [None] and r["n"] is None and r["first"] is None and r["each"] is None
            continue
        spans = kernels.spans(body, t)
        assert [tuple(x) for x in r["spans"]] == [(a + 1, b) for a, b in spans], t
        assert r["hits"] == [t[a:b] for a, b in spans] and r["n"] == len(spans)
        assert r["pieces"] == kernels.split(body, t, -1) and r["two"] == kernels.split(body, t, 2), t
        assert r["first"] == (t[slice(*spans[0])] if spans else None)
        assert tuple(r["span"]) == ((spans[0][0] + 1, spans[0][1]) if spans else (None, None))
        mark = lambda own: kernels.replaced(body, t, lambda x: "<" + x + ">", own)  # noqa: E731, B023
        assert r["once"] == mark(False) and r["each"] == mark(True), t


@pytest.mark.parametrize("pattern", EMPTY)
def test_empty_matches(texts, pattern):
    body = python_pattern(s.regex(pattern))
    for r in texts.where("s is not null").select("s", s.str_locate_all("s", pattern).alias("spans"), s.str_count("s", pattern).alias("n")).collect():
        spans = kernels.spans(body, r["s"])
        assert [tuple(x) for x in r["spans"]] == [(a + 1, b) for a, b in spans]
        if not (pattern == "$" and "\n" in r["s"]):
            assert r["n"] == len(spans), r["s"]


@pytest.mark.parametrize("text", ["a", "1 ", ".", "é", "aa"])
def test_fixed(texts, text):
    p = s.fixed(text)
    for r in texts.where("s is not null").select(
        "s", s.str_count("s", p).alias("n"), s.str_split("s", p).alias("pieces"), s.str_locate("s", p).alias("span"), s.str_replace("s", p, "#").alias("one"), s.str_replace_all("s", p, "#").alias("all"),
        s.str_starts("s", p).alias("a"), s.str_ends("s", p).alias("z"), s.str_detect("s", p).alias("d"), s.str_locate_all("s", p).alias("spans"),
    ).collect():
        t = r["s"]
        at = t.find(text)
        assert (r["n"], r["pieces"]) == (t.count(text), t.split(text))
        assert tuple(r["span"]) == ((at + 1, at + len(text)) if at >= 0 else (None, None)) and len(r["spans"]) == t.count(text)
        assert (r["one"], r["all"]) == (t.replace(text, "#", 1), t.replace(text, "#"))
        assert (r["a"], r["z"], r["d"]) == (t.startswith(text), t.endswith(text), text in t)


def test_unary(texts):
    for r in texts.where("s is not null").select(
        "s", s.str_width("s").alias("w"), s.str_length("s").alias("n"), s.str_reverse("s").alias("rev"), s.trans_nfc("s").alias("nfc"), s.str_trim("s").alias("trim"),
        s.str_squish("s").alias("squish"), s.str_sub("s", -4, -2).alias("sub"), s.escape_unicode("s").alias("esc"),
    ).collect():
        t = r["s"]
        assert (r["w"], r["n"], r["rev"]) == (kernels.width(t), len(t), t[::-1])
        assert (r["nfc"], r["trim"], r["squish"]) == (unicodedata.normalize("NFC", t), t.strip(), " ".join(t.split()))
        assert r["sub"] == t[max(0, len(t) - 4) : max(0, len(t) - 1)]
        assert r["esc"].encode().decode("unicode_escape") == t


def test_dialect():
    assert to_java(r"[\p{L}--[b]]") == r"[\p{L}&&[^[b]]]"
    assert to_java("[[:alpha:]_]") == r"[\p{IsAlphabetic}_]"
    assert to_java(r"\p{Whitespace}") == r"\p{IsWhite_Space}"
    assert to_java("a--b") == "a--b"


def test_versions(spark):
    assert set(s.icu_info(spark)) == {"spark", "unicode", "kernel_unicode", "python"}

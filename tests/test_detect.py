import pytest
from pyspark.sql import functions as F

from glyphframe import api as s

L, NULL = F.lit, F.lit(None).cast("string")


def test_detect(check):
    check(
        (s.str_detect(NULL, "x"), None),
        (s.str_detect(L("ab"), "a"), True),
        (s.str_detect(L("ab"), "c"), False),
        (s.str_detect(L("ab"), "c", negate=True), True),
        (s.str_detect(L("ab"), L("b")), True),
        (s.str_detect(L("X"), s.fixed(".")), False),
        (s.str_detect(L("ı"), s.coll("I", ignore_case=True, locale="tr")), True),
        (s.str_detect(L("ı"), s.coll("i", ignore_case=True, locale="en")), False),
        (s.str_detect(L("I"), s.fixed("i", ignore_case=True)), True),
        (s.str_detect(L("ı"), s.fixed("i", ignore_case=True)), True),
        (s.str_detect(L("İ"), s.fixed("i", ignore_case=True)), False),
        (s.str_detect(L("ſ"), s.fixed("S", ignore_case=True)), True),
        (s.str_detect(L("a.b"), "a\\.b"), True),
        (s.str_detect(L("axb"), "a\\.b"), False),
        (s.str_detect(L("a\nb"), s.regex("a.b", dotall=True)), True),
        (s.str_detect(L("a\nb"), s.regex("^b", multiline=True)), True),
        (s.str_detect(L("ab"), s.regex("a b # words", comments=True)), True),
        (s.str_detect(L("a+b"), s.regex("a+b", literal=True)), True),
        (s.str_detect(L("É"), s.regex("é", ignore_case=True)), True),
        (s.str_detect(L("\u0085"), r"\s"), True),
        (s.str_detect(L("b"), r"[\p{L}--[b]]"), False),
        (s.str_detect(L("c"), r"[\p{L}--[b]]"), True),
        (s.str_detect(L("x"), s.fixed("")), None),
    )


def test_starts_ends(check):
    check(
        (s.str_starts(L("ab"), "a"), True),
        (s.str_starts(L("ba"), "a"), False),
        (s.str_ends(L("ab"), "a"), False),
        (s.str_ends(L("ba"), "a"), True),
        (s.str_starts(L("ba"), "a", negate=True), True),
        (s.str_starts(L("cb"), "a|b"), False),
        (s.str_starts(L("ba"), "a|b"), True),
        (s.str_ends(L("bc"), "a|b"), False),
        (s.str_ends(L("ab"), "a|b"), True),
        (s.str_ends(L("ab\n"), "b"), True),
        (s.str_ends(L("ab\n"), s.fixed("b")), False),
        (s.str_starts(L("X"), s.fixed(".")), False),
        (s.str_starts(L("ıx"), s.coll("I", ignore_case=True, locale="tr")), True),
        (s.str_ends(L("xı"), s.coll("I", ignore_case=True, locale="tr")), True),
        (s.str_starts(L("Abc"), s.fixed("aB", ignore_case=True)), True),
        (s.str_ends(L("abC"), s.fixed("Bc", ignore_case=True)), True),
    )


@pytest.mark.parametrize("verb", [s.str_detect, s.str_starts, s.str_ends, s.str_replace, s.str_replace_all])
def test_no_empty_pattern(spark, verb):
    more = ("",) if "replace" in verb.__name__ else ()
    with pytest.raises(ValueError, match="empty string"):
        verb(L("x"), "", *more)
    with pytest.raises(ValueError, match="boundary"):
        verb(L("x"), s.boundary("word"), *more)


def test_like(check, spark):
    assert s.like_to_regex("ab%") == "^ab.*$"
    assert s.like_to_regex("ab_") == "^ab.$"
    assert s.like_to_regex("ab\\%") == "^ab\\%$"
    assert s.like_to_regex("ab[%]") == "^ab[%]$"
    check(
        (s.str_like(L("abc"), "ab%"), True),
        (s.str_like(L("abc"), "AB%"), False),
        (s.str_ilike(L("abc"), "AB%"), True),
        (s.str_like(L("a\nb"), "a%b"), False),
        (s.str_like(L("abc"), L("a_c")), True),
    )
    with pytest.warns(DeprecationWarning):
        s.str_like(L("abc"), "AB%", ignore_case=True)
    for verb in (s.str_like, s.str_ilike):
        with pytest.raises(TypeError, match="plain string"):
            verb(L("abc"), s.regex("x"))


def test_equal(check):
    check(
        (s.str_equal(L("a"), L("b")), False),
        (s.str_equal(L("a"), L("A")), False),
        (s.str_equal(L("a"), L("A"), ignore_case=True), True),
        (s.str_equal(L("\u00e1"), L("a\u0301")), True),
        (s.str_equal(L("\u03a9"), L("\u2126")), True),
        (s.str_equal(L("a"), L("á"), strength=1), True),
    )


def test_subset_and_which(strings):
    rows = lambda df: [r["s"] for r in df.orderBy("i").collect()]
    assert rows(s.str_subset(strings("a", "b", "c"), "s", "a|c")) == ["a", "c"]
    assert rows(s.str_subset(strings("a", "b", "c"), "s", "a|c", negate=True)) == ["b"]
    assert rows(s.str_subset(strings("a", None, "b"), "s", ".")) == ["a", "b"]
    assert rows(s.str_subset(strings("a", None, "b"), "s", "a", negate=True)) == ["b"]
    assert rows(s.str_subset(strings("i", "I"), "s", s.fixed("i", ignore_case=True))) == ["i", "I"]
    letters = strings(*"abcdef")
    assert sorted(r[0] for r in s.str_which(letters, "s", "[aeiou]", "i").collect()) == [1, 5]
    assert sorted(r[0] for r in s.str_which(letters, "s", "[aeiou]", "i", negate=True).collect()) == [2, 3, 4, 6]


def test_literals_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("abc",)], "s string").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for c, name in ((s.str_detect("s", "b"), "StringContains"), (s.str_starts("s", s.fixed("a.")), "StringStartsWith"), (s.str_ends("s", s.fixed("c")), "StringEndsWith")):
        plan = t.where(c)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert name in plan


def test_patterns(spark):
    assert s.type_of("") == "empty" and s.type_of("a") == "regex" and s.type_of(s.fixed("a")) == "fixed" and s.type_of(s.boundary()) == "bound"
    assert s.coll("x", strength=1).get("strength") == 1
    assert s.coll("x", ignore_case=True).get("strength") == 2
    assert s.coll("x").get("strength") == 3
    assert s.regex("a", multiline=True).with_text("b").get("multiline")
    assert s.boundary("word").get("skip_word_none") and not s.boundary().get("skip_word_none")
    for bad in (1, None):
        with pytest.raises((TypeError, ValueError)):
            s.as_pattern(bad)
    with pytest.raises(NotImplementedError):
        s.regex("a", time_limit=1)
    with pytest.warns(UserWarning):
        s.regex("a", nonsense=1)

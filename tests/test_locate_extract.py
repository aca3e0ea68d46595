import pytest
from pyspark.sql import functions as F

from glyphframe import api as s
from glyphframe.functions.dialect import facts

L, NULL = F.lit, F.lit(None).cast("string")
TR = s.coll("I", ignore_case=True, locale="tr")


def test_count(check):
    towns = ("Lisbon", "Tallinn", "Addis Ababa", "Ülemiste")
    check(*[(s.str_count(L(t), p), t.count(p)) for t in towns for p in "lsa"])
    check(
        (s.str_count(L("x."), s.fixed(".")), 1),
        (s.str_count(L("ı"), TR), 1),
        (s.str_count(L("a b c"), ""), 5),
        (s.str_count(L("a b c"), s.boundary("word")), 3),
        (s.str_count(L("e\u0301x"), ""), 2),
        (s.str_count(NULL, "a"), None),
        (s.str_count(L(""), s.fixed("a")), 0),
        (s.str_count(L("aaa"), s.fixed("aa")), 1),
        (s.str_count(L("aaa"), s.fixed("aa", overlap=True)), 2),
        (s.str_count(L("AaA"), s.fixed("a", ignore_case=True)), 3),
        (s.str_count(L("abc"), L("b")), 1),
        (s.str_count(L("One. Two! Three?"), s.boundary("sentence")), 3),
    )


def test_locate(check):
    check(
        (s.str_locate(L("abc"), "a"), (1, 1)),
        (s.str_locate(L("abc"), "c"), (3, 3)),
        (s.str_locate(L("abc"), ".+"), (1, 3)),
        (s.str_locate(L("def"), "a"), (None, None)),
        (s.str_locate(L("😊xb"), "x"), (2, 2)),
        (s.str_locate(L("x.x"), s.fixed(".")), (2, 2)),
        (s.str_locate(L("ı"), TR), (1, 1)),
        (s.str_locate(L("ae\u0301b"), s.coll("\u00e9")), (2, 3)),
        (s.str_locate(L(" x  y"), ""), (1, 1)),
        (s.str_locate(L(" xy"), s.boundary("word")), (2, 3)),
        (s.str_locate(NULL, "a"), (None, None)),
        (s.str_locate(L("abc"), "(?=c)"), (3, 2)),
    )


def test_locate_all_and_invert(check):
    all_ = s.str_locate_all
    check(
        (all_(L("abab"), "a"), [(1, 1), (3, 3)]),
        (all_(L("abab"), L("b")), [(2, 2), (4, 4)]),
        (all_(L("x.x."), s.fixed(".")), [(2, 2), (4, 4)]),
        (all_(L("ıI"), TR), [(1, 1), (2, 2)]),
        (all_(L("abc"), ""), [(1, 1), (2, 2), (3, 3)]),
        (all_(L(" ab  cd"), s.boundary("word")), [(2, 3), (6, 7)]),
        (all_(L("b😊anana"), "a"), [(3, 3), (5, 5), (7, 7)]),
        (all_(L("abc"), "z"), []),
        (all_(L(""), "z"), []),
        (all_(NULL, "z"), [(None, None)]),
        (all_(L("ab"), "x*"), [(1, 0), (2, 1), (3, 2)]),
        (s.invert_match(all_(L("a b"), " ")), [(0, 1), (3, -1)]),
        (s.invert_match(all_(L("ab"), " ")), [(0, -1)]),
    )


def test_extract(check):
    check(
        (s.str_extract(L("Stairs UP"), r"\b[a-z]{2}\b"), None),
        (s.str_extract(L("step up to it"), r"\b[a-z]{2}\b"), "up"),
        (s.str_extract(L("abc"), "(.).(.)", group=1), "a"),
        (s.str_extract(L("abc"), "(.).(.)", group=2), "c"),
        (s.str_extract(L("x.x"), s.fixed(".")), "."),
        (s.str_extract(L("ı"), TR), "ı"),
        (s.str_extract(L("xe\u0301"), s.coll("\u00e9")), "e\u0301"),
        (s.str_extract(L("a b c"), ""), "a"),
        (s.str_extract(L("a b c"), s.boundary("word")), "a"),
        (s.str_extract(L("abc"), "x*"), ""),
        (s.str_extract(NULL, "a"), None),
    )


def test_extract_all(check):
    check(
        (s.str_extract_all(L("one two three"), "[a-z]+"), ["one", "two", "three"]),
        (s.str_extract_all(L("a b c"), "[a-z]{3,}"), []),
        (s.str_extract_all(L("x.x."), s.fixed(".")), [".", "."]),
        (s.str_extract_all(L("ıI"), TR), ["ı", "I"]),
        (s.str_extract_all(L("a b c"), ""), ["a", " ", "b", " ", "c"]),
        (s.str_extract_all(L("a b c"), s.boundary("word")), ["a", "b", "c"]),
        (s.str_extract_all(NULL, "a"), [None]),
        (s.str_extract_all(L("ab"), ".", simplify=True, width=3), ["a", "b", ""]),
    )


def test_match(check):
    date = r"<([0-9]{4})/([0-9]{2})/([0-9]{2})>"
    check(
        (s.str_match(NULL, "(a)"), (None, None)),
        (s.str_match(L("a"), "."), ("a",)),
        (s.str_match(L("on <2031/07/09>"), date), ("<2031/07/09>", "2031", "07", "09")),
        (s.str_match(L("never"), date), (None,) * 4),
        (s.str_match(L("ab"), "(a)(b)?"), ("ab", "a", "b")),
        (s.str_match(L("a"), "(a)(b)?"), ("a", "a", None)),
        (s.str_match_all(L("a"), "(a)(b)?"), [("a", "a", None)]),
        (s.str_match_all(L("<2031/07/09> or <1999/12/31>"), date), [("<2031/07/09>", "2031", "07", "09"), ("<1999/12/31>", "1999", "12", "31")]),
        (s.str_match_all(L("x"), "(a)"), []),
        (s.str_match_all(NULL, "(a)"), [(None, None)]),
        (s.str_match(L("k=v"), "(?<key>.)=(?<val>.)")["val"], "v"),
    )
    for verb in (s.str_match, s.str_match_all):
        for p in (s.fixed("3"), s.coll("9")):
            with pytest.raises(TypeError):
                verb(L("x"), p)


def test_facts():
    f = lambda p: facts(s.regex(p))
    assert (f("(a)(?<n>b)").groups, f("(a)(?<n>b)").names) == (2, (None, "n"))
    assert f("(a)?").optional and f("(a)|b").optional and not f("(a)b").optional
    assert f("a*").may_be_empty and f("(?=a)").may_be_empty and f(r"\b").may_be_empty and not f("a+").may_be_empty
    assert f(r"\((a)").groups == 1 and f(r"[(](a)").groups == 1 and f("(?:a)(b)").groups == 1


def test_simplify(strings):
    df = s.simplify(strings("a-b", "c", None), s.str_split("s", "-"))
    assert [tuple(r)[2:] for r in df.orderBy("i").collect()] == [("a", "b"), ("c", ""), (None, "")]
    assert s.simplify(strings("a").where("false"), s.str_split("s", "-")).columns == ["i", "s"]


def test_collated_text(check):
    """Marks of any number, private-use characters and characters that stand for several."""
    accents = "\u0301\u0308\u0323\u0304\u0306"
    loose = s.coll("a", strength=1)
    check(
        (s.str_extract(L(f"xa{accents}y"), loose), f"a{accents}"),
        (s.str_locate(L(f"xa{accents}y"), loose), (2, 7)),
        (s.str_locate_all(L(f"a{accents}a"), loose), [(1, 6), (7, 7)]),
        (s.str_extract(L(f"pa{accents}b"), s.coll("ab", strength=1)), f"a{accents}b"),
        (s.str_count(L("a\ue000b"), s.coll("b")), 1),
        (s.str_count(L("\ue000\ue001\ue000"), s.coll("\ue000")), 2),
        (s.str_split(L("a\ue000b"), s.coll("x")), ["a\ue000b"]),
        (s.str_split(L("a\ue000xb\ue001"), s.coll("x")), ["a\ue000", "b\ue001"]),
        (s.str_locate_all(L("x\ue000x"), s.coll("x")), [(1, 1), (3, 3)]),
        (s.str_equal(L("a-b"), "ab", alternate_shifted=True), True),
        (s.str_equal(L("a-b"), "ab"), False),
        (s.str_equal(L("v07"), "v7", numeric=True), True),
        (s.str_equal(L("V07"), "v7", numeric=True, ignore_case=True), True),
        (s.str_equal(L("v07"), "v70", numeric=True), False),
        (s.str_equal(L("a"), "A", uppercase_first=True), False),
    )
    for option in ("numeric", "alternate_shifted", "french"):
        with pytest.raises(NotImplementedError, match=option):
            s.str_detect(L("x"), s.coll("x", **{option: True}))

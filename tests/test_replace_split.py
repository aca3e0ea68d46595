import pytest
from pyspark.sql import functions as F

from glyphframe import api as s
from glyphframe.functions.dialect import fix_replacement

L, NULL = F.lit, F.lit(None).cast("string")
TR = s.coll("I", ignore_case=True, locale="tr")


def test_replace(check):
    check(
        (s.str_replace_all(L("tomato"), "to", "TA"), "TAmaTA"),
        (s.str_replace_all(L("kiwi kiwi"), "wi", "WI"), "kiWI kiWI"),
        (s.str_replace(L("kiwi kiwi"), "wi", "WI"), "kiWI kiwi"),
        (s.str_replace_all(L("p7"), {"p": "7", "7": "seven"}), "sevenseven"),
        (s.str_replace_all(L("q8"), {"p": "7", "7": "seven"}), "q8"),
        (s.str_replace_all(L("m"), s.regex("M", ignore_case=True), "n"), "n"),
        (s.str_replace(L("tuv"), "u", NULL), None),
        (s.str_replace(L("tuv"), "q", NULL), "tuv"),
        (s.str_replace_na(NULL), "NA"),
        (s.str_replace(L("3+4+5"), s.fixed("+"), "-"), "3-4+5"),
        (s.str_replace_all(L("3+4+5"), s.fixed("+"), "-"), "3-4-5"),
        (s.str_replace(L("ı"), TR, "Y"), "Y"),
        (s.str_replace_all(L("kıIk"), TR, "y"), "kyyk"),
        (s.str_replace(L("ae\u0301b"), s.coll("\u00e9"), "_"), "a_b"),
        (s.str_remove_all(L("kiwi kiwi"), "wi"), "ki ki"),
        (s.str_remove(L("kiwi kiwi"), "wi"), "ki kiwi"),
        (s.str_replace(NULL, "k", "l"), None),
        (s.str_replace(L("mQnq"), s.fixed("q", ignore_case=True), "$1"), "m$1nq"),
        (s.str_replace_all(L("mQnq"), s.fixed("q", ignore_case=True), "$1"), "m$1n$1"),
        (s.str_replace(L("mn\nop"), "o(p)", r"<\1\0>"), "mn\n<pop>"),
        (s.str_replace(L("uvwuvw"), r"(v)(w)", L(r"\2\1")), "uwvuvw"),
        (s.str_replace(L("zeee"), r"(e)\1", "_"), "z_e"),
        (s.str_replace_all(L("a😊b"), "x*", "-"), "-a-😊-b-"),
        (s.str_replace_all(L("mn"), "(n?)", r"[\1$]"), "[$]m[n$][$]"),
        (s.str_extract_all(L("😊m"), "m*"), ["", "m", ""]),
        (s.replace_charclass(L("eeffg"), "[ef]", "x", merge=True), "xg"),
    )


def test_back_references(check, spark):
    """A digit after a backslash is a group; a dollar sign and a doubled backslash are themselves."""
    word = r"(p)(q)(r)"
    check(
        *[(s.str_replace_all(L("opqrs"), word, f"\\{i}"), f"o{g}s") for i, g in enumerate(("pqr", "p", "q", "r"))],
        (s.str_replace_all(L("opqrs"), word, r"\3\2\1"), "orqps"),
        (s.str_replace_all(L("opqrs"), "q", r"\\2"), r"op\2rs"),
        (s.str_replace_all(L("4%of%9"), "%", "$"), "4$of$9"),
        (s.str_replace(L("eve"), "v", "$2"), "e$2e"),
        (s.str_replace(L("eve"), "(v)", r"$\1$"), "e$v$e"),
        (s.str_replace(L("eve"), "(v)", r"\\$\1"), "e\\$ve"),
    )
    with pytest.raises(ValueError, match="group 5"):
        s.str_replace_all(L("opqrs"), word, r"\5")
    fixed = {"$": r"\$", r"\$": r"\\$", r"\3": "$3", r"\\3": r"\\3", "end\\": "end"}
    assert {k: fix_replacement(k) for k in fixed} == fixed
    with pytest.raises(TypeError):
        s.str_replace(L("o"), "o", 1)


def test_functions(check, spark):
    twice = lambda m: F.upper(F.concat(m, m))
    check(
        (s.str_replace(L("melon"), "[eo]", F.upper), "mElon"),
        (s.str_replace_all(L("melon"), "[eo]", F.upper), "mElOn"),
        (s.str_replace_all(L("melon"), "l", lambda m: L("r")), "meron"),
        (s.str_replace_all(L("one"), "o|e", twice), "OOnEE"),
        (s.str_replace_all(L(""), "o|e", twice), ""),
        (s.str_replace(L("melon"), "z", F.upper), "melon"),
        (s.str_replace(L("melon"), "$", F.upper), "melon"),
        (s.str_replace_all(L("pip"), "$|^", lambda m: L("|")), "|pip|"),
        (s.str_replace_all(L("melon"), "[eo]", s.per_batch(lambda x: x.str.upper())), "mElOn"),
        (s.str_replace_all(NULL, "e", F.upper), None),
        (s.str_replace_all(L("Ölöl"), s.coll("ö", ignore_case=True), lambda m: F.concat(L("<"), m, L(">"))), "<Ö>l<ö>l"),
        (s.str_replace(L("Ölöl"), s.coll("ö"), F.upper), "ÖlÖl"),
        (s.str_replace_all(L("e1e2"), L("e[0-9]"), F.upper), "E1E2"),
        (s.str_replace(L("e1e2"), s.fixed(L("e2")), F.upper), "e1E2"),
    )
    for bad in (lambda x: x.map(len), lambda x: x[:0]):
        with pytest.raises(Exception, match="replacement function"):
            spark.range(1).select(s.str_replace_all(L("x"), "x", s.per_batch(bad))).collect()


def test_split(check):
    check(
        (s.str_split(NULL, ""), [None]),
        (s.str_split(L("kayak"), "a"), ["k", "y", "k"]),
        (s.str_split(L("mn"), ""), ["m", "n"]),
        (s.str_split(L("soon, later."), s.boundary("word")), ["soon", "later"]),
        (s.str_split(L("p+q"), s.fixed("+")), ["p", "q"]),
        (s.str_split(L("1Z2"), s.coll("z", ignore_case=True)), ["1", "2"]),
        (s.str_split(L("1Z2z3"), s.coll("z", ignore_case=True), n=2), ["1", "2z3"]),
        (s.str_split(L("p+q"), r"\+", n=1), ["p+q"]),
        (s.str_split(L("p"), r"\+", n=4), ["p"]),
        (s.str_split(L("p+q"), r"\+", n=4), ["p", "q"]),
        (s.str_split(L("/p/"), "/"), ["", "p", ""]),
        (s.str_split(L(""), "/"), [""]),
        (s.str_split(L("pqr"), "(?=q)"), ["p", "qr"]),
        (s.str_split(L("e\u0301n"), ""), ["e\u0301", "n"]),
        (s.str_split(L("pqrs"), "", n=3), ["p", "q", "rs"]),
        (s.str_split_fixed(L("p/q"), "/", 3), ["p", "q", ""]),
        (s.str_split_fixed(L("p/q/r"), "/", 2), ["p", "q/r"]),
        (s.str_split_i(L("9/8/7"), "/", 1), "9"),
        (s.str_split_i(L("9/8/7"), "/", -1), "7"),
        (s.str_split_i(L("p"), "/", 2), None),
        (s.str_split_i(L("9/8"), "/", -3), None),
        (s.split_lines(L("p\r\nq\u2028r\x85")), ["p", "q", "r", ""]),
        (s.split_lines(L("p\nq\n"), drop_last=True), ["p", "q"]),
    )


def test_split_errors(spark, strings):
    for n in (0, -1):
        with pytest.raises(ValueError, match="`n`"):
            s.str_split(L("x"), "x", n=n)
    with pytest.raises(TypeError, match="`pattern`"):
        s.str_split(L("x"), 1)
    with pytest.raises(ValueError, match="must not be 0"):
        s.str_split_i(L("x"), "x", 0)
    with pytest.raises(ValueError, match="whole number"):
        s.str_split_i(L("x"), "x", 0.5)
    assert [r[0] for r in s.str_split_1(strings("abc"), "s", "").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="single string"):
        s.str_split_1(strings("a", "b"), "s", "")


def test_word(check):
    tide = L("low tide at dawn")
    dotted = L("v1.2..beta.3")
    check(
        (s.word(tide), "low"),
        (s.word(tide, 4), "dawn"),
        (s.word(tide, 2, 3), "tide at"),
        (s.word(tide, 5), None),
        (s.word(tide, -1), "dawn"),
        (s.word(tide, -2, -1), "at dawn"),
        (s.word(tide, -9, -1), "low tide at dawn"),
        (s.word(dotted, 1, sep=s.fixed("..")), "v1.2"),
        (s.word(dotted, 2, sep=s.fixed("..")), "beta.3"),
        (s.word(dotted, -1, sep=s.fixed("..")), "beta.3"),
        (s.word(L("xaaay"), -1, sep=s.fixed("aa")), "ay"),
        (s.word(L("p1q22r"), 2, 3, sep="[0-9]+"), "q22r"),
        (s.word(NULL), None),
        (s.word(NULL, -1), None),
    )

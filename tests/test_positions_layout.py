import pytest
from pyspark.sql import functions as F

from glyphframe import api as s
from glyphframe.functions import kernels

L, NULL, NO = F.lit, F.lit(None).cast("string"), F.lit(None).cast("int")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def test_sub(check):
    a = L(ALPHABET)
    check(
        (s.str_sub(a, 1, 3), "abc"),
        (s.str_sub(a, 24, 26), "xyz"),
        (s.str_sub(a, end=3), "abc"),
        (s.str_sub(a, 24), "xyz"),
        (s.str_sub(L("ABCDEF"), 4, -1), "DEF"),
        (s.str_sub(L("ABCDEF"), 1, -4), "ABC"),
        (s.str_sub(L("ABCDEF"), -3), "DEF"),
        (s.str_sub(L("ABCDEF"), -10, 2), "AB"),
        (s.str_sub(L("ABCDEF"), 0, 2), "AB"),
        (s.str_sub(L("ABCDEF"), -10, -9), ""),
        (s.str_sub(NULL), None),
        (s.str_sub(L("test"), NO, NO), None),
        (s.str_sub(L("abc"), 2, 1), ""),
        (s.str_sub(L("abc"), 4, 5), ""),
        (s.str_sub(L("abc"), 1, length=2), "ab"),
        (s.str_sub(L("abc"), -2, length=1), "b"),
        (s.str_sub(L("abc"), 1, length=0), ""),
        (s.str_sub(L("x😊yz"), 2, 3), "😊y"),
        (s.str_sub_all(L("abc"), [(1, 1), (2, 2)]), ["a", "b"]),
        (s.str_sub_all(L("def"), [(1, 2)]), ["de"]),
    )


def test_sub_replace(check, spark):
    r = s.str_sub_replace
    check(
        (r(L("BBCDEF"), 1, 1, "A"), "ABCDEF"),
        (r(L("ABCDEF"), -1, -1, "K"), "ABCDEK"),
        (r(L("ABCDEK"), -2, -1, "EFGH"), "ABCDEFGH"),
        (r(L("ABCDEFGH"), 2, -2, ""), "AH"),
        (r(L("BBCDEF"), NO, -1, "A"), None),
        (r(L("BBCDEF"), NO, -1, "A", omit_na=True), "BBCDEF"),
        (r(L("BBCDEF"), 1, 1, NULL, omit_na=True), "BBCDEF"),
        (r(L("abc"), 3, 1, "+"), "ab+c"),
        (s.str_sub_replace_all(L("abcdef"), [(1, 1), (3, 4)], ["<", ">"]), "<b>ef"),
    )
    with pytest.raises(Exception, match="sorted"):
        spark.range(1).select(s.str_sub_replace_all(L("abcdef"), [(3, 4), (1, 1)], ["<", ">"])).collect()


def test_trunc(check):
    x = L("This string is moderately long")
    t = s.str_trunc
    pairs = [(t(NULL, 5), None), (t(L("foobar"), 5), "fo..."), (t(L("abcde"), 5), "abcde"), (t(L("abcdef"), 5), "ab...")]
    for side, wanted in {
        "right": {20: "This string is mo...", 3: "...", 4: "T...", 5: "Th..."},
        "left": {20: "...s moderately long", 3: "...", 4: "...g", 5: "...ng"},
        "center": {20: "This stri...ely long", 3: "...", 4: "T...", 5: "T...g"},
    }.items():
        pairs += [(t(x, w, side), out) for w, out in wanted.items()]
    for w, side, out in ((4, "right", "aa.."), (4, "left", "..aa"), (4, "center", "a..a"), (3, "center", "a.."), (2, "left", "..")):
        pairs.append((t(L("aaaaaaa"), w, side, ".."), out))
    check(*pairs)
    for args in ((2,), (3, "right", "....")):
        with pytest.raises(ValueError, match="shorter"):
            t(L("foobar"), *args)


def test_width_rules(check):
    """Columns by the rule: other symbols are two, whatever the block; a joiner joins emoji only; flags are pairs."""
    widths = {
        "©": 2, "®": 2, "°": 2, "─│┌": 6, "■": 2, "★": 2, "™": 2, "§": 1, "±": 1, "…": 1, "€": 1, "ß": 1, "\u00ad": 1, "\u200b": 0,
        "e\u0301": 1, "ﾊ": 1, "ハ": 2, "한": 2, "\u1112\u1161\u11ab": 2, "👩\u200d💻": 2, "\u200d©": 2, "❤\ufe0f": 2, "👍🏽": 2, "🏽": 0,
        "🇩🇪": 2, "🇩🇪🇫🇷": 4, "🇩": 2, "🇩🇪🇫": 4, "🏴\u200d☠\ufe0f": 2, "\tx\x7f": 1, "x\u200d": 1,
    }
    check(*[(s.str_width(L(t)), n) for t, n in widths.items()], (s.str_pad(L("©"), 4, "right", "."), "©.."), (s.str_pad(L("°C"), 6, "both", "-"), "-°C--"))


def test_length_width(check):
    check(
        (s.str_length(L("abc")), 3),
        (s.str_length(NULL), None),
        (s.str_length(L("a😊e\u0301")), 4),
        (s.str_width(L("\u0308")), 0),
        (s.str_width(L("x")), 1),
        (s.str_width(L("\U0001f60a")), 2),
        (s.str_width(L("中")), 2),
        (s.str_width(L("a\tb")), 2),
        (s.str_width(L("\u00ad")), 1),
        (s.str_width(L("\u200b")), 0),
        (s.str_width(L("\U0001f468\u200d\U0001f469")), 2),
        (s.str_width(L("\U0001f1eb\U0001f1f7")), 2),
        (s.str_width(NULL), None),
        (s.str_reverse(L("a😊b")), "b😊a"),
    )


def test_pad(check):
    check(
        (s.str_pad(L("had"), 10, "right"), "had       "),
        (s.str_pad(L("had"), 10, "left"), "       had"),
        (s.str_pad(L("had"), 10, "both"), "   had    "),
        (s.str_pad(L("中"), 6, "both"), "  中  "),
        (s.str_pad(L("中"), 5, "both", use_width=False), "  中  "),
        (s.str_pad(L(ALPHABET), 3), ALPHABET),
        (s.str_pad(L("a"), 3, "left", "."), "..a"),
        (s.str_pad(NULL, 3), None),
    )
    for bad in ("", "ab"):
        with pytest.raises(ValueError, match="`pad`"):
            s.str_pad(L("a"), 3, pad=bad)
    with pytest.raises(ValueError, match="`side`"):
        s.str_pad(L("a"), 3, side="top")


def test_trim_squish_dup(check):
    check(
        (s.str_trim(L("  abc   ")), "abc"),
        (s.str_trim(L("\tabc\t")), "abc"),
        (s.str_trim(L(" abc "), "left"), "abc "),
        (s.str_trim(L(" abc "), "right"), " abc"),
        (s.str_trim(L("\u00a0\u2003abc\u0085")), "abc"),
        (s.str_trim(L("\u200babc")), "\u200babc"),
        (s.str_squish(L("ab\t\tc\t")), "ab c"),
        (s.str_squish(L("\ta\t bc\t")), "a bc"),
        (s.str_dup(L("a"), 3), "aaa"),
        (s.str_dup(L("a"), 0), ""),
        (s.str_dup(L("abc"), 1, sep="-"), "abc"),
        (s.str_dup(L("abc"), 2, sep="-"), "abc-abc"),
        (s.str_dup(NULL, 2, sep="-"), None),
        (s.str_dup(L("a"), NO, sep="-"), None),
        (s.str_dup(L("a"), -1, sep="-"), None),
        (s.str_dup(L("a"), -1), None),
    )
    with pytest.raises(TypeError, match="`sep`"):
        s.str_dup(L("a"), 3, sep=1)


def test_wrap(check):
    letters = " ".join(ALPHABET)
    check(
        (s.str_wrap(L("")), ""),
        (s.str_wrap(L(" ")), ""),
        (s.str_wrap(L("  a  ")), "a"),
        (s.str_wrap(L(letters), 0), "\n".join(ALPHABET)),
        (s.str_wrap(L("a/b"), 0), "a/b"),
        (s.str_wrap(L("a/b"), 0, whitespace_only=False), "a/\nb"),
        (s.str_wrap(L("aa bb cc"), 5, indent=1, exdent=2), " aa\n  bb\n  cc"),
        (s.str_wrap(NULL), None),
    )


@pytest.mark.parametrize("seed", range(20))
def test_wrap_is_best(seed):
    """Against all ways to break a short text."""
    import itertools
    import random

    r = random.Random(seed)
    words, room = ["x" * r.randint(1, 6) for _ in range(7)], r.randint(6, 12)

    def cost(lines):
        sizes = [len(" ".join(x)) for x in lines]
        return None if any(n > room for n in sizes) else sum((room - n) ** 2 for n in sizes[:-1])

    options = []
    for cuts in itertools.product((0, 1), repeat=6):
        lines, now = [], [words[0]]
        for c, w in zip(cuts, words[1:]):
            if c:
                lines.append(now)
                now = [w]
            else:
                now.append(w)
        options.append(cost([*lines, now]))
    got = kernels.fill(" ".join(words), room, 0, 0, True).split("\n")
    assert cost([x.split(" ") for x in got]) == min(x for x in options if x is not None)


def test_segments():
    words = lambda t: [t[a:b] for a, b in kernels.segments(t, "word", frozenset({"none"}))]
    assert words("Don't stop-here, 3.5 kg! foo_bar") == ["Don't", "stop", "here", "3.5", "kg", "foo_bar"]
    assert words("中文 test") == ["中", "文", "test"]
    for kind in kernels.SEGMENTERS:
        t = "Hello there, world. How are you? \r\n Fine (thanks)! 1,000.5 x/y"
        assert "".join(t[a:b] for a, b in kernels.segments(t, kind, frozenset())) == t
    sentences = lambda t: [t[a:b] for a, b in kernels.segments(t, "sentence", frozenset())]
    assert sentences("One two. Three 3.5 four! Five") == ["One two. ", "Three 3.5 four! ", "Five"]
    assert sentences("a.b said e.g. this.") == ["a.b said e.g. this."]

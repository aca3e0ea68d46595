"""Boundaries against ICU's own iterators, which Spark brings along in the JVM."""

import random

import duckdb
import pytest

from glyphframe import api as s
from glyphframe.functions import boundaries, kernels

#: No Han, Hiragana or Thai, which ICU takes from dictionaries.
ALPHABET = list("aabZ12 .,!?:;'\"()[]-/$%\n\r\t_&é́‍😀👍🏽🇫🇷שק한국각カア「」、。…—‘’“”«» ‐​ ǅß٣+€™⁠~|#*")
WORD = {0: "none", 100: "number", 200: "letter", 300: "kana", 400: "ideo"}
KINDS = {
    "Word": (boundaries.words, WORD.get),
    "Sentence": (boundaries.sentences, lambda x: "term" if x < 100 else "sep"),
    "Line": (boundaries.line_breaks, lambda x: "soft" if x < 100 else "hard"),
}


def by_icu(spark, kind, locale, texts):
    icu = spark._jvm.com.ibm.icu
    breaks = getattr(icu.text.BreakIterator, f"get{kind}Instance")(icu.util.ULocale(locale))
    for t in texts:
        breaks.setText(t)
        units, out, a = t.encode("utf-16-le"), [], breaks.first()
        while (b := breaks.next()) >= 0:
            out.append((units[2 * a : 2 * b].decode("utf-16-le", "surrogatepass"), breaks.getRuleStatus()))
            a = b
        yield t, out


@pytest.fixture(scope="module")
def samples():
    r = random.Random(29)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 12))) for _ in range(1500)]
    table = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 25").fetchall()
    return made + [t[:1500] for (t,) in table]


@pytest.mark.parametrize("kind", KINDS)
def test_as_icu(spark, samples, kind):
    find, label = KINDS[kind]
    for t, want in by_icu(spark, kind, "en", samples):
        assert [(t[a:b], c) for a, b, c in find(t)] == [(x, label(n)) for x, n in want], t


def test_greek_sentences(spark):
    texts = ["Τι; Ναι. Όχι; Καλά", "a; B;; c", "a;b"]
    for t, want in by_icu(spark, "Sentence", "el", texts):
        assert [t[a:b] for a, b, _ in boundaries.greek_sentences(t)] == [x for x, _ in want], t


def test_without_dictionaries():
    assert [x[:2] for x in boundaries.words("漢字かな")] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert boundaries.words("") == boundaries.sentences("") == boundaries.line_breaks("") == []


def test_breaks_after_spaces(samples):
    for t in samples:
        ends = [b for _, b, _ in boundaries.line_breaks(t) if t[b - 1] in boundaries.WHITE or b == len(t)]
        assert [x for x in boundaries.space_breaks(t) if t[x - 1 : x] not in tuple("\n\r\u2028")] == [x for x in ends if t[x - 1 : x] not in tuple("\n\r\u2028")], t


def test_wrap_breaks_as_lines_may(samples):
    """Printable ASCII is split by a pattern of its own: the pieces are those of the full rules."""
    for t in samples:
        t = "".join(c if " " <= c < "\x7f" else " " for c in t).strip()
        t = " ".join(t.split())
        if t:
            words = kernels._ASCII_BREAK.split(t)
            stops = boundaries.space_breaks(t)
            assert words == [t[a:b].rstrip(" ") for a, b in zip([0, *stops], stops)], t


def every_way(words, columns, indent, exdent):
    """Least cost of all ways to break, a line a cost, the last one free."""
    best = None
    for cuts in range(1 << (len(words) - 1)):
        lines, now = [], [words[0]]
        for k, w in enumerate(words[1:]):
            if cuts >> k & 1:
                lines.append(now)
                now = [w]
            else:
                now.append(w)
        lines.append(now)
        cost = 0
        for k, line in enumerate(lines):
            left = columns - (exdent if k else indent) - len(" ".join(line))
            if left < 0 and len(line) > 1:
                break
            cost += 0 if left < 0 or k == len(lines) - 1 else left * left
        else:
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_fill_is_best(seed):
    """Indents and words longer than a line included."""
    r = random.Random(seed)
    words = ["x" * r.choice((1, 2, 3, 5, 8, 14)) for _ in range(r.randrange(1, 11))]
    columns, indent, exdent = r.randint(4, 18), r.randint(0, 4), r.randint(0, 4)
    lines = kernels.fill(" ".join(words), columns, indent, exdent, True).split("\n")
    assert " ".join(x.strip(" ") for x in lines) == " ".join(words)
    cost = 0
    for k, line in enumerate(lines):
        assert len(line) <= columns or " " not in line.strip(" ")
        cost += 0 if k == len(lines) - 1 else max(0, columns - len(line)) ** 2
    assert cost == every_way(words, columns, indent, exdent)


def test_fill_rules():
    assert kernels.fill("why ? ( yes ) no", 4, 0, 0, True) == "why ?\n( yes )\nno"
    assert kernels.fill("a\u3000b\u00a0c \u00a0", 1, 0, 0, True) == "a\nb\u00a0c"
    assert kernels.fill("漢字 語", 2, 0, 0, False) == "漢\n字\n語" and kernels.fill("漢字 語", 2, 0, 0, True) == "漢字\n語"
    assert kernels.fill("\ufeffe\u0301 \r\n\t b", 9, 0, 0, True) == "\u00e9 b"
    assert kernels.fill("a a a a a xxxxx", 5, 0, 0, True) == "a a\na a a\nxxxxx"  # two equal ways


def test_count_in_the_jvm(spark, samples):
    """Latin text is counted by a pattern: as many words as the segments say."""
    r = random.Random(7)
    made = ["".join(r.choice("ab1 2_.,:;'\"-éß×\n\t\x01") for _ in range(r.randrange(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in made + samples], "t string").select("t", s.str_count("t", s.boundary("word")).alias("n")).collect()
    for t, n in rows:
        assert n == sum(c != "none" for _, _, c in boundaries.words(t)), t


def test_verbs(spark):
    row = spark.createDataFrame([("Τι; Ναι カタ 3.5",)], "t string").select(
        s.str_split("t", s.boundary("sentence", locale="el_GR")).alias("el"),
        s.str_split("t", s.boundary("sentence")).alias("en"),
        s.str_extract_all("t", s.boundary("word", skip_word_ideo=True)).alias("w"),
        s.str_count("t", s.boundary("line_break")).alias("n"),
    )
    assert tuple(row.first()) == (["Τι; ", "Ναι カタ 3.5"], ["Τι; Ναι カタ 3.5"], ["Τι", "Ναι", "3.5"], 5)  # カ and タ are two pieces of a line

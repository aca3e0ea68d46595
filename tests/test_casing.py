"""Case mapping by locale against ICU's own, which Spark brings along in the JVM."""

import random

import pytest

from glyphframe import api as s

LETTERS = list("ᾳήϊΐάοιηυ iIjJįĮÌÍĨìaBΣσςΑ .!?\n1ijİıSß") + list("\u0307\u0300\u0301\u0323\u0303") + ["ǆ", "😀", "(", "€"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(8)
    rows = ["".join(r.choice(LETTERS) for _ in range(r.randrange(1, 9))) for _ in range(1500)]
    rows += ["", "One two. three FOUR? 2 five! «six» (ok).", "IJSSEL ijs. íj\u0301 a", "ΆΛΛΟ Ή ΟΧΙ; ναι", "ᾠδή μαΐου άυ\u0300"]
    return spark.createDataFrame([(t,) for t in rows], "t string").cache()


@pytest.mark.parametrize("locale", ["en", "tr", "az", "lt", "nl", "el", "lt_LT"])
def test_as_icu(spark, texts, locale):
    icu = spark._jvm.com.ibm.icu
    own, u = icu.util.ULocale(locale), icu.lang.UCharacter
    sentences = icu.text.BreakIterator.getSentenceInstance(own)
    for r in texts.select("t", s.str_to_upper("t", locale), s.str_to_lower("t", locale), s.str_to_title("t", locale), s.str_to_sentence("t", locale)).collect():
        t = r[0]
        want = [u.toUpperCase(own, t), u.toLowerCase(own, t), u.toTitleCase(own, t, None), u.toTitleCase(own, t, sentences)]
        assert list(r[1:]) == want, t


def test_null(check):
    from pyspark.sql import functions as F

    null = F.lit(None).cast("string")
    check(*[(verb(null, x), None) for verb in (s.str_to_upper, s.str_to_lower, s.str_to_title, s.str_to_sentence) for x in ("en", "lt", "nl", "el", "tr")])

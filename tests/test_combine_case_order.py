import pytest
from pyspark.sql import functions as F

from glyphframe import api as s
from glyphframe.operators import ordering
from glyphframe.operators.encoding import charset
from glyphframe.streaming.text import stream_counts, stream_unique, surrogate_key

L, NULL = F.lit, F.lit(None).cast("string")


def test_c(check):
    check(
        (s.str_c(L("a"), "b", None, L("c")), "abc"),
        (s.str_c(L("a"), L("b"), sep="-"), "a-b"),
        (s.str_c(L("a"), NULL, sep="-"), None),
        (s.str_c(L("a"), NULL, "b", sep="-", ignore_null=True), "a-b"),
        (s.str_c(), ""),
        (s.str_c("x", L(1)), "x1"),
    )


def test_flatten(strings):
    one = lambda df, c: df.agg(c).first()[0]
    abc = strings("a", "b", "c")
    f = lambda *a, **k: s.str_flatten("s", *a, order_by="i", **k)
    assert one(abc, f()) == "abc"
    assert one(abc, f(", ", ", and ")) == "a, b, and c"
    assert one(strings("a", "b"), f(", ", ", and ")) == "a, and b"
    assert one(strings("a"), f(", ", ", and ")) == "a"
    assert one(strings("a", None), f()) is None
    assert one(strings("a", None), f(na_rm=True)) == "a"
    assert one(strings("a", None, "b"), f("-", na_empty=True)) == "a--b"
    assert one(abc.where("false"), f()) == ""
    comma = lambda *a: s.str_flatten_comma("s", *a, order_by="i")
    assert one(strings("a", "b"), comma(", or ")) == "a or b"
    assert one(abc, comma(", or ")) == "a, b, or c"
    assert one(abc, comma(" or ")) == "a, b or c"
    assert one(abc, comma()) == "a, b, c"
    with pytest.raises(ValueError, match="order_by"):
        s.str_flatten("s")
    with pytest.raises(TypeError):
        s.str_flatten("s", ["a", "b"], order_by="i")


def test_templates(check, spark):
    check(
        (s.str_glue("a {b}", b="b"), "a b"),
        (s.str_glue("{1 + 1} {{x}} {upper('q')}"), "2 {x} Q"),
        (s.str_glue("v {x}", x=NULL), "v NA"),
        (s.str_glue("v {x}", x=NULL, na=None), None),
        (s.str_glue("L1\t \n  \tL2"), "L1\t \nL2"),
        (s.str_glue("L1\t \n  \tL2", trim=False), "L1\t \n  \tL2"),
        (s.str_interp("${fruit}: $[d]{n} for $[.1f]{price}", fruit="plums", n=12, price=3.449), "plums: 12 for 3.4"),
        (s.str_interp("from ${low} to ${high}", low=5, high=L(5) * 6), "from 5 to 30"),
        (s.str_interp("} and { stay, $[.2f]{{{1 + 2} * {2.5D}}}"), "} and { stay, 7.50"),
        (s.str_interp("nothing to fill in"), "nothing to fill in"),
    )
    for bad in ("${${inner}}", "$[.1f]{${inner}}", "${}"):
        with pytest.raises(ValueError, match="Invalid template"):
            s.str_interp(bad)
    with pytest.raises(TypeError):
        s.str_interp(3)
    with pytest.raises(Exception):
        spark.range(1).select(s.str_interp("sum: ${2 *}")).collect()


def test_case(check):
    check(
        (s.str_to_upper(L("This ß")), "THIS SS"),
        (s.str_to_lower(L("This")), "this"),
        (s.str_to_upper(L("i"), "tr"), "İ"),
        (s.str_to_lower(L("I"), "tr"), "ı"),
        (s.str_to_title(L("this is don't stop-here")), "This Is Don't Stop-Here"),
        (s.str_to_title(L("ijs in ijmuiden, bij"), "nl"), "IJs In IJmuiden, Bij"),
        (s.str_to_upper(L("μάιος ήλιος ή άυλος ρολόι"), "el"), "ΜΑΪΟΣ ΗΛΙΟΣ Ή ΑΫΛΟΣ ΡΟΛΟΪ"),
        (s.str_to_upper(L("straße"), "el"), "STRASSE"),
        (s.str_to_lower(L("ΟΔΟΣ"), "el"), "οδος"),
        (s.str_to_sentence(L("a Test")), "A test"),
        (s.str_to_sentence(L("the dog. THE CAT")), "The dog. The cat"),
        (s.str_to_camel(L("row_count")), "rowCount"),
        (s.str_to_camel(L("row%count")), "rowCount"),
        (s.str_to_camel(L(" row    count  ")), "rowCount"),
        (s.str_to_camel(L("row_count"), first_upper=True), "RowCount"),
        *[
            (verb(L(x)), out.replace("_", sep))
            for verb, sep in ((s.str_to_snake, "_"), (s.str_to_kebab, "-"), (s.to_words, " "))
            for x, out in {
                "rowCount": "row_count", "RowCount": "row_count", "2RowCount3": "2_row_count_3", "Row%Count": "row_count",
                " Row   Count  ": "row_count", "readXMLFile": "read_xml_file", "größeÄndern": "größe_ändern", "URL": "url", "v10beta": "v_10_beta",
            }.items()
        ],
    )
    with pytest.raises(TypeError):
        s.str_to_upper(L("i"), None)


def test_order(strings):
    places = lambda df, n: [r[n] for r in df.orderBy("i").collect()]
    x = strings("2", "1", "10")
    assert places(s.str_order(x, "s", "i"), "order") == [3, 1, 2]
    assert places(s.str_order(x, "s", "i", numeric=True), "order") == [2, 1, 3]
    assert places(s.str_rank(x, "s", "i"), "rank") == [3, 1, 2]
    assert places(s.str_rank(x, "s", "i", numeric=True), "rank") == [2, 1, 3]
    assert [r["s"] for r in s.str_sort(x, "s", "i").collect()] == ["1", "10", "2"]
    assert [r["s"] for r in s.str_sort(x, "s", "i", numeric=True).collect()] == ["1", "2", "10"]
    assert [r["s"] for r in s.str_sort(x, "s", "i", decreasing=True).collect()] == ["2", "10", "1"]
    gap = strings("2", "1", None, "10")
    assert [r["s"] for r in s.str_sort(gap, "s", "i", numeric=True).collect()] == ["1", "2", "10", None]
    assert [r["s"] for r in s.str_sort(gap, "s", "i", numeric=True, na_last=False).collect()] == [None, "1", "2", "10"]
    assert [r["s"] for r in s.str_sort(gap, "s", "i", na_last=None).collect()] == ["1", "10", "2"]
    assert places(s.str_rank(strings("b", "a", "b", None, "c"), "s", "i"), "rank") == [2, 1, 2, None, 4]
    assert [r["s"] for r in s.str_sort(strings("2b", "100a10", "2a", "100a5"), "s", "i", numeric=True).collect()] == ["2a", "2b", "100a5", "100a10"]
    assert [r["s"] for r in s.str_sort(strings("b", "A", "a", "B"), "s", "i").collect()] == ["a", "A", "b", "B"]
    assert [r["s"] for r in s.str_sort(strings("b", "A", "a", "B"), "s", "i", uppercase_first=True).collect()] == ["A", "a", "B", "b"]


def test_rank_of_many(spark, monkeypatch):
    """Against sorting in Python, with the ranks broadcast and joined."""
    rows = [(i, None if i % 11 == 0 else f"k{(i * 37) % 23:02d}") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s string").repartition(5)
    texts = sorted(t for _, t in rows if t is not None)
    want = {i: None if t is None else texts.index(t) + 1 for i, t in rows}
    for bound in (200_000, 0):
        monkeypatch.setattr(ordering, "BROADCAST_ROWS", bound)
        assert {r["i"]: r["rank"] for r in s.str_rank(df, "s", "i").collect()} == want
    assert s.str_rank(df.where("false"), "s", "i").count() == 0
    assert {r["i"]: r["s"] for r in s.str_rank(df, "s", "i", name="s").collect()}.keys() == want.keys()


def test_which_shuffles_keys_only(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", "long " * 50) for i in range(40)], "i int, s string, body string")
    assert sorted(r["index"] for r in s.str_which(df, "s", "t3", "i").collect()) == [i + 1 for i in range(40) if i % 7 == 3]


def test_equality_options(strings):
    firsts = lambda df: sorted((r["i"], r["s"]) for r in df.collect())
    assert firsts(s.str_unique(strings("a b", "ab", "c"), "s", "i", alternate_shifted=True)) == [(1, "a b"), (3, "c")]
    assert firsts(s.str_unique(strings("x9", "x09", "x90"), "s", "i", numeric=True)) == [(1, "x9"), (3, "x90")]


def test_unique(strings):
    firsts = lambda df: sorted((r["i"], r["s"]) for r in df.collect())
    assert firsts(s.str_unique(strings("a", "a", "a"), "s", "i")) == [(1, "a")]
    assert firsts(s.str_unique(strings(None, None), "s", "i")) == [(1, None)]
    assert firsts(s.str_unique(strings("a", "A", "b"), "s", "i", ignore_case=True)) == [(1, "a"), (3, "b")]
    again = s.str_duplicated(strings("a", "b", "a", None, None), "s", "i").orderBy("i").collect()
    assert [r["duplicated"] for r in again] == [False, False, True, False, True]


def test_encodings(check, spark):
    check(
        (s.str_conv(F.unhex(L("B1")), "latin1"), "±"),
        (s.str_conv(F.unhex(L("A1")), "iso-8859-2"), "Ą"),
        (s.str_conv(F.unhex(L("82A0")), "shift_jis"), "あ"),
        (s.str_conv(F.unhex(L("61FF")), "UTF-8"), "a�"),
        (s.str_encode(L("Ą"), "iso-8859-2"), bytearray(b"\xa1")),
        (s.trans_nfc(L("e\u0301")), "é"),
        (s.str_escape(L(".^$|*+?{}[]()")), "\\.\\^\\$\\|\\*\\+\\?\\{\\}\\[\\]\\(\\)"),
        (s.str_escape(L("\\")), "\\\\"),
        (s.escape_unicode(L("a\u00a0\n\t\"'\\")), "a\\u00a0\\n\\t\\\"\\'\\\\"),
        (s.escape_unicode(L("😊")), "\\U0001f60a"),
        (s.escape_unicode(NULL), None),
    )
    assert charset("latin1") == "iso8859-1" and s.enc_get() == "utf-8"
    info = s.enc_info("latin1")
    assert info["single_byte"] and info["ascii_superset"] and "latin_1" in info["aliases"]
    with pytest.raises(TypeError):
        s.str_conv(L("A"), ["ISO-8859-1", "ISO-8859-2"])
    with pytest.raises(LookupError):
        s.str_conv(L("A"), "no-such-charset")


def test_view(strings):
    x = strings("abc", "def", "fgh")
    assert str(s.str_view(x, "s", "[aeiou]", "i")) == "[1] | <a>bc\n[2] | d<e>f"
    assert str(s.str_view(x, "s", "d|e", "i")) == "[2] | <d><e>f"
    assert s.str_view(x, "s", "d|e", "i", html=True).html() == "<ul>\n  <li><pre><span class='match'>d</span><span class='match'>e</span>f</pre></li>\n</ul>"
    y = strings("abc", "def", "fgh", None)
    assert [s.str_view(y, "s", "d|e", "i", match=m).rows.count() for m in (None, True, False)] == [4, 1, 3]
    odd = strings(" ", "\u00a0", "\n", "\t")
    assert s.str_view(odd, "s", order_by="i").lines() == ["[1] |  ", "[2] | {\\u00a0}", "[3] | ", "    | ", "[4] | {\\t}"]
    assert s.str_view(odd, "s", order_by="i", use_escapes=True).lines() == ["[1] |  ", "[2] | \\u00a0", "[3] | \\n", "[4] | \\t"]
    assert s.str_view(x.where("false"), "s", order_by="i").lines() == ["x Empty `string` provided."]
    many = s.str_view(strings(*"abcdefghijklmnopqrstuvwxyz"), "s", order_by="i").lines(5)
    assert many[0] == "[1] | a" and many[-1] == "... and 21 more"
    with pytest.warns(DeprecationWarning):
        assert str(s.str_view_all(strings("abc"), "s", "a|b", "i")) == "[1] | <a><b>c"


def test_read_lines(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_bytes("\ufeffa\r\nb\u2028c\x85\n\nd\u2029".encode() + b"\xff\n")
    got = s.str_read_lines(spark, str(p)).orderBy("line_no").collect()
    assert [r["line"] for r in got] == ["a", "b", "c", "", "", "d", "�"]
    assert [r["line_no"] for r in got] == list(range(1, 8))
    (tmp_path / "l.txt").write_bytes(b"\xb1\n")
    assert [r["line"] for r in s.read_lines(spark, str(tmp_path / "l.txt"), "latin1").collect()] == ["±"]
    assert s.read_raw(spark, str(p)).first()["content"][:3] == b"\xef\xbb\xbf"
    (tmp_path / "e.txt").write_bytes(b"")
    assert s.read_lines(spark, str(tmp_path / "e.txt")).count() == 0
    (tmp_path / "s.txt").write_bytes("a\nb\u2028c\n".encode())
    assert sorted(r["line"] for r in s.scan_lines(spark, str(tmp_path / "s.txt")).collect()) == ["a", "b", "c"]
    with pytest.raises(Exception):
        s.read_lines(spark, str(tmp_path / "missing.txt")).collect()


def test_streaming(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a\u0301 x"), ("2024-01-01 00:01:00", "á x"), ("2024-01-01 00:02:00", "b")]
    spark.createDataFrame(rows, "t string, s string").selectExpr("cast(t as timestamp) ts", "s").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("ts timestamp, s string").parquet(str(tmp_path / "in"))

    def collected(stream, name):
        q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    words = source().select(s.str_count("s", s.boundary("word")).alias("n"), s.str_detect("s", "x").alias("hit"), s.str_to_title("s").alias("title"))
    assert sorted((r["n"], r["hit"]) for r in collected(words, "w")) == [(1, False), (2, True), (2, True)]
    assert len(collected(stream_unique(source(), "s", "ts"), "u")) == 2
    assert isinstance(collected(stream_counts(source(), "s", "ts"), "c"), list)
    assert spark.range(1).select(surrogate_key(L("E\u0301"), ignore_case=True)).first()[0] == "é"

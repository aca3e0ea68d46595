"""Registered queries of the string engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphframe import api as s
from glyphframe.functions.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _verb(name: str, table: str, key: str | tuple[str, ...], build: Callable[[], dict[str, Column]], sql: dict[str, str] | None) -> None:
    """Register a query of row-wise verbs: key columns and computed ones."""
    keys = (key,) if isinstance(key, str) else key

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, table).select(*keys, *[c.alias(n) for n, c in build().items()])

    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = f"SELECT {', '.join(keys)}, {', '.join(f'{x} AS {n}' for n, x in sql.items())} FROM {table}"


def _query(name: str, sql: str | None = None):
    """Register a query of its own form."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def _spans(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


PART, DOC, PAGE, CUST = ("part", "p_partkey"), ("documents", "doc_id"), ("pages", "page_id"), ("customer", "c_custkey")

# Detection

_verb("detect_regex", *DOC, lambda: {"hit": s.str_detect("text", r"[0-9]{3}"), "none": s.str_detect("text", "[0-9]{3}", negate=True)},
      {"hit": "regexp_matches(text, '[0-9]{3}')", "none": "NOT regexp_matches(text, '[0-9]{3}')"})
_verb("detect_regex_flags", *DOC, lambda: {"hit": s.str_detect("text", s.regex("LICENSE.+public", ignore_case=True)), "line": s.str_detect("text", s.regex("^the ", ignore_case=True, multiline=True))},
      {"hit": "regexp_matches(text, '(?i)LICENSE.+public')", "line": "regexp_matches(text, '(?im)^the ')"})
_verb("detect_fixed", *DOC, lambda: {"hit": s.str_detect("text", s.fixed("License,")), "any_case": s.str_detect("text", s.fixed("LICENSE", ignore_case=True))},
      {"hit": "contains(text, 'License,')", "any_case": "contains(upper(text), 'LICENSE')"})
_verb("detect_coll", *PART, lambda: {"hit": s.str_detect("p_name", s.coll("RING", ignore_case=True)), "exact": s.str_detect("p_name", s.coll("RING"))},
      {"hit": "contains(lower(p_name), 'ring')", "exact": "contains(p_name, 'RING')"})
_verb("starts_regex", *PART, lambda: {"hit": s.str_starts("p_name", "red|small"), "other": s.str_starts("p_name", "red|small", negate=True)},
      {"hit": "regexp_matches(p_name, '^(red|small)')", "other": "NOT regexp_matches(p_name, '^(red|small)')"})
_verb("starts_fixed_coll", *PART, lambda: {"fixed": s.str_starts("p_name", s.fixed("small")), "coll": s.str_starts("p_name", s.coll("SMALL", ignore_case=True))},
      {"fixed": "starts_with(p_name, 'small')", "coll": "starts_with(lower(p_name), 'small')"})
_verb("ends_verbs", *PART, lambda: {"regex": s.str_ends("p_name", "ring|widget"), "fixed": s.str_ends("p_name", s.fixed("ring")), "coll": s.str_ends("p_name", s.coll("RING", ignore_case=True))},
      {"regex": "regexp_matches(p_name, '(ring|widget)$')", "fixed": "ends_with(p_name, 'ring')", "coll": "ends_with(lower(p_name), 'ring')"})
_verb("like_ilike", *PART, lambda: {"plain": s.str_like("p_name", "%r_ng"), "upper": s.str_like("p_name", "%RING"), "any_case": s.str_ilike("p_name", "%RING")},
      {"plain": "p_name LIKE '%r_ng'", "upper": "p_name LIKE '%RING'", "any_case": "p_name ILIKE '%RING'"})
_verb("detect_column_pattern", "orders", "o_orderkey", lambda: {"hit": s.str_detect("o_orderpriority", s.fixed(F.col("o_orderstatus")))},
      {"hit": "contains(o_orderpriority, o_orderstatus)"})
_verb("equal_collation", "lineitem", ("l_orderkey", "l_linenumber"), lambda: {"same": s.str_equal("l_returnflag", F.col("l_linestatus")), "any_case": s.str_equal(F.lower("l_returnflag"), F.col("l_linestatus"), ignore_case=True)},
      {"same": "l_returnflag = l_linestatus", "any_case": "lower(l_returnflag) = lower(l_linestatus)"})


@_query("subset", "SELECT doc_id, lang FROM documents WHERE contains(text, 'License')")
def _subset(spark, sf_dir):
    return s.str_subset(_table(spark, sf_dir, "documents"), "text", s.fixed("License")).select("doc_id", "lang")


@_query("which", "SELECT i AS \"index\" FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS i FROM part) WHERE contains(p_name, 'ring')")
def _which(spark, sf_dir):
    return s.str_which(_table(spark, sf_dir, "part"), "p_name", "ring", order_by="p_partkey")


@_query("collation_join", "SELECT a.n_nationkey, b.r_regionkey FROM nation a JOIN region b ON lower(a.n_name) = 'nation_' || b.r_regionkey")
def _collation_join(spark, sf_dir):
    a, b = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    name = F.concat(F.lit("nation_"), F.col("r_regionkey").cast("string"))
    return a.join(b, s.str_equal("n_name", name, ignore_case=True)).select("n_nationkey", "r_regionkey")


# Counting and locating

_verb("count_regex", *DOC, lambda: {"n": s.str_count("text", "[aeiou]"), "words": s.str_count("text", r"[^\s]+")},
      {"n": "len(regexp_extract_all(text, '[aeiou]'))::INT", "words": r"len(regexp_extract_all(text, '[^\s]+'))::INT"})
_verb("count_fixed", *DOC, lambda: {"n": s.str_count("text", s.fixed("the")), "over": s.str_count("text", s.fixed("nn", overlap=True))},
      {"n": "((length(text) - length(replace(text, 'the', ''))) / 3)::INT", "over": "len(list_filter(generate_series(1, length(text)), lambda i: substring(text, i, 2) = 'nn'))::INT"})
_verb("count_coll", *PART, lambda: {"n": s.str_count("p_name", s.coll("E", ignore_case=True))}, {"n": "(length(p_name) - length(replace(lower(p_name), 'e', '')))::INT"})
_verb("count_characters", *DOC, lambda: {"n": s.str_count("text", "")}, {"n": "length_grapheme(text)::INT"})
_verb("count_words", *DOC, lambda: {"n": s.str_count(F.regexp_replace("text", "[^A-Za-z\u00c0-\u024f \n]", " "), s.boundary("word"))}, {"n": r"len(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{024F}]+'))::INT"})
_verb("coll_marks", *PART, lambda: {"found": s.str_extract(F.replace("p_name", F.lit("e"), F.lit("e\u0301\u0323\u0308")), s.coll("E", strength=1)), "n": s.str_count(F.replace("p_name", F.lit("e"), F.lit("\ue000e")), s.coll("e")), "pieces": F.size(s.str_split(F.replace("p_name", F.lit("a"), F.lit("\ue000")), s.coll("e"))), "same": s.str_equal(F.replace("p_name", F.lit("e"), F.lit("\u00e9")), F.replace("p_name", F.lit("e"), F.lit("e\u0301"))), "loose": s.str_equal(F.replace("p_name", F.lit(" "), F.lit("-")), F.replace("p_name", F.lit(" "), F.lit("")), alternate_shifted=True)},
      {"found": "CASE WHEN contains(p_name, 'e') THEN 'e' || chr(769) || chr(803) || chr(776) END", "n": "len(regexp_extract_all(p_name, 'e'))::INT", "pieces": "len(string_split(p_name, 'e'))::INT", "same": "true", "loose": "true"})
_verb("locate_fixed", *DOC, lambda: {"start": s.str_locate("text", s.fixed("the"))["start"], "end": s.str_locate("text", s.fixed("the"))["end"]},
      {"start": "nullif(strpos(text, 'the'), 0)::INT", '"end"': "(nullif(strpos(text, 'the'), 0) + 2)::INT"})
_verb("locate_regex", *DOC, lambda: {"start": s.str_locate("text", "[0-9]+")["start"], "end": s.str_locate("text", "[0-9]+")["end"]},
      {"start": "nullif(strpos(text, regexp_extract(text, '[0-9]+')) * regexp_matches(text, '[0-9]+')::INT, 0)::INT",
       '"end"': "(nullif(strpos(text, regexp_extract(text, '[0-9]+')) * regexp_matches(text, '[0-9]+')::INT, 0) + length(regexp_extract(text, '[0-9]+')) - 1)::INT"})
_verb("locate_all_regex", *PART, lambda: {"spans": _spans(s.str_locate_all("p_name", "[aeiou]"))},
      {"spans": "array_to_string(list_transform(list_filter(generate_series(1, length(p_name)), lambda i: p_name[i] IN ('a', 'e', 'i', 'o', 'u')), lambda i: i || '-' || i), ',')"})
_verb("locate_all_fixed_coll", *PART, lambda: {"fixed": _spans(s.str_locate_all("p_name", s.fixed("e"))), "coll": _spans(s.str_locate_all("p_name", s.coll("E", ignore_case=True)))},
      dict.fromkeys(("fixed", "coll"), "array_to_string(list_transform(list_filter(generate_series(1, length(p_name)), lambda i: p_name[i] = 'e'), lambda i: i || '-' || i), ',')"))
_verb("invert_match", *PART, lambda: {"gaps": _spans(s.invert_match(s.str_locate_all("p_name", s.fixed("e"))))},
      {"gaps": "(SELECT array_to_string(list_transform(generate_series(0, len(pos)), lambda i: (CASE WHEN i = 0 THEN 0 ELSE pos[i] + 1 END) || '-' || (CASE WHEN i = len(pos) THEN -1 ELSE pos[i + 1] - 1 END)), ',') FROM (SELECT list_filter(generate_series(1, length(p_name)), lambda i: p_name[i] = 'e') AS pos))"})
_verb("locate_words", *PART, lambda: {"spans": _spans(s.str_locate_all("p_name", s.boundary("word")))},
      {"spans": "(SELECT array_to_string(list_transform(generate_series(1, len(ws)), lambda i: (length(array_to_string(ws[1:i - 1], ' ')) + (CASE WHEN i > 1 THEN 2 ELSE 1 END)) || '-' || length(array_to_string(ws[1:i], ' '))), ',') FROM (SELECT string_split(p_name, ' ') AS ws))"})

# Extraction

_verb("extract_regex", *PAGE, lambda: {"number": s.str_extract("url", "[0-9]+"), "host": s.str_extract("url", "://([^/]+)/", group=1)},
      {"number": "CASE WHEN regexp_matches(url, '[0-9]+') THEN regexp_extract(url, '[0-9]+') END", "host": "CASE WHEN regexp_matches(url, '://([^/]+)/') THEN regexp_extract(url, '://([^/]+)/', 1) END"})
_verb("extract_fixed_coll", *PART, lambda: {"fixed": s.str_extract("p_name", s.fixed("ring")), "coll": s.str_extract("p_name", s.coll("RING", ignore_case=True)), "letter": s.str_extract("p_name", "")},
      {"fixed": "CASE WHEN contains(p_name, 'ring') THEN 'ring' END", "coll": "CASE WHEN contains(p_name, 'ring') THEN 'ring' END", "letter": "p_name[1]"})
_verb("extract_all_regex", *PAGE, lambda: {"numbers": _joined(s.str_extract_all("url", "[0-9]+")), "three": _joined(s.str_extract_all("url", "[a-z]+", simplify=True, width=3))},
      {"numbers": "array_to_string(regexp_extract_all(url, '[0-9]+'), '|')", "three": "array_to_string(list_transform([1, 2, 3], lambda i: coalesce(regexp_extract_all(url, '[a-z]+')[i], '')), '|')"})
_verb("extract_all_others", *PART, lambda: {"fixed": _joined(s.str_extract_all("p_name", s.fixed("e"))), "coll": _joined(s.str_extract_all("p_name", s.coll("E", ignore_case=True))), "words": _joined(s.str_extract_all("p_name", s.boundary("word")))},
      {"fixed": "array_to_string(regexp_extract_all(p_name, 'e'), '|')", "coll": "array_to_string(regexp_extract_all(p_name, 'e'), '|')", "words": "array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9]+'), '|')"})
_verb("match_groups", *PAGE, lambda: {n: s.str_match("url", "^(https?)://(?<host>[^/]+)/")[n] for n in ("match", "g1", "host")},
      {"match": "CASE WHEN regexp_matches(url, '^(https?)://([^/]+)/') THEN regexp_extract(url, '^(https?)://([^/]+)/') END",
       "g1": "CASE WHEN regexp_matches(url, '^(https?)://([^/]+)/') THEN regexp_extract(url, '^(https?)://([^/]+)/', 1) END",
       "host": "CASE WHEN regexp_matches(url, '^(https?)://([^/]+)/') THEN regexp_extract(url, '^(https?)://([^/]+)/', 2) END"})
_verb("match_optional_group", *PAGE, lambda: {"fragment": s.str_match("url", "^[^#]*(#.*)?$")["g1"]}, {"fragment": "CASE WHEN contains(url, '#') THEN url[strpos(url, '#'):] END"})
_verb("match_all_groups", *PAGE, lambda: {"tags": _joined(F.transform(s.str_match_all("html", "<([a-z][a-z0-9]*)[ >]"), lambda m: m["g1"]))}, {"tags": "array_to_string(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1), '|')"})
_verb("match_json", "events", "event_id", lambda: {"k": s.str_match("props", '"k": ([0-9]+)')["g1"]}, {"k": "CASE WHEN regexp_matches(props, '\"k\": ([0-9]+)') THEN regexp_extract(props, '\"k\": ([0-9]+)', 1) END"})

# Replacement

_verb("replace_first", *DOC, lambda: {"regex": s.str_replace("text", "[aeiou]", r"<\0>"), "fixed": s.str_replace("text", s.fixed("the"), "$1"), "swap": s.str_replace("text", "([a-z])([a-z])", r"\2\1")},
      {"regex": r"regexp_replace(text, '[aeiou]', '<\0>')", "fixed": "CASE WHEN contains(text, 'the') THEN text[:strpos(text, 'the') - 1] || '$1' || text[strpos(text, 'the') + 3:] ELSE text END", "swap": r"regexp_replace(text, '([a-z])([a-z])', '\2\1')"})
_verb("replace_all", *DOC, lambda: {"regex": s.str_replace_all("text", "([aeiou])", r"<\1>"), "fixed": s.str_replace_all("text", s.fixed("."), "$")},
      {"regex": r"regexp_replace(text, '([aeiou])', '<\1>', 'g')", "fixed": "replace(text, '.', '$')"})
_verb("replace_coll", *PART, lambda: {"first": s.str_replace("p_name", s.coll("E", ignore_case=True), "_"), "all_": s.str_replace_all("p_name", s.coll("E", ignore_case=True), "_")},
      {"first": "regexp_replace(p_name, 'e', '_')", "all_": "replace(p_name, 'e', '_')"})
_verb("replace_several", *PART, lambda: {"out": s.str_replace_all("p_name", {"e": "3", "3r": "#", "[aiou]": "*"})}, {"out": "regexp_replace(replace(replace(p_name, 'e', '3'), '3r', '#'), '[aiou]', '*', 'g')"})
_verb("replace_function", *PART, lambda: {"all_": s.str_replace_all("p_name", "[aeiou]", F.upper), "first": s.str_replace("p_name", "^.", F.upper), "python": s.str_replace_all("p_name", "[aeiou]", s.per_batch(lambda x: x.str.upper()))},
      {"all_": "translate(p_name, 'aeiou', 'AEIOU')", "first": "upper(p_name[1]) || p_name[2:]", "python": "translate(p_name, 'aeiou', 'AEIOU')"})
_verb("remove_verbs", *DOC, lambda: {"first": s.str_remove("text", "[aeiou]+"), "all_": s.str_remove_all("text", "[aeiou]+")}, {"first": "regexp_replace(text, '[aeiou]+', '')", "all_": "regexp_replace(text, '[aeiou]+', '', 'g')"})
_verb("replace_missing", "orders", "o_orderkey", lambda: {"out": s.str_replace_na(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))}, {"out": "coalesce(nullif(o_orderstatus, 'P'), 'NA')"})
_verb("replace_charclass", *PART, lambda: {"each": s.replace_charclass("p_type", "[A-M]", "x"), "runs": s.replace_charclass("p_type", "[A-M]", "x", merge=True)}, {"each": "regexp_replace(p_type, '[A-M]', 'x', 'g')", "runs": "regexp_replace(p_type, '[A-M]+', 'x', 'g')"})

# Splitting

_verb("split_regex", *PAGE, lambda: {"pieces": _joined(s.str_split("url", "[/.?]")), "three": _joined(s.str_split("url", "[/.?]", n=3))},
      {"pieces": "array_to_string(string_split_regex(url, '[/.?]'), '|')", "three": "array_to_string(string_split_regex(url, '[/.?]')[:2], '|') || '|' || url[length(array_to_string(string_split_regex(url, '[/.?]')[:2], '|')) + 2:]"})
_verb("split_fixed_coll", *PART, lambda: {"fixed": _joined(s.str_split("p_name", s.fixed(" "))), "coll": _joined(s.str_split("p_name", s.coll("E", ignore_case=True))), "letters": _joined(s.str_split("p_name", ""))},
      {"fixed": "array_to_string(string_split(p_name, ' '), '|')", "coll": "array_to_string(string_split(p_name, 'e'), '|')", "letters": "array_to_string(string_split(p_name, ''), '|')"})
_verb("split_padded", *PART, lambda: {"pieces": _joined(s.str_split_fixed("p_name", s.fixed(" "), 4))}, {"pieces": "array_to_string(list_transform([1, 2, 3, 4], lambda i: coalesce(string_split(p_name, ' ')[i], '')), '|')"})
_verb("split_piece", *PAGE, lambda: {"third": s.str_split_i("url", s.fixed("/"), 3), "last": s.str_split_i("url", s.fixed("/"), -1), "ninth": s.str_split_i("url", s.fixed("/"), 9)},
      {"third": "string_split(url, '/')[3]", "last": "string_split(url, '/')[-1]", "ninth": "string_split(url, '/')[9]"})
_verb("split_lines", *DOC, lambda: {"n": F.size(s.split_lines("text")), "first": F.get(s.split_lines("text"), F.lit(0))}, {"n": "len(string_split(text, chr(10)))::INT", "first": "string_split(text, chr(10))[1]"})
_verb("words_by_number", *DOC, lambda: {"first": s.word("text"), "two": s.word("text", 2, 3), "last": s.word("text", -1), "far": s.word("text", 100000)},
      {"first": "string_split(text, ' ')[1]", "two": "CASE WHEN len(string_split(text, ' ')) >= 3 THEN array_to_string(string_split(text, ' ')[2:3], ' ') END", "last": "string_split(text, ' ')[-1]", "far": "string_split(text, ' ')[100000]"})
_verb("split_sentences", "conversations", ("conv_id", "turn"), lambda: {"n": F.size(s.str_split("text", s.boundary("sentence")))},
      {"n": r"len(regexp_extract_all(text, '[^.!?\n]*([.!?]+ *\n?|\n)|[^.!?\n]+$'))::INT"})


@_query("split_one", "SELECT unnest(string_split(r_name, 'A')) AS piece FROM region WHERE r_regionkey = 1")
def _split_one(spark, sf_dir):
    return s.str_split_1(_table(spark, sf_dir, "region").where("r_regionkey = 1"), "r_name", s.fixed("A"))


# Positions

_verb("sub_range", *DOC, lambda: {"head": s.str_sub("text", 1, 10), "tail": s.str_sub("text", -5), "inner": s.str_sub("text", 3, -3), "none": s.str_sub("text", 5, 2), "size": s.str_sub("text", 4, length=3)},
      {"head": "text[1:10]", "tail": "CASE WHEN length(text) < 5 THEN text ELSE text[length(text) - 4:] END", "inner": "CASE WHEN length(text) < 5 THEN '' ELSE text[3:length(text) - 2] END", "none": "''", "size": "text[4:6]"})
_verb("sub_replace", *PART, lambda: {"out": s.str_sub_replace("p_name", 2, 3, "__"), "insert": s.str_sub_replace("p_name", 2, 1, "+")}, {"out": "p_name[1] || '__' || p_name[4:]", "insert": "p_name[1] || '+' || p_name[2:]"})
_verb("sub_several", *PART, lambda: {"out": _joined(s.str_sub_all("p_name", [(1, 1), (2, 3), (-2, -1)])), "put": s.str_sub_replace_all("p_name", [(1, 1), (3, 3)], ["<", ">"])},
      {"out": "p_name[1] || '|' || p_name[2:3] || '|' || p_name[length(p_name) - 1:]", "put": "'<' || p_name[2] || '>' || p_name[4:]"})
_verb("trunc_sides", *DOC, lambda: {side: s.str_trunc("text", 20, side) for side in ("right", "left", "center")},
      {"\"right\"": "CASE WHEN length(text) > 20 THEN text[:17] || '...' ELSE text END", "\"left\"": "CASE WHEN length(text) > 20 THEN '...' || text[length(text) - 16:] ELSE text END", "center": "CASE WHEN length(text) > 20 THEN text[:9] || '...' || text[length(text) - 7:] ELSE text END"})
_verb("reverse_text", *DOC, lambda: {"out": s.str_reverse(F.regexp_replace("text", "\\s+", " "))}, {"out": "reverse(regexp_replace(text, '\\s+', ' ', 'g'))"})

# Layout

_verb("length_text", *DOC, lambda: {"n": s.str_length("text")}, {"n": "length(text)::INT"})
_verb("width_text", *DOC, lambda: {"n": s.str_width("text")}, {"n": "length(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'))::INT"})
# letters stand for wide, symbol, joined and combining characters
_verb("width_wide", *PART, lambda: {"n": s.str_width(F.replace(F.replace(F.replace("p_name", F.lit("a"), F.lit("\u4e2d")), F.lit("e"), F.lit("\u00a9")), F.lit("i"), F.lit("i\u0301"))), "emoji": s.str_width(F.replace("p_name", F.lit("r"), F.lit("\U0001f469\u200d\U0001f4bb")))},
      {"n": "(length(p_name) + len(regexp_extract_all(p_name, '[ae]')))::INT", "emoji": "(length(p_name) + len(regexp_extract_all(p_name, 'r')))::INT"})
_verb("pad_wide", *PART, lambda: {"out": s.str_pad(F.replace("p_name", F.lit("a"), F.lit("\u00a9")), 24, "right", "."), "by_column": s.str_pad("p_name", 24, "left", F.substring("p_brand", 1, 1))},
      {"out": "replace(p_name, 'a', '\u00a9') || repeat('.', greatest(24 - length(p_name) - len(regexp_extract_all(p_name, 'a')), 0)::INT)", "by_column": "repeat(p_brand[1], greatest(24 - length(p_name), 0)) || p_name"})
_verb("pad_sides", *PART, lambda: {"a": s.str_pad("p_name", 20), "b": s.str_pad("p_name", 20, "right", "."), "c": s.str_pad("p_name", 20, "both", "*")},
      {"a": "repeat(' ', greatest(20 - length(p_name), 0)) || p_name", "b": "p_name || repeat('.', greatest(20 - length(p_name), 0))", "c": "repeat('*', greatest(20 - length(p_name), 0) // 2) || p_name || repeat('*', greatest(20 - length(p_name), 0) - greatest(20 - length(p_name), 0) // 2)"})
_verb("trim_squish", *PART, lambda: {k: v for k, v in (("both", s.str_trim(F.concat(F.lit(" \t "), "p_name", F.lit(" \n")))), ("l", s.str_trim(F.concat(F.lit("  "), "p_name", F.lit(" ")), "left")), ("squish", s.str_squish(F.concat(F.lit("  "), "p_name", F.lit(" \t x ")))))},
      {'"both"': "p_name", "l": "p_name || ' '", "squish": "p_name || ' x'"})
_verb("dup_text", *PART, lambda: {"two": s.str_dup("p_brand", 2), "sep": s.str_dup("p_brand", F.col("p_size") % 4, sep="-"), "none": s.str_dup("p_brand", -1)},
      {"two": "repeat(p_brand, 2)", "sep": "array_to_string(list_transform(generate_series(1, p_size % 4), lambda i: p_brand), '-')", "none": "NULL::VARCHAR"})
_verb("wrap_text", "conversations", ("conv_id", "turn"), lambda: {"out": s.str_wrap("text", 60, indent=2, exdent=1)}, None)

# Combining

_verb("c_columns", *PART, lambda: {"out": s.str_c(F.col("p_name"), F.col("p_brand"), "x", sep="/"), "missing": s.str_c(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")), sep="-")},
      {"out": "p_name || '/' || p_brand || '/x'", "missing": "p_name || '-' || (CASE WHEN p_size > 25 THEN p_brand END)"})
_verb("glue_template", *CUST, lambda: {"out": s.str_glue("{c_name} ({upper(c_mktsegment)}) {{{x}}}", x=F.col("c_nationkey") + 1)}, {"out": "c_name || ' (' || upper(c_mktsegment) || ') {' || (c_nationkey + 1) || '}'"})
_verb("interp_template", *CUST, lambda: {"out": s.str_interp("${c_name}: $[.2f]{c_acctbal} and $[05d]{c_nationkey}")}, {"out": "c_name || ': ' || printf('%.2f', c_acctbal) || ' and ' || printf('%05d', c_nationkey)"})


@_query("flatten_groups", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS joined, CASE WHEN bool_or(n_nationkey = 3) THEN NULL ELSE string_agg(n_name, '' ORDER BY n_nationkey) END AS strict_ FROM nation GROUP BY n_regionkey")
def _flatten(spark, sf_dir):
    t = _table(spark, sf_dir, "nation")
    some = F.when(F.col("n_nationkey") != 3, F.col("n_name"))
    return t.groupBy("n_regionkey").agg(s.str_flatten("n_name", ", ", order_by="n_nationkey").alias("joined"), s.str_flatten(some, order_by="n_nationkey").alias("strict_"))


@_query("flatten_comma", "SELECT conv_id, CASE WHEN count(*) > 1 THEN array_to_string(list(role ORDER BY turn)[:-2], ', ') || (CASE WHEN count(*) = 2 THEN ' and ' ELSE ', and ' END) || list(role ORDER BY turn)[-1] ELSE any_value(role) END AS roles FROM conversations GROUP BY conv_id")
def _flatten_comma(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(s.str_flatten_comma("role", ", and ", order_by="turn").alias("roles"))


# Case

_verb("case_accents", *DOC, lambda: {"up": s.str_to_upper("text"), "low": s.str_to_lower("text")}, {"up": "upper(replace(text, chr(223), 'SS'))", "low": "lower(text)"})
_verb("case_locales", *PART, lambda: {"tr": s.str_to_upper("p_name", "tr"), "el": s.str_to_upper(F.replace("p_name", F.lit("a"), F.lit("\u03ac")), "el"), "nl": s.str_to_title(F.concat(F.lit("ij"), "p_name"), "nl")},
      {"tr": "upper(replace(p_name, 'i', chr(304)))", "el": "replace(upper(replace(p_name, 'a', chr(945))), 'a', chr(913))", "nl": "'IJ' || array_to_string(list_transform(generate_series(1, len(string_split(p_name, ' '))), lambda i: CASE WHEN i = 1 THEN string_split(p_name, ' ')[1] ELSE upper(string_split(p_name, ' ')[i][1]) || string_split(p_name, ' ')[i][2:] END), ' ')"})
_verb("case_mapping", *PART, lambda: {"up": s.str_to_upper("p_name"), "low": s.str_to_lower("p_type"), "title": s.str_to_title("p_name"), "sentence": s.str_to_sentence("p_name")},
      {"up": "upper(p_name)", "low": "lower(p_type)", "title": "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')", "sentence": "upper(p_name[1]) || p_name[2:]"})
_verb("case_identifiers", *CUST, lambda: {"snake": s.str_to_snake("c_name"), "kebab": s.str_to_kebab("c_name"), "camel": s.str_to_camel("c_name"), "pascal": s.str_to_camel("c_name", first_upper=True)},
      {"snake": "lower(replace(c_name, '#', '_'))", "kebab": "lower(replace(c_name, '#', '-'))", "camel": "lower(replace(c_name, '#', ''))", "pascal": "replace(c_name, '#', '')"})

# Order


@_query("sort_place", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS place FROM customer")
def _sort_place(spark, sf_dir):
    return s.str_order(_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", name="place").select("c_custkey", "place")


@_query("sort_numeric", "SELECT n_nationkey, row_number() OVER (ORDER BY split_part(n_name, '_', 2)::INT) AS place FROM nation")
def _sort_numeric(spark, sf_dir):
    return s.str_order(_table(spark, sf_dir, "nation"), "n_name", "n_nationkey", numeric=True, name="place").select("n_nationkey", "place")


@_query("sort_rows", "SELECT n_name, row_number() OVER (ORDER BY n_regionkey % 3 DESC, n_name) AS place FROM nation WHERE n_nationkey <> 4")
def _sort_rows(spark, sf_dir):
    """The order of the rows themselves, read off their positions; nation has 25 rows at every scale."""
    names = F.element_at(F.array(F.lit("ab"), F.lit("\u00c1c"), F.lit("b")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    some = _table(spark, sf_dir, "nation").withColumn("k", F.when(F.col("n_nationkey") != 4, names))
    rows = s.str_sort(some, "k", "n_name", decreasing=True, na_last=None).withColumn("at", F.monotonically_increasing_id())
    return rows.select("n_name", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@_query("na_options", "SELECT p_brand, string_agg(p_name, '+' ORDER BY p_partkey) FILTER (p_size % 7 > 0) AS dropped, string_agg(CASE WHEN p_size % 7 > 0 THEN p_name ELSE '' END, '+' ORDER BY p_partkey) AS emptied, CASE WHEN bool_or(p_size % 7 = 0) THEN NULL ELSE string_agg(p_name, '+' ORDER BY p_partkey) END AS strict_, string_agg(p_name || '/' || p_type, ';' ORDER BY p_partkey) FILTER (p_size % 7 > 0) AS joined FROM part GROUP BY p_brand")
def _na_options(spark, sf_dir):
    """What missing values become when texts are joined."""
    some = F.when(F.col("p_size") % 7 > 0, F.col("p_name"))
    flat = lambda c, sep, **options: s.str_flatten(c, sep, order_by="p_partkey", **options)
    return _table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.nullif(flat(some, "+", na_rm=True), F.lit("")).alias("dropped"),
        flat(some, "+", na_empty=True).alias("emptied"),
        flat(some, "+").alias("strict_"),
        F.nullif(flat(s.str_c(some, F.col("p_type"), sep="/"), ";", na_rm=True), F.lit("")).alias("joined"),
    )


@_query("join_missing", "SELECT p_partkey, concat_ws('-', p_brand, CASE WHEN p_size > 25 THEN p_type END, 'x') AS skipped, CASE WHEN p_size > 25 THEN p_brand || '-' || p_type END AS strict_ FROM part")
def _join_missing(spark, sf_dir):
    some = F.when(F.col("p_size") > 25, F.col("p_type"))
    return _table(spark, sf_dir, "part").select("p_partkey", s.str_c(F.col("p_brand"), some, "x", sep="-", ignore_null=True).alias("skipped"), s.str_c(F.col("p_brand"), some, sep="-").alias("strict_"))


@_query("view_rows", "SELECT id, replace(p_name, 'ring', '<ring>') AS text FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS id FROM part) WHERE contains(p_name, 'ring')")
def _view_rows(spark, sf_dir):
    return s.str_view(_table(spark, sf_dir, "part"), "p_name", s.fixed("ring"), order_by="p_partkey").rows


@_query("read_lines", "SELECT (2 * r_regionkey + k)::BIGINT AS line_no, CASE WHEN k = 1 THEN r_name ELSE 'no. ' || r_regionkey END AS line FROM region, (VALUES (1), (2)) AS t(k)")
def _read_lines(spark, sf_dir):
    """The five regions as a text file of two lines each, by two kinds of terminators."""
    lines = F.concat("r_name", F.lit("\u2028no. "), F.col("r_regionkey").cast("string"))
    path = scratch_path(spark)
    _table(spark, sf_dir, "region").orderBy("r_regionkey").select(lines).coalesce(1).write.text(path)
    return s.str_read_lines(spark, path).select(F.col("line_no").cast("long").alias("line_no"), "line")


@_query("read_raw", "SELECT sum(strlen(r_name) + 1)::BIGINT AS size FROM region")
def _read_raw(spark, sf_dir):
    path = scratch_path(spark)
    _table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(path)
    return s.read_raw(spark, path).agg(F.sum(F.octet_length("content")).cast("long").alias("size"))


@_query("pattern_options", "SELECT 'bound' AS kind, 'word' AS type, true AS skip UNION ALL SELECT 'regex', NULL, NULL UNION ALL SELECT 'empty', NULL, NULL")
def _pattern_options(spark, sf_dir):
    """Dispatch tags and options, which exist when plans are built."""
    rows = [(s.type_of(p), s.opts(p).get("type") if s.type_of(p) == "bound" else None, s.opts(p).get("skip_word_none") if s.type_of(p) == "bound" else None) for p in (s.boundary("word"), "a+", "")]
    return spark.createDataFrame(rows, "kind string, type string, skip boolean")


@_query("rank_text", 'SELECT c_custkey, rank() OVER (ORDER BY c_mktsegment) AS "rank" FROM customer')
def _rank(spark, sf_dir):
    return s.str_rank(_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey").select("c_custkey", "rank")


@_query("unique_text", "SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_type")
def _unique(spark, sf_dir):
    return s.str_unique(_table(spark, sf_dir, "part"), "p_type", "p_partkey").select("p_type", "p_partkey")


@_query("duplicated_text", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) > 1 AS again FROM part")
def _duplicated(spark, sf_dir):
    return s.str_duplicated(_table(spark, sf_dir, "part"), "p_brand", "p_partkey", name="again").select("p_partkey", "again")


# Encodings, escapes, view

_verb("conv_bytes", *DOC, lambda: {"same": s.str_conv(F.encode("text", "UTF-8"), "UTF-8"), "size": F.octet_length(s.str_encode("text", "UTF-8"))}, {"same": "text", "size": "strlen(text)::INT"})
_verb("escape_text", *PAGE, lambda: {"regex": s.str_escape("url"), "unicode": s.escape_unicode(F.replace(F.replace("url", F.lit("a"), F.lit("\u00e9")), F.lit("o"), F.lit("\U0001f60a")))}, {"regex": r"regexp_replace(url, '([.^$\\|*+?{}\[\]()])', '\\\1', 'g')", "unicode": r"replace(replace(url, 'a', '\u00e9'), 'o', '\U0001f60a')"})
_verb("nfc_text", *DOC, lambda: {"out": s.trans_nfc(F.replace("text", F.lit("e"), F.lit("e\u0301")))}, {"out": "nfc_normalize(replace(text, 'e', 'e' || chr(769)))"})
_verb("view_text", *PART, lambda: {"out": s.highlighted("p_name", "[aeiou]+"), "html": s.highlighted("p_name", s.fixed("ring"), html=True)}, {"out": r"regexp_replace(p_name, '[aeiou]+', '<\0>', 'g')", "html": "replace(p_name, 'ring', '<span class=''match''>ring</span>')"})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with a word in a capital: counts and all titles by language."""
    docs = s.str_subset(_table(spark, sf_dir, "documents"), "text", r"\b[A-Z][a-z]+\b")
    rows = docs.select("doc_id", "lang", s.str_count("text", s.fixed(" ")).alias("spaces"), s.str_to_title(s.str_sub("text", 1, 20)).alias("title"))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.sum("spaces").alias("spaces"),
        s.str_flatten("title", " / ", na_rm=True, order_by="doc_id").alias("titles"),
    )


QUERIES["flagship"] = flagship

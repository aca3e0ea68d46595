"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.llm import decontaminate, language, licence, lines, mixing, quality, rules, sharding, simhash, suffixes
from glyphframe.llm.common import checkpoint_dir, table


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels that may train."""
    return table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality")


def quality_weight(spark: SparkSession, sf_dir: str) -> Column:
    """The classifier's score of a document's text, for draws by quality."""
    model = quality.train(table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))
    return quality.probability(model, F.col("text"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, quality_labels(spark, sf_dir)))
    return scored.select(
        F.col("id").alias("doc_id"),
        quality.held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of all documents, sizes near equal."""
    path = f"{checkpoint_dir(spark)}/slot-maps/{uuid.uuid4().hex}"
    placed, _ = sharding.place(table(spark, sf_dir, "documents"), 40, map_path=path)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; the classifier's score is the weight in the draw."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, weight=quality_weight(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand in ten sources or more."""
    left = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of all documents, by SimHash of 3-word shingles."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat 100 bytes of an earlier place."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents, and whether the rules keep them."""
    docs = table(spark, sf_dir, "documents")
    model = rules.train(docs, quality_labels(spark, sf_dir))
    return rules.evaluate(docs, model).withColumnRenamed("id", "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    apart = quality.held_out(F.col("doc_id"), folds=4, fold=2)
    model = language.train(docs.where(~apart).select("doc_id", "text", "lang"))
    found = language.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), quality.held_out(F.col("id"), folds=4, fold=2).alias("held_out"), "lang_pred", "score")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    docs = table(spark, sf_dir, "documents")
    return licence.scan(docs, licence.train(docs)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_lines": op5_lines,
    "op6_simhash": op6_simhash,
    "op7_suffixes": op7_suffixes,
    "op8_rules": op8_rules,
    "op9_language": op9_language,
    "op10_licences": op10_licences,
}

#: Of the operators that SQL can express on whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), items AS (
            SELECT item_id, ws, least(13, len(ws)) AS m
            FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
            WHERE len(ws) > 0
        ), item_windows AS (
            SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win
            FROM (SELECT item_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM items)
        ), doc_windows AS (
            SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
            FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i
                  FROM docs, (SELECT DISTINCT m FROM items) WHERE len(ws) >= m)
        ), hits AS (
            SELECT d.doc_id, d.i, d.m, b.item_id FROM doc_windows d JOIN item_windows b ON d.m = b.m AND d.win = b.win
        ), words_hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id
        ), items_hit AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
    """,
    "op5_lines": r"""
        WITH lines AS (
            SELECT doc_id, source, i, string_split(text, chr(10))[i] AS raw,
                   regexp_replace(string_split(text, chr(10))[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
            FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)
        ), common AS (
            SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0) || 'null')) >= 10
        ), marked AS (
            SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.line = c.line
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
               sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}

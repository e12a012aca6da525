"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fertility, kneser_ney, langid, linededup, minhash, mixing, pii, search, substrings, toxicity, variants
from .common import crc_mod, ship, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")), ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = fertility.fertility_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "fallback_share", "token_entropy")


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    learned = langid.profiles(docs.where(~held_out))
    return langid.predict(docs, learned, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.corpus.pseudonym.key", pii.KEY)
    return pii.report(pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], texts=False)


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return search.search(search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], texts=False)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: DuckDB: lines and keys as the contract states them; a document is a row.
LINES_SQL = r"""
WITH n AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
e AS (SELECT row, doc_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM n),
k AS (SELECT row, doc_id, i, parts[i] AS line, translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY row
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_toxicity, op2_fertility, op3_chat_snapshots, op4_language, op5_near_duplicates, op6_mixing, op7_pseudonyms, op8_line_dedup, op9_perplexity, op10_decontamination, op11_lexical_search, op12_substring_dedup, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_snapshots": chat.SQL, "op6_mixing": mixing.SQL, "op8_line_dedup": LINES_SQL, "op10_decontamination": decontam.SQL, "op11_lexical_search": search.SQL, "op12_substring_dedup": substrings.SQL}

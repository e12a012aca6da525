"""A corpus pipeline of five stages; each takes the written documents of the stage before it.

Toxic documents go, frequent lines go from the rest, one document of each group
of near duplicates stays, documents with benchmark passages go, and what is left
is mixed: its last stage returns a row for each document with the copies to take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm import decontam, linededup, minhash, mixing, toxicity
from quillmap.llm.common import crc_mod, materialize, release, ship, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of op1, trained on the same fold, scores below 0.3."""
    ship(spark)
    seen = F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), seen)
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.3").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go from all; a text that loses lines gets its new length."""
    ship(spark)
    keep = [c for c in COLUMNS if c != "text"]
    out = linededup.dedup_lines(docs, keep, texts=True)
    changed = F.col("n_dropped") > 0
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), one row of each (doc_id, text); rows with neither doc_id nor words stay."""
    ship(spark)
    marked = minhash.groups(docs, k=5, percent=80)
    row = F.xxhash64("doc_id", "text_key").alias("_row_")
    kept = marked.where(F.col("first").isNull() | minhash.is_first()).select(row, "n_shingles").distinct()
    # the join and the grouping share one exchange by _row_
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key")).select(*COLUMNS, "text_key", row).join(kept, "_row_")
    rows = rows.withColumn("_own_", F.when(F.col("doc_id").isNull() & (F.col("n_shingles") == 0), F.monotonically_increasing_id()))
    return rows.groupBy("_row_", F.col("doc_id").alias("_d_"), "text_key", "_own_").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return out.where("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating: doc_id, source, size, target and the words and copies taken."""
    return mixing.mix_documents(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: A trained score decides in the first stage, which SQL cannot express; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    since = len(written(spark))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, since)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)

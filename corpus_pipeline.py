"""The corpus pipeline: quality rules, language ID, near-duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes each stage's result as Parquet in the shared folder and
reads it back.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.llm import bpe, decontam, langid, quality_rules, simhash
from sensorlab.llm.scratch import folder, remove, stored, temporary
from sensorlab.session import ship
from sensorlab.sources.tables import read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, fitted on ``docs`` and the labels."""
    ship(spark)
    judged = quality_rules.apply_rules(_packed(docs), read_table(spark, sf_dir, "labels"))
    return _unpacked(judged.where("kept"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language: all that are not ``und``.  Learns from every labelled row."""
    ship(spark)
    model = langid.fit(docs, F.lit(True))
    found = langid.identify(_packed(docs), model)
    return _unpacked(found.where(F.col("lang_pred") != "und"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 2 bits): that of the smallest id."""
    ship(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that hold benchmark windows of 10 words;
    those with more than half of their words in such spans go.  ``n_chars`` is
    counted anew where the text was cut."""
    ship(spark)
    cut = decontam.remove_spans(docs.withColumn("__before", F.char_length("text")), read_table(spark, sf_dir, "benchmark"),
                                window=10, max_coverage=0.5)
    now = F.char_length("text")
    size = F.when(now.eqNullSafe(F.col("__before")), F.col("n_chars")).otherwise(now.cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("n_chars", size).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``documents`` columns with ``n_tokens``, ``ids`` and ``offsets`` (packed
    32-bit), and ``intact``: the ids decode to the text."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), check=True)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no operator column hides one of the documents'."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("__doc.*")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("language_id", keep_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", tokenise),
]

#: The stages hash, learn and tokenise in ways SQL cannot state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over ``documents``.  What a stage stores for itself goes when its result
    is written, and the result goes when the next one is."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = folder(spark, f"stage-{name}")
        with temporary(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        if last:
            remove(spark, last)
        last = path
    return docs

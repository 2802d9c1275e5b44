"""The corpus pipeline: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads again as the next one's docs.
All but the last return the columns of documents, extra ones included, whatever their names.

Defined results of all stages: no stage cuts or skips a long text; equal rows get equal results; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import bpe, decontaminate, quality, secrets, simhash
from glyphflow.llm.common import materialise, table

REDACTED = "[SECRET]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of policy v2. A null or empty text has no words and is rejected; of repeated rows all stay or none."""
    return quality.keep(docs, "v2")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id; a null id comes last, of equal ids the row stored first stays.

    Texts without words are copies of each other."""
    return simhash.keep(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null texts hold none and stay; items without words or id are left out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), how="documents")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by REDACTED, n_chars brought up to date. Null texts stay null; overlapping secrets become one sign."""
    names = docs.columns
    found = secrets.find(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("_text")),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "_text", REDACTED,
    )
    changed = F.size("secret_spans") > 0
    new = {"text": F.col("_text"), "n_chars": F.when(changed, F.char_length("_text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in names else None}
    return found.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in names])


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and round_trip: whether the bytes decoded from these ids alone are those of the text. A null text has no ids; own columns beyond doc_id are left."""
    safe = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    coded = bpe.encode(safe, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.when(F.col("ids_text") == "", F.array().cast("array<int>")).otherwise(F.split("ids_text", ",").cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("ids"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", bpe_encoding),
]

#: XXH64, token efficiency and merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

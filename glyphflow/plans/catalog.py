"""Registered queries, each an operator applied to whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked, and tests hold it against goldens."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Stand-ins for the store's tables, derived from events: the same text for both engines.
K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
KD = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("target"), F.col("value").alias("elapsed_ms"), (F.col("event_type") != "error").alias("ok"), "user_id", "ts")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.pmod("event_id", F.lit(997)).alias("request_id"), F.when(F.pmod("event_id", F.lit(10)) != 0, F.pmod("user_id", F.lit(50))).alias("user_id"),
        F.when(k % 2 == 0, "up").otherwise("down").alias("rating"), F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("correction"), F.col("event_id").alias("seq"),
    )


REQUESTS_SQL = "(SELECT event_id AS id, event_type AS target, value AS elapsed_ms, event_type <> 'error' AS ok, user_id, ts FROM events)"
FEEDBACK_SQL = f"""(SELECT event_id % 997 AS request_id, CASE WHEN event_id % 10 <> 0 THEN user_id % 50 END AS user_id,
  CASE WHEN {KD} % 2 = 0 THEN 'up' ELSE 'down' END AS rating, CASE WHEN {KD} % 3 = 0 THEN 'c' || {KD} END AS correction, event_id AS seq FROM events)"""

WORDS_SQL = r"SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents"
FREQ_SQL = f"SELECT word, count(*) AS freq FROM ({WORDS_SQL}) GROUP BY word"
FREQ_LANG_SQL = f"SELECT lang, word, count(*) AS freq FROM ({WORDS_SQL}) GROUP BY lang, word"


def load() -> None:
    """Fill QUERIES and SQL."""
    from glyphflow.plans import queries_corpus, queries_files, queries_image, queries_script, queries_store  # noqa: F401

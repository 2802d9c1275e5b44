"""The store over streams. Each form gives what the batch functions of glyphflow.operators.store give over the same events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphflow.sources.files import EVENT


def event_stream(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """JSON lines as they are appended to a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "").select(F.from_json("line", schema).alias("x")).select("x.*")


def feedback_upserts(stream: DataFrame) -> DataFrame:
    """Update mode: (request_id, user_id) with the last rating and the last non-null correction. The state is one row per key, without expiry."""
    return stream.where("user_id IS NOT NULL").groupBy("request_id", "user_id").agg(
        F.max_by("rating", "seq").alias("rating"), F.max_by("correction", F.when(F.col("correction").isNotNull(), F.col("seq"))).alias("correction"), F.max("seq").alias("seq")
    )


def replay_stream(stream: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore: the first row of each key that arrives."""
    return stream.dropDuplicates(key)


def stats_stream(stream: DataFrame) -> DataFrame:
    """Running counts per target."""
    return stream.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))


def windowed(stream: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Extension: counts in event-time windows with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "target").agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """Extension: events per user and session."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


class Pending(StatefulProcessor):
    """Per (chat, user): a down vote waits for a text, which becomes its correction; anything else clears it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "request_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        every = pd.concat(list(rows)).sort_values("seq")
        for r in every.itertuples(index=False):
            if r.kind == "down":
                self.waiting.update((int(r.request_id),))
                continue
            if r.kind == "text" and self.waiting.exists():
                out.append((int(key[0]), int(key[1]), int(self.waiting.get()[0]), r.text, int(r.seq)))
            if self.waiting.exists():
                self.waiting.clear()
        yield pd.DataFrame(out, columns=["chat_id", "user_id", "request_id", "correction", "seq"])

    def close(self) -> None:
        pass


def corrections_stream(stream: DataFrame) -> DataFrame:
    """Corrections as they are completed. Needs the RocksDB state store."""
    return stream.groupBy("chat_id", "user_id").transformWithStateInPandas(
        statefulProcessor=Pending(), outputStructType="chat_id long, user_id long, request_id long, correction string, seq long", outputMode="Append", timeMode="None"
    )

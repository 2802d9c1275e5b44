"""The request and feedback store as functions over event tables; streaming forms are in glyphflow.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULTS = {"size": "m", "punctuation": "off", "fix_letters": "1"}
MODES = ("translit", "todo", "hudum", "image", "fix", "ocr")


def upsert_feedback(events: DataFrame) -> DataFrame:
    """One row per (request_id, user_id): last rating, last non-null correction. Rows without user never conflict and all stay."""
    known, anonymous = events.where("user_id IS NOT NULL"), events.where("user_id IS NULL")
    merged = known.groupBy("request_id", "user_id").agg(
        F.max_by("rating", "seq").alias("rating"), F.max_by("correction", F.when(F.col("correction").isNotNull(), F.col("seq"))).alias("correction"), F.max("seq").alias("seq")
    )
    return merged.unionByName(anonymous.select("request_id", "user_id", "rating", "correction", "seq"))


def replay(log: DataFrame, existing: DataFrame, key: list[str], parity: bool = False) -> DataFrame:
    """Rows of the log that a replay inserts: the first of each key that the target lacks. Keys compare null-safely, unless ``parity``: then rows with a null in the key always go in."""
    first = log.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("seq"))).where("_n = 1").drop("_n")
    same = None
    for k in key:
        c = first[k].eqNullSafe(existing[k])
        same = c if same is None else same & c
    new = first.join(existing, same, "left_anti")
    if not parity:
        return new
    nulls = None
    for k in key:
        nulls = F.col(k).isNull() if nulls is None else nulls | F.col(k).isNull()
    return new.where(~nulls).unionByName(log.where(nulls))


def replay_counts(lines: DataFrame, schema: str, line_col: str = "line") -> DataFrame:
    """requests, feedback, skipped (other kinds), broken (not JSON or no kind) of a log of JSON lines; blank lines don't count."""
    parsed = lines.where(F.trim(line_col) != "").select(F.from_json(line_col, schema).alias("x"))
    kind = F.col("x.event")
    return parsed.agg(
        F.count_if(kind == "request").alias("requests"), F.count_if(kind == "feedback").alias("feedback"),
        F.count_if(kind.isNotNull() & ~kind.isin("request", "feedback")).alias("skipped"), F.count_if(kind.isNull()).alias("broken"),
    )


def settings(events: DataFrame, fields: list[str]) -> DataFrame:
    """Per user the last non-null value of each field since the user's last reset. events: user_id, seq, kind (set, reset), and the fields."""
    last = F.coalesce(F.max(F.when(F.col("kind") == "reset", F.col("seq"))).over(W.partitionBy("user_id")), F.lit(-1))
    live = events.withColumn("_reset", last).where((F.col("seq") > F.col("_reset")) & (F.col("kind") == "set"))
    return live.groupBy("user_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def settings_by_join(events: DataFrame, fields: list[str]) -> DataFrame:
    """The same with the resets aggregated first, for users with very many events: no task gathers one user's rows."""
    resets = events.where("kind = 'reset'").groupBy("user_id").agg(F.max("seq").alias("_reset"))
    live = events.where("kind = 'set'").join(resets, "user_id", "left").where("_reset IS NULL OR seq > _reset")
    return live.groupBy("user_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def with_defaults(rows: DataFrame, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """Null and empty fields fall to their defaults."""
    return rows.withColumns({f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit(v)) for f, v in defaults.items() if f in rows.columns})


def modes(events: DataFrame, default: str = "translit") -> DataFrame:
    """Last mode of each (chat, user); what isn't a mode is the default."""
    last = events.groupBy("chat_id", "user_id").agg(F.max_by("mode", "seq").alias("mode"))
    return last.withColumn("mode", F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise(default))


def corrections(events: DataFrame) -> DataFrame:
    """Pending corrections: a text right after a down vote is that request's correction. events: chat_id, user_id, seq, kind (down, text, cancel, command), request_id, text."""
    w = W.partitionBy("chat_id", "user_id").orderBy("seq")
    return events.withColumns({"_kind": F.lag("kind").over(w), "_request": F.lag("request_id").over(w)}).where("kind = 'text' AND _kind = 'down'").select(
        "chat_id", "user_id", F.col("_request").alias("request_id"), F.col("text").alias("correction"), "seq"
    )


def convert_further(requests: DataFrame, asks: DataFrame) -> DataFrame:
    """Requests derived from stored ones: the Todo text for hudum, the fixed text for fix, else the input; photos aren't converted."""
    source = requests.select(F.col("id").alias("from_id"), F.col("target").alias("was"), "input_text", "todo", "fixed")
    text = F.coalesce(F.when(F.col("target") == "hudum", F.col("todo")), F.when(F.col("was") == "fix", F.col("fixed")), F.col("input_text"))
    return asks.join(source, "from_id").where(~F.col("input_text").startswith("photo:")).select("ask_id", "from_id", "target", text.alias("text"))


def letters_log(flag: Column, fixes: Column) -> Column:
    """Recorded only if something fired."""
    return F.when((flag != "") | (F.size(fixes) > 0), F.struct(flag.alias("flag"), fixes.alias("fixes")))


def stats(requests: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: totals, users, failures, mean time of what succeeded, votes and their shares."""
    r = requests.agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("users"), F.count_if(~F.col("ok")).alias("failed"),
        F.avg(F.when(F.col("ok"), F.col("elapsed_ms"))).alias("avg_ms"),
    )
    f = feedback.agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"), F.count("correction").alias("corrections"))
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("up") + F.col("down")), F.lit(0.0))
    return r.join(F.broadcast(f)).withColumns({"up_share": share("up"), "down_share": share("down")})  # one row each


def by_target(requests: DataFrame) -> DataFrame:
    """Requests of each target and of all (a rollup)."""
    return requests.rollup("target").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok")).withColumn("target", F.coalesce("target", F.lit("all")))


def export(feedback: DataFrame, requests: DataFrame, only_corrections: bool = False) -> DataFrame:
    out = feedback.join(requests.withColumnsRenamed({"id": "request_id", "user_id": "asked_by"}), "request_id")
    return out.where("correction IS NOT NULL") if only_corrections else out

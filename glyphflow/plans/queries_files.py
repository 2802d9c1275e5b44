"""Queries of scans and sinks: what is written in a format and read back, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphflow.operators import lexicon
from glyphflow.plans.catalog import FREQ_SQL, query, read
from glyphflow.sources import files
from glyphflow.storage import fresh


def words(spark, d):
    return lexicon.frequencies(read(spark, d, "documents").select("doc_id", "lang", "source", "text"))


KIND_SQL = "CASE length(word) % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'k' ELSE 'r' END"


def _kind(names: str):
    return F.element_at(F.array(*map(F.lit, names)), (F.char_length("word") % 3 + 1).cast("int"))


@query("io03_vocabulary", f"SELECT {KIND_SQL} AS kind, word, freq FROM ({FREQ_SQL})")
def io03(spark, d):
    path = fresh(spark, "io03")
    words(spark, d).withColumn("kind", _kind("dkr")).write.csv(path, sep="\t", compression="gzip")
    kinds = [rows.select(F.lit(k).alias("kind"), "word", "freq") for k, rows in files.vocabulary(spark, path).items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("io04_tagged", "SELECT CASE length(word) % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'n' ELSE 'g' END AS kind, word AS key, freq / 4.0::DOUBLE AS val FROM (" + FREQ_SQL + ")")
def io04(spark, d):
    path = fresh(spark, "io04")
    words(spark, d).select(_kind("wng").alias("kind"), F.col("word").alias("key"), (F.col("freq") / 4.0).alias("val")).write.csv(path, sep="\t", compression="gzip")
    kinds = [rows.select(F.lit(k).alias("kind"), "key", "val") for k, rows in files.tagged(spark, path).items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("io05_frequencies", FREQ_SQL)
def io05(spark, d):
    path = fresh(spark, "io05")
    files.write_lexicon(words(spark, d), path)
    return files.frequencies(spark, path)


@query("io07_table", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_custkey::VARCHAR AS o_custkey FROM orders")
def io07(spark, d):
    path = fresh(spark, "io07")
    read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").write.csv(path, header=True)
    return files.table(spark, path, ",")


@query("io08_pair_sheet", f"SELECT word AS todo, reverse(word) AS xudam FROM ({FREQ_SQL})")
def io08(spark, d):
    path = fresh(spark, "io08")
    words(spark, d).select(F.col("word").alias("todo"), F.reverse("word").alias("xudam")).write.csv(path, header=True)
    return files.pair_sheet(spark, path)


@query("io12_append_lines", "SELECT event_type AS event, event_id AS id, user_id FROM events")
def io12(spark, d):
    path = fresh(spark, "io12")
    rows = read(spark, d, "events").select(F.col("event_type").alias("event"), F.col("event_id").alias("id"), "user_id")
    for part in (0, 1):
        files.append_lines(rows.where(F.pmod("id", F.lit(2)) == part), path)
    return files.json_lines(spark, path, "event string, id long, user_id long").select("x.event", "x.id", "x.user_id")


@query("io13_export", "SELECT event_id::VARCHAR AS event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 'a, \"b\"' ELSE '' END AS note FROM events")
def io13(spark, d):
    path = fresh(spark, "io13")
    note = F.when(F.pmod("event_id", F.lit(5)) == 0, 'a, "b"').otherwise("")
    files.write_export(read(spark, d, "events").select("event_id", "event_type", note.alias("note")), path)
    return spark.read.csv(path, header=True, escape="\\", emptyValue="").toDF("event_id", "event_type", "note").withColumn("note", F.coalesce("note", F.lit("")))


@query("io14_report", f"SELECT word, freq::VARCHAR AS freq FROM ({FREQ_SQL}) WHERE freq >= 2")
def io14(spark, d):
    path = fresh(spark, "io14")
    files.write_report(words(spark, d).where("freq >= 2"), path)
    return files.table(spark, path)

"""Scans and sinks: JSON lines, tab-separated lexicons, corpora, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "book_id string, text string, ocr_suspect boolean, foreign_words array<struct<word:string,kind:string>>"
EVENT = "event string, id long, request_id long, user_id long, username string, chat_id long, target string, input_text string, rating string, correction string, created_at string"
VOCAB = "word string, freq long, kind string"
TAGGED = "kind string, key string, val double"


def json_lines(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """(line, x): every line that isn't blank, with its parsed form; a broken one has x.event null."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parse_lines(lines, schema)


def parse_lines(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    return lines.where(F.trim("line") != "").withColumn("x", F.from_json("line", schema))


def corpus(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Corpus sentences; suspect ones and excluded books are filtered at the scan."""
    return usable(spark.read.schema(CORPUS).json(path), F.col("ocr_suspect"), F.col("book_id"), exclude)


def usable(df: DataFrame, suspect: Column, book: Column, exclude: tuple[str, ...]) -> DataFrame:
    kept = df.where(~F.coalesce(suspect, F.lit(False)))
    return kept.where(~book.isin(*exclude)) if exclude else kept


def vocabulary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A lexicon file (plain or gzip), split by kind: d trusted, k corpus, r protected."""
    rows = spark.read.schema(VOCAB).csv(path, sep="\t")
    return {k: rows.where(F.col("kind") == k).select("word", "freq") for k in "dkr"}


def tagged(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Language data: w Russian words, n names, g n-gram weights."""
    rows = spark.read.schema(TAGGED).csv(path, sep="\t")
    return {k: rows.where(F.col("kind") == k).select("key", "val") for k in "wng"}


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, freq long").csv(path, sep="\t")


def table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A file with a header line."""
    return spark.read.csv(path, header=True, sep=sep)


def pair_sheet(spark: SparkSession, path: str, header: tuple[str, ...] = ("todo", "xudam")) -> DataFrame:
    """A dictionary sheet exported as CSV; its header must be the given one."""
    rows = spark.read.csv(path, header=True)
    if tuple(rows.columns) != header:
        raise ValueError(f"the header is {tuple(rows.columns)}, not {header}")
    return rows


def images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,webp}", most: int = 50_000_000) -> DataFrame:
    """Image files with kind, width and height read from the header alone; ones of more than ``most`` pixels are marked, and never decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return image_headers(files, most)


def image_headers(files: DataFrame, most: int = 50_000_000) -> DataFrame:
    """PNG and WebP (VP8X) sizes from fixed places of the header, as SQL over the bytes; JPEG sizes stay null."""
    h = F.hex(F.substr("content", F.lit(1), F.lit(32)))
    number = lambda a, n: F.conv(F.substr(h, F.lit(2 * a + 1), F.lit(2 * n)), 16, 10).cast("long")
    kind = F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("52494646") & (F.substr(h, F.lit(17), F.lit(8)) == "57454250"), "webp")
    out = files.withColumns({"kind": kind, "width": F.when(kind == "png", number(16, 4)), "height": F.when(kind == "png", number(20, 4))})
    return out.withColumn("too_large", F.coalesce(F.col("width") * F.col("height") > most, F.lit(False)))


def write_lexicon(freq: DataFrame, path: str) -> None:
    """One gzip TSV in the order (-freq, word). A lexicon is small beside its corpus; one file is the format."""
    freq.select("word", "freq").orderBy(F.desc("freq"), "word").coalesce(1).write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def write_export(df: DataFrame, path: str) -> None:
    """CSV with a header line, even if empty, that begins with a byte-order mark."""
    first = df.columns[0]
    marked = df.withColumnRenamed(first, "\ufeff" + first)
    marked.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def append_lines(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)

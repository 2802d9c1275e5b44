"""Parallel-text lookups: interval, box and prefix joins, dictionary ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphflow.functions import greedy


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Points with the spans that hold them (both ends included), by an equi-join on cells of ``width`` instead of a nested loop.

    A span takes part once per cell it touches; a width near the usual span keeps that to one or two."""
    by = by or []
    cells = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(cells))
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    return p.join(s, [*by, "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")


def nearest_line(clicks: DataFrame, boxes: DataFrame, slack: int = 4, width: int = 64) -> DataFrame:
    """For each click (click, page, x, y) the line of its column (x within the box and ``slack``) nearest in y, ties by line."""
    wide = boxes.withColumns({"_x0": F.col("x0") - slack, "_x1": F.col("x1") + slack})
    found = interval_join(clicks, wide, "x", "_x0", "_x1", width, ["page"])
    distance = F.greatest(F.col("y0") - F.col("y"), F.col("y") - F.col("y1"), F.lit(0))
    return found.groupBy("click").agg(F.min(F.struct(distance.alias("d"), "line")).alias("m")).select("click", F.col("m.line").alias("line"), F.col("m.d").alias("distance"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.char_length(a), F.char_length(b))
    first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(first, F.lit(0)) - 1, n))


def prefix_join(queries: DataFrame, heads: DataFrame) -> DataFrame:
    """(query, head, lcp, score) of heads that share a prefix of three letters or more, and all but four of the head's.

    A head meets the queries at the at most five prefixes that may be shared, by equality, so that a common beginning makes no pairs by itself."""
    n = F.char_length("head")
    short = heads.where(n >= 3).select("head", F.explode(F.sequence(F.greatest(F.lit(3), n - 4), n)).alias("lcp")).select("head", "lcp", F.expr("left(head, lcp)").alias("_k"))
    cut = queries.where(F.char_length("query") >= 3).select("query", F.explode(F.sequence(F.lit(3), F.char_length("query"))).alias("_n")).select("query", F.expr("left(query, _n)").alias("_k"))
    scored = cut.join(short, "_k").groupBy("query", "head").agg(F.max("lcp").alias("lcp"))
    apart = F.abs(F.char_length("query") - n)
    return scored.withColumn("score", 2 * F.col("lcp") - 0.5 * apart + F.when(F.col("lcp") == n, 3).otherwise(0))


def verb_join(queries: DataFrame, heads: DataFrame, ending: str, suffixes: str) -> DataFrame:
    """Words that are the stem of a headword (without its ``ending``) and a verb suffix: (query, head, stem, rest)."""
    stems = heads.where(F.col("head").endswith(ending) & (F.char_length("head") > len(ending) + 1)).select("head", F.expr(f"left(head, char_length(head) - {len(ending)})").alias("stem"))
    n = F.char_length("query")
    cuts = queries.where(n >= 2).select("query", F.explode(F.sequence(F.lit(2), n)).alias("k")).select("query", F.expr("left(query, k)").alias("stem"), F.expr("substr(query, k + 1)").alias("rest"))
    return cuts.join(stems, "stem").where(F.col("rest").rlike(f"^(?:{suffixes})$"))


def rank_entries(found: DataFrame, context: DataFrame, k: int = 6) -> DataFrame:
    """Best k headwords per query. found: query, head, exact, prefix_score, suffix, freq, pos_ok; context: query, stems (array of strings), head_stems."""
    score = (
        F.when(F.col("exact"), 100.0).otherwise(0.0) + F.coalesce("prefix_score", F.lit(0.0)) + F.when(F.col("suffix"), 6.0).otherwise(0.0)
        + F.when(F.col("pos_ok"), 1.0).otherwise(-1.0) + 2 * F.size(F.array_intersect("head_stems", "stems")) + 0.3 * F.log1p(F.col("freq").cast("double"))
    )
    rows = found.join(context, "query", "left").withColumn("stems", F.coalesce("stems", F.array().cast("array<string>"))).withColumn("score", F.round(score, 6))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "head"))).where(F.col("rank") <= k)


def phrases(words: Column, lexicon: Column, width: int) -> Column:
    """Greedy longest phrases of an array of words: spans of single-space-joined words in the lexicon, not longer than ``width``, else single words."""
    return greedy.by_row(greedy.phrases(width), words, lexicon)

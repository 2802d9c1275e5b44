"""Language of short texts by votes of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow import tables as t
from glyphflow.functions import tokens


def ngram_scores(words: DataFrame, weights: DataFrame) -> DataFrame:
    """(word, score): mean weight of the word's known n-grams, 0 without any. ``weights``: g, weight."""
    distinct = words.select("word").distinct()
    grams = distinct.select("word", F.explode(tokens.ngrams(F.col("word"))).alias("g"))
    known = grams.join(weights, "g").groupBy("word").agg(F.avg("weight").alias("score"))
    return distinct.join(known, "word", "left").select("word", F.coalesce("score", F.lit(0.0)).alias("score"))


def sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of each class above each threshold: (threshold, tpr, fpr) from (score, positive). One pass: thresholds are exploded per partial sum only."""
    points = scores.select("positive", F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), (F.col("score") > x).cast("int").alias("over")) for x in thresholds])).alias("p"))
    return points.groupBy("p.threshold").agg(
        F.round(F.avg(F.when(F.col("positive"), F.col("p.over"))), 6).alias("tpr"), F.round(F.avg(F.when(~F.col("positive"), F.col("p.over"))), 6).alias("fpr")
    )


def token_class(home: Column, ru: Column, name: Column, capital: Column, score: Column, word: Column) -> Column:
    """home, name, ru or null, by the first rule that holds."""
    mixed = word.contains("дж")
    return (
        F.when(home & ~mixed & ~(ru & ~name), "home")
        .when((name & (capital | ~ru)) | (mixed & (F.char_length(word) >= 4)), "name")
        .when(ru & (score > -0.3), "ru")
        .when(capital & word.rlike("(ов|ев|ин|ова|ева|ина|ский|ская)$") & (F.char_length(word) >= 5), "name")
        .when(score >= 1.0, "name")
        .when(score <= -0.3, "home")
    )


def vote(n: Column, home: Column, ru: Column, name: Column) -> Column:
    """kalmyk, russian or name, by shares."""
    foreign = ru + name
    return (
        F.when((2 * home >= n) | ((home >= 1) & (3 * home > foreign)), "kalmyk")
        .when((ru >= 1) & (10 * foreign >= 6 * n) & (ru >= name), "russian")
        .when((name >= 1) & (10 * foreign >= 6 * n), "name")
        .otherwise("kalmyk")
    )


def check(texts: DataFrame, lexicon: DataFrame, ru: DataFrame, names: DataFrame, weights: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, home, ru, name, kind). A special letter settles it; else the tokens of two letters or more vote."""
    text = tokens.normalize_lookalikes(F.col(text_col))
    base = texts.select(F.col(id_col).alias("id"), text.alias("text"), F.lower(text).rlike(f"[{t.SPECIAL}]").alias("special"))
    toks = base.select("id", F.explode(tokens.words(F.col("text"), tokens.CYRILLIC_WORD)).alias("raw")).withColumn("word", F.lower("raw")).where(F.char_length("word") >= 2)
    words = toks.select("word").distinct()
    flag = lambda df, name: df.select("word").distinct().withColumn(name, F.lit(True))
    facts = words.join(flag(lexicon, "home"), "word", "left").join(flag(ru, "ru"), "word", "left").join(flag(names, "name"), "word", "left").na.fill(False).join(ngram_scores(words, weights), "word")
    classed = toks.join(facts, "word").withColumn("class", token_class(F.col("home"), F.col("ru"), F.col("name"), F.col("raw").rlike("^[А-ЯЁ][а-яё]+"), F.col("score"), F.col("word")))
    sums = classed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("class") == c).alias(c) for c in ("home", "ru", "name")])
    rows = base.join(sums, "id", "left").na.fill(0, ["n", "home", "ru", "name"])
    kind = F.when(F.col("special") | (F.col("n") == 0), "kalmyk").otherwise(vote(F.col("n"), F.col("home"), F.col("ru"), F.col("name")))
    return rows.select("id", "n", "home", "ru", "name", kind.alias("kind"))

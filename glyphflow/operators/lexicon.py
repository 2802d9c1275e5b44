"""Corpus jobs: frequency lexicons, letter statistics, suffix tables, n-gram models, splits, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphflow.functions import letters, tokens
from glyphflow.operators import graph


def occurrences(docs: DataFrame, text_col: str = "text", pattern: str = r"\p{L}+", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token, lower-cased: ``keep`` columns and word."""
    return docs.select(*keep, F.explode(tokens.words(F.lower(F.col(text_col)), pattern)).alias("word"))


def frequencies(docs: DataFrame, by: tuple[str, ...] = (), **options) -> DataFrame:
    """Word counts, of the whole or by columns."""
    return occurrences(docs, keep=by, **options).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("freq"))


def top(freq: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent words (of each group), ties by word."""
    order = [F.col("freq").desc(), F.col("word")]
    if not by:
        return freq.orderBy(*order).limit(k)
    return freq.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def letter_distribution(freq: DataFrame) -> DataFrame:
    """Letters weighted by word frequency."""
    return freq.select(F.explode(F.split("word", "")).alias("letter"), "freq").groupBy("letter").agg(F.sum("freq").alias("n"))


def letter_contexts(freq: DataFrame, special: str, vowels: str, k: int = 12) -> DataFrame:
    """For each special letter and kind of neighbourhood (start, vowel or consonant before; the same after): weight, words, top examples."""
    kind = lambda c, edge: F.when(c.isNull() | (c == ""), edge).when(c.rlike(f"[{vowels}]"), "V").otherwise("C")
    chars = F.col("chars")
    spots = freq.withColumn("chars", F.split("word", "")).select(
        "word", "freq",
        F.explode(F.transform(chars, lambda c, i: F.struct(c.alias("letter"), F.concat(kind(F.get(chars, i - 1), "^"), F.lit("_"), kind(F.get(chars, i + 1), "$")).alias("kind")))).alias("s"),
    )
    each = spots.where(F.col("s.letter").rlike(f"[{special}]")).select("word", "freq", "s.letter", "s.kind").distinct()
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("letter", "kind").orderBy(F.desc("freq"), "word")))
    return ranked.groupBy("letter", "kind").agg(
        F.sum("freq").alias("weight"), F.count(F.lit(1)).alias("words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "word")))), lambda x: x["word"]), ",").alias("examples"),
    )


def row_pivot(freq: DataFrame, consonants: str, back: str, front: str) -> DataFrame:
    """Consonant by vowel row of the words it occurs in: summed frequency."""
    rows = freq.select("freq", letters.vowel_row(F.col("word"), back, front).alias("row"), F.explode(F.array_distinct(F.split("word", ""))).alias("cons"))
    return rows.where(F.col("cons").rlike(f"^[{consonants}]$")).groupBy("cons").pivot("row", ["b", "f", "m", "n"]).agg(F.sum("freq")).na.fill(0)


def nearest_vowels(freq: DataFrame, consonant: str, vowels: str) -> DataFrame:
    """The first vowel to the right of the consonant, else the last to its left: weights."""
    right = F.regexp_extract("word", f"{consonant}[^{vowels}]*([{vowels}])", 1)
    left = F.regexp_extract("word", f"([{vowels}])[^{vowels}]*{consonant}", 1)
    near = F.when(right != "", right).when(left != "", left).otherwise("-")
    return freq.where(F.col("word").contains(consonant)).groupBy(near.alias("vowel")).agg(F.sum("freq").alias("n"))


def splits(freq: DataFrame, longest: int, least_stem: int) -> DataFrame:
    """Every stem and tail of every word: word, freq, stem, tail."""
    n = F.char_length("word")
    cut = F.sequence(F.lit(1), F.greatest(F.least(F.lit(longest), n - least_stem), F.lit(1)))
    return freq.where(n > least_stem).select("word", "freq", F.explode(cut).alias("k")).select(
        "word", "freq", F.expr("left(word, char_length(word) - k)").alias("stem"), F.expr("right(word, k)").alias("tail")
    )


def suffix_table(freq: DataFrame, back: str, front: str, longest: int = 5, least_stem: int = 3, stem_freq: int = 3, least: int = 30) -> DataFrame:
    """Tails that follow good stems of a vowel row, weighted by word frequency."""
    good = freq.where(F.col("freq") >= stem_freq).select(F.col("word").alias("stem"))
    found = splits(freq, longest, least_stem).join(good, "stem", "left_semi")
    return (
        found.groupBy(letters.vowel_row(F.col("stem"), back, front).alias("row"), "tail").agg(F.sum("freq").alias("n")).where(F.col("n") >= least)
    )


def gram_counts(freq: DataFrame, by: str | None = None) -> DataFrame:
    keep = [by] if by else []
    return freq.select(*keep, "freq", F.explode(tokens.ngrams(F.col("word"))).alias("g")).groupBy(*keep, "g").agg(F.sum("freq").alias("n"))


def llr_model(freq: DataFrame, label: str, one: str, other: str, least: int = 8, smooth: float = 0.5) -> DataFrame:
    """n-grams and the log ratio of their rates in two classes; totals come from the same pass."""
    counted = freq.where(F.col(label).isin(one, other)).select(label, "freq", F.explode(tokens.ngrams(F.col("word"))).alias("g"))
    sums = counted.groupBy("g").agg(
        F.sum(F.when(F.col(label) == one, F.col("freq")).otherwise(0)).alias("a"), F.sum(F.when(F.col(label) == other, F.col("freq")).otherwise(0)).alias("b")
    )
    totals = sums.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))  # one row
    ratio = F.log((F.col("a") + smooth) / (F.col("ta") + smooth)) - F.log((F.col("b") + smooth) / (F.col("tb") + smooth))
    return sums.where(F.col("a") + F.col("b") >= least).join(F.broadcast(totals)).select("g", "a", "b", F.round(ratio, 6).alias("llr"))


def class_lexicon(freq: DataFrame, label: str, one: str, other: str, times: int = 5) -> DataFrame:
    """Words of the one class: twice or more, two letters or more, and at least ``times`` as frequent there, relatively."""
    sums = freq.where(F.col(label).isin(one, other)).groupBy("word").agg(
        F.sum(F.when(F.col(label) == one, F.col("freq")).otherwise(0)).alias("a"), F.sum(F.when(F.col(label) == other, F.col("freq")).otherwise(0)).alias("b")
    )
    totals = sums.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return (
        sums.join(F.broadcast(totals)).where((F.col("a") >= 2) & (F.char_length("word") >= 2) & (F.col("a") * F.col("tb") >= times * F.col("b") * F.col("ta"))).select("word", "a", "b")
    )


def lm_counts(types: DataFrame, order: int = 5) -> DataFrame:
    """Witten-Bell counts over word types: (k, ctx, c, cnt, ctx_n, ctx_t) for contexts of 0 to order-1 letters."""
    w = F.concat(F.lit("^" * (order - 1)), F.col("word"), F.lit("$"))
    spots = types.select(w.alias("w"), F.explode(F.sequence(F.lit(order), F.char_length(w))).alias("i"))
    grams = spots.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"substr(w, i - {k - 1}, {k - 1})").alias("ctx"), F.expr("substr(w, i, 1)").alias("c")) for k in range(1, order + 1)])).alias("x"))
    counts = grams.groupBy("x.k", "x.ctx", "x.c").agg(F.count(F.lit(1)).alias("cnt"))
    context = counts.groupBy("k", "ctx").agg(F.sum("cnt").alias("ctx_n"), F.count(F.lit(1)).alias("ctx_t"))
    return counts.join(context, ["k", "ctx"])


def hash_sample(df: DataFrame, key: Column, n: int, seed: str = "42") -> DataFrame:
    """n rows in the order of a digest of the key: the same rows on every run and every layout."""
    return df.withColumn("_h", F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)).orderBy("_h").limit(n).drop("_h")


def hash_split(key: Column) -> Column:
    """test, validation or train by the first byte of a digest."""
    byte = F.conv(F.left(F.sha2(key, 256), F.lit(2)), 16, 10).cast("int")
    return F.when(byte < 26, "test").when(byte < 52, "validation").otherwise("train")


def noise(freq: DataFrame, by: Column, times: int = 5) -> DataFrame:
    """Words of which a word with the same key is at least ``times`` as frequent.

    Against the maximum of each key, so no pair of words is formed."""
    keyed = freq.withColumn("_key", by)
    best = keyed.groupBy("_key").agg(F.max("freq").alias("best"))
    return keyed.join(best, "_key").where(F.col("best") >= times * F.col("freq")).drop("_key")


def collisions(freq: DataFrame, styles: list[Column]) -> DataFrame:
    """Words whose typed form is itself a word: word, freq, typed, typed_freq."""
    typed = freq.select("word", "freq", F.explode(F.array_distinct(F.array(*styles))).alias("typed")).where("typed != word")
    return typed.join(freq.select(F.col("word").alias("typed"), F.col("freq").alias("typed_freq")), "typed")


def prepare_pairs(pairs: DataFrame, a: str, b: str, longest: int = 32, spelling: str = r"^[\p{L}' -]+$") -> DataFrame:
    """Pairs with the reason of rejection: missing, non_spelling, too_long, duplicate (all but one), or ok."""
    x, y = F.col(a), F.col(b)
    reason = (
        F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), "missing")
        .when(~(x.rlike(spelling) & y.rlike(spelling)), "non_spelling")
        .when((F.char_length(x) > longest) | (F.char_length(y) > longest), "too_long")
    )
    counted = pairs.withColumn("reason", reason).groupBy(a, b, "reason").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where("reason IS NULL")
    return counted.where("reason IS NOT NULL").unionByName(kept.withColumns({"reason": F.lit("ok"), "n": F.lit(1).cast("long")})).unionByName(
        kept.where("n > 1").withColumns({"reason": F.lit("duplicate"), "n": F.col("n") - 1})
    )


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that share either side belong together: each pair with the least key of its component, which is one of side ``a``."""
    edges = pairs.select(F.concat(F.lit("b:"), F.col(b)).alias("u"), F.concat(F.lit("a:"), F.col(a)).alias("v"))
    found = graph.components(edges).where("node LIKE 'a:%'").select(F.substr("node", F.lit(3)).alias("_a"), "root")
    return pairs.join(found, F.col(a) == F.col("_a"), "left").withColumn("component", F.coalesce("root", F.concat(F.lit("a:"), F.col(a)))).drop("_a", "root")

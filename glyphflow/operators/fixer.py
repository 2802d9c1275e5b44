"""Letter fixing as joins: find what a word may have been, rank it, decide per text whether to touch it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphflow import tables as t
from glyphflow.functions import letters, scripts, tokens


def index(lexicon: DataFrame) -> DataFrame:
    """(skeleton, word, freq): the blocking key of a lexicon of (word, freq)."""
    return lexicon.select(letters.skeleton(F.col("word")).alias("skeleton"), "word", "freq")


def candidates(typed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """For distinct typed words (column typed): typed, word, freq, cost, subs. Blocked by skeleton, verified by the channel."""
    keys = typed.select("typed").distinct().select("typed", F.explode(letters.query_keys(F.col("typed"))).alias("skeleton"))
    pairs = keys.join(index(lexicon), "skeleton").select("typed", "word", "freq").distinct()
    found = pairs.withColumn("c", letters.channel_udf("word", "typed")).where("c.cost IS NOT NULL")
    start = F.regexp_replace("typed", "^йа", "я")  # a word may begin with йа for я, йу for ю
    start = F.regexp_replace(start, "^йу", "ю")
    other = typed.select("typed").distinct().where(F.col("typed").rlike("^й[ау]")).select("typed", start.alias("alt"))
    alt = (
        other.select("typed", "alt", F.explode(letters.query_keys(F.col("alt"))).alias("skeleton"))
        .join(index(lexicon), "skeleton").select("typed", "alt", "word", "freq").distinct()
        .withColumn("c", letters.channel_udf("word", "alt")).where("c.cost IS NOT NULL")
        .select("typed", "word", "freq", (F.col("c.cost") + 0.5).alias("cost"), F.col("c.subs").alias("subs"))
    )
    every = found.select("typed", "word", "freq", F.col("c.cost").alias("cost"), F.col("c.subs").alias("subs")).unionByName(alt)
    return every.groupBy("typed", "word", "freq").agg(F.min(F.struct("cost", "subs")).alias("c")).select("typed", "word", "freq", "c.cost", "c.subs")


def scored(cands: DataFrame, cost: str = "cost") -> DataFrame:
    return cands.withColumn("score", F.log(F.col("freq") + 1.0) - t.COST_WEIGHT * F.col(cost))


def best(cands: DataFrame, by: list[str]) -> DataFrame:
    """The candidate of the highest score, ties by frequency, then word; its margin over the next and how many there are."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.desc("freq"), "word")
    ranked = cands.withColumns({"rank": F.row_number().over(order), "next": F.lead("score").over(order), "many": F.count(F.lit(1)).over(W.partitionBy(*by))})
    return ranked.where("rank = 1").withColumn("margin", F.col("score") - F.col("next")).drop("rank", "next")


def typed_tokens(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, raw, typed): Cyrillic tokens after look-alikes are put right."""
    words = tokens.words(tokens.normalize_lookalikes(F.col(text_col)), tokens.CYRILLIC_WORD)
    return texts.select(F.col(id_col).alias("id"), F.posexplode(words).alias("pos", "raw")).withColumn("typed", F.lower("raw"))


def protected(words: DataFrame, stems: DataFrame, longest: int = 4, least: int = 4) -> DataFrame:
    """Words that begin with a protected stem of at least ``least`` letters and end within ``longest`` more: a semi join on prefixes."""
    n = F.char_length("typed")
    cut = F.sequence(F.greatest(n - longest, F.lit(least)), F.greatest(n, F.lit(least)))
    prefixes = words.where(n >= least).select("typed", F.explode(cut).alias("k")).select("typed", F.expr("left(typed, k)").alias("stem"))
    return prefixes.join(stems.select("stem"), "stem", "left_semi").select("typed").distinct()


def detect(texts: DataFrame, lexicon: DataFrame, stems: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, sp, hard, voc, russian, flag): why a text counts as typed without its letters, or ''."""
    toks = typed_tokens(texts, id_col, text_col)
    words = toks.select("typed").distinct()
    oov = words.join(lexicon.select(F.col("word").alias("typed")), "typed", "left_anti").join(protected(words, stems), "typed", "left_anti")
    picked = best(scored(candidates(oov, lexicon)), ["typed"]).select("typed", "word")
    marked = (
        oov.join(picked, "typed", "left")
        .select("typed", F.col("typed").rlike(tokens.HARD).alias("hard"), (F.coalesce(F.col("word") != F.col("typed"), F.lit(False)) & F.coalesce(F.col("word").rlike(f"[{t.SPECIAL}]"), F.lit(False))).alias("voc"))
    )
    counted = toks.join(marked, "typed", "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("typed").rlike(f"[{t.SPECIAL}]")).alias("sp"),
        F.count_if(F.coalesce("hard", F.lit(False))).alias("hard"), F.count_if(F.coalesce("voc", F.lit(False))).alias("voc"),
    )
    mixed = F.size(F.filter(tokens.words(F.col(text_col), tokens.ANY_TOKEN), lambda w: tokens.foreign(w)))
    base = texts.select(F.col(id_col).alias("id"), mixed.alias("dbl"), tokens.is_russian(F.col(text_col)).alias("russian"))
    rows = base.join(counted, "id", "left").na.fill(0, ["n", "sp", "hard", "voc"])
    flag = (
        F.when(F.col("russian"), "")
        .when((F.col("dbl") > 0) | (F.col("hard") > 0), "hard")
        .when((F.col("sp") == 0) & (F.col("voc") >= 1), "vocab")
        .when((F.col("sp") == 0) & (F.col("n") >= 7), "length")
        .when((F.col("voc") >= 2) & (100 * F.col("voc") >= 15 * F.col("n")), "partial")
        .otherwise("")
    )
    return rows.withColumn("flag", flag)


def habits(toks: DataFrame, picked: DataFrame) -> DataFrame:
    """(id, letter, typed_as): substitutions of unambiguous words (one candidate, or a margin over 2) in each text."""
    sure = picked.where((F.col("many") == 1) | (F.col("margin") > 2)).select("typed", "subs")
    return toks.join(sure, "typed").select("id", F.explode("subs").alias("s")).select("id", F.col("s.letter").alias("letter"), F.col("s.typed").alias("typed_as")).distinct()


def stem_candidates(oov: DataFrame, lexicon: DataFrame, suffixes: DataFrame, top: int = 3) -> DataFrame:
    """Stem and ending where the whole word is unknown: (typed, word, score). ``suffixes``: row, tail, n."""
    parts = oov.select(F.col("typed").alias("word"), F.lit(0).alias("freq"))
    n = F.char_length("word")
    cut = F.sequence(F.lit(1), F.greatest(F.least(F.lit(t.SUFFIX_MAX), n - t.STEM_MIN), F.lit(1)))
    parts = parts.where(n > t.STEM_MIN).select(F.col("word").alias("whole"), F.explode(cut).alias("k")).select("whole", F.expr("left(whole, char_length(whole) - k)").alias("typed"), F.expr("right(whole, k)").alias("end"))
    good = scored(candidates(parts, lexicon.where(F.col("freq") >= t.STEM_MIN_FREQ)))
    stems = good.withColumn("r", F.row_number().over(W.partitionBy("typed").orderBy(F.desc("score"), "word"))).where(F.col("r") <= top)
    stems = stems.select("typed", F.col("word").alias("stem"), F.col("score").alias("stem_score"), letters.vowel_row(F.col("word")).alias("row"))
    tails = suffixes.select("row", "tail", "n", letters.skeleton(F.col("tail")).alias("tail_key"))
    joined = parts.join(stems, "typed").withColumn("tail_key", letters.skeleton(F.col("end"))).join(tails, ["row", "tail_key"])
    checked = joined.withColumn("c", letters.channel_udf("tail", "end")).where("c.cost IS NOT NULL")
    score = F.col("stem_score") + F.log(F.col("n").cast("double")) - t.COST_WEIGHT * F.col("c.cost") - t.SPLIT_PENALTY
    return checked.select(F.col("whole").alias("typed"), F.concat("stem", "tail").alias("word"), score.alias("score"), F.col("n").alias("freq"))


def fix(texts: DataFrame, lexicon: DataFrame, stems: DataFrame, suffixes: DataFrame | None = None, force: bool = False, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text, flag, fixes): two passes, the second with the habits that the first has found. Lexicon words never change."""
    flags = detect(texts, lexicon, stems, id_col, text_col).select("id", "flag", "russian")
    toks = typed_tokens(texts, id_col, text_col)
    words = toks.select("typed").distinct()
    oov = words.join(lexicon.select(F.col("word").alias("typed")), "typed", "left_anti").join(protected(words, stems), "typed", "left_anti")
    cands = candidates(oov, lexicon)
    known = habits(toks, best(scored(cands), ["typed"]))
    per_text = toks.select("id", "typed").distinct().join(cands, "typed").join(known.groupBy("id").agg(F.collect_set(F.concat_ws(">", "letter", "typed_as")).alias("habits")), "id", "left")
    costs = F.create_map(*[F.lit(x) for a, b in t.SUBSTITUTIONS.items() for k, c in b.items() for x in (f"{a}>{k}", c)])
    saved = F.aggregate("subs", F.lit(0.0), lambda s, x: s + F.when(F.array_contains(F.coalesce("habits", F.array().cast("array<string>")), F.concat_ws(">", x["letter"], x["typed"])), F.element_at(costs, F.concat_ws(">", x["letter"], x["typed"]))).otherwise(0.0))
    second = best(scored(per_text.withColumn("cheaper", F.col("cost") - (1 - t.HABIT_DISCOUNT) * saved), "cheaper"), ["id", "typed"]).select("id", "typed", "word")
    if suffixes is not None:
        rest = oov.join(cands.select("typed").distinct(), "typed", "left_anti")
        split = best(stem_candidates(rest, lexicon, suffixes), ["typed"]).select("typed", "word")
        second = second.unionByName(toks.select("id", "typed").distinct().join(split, "typed").select("id", "typed", "word"))
    chosen = toks.join(second, ["id", "typed"]).withColumn("fixed", scripts.case_like(F.col("word"), F.col("raw"))).where("fixed != raw")
    plain = texts.select(F.col(id_col).alias("id"), tokens.normalize_lookalikes(F.col(text_col)).alias("plain")).join(flags, "id")
    go = ~F.col("russian") & (F.lit(force) | (F.col("flag") != ""))
    gathered = chosen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "raw", "fixed"))).alias("fixes"))
    rows = plain.join(gathered, "id", "left")
    at = F.map_from_entries(F.transform("fixes", lambda x: F.struct(x["pos"], x["fixed"])))
    marked = F.split(F.regexp_replace("plain", tokens.CYRILLIC_WORD, "\u0001$0\u0001"), "\u0001", -1)
    new = F.array_join(F.transform(marked, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at(at, ((i - 1) / 2).cast("int")), p)).otherwise(p)), "")
    return rows.select("id", F.when(go & F.col("fixes").isNotNull(), new).otherwise(F.col("plain")).alias("text"), "flag", F.when(go, F.col("fixes")).alias("fixes"))

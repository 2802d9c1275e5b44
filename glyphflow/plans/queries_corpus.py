"""Queries of lexicon jobs, similarity joins, language and models of letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphflow import tables as t
from glyphflow.functions import letters, scripts, tokens
from glyphflow.operators import convert, fixer, language, lexicon, lm, models, reader
from glyphflow.plans import sql as s
from glyphflow.plans.catalog import FREQ_LANG_SQL, FREQ_SQL, WORDS_SQL, local, query, read

BACK, FRONT = "aouáóú", "eiéèêäöü"
ROW_SQL = f"CASE WHEN regexp_matches({{0}}, '[{BACK}]') AND regexp_matches({{0}}, '[{FRONT}]') THEN 'm' WHEN regexp_matches({{0}}, '[{BACK}]') THEN 'b' WHEN regexp_matches({{0}}, '[{FRONT}]') THEN 'f' ELSE 'n' END"
SKELETON = f"translate({{0}}, '{t.LATIN_SKELETON_FROM}', '{t.LATIN_SKELETON_TO}')"


def docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", "source", "text")


def freq(spark, d):
    return lexicon.frequencies(docs(spark, d))


def by_lang(spark, d):
    return lexicon.frequencies(docs(spark, d), by=("lang",))


def latin_skeleton(c):
    return letters.skeleton(c, t.LATIN_SKELETON_FROM, t.LATIN_SKELETON_TO)


# --- frequencies and statistics -------------------------------------------------------------------------------------------------------
query("a03_word_freq", FREQ_LANG_SQL)(by_lang)
query("a04_piece_freq", r"SELECT word, count(*) AS freq FROM (SELECT unnest(string_split_regex(lower(text), '[- ]+')) AS word FROM documents WHERE regexp_matches(text, '^\p{L}')) WHERE word <> '' GROUP BY word")(
    lambda spark, d: docs(spark, d).where(F.col("text").rlike(r"^\p{L}")).select(F.explode(F.split(F.lower("text"), "[- ]+")).alias("word")).where("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
)
query("a14_top_words", f"SELECT lang, word, freq, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, word) AS rank FROM ({FREQ_LANG_SQL})) WHERE rank <= 20")(lambda spark, d: lexicon.top(by_lang(spark, d), 20, ("lang",)))
query("io11_ordered_lexicon", f"SELECT word, freq FROM ({FREQ_SQL}) ORDER BY freq DESC, word")(lambda spark, d: freq(spark, d).orderBy(F.desc("freq"), "word"))
query("a05_letter_dist", f"SELECT letter, sum(freq)::BIGINT AS n FROM (SELECT unnest(string_split(word, '')) AS letter, freq FROM ({FREQ_SQL})) GROUP BY letter")(lambda spark, d: lexicon.letter_distribution(freq(spark, d)))
query(
    "a06_letter_contexts",
    f"""WITH k AS (SELECT DISTINCT word, freq, c AS letter, kl || '_' || kr AS kind FROM (SELECT word, freq, substr(word, i, 1) AS c,
      CASE WHEN i = 1 THEN '^' WHEN regexp_matches(substr(word, i - 1, 1), '[aeiou]') THEN 'V' ELSE 'C' END AS kl, CASE WHEN i = length(word) THEN '$' WHEN regexp_matches(substr(word, i + 1, 1), '[aeiou]') THEN 'V' ELSE 'C' END AS kr
      FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM ({FREQ_SQL}))) WHERE regexp_matches(c, '[éèäöüñç]')),
    r AS (SELECT *, row_number() OVER (PARTITION BY letter, kind ORDER BY freq DESC, word) AS rank FROM k)
    SELECT letter, kind, sum(freq)::BIGINT AS weight, count(*) AS words, string_agg(word, ',' ORDER BY rank) FILTER (rank <= 12) AS examples FROM r GROUP BY letter, kind""",
)(lambda spark, d: lexicon.letter_contexts(freq(spark, d), "éèäöüñç", "aeiou"))
query(
    "a07_pivot_rows",
    f"""SELECT cons, coalesce(sum(freq) FILTER (r = 'b'), 0)::BIGINT AS b, coalesce(sum(freq) FILTER (r = 'f'), 0)::BIGINT AS f, coalesce(sum(freq) FILTER (r = 'm'), 0)::BIGINT AS m, coalesce(sum(freq) FILTER (r = 'n'), 0)::BIGINT AS n
    FROM (SELECT freq, {ROW_SQL.format('word')} AS r, unnest(list_distinct(string_split(word, ''))) AS cons FROM ({FREQ_SQL})) WHERE regexp_matches(cons, '^[bcdfghklmnprstv]$') GROUP BY cons""",
)(lambda spark, d: lexicon.row_pivot(freq(spark, d), "bcdfghklmnprstv", BACK, FRONT))
query(
    "a08_nearest_vowels",
    f"""SELECT vowel, sum(freq)::BIGINT AS n FROM (SELECT freq, CASE WHEN regexp_extract(word, 'g[^aeiou]*([aeiou])', 1) <> '' THEN regexp_extract(word, 'g[^aeiou]*([aeiou])', 1)
    WHEN regexp_extract(word, '([aeiou])[^aeiou]*g', 1) <> '' THEN regexp_extract(word, '([aeiou])[^aeiou]*g', 1) ELSE '-' END AS vowel FROM ({FREQ_SQL}) WHERE contains(word, 'g')) GROUP BY vowel""",
)(lambda spark, d: lexicon.nearest_vowels(freq(spark, d), "g", "aeiou"))
query(
    "a09_suffixes",
    f"""WITH f AS ({FREQ_SQL}), c AS (SELECT freq, left(word, length(word) - k) AS stem, right(word, k) AS tail FROM (SELECT word, freq, unnest(range(1, least(5, length(word) - 3) + 1)) AS k FROM f WHERE length(word) > 3))
    SELECT {ROW_SQL.format('stem')} AS row, tail, sum(c.freq)::BIGINT AS n FROM c JOIN f ON f.word = c.stem AND f.freq >= 3 GROUP BY 1, 2 HAVING sum(c.freq) >= 30""",
)(lambda spark, d: lexicon.suffix_table(freq(spark, d), BACK, FRONT))
GRAMS_SQL = f"SELECT lang, freq, {s.ngrams('word')} FROM ({FREQ_LANG_SQL})"
query("t23_ngrams", f"SELECT lang, g, sum(freq)::BIGINT AS n FROM ({GRAMS_SQL}) GROUP BY lang, g")(lambda spark, d: lexicon.gram_counts(by_lang(spark, d), "lang"))
LLR_SQL = f"""WITH c AS (SELECT g, coalesce(sum(freq) FILTER (lang = 'en'), 0)::BIGINT AS a, coalesce(sum(freq) FILTER (lang = 'fr'), 0)::BIGINT AS b FROM ({GRAMS_SQL}) WHERE lang IN ('en', 'fr') GROUP BY g),
    t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c)
    SELECT g, a, b, round(ln((a + 0.5::DOUBLE) / (ta + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (tb + 0.5::DOUBLE)), 6) AS llr FROM c, t WHERE a + b >= 8"""
query("a10_ngram_llr", LLR_SQL)(lambda spark, d: lexicon.llr_model(by_lang(spark, d), "lang", "en", "fr"))
query(
    "a11_class_lexicon",
    f"""WITH c AS (SELECT word, coalesce(sum(freq) FILTER (lang = 'en'), 0)::BIGINT AS a, coalesce(sum(freq) FILTER (lang = 'fr'), 0)::BIGINT AS b FROM ({FREQ_LANG_SQL}) WHERE lang IN ('en', 'fr') GROUP BY word),
    t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c) SELECT word, a, b FROM c, t WHERE a >= 2 AND length(word) >= 2 AND a * tb >= 5 * b * ta""",
)(lambda spark, d: lexicon.class_lexicon(by_lang(spark, d), "lang", "en", "fr"))
LM_SQL = f"""WITH g AS (SELECT k, substr(w, i - k + 1, k - 1) AS ctx, substr(w, i, 1) AS c FROM (SELECT w, unnest(range(5, length(w) + 1)) AS i FROM (SELECT '^^^^' || word || '$' AS w FROM ({FREQ_SQL}))), (SELECT unnest(range(1, 6)) AS k)),
    n AS (SELECT k, ctx, c, count(*) AS cnt FROM g GROUP BY ALL), x AS (SELECT k, ctx, sum(cnt)::BIGINT AS ctx_n, count(*) AS ctx_t FROM n GROUP BY ALL)
    SELECT k::INTEGER AS k, ctx, c, cnt, ctx_n, ctx_t FROM n JOIN x USING (k, ctx)"""
query("a12_lm_counts", LM_SQL)(lambda spark, d: lexicon.lm_counts(freq(spark, d)))


@query("a13_lm_logp")
def a13(spark, d):
    f = freq(spark, d)
    return lm.log_probability(f, lexicon.lm_counts(f), 40).withColumn("logp", F.round("logp", 6))


SWEEP_SQL = f"""WITH m AS ({LLR_SQL}), w AS (SELECT lang, word FROM ({FREQ_LANG_SQL}) WHERE lang IN ('en', 'fr')),
    sc AS (SELECT lang, word, coalesce(avg(llr), 0) AS score FROM (SELECT lang, word, {s.ngrams('word')} FROM w) LEFT JOIN m USING (g) GROUP BY lang, word)
    SELECT {{0}}"""
query("j07_ngram_score", f"WITH m AS ({LLR_SQL}), w AS (SELECT DISTINCT word FROM ({FREQ_LANG_SQL}) WHERE lang IN ('en', 'fr')) SELECT word, coalesce(avg(round(llr * 1000000)), 0) AS score FROM (SELECT word, {s.ngrams('word')} FROM w) LEFT JOIN m USING (g) GROUP BY word")(
    lambda spark, d: language.ngram_scores(by_lang(spark, d).where("lang IN ('en', 'fr')"), lexicon.llr_model(by_lang(spark, d), "lang", "en", "fr").select("g", F.round(F.col("llr") * 1000000).alias("weight")))
)


@query("a20_threshold_sweep", SWEEP_SQL.replace("{0}", "threshold, round(avg((score > threshold)::INT) FILTER (lang = 'en'), 6) AS tpr, round(avg((score > threshold)::INT) FILTER (lang = 'fr'), 6) AS fpr FROM sc, (SELECT unnest([-1.03::DOUBLE, 0.07, 1.01, 2.03]) AS threshold) GROUP BY threshold"))
def a20(spark, d):
    words = by_lang(spark, d).where("lang IN ('en', 'fr')")
    scores = language.ngram_scores(words, lexicon.llr_model(words, "lang", "en", "fr").select("g", F.col("llr").alias("weight")))
    rows = words.select("lang", "word").join(scores, "word").select("score", (F.col("lang") == "en").alias("positive"))
    return language.sweep(rows, [-1.03, 0.07, 1.01, 2.03])


TRIGGERS = {"double": "(aa|ee|oo|nn|ss|tt)", "th": "th", "final_e": "e$", "special": "[éèêäöüßñçóí]", "cons_y": "[^aeiou]y"}


@query("a21_trigger_rates", f"SELECT lang, rule, round(100.0::DOUBLE * sum(CASE WHEN regexp_matches(word, pat) THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM ({WORDS_SQL}), " + s.values(list(TRIGGERS.items()), "rule, pat") + " GROUP BY lang, rule")
def a21(spark, d):
    counted = by_lang(spark, d)  # patterns meet distinct words, not tokens
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.when(F.col("word").rlike(p), F.col("freq")).otherwise(0).alias("hit")) for k, p in TRIGGERS.items()])
    rows = counted.select("lang", "freq", F.inline(rules))
    return rows.groupBy("lang", "rule").agg(F.round(F.lit(100.0) * F.sum("hit") / F.sum("freq"), 6).alias("pct"))


# --- splits, pairs, components ----------------------------------------------------------------------------------------------------------
query("a25_hash_split", "SELECT lang, split, count(*) AS n FROM (SELECT lang, CASE WHEN b < 26 THEN 'test' WHEN b < 52 THEN 'validation' ELSE 'train' END AS split FROM (SELECT lang, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT AS b FROM documents)) GROUP BY lang, split")(
    lambda spark, d: docs(spark, d).groupBy("lang", lexicon.hash_split(F.col("doc_id").cast("string")).alias("split")).agg(F.count(F.lit(1)).alias("n"))
)
query("a24_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id::VARCHAR) LIMIT 100")(lambda spark, d: lexicon.hash_sample(docs(spark, d).select("doc_id"), F.col("doc_id"), 100))
PAIRS_SQL = f"(SELECT word AS a, CASE WHEN length(word) % 11 = 0 THEN NULL ELSE {SKELETON.format('word')} END AS b FROM ({WORDS_SQL}))"


def pairs(spark, d):
    w = lexicon.occurrences(docs(spark, d))
    return w.select(F.col("word").alias("a"), F.when(F.char_length("word") % 11 != 0, latin_skeleton(F.col("word"))).alias("b"))


query(
    "a27_reject_reasons",
    f"""WITH p AS (SELECT a, b, CASE WHEN a IS NULL OR b IS NULL OR a = '' OR b = '' THEN 'missing' WHEN NOT (regexp_matches(a, '^[\\p{{L}}'' -]+$') AND regexp_matches(b, '^[\\p{{L}}'' -]+$')) THEN 'non_spelling'
      WHEN length(a) > 32 OR length(b) > 32 THEN 'too_long' END AS reason, count(*) AS n FROM {PAIRS_SQL} GROUP BY ALL)
    SELECT reason, sum(n)::BIGINT AS n FROM (SELECT reason, n FROM p WHERE reason IS NOT NULL UNION ALL SELECT 'ok', 1 FROM p WHERE reason IS NULL UNION ALL SELECT 'duplicate', n - 1 FROM p WHERE reason IS NULL AND n > 1) GROUP BY reason""",
)(lambda spark, d: lexicon.prepare_pairs(pairs(spark, d), "a", "b").groupBy("reason").agg(F.sum("n").alias("n")))


@query("a26_components", f"""WITH RECURSIVE p AS (SELECT DISTINCT 'a:' || word AS a, 'b:' || left({SKELETON.format('word')}, 5) AS b FROM ({FREQ_SQL}) WHERE freq >= 5),
    e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r AS (SELECT u, u AS label FROM e UNION SELECT e.v, r.label FROM r JOIN e USING (u))
    SELECT substr(a, 3) AS a, min(label) AS component FROM p JOIN r ON r.u = p.a GROUP BY a""")
def a26(spark, d):
    p = freq(spark, d).where(F.col("freq") >= 5).select(F.col("word").alias("a"), F.left(latin_skeleton(F.col("word")), F.lit(5)).alias("b"))
    return lexicon.components(p, "a", "b").select("a", "component").distinct()


query("j17_ambiguous_keys", f"SELECT count(*) FILTER (n > 1) AS many, count(*) AS keys FROM (SELECT {SKELETON.format('word')} AS b, count(*) AS n FROM ({FREQ_SQL}) GROUP BY 1)")(
    lambda spark, d: freq(spark, d).groupBy(latin_skeleton(F.col("word")).alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("many"), F.count(F.lit(1)).alias("keys"))
)

# --- joins on words ------------------------------------------------------------------------------------------------------------------------
LEX_SQL = f"(SELECT word, freq FROM ({FREQ_SQL}) WHERE freq >= 10)"


def lex(spark, d):
    return freq(spark, d).where(F.col("freq") >= 10)


def _ascii(spark, d):
    return lex(spark, d).where(F.col("word").rlike("^[a-z]+$"))  # the other engine's distance counts bytes


query("j02_dictionary_left", f"SELECT f.word, coalesce('<' || l.word || '>', f.word) AS reading, CASE WHEN l.word IS NULL THEN 'model' ELSE 'dict' END AS source FROM ({FREQ_SQL}) f LEFT JOIN {LEX_SQL} l USING (word)")(
    lambda spark, d: models.transliterate(freq(spark, d), lex(spark, d).select("word", F.concat(F.lit("<"), "word", F.lit(">")).alias("translit")), None).select("word", F.col("translit").alias("reading"), "source")
)
query("j03_oov_anti", f"SELECT word FROM ({FREQ_SQL}) WHERE word NOT IN (SELECT word FROM {LEX_SQL})")(lambda spark, d: freq(spark, d).join(lex(spark, d), "word", "left_anti").select("word"))
query("j04_invocab_semi", f"SELECT doc_id, count(*) AS n FROM ({WORDS_SQL}) WHERE word IN (SELECT word FROM {LEX_SQL}) GROUP BY doc_id")(
    lambda spark, d: lexicon.occurrences(docs(spark, d), keep=("doc_id",)).join(lex(spark, d), "word", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
)
query("j05_prefix_semi", f"SELECT DISTINCT f.word AS typed FROM ({FREQ_SQL}) f JOIN {LEX_SQL} l ON length(l.word) >= 4 AND length(f.word) - length(l.word) BETWEEN 0 AND 4 AND starts_with(f.word, l.word)")(
    lambda spark, d: fixer.protected(freq(spark, d).select(F.col("word").alias("typed")), lex(spark, d).select(F.col("word").alias("stem")))
)


@query("j06_skeleton_candidates", f"""WITH f AS MATERIALIZED (SELECT word, freq, {SKELETON.format('word')} AS k FROM ({FREQ_SQL}))
  SELECT a.word AS typed, b.word, b.freq FROM f a JOIN f b USING (k) WHERE a.word <> b.word
    AND len(list_filter(range(1, length(k) + 1), lambda i: substr(a.word, i, 1) NOT IN (substr(b.word, i, 1), substr(k, i, 1)))) = 0""")
def j06(spark, d):
    f = freq(spark, d).withColumn("k", latin_skeleton(F.col("word")))
    right = f.where(F.col("word") != F.col("k"))  # only a word with special letters can be typed in another way
    return f.select(F.col("word").alias("typed"), "k").join(right, "k").where((F.col("typed") != F.col("word")) & letters.plainer(F.col("typed"), F.col("word"), F.col("k"))).select("typed", "word", "freq")


query("j14_noise_words", f"WITH f AS (SELECT word, freq, {SKELETON.format('word')} AS k FROM ({FREQ_SQL})) SELECT word, freq, best FROM f JOIN (SELECT k, max(freq) AS best FROM f GROUP BY k) USING (k) WHERE best >= 5 * freq")(
    lambda spark, d: lexicon.noise(freq(spark, d), latin_skeleton(F.col("word")))
)
DEG = [s.chain("word", [(a, b[min(k, len(b) - 1)]) for a, b in t.LATIN_SUBSTITUTIONS.items()]) for k in (0, 1)]
query("j15_collisions", f"WITH f AS ({FREQ_SQL}) SELECT DISTINCT x.word, x.freq, x.typed, f.freq AS typed_freq FROM (SELECT word, freq, unnest([{DEG[0]}, {DEG[1]}]) AS typed FROM f) x JOIN f ON f.word = x.typed WHERE x.typed <> x.word")(
    lambda spark, d: lexicon.collisions(freq(spark, d), [letters.degrade_latin(F.col("word"), k) for k in (0, 1)])
)
query("j16_zip_join", r"SELECT doc_id, count(*) AS n, count(*) FILTER (a = b) AS same FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS a, unnest(string_split(lower(text), ' ')) AS b FROM documents) GROUP BY doc_id")(
    lambda spark, d: docs(spark, d).select("doc_id", F.split("text", " ", -1).alias("a"), F.split(F.lower("text"), " ", -1).alias("b")).where(F.size("a") == F.size("b"))
    .select("doc_id", F.size("a").cast("long").alias("n"), F.size(F.filter(F.arrays_zip("a", "b"), lambda z: z["a"] == z["b"])).cast("long").alias("same"))
)
query("j12_prefix_join", f"""WITH q AS (SELECT word AS query FROM {LEX_SQL} WHERE length(word) >= 3), h AS (SELECT word AS head FROM {LEX_SQL} WHERE length(word) >= 3),
    p AS (SELECT query, head, CASE WHEN query = head THEN length(head) ELSE coalesce(list_min(list_filter(range(1, least(length(query), length(head)) + 1), lambda i: substr(query, i, 1) <> substr(head, i, 1))) - 1, least(length(query), length(head))) END AS lcp FROM q JOIN h ON left(query, 3) = left(head, 3))
    SELECT query, head, lcp::INTEGER AS lcp, 2 * lcp - 0.5::DOUBLE * abs(length(query) - length(head)) + CASE WHEN lcp = length(head) THEN 3 ELSE 0 END AS score FROM p WHERE lcp >= greatest(3, length(head) - 4)""")(
    lambda spark, d: reader.prefix_join(lex(spark, d).select(F.col("word").alias("query")), lex(spark, d).select(F.col("word").alias("head")))
)
query("j13_verb_join", f"SELECT f.word AS query, h.word AS head, left(h.word, length(h.word) - 2) AS stem, substr(f.word, length(h.word) - 1) AS rest FROM ({FREQ_SQL}) f JOIN {LEX_SQL} h ON right(h.word, 2) = 'er' AND length(h.word) > 3 AND starts_with(f.word, left(h.word, length(h.word) - 2)) AND regexp_matches(substr(f.word, length(h.word) - 1), '^(?:ed|ing|es|ly)$')")(
    lambda spark, d: reader.verb_join(freq(spark, d).select(F.col("word").alias("query")), lex(spark, d).select(F.col("word").alias("head")), "er", "ed|ing|es|ly")
)
query("j19_nearest_candidate", f"WITH f AS (SELECT word FROM {LEX_SQL} WHERE regexp_matches(word, '^[a-z]+$')), p AS (SELECT a.word AS query, b.word AS cand, levenshtein(a.word, b.word) AS dist FROM f a JOIN f b ON left(a.word, 3) = left(b.word, 3) AND a.word <> b.word) SELECT query, (arg_min(cand, {{'d': dist, 'c': cand}})) AS cand, min(dist)::INTEGER AS dist FROM p GROUP BY query")(
    lambda spark, d: _ascii(spark, d).select(F.col("word").alias("query"), F.left("word", F.lit(3)).alias("k")).join(_ascii(spark, d).select(F.col("word").alias("cand"), F.left("word", F.lit(3)).alias("k")), "k").where("query != cand")
    .groupBy("query").agg(F.min(F.struct(F.levenshtein("query", "cand").alias("dist"), "cand")).alias("m")).select("query", "m.cand", "m.dist")
)
query("a19_accuracy", f"SELECT lang, count(*) AS n, count(*) FILTER (d = 0) AS exact, sum(d)::BIGINT AS edits, sum(l)::BIGINT AS letters FROM (SELECT lang, len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr({SKELETON.format('word')}, i, 1))) AS d, length(word) AS l FROM ({FREQ_LANG_SQL})) GROUP BY lang")(
    lambda spark, d: by_lang(spark, d).select("lang", F.levenshtein("word", latin_skeleton(F.col("word"))).alias("e"), F.char_length("word").alias("l")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e") == 0).alias("exact"), F.sum("e").alias("edits"), F.sum("l").alias("letters"))
)
query(
    "a22_restore_outcomes",
    f"""WITH f AS ({FREQ_SQL}), x AS (SELECT word, freq, {DEG[0]} AS typed FROM f WHERE regexp_matches(word, '[{''.join(t.LATIN_SUBSTITUTIONS)}]')), c AS (SELECT typed, count(*) AS n, arg_max(word, {{'f': freq, 'w': word}}) AS best FROM x GROUP BY typed)
    SELECT CASE WHEN f.word IS NOT NULL THEN 'collision' WHEN c.n = 1 THEN 'unique' ELSE 'multiple' END AS outcome, count(*) AS n, sum(x.freq) FILTER (c.best = x.word)::BIGINT AS right_freq FROM x JOIN c USING (typed) LEFT JOIN f ON f.word = x.typed GROUP BY 1""",
)(lambda spark, d: _outcomes(spark, d))


def _outcomes(spark, d):
    f = freq(spark, d)
    x = f.where(F.col("word").rlike(f"[{''.join(t.LATIN_SUBSTITUTIONS)}]")).select("word", "freq", letters.degrade_latin(F.col("word"), 0).alias("typed"))
    c = x.groupBy("typed").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("freq", "word")).alias("best"))
    joined = x.join(c, "typed").join(f.select(F.col("word").alias("typed"), F.lit(True).alias("known")), "typed", "left")
    outcome = F.when(F.col("known"), "collision").when(F.col("k") == 1, "unique").otherwise("multiple")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("best.word") == F.col("word"), F.col("freq"))).alias("right_freq"))


query(
    "a23_uncertain",
    f"WITH f AS (SELECT word, freq, {SKELETON.format('word')} AS k FROM ({FREQ_SQL})), r AS (SELECT *, row_number() OVER w AS rn, lead(freq) OVER w AS second, lead(word) OVER w AS other FROM f WINDOW w AS (PARTITION BY k ORDER BY freq DESC, word)) SELECT word, freq, other, second FROM r WHERE rn = 1 AND second * 5 >= freq",
)(lambda spark, d: _uncertain(spark, d))


def _uncertain(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy(F.desc("freq"), "word")
    r = freq(spark, d).withColumn("k", latin_skeleton(F.col("word"))).withColumns({"rn": F.row_number().over(w), "second": F.lead("freq").over(w), "other": F.lead("word").over(w)})
    return r.where("rn = 1 AND second * 5 >= freq").select("word", "freq", "other", "second")


query("a33_source_counters", f"SELECT lang, CASE WHEN l.word IS NULL THEN 'model' ELSE 'dict' END AS source, sum(f.freq)::BIGINT AS n FROM ({FREQ_LANG_SQL}) f LEFT JOIN {LEX_SQL} l USING (word) GROUP BY 1, 2")(
    lambda spark, d: by_lang(spark, d).join(lex(spark, d).select("word", F.lit("dict").alias("s")), "word", "left").groupBy("lang", F.coalesce("s", F.lit("model")).alias("source")).agg(F.sum("freq").alias("n"))
)
query("m13_add_words", f"SELECT coalesce(o.word, n.word) AS word, coalesce(n.freq, o.freq) AS freq, CASE WHEN o.word IS NULL THEN '+' WHEN n.word IS NULL OR o.freq = n.freq THEN '=' ELSE '~' END AS status FROM (SELECT word, freq FROM {LEX_SQL}) o FULL JOIN (SELECT word, freq + length(word) % 2 AS freq FROM ({FREQ_SQL})) n ON o.word = n.word")(
    lambda spark, d: _add_words(lex(spark, d), freq(spark, d).select("word", (F.col("freq") + F.char_length("word") % 2).alias("new")))
)


def _add_words(old, new):
    status = F.when(F.col("freq").isNull(), "+").when(F.col("new").isNull() | (F.col("freq") == F.col("new")), "=").otherwise("~")
    return old.join(new, "word", "full").select("word", F.coalesce("new", "freq").alias("freq"), status.alias("status"))


for name, how, text in (("o04_union", "union", "UNION"), ("o05_difference", "exceptAll", "EXCEPT"), ("o06_intersection", "intersect", "INTERSECT")):
    query(name, f"SELECT word FROM ({FREQ_LANG_SQL}) WHERE lang = 'en' {text} SELECT word FROM ({FREQ_LANG_SQL}) WHERE lang = 'fr'")(
        lambda spark, d, how=how: (lambda a, b: a.union(b).distinct() if how == "union" else getattr(a, how)(b))(*[by_lang(spark, d).where(F.col("lang") == x).select("word") for x in ("en", "fr")])
    )
query("o07_ordered_distinct", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
  f AS (SELECT doc_id, word, min(i) AS i FROM e GROUP BY ALL), g AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id)
  SELECT doc_id, coalesce(words, '') AS words FROM w LEFT JOIN g USING (doc_id)""")(
    lambda spark, d: docs(spark, d).select("doc_id", F.array_join(F.array_distinct(tokens.words(F.lower("text"), r"\p{L}+")), " ").alias("words"))
)

# --- letter fixing and language, over fixtures ---------------------------------------------------------------------------------------------
LEXICON = [("сән", 900), ("бәәнт", 60), ("хальмгаһар", 30), ("келнәт", 20), ("үвләс", 15), ("эрүл", 80), ("менд", 300), ("һарвт", 20), ("асхн", 50), ("төвкнүн", 40), ("болтха", 90), ("хальмг", 2000), ("таңһч", 70), ("дуһарна", 25), ("бәәдл", 60), ("гергтәвт", 8), ("тер", 3000), ("гиҗ", 4000), ("келв", 500), ("та", 800), ("сәәнәр", 40), ("улс", 700), ("күн", 1500), ("нүдн", 90)]
TEXTS = [(1, "Сян бяянт!"), (2, "Та сяяняр хальмгаhар келнят"), (3, "Увлэс эрул менд hарвт"), (4, "Асхн тёвкнюн болтха!"), (5, "Хальмг улс"), (6, "Привет, как дела? Это обычный русский текст."), (7, "дугарна бяядл"), (8, "Та гергтявт?")]


def lexicon_of(spark):
    return local(spark, LEXICON, "word string, freq long")


@query("a17_detect_flags")
def a17(spark, d):
    return fixer.detect(local(spark, TEXTS, "id long, text string"), lexicon_of(spark), local(spark, [("москв",)], "stem string"))


@query("j18_a15_a16_fix")
def fix(spark, d):
    return fixer.fix(local(spark, TEXTS, "id long, text string"), lexicon_of(spark), local(spark, [("москв",)], "stem string")).select("id", "text", "flag")


VOTE_SQL = "CASE WHEN 2 * home >= n OR (home >= 1 AND 3 * home > ru + name) THEN 'kalmyk' WHEN ru >= 1 AND 10 * (ru + name) >= 6 * n AND ru >= name THEN 'russian' WHEN name >= 1 AND 10 * (ru + name) >= 6 * n THEN 'name' ELSE 'kalmyk' END"


@query("a18_language_vote", f"""WITH c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (word IN (SELECT word FROM ({FREQ_LANG_SQL}) WHERE lang = 'es' AND freq >= 5)) AS home, count(*) FILTER (word IN (SELECT word FROM ({FREQ_LANG_SQL}) WHERE lang = 'en' AND freq >= 5)) AS ru, count(*) FILTER (length(word) > 12) AS name FROM ({WORDS_SQL}) WHERE length(word) >= 2 GROUP BY doc_id)
    SELECT doc_id, n, home, ru, name, {VOTE_SQL} AS kind FROM c""")
def a18(spark, d):
    words = by_lang(spark, d).where(F.col("freq") >= 5)
    flag = lambda lang, name: words.where(F.col("lang") == lang).select("word", F.lit(True).alias(name))
    toks = lexicon.occurrences(docs(spark, d), keep=("doc_id",)).where(F.char_length("word") >= 2)
    marked = toks.join(flag("es", "h"), "word", "left").join(flag("en", "r"), "word", "left")
    sums = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("home"), F.count("r").alias("ru"), F.count_if(F.char_length("word") > 12).alias("name"))
    return sums.withColumn("kind", language.vote(F.col("n"), F.col("home"), F.col("ru"), F.col("name")))


@query("m06_broken_words")
def m06(spark, d):
    """Every document in Todo letters with narrow gaps inside words, against the frequencies of the transliterated words."""
    broken = scripts.replaced(F.col("text"), (("in", "i\u202fn"), ("the", "t\u202fhe"), ("an", "a\u202f\u202fn")))
    texts = docs(spark, d).select("doc_id", scripts.translit_to_todo(broken).alias("text"))
    whole = docs(spark, d).select("doc_id", scripts.todo_to_translit(scripts.translit_to_todo(F.col("text"))).alias("text"))
    return lm.join_broken_words(texts, "text", lexicon.frequencies(whole), "text", script="todo").select("doc_id", F.col("text").alias("joined"))


WORD_AT_SQL = r"SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents)"


@query("j09_phrases", f"""WITH RECURSIVE e AS ({WORD_AT_SQL}), n AS (SELECT *, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  s AS MATERIALIZED (SELECT doc_id, i, CASE WHEN w = 'and' AND w2 = 'the' AND w3 = 'of' THEN 3 WHEN w IN ('of', 'in') AND w2 = 'the' THEN 2 ELSE 1 END AS k, w, w2, w3 FROM n),
  r AS (SELECT doc_id, i, k, concat_ws(' ', w, CASE WHEN k > 1 THEN w2 END, CASE WHEN k > 2 THEN w3 END) AS phrase FROM s WHERE i = 1 UNION ALL
        SELECT s.doc_id, s.i, s.k, concat_ws(' ', s.w, CASE WHEN s.k > 1 THEN s.w2 END, CASE WHEN s.k > 2 THEN s.w3 END) FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + r.k)
  SELECT d.doc_id, coalesce(string_agg(phrase, '|' ORDER BY i), '') AS phrases FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def j09(spark, d):
    known = F.array(*map(F.lit, ("of the", "in the", "the", "and the of")))
    return docs(spark, d).select("doc_id", F.array_join(reader.phrases(tokens.words(F.lower("text"), r"\p{L}+"), known, 12), "|").alias("phrases"))


@query("m02_transliterate", "SELECT word, CASE word WHEN 'хальмг' THEN 'xalimaq' WHEN 'улс' THEN 'ulus' WHEN 'эк' THEN 'eke' WHEN 'эк-эцк' THEN 'eke ecege' ELSE word END AS translit, CASE WHEN word IN ('хальмг', 'улс', 'эк') THEN 'dict' WHEN word = 'эк-эцк' THEN 'split' ELSE 'model' END AS source FROM " + s.values([("хальмг",), ("улс",), ("эк-эцк",), ("нутг",), ("эк",)], "word"))
def m02(spark, d):
    dictionary = local(spark, [("хальмг", "xalimaq"), ("улс", "ulus"), ("эк", "eke"), ("эцк", "ecege")], "word string, translit string")
    return models.transliterate(local(spark, [("хальмг",), ("улс",), ("эк-эцк",), ("нутг",), ("эк",)], "word string"), dictionary, None)


PAIRS = [("of", "OF"), ("of the", "OF-THE"), ("in", "IN"), ("and", "AND"), ("and", "ALSO")]


@query("j08_pair_lookup", f"SELECT doc_id, count(*) AS n, count(*) FILTER (word = 'and') AS several FROM ({WORDS_SQL}) WHERE word IN ('of', 'in', 'and') GROUP BY doc_id")
def j08(spark, d):
    toks = lexicon.occurrences(docs(spark, d), keep=("doc_id",))
    found = convert.look_up(toks, local(spark, PAIRS, "source string, target string"))
    return toks.join(found, "word").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("targets") > 1).alias("several"))


GAP_WORD = r"[\p{L}\p{M}\x{180B}-\x{180F}\x{200C}\x{200D}]+"


@query("m05_convert", f"""WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace(text, '({GAP_WORD})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
  e AS (SELECT doc_id, i, p[2 * i] AS w, p[2 * i + 1] AS gap, p[2 * i + 2] AS w2, p[2 * i + 3] AS gap2 FROM (SELECT doc_id, p, unnest(range(1, (len(p) - 1) // 2 + 1)) AS i FROM p)),
  s AS MATERIALIZED (SELECT doc_id, i, CASE WHEN w = 'of' AND gap = ' ' AND w2 = 'the' THEN 2 ELSE 1 END AS k, w, gap, gap2 FROM e),
  t AS MATERIALIZED (SELECT doc_id, i, k, CASE WHEN k = 2 THEN 'OF-THE' || gap2 WHEN w = 'of' THEN 'OF' || gap WHEN w = 'in' THEN 'IN' || gap WHEN w = 'and' THEN 'ALSO' || gap ELSE w || gap END AS said, (w IN ('of', 'in', 'and'))::INTEGER AS hit FROM s),
  r AS (SELECT * FROM t WHERE i = 1 UNION ALL SELECT t.* FROM r JOIN t ON t.doc_id = r.doc_id AND t.i = r.i + r.k)
  SELECT p.doc_id AS id, any_value(p.p[1]) || coalesce(string_agg(said, '' ORDER BY i), '') AS text, any_value((len(p.p) - 1) // 2)::INTEGER AS n_words, coalesce(sum(hit), 0)::INTEGER AS n_found FROM p LEFT JOIN r USING (doc_id) GROUP BY p.doc_id""")
def m05(spark, d):
    return convert.convert(docs(spark, d), local(spark, PAIRS, "source string, target string"), id_col="doc_id")


@query("t28_fit_charset", r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, 'é', 'e'), '[^a-z ]', ' ', 'g'), ' {2,}', ' ', 'g') AS text FROM documents")
def t28(spark, d):
    return docs(spark, d).select("doc_id", convert.fit_charset(F.col("text"), "abcdefghijklmnopqrstuvwxyz ", {"é": "e"}).alias("text"))


@query("a31_wrap", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT doc_id, w, i, length(w) + length(w) - length(translate(w, 'mw', '')) AS n FROM ({WORD_AT_SQL})),
  r AS (SELECT doc_id, i, w, n AS size, 0 AS line FROM e WHERE i = 1 UNION ALL
        SELECT e.doc_id, e.i, e.w, CASE WHEN r.size + 1 + e.n <= 40 THEN r.size + 1 + e.n ELSE e.n END, CASE WHEN r.size + 1 + e.n <= 40 THEN r.line ELSE r.line + 1 END FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
  SELECT doc_id, line::INTEGER AS line, string_agg(w, ' ' ORDER BY i) AS text FROM r GROUP BY doc_id, line""")
def a31(spark, d):
    words = tokens.words(F.lower("text"), r"\p{L}+")
    return docs(spark, d).select("doc_id", F.posexplode(convert.wrap(words, 40, {"m": 2, "w": 2, "i": 1}, 1)).alias("line", "text"))

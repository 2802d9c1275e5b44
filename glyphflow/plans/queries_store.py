"""Queries of the event store, the reader, and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphflow.operators import page, reader, store
from glyphflow.plans.catalog import FEEDBACK_SQL, KD, REQUESTS_SQL, feedback, query, read, requests

# --- store -------------------------------------------------------------------------------------------------------------------------------
def _shown(df):
    return df.withColumn("user_id", F.col("user_id").cast("string"))


UPSERT_SQL = f"""(SELECT request_id, user_id, arg_max(rating, seq) AS rating, arg_max(correction, seq) FILTER (correction IS NOT NULL) AS correction, max(seq) AS seq FROM {FEEDBACK_SQL} WHERE user_id IS NOT NULL GROUP BY request_id, user_id
  UNION ALL SELECT request_id, user_id, rating, correction, seq FROM {FEEDBACK_SQL} WHERE user_id IS NULL)"""
query("s01_feedback_upsert", f"SELECT request_id, user_id::VARCHAR AS user_id, rating, correction, seq FROM {UPSERT_SQL}")(lambda spark, d: _shown(store.upsert_feedback(feedback(spark, d))))
query("j01_feedback_export", f"SELECT f.request_id, f.user_id::VARCHAR AS user_id, f.correction, r.target, r.user_id AS asked_by FROM {UPSERT_SQL} f JOIN {REQUESTS_SQL} r ON r.id = f.request_id WHERE f.correction IS NOT NULL")(
    lambda spark, d: _shown(store.export(store.upsert_feedback(feedback(spark, d)), requests(spark, d), True)).select("request_id", "user_id", "correction", "target", "asked_by")
)
query(
    "a01_a02_stats",
    f"""WITH r AS (SELECT count(*) AS requests, count(DISTINCT user_id) AS users, count(*) FILTER (NOT ok) AS failed, round(avg(elapsed_ms) FILTER (ok), 4) AS avg_ms FROM {REQUESTS_SQL}),
    f AS (SELECT count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, count(correction) AS corrections FROM {UPSERT_SQL})
    SELECT *, CASE WHEN up + down = 0 THEN 0 ELSE round(up::DOUBLE / (up + down), 6) END AS up_share, CASE WHEN up + down = 0 THEN 0 ELSE round(down::DOUBLE / (up + down), 6) END AS down_share FROM r, f""",
)(lambda spark, d: store.stats(requests(spark, d), store.upsert_feedback(feedback(spark, d))).withColumns({"avg_ms": F.round("avg_ms", 4), "up_share": F.round("up_share", 6), "down_share": F.round("down_share", 6)}))
query("a01_by_target", f"SELECT coalesce(target, 'all') AS target, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM {REQUESTS_SQL} GROUP BY ROLLUP (target)")(lambda spark, d: store.by_target(requests(spark, d)))

SETTING_SQL = f"(SELECT user_id, event_id AS seq, CASE WHEN {KD} % 19 = 0 THEN 'reset' ELSE 'set' END AS kind, CASE WHEN {KD} % 2 = 0 THEN 's' || {KD} % 5 END AS size, CASE WHEN {KD} % 3 = 0 THEN event_type WHEN {KD} % 7 = 0 THEN '' END AS punctuation FROM events)"


def setting_events(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.when(k % 19 == 0, "reset").otherwise("set").alias("kind"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 5).cast("string"))).alias("size"), F.when(k % 3 == 0, F.col("event_type")).when(k % 7 == 0, "").alias("punctuation"),
    )


LIVE_SQL = f"WITH e AS {SETTING_SQL}, l AS (SELECT e.* FROM e LEFT JOIN (SELECT user_id, max(seq) AS r FROM e WHERE kind = 'reset' GROUP BY user_id) x USING (user_id) WHERE kind = 'set' AND (r IS NULL OR seq > r))"
query("s02_s03_settings", f"{LIVE_SQL} SELECT user_id, arg_max(size, seq) FILTER (size IS NOT NULL) AS size, arg_max(punctuation, seq) FILTER (punctuation IS NOT NULL) AS punctuation FROM l GROUP BY user_id")(
    lambda spark, d: store.settings_by_join(setting_events(spark, d), ["size", "punctuation"])
)
query("s05_defaults", f"{LIVE_SQL} SELECT user_id, coalesce(nullif(arg_max(size, seq) FILTER (size IS NOT NULL), ''), 'm') AS size, coalesce(nullif(arg_max(punctuation, seq) FILTER (punctuation IS NOT NULL), ''), 'off') AS punctuation FROM l GROUP BY user_id")(
    lambda spark, d: store.with_defaults(store.settings_by_join(setting_events(spark, d), ["size", "punctuation"]))
)
query("s04_modes", f"SELECT chat_id, user_id, CASE WHEN mode IN ('translit', 'todo', 'hudum', 'image', 'fix', 'ocr') THEN mode ELSE 'translit' END AS mode FROM (SELECT user_id % 20 AS chat_id, user_id, arg_max(CASE WHEN {KD} % 2 = 0 THEN 'todo' ELSE event_type END, event_id) AS mode FROM events GROUP BY 1, 2)")(
    lambda spark, d: store.modes(read(spark, d, "events").select(F.pmod("user_id", F.lit(20)).alias("chat_id"), "user_id", F.when(F.get_json_object("props", "$.k").cast("long") % 2 == 0, "todo").otherwise(F.col("event_type")).alias("mode"), F.col("event_id").alias("seq")))
)
query("s06_replay", f"WITH f AS {FEEDBACK_SQL}, x AS (SELECT request_id, user_id FROM f WHERE seq % 11 = 0) SELECT request_id, user_id::VARCHAR AS user_id, rating, correction, seq FROM (SELECT *, row_number() OVER (PARTITION BY request_id, user_id ORDER BY seq) AS n FROM f) g WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM x WHERE x.request_id = g.request_id AND x.user_id IS NOT DISTINCT FROM g.user_id)")(
    lambda spark, d: _shown(store.replay(feedback(spark, d), feedback(spark, d).where("seq % 11 = 0").select("request_id", "user_id"), ["request_id", "user_id"]))
)
query("s06_replay_counts", "SELECT count(*) FILTER (event_id % 3 = 0 AND event_id % 13 <> 0) AS requests, count(*) FILTER (event_id % 3 = 1 AND event_id % 13 <> 0) AS feedback, count(*) FILTER (event_id % 3 = 2 AND event_id % 13 <> 0) AS skipped, count(*) FILTER (event_id % 13 = 0) AS broken FROM events")(
    lambda spark, d: store.replay_counts(
        read(spark, d, "events").select(F.concat(F.lit('{"event":"'), F.element_at(F.array(F.lit("request"), F.lit("feedback"), F.lit("other")), (F.pmod("event_id", F.lit(3)) + 1).cast("int")), F.when(F.pmod("event_id", F.lit(13)) == 0, "").otherwise('"}')).alias("line")), "event string"
    )
)
TURNS_SQL = "(SELECT user_id % 10 AS chat_id, user_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'down' WHEN 3 THEN 'cancel' ELSE 'text' END AS kind, event_id % 997 AS request_id, event_type AS text FROM events)"


def turns(spark, d):
    m = F.pmod("event_id", F.lit(4))
    return read(spark, d, "events").select(F.pmod("user_id", F.lit(10)).alias("chat_id"), "user_id", F.col("event_id").alias("seq"), F.when(m == 0, "down").when(m == 3, "cancel").otherwise("text").alias("kind"), F.pmod("event_id", F.lit(997)).alias("request_id"), F.col("event_type").alias("text"))


query("s07_corrections", f"SELECT chat_id, user_id, pr AS request_id, text AS correction, seq FROM (SELECT *, lag(kind) OVER w AS pk, lag(request_id) OVER w AS pr FROM {TURNS_SQL} WINDOW w AS (PARTITION BY chat_id, user_id ORDER BY seq)) WHERE kind = 'text' AND pk = 'down'")(lambda spark, d: store.corrections(turns(spark, d)))
query("s08_convert_further", f"SELECT a.event_id AS ask_id, a.event_id % 997 AS from_id, 'hudum' AS target, coalesce(CASE WHEN r.event_type = 'click' THEN 'todo' || r.event_id END, CASE WHEN r.event_type = 'view' THEN 'fixed' END, r.event_type) AS text FROM events a JOIN events r ON r.event_id = a.event_id % 997 WHERE a.event_id >= 997")(
    lambda spark, d: store.convert_further(
        read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "fix").otherwise("todo").alias("target"), F.col("event_type").alias("input_text"), F.when(F.col("event_type") == "click", F.concat(F.lit("todo"), F.col("event_id").cast("string"))).alias("todo"), F.lit("fixed").alias("fixed")),
        read(spark, d, "events").where("event_id >= 997").select(F.col("event_id").alias("ask_id"), F.pmod("event_id", F.lit(997)).alias("from_id"), F.lit("hudum").alias("target")),
    )
)
query("s09_letters_log", f"SELECT event_id, CASE WHEN {KD} % 5 = 0 THEN 'hard' END AS flag FROM events")(
    lambda spark, d: read(spark, d, "events").select("event_id", store.letters_log(F.when(F.get_json_object("props", "$.k").cast("long") % 5 == 0, "hard").otherwise(""), F.array().cast("array<string>")).alias("log")).select("event_id", F.col("log.flag").alias("flag"))
)

# --- reader ------------------------------------------------------------------------------------------------------------------------------------
query("j10_interval_join", "SELECT l_orderkey, l_linenumber, o_orderkey AS span FROM lineitem JOIN (SELECT o_orderkey, o_orderkey AS lo, o_orderkey + o_custkey % 6 AS hi FROM orders) o ON l_orderkey BETWEEN lo AND hi")(
    lambda spark, d: reader.interval_join(
        read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"),
        read(spark, d, "orders").select(F.col("o_orderkey").alias("span"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.col("o_custkey") % 6).alias("hi")), "l_orderkey", "lo", "hi", 16,
    ).select("l_orderkey", "l_linenumber", "span")
)
query("j11_nearest_box", """SELECT click, arg_min(line, {'d': d, 'l': line}) AS line, min(d) AS distance FROM (SELECT c.event_id AS click, b.event_id AS line, greatest(b.event_id % 400 - c.event_id % 500, c.event_id % 500 - (b.event_id % 400 + 40), 0) AS d
  FROM events c JOIN events b ON c.user_id = b.user_id AND c.event_id % 300 BETWEEN b.event_id % 280 - 4 AND b.event_id % 280 + 24 WHERE c.event_id % 2 = 0 AND b.event_id % 2 = 1) GROUP BY click""")(
    lambda spark, d: reader.nearest_line(
        read(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("click"), F.col("user_id").alias("page"), (F.col("event_id") % 300).alias("x"), (F.col("event_id") % 500).alias("y")),
        read(spark, d, "events").where("event_id % 2 = 1").select(F.col("event_id").alias("line"), F.col("user_id").alias("page"), (F.col("event_id") % 280).alias("x0"), (F.col("event_id") % 280 + 20).alias("x1"), (F.col("event_id") % 400).alias("y0"), (F.col("event_id") % 400 + 40).alias("y1")),
    )
)
query("a34_dictionary_ranking", "SELECT query, head, rank::INTEGER AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, head) AS rank FROM (SELECT user_id AS query, 'h' || event_id AS head, round(CASE WHEN event_id % 9 = 0 THEN 100 ELSE 0 END + value::INTEGER % 10 + CASE WHEN event_id % 4 = 0 THEN 6 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END + 2 * (event_type IN ('view', 'click'))::INT + 0.3::DOUBLE * ln(1 + (event_id % 50)::DOUBLE), 6) AS score FROM events)) WHERE rank <= 6")(
    lambda spark, d: reader.rank_entries(
        read(spark, d, "events").select(F.col("user_id").alias("query"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("head"), (F.col("event_id") % 9 == 0).alias("exact"), (F.rint("value").cast("int") % 10).cast("double").alias("prefix_score"), (F.col("event_id") % 4 == 0).alias("suffix"), (F.col("event_id") % 50).alias("freq"), (F.col("event_id") % 2 == 0).alias("pos_ok"), F.array("event_type").alias("head_stems")),
        read(spark, d, "events").select(F.col("user_id").alias("query")).distinct().withColumn("stems", F.array(F.lit("view"), F.lit("click"))),
    ).select("query", "head", "rank", "score")
)

# --- pages --------------------------------------------------------------------------------------------------------------------------------------
query("g01_otsu", """WITH h AS (SELECT page_id, v, count(*) AS n FROM (SELECT page_id, least(unicode(unnest(string_split(html, ''))), 255) AS v FROM pages) GROUP BY ALL),
  s AS (SELECT page_id, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY page_id) AS w, sum(n * v) OVER (PARTITION BY page_id) AS s FROM h WINDOW w AS (PARTITION BY page_id ORDER BY v)),
  b AS (SELECT page_id, v, round(CASE WHEN w - w0 > 0 THEN pow((s0 * w - s * w0)::DOUBLE / w, 2) / (w0 * (w - w0)) ELSE 0 END, 4) AS b FROM s)
  SELECT page_id, arg_max(v, {'b': b, 't': -v})::BIGINT AS threshold, max(b) AS between FROM b GROUP BY page_id""".replace("AS between FROM", 'AS "between" FROM'))(
    lambda spark, d: page.otsu(read(spark, d, "pages").select("page_id", F.explode(F.split("html", "")).alias("c")).select("page_id", F.least(F.ascii("c"), F.lit(255)).alias("v")), "page_id", "v")
)
query("g06_runs", "SELECT user_id, min(p)::BIGINT AS start, count(*) AS length FROM (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, value FROM events) WHERE value > 20) GROUP BY user_id, g")(
    lambda spark, d: page.runs(read(spark, d, "events").selectExpr("user_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p", "value > 20 AS ink"), ["user_id"], "p", "ink").select("user_id", F.col("start").cast("long").alias("start"), "length")
)


BOXES_SQL = "(SELECT l_orderkey AS page, l_partkey % 5 * 50 AS x, l_linenumber AS id, l_suppkey % 7 * 100 AS y0, l_suppkey % 7 * 100 + 20 + l_quantity::INTEGER * 12 AS y1 FROM lineitem)"


@query("g07_stacked_order", f"""WITH t AS (SELECT *, y1 - y0 >= 0.9::DOUBLE * (max(y1) OVER p - min(y0) OVER p) AS tall FROM {BOXES_SQL} WINDOW p AS (PARTITION BY page)),
  u AS (SELECT *, sum(CASE WHEN tall OR before THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x, y0, y1) AS run FROM (SELECT *, coalesce(lag(tall) OVER (PARTITION BY page ORDER BY x, y0, y1), false) AS before FROM t)),
  v AS (SELECT *, coalesce(y0 > max(y1) OVER (PARTITION BY page, run ORDER BY y0, x, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new FROM u),
  w AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY page, run ORDER BY y0, x, y1) AS block FROM v)
  SELECT page, x, y0, y1, row_number() OVER (PARTITION BY page ORDER BY run, block, x, y0, y1) AS place FROM w""")
def g07(spark, d):
    boxes = read(spark, d, "lineitem").selectExpr("l_orderkey AS page", "l_partkey % 5 * 50 AS x", "l_suppkey % 7 * 100 AS y0", "l_suppkey % 7 * 100 + 20 + CAST(l_quantity AS INT) * 12 AS y1")
    return page.stacked_order(boxes).select("page", "x", "y0", "y1", "place")


query("g09_unreadable", "SELECT l_orderkey, l_linenumber FROM lineitem, (SELECT median(l_quantity) AS h, median(l_partkey % 50) AS w FROM lineitem WHERE l_linenumber % 2 = 1) WHERE l_linenumber % 2 = 0 AND 2 * l_quantity >= h AND l_quantity <= 2 * h AND l_partkey % 50 <= 2 * w")(
    lambda spark, d: page.unreadable(
        *[read(spark, d, "lineitem").where(f"l_linenumber % 2 = {n}").select("l_orderkey", "l_linenumber", F.lit(0).alias("x0"), (F.col("l_partkey") % 50).alias("x1"), F.lit(0).alias("y0"), F.col("l_quantity").alias("y1")) for n in (1, 0)]
    ).select("l_orderkey", "l_linenumber")
)
query("a32_junk", "SELECT user_id, median(v) < 0.8 AS junk FROM (SELECT user_id, round(value / (value + 5), 3) AS v FROM events) GROUP BY user_id")(
    lambda spark, d: read(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.round(F.col("value") / (F.col("value") + 5), 3)).alias("p")).select("user_id", page.junk(F.col("p")).alias("junk"))
)
CTC_SQL = """WITH f AS (SELECT label AS page, vec_id, list_position(embedding, list_max(embedding)) - 1 AS k, 1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) AS p FROM embeddings),
  x AS (SELECT *, lag(k) OVER (PARTITION BY page ORDER BY vec_id) AS before FROM f)
  SELECT page, string_agg(k::VARCHAR, ' ' ORDER BY vec_id) AS labels, count(*) AS n_labels, round(avg(p), 4) AS confidence FROM x WHERE k <> 0 AND (before IS NULL OR before <> k) GROUP BY page"""
query("m07_ctc", CTC_SQL)(
    lambda spark, d: page.ctc_decode(read(spark, d, "embeddings").select(F.col("label").alias("page"), "vec_id", F.col("embedding").alias("scores")), "page", "vec_id", F.col("scores"))
    .select("page", "labels", "n_labels", F.round("confidence", 4).alias("confidence"))
)
query("g14_tight_gaps", "SELECT user_id, first, last, NOT bool_or(value < 5) AS tight FROM (SELECT user_id, event_id, value FROM events) JOIN (SELECT user_id, min(event_id) AS first, min(event_id) + 400 AS last FROM events GROUP BY user_id) USING (user_id) WHERE event_id BETWEEN first AND last GROUP BY ALL")(
    lambda spark, d: page.tight_gaps(
        read(spark, d, "events").select("user_id", "event_id", (F.col("value") < 5).alias("blank")), "user_id", "event_id", "blank", "first", "last",
        read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first")).withColumn("last", F.col("first") + 400),
    )
)
query("a29_packing", """WITH RECURSIVE e AS MATERIALIZED (SELECT doc_id, l, i FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
  r AS (SELECT doc_id, i, l, length(l) AS size, 0 AS part FROM e WHERE i = 1 UNION ALL
        SELECT e.doc_id, e.i, e.l, CASE WHEN r.size + 1 + length(e.l) <= 400 THEN r.size + 1 + length(e.l) ELSE length(e.l) END, CASE WHEN r.size + 1 + length(e.l) <= 400 THEN r.part ELSE r.part + 1 END FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
  SELECT doc_id, part::INTEGER AS part, string_agg(l, chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, part""")(
    lambda spark, d: read(spark, d, "documents").select("doc_id", F.posexplode(page.pack(F.split("text", "\n", -1), 400)).alias("part", "text"))
)
query("a30_windows", r"""WITH RECURSIVE e AS MATERIALIZED (SELECT doc_id, w, i, regexp_matches(w, '^[^\p{L}\p{N}]+$') AS sign FROM (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|[.,!?]') AS p FROM documents))),
  r AS (SELECT doc_id, i, w, 1 AS n, length(w) AS size, 0 AS part FROM e WHERE i = 1 UNION ALL
        SELECT e.doc_id, e.i, CASE WHEN e.sign THEN e.w WHEN r.n < 2 AND r.size + 1 + length(e.w) <= 60 THEN ' ' || e.w ELSE e.w END,
               CASE WHEN e.sign THEN r.n WHEN r.n < 2 AND r.size + 1 + length(e.w) <= 60 THEN r.n + 1 ELSE 1 END,
               CASE WHEN e.sign THEN r.size + length(e.w) WHEN r.n < 2 AND r.size + 1 + length(e.w) <= 60 THEN r.size + 1 + length(e.w) ELSE length(e.w) END,
               CASE WHEN e.sign OR (r.n < 2 AND r.size + 1 + length(e.w) <= 60) THEN r.part ELSE r.part + 1 END FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
  SELECT doc_id, part::INTEGER AS part, string_agg(w, '' ORDER BY i) AS text FROM r GROUP BY doc_id, part""")(
    lambda spark, d: read(spark, d, "documents").select("doc_id", F.posexplode(page.windows(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+|[.,!?]"), F.lit(0)))).alias("part", "text"))
)
query("a28_batches", "SELECT l_orderkey, l_linenumber, size, ((row_number() OVER (ORDER BY size, l_orderkey, l_linenumber) - 1) // 64)::BIGINT AS batch FROM (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS size FROM lineitem)")(
    lambda spark, d: page.batches(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("size")), "size", ["l_orderkey", "l_linenumber"], 64)
)
query("o03_limits", """SELECT 'pages' AS kind, source AS key, string_agg(doc_id::VARCHAR, ',' ORDER BY r) AS kept FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20 GROUP BY source
  UNION ALL SELECT 'plates', l_orderkey::VARCHAR, string_agg(l_linenumber::VARCHAR, ',' ORDER BY r) FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 6 GROUP BY l_orderkey""")(
    lambda spark, d: page.first_of(read(spark, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("item"), F.col("doc_id").alias("o")), "key", ["o"], "item", 20).withColumn("kind", F.lit("pages")).unionByName(
        page.first_of(read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").alias("item"), (-F.col("l_quantity")).alias("o")), "key", ["o", "item"], "item", 6).withColumn("kind", F.lit("plates"))
    )
)

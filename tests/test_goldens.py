"""Golden rows of the script transforms, the fixer, language kinds, boxes and the store."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow import tables as t
from glyphflow.functions import letters, scripts, tokens
from glyphflow.operators import broken, convert, fixer, language, lexicon, lm, models, page, reader, store
from glyphflow.plans.pipeline import inline_results, process
from glyphflow.plans.queries_corpus import LEXICON


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_tables_pair_up():
    for a, b in ((t.ASCII_LETTERS, t.TODO_LETTERS), (t.ASCII_MARKS, t.TODO_MARKS), (t.TODO_TO_ASCII_FROM, t.TODO_TO_ASCII_TO), (t.LOOKALIKE_FROM, t.LOOKALIKE_TO), (t.TWINS_FROM, t.TWINS_TO), (t.SKELETON_FROM, t.SKELETON_TO), (t.RUSSIAN_FROM, t.RUSSIAN_TO)):
        assert len(a) == len(b)


@pytest.mark.parametrize(("latin", "todo"), [("bolxu", "ᡋᡆᠯᡍᡇ"), ("či", "ᡔᡅ"), ("ǰil", "ᠴᡅᠯ"), ("aǰa", "ᠠᡓᠠ"), ("āǰa", "ᠠᡃᡓᠠ"), ("adǰi", "ᠠᡑᠴᡅ"), ("karou", "ᡗᠠᠷᡆᡇ"), ("BOLXU", "ᡋᡆᠯᡍᡇ")])
def test_to_todo(spark, latin, todo):
    assert one(spark, latin, scripts.translit_to_todo) == todo


def test_to_todo_contains(spark):
    f = lambda x: one(spark, x, scripts.translit_to_todo)
    assert "ᡀ" not in f("ādoulxu") and "ᡗ" not in f("angxāraq") and "ᡗ" not in f("kelen")
    assert "ᡔ" in f("arčīxu") and "ᡒ" in f("čōno") and "ᡔ" not in f("čōno")
    assert f("xalīlγaǰi").endswith("ᠴᡅ") and f("ǰī").startswith("ᠴ") and f("ǰolō").startswith("ᡚ") and f("ǰe").startswith("ᡓ")
    assert "︱" in f("xalimaq — ulus") and " " in f("γazar-yēn") and f("a\nb").count("\n") == 1


@pytest.mark.parametrize("word", ["abči", "bolxu", "xalimaq", "ulus", "kele", "ǰil", "γazar", "ȫrgȫ", "bi ger tü\nči"])
def test_round_trip(spark, word):
    back = one(spark, word, lambda c: scripts.todo_to_translit(scripts.translit_to_todo(c)))
    assert back == word
    assert one(spark, back, lambda c: scripts.todo_to_translit(scripts.translit_to_todo(c))) == back


def test_punctuation(spark):
    source = "xalimaq ulus, eke! ecege — ulus."
    off, frame, whole = (one(spark, source, lambda c, m=m: scripts.punctuation(scripts.translit_to_todo(c), m)) for m in ("off", "frame", "all"))
    assert not set(off) & set(t.MARKS) and "  " not in off
    assert frame[0] == "᠀" and frame[-1] == "᠅" and not set(frame[1:-1]) & set(t.MARKS)
    assert whole[0] == "᠀" and "᠂" in whole and whole[-1] == "᠅"
    assert one(spark, "ᠠ᠃\nᡅ᠃\n", lambda c: scripts.punctuation(c, "all")) == "᠀ᠠ᠃\nᡅ᠅\n"
    assert one(spark, "ᠠ︖", lambda c: scripts.punctuation(c, "all")).endswith("︖᠅")
    assert one(spark, "", lambda c: scripts.punctuation(c, "all")) == ""


@pytest.mark.parametrize(("read", "want"), [("xoišidu baixu züil dalai ügei", "xoyišidu bayixu züyil dalai ügei"), ("bürotaln bosu bülēn bolǰi büli zorigiyn", "borotala bosu bülēn bolǰi büli zorigiyn"), ("barixu büii?", "barixu büi?")])
def test_ocr_norms(spark, read, want):
    assert one(spark, read, lambda c: scripts.ocr_to_translit(scripts.normalize_ocr(scripts.translit_to_todo(c)))).replace("︖", "?") == want


def test_small_text_functions(spark):
    assert one(spark, "привет", scripts.russian_to_translit) == "privet" and one(spark, "Джамал", scripts.russian_to_translit) == "ǰamal"
    assert [one(spark, "x", lambda c, n=n: scripts.plural(F.lit(n), "столбец", "столбца", "столбцов")) for n in (1, 2, 5, 11, 22)] == ["столбец", "столбца", "столбцов", "столбцов", "столбца"]
    assert one(spark, "x", lambda c: scripts.milliseconds(F.lit(412.7))) == "413 мс" and one(spark, "x", lambda c: scripts.milliseconds(F.lit(1234.5))) == "1,23 с"
    assert one(spark, "a . b ! c", lambda c: scripts.capitalise(scripts.tidy_spaces(c))) == "A. B! C"
    assert one(spark, "Хальмгаhар", tokens.normalize_lookalikes) == "Хальмгаһар" and one(spark, "plain hat", tokens.normalize_lookalikes) == "plain hat"
    assert [r.s for r in spark.createDataFrame([("todo ᠠ",), ("хальмг",), ("ger",), ("12",)], "x string").select(scripts.detect_script(F.col("x")).alias("s")).collect()] == ["todo", "cyrillic", "translit", "unknown"]


def test_channel_is_the_cheapest_path():
    assert letters.channel("бәәдл", "бяядл")[0] == pytest.approx(0.6)
    assert letters.channel("йовҗ", "йовдж")[0] == 1.0 and letters.channel("һалун", "алун")[0] == 2.5
    assert letters.channel("күн", "кон") is None and letters.channel("", "") == (0.0, [])
    assert letters.spelling_distance("abc", "abc") == 0 and letters.spelling_distance("ger", "gar") == pytest.approx(1 / 12)


FIXES = [("Сян бяянт!", "Сән бәәнт!"), ("Та сяяняр хальмгаhар келнят", "Та сәәнәр хальмгаһар келнәт"), ("Увлэс эрул менд hарвт", "Үвләс эрүл менд һарвт"), ("Асхн тёвкнюн болтха!", "Асхн төвкнүн болтха!"), ("Хальмг Тангч", "Хальмг Таңһч")]
KEPT = ["Хальмг улс", "Привет, как дела? Это обычный русский текст."]


def test_fix(spark):
    lexicon, stems = spark.createDataFrame(LEXICON, "word string, freq long"), spark.createDataFrame([("москв",)], "stem string")
    rows = [(i, a) for i, (a, _) in enumerate(FIXES)] + [(100 + i, a) for i, a in enumerate(KEPT)]
    got = {r.id: r for r in fixer.fix(spark.createDataFrame(rows, "id long, text string"), lexicon, stems).collect()}
    for i, (_, want) in enumerate(FIXES[:4]):
        assert got[i].text == want
    for i, a in enumerate(KEPT):
        assert (got[100 + i].text, got[100 + i].flag) == (a, "")
    forced = fixer.fix(spark.createDataFrame([(1, "дугарна бяядл"), (2, "Та гергтявт?")], "id long, text string"), lexicon, stems, force=True)
    assert {r.id: r.text for r in forced.collect()} == {1: "дуһарна бәәдл", 2: "Та гергтәвт?"}


def test_suffix_split(spark):
    lexicon = spark.createDataFrame([("дуһар", 50), ("келн", 90)], "word string, freq long")
    suffixes = spark.createDataFrame([("b", "һас", 40), ("b", "ан", 60)], "row string, tail string, n long")
    got = fixer.fix(spark.createDataFrame([(1, "дугаргас")], "id long, text string"), lexicon, spark.createDataFrame([], "stem string"), suffixes, force=True).first()
    assert got.text == "дуһарһас"


def test_language_kinds(spark):
    words = lambda xs: spark.createDataFrame([(x,) for x in xs.split()], "word string")
    texts = [(1, "Как дела"), (2, "Моя семья в Элисте, сейчас я учусь в Москве"), (3, "Александр"), (4, "Хальмг келн"), (5, "Бадмин Үкрчә")]
    got = language.check(
        spark.createDataFrame(texts, "id long, text string"), words("хальмг келн мини нерн"), words("как дела моя семья сейчас учусь москве"), words("александр элисте бадмин"), spark.createDataFrame([("^к", 0.1)], "g string, weight double"),
    )
    assert {r.id: r.kind for r in got.collect()} == {1: "russian", 2: "russian", 3: "name", 4: "kalmyk", 5: "kalmyk"}


FREQ = {"ged": 5, "gedeq": 2881, "ü": 4, "dü": 9057, "örgöǰi": 173, "kü": 2, "örgöǰikü": 2, "erdeni": 183, "d": 0}


@pytest.mark.parametrize(("text", "want"), [("örgöǰi kü ged eq", "örgöǰikü gedeq"), ("erdeni\u202fdü ger", "erdeni\u202fdü ger"), ("baqta :qsan", "baqta:qsan"), ("", "")])
def test_broken_words(text, want):
    assert lm.join_broken(text, FREQ) == want


def test_letter_model():
    rows = []
    from collections import Counter

    counts = Counter()
    for w in ("abab", "aba"):
        s = "^^^^" + w + "$"
        for i in range(4, len(s)):
            for k in range(5):
                counts[k + 1, s[i - k : i], s[i]] += 1
    rows = [(k, c, x, n) for (k, c, x), n in counts.items()]
    model = lm.LetterModel(rows, 3)
    assert model.logp("aba") > model.logp("bbb") and math.isfinite(model.gain("ab", "a"))


def test_letter_model_as_joins(spark):
    from glyphflow.operators import lexicon

    types = spark.createDataFrame([("abab",), ("aba",)], "word string")
    counts = lexicon.lm_counts(types)
    model = lm.LetterModel([(r.k, r.ctx, r.c, r.cnt) for r in counts.collect()], 3)
    for r in lm.log_probability(spark.createDataFrame([("aba",), ("bbb",), ("x",)], "word string"), counts, 3).collect():
        assert r.logp == pytest.approx(model.logp(r.word))


def test_models_with_made_up_weights():
    import numpy as np

    rng = np.random.default_rng(0)
    w = lambda *s: rng.normal(0, 0.5, s).astype(np.float32)
    layer = lambda n, i, h: {f"{n}.w_ih": w(3 * h, i), f"{n}.w_hh": w(3 * h, h), f"{n}.b_ih": w(3 * h), f"{n}.b_hh": w(3 * h)}
    weights = {"src_emb": w(8, 4), "tgt_emb": w(8, 4), "attn.enc": w(5, 6), "attn.dec": w(5, 3), "attn.v": w(5), "bridge.w": w(3, 6), "bridge.b": w(3), "out.w": w(8, 9), "out.b": w(8)} | layer("fwd", 4, 3) | layer("bwd", 4, 3) | layer("dec", 10, 3)
    model = models.Seq2Seq(weights, {"a": 4, "b": 5}, {"x": 4, "y": 5, "z": 6, "w": 7}, 10)
    assert model.decode("abba") == model.decode("abba") and len(model.decode("ab?")) <= 10
    seg = models.Segmenter({"emb": w(4, 4), "out.w": w(6), "out.b": w(1)[0]} | layer("l0.fwd", 4, 3) | layer("l0.bwd", 4, 3) | layer("l1.fwd", 6, 3) | layer("l1.bwd", 6, 3), {"a": 1, " ": 2, "b": 3})
    assert sum(seg.groups("a b ab"), []) == ["a", "b", "ab"] and seg.groups("") == []


def test_clear_script():
    rules = {"uni": {"a": {"A": 3}, "b": {"B": 1, "C": 2}, "ab": {"X": 1}}, "prev": {"ab": {"D": 5}}}
    assert models.clear_script("ab", rules, {"a": 0.5, "b": 0.5, "ab": 0.01}) == "AD"
    assert models.clear_script("ab", rules, {"ab": 0.9}) == "X" and models.clear_script("zz", rules, {}) == "zz"


def test_boxes(spark):
    probs = spark.createDataFrame([(1, [0.5, 0.7, 0.6, 0.9, 0.4, 0.3, 0.6, 0.7]), (2, [0.99, 0.7, 0.6, 0.99, 0.95, 1.0, 0.98, 0.97])], "i int, p array<double>")
    assert [r.j for r in probs.orderBy("i").select(page.junk(F.col("p")).alias("j")).collect()] == [True, False]
    box = "x0 int, y0 int, x1 int, y1 int"
    kept = spark.createDataFrame([(0, 0, 30, 400), (40, 0, 70, 380), (80, 0, 110, 420)], box)
    found = spark.createDataFrame([(120, 0, 148, 390), (-40, 0, 300, 1200), (160, 0, 170, 20)], box)
    assert [tuple(r) for r in page.unreadable(kept, found).collect()] == [(120, 0, 148, 390)]
    blocks = spark.createDataFrame([(1, 0, 0, 1000), (1, 50, 0, 400), (1, 50, 700, 1000), (1, 100, 0, 450), (1, 100, 680, 1000)], "page int, x int, y0 int, y1 int")
    assert [(r.x, r.y0) for r in page.stacked_order(blocks).orderBy("place").collect()] == [(0, 0), (50, 0), (100, 0), (50, 700), (100, 680)]


def test_packing(spark):
    rng = random.Random(1)
    parts = ["x" * rng.randint(1, 30) for _ in range(40)]
    out = spark.createDataFrame([(parts,)], "p array<string>").select(page.pack(F.col("p"), 50).alias("o")).first().o
    want = []
    for p in parts:
        if want and len(want[-1]) + 1 + len(p) <= 50:
            want[-1] += "\n" + p
        else:
            want.append(p)
    assert out == want
    words = spark.createDataFrame([(["a", "b", ",", "c", "."],)], "w array<string>").select(page.windows(F.col("w")).alias("o")).first().o
    assert words == ["a b,", "c."]


def test_phrases(spark):
    df = spark.createDataFrame([(["in", "the", "old", "house"],), ([],)], "w array<string>")
    got = [r.p for r in df.select(reader.phrases(F.col("w"), F.array(F.lit("in the"), F.lit("old house"), F.lit("in the old house")), 12).alias("p")).collect()]
    assert got == [["in the", "old house"], []]


def test_store_scenarios(spark):
    schema = "request_id long, user_id long, rating string, correction string, seq long"
    log = spark.createDataFrame([(2, 7, "down", None, 1), (2, 7, "down", "better", 2), (1, 7, "up", None, 3), (1, 7, "down", None, 4), (5, None, "up", None, 5), (5, None, "up", None, 6)], schema)
    live = {(r.request_id, r.user_id): r for r in store.upsert_feedback(log).where("user_id IS NOT NULL").collect()}
    assert live[2, 7].correction == "better" and live[1, 7].rating == "down"
    assert store.upsert_feedback(log).where("user_id IS NULL").count() == 2
    nothing = log.limit(0)
    once = store.replay(log, nothing, ["request_id", "user_id"])
    assert {(r.request_id, r.correction) for r in once.where("user_id = 7").collect()} == {(2, None), (1, None)}  # the first event wins
    assert store.replay(log, once, ["request_id", "user_id"]).count() == 0 and once.count() == 3
    assert store.replay(log, once, ["request_id", "user_id"], parity=True).count() == 2
    counts = store.replay_counts(spark.createDataFrame([('{"event":"request"}',), ("",), ('{"event":"x"}',), ('{"ev',)], "line string"), "event string").first()
    assert tuple(counts) == (1, 0, 1, 1)


def test_settings_agree(spark):
    e = spark.createDataFrame([(1, 1, "set", "s", None), (1, 2, "reset", None, None), (1, 3, "set", None, "all"), (2, 1, "set", "l", "")], "user_id long, seq long, kind string, size string, punctuation string")
    a, b = store.settings(e, ["size", "punctuation"]), store.settings_by_join(e, ["size", "punctuation"])
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r.user_id: (r["size"], r.punctuation) for r in store.with_defaults(b).collect()} == {1: ("m", "all"), 2: ("l", "off")}


def test_pipeline(spark):
    df = spark.createDataFrame([(1, "bolxu"), (2, ""), (3, "ᡋᡆᠯᡍᡇ"), (4, "хальмг, улс"), (5, "123"), (6, "Привет, как дела у вас")], "id long, text string")
    words = spark.createDataFrame([("хальмг", "xalimaq"), ("улс", "ulus")], "word string, translit string")
    got = {r.id: r for r in process(df, "todo", translit=words).collect()}
    assert got[1].todo == "ᡋᡆᠯᡍᡇ" and got[2].error == "empty" and got[3].translit == "bolxu" and got[4].translit == "xalimaq, ulus" and got[5].error == "no_letters"
    assert got[6].translit.startswith("privet")
    inline = [(r.kind, r.text) for r in inline_results(df.where("id IN (1, 3, 5)"), "id").orderBy("id").collect()]
    assert inline == [("todo", "ᡋᡆᠯᡍᡇ"), ("translit", "bolxu")]


def test_inline_limit_is_the_text_s(spark):
    """Digraphs shorten a text, dashes lengthen it; only its own length decides."""
    df = spark.createDataFrame([(1, "ng" * 501), (2, "a-" + "—" * 998), (3, "a" * 1000), (4, None)], "id long, text string")
    got = {r.id: len(r.text) for r in inline_results(df, "id").collect()}
    assert sorted(got) == [2, 3] and got[2] > 1000


def test_capitals_one_letter_for_one(spark):
    """As the other engine has them: no letter becomes two, no last sigma."""
    f = lambda x: one(spark, x, lambda c: scripts.capitalise(scripts.tidy_spaces(scripts.small(c))))
    assert f("ßa. ŉb! ᾳ ? ﬁn") == "ẞa. ŉb! ᾼ? ﬁn"
    assert f("ΟΔΟΣ. İA") == "Οδοσ. Ia"


def test_convert(spark):
    pairs = spark.createDataFrame([("a", "1"), ("a b", "12"), ("b", "2"), ("c", "x"), ("c", "yy"), ("d\u180b", "4"), ("d", "5")], "source string, target string")
    texts = [(1, "a b a, b!"), (2, "zz"), (3, ""), (4, "c d\u180b d"), (5, "a  b"), (6, "a\u200d")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: (r.text, r.n_found) for r in convert.convert(df, pairs).collect()}
    assert got == {1: ("12 1, 2!", 3), 2: ("zz", 0), 3: ("", 0), 4: ("x 4 5", 3), 5: ("1  2", 2), 6: ("1", 1)}
    said = spark.createDataFrame([("c", "yyy")], "word string, prediction string")
    assert {r.id: r.text for r in convert.convert(df, pairs, said).collect()}[4] == "yy 4 5"


def test_fit_and_wrap(spark):
    df = spark.createDataFrame([("aé#b##c\u200d",)], "x string")
    assert df.select(convert.fit_charset(F.col("x"), "abc", {"é": "e"}).alias("y")).first().y == "a b c\u200d"
    words = spark.createDataFrame([(["aa", "bb", "cccccc", "d"],)], "w array<string>")
    assert words.select(convert.wrap(F.col("w"), 5, {"b": 1}, 1).alias("o")).first().o == ["aa bb", "cccccc", "d"]
    assert words.select(convert.wrap(F.col("w"), 5, {"b": 2}, 1).alias("o")).first().o == ["aa", "bb", "cccccc", "d"]


def test_clear_script_text(spark):
    df = spark.createDataFrame([("Ab, b#",), (None,)], "x string")
    got = models.clear_script_text(df, "x", "y", {"uni": {"a": {"A": 1}, "b": {"B": 1}}}, {}, {",": ";", " ": " "})
    assert [r.y for r in got.collect()] == ["AB; B", None]


def test_broken_words_of_a_table(spark):
    """Frequencies that come by a join give what the whole table gives, rare words and chains of three included."""
    freq = {"x": 99, "y": 98, "ged": 5, "gedeq": 7, "kü": 1, "örgöǰikü": 2, "ab": 2, "abc": 3, "baq:": 1}
    texts = ["ged eq, x örgöǰi kü.", "a b c", "(ged eq) baq :ta y", None, "", "a b c x", "ged eq ged eq", "x \u202f y"]
    words = spark.createDataFrame(list(freq.items()), "word string, freq long")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "id long, text string")
    got = {r.id: r.joined for r in lm.join_broken_words(df, "text", words).collect()}
    assert got == {i: None if t is None else lm.join_broken(t, freq) for i, t in enumerate(texts + texts)}
    assert lm.join_broken(texts[0], freq) == "gedeq, x örgöǰikü." and got[7] == "x \u202f y"


def test_broken_todo_words(spark):
    """Todo text: forms are looked up by their transliteration, the long mark joins, the letter model closes tight narrow gaps, and gaps that stay keep their characters."""
    todo = lambda t: spark.createDataFrame([(t,)], "t string").select(scripts.translit_to_todo(F.col("t"))).first()[0]
    freq = {"ged": 5, "gedeq": 2881, "erdeni": 183, "dü": 9057, "bayiqsan": 40, "bayital": 50, "sayin": 60}
    words = spark.createDataFrame(list(freq.items()), "word string, freq long")
    ged, eq, erdeni, du = (todo(x) for x in ("ged", "eq", "erdeni", "dü"))
    rows = [(0, f"{ged}\u202f{eq} \u202f{erdeni}\u202f{du}"), (1, f"{todo('ba')}\u202f\u1843{todo('d')}"), (2, f"{todo('bayi')}\u202f{todo('tan')}")]
    df = spark.createDataFrame([(i, t, [True] * len(t)) for i, t in rows], "id long, text string, tight array<boolean>")
    got = {r.id: r.joined for r in lm.join_broken_words(df, "text", words, script="todo").collect()}
    assert got == {0: f"{todo('gedeq')} \u202f{erdeni}\u202f{du}", 1: todo("ba") + "\u1843" + todo("d"), 2: rows[2][1]}
    counts = lexicon.lm_counts(words).collect()
    model = lm.LetterModel([(r.k, r.ctx, r.c, r.cnt) for r in counts], 30)
    model.gain = lambda a, b, ab=None: 12.0  # between the two bounds
    tight = {r.id: r.joined for r in lm.join_broken_words(df, "text", words, model=model, tight_col="tight", script="todo").collect()}
    loose = {r.id: r.joined for r in lm.join_broken_words(df.withColumn("tight", F.transform("tight", lambda x: ~x)), "text", words, model=model, tight_col="tight", script="todo").collect()}
    assert tight[2] == rows[2][1].replace("\u202f", "") and loose[2] == rows[2][1]


def test_spellings(spark):
    rows = spark.createDataFrame([("dalai", "dalay"), ("xoišidu", "xoyišidu"), ("a b", "ab"), ("ger", "bayar")], "a string, b string")
    assert [r.x for r in rows.select(letters.related(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False]
    pairs = spark.createDataFrame([("ete", "été", "ete"), ("éte", "été", "ete"), ("ètè", "été", "ete")], "t string, w string, k string")
    assert [r.x for r in pairs.select(letters.plainer(F.col("t"), F.col("w"), F.col("k")).alias("x")).collect()] == [True, True, False]


def test_letter_probabilities_match_the_worker(spark):
    words = spark.createDataFrame([(w,) for w in ("abra", "cadabra", "bar", "a")], "word string").withColumn("freq", F.lit(1).cast("long"))
    counts = lexicon.lm_counts(words)
    model = lm.LetterModel([(r.k, r.ctx, r.c, r.cnt) for r in counts.collect()], 40)
    for r in lm.log_probability(words, counts, 40).collect():
        assert abs(r.logp - model.logp(r.word)) < 1e-9


def test_broken_words_travel_without_their_text(spark):
    """Equal texts, null and empty ones keep their rows; no exchange carries a text with each of its forms."""
    df = spark.createDataFrame([(1, "bol xu a"), (2, "bol xu a"), (3, None), (4, "")], "id long, t string")
    freq = spark.createDataFrame([("bolxu", 9)], "word string, freq long")
    got = lm.join_broken_words(df, "t", freq)
    assert {r.id: r.joined for r in got.collect()} == {1: "bolxu a", 2: "bolxu a", 3: None, 4: ""} and got.columns == ["id", "t", "joined"]
    assert "_text" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_inline_of_every_text(spark, tmp_path):
    """The query reads every text as transliteration, as its SQL does: those without letters, in other scripts and with empty results keep their row."""
    import duckdb

    from glyphflow.plans import catalog

    catalog.load()
    folder = str(tmp_path)
    rows = [(1, ""), (2, "123 — 4"), (3, "=+"), (4, "Привет"), (5, "ᡋᡆᠯᡍᡇ"), (6, "bolxu"), (7, "a" * 1001), (8, None), (9, "1" * 1000)]
    spark.createDataFrame([(i, "en", "s", t) for i, t in rows], "doc_id long, lang string, source string, text string").write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["m11_inline"](spark, folder).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert got == sorted(c.execute(catalog.SQL["m11_inline"]).fetchall()) and [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 9]


@pytest.mark.parametrize("script, letters", [("todo", "ᠠᡄᡍᡃᠴᡅᡔᡘᡊᡉ"), ("translit", "ab:c")])
def test_broken_words_by_numbers(spark, script, letters):
    """Words known by numbers join as ``join_broken`` joins them: chains, marks, line breaks, empty parts, frequencies of every order."""
    rng = random.Random(script)
    said = lambda w: scripts.todo_to_translit(F.col(w)) if script == "todo" else F.col(w)
    parts = ["".join(rng.choices(letters, k=rng.choice([1, 1, 2, 3]))) for _ in range(6)]
    texts = ["".join(x for _ in range(rng.randint(0, 9)) for x in (rng.choice([*parts, ""]), rng.choice([" ", " ", " ", "  ", ", ", "\n ", "\n", ""]))) for _ in range(300)]
    forms = sorted({f for x in texts for f in lm.formable(x, 12, script)})
    spelled = {r.form: r.word for r in spark.createDataFrame([(f,) for f in forms], "form string").withColumn("word", said("form")).collect()}
    words = {w: rng.randint(1, 4) for w in sorted(set(spelled.values())) if rng.random() < 0.3}
    by_number = dict(zip(broken.word_numbers(list(words), script)[0].tolist(), words.values()))
    gaps = broken.Gaps(texts, script)
    got = gaps.texts(gaps.closed(lambda h: np.array([by_number.get(x, 0) for x in h.tolist()], dtype=np.int64), 24))
    freq = {f: words[w] for f, w in spelled.items() if w in words}
    assert got == [lm.join_broken(x, freq, script=script) for x in texts] and got != texts


def test_broken_words_ask_only_for_known_words(spark):
    """A gap whose joined word isn't known asks for nothing, however many words its text could make."""
    gaps = broken.Gaps(["a " * 1000 + "b c"], "translit")
    known = set(broken.word_numbers(["bc", "a" * 30], "translit")[0].tolist())
    i, k = gaps.found(lambda h: np.isin(h, np.array(sorted(known), dtype=np.uint64)), 60)
    assert list(zip(i, k)) == [(1000, 1000)]
    rows = spark.range(20).select("id", F.lit("a " * 50).alias("row"), F.lit("b c").alias("t.x"))
    freq = spark.createDataFrame([("bc", 2)], "word string, freq long")
    out = lm.join_broken_words(rows, "t.x", freq, "t.x")
    assert out.columns == ["id", "row", "t.x"] and {r["t.x"] for r in out.collect()} == {"bc"}

"""Operators against brute force, on small fixtures and on whole small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphflow.llm import bpe, ctw, decontaminate, langid, pii, quality, queries, secrets, sharding, simhash, token_counts
from glyphflow.operators.graph import components

SF = "/root/testdata/sf0.001"
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, n_tokens string, _row string, lang string"
LETTERS = ["a", "B", "é", "ß", "İ", "Σ", " ", "\n", "\t", "\x1c", "\x85", " ", " ", "1", "²", "'s", "'", "<|endoftext|>", "中", "ก", "😀", "﷐", "́", "-", "!!", "\x00", "Hello", "the", "running", "xyzzyq", "  "]
ODD = [None, "", " ", "\n\n", "a", "a b", "a b c", "x" * 3000, "the cat sat on the mat " * 300, "the cat sat on the mat " * 300, "é" * 50, "ΑΣ ΟΔΟΣ", "1 2 3 4 5 6 7 8 9 10 11 12"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [(None if i % 50 == 49 else i // 2 if i % 10 == 0 else i, t, "x", "y", "en") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1: token counts
def test_token_counts_are_the_librarys(odd, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_JSON)
    got = token_counts.count(odd, WORD_JSON).collect()
    assert len(got) == odd.count()
    for r in got:
        want = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((r.text or "").encode()), want > 2048), r.text
    assert token_counts.count(nothing, WORD_JSON).count() == 0


def test_proven_tokens_encode_alone():
    from tokenizers import Tokenizer

    with open(WORD_JSON, encoding="utf-8") as f:
        definition = f.read()
    lib, whole = Tokenizer.from_str(definition), sorted(token_counts.proven(definition))
    assert len(whole) > 30_000
    assert all(len(e.ids) == 1 for e in lib.encode_batch(whole, add_special_tokens=False))


# --- 2: sharding
def brute_ring(keys, shards):
    """Keys one by one in ring order, each to the first shard with room."""
    routes, n = sharding.clockwise(shards), len(keys)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    out = []
    for cell in keys:
        s = next(s for s in routes[cell] if room[s])
        room[s] -= 1
        out.append(s)
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_ring_is_balanced_and_gapless(odd, shards):
    got = sharding.assign(odd, shards=shards).collect()
    assert len(got) == odd.count()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    by_crc = Counter((r.key, r["size"], r.text_crc32) for r in got)
    assert by_crc == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())


def test_ring_follows_the_walk(spark, odd):
    cells = sorted(r.c for r in odd.select(F.shiftrightunsigned(F.xxhash64("doc_id"), 48).alias("c")).collect())
    assert Counter(brute_ring(cells, 8)) == Counter(r.shard for r in sharding.assign(odd).collect())
    plan = sharding.fill(Counter(cells), 8)
    assert sum(1 for r in sharding.assign(odd).collect() if r.shard == r.home_shard) >= len(cells) // 2
    assert sum(x[-1][0] for x in plan if x) == len(cells)


def test_ring_moves_few_keys(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r.key: r.home_shard for r in sharding.assign(df, shards=8).collect()}
    b = {r.key: r.home_shard for r in sharding.assign(df, shards=9).collect()}
    assert all(b[k] in (a[k], 8) for k in a)  # on the ring alone, keys only move into the new shard


def test_ring_hot_key(spark, nothing):
    df = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assign(df).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [750] * 8
    assert len({(r.shard, r.slot) for r in got}) == 6000
    assert sharding.assign(nothing).count() == 0


# --- 3: PII
def brute_pii(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_base_is_exact():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "@", ".", "-", "+", " ", "1", "25", "300", "4111 1111 1111 1111", "192.168.1.1", "+1 (212) 555-0100", "x@y.de", "..", "(", ")", "9", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        found = pii.base_spans(text)
        assert [(k, *s) for k in pii.BASE for s in found[k]] == brute_pii(text), text


def test_pii_spans(spark, odd, nothing):
    rows = [(1, "call +1 (212) 555-0100 or 4111 1111 1111 1111"), (2, "phone (212) 555-0199 now"), (3, None), (4, "order 123-45-6789 x"), (5, "my ssn 123-45-6789"), (1, "call +1 (212) 555-0100 or 4111 1111 1111 1111")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append([(x.kind, x.start, x.end, x.base) for x in r.spans])
    assert by[1] == [[("card", 26, 45, True), ("phone", 5, 22, True)]] * 2
    assert by[3] == [[]]
    assert len(pii.find(odd).collect()) == odd.count() and pii.find(nothing).count() == 0


def test_pii_reliabilities():
    right, chance = pii.reliabilities({"phone:++++00": 50, "phone:0--0--": 40, "phone:+++000": 20, "phone:-+-0-0": 10})
    assert right["phone"]["pattern"] > 0.5 and right["phone"]["check"] > 0.5
    assert chance["phone:++++00"] > 0.9 and chance["phone:0--0--"] < 0.1
    assert pii.accepted({}) == []


def test_pii_finds_a_bad_labeler_of_one_kind():
    """A labeler that is right for one kind and wrong for another gets two reliabilities, the second below one half."""
    rng, patterns = random.Random(9), Counter()
    for kind, good in (("phone", 0.9), ("card", 0.1)):
        for _ in range(4000):
            true = rng.random() < 0.5
            say = lambda p: "+" if (rng.random() < p) == true else "-"
            patterns[f"{kind}:{say(0.9)}{say(0.9)}{say(good)}{say(0.8)}00"] += 1
    right, _ = pii.reliabilities(patterns)
    assert right["phone"]["gazetteer"] > 0.8 and right["card"]["gazetteer"] < 0.2 and abs(right["card"]["pattern"] - 0.9) < 0.05


def test_pii_shape_decides_where_votes_are_silent():
    """Spans whose votes say nothing follow the shape that voted spans had: what the classifier adds to expectation-maximisation."""
    patterns = {"phone:+++++0:3dss": 200, "phone:------:1nww": 200, "phone:000000:3dss": 40, "phone:000000:1nww": 40}
    assert pii.accepted(patterns) == ["phone:+++++0:3dss", "phone:000000:3dss"]
    assert pii.shape("a 212-555-0100\n", 2, 14) == "3dse" and pii.shape("x@y.de", 0, 6) == "3oee"


def test_pii_and_secrets_take_long_texts_in_linear_time():
    ranks = secrets.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    scanner, times = secrets.Scanner(ranks, public_tokenizers.PATTERN), {}
    for n in (1, 8):
        mails = "write a.b@c.de or 10.0.0.1, (212) 555-0199 or 212-555-0199; " * (20_000 * n)
        keys = "password=abcdefABCDEF123 deadbeefdeadbeef00 Zx9Qv7Lk2Wp4Rt8Yb3Nm6Jd1Hs5 " * (4_000 * n)
        start = time.time()
        found, taken = pii.base_spans(mails), None
        taken = pii.Cover(s for k in pii.BASE for s in found[k])
        assert sum(not taken.within(a, b) for _, a, b in pii.further(mails)) == 40_000 * n
        middle = time.time()
        assert len(scanner.spans(keys)) == 12_000 * n
        times[n] = (middle - start, time.time() - middle)
    assert all(b < 24 * max(a, 0.05) for a, b in zip(times[1], times[8])), times  # 8 times the text; quadratic would be 64


# --- 4: SimHash
def brute_fp(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    each = defaultdict(list)
    for i in range(len(rows)):
        each[find(i)].append(i)
    return {i: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in each.values() for i in g}


def test_fingerprints(odd):
    got = simhash.fingerprints(odd.select("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((r.doc_id, brute_fp(r.text)) for r in odd.collect())


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash_groups(spark, bucket):
    """With pairs inside keys, and with every shared key treated as crowded."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(70):
        fps.append(rng.choice(fps) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) % (1 << 64))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in {f % (1 << 64) for f in fps}], "fp long")
    linked = simhash.links(nodes, bucket)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(linked).collect()}
    order = sorted({f % (1 << 64) for f in fps}, key=lambda x: x - (1 << 64) if x >> 63 else x)
    want = brute_groups([(i, f) for i, f in enumerate(order)])
    assert {f: order.index(found.get(f, f)) for f in order} == {f: want[i] for i, f in enumerate(order)}


def test_simhash_crowded_key(spark):
    """Fingerprints that all share one two-segment key: a few rows each, no pair of neighbours lost."""
    rng = random.Random(6)
    fps = {0xABCD | rng.getrandbits(48) << 16 for _ in range(60_000)}
    fps = {f & ~0xFF0000 | 0x770000 for f in fps}
    for f in rng.sample(sorted(fps), 300):
        fps.add(f ^ (1 << rng.randrange(24, 32)) ^ (1 << rng.randrange(32, 48)) ^ (1 << rng.randrange(48, 64)))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    two = simhash.sized(simhash.keyed(nodes), simhash.BUCKET)
    three = simhash.sized(simhash.longer(two.where("crowded")), simhash.BUCKET)
    assert two.where("crowded").count() >= len(fps) and three.where("crowded").count() == 0
    assert two.count() + simhash.longer(two.where("crowded")).count() < 20 * len(fps)
    at, want = defaultdict(list), set()
    for f in fps:  # brute force within 3 bits of the 48 that vary, by equal thirds or sixths: any two share one of four 12-bit blocks
        for b in range(4):
            at[b, f >> 16 + 12 * b & 0xFFF].append(f)
    for group in at.values():
        a = np.array(group, dtype=np.uint64)
        for i, f in enumerate(group):
            near = np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ np.uint64(f)) <= 3)
            want |= {tuple(sorted((f, group[i + 1 + j]))) for j in near.tolist()}
    got = {tuple(sorted((r.u % (1 << 64), r.v % (1 << 64)))) for r in simhash.links(nodes).collect()}
    assert got == want and len(want) >= 300


def test_simhash_query(spark, documents, nothing):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, SF).collect()}
    rows = [(r.doc_id, brute_fp(r.text)) for r in documents.collect()]
    want = brute_groups(rows)
    for i, (doc, fp) in enumerate(rows):
        assert (got[doc].fingerprint, got[doc].component_id) == (f"{fp:016x}", want[i])
    assert simhash.groups(nothing).count() == 0 and simhash.keep(nothing).count() == 0


def test_simhash_keep(odd):
    kept = simhash.keep(odd)
    assert kept.columns == odd.columns
    n = len(set(brute_groups([(k, brute_fp(r.text)) for k, r in enumerate(odd.collect())]).values()))
    assert kept.count() == n


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# --- 5: quality
def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(win)
    hit = {i + k for i, w in enumerate(win) if twice[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(odd, nothing):
    book = quality.ledger(odd.drop("_row"))
    for r in book.collect():
        m = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, r.text
        assert bool(r.fail_bits & 3) == (m[0] < 50 or 100 * m[4] > 50 * m[0])
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and quality.ledger(nothing).count() == 0
    for r in quality.ablations(book, "v2").collect():
        b = quality.bit(r.rule)
        rows = book.collect()
        assert (r.n_failed, r.n_only) == (sum(bool(x.fail_bits & b) for x in rows), sum(x.fail_bits == b for x in rows))


# --- 6: language
def test_language(spark, nothing):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.9
    assert langid.predict(nothing).count() == 0


def test_language_without_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat and the dog", "the dog and a cat", "² ½", "", None, "123", "中文"])] + [(20, "der hund und die katze", "de"), (21, "der hund", None)]
    got = {r.doc_id if hasattr(r, "doc_id") else r.id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4 and got[0].lang_pred == "en" and got[6].lang_pred in ("en", "de")


def brute_kneser_ney(rows):
    """(language, word) -> log probability by dictionaries of strings, from training rows (text, language)."""
    grams = defaultdict(lambda: [Counter() for _ in range(4)])
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for j in range(len(w) + 1):
                for k in range(1, 5):
                    seen = f" {w} "[j + 2 - k : j + 2] if j + 2 >= k else ""
                    if seen:
                        grams[lang][k - 1][seen] += 1
    alphabet = sum(len(set(g)) for g in [{c for x in grams.values() for c in x[0]}]) + 1

    def p(lang, gram):
        if not gram:
            return 1 / (alphabet + 1)
        k = len(gram)
        adjusted = {}
        for g, n in grams[lang][k - 1].items():
            before = sum(x[1:] == g for x in grams[lang][k]) if k < 4 else 0
            adjusted[g] = before or n
        once, twice = sum(n == 1 for n in adjusted.values()), sum(n == 2 for n in adjusted.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        same = [n for g, n in adjusted.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(lang, gram[1:])
        return max(adjusted.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(lang, gram[1:]) if gram in adjusted else d * len(same) / sum(same) * p(lang, gram[1:])

    def log(lang, w):
        return sum(math.log(p(lang, f" {w} "[max(0, j + 2 - 4) : j + 2])) for j in range(len(w) + 1))

    return log


def test_language_against_brute_force(spark):
    """Entropy of every word and the language of every text, and that a bound on entries only backs off."""
    rows = [("the cat and the dog", "en"), ("a dog that ran", "en"), ("der hund und die katze", "de"), ("ein hund im haus", "de"), ("кот и пёс", "ru"), ("le chat et le chien", "fr")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows * 4)], "doc_id long, text string, lang string")
    train = [(t, lang) for i, (t, lang) in enumerate(rows * 4) if zlib.crc32(str(i).encode()) % 4 != 2]
    log = brute_kneser_ney(train)
    model = langid.train(df, "doc_id", "text", "lang", 4, 2)
    words = ["the", "hund", "кот", "zebra", "katzen", "a"]
    want = np.array([[log(lang, w) for lang in ("de", "en", "fr", "ru")] for w in words])
    assert model.langs == ["de", "en", "fr", "ru"] and np.allclose(model.logs(words), want, atol=1e-4)
    queries_ = [(100 + i, t, None) for i, t in enumerate(["the house", "das hundehaus", "кошка", "la chatte", "x"])]
    got = {r.id: r for r in langid.predict(df.unionByName(spark.createDataFrame(queries_, df.schema))).collect()}
    for i, t, _ in queries_:
        each = {lang: -sum(log(lang, w) for w in t.split()) / sum(len(w) + 1 for w in t.split()) for lang in model.langs}
        best = min(sorted(each), key=each.get)
        assert got[i].lang_pred == best and abs(got[i].entropy - each[best]) < 1e-4, t
    small = langid.train(df, "doc_id", "text", "lang", 4, 2, entries=60)
    assert sum(len(t.keys) for t in small.grams[1:]) <= 60 and np.isfinite(small.logs(words)).all()


def test_marks_belong_to_words():
    assert langid.words_of("हिन्दी में") == ["हिन्दी", "में"] and langid.words_of("Ab3cd_e") == ["ab", "cd", "e"]


def test_kneser_ney_sums_to_one(spark):
    counts = [("x", k, key, n) for k, keys, ns in langid.gram_counts({"abc": 3, "abd": 2, "bca": 1}) for key, n in zip(keys.view(np.int64).tolist(), ns.tolist())]
    orders = [o.collect() for o in langid.kneser_ney(spark.createDataFrame(counts, "lang string, k int, gram long, n long"), 4)]
    low = {r.gram: r.p for r in orders[0]}
    for c in {r.ctx for r in orders[1]}:  # seen mass and what goes to the order below
        seen = [r for r in orders[1] if r.ctx == c]
        assert abs(sum(r.p - r.weight * low[r.gram & 0xFFFF] for r in seen) + seen[0].weight - 1) < 1e-9


def test_words_are_scored_a_few_at_once():
    """A text of very many words: the model's arrays stay small, and every word has its own score."""

    class Fake:
        langs, asked = ["a", "b"], []

        def logs(self, words):
            self.asked.append(len(words))
            return np.array([[hash(w) % 1000, 1.0] for w in words])

    reader, words = langid.Reader(Fake()), [f"w{i}" for i in range(2 * langid.AT_ONCE + 7)]
    reader.learn(words[:5])
    reader.learn(words[5:])
    assert max(Fake.asked) <= langid.AT_ONCE and sum(Fake.asked) == len(words)
    assert all(reader.table[reader.at[w], 0] == hash(w) % 1000 for w in words)


# --- 7: decontamination
def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add(str(item))
    return len(w), sorted(hit), sorted(ids)


@pytest.mark.parametrize("block", [1 << 25, 100])
def test_decontamination(spark, odd, nothing, block):
    items = [(1, "The cat sat"), (12, "on the mat the cat sat on the mat the cat sat"), (3, None), (None, "the"), (5, "..."), (7, "1 2 3 4 5 6 7 8 9 10 11 12"), (7, "hello"), (8, "A B C")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, t) for i, t in items if i is not None and t is not None]
    got = decontaminate.scan(odd.select("doc_id", "text"), bench, block_bytes=block).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words, r.hit_words, r.hit_items) == brute_hits(r.text, want), r.text
    if block > 100:
        assert decontaminate.scan(nothing, bench).count() == 0
        assert decontaminate.scan(odd, bench.limit(0)).where(F.size("hit_words") > 0).count() == 0
        kept = decontaminate.clean(odd, bench)
        assert kept.columns == odd.columns and kept.count() == sum(not r.hit_words for r in got)


def test_remove_spans():
    assert decontaminate.remove_spans("One two, three. Four", [1, 2]) == "One . Four"


# --- 8: LM scoring

def test_base_scores(spark, nothing):
    rows = [(i, t) for i, t in enumerate(["a b a", "b c", "", None, "A a a zz", "q " * 50, "b"] * 4)] + [(None, "a q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [((t or "").lower().split() + ["\0end"], out(i)) for i, t in rows]
    c = Counter(w for ws, held in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    got = sorted(((r.id is None, r.id or 0, r) for r in ctw.score(df).collect()), key=lambda x: x[:2])
    want = sorted(((i is None, i or 0, ws, held) for (i, _), (ws, held) in zip(rows, toks)), key=lambda x: x[:2])
    for (_, _, r), (_, _, ws, held) in zip(got, want):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-9
        assert r.score < 0
    assert ctw.score(nothing).count() == 0


def test_frequent_and_rare_words_agree(documents):
    df = documents.select("doc_id", "text")
    a = {r.id: r for r in ctw.score(df).collect()}
    for r in ctw.score(df, room=3000).collect():
        assert r.n_known == a[r.id].n_known and abs(r.base_score - a[r.id].base_score) < 1e-6 and abs(r.score - a[r.id].score) < 1e-6


def brute_tree(tokens):
    """Recursion over raw bytes: log10 probability of a token under context trees of these training tokens."""
    grams = Counter((bytes(reversed(w[:j]))[:7].ljust(7, b" "), b) for w in tokens for j, b in enumerate(w + b" "))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    def bits(context, prefix):
        out = [0, 0]
        for (c, byte), k in grams.items():
            s = f"{byte:08b}"
            if c.startswith(context) and s.startswith(prefix):
                out[int(s[len(prefix)])] += k
        return out

    known = {}

    def block(context, prefix):
        if (context, prefix) not in known:
            own = kt(*bits(context, prefix))
            if len(context) < 7:
                below = sum(block(c, prefix) for c in {c[: len(context) + 1] for c, _ in grams if c.startswith(context)})
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            known[context, prefix] = own
        return known[context, prefix]

    def one(context, prefix, depth=0, last=0.5):
        a, b = bits(context[:depth], prefix)
        if a + b == 0:
            return last
        here = (b + 0.5) / (a + b + 1)
        if depth == 7:
            return here
        stop = math.exp(math.log(0.5) + kt(a, b) - block(context[:depth], prefix))
        return stop * here + (1 - stop) * one(context, prefix, depth + 1, here)

    def log(w):
        total = 0.0
        for j, byte in enumerate(w + b" "):
            c, s = bytes(reversed(w[:j]))[:7].ljust(7, b" "), f"{byte:08b}"
            for k in range(8):
                q = one(c, s[:k])
                total += math.log10(q if s[k] == "1" else 1 - q)
        return total

    return log


def test_tree_matches_recursion_over_bytes(spark):
    words = ["abracadabra", "abra", "cadabra", "a", "\x00", "中文", "é", "zz9", "abracadabracadabra"]
    train = ["abra abra a", "cadabra abracadabra \x00", "中文 é abra", "abracadabracadabra"]
    rows = [(w, n) for w, n in Counter(w for t in train for w in t.split()).items()] + [("zz9", 0), (None, len(train))]
    df = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(rows)], "wid long, word string, n long")
    log = brute_tree([(w or "").encode() for w, n in rows for _ in range(n)])
    got = {r.wid: r.score for r in ctw.word_scores(df).collect()}
    assert set(words) <= {w for w, _ in rows}
    for i, (w, _) in enumerate(rows):
        assert abs(got[i] - log((w or "").encode())) < 1e-9, w


def test_scores_of_texts(spark):
    """A text's score is the sum over its tokens; the chances of all tokens of one byte and the end add up to what one is left with."""
    rows = [(i, t) for i, t in enumerate(["Ab ab c", "ab", None, "c " * 3000, "x" * 200_000, "\x00 ab"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [w.encode() for w in (t or "").lower().split(" ") if w] + [b""]
    small = [(i, t) for i, t in rows if len(t or "") < 100]
    got = {r.id: r for r in ctw.score(df.where("length(coalesce(text, '')) < 100")).collect()}
    log = brute_tree([w for i, t in small for w in tokens(t) if not out(i)])
    for i, t in small:
        assert abs(got[i].score - sum(map(log, tokens(t)))) < 1e-9
        assert abs(got[i].bits_per_byte + got[i].score * math.log2(10) / sum(len(w) + 1 for w in tokens(t))) < 1e-9
    long = {r.id: r for r in ctw.score(df).collect()}
    assert len(long) == len(rows) and all(r.score < 0 for r in long.values())


@pytest.mark.parametrize("room", [1 << 20, 600, 0])
def test_contexts_reach_over_tokens(spark, room):
    """Whole texts by the same recursion: a text is one token with its terminators inside; frequent grams, places that travel and both give the same."""
    texts = ["Ab ab c", "ab  cab\tab", None, "", "c ab c ab c", "\x00 ab 中文", "zz 9"]
    rows = list(enumerate(texts * 3)) + [(None, "ab c")]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    whole = lambda t: b"".join(w + b" " for w in (t or "").encode().lower().split())
    log = brute_tree([whole(t) for i, t in rows if not out(i)])
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), room=room, across=True).collect()
    want = sorted((-1 if i is None else i, log(whole(t)), len(whole(t)) + 1) for i, t in rows)
    assert len(got) == len(want)
    for r, (i, score, n) in zip(sorted(got, key=lambda r: -1 if r.id is None else r.id), want):
        assert (-1 if r.id is None else r.id) == i and abs(r.score - score) < 1e-9 and abs(r.bits_per_byte + score * math.log2(10) / n) < 1e-9


def test_places_of_cut_texts():
    texts = [b"", b"ab " * 50, b"x" * 100 + b" ", b"c "]
    want = [(g, i) for i, t in enumerate(texts) for g in ctw.grams_of([t])[0].tolist()]
    for limit in (1, 5, 8, 64, 1000):
        assert [x for grams, of in ctw.places(texts, limit) for x in zip(grams.tolist(), of.tolist())] == want


def test_sums_of_texts_travel_packed(spark):
    """What meets the leaves hands on rows by parts of the texts, not by texts; grams come back from their buckets, and a bucket is one stretch of mixed grams."""
    rows = spark.createDataFrame([(i, f"w{i} ab{i % 7} c", False) for i in range(3000)], "rid long, text string, held_out boolean")
    plan = ctw.text_scores(rows, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "met(bucket" in plan and "[rid" not in next(line for line in plan.splitlines() if "met(bucket" in line).split("),")[-1]
    grams = ctw.grams_of([b"abracadabra", "中文 é".encode() * 9])[0]
    keys = np.sort(ctw.mixed(grams))
    assert sorted(ctw.plain(keys).tolist()) == sorted(grams.tolist())
    dealt = list(ctw._by_bucket(keys, np.arange(len(keys))))
    assert len({b for b, _, _ in dealt}) == len(dealt) and sum(k for _, k, _ in dealt) == len(keys)
    back = [ctw._unpacked(pa.scalar(d), k, np.uint64, np.int64) for _, k, d in dealt]
    assert np.array_equal(np.concatenate([g for g, _ in back]), ctw.plain(keys)) and np.array_equal(np.concatenate([n for _, n in back]), np.arange(len(keys)))


def test_op8_keeps_its_texts_small(spark, monkeypatch):
    kept, write = {}, ctw.materialise
    monkeypatch.setattr(ctw, "materialise", lambda df, label, *how: kept.setdefault(label, write(df, label, *how)))
    assert ctw.score(spark.createDataFrame([(1, "ab " * 99), (2, None)], "doc_id long, text string"), across=True).count() == 2
    assert all(f.endswith(".zstd.parquet") for f in kept["ctw-texts"].inputFiles())


def test_op8_reads_contexts_over_tokens(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got, whole, parts = ({r[0]: r.score for r in rows.collect()} for rows in (queries.op8_lm_scoring(spark, folder), ctw.score(docs, across=True), ctw.score(docs)))
    assert got.keys() == whole.keys() and all(abs(got[i] - whole[i]) < 1e-6 < abs(got[i] - parts[i]) for i in got)


def test_kt_of_large_counts():
    a, b = np.array([0, 3, 5000, 4095, 10**6]), np.array([0, 0, 7, 4095, 3])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) if x + y else 0 for x, y in zip(a.tolist(), b.tolist())]
    assert np.allclose(ctw.kt(a, b), want, rtol=1e-9)


# --- 9: secrets
def brute_secrets(text):
    rules = {
        "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    out = [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text, re.A) if ok(m)]
    return sorted(out, key=lambda x: (x[1], list(rules).index(x[0])))


def test_secrets_base_is_exact():
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "ſecret", ":", "=", " ", '"', "'", "AKIA", "ABCDEF1234567890", "0123456789abcdef", "deadbeef", "g", "\n", "secret", "x.y-z/="]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(text) == brute_secrets(text), text


def test_secrets_by_token_efficiency(spark, odd, nothing):
    scanner = secrets.Scanner(secrets.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    kinds = lambda t: [k for k, _, _ in scanner.spans(t)]
    assert kinds("key Zx9Qv7Lk2Wp4Rt8Yb3Nm6Jd1Hs5 end") == ["random"]
    assert kinds("see 550e8400-e29b-41d4-a716-446655440000 and some_long_variable_name_12 or 2024-01-02T10_11_12_2345") == []
    assert kinds("a plain sentence with internationalization2 in it") == [] and kinds("") == [] and kinds(None) == []
    assert secrets.redacted("a KEY b", [("random", 2, 5), ("hex", 3, 5)], "#") == "a # b"
    find = lambda df, **k: secrets.find(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **k)
    assert find(odd).count() == odd.count() and find(nothing).count() == 0
    assert find(odd, redact="#").columns == [*odd.columns, "secret_spans"]


def test_secrets_beside_other_parts():
    scanner = secrets.Scanner(secrets.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    uuid, digest = "550e8400-e29b-41d4-a716-446655440000", "0123456789ABCDEF" * 4
    for before in ("", "export/production/configuration/database/connection/", "productionconfiguration", f"{uuid}/", f"{digest}/", "0123456789abcdef0123/"):
        for signs in (letters, letters[:26], letters + "0123456789"):
            n = 0
            for _ in range(100):
                text = f"see {before}{''.join(rng.choice(signs) for _ in range(24))} here"
                end = len(text) - 5
                found = [(a, b) for k, a, b in scanner.spans(text) if k == "random"]
                n += any(a <= end - 24 and b == end for a, b in found)
                assert all(a >= 4 and b <= end for a, b in found) and (uuid not in before or not found or found[0][0] >= 3 + len(before)), text
            assert n >= 90, (before, signs, n)
    for text in (f"path/to/{uuid}", f"objects/{digest}", "-" * 300, "=_" * 40, "export/production/configuration/2024-01-02T10_11_12_2345/getUserAccountManagerFactory"):
        assert scanner.spans(text) == [], text


# --- 10: BPE
@pytest.mark.parametrize("room", [1 << 26, 2000, 0])
def test_bpe_is_the_librarys(odd, nothing, room):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    got = bpe.encode(odd.select(F.col("doc_id"), F.col("text").alias("t"), F.col("text"), "n_tokens", "_row", F.lit(1).alias("known"), F.lit(2).alias("codes")), MULTI, public_tokenizers.PATTERN, room=room)
    assert got.columns == ["doc_id", "t", "_row", "known", "codes", "ids_text", "n_tokens", "decoded"]
    got = got.collect()
    assert len(got) == odd.count()
    for r in got:
        ids = lib.encode_ordinary(r.t or "")
        assert (r.ids_text, r.n_tokens, bytes(r.decoded)) == (",".join(map(str, ids)), len(ids), (r.t or "").encode()), r.t
        assert (r._row, r.known, r.codes) == ("y", 1, 2)
    if room == 2000:
        assert bpe.encode(nothing.select("doc_id", "text"), MULTI, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("room", [1 << 26, 0])
def test_bpe_decodes_the_ids_alone(spark, room):
    """A pattern that leaves signs out loses them in the decoded bytes, long pre-tokens included."""
    text = "ab cd 12 " + "é" * 400
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), MULTI, r"\p{L}+", room=room).first()
    assert bytes(row.decoded).decode() == "abcd" + "é" * 400
    ranks = bpe.read_ranks(MULTI)
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[int(i)] for i in row.ids_text.split(",")) == bytes(row.decoded) and row.n_tokens == row.ids_text.count(",") + 1


def test_bpe_reads_numbers_of_a_text_at_once(spark):
    """Ids become numbers in one compiled cast of the whole list, not one by one; no ids and unknown ones give no bytes."""
    codec = bpe.Codec({b"a": 0, b"b": 1, b"ab": 2, "é".encode(): 3})
    got = spark.createDataFrame([("2,0,3",), ("",), ("1,99,1",)], "ids string").select("ids", codec.unfold(F.col("ids")).alias("b"))
    assert {r.ids: bytes(r.b).decode() for r in got.collect()} == {"2,0,3": "abaé", "": "", "1,99,1": "bb"}
    assert "as array<int>" in got._jdf.queryExecution().optimizedPlan().toString()


OWN = "_row _text _w _l _at known codes others cands key spans secret_spans n_words fail_bits n_bytes n_tokens hit_words hit_items fp id root cell rid lang word ids_text decoded held_out score".split()
MADE = {
    "token_counts": ("n_bytes", "n_tokens", "over_limit"), "pii": ("spans",), "quality": (*quality.MEASURES, "fail_bits"), "decontaminate": decontaminate.RESULTS,
    "secrets": ("secret_spans",), "bpe": ("ids_text", "n_tokens", "decoded"),
}


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns with every name that operators use inside or give, nulls in all of them, empty, repeated and very long texts."""
    long = ("the cat sat on the mat, call +1 (212) 555-0100 or x@y.de; " * 20_000, "x" * 300_000, "é " * 100_000)
    texts_ = [None, "", "the cat sat", "the cat sat", *long]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in OWN)
    rows = [(None if i == 3 else i // 2, t, *[None if i % 2 else f"{c}{i}" for c in OWN]) for i, t in enumerate(texts_)]
    return spark.createDataFrame(rows, schema).repartition(2).cache()


def test_own_columns_and_long_texts(spark, clashing):
    """Operators that give rows back: own columns stay, but for those named like a result; a whole long text is read."""
    bench = spark.createDataFrame([(1, "sat on the mat call 1 212 555 0100 or x")], "item_id long, text string")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = {
        "token_counts": token_counts.count(clashing, WORD_JSON), "pii": pii.find(clashing), "quality": quality.ledger(clashing), "decontaminate": decontaminate.scan(clashing, bench),
        "secrets": secrets.find(clashing, vocabulary, public_tokenizers.PATTERN), "bpe": bpe.encode(clashing, MULTI, public_tokenizers.PATTERN),
    }
    want = Counter(tuple(None if v is None else str(v) for v in (r.doc_id, *[r[c] for c in OWN])) for r in clashing.collect())
    for name, df in made.items():
        rows = df.collect()
        kept = [c for c in OWN if c not in MADE[name]]
        at = [0, *[1 + OWN.index(c) for c in kept]]
        got = Counter(tuple(None if v is None else str(v) for v in (r.doc_id, *[r[c] for c in kept])) for r in rows)
        assert got == Counter(tuple(k[i] for i in at) for k in want.elements()), name
        assert set(MADE[name]) <= set(df.columns), name
    assert max(len(r.spans) for r in made["pii"].collect()) == 40_000
    assert max(len(r.hit_words) for r in made["decontaminate"].collect()) == 20_000 * 11
    assert sorted(len(bytes(r.decoded)) for r in made["bpe"].collect()) == sorted(len((r.text or "").encode()) for r in clashing.collect())


def test_own_columns_where_results_stand_alone(clashing):
    n = clashing.count()
    assert sharding.assign(clashing).count() == n and simhash.groups(clashing).count() == n
    assert simhash.keep(clashing).columns == clashing.columns and quality.keep(clashing).columns == clashing.columns
    scored = ctw.score(clashing).collect()
    assert len(scored) == n and all(r.score < 0 for r in scored)
    assert {r.lang_pred for r in langid.predict(clashing).collect()} <= {"und", *[f"lang{i}" for i in range(0, 8, 2)]}
    assert decontaminate.clean(clashing, clashing.limit(0).select(F.col("doc_id").alias("item_id"), "text"), how="spans").columns == clashing.columns


def test_spans_are_removed_by_batches(spark):
    docs = spark.createDataFrame([(1, "One two, three. Four", "a"), (2, None, "b"), (3, "none here", None)], "doc_id long, text string, _text string")
    bench = spark.createDataFrame([(9, "two three")], "item_id long, text string")
    got = {r.doc_id: (r.text, r._text) for r in decontaminate.clean(docs, bench, how="spans").collect()}
    assert got == {1: ("One . Four", "a"), 2: (None, "b"), 3: ("none here", None)}


def test_windows_stay_small():
    """Memory of a block of items stays a few times its text."""
    import tracemalloc

    rng = random.Random(4)
    names = [f"word{i}" for i in range(20_000)]
    items = [(str(k), " ".join(rng.choices(names, k=200))) for k in range(1500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = decontaminate.Windows(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * size, (peak, size)
    text = items[7][1]
    assert decontaminate.find([text], windows, [None])[1] == [list(range(200))]


def test_ring_is_the_walk_key_by_key(spark, odd):
    """Who goes where, hot keys and any layout included; and how far one more row or shard moves the bounded assignment."""
    rows = [(k, f"t{k % 3}") for k in range(3000)] + [(7, "same")] * 3000 + [(8, f"u{i % 40}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = df.select(F.xxhash64("doc_id").alias("at"), "doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), (F.octet_length("text") + 1).alias("size")).collect()
    order.sort(key=lambda r: (r["at"] >> 48 & 0xFFFF, r["at"], r.doc_id, r.crc, r["size"]))
    want = Counter((r.doc_id, r.crc, s) for r, s in zip(order, brute_ring([r["at"] >> 48 & 0xFFFF for r in order], 8)))
    for parts in (1, 5):
        got = sharding.assign(df.repartition(parts)).collect()
        assert Counter((r.key, r.text_crc32, r.shard) for r in got) == want
        assert len({(r.shard, r.slot) for r in got}) == len(rows)
    a, b = ({r.key: r.shard for r in sharding.assign(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()} for n in (4000, 4001))
    assert sum(a[k] != b[k] for k in a) < 0.02 * len(a)
    c = {r.key: r.shard for r in sharding.assign(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), shards=9).collect()}
    moved = sum(a[k] != c[k] for k in a) / len(a)
    assert moved < 0.6, moved


def test_every_query_returns_all_rows(spark, documents):
    n = documents.count()
    for name, f in queries.QUERIES.items():
        assert f(spark, SF).count() == n, name


def test_op10_digests(spark, documents):
    got = {r.doc_id: r for r in queries.op10_bpe(spark, SF).collect()}
    for r in documents.collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()

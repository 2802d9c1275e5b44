"""Language identification by interpolated Kneser-Ney character models.

A text's letters are lower-cased words (letters and their marks) between two marks; character grams up to ``ORDER`` within a word are counted for each language over all
training rows. A gram is its characters, 16 bits each, packed into 64 bits: nothing collides but letters beyond the first plane, which are folded into its private area.
Continuation counts, discounts, context totals and probabilities are aggregations and joins by language and gram, order by order. What is broadcast are sorted arrays of at most
``ENTRIES`` grams, dealt evenly to the languages: log probability of each gram, and interpolation weight of each of their contexts; a language with more keeps the grams of
orders above 1 from a count on, and backs off for the others. At 18 bytes a gram and as much a context that is 75 MB at most, for 100 languages as for two. The language with the
lowest cross-entropy per character wins.

Scores and rejection are calibrated on about ``CALIBRATION`` distinct training rows, those with the lowest hash of id and text: a temperature for the chance of the winner, and
for each language the cross-entropy above which a text is rejected; a rejected text keeps its nearest language, its score falls with the excess. Only their entropies reach the driver.

Defined results: a null text or one without letters is ``und`` with score 0; texts of any length are read whole; ties go to the language that sorts first; rows without id count
as training rows, repeated ones each time; without training rows every text is ``und``; the result has its own columns only, so names of ``df`` can't clash; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import chunks, few_at_once, materialise, shuffled

ORDER, ENTRIES = 4, 1 << 21
CALIBRATION = 2_000
GATHER = 500_000
CACHE = 500_000
LATIN, WORDS = re.compile(r"[^\W\d_]+"), regex.compile(r"[\p{L}\p{M}]+")


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code of each character of " w1 w2 ... wn " (16 bits, higher planes folded), and its place in its word, the mark before it being 0."""
    data = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    data = np.where(data > 0xFFFF, np.uint64(0xE000) + data % np.uint64(0x1900), data)
    sizes = np.array([len(w) + 1 for w in words])
    place = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return data, place


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORDS.findall(text.lower())
    return LATIN.findall(text.lower())


#: Words scored at once, and bytes of text that a worker holds as words: both bound a worker's memory, not the result.
AT_ONCE, PIECE = 20_000, 2 << 20


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The packed gram of this order that ends at each character but the first; only valid where the word reaches back as far."""
    n = len(data) - 1
    key = np.zeros(n, dtype=np.uint64)
    for back in range(order):
        if back < n + 1:
            key[max(0, back - 1) :] |= data[max(0, 1 - back) : n + 1 - back] << np.uint64(16 * back)
    return key


def gram_counts(words: dict[str, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: grams and their counts."""
    each = list(words)
    data, place = codes(each)
    times = np.repeat(np.array([words[w] for w in each], dtype=np.int64), [len(w) + 1 for w in each])
    for k in range(1, ORDER + 1):
        ok = place >= k - 1
        key, inverse = np.unique(grams(data, k)[ok], return_inverse=True)
        yield k, key, np.bincount(inverse, weights=times[ok]).astype(np.int64)


def _counted(df: DataFrame) -> DataFrame:
    def of(lang: str, words: Counter) -> Iterator[pa.RecordBatch]:
        words = {w: n for w, n in words.items() if any(map(str.isalpha, w))}  # signs like superscripts aren't letters
        for k, key, n in gram_counts(words) if words else ():
            size = len(key)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.full(size, k, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "k", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each: dict[str, Counter] = {}
        for batch in chunks(batches, "text", PIECE):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = each.setdefault(lang, Counter())
                words.update(words_of(text))
                if sum(map(len, each.values())) > GATHER:
                    most = max(each, key=lambda k: len(each[k]))
                    yield from of(most, each.pop(most))
        for lang, words in each.items():
            if words:
                yield from of(lang, words)

    return df.mapInArrow(run, "lang string, k int, gram long, n long")


def kneser_ney(counts: DataFrame, alphabet: int) -> list[DataFrame]:
    """For each order (lang, gram, n, p, ctx, weight): probability of the gram after its context, and the context's interpolation weight."""
    out: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        own = counts.where(F.col("k") == k).select("lang", "gram", "n")
        if k < ORDER:  # how many different characters stand before; a gram at a word's start has its own count
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
            before = counts.where(F.col("k") == k + 1).groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("before"))
            own = shuffled(own, before, ["lang", "gram"], "left").select("lang", "gram", "n", F.coalesce("before", "n").alias("c"))
        else:
            own = own.withColumn("c", F.col("n"))
        own = own.withColumns({"ctx": F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long"), "suf": F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))})
        own = materialise(own, "langid-counts")
        once, twice = F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))
        discount = F.when(once + twice > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / (once + 2 * twice)))).otherwise(F.lit(0.5))
        taken = own.groupBy("lang").agg(discount.alias("d"))
        totals = own.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        totals = totals.join(F.broadcast(taken), "lang").select("lang", "ctx", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"))  # a row a language
        own = shuffled(own, totals, ["lang", "ctx"])
        below = F.lit(1.0 / (alphabet + 1))
        if out:
            own = shuffled(own, out[-1].select("lang", F.col("gram").alias("suf"), F.col("p").alias("below")), ["lang", "suf"])
            below = F.col("below")
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * below
        out.append(materialise(own.select("lang", "gram", "n", p.alias("p"), "ctx", "weight"), "langid-order"))
    return out


def thresholds(counts: DataFrame, langs: list[str], entries: int) -> dict[str, int]:
    """For each language the least count from which on its grams of orders above 1 fit in its share, by a histogram of at most 320 rows a language."""
    step = F.when(F.col("n") < 256, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    out, taken = dict.fromkeys(langs, (1 << 63) - 1), dict.fromkeys(langs, 0)
    full = set()
    rows = counts.where("k > 1").groupBy("lang", step.alias("least")).agg(F.count(F.lit(1)).alias("grams")).collect()
    for r in sorted(rows, key=lambda r: -r["least"]):
        lang = r["lang"]
        taken[lang] += r["grams"]
        if taken[lang] > entries // len(langs):
            full.add(lang)
        if lang not in full:
            out[lang] = r["least"]
    return out


class Table:
    """Sorted 64-bit keys, and for each the languages that have it with their values."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, values: np.ndarray):
        order = np.lexsort((lang, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int32)
        self.lang, self.values = lang[order].astype(np.int16), values[order].astype(np.float32)

    def look(self, keys: np.ndarray, langs: int) -> np.ndarray:
        """A row of values for each key, NaN where a language lacks it."""
        out = np.full((len(keys), langs), np.nan)
        if not len(self.keys) or not len(keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        first, n = self.first[at[hit]], np.diff(self.first)[at[hit]]
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(hit, n), self.lang[entry]] = self.values[entry]
        return out


class Model:
    """The languages' models side by side: for each order the grams' log probabilities and the contexts' log weights."""

    def __init__(self, langs: list[str], alphabet: int, grams: list[Table], weights: list[Table]):
        self.langs, self.floor, self.grams, self.weights = langs, -np.log(alphabet + 1), grams, weights
        self.heat, self.limit = 1.0, np.full(len(langs), np.inf)

    def logs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word and its end, for each language."""
        data, place = codes(words)
        now = np.full((len(place), len(self.langs)), self.floor)
        for k in range(1, ORDER + 1):
            ok = np.flatnonzero(place >= k - 1)
            key = grams(data, k)[ok]
            seen = self.grams[k - 1].look(key, len(self.langs))
            weight = self.weights[k - 1].look(key >> np.uint64(16) if k > 1 else np.zeros_like(key), len(self.langs))
            now[ok] = np.where(np.isnan(seen), np.nan_to_num(weight, nan=0.0) + now[ok], seen)
        sizes = np.array([len(w) + 1 for w in words])
        return np.add.reduceat(now, np.cumsum(sizes) - sizes)

    def calibrate(self, entropy: np.ndarray, truth: list[str]) -> None:
        """Temperature by the log loss of the true language; limits by the spread of right answers."""
        want = np.array([self.langs.index(t) for t in truth])
        best = np.inf
        for heat in 2.0 ** np.arange(-2, 8, 0.5):
            loss = -np.log(self.chances(entropy, heat)[np.arange(len(want)), want] + 1e-12).mean()
            if loss < best - 1e-6:
                best, self.heat = loss, heat
        right = entropy.argmin(1) == want
        for i in range(len(self.langs)):
            own = entropy[right & (want == i), i]
            if len(own) > 5:
                self.limit[i] = own.mean() + 6 * own.std() + 0.1

    @staticmethod
    def chances(entropy: np.ndarray, heat: float) -> np.ndarray:
        e = np.exp(-heat * (entropy - entropy.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)

    def decide(self, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, score, rejected."""
        win = entropy.argmin(1)
        at = np.arange(len(win))
        over = np.maximum(entropy[at, win] - self.limit[win], 0)
        return win, self.chances(entropy, self.heat)[at, win] * np.exp(-over), over > 0


class Reader:
    """Cross-entropies of texts; remembers the words it has scored while there is room."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table, self.sizes = np.zeros((1024, len(self.model.langs))), np.zeros(1024)
        self.used = 0

    def learn(self, words: list[str]) -> None:
        words = [w for w in words if any(map(str.isalpha, w))]  # signs like superscripts aren't letters
        if not words:
            return
        need = self.used + len(words)
        if need > len(self.table):
            room = max(need, 2 * len(self.table))
            self.table = np.concatenate([self.table, np.zeros((room - len(self.table), self.table.shape[1]))])
            self.sizes = np.concatenate([self.sizes, np.zeros(room - len(self.sizes))])
        for i in range(0, len(words), AT_ONCE):  # a word's score is its own
            self.table[self.used + i : min(self.used + i + AT_ONCE, need)] = self.model.logs(words[i : i + AT_ONCE])
        self.sizes[self.used : need] = [len(w) + 1 for w in words]
        self.at.update(zip(words, range(self.used, need)))
        self.used = need

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character for each language, and whether the text has letters."""
        if len(self.at) > CACHE:
            self.clear()
        each = [words_of(t) if t else [] for t in texts]
        new = set().union(*each).difference(self.at) if each else set()
        self.learn(sorted(new))
        out = np.zeros((len(texts), len(self.model.langs)))
        has = np.zeros(len(texts), dtype=bool)
        for i, words in enumerate(each):
            at = [x for x in map(self.at.get, words) if x is not None]
            if at:
                has[i] = True
                at = np.array(at)
                out[i] = -self.table[at].sum(0) / self.sizes[at].sum()
        return out, has


def fitted(counts: DataFrame, entries: int = ENTRIES) -> Model | None:
    """The model of these counts (lang, k, gram, n)."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    alphabet = counts.where("k = 1").select("gram").distinct().count() + 1
    least = thresholds(counts, langs, entries)
    number = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])
    bound = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(least[name]).cast("long"))])
    grams, weights = [], []
    for k, rows in enumerate(kneser_ney(counts, alphabet), 1):
        kept = rows if k == 1 else rows.where(F.col("n") >= F.element_at(bound, F.col("lang")))
        kept = kept.withColumn("i", F.element_at(number, F.col("lang")))
        for into, key, value in ((grams, "gram", "p"), (weights, "ctx", "weight")):
            got = kept.select("i", key, F.log(value).cast("float").alias("v"))
            got = (got.distinct() if key == "ctx" else got).toArrow()  # at most ``entries``, and the single characters
            into.append(Table(got[key].to_numpy().view(np.uint64), got["i"].to_numpy(), got["v"].to_numpy()))
    return Model(langs, alphabet, grams, weights)


def _entropies(rows: DataFrame, shared) -> DataFrame:
    """(h, lang, entropy) of rows (h, lang, text) with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done = Reader(shared.value), set()
        for batch in chunks(batches, "text", PIECE):
            new = []
            for i, x in enumerate(zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist())):
                if x not in done:
                    done.add(x)
                    new.append(i)
            part = batch.take(pa.array(new, pa.int64()))
            each, has = reader.entropies(part.column("text").to_pylist())
            keep = pa.array(np.flatnonzero(has))
            columns = [part.column(c).take(keep) for c in ("h", "lang")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(each[has].tolist(), pa.list_(pa.float64()))], names=["h", "lang", "entropy"])

    return rows.mapInArrow(run, "h long, lang string, entropy array<double>")


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int, entries: int = ENTRIES) -> Model | None:
    spark = df.sparkSession
    few_at_once(spark)
    rows = df.where(~held_out(id_col, folds, fold) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    )
    counts = materialise(_counted(rows.select("lang", "text")).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    model = fitted(counts, entries)
    if model is None:
        return None
    share = min(1.0, CALIBRATION / max(1, rows.count()))
    hashed = rows.select(F.xxhash64("id", "text").alias("h"), "lang", "text").where(F.col("h") <= min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1))
    shared = spark.sparkContext.broadcast(model)
    found = _entropies(hashed, shared).groupBy("h", "lang").agg(F.min("entropy").alias("entropy")).orderBy("h", "lang").collect()
    shared.destroy()  # the calibrated model goes out by itself
    if found:
        model.calibrate(np.array([r["entropy"] for r in found]), [r["lang"] for r in found])
    return model


def predict(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, entries: int = ENTRIES) -> DataFrame:
    """For each row: its id, held_out, lang_pred, score, entropy (nats per character), rejected."""
    model = train(df, id_col, text_col, lang_col, folds, fold, entries)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(own) if own is not None else None
        for batch in chunks(batches, "text", PIECE):
            n = batch.num_rows
            pred, score, entropy, rejected = ["und"] * n, np.zeros(n), [None] * n, [False] * n
            if reader:
                each, has = reader.entropies(batch.column("text").to_pylist())
                at = np.flatnonzero(has)
                if len(at):
                    win, s, over = own.decide(each[at])
                    score[at] = s
                    for i, w, x in zip(at.tolist(), win.tolist(), over.tolist()):
                        pred[i], entropy[i], rejected[i] = own.langs[w], float(each[i, w]), x
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["id", "held_out", "lang_pred", "score", "entropy", "rejected"],
            )

    schema = T.StructType([*rows.select("id", "held_out").schema.fields, *T._parse_datatype_string("lang_pred string, score double, entropy double, rejected boolean").fields])
    return rows.mapInArrow(run, schema)

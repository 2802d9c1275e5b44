"""Joining of broken words over a table: words are known by numbers, and only forms that may be known words are looked up.

A gap closes only if the word that it would make is known, or the part after it begins with the long mark. So each block of texts asks a filter of the known words, of bounded
size, about every gap, and asks on from those that pass; what passes meets the frequencies by shuffles of packed numbers, and the answers come back to the block's texts.
A word's number is a polynomial of 64 bits over its letters, checked by a second one of 32 bits; prefix sums give the number of any run of letters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow import tables as t
from glyphflow.storage import materialise, release, sweep

U = np.uint64
#: Characters of a block of texts (a longer text is a block of its own), bits of the filter at most (64 MB), bits a known word, words a bucket.
BLOCK, FILTER_BITS, WORD_BITS, BUCKET = 700_000, 29, 16, 1 << 17
#: Rows that workers get at once, where the session sends the engine's usual 10,000: whole texts are large.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LONG_VOWELS = {long: short + ":" for long, short in zip("āēīōūȫǖ", "aeiouöü")}
FIRST, LAST = t.TODO_BLOCK
ASKED = np.dtype([("h", "<u8"), ("c", "<u4")])
WORD = np.dtype([("h", "<u8"), ("c", "<u4"), ("f", "<i8")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def letter_values(codes: np.ndarray, k: int) -> np.ndarray:
    return mixed(codes.astype(U) * U(2) + U(0x9E3779B97F4A7C15 + k))


#: What a worker has computed.
_KEPT: dict = {}


def powers(k: int, n: int, inverse: bool = False) -> np.ndarray:
    """The powers of a base, or of its inverse, from 0 to n at least."""
    have = _KEPT.get((k, inverse))
    if have is None or len(have) <= n:
        base = pow(BASES[k], -1, 1 << 64) if inverse else BASES[k]
        steps = np.full(max(n + 1, 1 << 16), base, dtype=U)
        steps[0] = 1
        have = _KEPT[k, inverse] = np.multiply.accumulate(steps)
    return have


def todo_symbols(letter: str, after: str, front: bool) -> str:
    """What a Todo letter is in the transliteration, before ``after`` and with a left-over h by harmony; the long mark stays a sign of its own."""
    out = letter
    for own, before_front, before_back, alone in t.TODO_BY_VOWEL:
        if letter == own:
            out = before_front if after and after in t.TODO_FRONT else before_back if after and after in t.TODO_BACK else alone
    if letter == "ᠴ" and after == "ᡅ":
        out = "j"
    out = dict(t.TODO_TO_ASCII_LONG).get(out, out).translate(str.maketrans(t.TODO_TO_ASCII_FROM, t.TODO_TO_ASCII_TO))
    if out == "c" and after == "ᡅ":
        out = "č"
    for a, b in t.ASCII_TO_LATIN:
        out = out.replace(a, b)
    for a, b in (("O", "ö"), ("U", "ü"), ("h", "k" if front else "x")):
        out = out.replace(a, b)
    return out


def todo_tables():
    """By letter and the class of the letter after it (none, front, back, i): values for both harmonies and numbers; the letters' sizes, classes and harmony vowels."""
    if "todo" in _KEPT:
        return _KEPT["todo"]
    letters = [chr(x) for x in range(FIRST, LAST + 1)]
    after = ["", next(x for x in t.TODO_FRONT if x != "ᡅ"), t.TODO_BACK[0], "ᡅ"]
    size = np.array([len(todo_symbols(x, "", False)) for x in letters], dtype=np.int64)
    symbols = [[[todo_symbols(x, y, front).ljust(2, "\0") for y in after] for x in letters] for front in (False, True)]
    signs = np.array([[[[ord(c) for c in z] for z in y] for y in x] for x in symbols])
    values = np.stack([(letter_values(signs, k) * (signs > 0) * powers(k, 2)[:2]).sum(axis=-1, dtype=U) for k in (0, 1)])
    classes = np.array([3 if x == "ᡅ" else 1 if x in t.TODO_FRONT else 2 if x in t.TODO_BACK else 0 for x in letters])
    ascii_of = [x.translate(str.maketrans(t.TODO_TO_ASCII_FROM, t.TODO_TO_ASCII_TO)) for x in letters]
    harmony = np.array([2 if x in t.HARMONY_FRONT else 1 if x in t.HARMONY_BACK else 0 for x in ascii_of])
    _KEPT["todo"] = values, size, classes, harmony
    return _KEPT["todo"]


def translit_letters() -> np.ndarray:
    if "letters" in _KEPT:
        return _KEPT["letters"]
    out = _KEPT["letters"] = np.zeros(0x110000, dtype=bool)
    out[[ord(x) for x in re.findall(r"[^\W\d_]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))]] = True
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_numbers(words: list[str], script: str) -> tuple[np.ndarray, np.ndarray]:
    """Number and check of each word of the transliteration (none with U+0000); for Todo, long vowels are a vowel and the mark, as ``todo_symbols`` has them."""
    whole = "\0".join(words) + "\0"
    if script == "todo":
        whole = re.sub("(?<=[aeiouöü]):", "\1", whole).translate(str.maketrans(LONG_VOWELS))  # no form has a bare mark there
    c = codes(whole)
    end = np.flatnonzero(c == 0)
    start = np.concatenate([[0], end[:-1] + 1])
    out = []
    for k in (0, 1):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(letter_values(c, k) * powers(k, len(c))[: len(c)], dtype=U)])
        out.append(mixed((sums[end] - sums[start]) * powers(k, len(c), True)[start]))
    return out[0], out[1].astype(np.uint32)


class Runs:
    """Numbers of runs of the letters of a block."""

    def __init__(self, letters: np.ndarray, script: str):
        n = len(letters)
        self.todo = script == "todo"
        if self.todo:
            values, size, classes, harmony = todo_tables()
            self.own = own = letters.astype(np.int64) - FIRST
            before = classes[np.concatenate([own[1:], [0]])] if n else own
            self.at = np.concatenate([[0], np.cumsum(size[own])])
            tone = harmony[own]
            vowels = np.append(np.flatnonzero(tone), n)
            self.vowel = vowels[np.concatenate([[0], np.cumsum(tone > 0)])]  # the first from a place on
            self.front = np.append(tone == 2, False)
            each = own * 4 + before
            self.values = lambda k: [values[k, f].reshape(-1)[each] for f in (0, 1)]
            self.ends = values[:, :, :, 0]
        else:
            self.at = np.arange(n + 1)
            self.values = lambda k: [letter_values(letters, k)]
        self.kept: dict[int, list[np.ndarray]] = {}

    def sums(self, k: int) -> list[np.ndarray]:
        if k not in self.kept:
            power = powers(k, int(self.at[-1]))[self.at[:-1]]
            self.kept[k] = [np.concatenate([np.zeros(1, U), np.cumsum(x * power, dtype=U)]) for x in self.values(k)]
        return self.kept[k]

    def number(self, a: np.ndarray, b: np.ndarray, k: int = 0) -> np.ndarray:
        """Of the letters from a to b, of which there must be one at least."""
        power = powers(k, int(self.at[-1]))
        if self.todo:
            first = self.vowel[a]
            front = self.front[first] & (first < b)
            back_sums, front_sums = self.sums(k)
            last = b - 1
            total = np.where(front, front_sums[last] - front_sums[a], back_sums[last] - back_sums[a])
            total = total + np.where(front, self.ends[k, 1][self.own[last]], self.ends[k, 0][self.own[last]]) * power[self.at[last]]
        else:
            sums = self.sums(k)[0]
            total = sums[b] - sums[a]
        return mixed(total * powers(k, int(self.at[-1]), True)[self.at[a]])


class Gaps:
    """The gaps of some texts: a gap stands between the words L and R; R of a gap is L of the next in its text. Words end as Python's $ has it, before a last line break."""

    def __init__(self, texts: list[str], script: str):
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        self.text_end = np.cumsum(sizes + 1) - 1
        self.text_start = self.text_end - sizes
        self.c = c = codes("\0".join(texts) + "\0")
        gap = (c == 0x20) | (c == 0x202F)
        edge = np.diff(np.concatenate([[0], gap.view(np.int8), [0]]))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(self.text_end, self.start)
        n = len(text)
        self.follows = np.concatenate([text[1:] == text[:-1], [False]])[:n]  # another gap in the same text
        first = np.concatenate([[True], ~self.follows[:-1]])[:n]
        letter = (c >= FIRST) & (c <= LAST) if script == "todo" else translit_letters()[c]
        mark = ord("ᡃ" if script == "todo" else ":")
        none = np.concatenate([[0], np.cumsum(~letter)])
        bare = np.concatenate([[-1], np.flatnonzero(~letter)])
        ls = np.where(first, self.text_start[text], np.concatenate([[0], self.end[:-1]])[:n])
        le, rs = self.start, self.end
        re_ = np.where(self.follows, np.concatenate([self.start[1:], [0]])[:n], self.text_end[text])
        te = le - ((le > ls) & (c[le - 1] == 10))
        body = te if script == "todo" else te - ((te > ls) & (c[te - 1] == mark))
        ts = np.maximum(ls, bare[none[body]] + 1)
        he = bare[none[rs] + 1]
        self.tail, self.head = te > ts, he > rs
        self.mark = c[rs] == mark
        self.mark_needs_tail = script == "todo"
        self.all_letters = self.head & (he == re_)
        self.whole = (ts == ls) & self.tail  # L is its own tail
        self.ends_in_letter = (le > ls) & letter[le - 1]
        kept = letter if script == "todo" else letter | (c == mark)
        place = np.concatenate([[0], np.cumsum(kept)])
        self.a, self.a_end, self.b, self.b_end = place[ts], place[te], place[rs], place[he]
        self.runs = Runs(c[kept], script)

    def extends(self, k: np.ndarray) -> np.ndarray:
        """Whether the tail after gap k was closed reaches over it."""
        nxt = np.minimum(k + 1, len(self.start) - 1)
        return self.follows[k] & self.whole[nxt] & self.ends_in_letter[k]

    def found(self, test, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, k): the tail that began in L of gap i, and gap k, whose joined word passes the test; gaps between them may have been closed."""
        i = k = np.arange(len(self.start))
        out_i, out_k = [], []
        while len(k):
            here = (self.b_end[k] - self.a[i]) <= longest
            i, k = i[here], k[here]
            asked = self.tail[i] & self.head[k]
            ok = np.zeros(len(k), dtype=bool)
            ok[asked] = test(self.runs.number(self.a[i[asked]], self.b_end[k[asked]]))
            out_i.append(i[ok])
            out_k.append(k[ok])
            go = (ok | self.mark[k]) & self.extends(k)
            i, k = i[go], k[go] + 1
        return (np.concatenate(out_i), np.concatenate(out_k)) if out_i else (np.zeros(0, np.int64),) * 2

    def forms(self, i: np.ndarray, k: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The runs of the joined word, of its left and of its right part; a left part ends with L of gap k."""
        return [(self.a[i], self.b_end[k]), (self.a[i], self.a_end[k]), (self.b[k], self.b_end[k])]

    def closed(self, frequency, longest: int) -> np.ndarray:
        """Which gaps close, from left to right. ``frequency``: of numbers, 0 for unknown ones."""
        n = len(self.start)
        i, k = self.found(lambda h: frequency(h) > 0, longest)
        ab, a, b = (frequency(self.runs.number(*x)) for x in self.forms(i, k))
        known = ab >= np.minimum(a, b)
        right, right_known = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)  # by gap, of its own two words
        right[k[i == k]], right_known[k[i == k]] = ab[i == k], known[i == k]
        other = (b == 0) & self.all_letters[k] & self.follows[k] & (right[k + 1] > ab) & right_known[k + 1]
        good = known & ~other
        joins = set((i[good] * n + k[good]).tolist())
        out = np.zeros(n, dtype=bool)
        gaps = np.unique(np.concatenate([k[good], np.flatnonzero(self.mark)]))
        over = self.extends(gaps - 1) if n else gaps
        begin = last = -2
        for g, reaches, mark, tail in zip(gaps.tolist(), over.tolist(), self.mark[gaps].tolist(), self.tail[gaps].tolist()):
            at = begin if last == g - 1 and reaches else g
            if (mark and (not self.mark_needs_tail or tail or at != g)) or at * n + g in joins:
                out[g], begin, last = True, at, g
        return out

    def texts(self, closed: np.ndarray) -> list[str]:
        drop = np.zeros(len(self.c) + 1, dtype=np.int64)
        drop[self.start[closed]] += 1
        drop[self.end[closed]] -= 1
        stays = np.cumsum(drop[:-1]) == 0
        place = np.concatenate([[0], np.cumsum(stays)])
        whole = self.c[stays].tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(place[self.text_start].tolist(), place[self.text_end].tolist())]


class Filter:
    """A filter of numbers, by buckets of 2^m bits with four probes each."""

    PROBES = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))

    def __init__(self, buckets: int, m: int, bits: np.ndarray):
        self.buckets, self.m, self.bits = buckets, m, bits

    @classmethod
    def bucket_bits(cls, h: np.ndarray, m: int) -> np.ndarray:
        out = np.zeros(1 << m, dtype=bool)
        for p in cls.PROBES:
            out[((h * p) >> U(64 - m)).astype(np.int64)] = True
        return np.packbits(out, bitorder="little")

    def __call__(self, h: np.ndarray) -> np.ndarray:
        left = np.arange(len(h))
        for p in self.PROBES:
            x = h[left]
            at = ((x * p) >> U(64 - self.m)).astype(np.int64)
            left = left[(self.bits[(bucket_of(x, self.buckets) << (self.m - 3)) + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
        out = np.zeros(len(h), dtype=bool)
        out[left] = True
        return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & U(0xFFFFFFFF)) * U(buckets) >> U(32)).astype(np.int64)


def dealt(rows: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Rows packed by bucket."""
    bucket = bucket_of(rows["h"], buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = rows[order]
    for x in np.flatnonzero(np.diff(cuts)).tolist():
        yield x, rows[cuts[x] : cuts[x + 1]].tobytes()


def unpacked(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype=kind)


def filter_of(words: DataFrame, buckets: int, m: int) -> np.ndarray:
    """The filter's bits: a bucket's are made in its task, the driver only puts them together."""

    def bits(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([Filter.bucket_bits(unpacked(table["payload"], WORD)["h"], m).tobytes()], pa.binary())})

    out = np.zeros(buckets << (m - 3), dtype=np.uint8)
    for r in words.groupBy("bucket").applyInArrow(bits, "bucket int, bits binary").toLocalIterator():
        out[r.bucket << (m - 3) : (r.bucket + 1) << (m - 3)] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def join_words(df: DataFrame, text_col: str, freq: DataFrame, out: str, script: str) -> DataFrame:
    """``lm.join_broken`` without a letter model, over a column."""
    spark = df.sparkSession
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS)
    counted = materialise(freq.select(F.col("word").cast("string").alias("word"), F.col("freq").cast("long").alias("freq")).where("freq > 0 AND word != ''"), "broken-words", "zstd")
    n, longest = counted.agg(F.count("word"), F.coalesce(F.max(F.char_length("word")), F.lit(0))).first()
    longest *= 2  # a letter of the transliteration is two in Todo at most
    buckets = max(64, -(-n // BUCKET))
    m = max(10, min((WORD_BITS * max(n, 1) // buckets).bit_length(), ((1 << FILTER_BITS) // buckets).bit_length() - 1))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, f) for w, f in zip(batch["word"].to_pylist(), batch["freq"].to_pylist()) if "\0" not in w]
            if not pairs:
                continue
            rows = np.zeros(len(pairs), dtype=WORD)
            rows["h"], rows["c"] = word_numbers([w for w, _ in pairs], script)
            rows["f"] = [f for _, f in pairs]
            packed = list(dealt(rows, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], ["bucket", "payload"])

    words = materialise(counted.mapInArrow(number, "bucket int, payload binary"), "broken-numbers")
    release(counted)
    bits = spark.sparkContext.broadcast(filter_of(words, buckets, m))

    others = [c for c in df.columns if c != text_col]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = df.select(F.struct(F.lit(0).alias(""), *[quoted(c).alias(str(i)) for i, c in enumerate(others)]).alias("row"), quoted(text_col).alias("text"))
    row_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema["row"].dataType.fields])
    asks = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("row", row_type)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Filter(buckets, m, bits.value)
        block = TaskContext.get().partitionId() << 32
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            size, cuts = 0, [0]
            for i, n_chars in enumerate(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()):
                size += n_chars
                if size > BLOCK and i > cuts[-1]:
                    cuts.append(i)
                    size = n_chars
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if a == b:
                    continue
                part, block = batch["text"].slice(a, b - a).to_pylist(), block + 1
                packed = [None if x is None else len(y := x.encode()).to_bytes(4, "little") + codec.compress(y, asbytes=True) for x in part]
                gaps = Gaps([x for x in part if x is not None], script) if any(part) else None
                asked = []
                if gaps is not None and len(gaps.start):
                    found = gaps.forms(*gaps.found(test, longest))
                    want = np.zeros(sum(len(x) for x, _ in found), dtype=ASKED)
                    for key, k in (("h", 0), ("c", 1)):
                        want[key] = np.concatenate([gaps.runs.number(x, y, k) for x, y in found]).astype(ASKED[key])
                    asked = list(dealt(want[np.unique(want["h"], return_index=True)[1]], buckets))
                    del found, want
                del gaps  # before the next block's
                extra = len(asked)
                row = batch["row"].slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * (b - a + extra), pa.int64()), pa.array([None] * (b - a) + [x for x, _ in asked], pa.int32()),
                        pa.array(packed + [x for _, x in asked], pa.binary()), pa.concat_arrays([row, pa.nulls(extra, row.type)]),
                    ],
                    ["block", "bucket", "payload", "row"],
                )

    sweep(spark)  # the counting's shuffle files go before texts travel
    asked = materialise(rows.mapInArrow(ask, asks), "broken-asked", "zstd")

    def answer(wanted: pa.Table, table: pa.Table) -> pa.Table:
        have = unpacked(table["payload"], WORD)
        have = have[np.argsort(have["h"], kind="stable")]
        block, payload = [], []
        for b, p in zip(wanted["block"].to_pylist(), wanted["payload"].to_pylist()) if len(have) else ():
            want = np.frombuffer(p, dtype=ASKED)
            at = np.searchsorted(have["h"], want["h"])
            f = np.zeros(len(want), dtype=np.int64)
            for step in (1, 0):  # two words of one number differ by their check
                x = np.minimum(at + step, len(have) - 1)
                same = (have["h"][x] == want["h"]) & (have["c"][x] == want["c"])
                f[same] = have["f"][x[same]]
            block.append(b)
            payload.append(want["h"][f > 0].tobytes() + f[f > 0].tobytes())  # frequencies side by side, whose zeros pack well
        return pa.table({"block": pa.array(block, pa.int64()), "payload": pa.array(payload, pa.binary())})

    answers = asked.where("bucket IS NOT NULL").select("bucket", "block", "payload").groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(answer, "block long, payload binary")
    keep = out != text_col  # else the text is replaced and doesn't come back
    result = T.StructType([T.StructField("row", row_type), T.StructField("joined", T.StringType()), *([T.StructField("text", T.StringType())] if keep else [])])

    def close(texts: pa.Table, said: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, dtype=U) for x in said["payload"].to_pylist()]
        h_all, f_all = (np.concatenate([np.zeros(0, U), *(x[side * len(x) // 2 : (side + 1) * len(x) // 2] for x in parts)]) for side in (0, 1))
        order = np.argsort(h_all)
        h_all, f_all = h_all[order], f_all[order].astype(np.int64)

        def frequency(h: np.ndarray) -> np.ndarray:
            if not len(h_all):
                return np.zeros(len(h), dtype=np.int64)
            at = np.minimum(np.searchsorted(h_all, h), len(h_all) - 1)
            return np.where(h_all[at] == h, f_all[at], 0)

        codec = pa.Codec("zstd")
        plain = [None if x is None else codec.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True).decode() for x in texts["payload"].to_pylist()]
        gaps = Gaps([x for x in plain if x is not None], script) if any(plain) else None
        done = iter(gaps.texts(gaps.closed(frequency, longest)) if gaps is not None and len(gaps.start) else [x for x in plain if x is not None])
        joined = pa.array([None if x is None else next(done) for x in plain], pa.string())
        row = texts["row"].combine_chunks()
        return pa.table({"row": row, "joined": joined} | ({"text": pa.array(plain, pa.string())} if keep else {}))

    whole = asked.where("bucket IS NULL").select("block", "payload", "row")
    joined = whole.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(close, result)
    columns = [F.col("joined").alias(c) if c == out else F.col("text").alias(c) if c == text_col else F.col("row").getField(str(others.index(c))).alias(c) for c in df.columns]
    return joined.select(*columns, *([] if out in df.columns else [F.col("joined").alias(out)]))

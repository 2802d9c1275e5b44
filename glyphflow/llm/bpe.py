"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A pre-token's bytes become an array of one-byte pieces (bytes written as the letters U+0000 to U+00FF); ``aggregate`` folds the merges over it, each step joining the
leftmost adjacent pair of lowest rank. Ranks come from a literal: an array of small maps, indexed by a hash of the piece, which the optimizer folds to a constant.
Decoding looks up each id of a document's final list in a literal array of pieces and concatenates their bytes; it sees nothing but the ids.

The fold runs once for each of the most frequent distinct pre-tokens of the corpus, as many as ``TABLE_BYTES`` hold (counted over all texts, a threshold on
counts found from a histogram of fixed size); their codes are broadcast in sorted hash arrays, a hit being a 64-bit hash and a checksum of 32 bits. The other pre-tokens
are folded where they stand, in the same stage, so no token and no text is ever shuffled. Workers only split texts and look words up.

A pre-token of more than ``LONG`` bytes would take the fold quadratic time; it is encoded by the library's own merge instead.

Defined results: a null text counts as empty (no ids); a text of any length is one row's work, never cut; equal rows get equal codes, and of equally frequent
pre-tokens all or none are frequent; extra columns pass through, one named like a result is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import chunks, materialise, own, packed

BUCKETS = 8192
#: Bytes that the table of frequent pre-tokens may take.
TABLE_BYTES = 96 << 20
LONG = 128
GATHER = 250_000
CACHE = 150_000
#: What stands between pieces, a letter that no byte is written as.
GAP = "\u0100"
#: Bytes of text that a worker holds in pieces at once.
PIECE = 2 << 20
#: Characters of a plan's text that the driver keeps.
UNLIMITED, PRINTED = "2147483", 1 << 16
#: Stands for the ids of a pre-token that is still to be folded.
HOLE = "_"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Column expressions over a rank file's literals."""

    def __init__(self, ranks: dict[bytes, int]):
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for piece, rank in ranks.items():
            s = piece.decode("latin-1")
            buckets[xxhash.xxh64_intdigest(s.encode(), 42) % BUCKETS][s] = rank
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")
        pairs = [-1] * 65536
        for piece, rank in ranks.items():
            if len(piece) == 2:
                pairs[piece[0] * 256 + piece[1]] = rank
        literal = lambda value, kind: F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)
        self.tables = literal({"ranks": buckets, "pairs": [None if r < 0 else r for r in pairs]}, "struct<ranks:array<map<string,int>>,pairs:array<int>>")
        self.pieces = literal(pieces, "array<string>")

    def using(self, body) -> Column:
        """``body`` of the tables, which the plan holds once: every copy would travel with every task."""
        return _let(self.tables, body)

    @staticmethod
    def rank(tables: Column, piece: Column) -> Column:
        return F.element_at(F.get(tables["ranks"], F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), piece)

    def fold(self, tables: Column, letters: Column) -> Column:
        """Ids of one pre-token, whose bytes are the column's letters.

        The state is (pieces joined by GAP, rank of each adjacent pair, place of the pair to join). Steps alternate: find the leftmost pair of
        lowest rank, then join it and look up the two pairs that it now forms. Strings and one array keep a step free of array concatenation."""
        parts = lambda p, n: F.call_function("substring_index", p, F.lit(GAP), n)
        three = lambda p, last: F.replace(parts(parts(p, last), F.lit(-3)), F.lit(GAP), F.lit(""))

        def step(acc: Column, _: Column) -> Column:
            p, r, i = acc["p"], acc["r"], acc["i"]
            find = F.struct(p.alias("p"), r.alias("r"), F.array_position(r, F.array_min(r)).cast("int").alias("i"))
            ranks = F.transform(
                r,
                lambda x, j: F.when((j < i - 2) | (j > i), x)
                .when(j == i - 2, self.rank(tables, three(p, i + 1)))
                .when(j == i, self.rank(tables, three(p, i + 2)))
                .otherwise(F.lit(-1)),
            )
            join = F.struct(F.concat(parts(p, i), parts(p, i - F.size(r) - 1)).alias("p"), F.array_remove(ranks, -1).alias("r"), F.lit(None).cast("int").alias("i"))
            return F.when(i.isNull(), find).otherwise(join)

        codes = F.transform(F.split(letters, ""), lambda c: F.ascii(c))
        first = F.transform(
            F.slice(codes, F.lit(2), F.length(letters)),
            lambda c, i: F.get(tables["pairs"], F.ascii(F.substr(letters, i + 1, F.lit(1))) * 256 + c),
        )
        merged = F.aggregate(
            F.sequence(F.lit(1), 2 * F.length(letters)),
            F.struct(F.array_join(F.split(letters, ""), GAP).alias("p"), first.alias("r"), F.lit(None).cast("int").alias("i")),
            step,
            lambda acc: F.transform(F.split(acc["p"], GAP), lambda piece: self.rank(tables, piece)),
        )
        return _let(self.rank(tables, letters), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(merged))

    def unfold(self, ids: Column) -> Column:
        """The bytes that these decimal ids, joined by commas, stand for."""
        pieces = _let(self.pieces, lambda table: F.transform(F.split(ids, ",").try_cast("array<int>"), lambda i: F.get(table, i)))
        return F.encode(F.array_join(pieces, ""), "ISO-8859-1")

    def code(self, letters: Column) -> Column:
        """Ids of one pre-token."""
        return self.using(lambda t: self.fold(t, letters))

    def codes(self, words: Column) -> Column:
        """(ids joined by commas, their number) of each of an array."""
        each = lambda t: F.transform(words, lambda w: _let(self.fold(t, w), lambda ids: F.struct(F.array_join(ids, ",").alias("ids"), F.size(ids).alias("n"))))
        return self.using(each)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letters(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def splitter(pattern: str):
    """Function from a text to its pre-tokens. White space is that of Unicode, as the library reads it; texts of Latin-1 letters go by the same pattern over the classes' members."""
    inside = {r"\s": r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"}
    plain = {r"\s": r"\t-\r \x85\xa0", r"\p{L}": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe"}

    def spelled(classes: dict[str, str]) -> str:
        def one(m: re.Match) -> str:
            if m[0].startswith("["):
                return re.sub(r"\\(?:s|p\{\w+\})", lambda c: classes.get(c[0], c[0]), m[0])
            if m[0] == r"\S":
                return f"[^{classes[chr(92) + 's']}]"
            return f"[{classes[m[0]]}]" if m[0] in classes else m[0]

        return re.sub(r"\[[^\]]*\]|\\(?:s|S|p\{\w+\})", one, pattern)

    short, full = re.compile(spelled(plain)).findall, regex.compile(spelled(inside)).findall

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return short(text)

    return find


def _counted(df: DataFrame, pattern: str) -> DataFrame:
    def rows(words: Counter) -> Iterator[pa.RecordBatch]:
        each = list(words)
        for i in range(0, len(each), 50_000):
            part = each[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([words[w] for w in part], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words = splitter(pattern), Counter()
        for batch in chunks(batches, "text", PIECE):
            for t in batch.column("text").to_pylist():
                if t:
                    words.update(find(t))
                    if len(words) > GATHER:
                        yield from rows(words)
                        words = Counter()
        yield from rows(words)

    return df.mapInArrow(run, "word string, n long")


class Codes:
    """Codes of the frequent pre-tokens: hashes in order, and for each a checksum and its ids as decimal text."""

    def __init__(self, found: pa.Table):
        self.hashes, self.sums = found["h"].to_numpy(), found["crc"].to_numpy().astype(np.uint32)
        self.ids = found["ids"].combine_chunks()

    def look(self, words: list[str]) -> list[str]:
        """For each word its ids, or HOLE if it isn't among the frequent."""
        if not len(self.hashes) or not words:
            return [HOLE] * len(words)
        data = [w.encode() for w in words]
        h = np.array([xxhash.xxh64_intdigest(d, 42) for d in data], dtype=np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.sums[at] == np.array([zlib.crc32(d) for d in data], dtype=np.uint32)))
        out = [HOLE] * len(words)
        for i, ids in zip(hit.tolist(), self.ids.take(pa.array(at[hit])).to_pylist()):
            out[i] = ids
        return out


def threshold(words: DataFrame, room: int) -> int | None:
    """The least count from which on all words' entries fit in ``room`` bytes, by a histogram of at most 256 + 64 rows.

    An entry takes at most 16 bytes and, if each byte is an id of five digits and a comma, six a byte."""
    step = F.when(F.col("n") < 256, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    taken, least = 0, None
    for r in sorted(words.groupBy(step.alias("least")).agg(F.sum(16 + 6 * F.octet_length("word").cast("long")).alias("size")).collect(), reverse=True):
        if taken + r["size"] > room:
            break
        taken, least = taken + r["size"], r["least"]
    return least


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", room: int = TABLE_BYTES) -> DataFrame:
    """``df`` without its text, with ids_text (decimal ids joined by commas), n_tokens and decoded (the bytes that the ids stand for)."""
    spark = df.sparkSession
    ranks = read_ranks(vocabulary)
    codec = Codec(ranks)
    if spark.conf.get("spark.sql.maxPlanStringLength").startswith(UNLIMITED):
        spark.conf.set("spark.sql.maxPlanStringLength", PRINTED)  # the driver keeps every plan as text, and this one holds the literal tables
    rows, names = packed(df, text_col, ("ids_text", "n_tokens", "decoded"))
    words = materialise(_counted(rows.select(F.col("_text").alias("text")), pattern).groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    words = words.where(F.octet_length("word") <= LONG)
    least = threshold(words, room)
    often = words.where(F.col("n") >= (least or 0)).select("word", letters(F.col("word")).alias("b"))
    if least is None:
        often = often.limit(0)
    found = materialise(
        often.select(F.xxhash64("word").alias("h"), F.crc32(F.col("word").cast("binary")).alias("crc"), F.array_join(codec.code(F.col("b")), ",").alias("ids")),
        "bpe-codes",
    )
    shared = spark.sparkContext.broadcast((vars(Codes(found.orderBy("h").toArrow())), ranks))  # at most ``room`` bytes and the vocabulary
    coded = _split(rows, shared, pattern).select("_row", "known", "n_known", F.when(F.size("others") > 0, codec.codes(F.col("others"))).alias("codes"))
    n = F.col("n_known") + F.coalesce(F.aggregate("codes.n", F.lit(0).cast("long"), lambda total, k: total + k), F.lit(0))
    whole = coded.select("_row", F.when(F.col("codes").isNull(), F.col("known")).otherwise(_mix("known", HOLE, F.col("codes.ids"))).alias("ids_text"), n.alias("n_tokens"))
    return whole.select(*own(names, text_col, text=False), "ids_text", "n_tokens", codec.unfold(F.col("ids_text")).alias("decoded"))


def _mix(runs: str, mark: str, between: Column) -> Column:
    """The column's text with its k-th mark replaced by the k-th string."""
    # strings and gaps alternate; one gap more than strings
    return F.array_join(F.flatten(F.zip_with(F.split(runs, mark, -1), F.concat(between, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def _split(rows: DataFrame, shared, pattern: str) -> DataFrame:
    """Known codes as text, with a sign for each pre-token that is still to be folded; and these, as letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks = shared.value
        codes = Codes.__new__(Codes)
        codes.__dict__ = table
        find, merge = splitter(pattern), None
        ids_of: dict[str, str] = {}
        for batch in chunks(batches, "_text", PIECE):
            if len(ids_of) > CACHE:
                ids_of = {}
            each = [find(t) if t else [] for t in batch.column("_text").to_pylist()]
            new = list(set().union(*each).difference(ids_of))
            ids_of.update(zip(new, codes.look(new)))
            for w in new:
                if len(w) > LONG // 4 and ids_of[w] == HOLE and len(w.encode()) > LONG:
                    merge = merge or long_merge(ranks)
                    ids_of[w] = merge(w.encode())
            known, others, n_known = [], [], []
            for words in each:
                got = list(map(ids_of.__getitem__, words))
                joined = ",".join(got)
                known.append(joined)
                others.append([w.encode().decode("latin-1") for w, c in zip(words, got) if c == HOLE] if HOLE in joined else [])
                n_known.append(joined.count(",") + bool(words) - len(others[-1]))
            columns = [batch.column("_row"), *(pa.array(x, k) for x, k in ((known, pa.string()), (others, pa.list_(pa.string())), (n_known, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "known", "others", "n_known"])

    more = T._parse_datatype_string("known string, others array<string>, n_known long").fields
    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], *more]))


def long_merge(ranks: dict[bytes, int]):
    """The library's merge of one pre-token, for those that the fold would take too long for."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return lambda data: ",".join(map(str, [ranks[data]] if data in ranks else own._encode_bytes(data)))

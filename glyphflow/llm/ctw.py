"""Language-model scores by context-tree weighting over bytes.

A text is a sequence of tokens: its words, lower-cased, and one end. A token is its bytes and a terminator (the end is a terminator alone); each byte is eight binary decisions,
predicted from the up to ``DEPTH`` bytes before it in its token, the token's start being one of them. Bytes are taken as they are. Every decision has a context tree: a
node's block probability is the Krichevsky-Trofimov estimate of its counts, mixed half and half with the product of its children's. A prediction mixes the estimates of all
depths on its path by their posterior weights; a path ends where training saw no further.

The tree is never in one place. A byte and its context pack into 64 bits, a gram. Grams of distinct words are shuffled by the last ``TOP`` + 1 bytes of context and sorted;
a task weighs whole subtrees, a bounded number of grams at a time, and hands up what depth ``TOP`` needs, which is summed by shuffle. Depths 0 to ``TOP`` have at most
256**TOP * 255 nodes; they are weighed on the driver and broadcast, and a second pass over the subtrees gives each gram its log probability. Grams meet their words, and rare
words their texts, in joins; as many frequent words as ``TABLE_BYTES`` hold are broadcast. The tree has a node for every context of every word, so it grows with the corpus.

With ``across`` contexts don't end at a token: a text is one sequence, and a byte is predicted from the up to ``DEPTH`` bytes before it in its text, terminators included.
Grams are then counted place by place, packed and dealt by ``BUCKETS`` of their first ``TOP`` + 1 bytes of context. Their logs meet the texts' places in the buckets, and
sums by text go back, packed too; as many frequent grams as ``TABLE_BYTES`` hold are broadcast, so that their places don't travel.

Defined results: a null text counts as empty (one end token); texts and words may have any length; rows without id count as training rows; equal rows get equal scores,
repeated training rows count each time; with no training rows every decision has chance 1/2; the result has its own columns only, so names of ``df`` can't clash; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import chunks, few_at_once, materialise, release, shuffled, sweep

DEPTH, TOP = 7, 2
#: Stands at the end of every token, and so before the next.
STOP = 32
START = bytes([STOP]) * DEPTH
#: Bytes of words that are broadcast with their counts and scores, 32 bytes a word included.
TABLE_BYTES = 24 << 20
#: Distinct words that a task gathers before it hands on its counts.
GATHER = 500_000
#: Grams that are weighed at once, if no subtree has more.
BLOCK = 1 << 18
#: Parts that grams are dealt to by their context, places that are taken at once, and grams or places that a task gathers before it hands them on.
BUCKETS, AT_ONCE, HELD = 1 << 10, 1 << 19, 3 << 20
#: Places that a task counts at once, 8 bytes each.
TALLIED = 4 << 20
#: What the newest bytes of context are multiplied by, and where they stand in a gram.
ODD, LOW, REST = 0x9E3779B1, np.uint64(64 - 8 * (TOP + 1)), np.uint64((1 << 64 - 8 * (TOP + 1)) - 1)
HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: Stirling's series at x + 8, carried back."""
    shift = np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


SMALL = 4096
HALVES, WHOLES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(2 * SMALL) + 1.0)
#: Block probabilities of pairs of counts below FEW, which nearly all nodes have.
FEW = 64
PAIRS = (HALVES[:FEW, None] + HALVES[:FEW] - WHOLES[np.arange(FEW)[:, None] + np.arange(FEW)] - math.log(math.pi)).ravel()
PAIRS[0] = 0.0


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    more = np.flatnonzero((a | b) >= FEW)
    if not len(more):
        return PAIRS[a * FEW + b]
    pair = a * FEW + b
    pair[more] = 0
    out, a, b = PAIRS[pair], a[more], b[more]
    big = (a >= SMALL) | (b >= SMALL)
    x, y = np.where(big, 0, a), np.where(big, 0, b)
    part = HALVES[x] + HALVES[y] - WHOLES[x + y] - math.log(math.pi)
    if big.any():
        x, y = a[big].astype(np.float64), b[big].astype(np.float64)
        part[big] = log_gamma(x + 0.5) + log_gamma(y + 0.5) - log_gamma(x + y + 1) - math.log(math.pi)
    out[more] = part
    return out


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of these tokens, one after the other: context, newest byte highest, above the byte; and each token's number of grams."""
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    return _grams(b"".join([x for w in words for x in (w, b" ")]), sizes)[0], sizes


def _grams(whole: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of sequences of these sizes, and each one's place in its own."""
    data = np.frombuffer(whole, dtype=np.uint8).astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = data.copy()
    for back in range(1, DEPTH + 1):
        before = np.full(len(data), STOP, dtype=np.uint64)
        before[back:] = data[:-back]
        out |= np.where(place >= back, before, np.uint64(STOP)) << np.uint64(64 - 8 * back)
    return out, place


def sequence(text: str | None) -> bytes:
    """The tokens of a text, each with its terminator, but the end without."""
    words = low(text).split()
    return b" ".join([*words, b""])


def windows(data: bytes) -> np.ndarray:
    """The gram of each byte that has ``DEPTH`` bytes before it."""
    out = np.empty(len(data) - DEPTH, np.uint64)
    for first in range(min(8, len(out))):
        to = out[first::8]
        to[:] = np.frombuffer(data, "<u8", len(to), first)
    return out << np.uint64(8) | out >> np.uint64(56)


def places(texts: list[bytes], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of each of these sequences and its end, at most ``limit`` and a text's rest at once, with the number of their text. A longer text is cut, its contexts are not."""
    held: list[tuple[int, bytes]] = []  # each piece with the DEPTH bytes before it

    def done() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(h[1]) for h in held])
        grams = windows(b"".join(h[1] for h in held))
        if len(held) > 1:  # without those that end before their piece
            own = np.ones(len(grams), bool)
            own[(np.cumsum(sizes)[:-1, None] - np.arange(1, DEPTH + 1)).ravel()] = False
            grams = grams[own]
        return grams, np.repeat([h[0] for h in held], sizes - DEPTH)

    size = 0
    for i, t in enumerate(texts):
        t = START + t + b" "
        for a in range(0, len(t) - DEPTH, limit):
            if size and size + min(len(t) - DEPTH - a, limit) > limit:
                yield done()
                held, size = [], 0
            held.append((i, t[a : a + DEPTH + limit]))
            size += len(held[-1][1]) - DEPTH
    if held:
        yield done()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at)


class Nodes:
    """The decisions of one depth at one bit: groups of sorted rows (context above byte) with the zeros and ones of training."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, total: np.ndarray, bit: int):
        prefix = keys >> np.uint64(8 - bit)
        new = np.empty(len(keys), bool)
        new[0] = True
        np.not_equal(prefix[1:], prefix[:-1], out=new[1:])
        self.first, self.at = np.flatnonzero(new), np.cumsum(new) - 1
        ends = np.append(self.first[1:], len(keys)) - 1
        ones = np.cumsum(n * (keys >> np.uint64(7 - bit) & np.uint64(1)).view(np.int64))[ends]
        self.b = np.diff(ones, prepend=0)
        self.a = np.diff(total[ends], prepend=0) - self.b
        self.kt = kt(self.a, self.b)
        self.one = (self.b + 0.5) / (self.a + self.b + 1)

    def weigh(self, below: np.ndarray | None) -> None:
        """Block probability and weight of stopping, from the sum of the children's log block probabilities."""
        if below is None:
            self.log, self.stop = self.kt, np.ones(len(self.kt))
            return
        less = np.exp(-np.abs(below - self.kt))
        self.log = HALF + np.maximum(self.kt, below) + np.log1p(less)
        self.stop = np.where(below > self.kt, less, 1.0) / (1 + less)

    def descend(self, sure: np.ndarray, left: np.ndarray, last: np.ndarray) -> None:
        """From what the parents pass on (chance so far, weight left, chance if the path ended there): the same for the children."""
        seen = self.a + self.b > 0
        self.last = np.where(seen, sure + left * self.one, last)
        self.sure = sure + left * self.stop * self.one
        self.left = left * (1 - self.stop)


class Subtrees:
    """Whole subtrees below depth TOP, from sorted distinct grams and their training counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams = grams
        self.keys, self.n, self.up = {DEPTH: grams}, {DEPTH: n}, {}
        for d in range(DEPTH - 1, TOP, -1):
            below = self.keys[d + 1]
            key = (below >> np.uint64(16)) << np.uint64(8) | below & np.uint64(255)
            self.keys[d], self.up[d + 1] = np.unique(key, return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], weights=self.n[d + 1]).astype(np.int64)
        self.total = {d: np.cumsum(n) for d, n in self.n.items()}

    def weighed(self, bit: int) -> tuple[dict[int, Nodes], dict[int, np.ndarray]]:
        """The nodes of each depth at this bit, and each node's parent."""
        each = {d: Nodes(self.keys[d], self.n[d], self.total[d], bit) for d in self.keys}
        parent = {d: each[d - 1].at[self.up[d][each[d].first]] for d in self.up}
        below = None
        for d in range(DEPTH, TOP, -1):
            each[d].weigh(below)
            if d - 1 > TOP:
                below = np.bincount(parent[d], weights=each[d].log, minlength=len(each[d - 1].kt))
        return each, parent

    def above(self, nodes: Nodes, bit: int) -> np.ndarray:
        """For each node of depth TOP + 1 the key of its parent: context above decision (1, then the bits so far)."""
        rows = self.keys[TOP + 1][nodes.first]
        return (rows >> np.uint64(16)) << np.uint64(8) | np.uint64(1 << bit) | (rows & np.uint64(255)) >> np.uint64(8 - bit)

    def handed_up(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys at depth TOP with zeros, ones and the log block probabilities of their children here."""
        out = []
        for bit in range(8):
            top = self.weighed(bit)[0][TOP + 1]
            keys, at = np.unique(self.above(top, bit), return_inverse=True)
            out.append((keys, *(np.bincount(at, weights=x) for x in (top.a, top.b, top.log))))
        return tuple(np.concatenate(x) for x in zip(*out))

    def logs(self, top: list) -> np.ndarray:
        """Log10 probability of each gram."""
        out = np.zeros(len(self.grams))
        for bit in range(8):
            each, parent = self.weighed(bit)
            state = look_up(top, self.above(each[TOP + 1], bit))
            for d in range(TOP + 1, DEPTH + 1):
                each[d].descend(*(state if d == TOP + 1 else [x[parent[d]] for x in state]))
                state = (each[d].sure, each[d].left, each[d].last)
            one = each[DEPTH].last[each[DEPTH].at]
            out += np.log10(np.where(self.grams >> np.uint64(7 - bit) & np.uint64(1), one, 1 - one))
        return out


class Upper(Nodes):
    """All decisions of one of the depths 0 to TOP, by key."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.keys, self.a, self.b = keys, a.astype(np.int64), b.astype(np.int64)
        self.kt, self.one = kt(self.a, self.b), (self.b + 0.5) / (self.a + self.b + 1)


def weigh_top(keys: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each depth from 0 to TOP: keys, and what a node passes on to its children, from depth TOP's keys, counts and children's sums."""
    order = np.argsort(keys)
    each = [Upper(keys[order], a[order], b[order])]
    each[0].weigh(below[order])
    for _ in range(TOP):
        low = each[0]
        up, at = np.unique((low.keys >> np.uint64(16)) << np.uint64(8) | low.keys & np.uint64(255), return_inverse=True)
        high = Upper(up, np.bincount(at, weights=low.a), np.bincount(at, weights=low.b))
        high.weigh(np.bincount(at, weights=low.log))
        low.parent = at
        each.insert(0, high)
    n = len(each[0].keys)
    state = (np.zeros(n), np.ones(n), np.full(n, 0.5))
    for d, nodes in enumerate(each):
        nodes.descend(*(state if d == 0 else [x[nodes.parent] for x in state]))
        state = (nodes.sure, nodes.left, nodes.last)
    return [(x.keys, x.sure, x.left, x.last, x.a + x.b > 0) for x in each]


def look_up(top: list, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What these nodes of depth TOP pass on; a node that training never reached passes on its nearest seen ancestor's chance."""
    n = len(keys)
    sure, left, last, context = np.zeros(n), np.ones(n), np.full(n, 0.5), keys >> np.uint64(8)
    for depth, (known, s, r, q, seen) in enumerate(top):
        key = (context >> np.uint64(8 * (TOP - depth))) << np.uint64(8) | keys & np.uint64(255)
        at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        hit = (known[at] == key) & seen[at] if len(known) else np.zeros(n, dtype=bool)
        last = np.where(hit, q[at] if len(known) else 0, last)
        if depth == TOP and len(known):
            sure, left = np.where(hit, s[at], 0), np.where(hit, r[at], 1)
    return sure, left, last


def low(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes: A-Z only


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _counted(rows: DataFrame) -> DataFrame:
    """Partial counts (word, times in training texts); the word null stands for the end."""

    def of(words: Counter) -> Iterator[pa.RecordBatch]:
        each = list(words)
        for i in range(0, len(each), 50_000):
            part = each[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in part], pa.string()), pa.array([words[w] for w in part], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, others, ends = Counter(), set(), 0

        def done() -> Iterator[pa.RecordBatch]:
            for w in others.difference(words):  # held out only, so that every word has a score
                words[w] = 0
            yield from of(words)

        for batch in chunks(batches):
            for t, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                if held:
                    others.update(low(t).split())
                else:
                    words.update(low(t).split())
                    ends += 1
                if len(words) + len(others) > GATHER:
                    yield from done()
                    words, others = Counter(), set()
        yield from done()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], names=["word", "n"])

    return rows.select("text", "held_out").mapInArrow(run, "word string, n long")


def _spelled(words: DataFrame) -> DataFrame:
    """(wid, gram) for each place of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([batch]), "word", 1 << 20):
                grams, sizes = grams_of([(w or "").encode() for w in part.column("word").to_pylist()])
                wid = np.repeat(part.column("wid").to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(wid), pa.array(grams.view(np.int64))], names=["wid", "gram"])

    return words.select("wid", "word").mapInArrow(run, "wid long, gram long")


def _gathered(words: DataFrame) -> DataFrame:
    """(part, gram, n): partial training counts of grams; part is their context at depth TOP + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(iter([batch]), "word", 1 << 20):
                grams, sizes = grams_of([(w or "").encode() for w in piece.column("word").to_pylist()])
                grams, n = summed(grams, np.repeat(piece.column("n").to_numpy(), sizes))
                part = (grams >> np.uint64(64 - 8 * (TOP + 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(grams.view(np.int64)), pa.array(n)], names=["part", "gram", "n"])

    return words.select("word", "n").mapInArrow(run, "part int, gram long, n long")


def _weighed(gathered: DataFrame) -> DataFrame:
    """One row for each block of subtrees, its grams and counts as bytes; and rows (key, a, b, below) for depth TOP."""
    nothing = {"grams": pa.binary(), "counts": pa.binary(), "key": pa.int64(), "a": pa.int64(), "b": pa.int64(), "below": pa.float64()}

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in nothing.items()], names=list(nothing))

    def block(grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams, n = summed(grams, n)
        yield rows(1, grams=[grams.tobytes()], counts=[n.tobytes()])
        keys, a, b, below = Subtrees(grams, n).handed_up()
        yield rows(len(keys), key=keys.view(np.int64), a=a.astype(np.int64), b=b.astype(np.int64), below=below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, shift = 0, np.uint64(64 - 8 * (TOP + 1))
        for batch in batches:  # rows come sorted by part, then gram
            grams, n = batch.column("gram").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            if size >= BLOCK and len(grams):
                part = held[-1][0][-1] >> shift
                cut = int(np.searchsorted(grams >> shift, part, "right")) if (grams >> shift)[0] == part else 0
                if cut < len(grams):
                    held.append((grams[:cut], n[:cut]))
                    yield from block(*map(np.concatenate, zip(*held)))
                    held, size, grams, n = [], 0, grams[cut:], n[cut:]
            if len(grams):
                held.append((grams, n))
                size += len(grams)
        if held:
            yield from block(*map(np.concatenate, zip(*held)))

    schema = "grams binary, counts binary, key long, a long, b long, below double"
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))  # whose first bytes are the part
    return gathered.repartition("part").sortWithinPartitions(unsigned).select("gram", "n").mapInArrow(run, schema)


def _logs(blocks: DataFrame, top) -> DataFrame:
    """(gram, log) of every gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c in zip(batch.column("grams"), batch.column("counts")):
                grams = np.frombuffer(g.as_buffer(), dtype=np.uint64)
                logs = Subtrees(grams, np.frombuffer(c.as_buffer(), dtype=np.int64)).logs(top.value)
                for i in range(0, len(grams), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + 50_000].view(np.int64)), pa.array(logs[i : i + 50_000])], names=["gram", "log"])

    return blocks.select("grams", "counts").mapInArrow(run, "gram long, log double")


def word_scores(words: DataFrame) -> DataFrame:
    """(wid, score): log10 probability of each of (wid, word, n), n being its count in training; the word null is the end."""
    spark = words.sparkSession
    weighed = materialise(_weighed(_gathered(words)), "ctw-tree")
    sums = weighed.where("key IS NOT NULL").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("a", "b", "below")]).toArrow()  # at most 256**TOP * 255 rows
    top = spark.sparkContext.broadcast(weigh_top(sums["key"].to_numpy().view(np.uint64), *[sums[c].to_numpy() for c in ("a", "b", "below")]))
    logs = materialise(_logs(weighed.where("grams IS NOT NULL"), top), "ctw-logs")
    return shuffled(_spelled(words), logs, "gram").groupBy("wid").agg(F.sum("log").alias("score"))


def mixed(grams: np.ndarray) -> np.ndarray:
    """Grams with the newest ``TOP`` + 1 bytes of context multiplied, so that sorting them puts together the grams of a bucket, and in it those of a context."""
    return (grams >> LOW) * np.uint64(ODD) << LOW | grams & REST


def plain(grams: np.ndarray) -> np.ndarray:
    return (grams >> LOW) * np.uint64(pow(ODD, -1, 256 ** (TOP + 1))) << LOW | grams & REST


def _planes(*columns: np.ndarray) -> np.ndarray:
    """Columns of eight bytes a value, byte by byte."""
    return np.concatenate([np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T) for c in columns])


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(_planes(*columns), codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, size: int, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=8 * size * len(kinds), codec="zstd"), np.uint8).reshape(len(kinds), 8, size)
    return [np.ascontiguousarray(r.T).view(k).ravel() for r, k in zip(raw, kinds)]


def _by_bucket(keys: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, size, data) of mixed grams in order and what belongs to them; the data has the grams as they were."""
    bucket = (keys >> np.uint64(64) - np.uint64(BUCKETS.bit_length() - 1)).astype(np.uint16)
    planes = _planes(plain(keys), other)
    ends = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    for s, e in zip(ends, ends[1:]):
        if e > s:
            yield int(bucket[s]), e - s, pa.compress(np.ascontiguousarray(planes[:, s:e]), codec="zstd", asbytes=True)


def _batch(rows: list[tuple], names: str, *kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names.split())


def _tallied(rows: DataFrame) -> DataFrame:
    """(bucket, size, data): partial training counts of the grams of texts, zero for those that are only held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {False: [], True: []}, 0

        def counted(which: bool) -> tuple[np.ndarray, np.ndarray]:
            g = np.concatenate([np.zeros(0, np.uint64), *held[which]])
            held[which].clear()
            g.sort()
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
            return g[at], np.diff(at, append=len(g))

        def done() -> pa.RecordBatch:
            grams, n = counted(False)
            others, _ = counted(True)
            if len(grams):
                others = others[grams[np.minimum(np.searchsorted(grams, others), len(grams) - 1)] != others]
            dealt = chain(_by_bucket(grams, n), _by_bucket(others, np.zeros(len(others), np.int64)))
            return _batch(list(dealt), "bucket size data", pa.int32(), pa.int32(), pa.binary())

        for batch in chunks(batches):
            texts, out = batch.column("text").to_pylist(), batch.column("held_out").to_pylist()
            for which in held:
                for grams, _ in places([sequence(t) for t, o in zip(texts, out) if o is which], AT_ONCE):
                    held[which].append(mixed(grams))
                    size += len(grams)
                    if size >= TALLIED:
                        yield done()
                        size = 0
        if size:
            yield done()

    return rows.select("text", "held_out").mapInArrow(run, "bucket int, size int, data binary")


def _grown(tallied: DataFrame) -> DataFrame:
    """(bucket, size, data) of each bucket's grams and counts, whole subtrees; and rows (key, a, b, below) for depth TOP."""
    kinds = {"bucket": pa.int32(), "size": pa.int32(), "data": pa.binary(), "key": pa.int64(), "a": pa.int64(), "b": pa.int64(), "below": pa.float64()}

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def done(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        grams, n = summed(*map(np.concatenate, zip(*held)))
        yield rows(1, bucket=[bucket], size=[len(grams)], data=[_packed(grams, n)])
        keys, a, b, below = Subtrees(grams, n).handed_up()
        yield rows(len(keys), key=keys.view(np.int64), a=a.astype(np.int64), b=b.astype(np.int64), below=below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for bucket, k, data in zip(batch.column("bucket").to_pylist(), batch.column("size").to_pylist(), batch.column("data")):
                if held and bucket != now:
                    yield from done(now, held)
                    held, size = [], 0
                now = bucket
                held.append(_unpacked(data, k, np.uint64, np.int64))
                size += k
                if size > HELD:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0]) // 2
        if held:
            yield from done(now, held)

    return tallied.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, size int, data binary, key long, a long, b long, below double")


def _leaves(grown: DataFrame, top) -> DataFrame:
    """(bucket, size, data): grams, counts and logs of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, k, data in zip(batch.column("bucket").to_pylist(), batch.column("size").to_pylist(), batch.column("data")):
                grams, n = _unpacked(data, k, np.uint64, np.int64)
                yield _batch([(bucket, k, _packed(grams, n, Subtrees(grams, n).logs(top.value)))], "bucket size data", pa.int32(), pa.int32(), pa.binary())

    return grown.select("bucket", "size", "data").mapInArrow(run, "bucket int, size int, data binary")


def _frequent(leaves: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams that fit in ``room`` bytes, mixed and sorted, and their logs."""

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column("size").to_pylist(), batch.column("data")):
                n = _unpacked(data, k, np.uint64, np.int64, np.float64)[1]
                m, many = np.unique(np.frexp(n[n > 0].astype(np.float64))[1] - 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(many, pa.int64())], names=["m", "many"])

    least, taken = None, 0
    for r in sorted(leaves.mapInArrow(orders, "m int, many long").groupBy("m").agg(F.sum("many").alias("many")).collect(), reverse=True):  # at most 64 rows
        taken += 16 * r["many"]
        if taken > room:
            break
        least = 1 << r["m"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column("size").to_pylist(), batch.column("data")):
                grams, n, log = _unpacked(data, k, np.uint64, np.int64, np.float64)
                some = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(log[some])], names=["gram", "log"])

    found = leaves.mapInArrow(those, "gram long, log double").toArrow()
    keys, log = mixed(found["gram"].to_numpy().view(np.uint64)), found["log"].to_numpy()
    order = np.argsort(keys)
    return keys[order], log[order]


def text_scores(rows: DataFrame, room: int = TABLE_BYTES) -> DataFrame:
    """(rid, score): log10 probability of each whole text of (rid, text, held_out), contexts reaching over its tokens. ``rows`` must give the same rows each time."""
    spark = rows.sparkSession
    grown = materialise(_grown(_tallied(rows)), "ctw-tree")
    sums = grown.where("key IS NOT NULL").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("a", "b", "below")]).toArrow()  # at most 256**TOP * 255 rows
    top = spark.sparkContext.broadcast(weigh_top(sums["key"].to_numpy().view(np.uint64), *[sums[c].to_numpy() for c in ("a", "b", "below")]))
    leaves = materialise(_leaves(grown.where("key IS NULL"), top), "ctw-logs")
    release(grown)
    often = spark.sparkContext.broadcast(_frequent(leaves, room))
    sweep(spark)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = often.value
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            keys, rid = map(np.concatenate, zip(*held))
            order = np.argsort(keys)
            return _batch([(b, 1, k, d) for b, k, d in _by_bucket(keys[order], rid[order])], "bucket kind size data", pa.int32(), pa.int32(), pa.int32(), pa.binary())

        for batch in chunks(batches):
            rid, total = batch.column("rid").to_numpy(), np.zeros(batch.num_rows)
            for grams, of in places([sequence(t) for t in batch.column("text").to_pylist()], AT_ONCE):
                keys = mixed(grams)
                order = np.argsort(keys)
                keys, of = keys[order], of[order]
                if len(known):
                    new = np.concatenate([[True], keys[1:] != keys[:-1]])
                    each = keys[new]
                    at = np.minimum(np.searchsorted(known, each), len(known) - 1)
                    hit = known[at] == each
                    of_each = np.cumsum(new) - 1
                    total += np.bincount(of, weights=np.where(hit, logs[at], 0.0)[of_each], minlength=len(total))
                    cold = np.flatnonzero(~hit[of_each])
                    keys, of = keys[cold], of[cold]
                held.append((keys, rid[of]))
                size += len(keys)
                if size >= HELD // 2:
                    yield dealt()
                    held, size = [], 0
            yield _batch([(int(rid[0]) % BUCKETS, 2, len(rid), _packed(rid, total))], "bucket kind size data", pa.int32(), pa.int32(), pa.int32(), pa.binary())
        if size:
            yield dealt()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, held, size = np.zeros(0, np.uint64), np.zeros(0), [], 0

        def done() -> tuple[np.ndarray, np.ndarray]:
            return summed(*map(np.concatenate, zip(*held)))

        for batch in batches:
            for kind, k, data in zip(batch.column("kind").to_pylist(), batch.column("size").to_pylist(), batch.column("data")):
                if kind == 0:  # before the places of its bucket
                    known, _, logs = _unpacked(data, k, np.uint64, np.int64, np.float64)
                elif kind == 1:
                    grams, rid = _unpacked(data, k, np.uint64, np.int64)
                    held.append((rid, logs[np.searchsorted(known, grams)]))
                else:
                    held.append(tuple(_unpacked(data, k, np.int64, np.float64)))
                size += k if kind else 0
                if size > HELD // 4:
                    held = [done()]
                    size = len(held[0][0]) // 2
                    if size > HELD // 8:
                        yield sent(*held[0])
                        held, size = [], 0
        if held:
            yield sent(*done())

    def sent(rid: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        part = (rid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64) - np.uint64(BUCKETS.bit_length() - 1)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        ends = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(part)]
        each = [(int(part[o[0]]), len(o), _packed(rid[o], score[o])) for o in (order[s:e] for s, e in zip(ends, ends[1:]))]
        return _batch(each, "part size data", pa.int32(), pa.int32(), pa.binary())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, HELD // 4
        for batch in batches:
            for k, data in zip(batch.column("size").to_pylist(), batch.column("data")):
                held.append(_unpacked(data, k, np.int64, np.float64))
                size += k
                if size > most:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    most = max(most, 2 * size)
        if held:
            rid, score = summed(*map(np.concatenate, zip(*held)))
            for i in range(0, len(rid), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(rid[i : i + 50_000]), pa.array(score[i : i + 50_000])], names=["rid", "score"])

    asked = rows.select("rid", "text").mapInArrow(placed, "bucket int, kind int, size int, data binary")
    both = leaves.select("bucket", F.lit(0).alias("kind"), "size", "data").unionByName(asked)
    sums = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(met, "part int, size int, data binary")
    return sums.repartition("part").select("size", "data").mapInArrow(added, "rid long, score double")


def threshold(words: DataFrame, room: int) -> int | None:
    """The least count from which on all words fit in ``room`` bytes, by their orders of magnitude, at most 64 rows."""
    taken, least = 0, None
    sizes = words.where("n > 0").groupBy(F.floor(F.log2("n")).alias("m")).agg(F.sum(F.octet_length("word").cast("long") + 32).alias("size")).collect()
    for r in sorted(sizes, reverse=True):
        if taken + r["size"] > room:
            break
        taken, least = taken + r["size"], 1 << r["m"]
    return least


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, room: int = TABLE_BYTES, across: bool = False) -> DataFrame:
    """For each row: its id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. ``across``: contexts reach over the tokens of a text, else each token starts anew."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col, folds, fold).alias("held_out"))
    if across:
        few_at_once(spark)
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "ctw-texts", "zstd") if across else rows
    counts = materialise(_counted(rows).groupBy("word").agg(F.sum("n").alias("n")).withColumn("wid", F.monotonically_increasing_id()), "ctw-words")
    scored = counts.select("word", "n", F.lit(0.0).alias("score")) if across else materialise(shuffled(counts, word_scores(counts), "wid").select("word", "n", "score"), "ctw-scored")
    end = scored.where("word IS NULL").first()
    words = scored.where("word IS NOT NULL")
    total, distinct = counts.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    least = threshold(words, room)
    often = words.where(F.col("n") >= least).toArrow() if least else None
    shared = spark.sparkContext.broadcast(often)
    first = materialise(_scored(rows if across else rows.withColumn("rid", F.monotonically_increasing_id()), shared, end), "ctw-rows")
    rest = words.where(F.col("n") < least) if least else words
    found = shuffled(first.select("rid", F.explode("rest").alias("word")), rest, "word").groupBy("rid").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("more_known"), F.sum("score").alias("more_score")
    )
    if across:
        found = found.withColumn("more_score", F.lit(0.0))
        first = shuffled(first.drop("score"), text_scores(rows, room), "rid")
    each = math.log10(total + distinct + 1)
    whole = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return shuffled(first, found, "rid", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        whole.alias("score"), (-whole / F.col("n_bytes") * math.log2(10)).alias("bits_per_byte"),
    )


class Known(dict):
    """Numbers of words, -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _scored(rows: DataFrame, shared, end) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, at = shared.value, Known()
        logs = scores = np.zeros(1)  # at the end, what other words have
        if often is not None:
            at = Known((w.encode(), i) for i, w in enumerate(often["word"].to_pylist()))
            logs, scores = np.append(np.log10(often["n"].to_numpy() + 1.0), 0.0), np.append(often["score"].to_numpy(), 0.0)
        for batch in chunks(batches, limit=2 << 20):
            each = [low(t).split() for t in batch.column("text").to_pylist()]
            sizes = np.array([len(words) for words in each])
            c = np.fromiter(map(at.__getitem__, chain.from_iterable(each)), np.int64, int(sizes.sum()))
            of = np.repeat(np.arange(len(each)), sizes)
            sums = math.log10(end["n"] + 1) + np.bincount(of, weights=logs[c], minlength=len(each))
            score = end["score"] + (np.bincount(of, weights=scores[c], minlength=len(each)) if scores.any() else np.zeros(len(each)))
            others = np.flatnonzero(c < 0)
            rest: list[list[str]] = [[] for _ in each]
            starts = np.cumsum(sizes) - sizes
            for i, place in zip(of[others].tolist(), (others - starts[of[others]]).tolist()):
                rest[i].append(each[i][place].decode())
            n_known = sizes - np.bincount(of[others], minlength=len(each)) + (end["n"] > 0)
            n_bytes = [len(b" ".join(words)) + 2 if words else 1 for words in each]
            columns = [batch.column("id"), batch.column("held_out"), batch.column("rid")]
            columns += [pa.array(x, k) for x, k in ((sizes + 1, pa.int64()), (n_known, pa.int64()), (sums, pa.float64()), (rest, pa.list_(pa.string())), (score, pa.float64()), (n_bytes, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "rid", "n_tokens", "n_known", "logs", "rest", "score", "n_bytes"])

    more = "n_tokens long, n_known long, logs double, rest array<string>, score double, n_bytes long"
    return rows.mapInArrow(run, T.StructType([*rows.select("id", "held_out", "rid").schema.fields, *T._parse_datatype_string(more).fields]))

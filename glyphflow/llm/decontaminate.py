"""Benchmark decontamination: word windows of the test items against every document.

Windows of 10 consecutive item words (or the whole of a shorter item) become sequences of word numbers,
known by a 64-bit polynomial hash; a document's words become numbers through the items' vocabulary,
so that only runs of known words are hashed, looked up by binary search and compared number by number.

The items' windows are arrays: for each distinct window its hash, a place where it stands in the items' numbers, and its owners.
They are broadcast in blocks of at most ``BLOCK_BYTES`` of item text, measured first; with more than one
block the documents pass once per block, through a table in the shared folder, and keep their hits.

Defined results: a null or wordless text has no hits; texts and items may have any length; items without words or without id are left out; items that share
an id count once; extra columns pass through, one named like a result is replaced; equal rows get equal results; empty tables give empty or hitless results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import chunks, materialise, own, packed

WINDOW = 10
RESULTS = ("n_words", "hit_words", "hit_items")
BLOCK_BYTES = 16 << 20

#: Bytes of words stay, A-Z become a-z, all else separates.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Windows:
    """The windows of a block of items, by length: sorted hashes, a place of each in the items' numbers, and its owners."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number, self.items, lengths, parts = self.vocabulary.setdefault, [], [], []
        for item, text in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append(item)
                lengths.append(len(ids))
                parts.append(np.array(ids, dtype=np.int32))
        self.numbers = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        lengths = np.array(lengths, dtype=np.int64)
        begins, sizes = np.cumsum(lengths) - lengths, np.minimum(lengths, window)
        self.by_size: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]] = []
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            n = lengths[which] - size + 1
            starts = (np.repeat(begins[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())).astype(np.int32)
            self.by_size.append((size, *self.indexed(starts, np.repeat(which, n).astype(np.int32), size)))

    def indexed(self, starts: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """Distinct windows: hashes in order, a place of each, where its owners begin, all owners, and the base of the hash."""
        base = 0x9E3779B97F4A7C15
        while True:  # another base until different windows have different hashes
            h = self.hashed(self.numbers, starts, size, np.uint64(base))
            order = np.lexsort((owner, h))
            h, at = h[order], starts[order]
            same = h[1:] == h[:-1]
            for k in range(size):
                if (self.numbers[at[1:][same] + k] != self.numbers[at[:-1][same] + k]).any():
                    break
            else:
                break
            base += 2
        owner = owner[order]
        fresh = np.concatenate([[True], ~same])
        single = fresh | np.concatenate([[True], owner[1:] != owner[:-1]])  # a window's owner counts once
        first = np.flatnonzero(fresh)
        begin = np.concatenate([[0], np.cumsum(single)])[np.append(first, len(h))]
        return h[first], at[first], begin.astype(np.int32), owner[single], np.uint64(base)

    @staticmethod
    def hashed(numbers: np.ndarray, starts: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
        h = np.zeros(len(starts), dtype=np.uint64)
        for k in range(size):
            h = h * base + numbers[starts + k].astype(np.uint64)
        return h ^ (h >> np.uint64(29))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[list[str]]]]:
        """For each window length: (length, starts, owners of each hit)."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, sorted_h, places, begin, owner, base in self.by_size:
            if len(ids) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            h = self.hashed(ids, starts, size, base)
            at = np.minimum(np.searchsorted(sorted_h, h), len(sorted_h) - 1)
            same = sorted_h[at] == h
            starts, at = starts[same], at[same]
            real = np.ones(len(starts), dtype=bool)
            for k in range(size):  # number by number
                real &= ids[starts + k] == self.numbers[places[at] + k]
            starts, at = starts[real], at[real]
            named = {w: [self.items[i] for i in owner[begin[w] : begin[w + 1]].tolist()] for w in np.unique(at).tolist()}
            if len(starts):
                yield size, starts, [named[w] for w in at.tolist()]


def find(texts: list[str | None], windows: Windows, before: list[list[int] | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """For each text: number of words, places of words in a hit (those of ``before`` too), ids of items hit."""
    get, numbers, bounds = windows.vocabulary.get, [], [0]
    for t in texts:
        numbers.extend(map(get, words(t), repeat(0)))
        numbers.append(0)  # nothing crosses from a text to the next
        bounds.append(len(numbers))
    ids, edges = np.array(numbers, dtype=np.int32), np.array(bounds)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for size, starts, owners in windows.hits(ids):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + size, -1)
        for doc, own_ids in zip((np.searchsorted(edges, starts, "right") - 1).tolist(), owners):
            items[doc].update(own_ids)
    hit = np.flatnonzero(np.cumsum(change[:-1]))
    cut = np.searchsorted(hit, edges)
    places = [(hit[a:b] - e).tolist() for a, b, e in zip(cut[:-1], cut[1:], edges)]
    places = [sorted({*p, *b}) if b else p for p, b in zip(places, before)]
    return (np.diff(edges) - 1).tolist(), places, [sorted(x) for x in items]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most about ``limit`` bytes, one block on the driver at a time."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item"], r["text"]) for r in part.collect()]


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, hit_words (places of hit words, from 0) and hit_items (ids, sorted as strings)."""
    rows, names = packed(docs, text_col, RESULTS)
    return _scanned(rows, benchmark, item_col, item_text_col, window, block_bytes).select(*own(names, text_col), *RESULTS)


def _scanned(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_row, _text) with the results."""
    spark = rows.sparkSession
    out = rows.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")})
    schema = T.StructType(out.schema.fields)
    first = True
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(vars(Windows(items, window)))
        if not first:
            out = materialise(out, "decontaminate")
        first = False
        out = out.mapInArrow(_scanner(shared), schema)
    return out


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows.__new__(Windows)
        windows.__dict__ = shared.value
        for batch in chunks(batches, "_text"):
            n, places, items = find(batch.column("_text").to_pylist(), windows, batch.column("hit_words").to_pylist())
            items = [sorted({*a, *b}) if b else a for a, b in zip(items, batch.column("hit_items").to_pylist())]
            columns = [batch.column("_row"), batch.column("_text"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_text", *RESULTS])

    return run


def sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def remove_spans(text: str, hit: list[int]) -> str:
    """``text`` without the words at these places; what stands between two removed words goes too."""
    gone, out, last = set(hit), [], 0
    data = text.encode()
    low, place, i, n = data.translate(TABLE), 0, 0, len(data)
    cut_from = None
    while i < n:
        if low[i] == 32:
            i += 1
            continue
        j = low.find(b" ", i)
        j = n if j < 0 else j
        if place in gone:
            if cut_from is None:
                cut_from = i
                out.append(data[last:i])
            last = j
        else:
            cut_from = None
        place, i = place + 1, j
    out.append(data[last:])
    return b"".join(out).decode()


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", how: str = "documents", **options) -> DataFrame:
    """The documents without hits (``documents``), or all documents without their hit words (``spans``); the columns of ``docs`` in both."""
    rows, names = packed(docs, text_col)
    found = _scanned(rows, benchmark, **options)
    if how == "documents":
        return found.where(F.size("hit_words") == 0).select(*own(names, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [remove_spans(t, hit) if hit else t for t, hit in zip(batch.column("_text").to_pylist(), batch.column("hit_words").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "_text"])

    return found.select("_row", "_text", "hit_words").mapInArrow(run, rows.schema).select(*own(names, text_col))

"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has four segments of 16 bits in a ring. If two fingerprints differ in at most 3 bits, a segment exists from which every
chain of l segments differs in at most 3*l/4 bits: 0, then 1, then 2, then 3. The budgets of a chain give join keys:

* two segments: the first itself and one half of the next (of two halves that differ in one bit at most, one is equal): 24 bits, eight keys a fingerprint;
* three segments, for members of keys of more than ``BUCKET`` fingerprints only: the 24 bits that the first key leaves of the three differ in two at most, so of their
  four blocks of 6 bits two are equal: 36 bits, six keys for each crowded key.

The whole chain is checked on each candidate, then the full Hamming distance. Only distinct fingerprints are compared. What shares even 36 bits with more than ``BUCKET``
others, a cluster of near copies, goes the exact other way, ``dense``: two fingerprints are within 3 bits if and only if some word is within 1 bit of the one and
2 of the other, so each meets its neighbours at such words, a number of rows fixed per fingerprint, and each meeting is a star.

All joins go by shuffle, none of their sides is broadcast. The sizes of keys are written before they are joined, so that the engine can split a crowded key.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text's shingles are hashed in pieces, whatever its length; repeated rows share
a fingerprint; ids may be null (a group's id is its least non-null id, or null); of equal ids ``keep`` keeps the row stored first; ``keep`` gives back all columns, whatever
their names, ``groups`` its own only; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.common import chunks, materialise, shuffled
from glyphflow.operators.graph import components

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 3, 4
#: Members of a join key that are compared pair by pair; larger keys are made longer, then go by ``dense``.
BUCKET = 64
#: Bytes of text that a worker holds in pieces at once.
HELD = 4 << 20
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    total = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, PIECE):
        part = words[a : a + PIECE + size - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(size)])) if len(words) >= size else [b" ".join(words)]
        h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``fp`` (the fingerprint's bits as a signed long)."""
    rest = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, HELD):
            fp = np.array([fingerprint(t) for t in batch.column(text_col).to_pylist()], dtype=np.uint64).view(np.int64)
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fp)], names=[*rest, "fp"])

    schema = df.select(*rest, F.lit(0).cast("long").alias("fp")).schema
    return df.mapInArrow(run, schema)


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _field(value, low: int, bits: int):
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1))


def keyed(nodes: DataFrame) -> DataFrame:
    """(k, start, fp): eight rows per fingerprint, by start segment and half of the next."""
    keys = []
    for i in range(SEGMENTS):
        for half in (0, 1):
            nxt = _field(_segment(F.col("fp"), i + 1), 8 * half, 8)
            k = F.shiftleft(_segment(F.col("fp"), i), 8).bitwiseOR(nxt).bitwiseOR(F.lit((i * 2 + half) << 24).cast("long"))
            keys.append(F.struct(k.alias("k"), F.lit(i).alias("start")))
    return nodes.select("fp", F.inline(F.array(*keys)))


def longer(crowded: DataFrame) -> DataFrame:
    """(k, start, fp): six rows for each row of crowded two-segment keys, by pairs of equal blocks in what the key leaves of three segments."""
    other = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        for half in (0, 1):  # the half that the key leaves out, and the third segment
            left = F.shiftleft(_segment(F.col("fp"), i + 2), 8).bitwiseOR(_field(_segment(F.col("fp"), i + 1), 8 * (1 - half), 8))
            other = F.when(F.shiftright("k", 24) == i * 2 + half, left).otherwise(other)
    keys = []
    for n, (x, y) in enumerate(combinations(range(4), 2)):
        blocks = F.shiftleft(_field(F.col("other"), 6 * x, 6), 6).bitwiseOR(_field(F.col("other"), 6 * y, 6))
        keys.append(F.shiftleft("k", 15).bitwiseOR(F.lit(n << 12).cast("long")).bitwiseOR(blocks))
    return crowded.select("k", "start", "fp", other.alias("other")).select("start", "fp", F.explode(F.array(*keys)).alias("k"))


def chain(a, b, start: int):
    """The budgets along the ring from this segment: the sum over l segments is at most l * RADIUS / SEGMENTS."""
    diff, so_far, ok = a.bitwiseXOR(b), F.lit(0), F.lit(True)
    for length in range(1, SEGMENTS + 1):
        so_far = so_far + F.bit_count(_segment(diff, start + length - 1))
        ok = ok & (so_far <= length * RADIUS // SEGMENTS)
    return ok


def dense(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect exactly what lies within 3 bits among these fingerprints, without pairs: 2,081 rows a fingerprint."""
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(1 << b for b in c) for r in range(RADIUS) for c in combinations(range(64), r))]
    at = F.transform(F.lit(signed), lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("z"), (F.bit_count(m) <= 1).alias("near")))
    met = nodes.select("fp", F.inline(at))
    stars = met.groupBy("z").agg(F.min("fp").alias("hub"), F.max("near").alias("near"), F.count(F.lit(1)).alias("n"))
    met = shuffled(met, stars.where("near AND n > 1").select("z", "hub"), "z")
    return met.select(F.col("fp").alias("u"), F.col("hub").alias("v")).where("u != v").distinct()


def sized(keys: DataFrame, bucket: int) -> DataFrame:
    """The rows of keys that several fingerprints share, with whether the key is crowded."""
    sizes = materialise(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", (F.col("n") > bucket).alias("crowded")), "simhash-sizes")
    return materialise(shuffled(keys, sizes, "k"), "simhash-keys")


def compared(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of fingerprints that share one of these keys and are within RADIUS bits."""
    pairs = shuffled(rows.select("k", "start", F.col("fp").alias("u")), rows.select("k", F.col("fp").alias("v")), "k").where("u < v")
    within = F.lit(False)
    for i in range(SEGMENTS):
        within = within | ((F.col("start") == i) & chain(F.col("u"), F.col("v"), i))
    return pairs.where(within).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) over distinct fingerprints whose components are those of the relation "at most 3 bits apart"."""
    two = sized(keyed(nodes), bucket)
    three = sized(longer(two.where("crowded")), bucket)
    still = materialise(three.where("crowded").select("fp").distinct(), "simhash-crowded")
    return compared(two.where("NOT crowded")).unionByName(compared(three.where("NOT crowded"))).unionByName(dense(still))


def _rooted(df: DataFrame, bucket: int, *also: str) -> tuple[DataFrame, DataFrame]:
    """(id, *also, fp) for each row of (id, *also, text); and (fp, root, first) for each fingerprint, first being its least row, rows without id last."""
    rows = materialise(fingerprints(df), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *also)).alias("first")
    nodes = materialise(rows.groupBy("fp").agg(first), "simhash-nodes")
    found = components(links(nodes.select("fp"), bucket))
    return rows, materialise(shuffled(nodes, found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``df``: id, fp, root (the component's least fingerprint), component_id."""
    rows, rooted = _rooted(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), bucket)
    least = materialise(rooted.groupBy("root").agg(F.min("first").getField("id").alias("component_id")), "simhash-least")
    named = shuffled(rooted.select("fp", "root"), least, "root")
    return shuffled(rows, named, "fp").select("id", "fp", "root", "component_id")


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row of each group, the one with the least id (of equal ids the one stored first), with the columns of ``df``.

    Rows are known by file and place in it. A frame that isn't a stored table is written first. Only what is dropped meets the texts again."""
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        df = materialise(df, "simhash-docs")
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at")
    rows, rooted = _rooted(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), at), bucket, "_at")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._at")
    dropped = materialise(shuffled(rows.select("_at"), kept, "_at", "left_anti"), "simhash-dropped")
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), at)
    return placed.join(dropped, "_at", "left_anti").select("_row.*")

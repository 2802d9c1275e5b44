"""Consistent-hash ring with virtual nodes and bounded loads, in built-in expressions only.

The ring has ``CELLS`` cells; a virtual node owns the cells up to the next node. Keys enter
in ring order; a key whose shard is full goes on clockwise to the next shard with room.
Capacities are floor or ceil of rows/shards, so counts are at most one apart (law ``rows``).

Only counts per cell (a fixed number of them) reach the driver, which walks the ring once and
returns, for each cell, rank intervals with a shard and a first slot. Rows find their interval by
their rank within their cell, in the order of key, checksum and size. In a cell that a key has filled, rows equal
in these three are counted in ``SALTS`` parts; the parts' counts, summed in that order, give each part its first
rank, so that no task holds a hot key and which keys go where doesn't depend on the layout.

Defined results: a null text has size 1 and checksum 0; texts have any length; null keys share one ring position;
rows with equal keys are ordered by checksum and size, and equal rows among each other
arbitrarily; the result has its own columns only, so extra ones can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphflow.llm.common import materialise

CELLS = 1 << 16
VNODES = 128
SALTS = 256
#: A cell with more rows than this and than 8 times the mean is ranked by parts.
HOT_ROWS = 1_000


def ring(shards: int, vnodes: int = VNODES) -> list[int]:
    """Owner of each cell. A node takes the cell its digest names, or the next free one."""
    at: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(shards):
            cell = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:2], "big")
            while cell in at:
                cell = (cell + 1) % CELLS
            at[cell] = s
    owner = at[min(at)]  # clockwise: a key belongs to the first node at or after its cell
    out = [0] * CELLS
    for cell in range(CELLS - 1, -1, -1):
        owner = at.get(cell, owner)
        out[cell] = owner
    return out


def clockwise(shards: int, vnodes: int = VNODES) -> list[tuple[int, ...]]:
    """For each cell the distinct shards in the order in which a key meets them."""
    own = ring(shards, vnodes)
    order = list(dict.fromkeys(own))
    out: list[tuple[int, ...]] = [()] * CELLS
    now = tuple(order)
    for cell in range(CELLS - 1, -1, -1):
        if now[0] != own[cell]:
            now = (own[cell], *[s for s in now if s != own[cell]])
        out[cell] = now
    return out


def fill(counts: dict[int, int], shards: int, vnodes: int = VNODES) -> list[list[tuple[int, int, int]]]:
    """For each cell the intervals (last rank, shard, slot of rank 0 if it were in this interval)."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    plan: list[list[tuple[int, int, int]]] = [[] for _ in range(CELLS)]
    routes = clockwise(shards, vnodes)
    for cell in sorted(counts):
        done, left = 0, counts[cell]
        for s in routes[cell]:
            take = min(left, room[s] - used[s])
            if take > 0:
                plan[cell].append((done + take, s, used[s] - done - 1))
                used[s] += take
                done += take
                left -= take
            if not left:
                break
    return plan


def assign(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", shards: int = 8, vnodes: int = VNODES) -> DataFrame:
    """One row for each row of ``df``: key, size, text_crc32, home shard, shard, slot."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    hashed = F.xxhash64(F.col(f"`{key_col}`"))
    keyed = materialise(
        df.select(
            F.col(f"`{key_col}`").alias("key"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            hashed.alias("at"),
            F.shiftrightunsigned(hashed, 48).cast("int").alias("cell"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "ring",
    )
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS rows
    plan = fill(counts, shards, vnodes)
    limit = max(HOT_ROWS, 8 * sum(counts.values()) // CELLS)
    hot = [c for c, n in counts.items() if n > limit]  # fewer than CELLS / 8
    same = ["at", "key", "text_crc32", "size"]
    ranked = keyed.where(~F.col("cell").isin(hot)).withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy(*same)).cast("long"))
    if hot:
        filled = keyed.where(F.col("cell").isin(hot))
        parts = filled.groupBy("cell", *same, "salt").agg(F.count(F.lit(1)).alias("n"))
        before = W.partitionBy("cell").orderBy(*same, "salt").rowsBetween(W.unboundedPreceding, -1)
        parts = materialise(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "ring-parts")
        filled = filled.withColumn("nth", F.row_number().over(W.partitionBy("cell", *same, "salt").orderBy(F.lit(0))))
        b = parts.select(*[F.col(c).alias(f"p_{c}") for c in parts.columns]).hint("merge")
        match = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("cell", *same, "salt")]
        found = filled.join(b, match)
        ranked = ranked.unionByName(found.select(*keyed.columns, (F.col("p_base") + F.col("nth")).cast("long").alias("rank")))
    literal = F.from_json(
        F.lit(json.dumps([[{"hi": h, "s": s, "b": b} for h, s, b in x] for x in plan])),
        "array<array<struct<hi:bigint,s:int,b:bigint>>>",
    )
    homes = F.from_json(F.lit(json.dumps(ring(shards, vnodes))), "array<int>")
    found = ranked.withColumn("_to", F.get(F.filter(F.get(literal, F.col("cell")), lambda x: F.col("rank") <= x["hi"]), F.lit(0)))
    return found.select(
        "key", "size", "text_crc32",
        F.get(homes, F.col("cell")).alias("home_shard"),
        F.col("_to.s").alias("shard"),
        (F.col("_to.b") + F.col("rank")).alias("slot"),
    )

"""Neural stages with pluggable weights: character seq2seq, gap segmenter, clear-script encoder. Weights travel once per job as a broadcast; workers batch their rows."""

from __future__ import annotations

import io
import json
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npz(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Arrays of a weights file in any store that Spark reads."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return {k: v.astype(np.float32) if v.dtype.kind == "f" else v for k, v in np.load(io.BytesIO(bytes(data)), allow_pickle=False).items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(x: np.ndarray, w: dict[str, np.ndarray], name: str, back: bool = False) -> np.ndarray:
    """A GRU layer over (time, features); gates in the order reset, update, new."""
    wi, wh, bi, bh = (w[f"{name}.{k}"] for k in ("w_ih", "w_hh", "b_ih", "b_hh"))
    inputs, size = x @ wi.T + bi, wh.shape[1]  # all steps at once
    h, out = np.zeros(size, dtype=np.float32), np.zeros((len(x), size), dtype=np.float32)
    for i in range(len(x) - 1, -1, -1) if back else range(len(x)):
        h = cell(inputs[i], h, wh, bh)
        out[i] = h
    return out


def cell(inputs: np.ndarray, h: np.ndarray, wh: np.ndarray, bh: np.ndarray) -> np.ndarray:
    n = len(h)
    rec = wh @ h + bh
    r, z = _sigmoid(inputs[:n] + rec[:n]), _sigmoid(inputs[n : 2 * n] + rec[n : 2 * n])
    return (1 - z) * np.tanh(inputs[2 * n :] + r * rec[2 * n :]) + z * h


class Seq2Seq:
    """Bidirectional GRU encoder, additive attention, greedy decoder. Vocabularies map letters to numbers; 0 pads, 1 starts, 2 ends, 3 is unknown."""

    def __init__(self, w: dict[str, np.ndarray], source: dict[str, int], target: dict[str, int], longest: int = 48):
        self.w, self.source, self.target, self.longest = w, source, {v: k for k, v in target.items()}, longest

    def decode(self, word: str) -> str:
        w = self.w
        ids = [self.source.get(c, 3) for c in unicodedata.normalize("NFC", word)] + [2]
        x = w["src_emb"][ids]
        enc = np.concatenate([gru(x, w, "fwd"), gru(x, w, "bwd", True)], axis=1)
        keys = enc @ w["attn.enc"].T  # projected once
        h = np.tanh(w["bridge.w"] @ np.concatenate([enc[-1, : enc.shape[1] // 2], enc[0, enc.shape[1] // 2 :]]) + w["bridge.b"])
        last, out = 1, []
        for _ in range(self.longest):
            energy = np.tanh(keys + w["attn.dec"] @ h) @ w["attn.v"]
            a = np.exp(energy - energy.max())
            context = (a / a.sum()) @ enc
            h = cell(w["dec.w_ih"] @ np.concatenate([w["tgt_emb"][last], context]) + w["dec.b_ih"], h, w["dec.w_hh"], w["dec.b_hh"])
            last = int(np.argmax(w["out.w"] @ np.concatenate([h, context]) + w["out.b"]))
            if last == 2:
                break
            if last > 3:
                out.append(self.target.get(last, ""))
        return unicodedata.normalize("NFC", "".join(out))


class Segmenter:
    """Two bidirectional GRU layers and a logistic unit: which spaces part groups of words."""

    def __init__(self, w: dict[str, np.ndarray], letters: dict[str, int], threshold: float = 0.5):
        self.w, self.letters, self.threshold = w, letters, threshold

    def groups(self, text: str) -> list[list[str]]:
        if not text:
            return []
        x = self.w["emb"][[self.letters.get(c, 0) for c in text]]
        for layer in (0, 1):
            x = np.concatenate([gru(x, self.w, f"l{layer}.fwd"), gru(x, self.w, f"l{layer}.bwd", True)], axis=1)
        cut = _sigmoid(x @ self.w["out.w"] + self.w["out.b"]) > self.threshold
        out, place = [[]], 0
        for word in text.split(" "):
            out[-1].append(word)
            place += len(word)
            if place < len(text) and cut[place]:
                out.append([])
            place += 1
        return [g for g in out if g]


def map_distinct(df: DataFrame, column: str, out: str, kind: str, f) -> DataFrame:
    """``f`` (list of strings to list of results) applied to the distinct values of a column and joined back: the costly call sees each value once."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(f(values.tolist()))

    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(distinct.withColumn(out, run(F.col(column))), column, "left")


def transliterate(words: DataFrame, dictionary: DataFrame, model: Seq2Seq | None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(word, translit, source): dictionary, else a compound of dictionary words, else the model (or the word itself without one). Only misses reach the model."""
    distinct = words.select("word").distinct()
    hit = distinct.join(dictionary, "word").select("word", "translit", F.lit("dict").alias("source"))
    miss = distinct.join(dictionary, "word", "left_anti")
    parts = miss.where(F.col("word").contains("-")).select("word", F.posexplode(F.split("word", "-")).alias("pos", "part"))
    looked = parts.join(dictionary.select(F.col("word").alias("part"), "translit"), "part", "left")
    good = ~F.col("part").isin(*suffixes) if suffixes else F.lit(True)
    whole = looked.groupBy("word").agg(F.bool_and(F.col("translit").isNotNull() & good).alias("all"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "translit"))), lambda x: x["translit"]), " ").alias("translit"))
    split = whole.where("all").select("word", "translit", F.lit("split").alias("source"))
    rest = miss.join(split, "word", "left_anti")
    if model is None:
        told = rest.select("word", F.col("word").alias("translit"), F.lit("model").alias("source"))
    else:
        shared = words.sparkSession.sparkContext.broadcast(vars(model))

        def decode(values: list[str]) -> list[str]:
            own = Seq2Seq.__new__(Seq2Seq)
            own.__dict__ = shared.value
            return [own.decode(v) for v in values]

        told = map_distinct(rest, "word", "translit", "string", decode).select("word", "translit", F.lit("model").alias("source"))
    return hit.unionByName(split).unionByName(told)


def clear_script(word: str, rules: dict[str, dict[str, dict[str, int]]], rate: dict[str, float]) -> str:
    """Best record of a word over spans of one or two letters. ``rules``: level (tri, prev, next, pos, uni) -> context key -> written form -> count.

    Each span takes the most frequent form of the first level that has seen its context often enough (three times; once for uni); a span scores the log of its rate and of the form's share."""
    n = len(word)

    def form(a: int, b: int) -> tuple[str, float] | None:
        unit, before, after = word[a:b], word[a - 1 : a] or "^", word[b : b + 1] or "$"
        place = "I" if a == 0 and b < n else "S" if a == 0 else "F" if b == n else "M"
        for level, key, least in (("tri", f"{before}{unit}{after}", 3), ("prev", f"{before}{unit}", 3), ("next", f"{unit}{after}", 3), ("pos", f"{unit}{place}", 3), ("uni", unit, 1)):
            seen = rules.get(level, {}).get(key)
            if seen and sum(seen.values()) >= least:
                best = min(seen, key=lambda x: (-seen[x], x))
                return best, math.log(rate.get(unit, 1e-3) + 1e-9) + math.log(seen[best] / sum(seen.values()))
        return None

    best: list[tuple[float, str] | None] = [(0.0, "")] + [None] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - 2), end):
            if best[start] is not None and word[start:end] in rules.get("uni", {}):
                found = form(start, end)
                if found and (best[end] is None or best[start][0] + found[1] > best[end][0]):
                    best[end] = (best[start][0] + found[1], best[start][1] + found[0])
    return best[n][1] if best[n] else word


def to_cyrillic(text: str, segmenter: Segmenter, model: Seq2Seq, most: int = 2, longest: int = 60) -> str:
    """Transliteration to Cyrillic, line by line: gaps that part groups, windows of at most ``most`` groups, the model on each, tidied punctuation."""
    import re

    def line(x: str) -> str:
        x = re.sub(r"[\s\u202f-]+", " ", unicodedata.normalize("NFC", x).lower()).strip()
        groups = [" ".join(g) for g in segmenter.groups(x)]
        out: list[list[str]] = []
        for g in groups:
            if out and len(out[-1]) < most and len(" ".join([*out[-1], g])) <= longest:
                out[-1].append(g)
            else:
                out.append([g])
        said = re.sub(r"\s+([,.!?])", r"\1", " ".join(model.decode(" ".join(w)) for w in out))
        return re.sub(r"(^|[.!?]\s*)(\w)", lambda m: m[1] + m[2].upper(), said)

    return "\n".join(map(line, text.split("\n")))


def clear_script_text(df: DataFrame, column: str, out: str, rules: dict, rate: dict[str, float], marks: dict[str, str]) -> DataFrame:
    """A column in the alternative script's record: words by ``clear_script``, each distinct one once per worker; marks mapped, other signs dropped."""
    import re
    from functools import lru_cache

    shared = df.sparkSession.sparkContext.broadcast((rules, rate))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        word = lru_cache(100_000)(lambda w: clear_script(w, *shared.value))
        for texts in batches:
            yield texts.map(lambda t: None if t is None else "".join(word(w) if w else marks.get(m, "") for w, m in re.findall(r"([^\W\d_]+)|(.)", t.lower(), re.S)))

    return df.withColumn(out, run(F.col(column)))

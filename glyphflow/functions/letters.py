"""Words typed without their special letters: keys, costs, candidates' verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow import tables as t


def skeleton(word: Column, source: str = t.SKELETON_FROM, target: str = t.SKELETON_TO) -> Column:
    """Equal for a word and for whatever it is typed as."""
    return F.translate(word, source, target)


def query_keys(word: Column) -> Column:
    """Skeletons under which a typed word may be found: with дж as ж, нг as н, both, or neither."""
    g = F.replace(word, F.lit("дж"), F.lit("ж"))
    n = lambda w: F.replace(w, F.lit("нг"), F.lit("н"))
    return F.array_distinct(F.transform(F.array(word, g, n(word), n(g)), lambda w: skeleton(w)))


def vowel_row(word: Column, back: str = "аоуыяюё", front: str = "әөүеэ") -> Column:
    """b, f, m (both) or n (neither)."""
    b, f = word.rlike(f"[{back}]"), word.rlike(f"[{front}]")
    return F.when(b & f, "m").when(b, "b").when(f, "f").otherwise("n")


def degrade(word: Column, style: str) -> Column:
    """The word as it is typed in a style: after a vowel or at the start some replacements differ."""
    vowels = "аеёиоуыэюяәөүі"
    styles = {
        "plain": (("ә", "а"), ("ө", "о"), ("ү", "у"), ("һ", "г"), ("җ", "ж"), ("ң", "н")),
        "soft": (("ә", "я"), ("ө", "ё"), ("ү", "ю"), ("һ", "г"), ("җ", "дж"), ("ң", "нг")),
        "hard": (("ә", "э"), ("ө", "о"), ("ү", "у"), ("һ", "х"), ("җ", "дж"), ("ң", "нг")),
        "bare": (("ә", "е"), ("ө", "э"), ("ү", "у"), ("һ", ""), ("җ", "ж"), ("ң", "н")),
    }
    out = word
    for letter, typed in styles[style]:
        if typed in "яёю" and typed:  # soft vowels only after consonants
            hard = {"я": "а", "ё": "о", "ю": "у"}[typed]
            out = F.regexp_replace(out, f"(?<![{vowels}])(?<!^){letter}", typed)
            out = F.replace(out, F.lit(letter), F.lit(hard))
        else:
            out = F.replace(out, F.lit(letter), F.lit(typed))
    return out


def degrade_latin(word: Column, style: int) -> Column:
    """Latin letters without their signs: the style's choice, or the last there is."""
    for letter, typed in t.LATIN_SUBSTITUTIONS.items():
        word = F.replace(word, F.lit(letter), F.lit(typed[min(style, len(typed) - 1)]))
    return word


def typed_as(word: Column, substitutions=None) -> Column:
    """A pattern that matches whatever the word may be typed as."""
    subs = substitutions if substitutions is not None else {a: tuple(b) for a, b in t.SUBSTITUTIONS.items()}
    table = F.create_map(*[F.lit(x) for a, b in subs.items() for x in (a, "(?:" + "|".join((a, *b)) + ")")])
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""), F.lit("$"))


def plainer(typed: Column, word: Column, skeleton: Column) -> Column:
    """Whether ``typed`` is the word with some of its letters as in the skeleton, which both share letter for letter."""
    each = F.arrays_zip(F.split(typed, "").alias("t"), F.split(word, "").alias("w"), F.split(skeleton, "").alias("k"))
    return F.forall(each, lambda x: (x["t"] == x["w"]) | (x["t"] == x["k"]))


def channel(right: str, typed: str) -> tuple[float, list[tuple[str, str]]] | None:
    """The cheapest way to type ``typed`` for ``right``, with its substitutions, or None."""
    best: dict[int, tuple[float, list[tuple[str, str]]]] = {0: (0.0, [])}
    for letter in right:
        new: dict[int, tuple[float, list[tuple[str, str]]]] = {}
        for at, (cost, subs) in best.items():
            moves = [(at + 1, cost, subs)] if typed[at : at + 1] == letter else []
            moves += [(at + len(x), cost + c, [*subs, (letter, x)]) for x, c in t.SUBSTITUTIONS.get(letter, {}).items() if typed.startswith(x, at)]
            for to, c, s in moves:
                if to not in new or c < new[to][0]:
                    new[to] = (c, s)
        best = new
    return best.get(len(typed))


CHANNEL_TYPE = T.StructType(
    [
        T.StructField("cost", T.DoubleType()),
        T.StructField("subs", T.ArrayType(T.StructType([T.StructField("letter", T.StringType()), T.StructField("typed", T.StringType())]))),
    ]
)


@F.pandas_udf(CHANNEL_TYPE)
def channel_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """``channel`` over pairs that share a skeleton."""
    remembered = lru_cache(100_000)(channel)
    for right, typed in batches:
        found = [remembered(a, b) if a is not None and b is not None else None for a, b in zip(right, typed)]
        yield pd.DataFrame(
            {
                "cost": [f[0] if f else None for f in found],
                "subs": [[{"letter": a, "typed": b} for a, b in f[1]] if f else None for f in found],
            }
        )


def spelling_distance(a: str, b: str, vowels: str = "aeiouöüāēīōūȫǖ") -> float:
    """Edit distance with indels 4, substitutions 5, vowel for vowel 1, over four times the longer length."""
    row = [4 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], 4 * i
        for j, y in enumerate(b, 1):
            change = 0 if x == y else 1 if x in vowels and y in vowels else 5
            last, row[j] = row[j], min(last + change, row[j] + 4, row[j - 1] + 4)
    return row[-1] / (4 * max(len(a), len(b), 1))


@F.pandas_udf(T.DoubleType())
def spelling_distance_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([spelling_distance(x, y) if x is not None and y is not None else None for x, y in zip(a, b)])


def related(a: Column, b: Column, most: float = 0.29) -> Column:
    """Whether two spellings have as many spaces and are at most ``most`` apart."""
    spaces = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))
    return (spaces(a) == spaces(b)) & (spelling_distance_udf(a, b) <= most)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, which has no built-in function."""
    return text.str.normalize("NFC")

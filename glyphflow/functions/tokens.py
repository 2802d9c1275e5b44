"""Tokenizers and token predicates as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow import tables as t
from glyphflow.functions.scripts import let

#: Words of a script; hyphenated compounds stay whole.
CYRILLIC_WORD = f"[{t.CYRILLIC}]+(?:-[{t.CYRILLIC}]+)*"
LATIN_WORD = r"\p{IsLatin}+(?:-\p{IsLatin}+)*"
ANY_TOKEN = r"[\p{L}\p{N}_'-]+"
#: Spellings that a word outside the lexicon shows only when typed without special letters.
CONSONANTS = "бвгджзйклмнпрстфхцчшщһҗң"
HARD = f"ё|яя|юю|^й[ау]|(?<=[^-э])э|[{CONSONANTS}][яю]"
NEVER = "ё|яя|юю|(?<=[^-э])э"


def words(col: Column, pattern: str = LATIN_WORD) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def rebuild(col: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """The text with ``f`` applied to each match; what stands between stays. U+0001 must not occur."""
    parts = F.split(F.regexp_replace(col, pattern, "\u0001$0\u0001"), "\u0001", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, f(p)).otherwise(p)), "")


def sentences(col: Column, least: int = 3) -> Column:
    """Stretches between stops and line breaks with at least so many words."""
    return F.filter(F.transform(F.split(col, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.size(F.split(s, r"\s+")) >= least)


def special_share(tokens: Column, letters: str) -> Column:
    """Share of tokens with one of the letters; null without tokens."""
    return F.try_divide(F.size(F.filter(tokens, lambda w: w.rlike(f"[{letters}]"))), F.size(tokens))


def length_bucket(n: Column) -> Column:
    return F.when(n < 8, n.cast("string")).when(n < 12, "8-11").otherwise("12+")


def foreign(token: Column) -> Column:
    """Cyrillic and something of another keyboard in one token."""
    return token.rlike(f"[{t.CYRILLIC}]") & token.rlike(f"[a-zA-Z{t.LOOKALIKE_FROM}]")


def normalize_lookalikes(col: Column) -> Column:
    """Letters of other keyboards become the ones they look like, inside tokens that mix scripts."""
    swap = lambda w: F.when(foreign(w), F.translate(w, t.LOOKALIKE_FROM + t.TWINS_FROM, t.LOOKALIKE_TO + t.TWINS_TO)).otherwise(w)
    return rebuild(col, ANY_TOKEN, swap)


def sentence_start(text: Column, pos: Column) -> Column:
    """Whether the last sign before this place (from 0), spaces and quotes aside, ends a sentence or is none."""
    before = F.regexp_replace(F.left(text, pos), "[\\s\"'«»„“”(]+$", "")
    return (before == "") | F.right(before, F.lit(1)).isin(".", "!", "?", "…", "\n")


def hyphen_parts_ok(word: Column, lexicon: Column, suffixes: Iterable[str]) -> Column:
    """Every part of a compound stands alone: in the lexicon, or longer than two letters and no suffix."""
    bad = F.array(*map(F.lit, suffixes))
    return F.forall(F.split(word, "-"), lambda p: F.array_contains(lexicon, p) | ((F.char_length(p) > 2) & ~F.array_contains(bad, p)))


def in_domain(value: Column, domain: Iterable[str], default: str) -> Column:
    return F.when(value.isin(*domain), value).otherwise(F.lit(default))


def is_language(col: Column, function_words: Iterable[str], finals: str, pattern: str) -> Column:
    """At least three tokens, and 12 % function words or 55 % of the longer tokens ending in one of these letters."""
    known = F.array(*map(F.lit, function_words))

    def shares(toks: Column) -> Column:
        func = F.size(F.filter(toks, lambda w: F.array_contains(known, w)))
        long = F.filter(toks, lambda w: F.char_length(w) >= 3)
        ends = F.size(F.filter(long, lambda w: F.right(w, F.lit(1)).rlike(f"[{finals}]")))
        return (F.size(toks) >= 3) & ((100 * func >= 12 * F.size(toks)) | (100 * ends >= 55 * F.greatest(F.size(long), F.lit(1))))

    return let(words(F.lower(col), pattern), shares)


def is_russian(col: Column) -> Column:
    return is_language(normalize_lookalikes(col), t.RUSSIAN_FUNCTION_WORDS, "аеёиоуыэюяй", CYRILLIC_WORD)


def ngrams(word: Column, sizes: Iterable[int] = (2, 3, 4)) -> Column:
    """Letter sequences of ^word$."""
    w = F.concat(F.lit("^"), word, F.lit("$"))
    return F.flatten(F.array(*[_grams(w, n) for n in sizes]))


def _grams(w: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(w) - (n - 1), F.lit(1)))
    return F.filter(F.transform(starts, lambda i: F.substr(w, i, F.lit(n))), lambda g: F.char_length(g) == n)

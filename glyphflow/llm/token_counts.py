"""Token counts under a vocabulary with word ends, by the whole-token shortcut.

Before any document is read, each vocabulary string that ends a word is encoded alone; those that come out as one token
are the proven whole tokens. A pre-token among them counts one; only the rest is merged, once per worker while its cache holds it.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; a text of any length is counted whole; the vocabulary's special strings count one token
each, as the library counts them by default, the longest first where several match; equal rows get equal counts; extra columns pass through, one named like a result is
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import chunks, own, packed

#: Unicode white space, which the vocabulary's pattern separates by.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")
ASCII_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
CACHE = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


LETTERS = byte_letters()


def lower(text: str) -> str:
    """Each character lower-cased by itself, without the rule for a final sigma."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


def pieces(text: str) -> list[str]:
    """Pre-tokens of a text without special strings."""
    if text.isascii():
        return ASCII_PIECES.findall(text.lower())
    return PIECES.findall(lower(unicodedata.normalize("NFC", text)))


class Counter(dict):
    """Pre-token -> number of tokens. Starts with the proven whole tokens; merged ones are kept while there is room."""

    def __init__(self, definition: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        from tokenizers import Tokenizer

        self.whole, self.merge = whole, Tokenizer.from_str(definition).model.tokenize
        special = [t["content"] for t in json.loads(definition).get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.signs = {t[0] for t in special}  # no special string without one of these

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode().decode("latin-1").translate(LETTERS)))
        if len(self) > CACHE + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not any(sign in text for sign in self.signs):
            return sum(map(self.__getitem__, pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, pieces(p))) for p in parts)


def proven(definition: str) -> frozenset[str]:
    """Pre-tokens that are whole tokens: a vocabulary string with the word end whose text is one pre-token and encodes as one token."""
    from tokenizers import Tokenizer

    model = json.loads(definition)["model"]
    end = model["end_of_word_suffix"] or ""
    merge, back = Tokenizer.from_str(definition).model.tokenize, {c: b for b, c in LETTERS.items()}
    out = set()
    for string in model["vocab"]:
        if end and not string.endswith(end):
            continue
        letters = string[: len(string) - len(end)]
        try:
            text = bytes(back[c] for c in letters).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and pieces(text) == [text] and len(merge(letters)) == 1:
            out.add(text)
    return frozenset(out)


def count(df: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit. ``vocabulary``: path of a tokenizer definition, read on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    shared = df.sparkSession.sparkContext.broadcast((definition, proven(definition)))  # as large as the vocabulary
    rows, names = packed(df, text_col, ("n_bytes", "n_tokens", "over_limit"))
    more = T._parse_datatype_string("n_bytes long, n_tokens long, over_limit boolean").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in chunks(batches, "_text"):
            n = [counter.count(t) if t else 0 for t in batch.column("_text").to_pylist()]
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column("_text")), 0).cast(pa.int64())
            columns = [*batch.columns, size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more])).select(*own(names, text_col), "n_bytes", "n_tokens", "over_limit")

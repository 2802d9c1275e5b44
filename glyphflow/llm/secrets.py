"""Secret scans by token efficiency.

Three exact patterns give the base spans, which always stay. The method adds strings that a byte-level vocabulary encodes badly: in runs of key characters, what no base span
covers, tested as a whole, by segments between signs, and by every stretch of tokens just ``LEAST`` long or longer. Those whose characters per token fall below ``RATIO`` (prose has
about four, random strings about two) are found, unless they are known digests by their length, identifiers such as UUIDs, or numbers.

Defined results: a null text counts as empty; a text of any length is scanned whole, in time proportional to it but for sorting; spans that start alike are ordered by kind as
listed; equal rows get equal results; extra columns pass through, one named secret_spans is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import Cover, chunks, own, packed

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Every match of ASSIGN holds one of these signs.
SIGN = re.compile(r"[:=]")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LEAST, RATIO = 20, 2.2
RUN = re.compile(f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
SEGMENT = re.compile(f"[A-Za-z0-9]{{{LEAST},}}")
SIGNS = "=-_/+"
#: Hexadecimal lengths of known digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
UUIDS = re.compile(rf"(?<![0-9a-fA-F]){UUID.pattern}(?![0-9a-fA-F])")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
#: Words and numbers joined by single signs, as in dates, file names and variables.
PART = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+(?:[TZ][0-9]*)?)"
NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?:[TZ][0-9]*)?(?![A-Za-z0-9])")
IDENTIFIER = re.compile(f"{PART}(?:[_/=+-]+{PART})*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if SIGN.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[1], BASE.index(x[0])))
    return out


def outside(a: int, b: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What spans, by start, leave of a stretch, where that is long enough."""
    for x, y in [*spans, (b, b)]:
        if x - a >= LEAST and x <= b:
            yield a, x
        a = max(a, y)


def known(s: str) -> bool:
    """Whether this is a digest, an identifier or a number, and so no secret by itself. Letters alone are no identifier."""
    if HEXADECIMAL.fullmatch(s):
        return len(s) in DIGESTS or s.isdigit()
    return not s or bool(UUID.fullmatch(s) or IDENTIFIER.fullmatch(s) and not s.isalpha())


class Scanner:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.length = {rank: len(piece) for piece, rank in ranks.items()}

    def random(self, s: str) -> bool:
        return not known(s.strip(SIGNS)) and len(s) / len(self.encode(s)) < RATIO

    def stretches(self, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        """For each token from which on there are LEAST characters, the fewest tokens that hold them, where that is random. A number or time between signs counts as one token."""
        inside = {i for m in NUMBER.finditer(text, a, b) for i in range(m.start() + 1, m.end())}
        ends = [a, *(i for i in accumulate((self.length[t] for t in self.encode(text[a:b])), initial=a) if i > a and i not in inside)]
        j = 0
        for i, start in enumerate(ends):
            while j < len(ends) and ends[j] - start < LEAST:
                j += 1
            if j == len(ends):
                return
            if (ends[j] - start) / (j - i) < RATIO and not known(text[start : ends[j]].strip(SIGNS)):
                yield start, ends[j]

    def parts(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """Random parts of a stretch of key characters, each up to the next signs, so that no end of a key is left."""
        if self.random(text[a:b]):
            return [(a, b)]
        if IDENTIFIER.fullmatch(text[a:b].strip(SIGNS)) and not SEGMENT.search(text, a, b):
            return []
        digests = [m.span() for m in HEXADECIMAL.finditer(text, a, b) if len(m[0]) in DIGESTS]
        found = []
        for x, y in outside(a, b, digests):
            found += [m.span() for m in SEGMENT.finditer(text, x, y) if self.random(m[0])]
            done = x
            for i, j in self.stretches(text, x, y):
                if j <= done:
                    continue
                while i > done and text[i - 1] not in SIGNS and text[i] not in SIGNS:
                    i -= 1
                while j < y and text[j] not in SIGNS and text[j - 1] not in SIGNS:
                    j += 1
                found.append((i, done := j))
        out = []
        for x, y in sorted(found):
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(y, out[-1][1]))
            else:
                out.append((x, y))
        return out

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        base, more = base_spans(text), []
        covered = Cover((x, y) for _, x, y in base)
        for m in RUN.finditer(text):
            a, b = m.span()
            for a, b in outside(a, b, covered.within(a, b)):
                for a, b in outside(a, b, [u.span() for u in UUIDS.finditer(text, a, b)]):
                    more += [("random", x, y) for x, y in self.parts(text, a, b)]
        return sorted(base + more, key=lambda x: (x[1], (*BASE, "random").index(x[0]))) if more else base


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def find(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """``df`` with ``secret_spans``: array of (kind, start, end) by start, then kind. ``vocabulary``: path of a rank file, read on the driver.

    With ``redact`` the text is rewritten: each stretch that spans cover becomes this string. Without, the text is left out."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # as large as the vocabulary
    rows, names = packed(df, text_col, ("secret_spans",))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    out = rows if redact is not None else rows.select("_row")
    schema = T.StructType([*out.schema.fields, T.StructField("secret_spans", T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, pattern)
        for batch in chunks(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            found = [scanner.spans(t) for t in texts]
            columns = {"_row": batch.column("_row")}
            if redact is not None:
                columns["_text"] = pa.array([redacted(t, s, redact) if s else t for t, s in zip(texts, found)], pa.string())
            columns["secret_spans"] = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, schema).select(*own(names, text_col, redact is not None), "secret_spans")


def redacted(text: str, spans: list[tuple[str, int, int]], by: str) -> str:
    """``text`` with each stretch that spans cover replaced."""
    out, done, merged = [], 0, []
    for _, a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[done:a], by]
        done = b
    return "".join(out) + text[done:]

"""Personal data by weak supervision.

Four exact patterns give the base spans, which always stay. Further candidates (unprefixed phone numbers, spelled-out addresses,
shorter card numbers, social security numbers) and the base spans too are voted on by labelers: pattern strictness, checksums and ranges, a gazetteer
of domains, issuers and area codes, words of context for this kind or another, words of other numbers, and placeholders. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability for each kind, drawn towards its reliability over all kinds; only the first two are held to be better than chance. Its posteriors are the
soft labels of a logistic span classifier, whose features are the votes and the span's own shape (groups, separators, what stands beside it), which no labeler reads; it
decides on what is not base.

What reaches the driver is a count for each pattern of kind, votes and shape that occurs: at most 5 * 3**6 * 480, whatever the corpus.

Defined results: a null text counts as empty; a text of any length is read whole, in time proportional to it but for sorting; spans of a kind that start alike are ordered by
end; equal rows get equal results; extra columns pass through, one named spans is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import Cover, chunks, materialise, own, packed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")  # a match never starts within a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[^0-9]+")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{2,63}){1,4}")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

#: Gazetteers and context words; fixed values of this module.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info example".split())
FOR = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt", "reach"),
    "ip": ("ip", "host", "server", "address", "adresse", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "carte", "karte", "tarjeta", "credit"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "telefon", "téléphone", "teléfono", "cell"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("isbn", "order", "invoice", "version", "ref", "part", "serial", "build", "commande", "rechnung", "factura")
CONTEXT = 40
PLACEHOLDERS = frozenset("test example user name someone nobody foo bar abc xxx your you email mail".split())
LABELERS = ("pattern", "check", "gazetteer", "context", "against", "placeholder")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1  # the next address can't reach behind this sign
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The exact spans of each base kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = DIGITS.sub("", m[0])
                if 16 <= len(d) <= 19 and luhn(d):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def further(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates outside the base patterns."""
    if "at]" in text or "at)" in text:
        yield from (("email", *m.span()) for m in SPELLED.finditer(text))
    if DIGIT.search(text):
        yield from (("phone", *m.span()) for m in LOCAL_PHONE.finditer(text))
        yield from (("ssn", *m.span()) for m in SSN.finditer(text))
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(DIGITS.sub("", m[0])) <= 15:
                yield ("card", *m.span())


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One sign for each labeler: + for, - against, 0 abstains."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    near = set(re.findall(r"\w+", before))
    others = {w for k in KINDS if k != kind for w in FOR[k]}
    d = DIGITS.sub("", span)
    around = text[start - 1 : start] + text[end : end + 1]
    strict = base and not any(c.isalnum() for c in around)
    if kind == "email":
        check, known = "0", "+" if re.split(r"[^A-Za-z0-9]", span)[-1].lower() in DOMAINS else "-"
    elif kind == "ip":
        check, known = "+" if not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else "-", "+" if span.split(".")[0] in ("10", "127", "172", "192") else "0"
    elif kind == "card":
        check, known = "+" if luhn(d) else "-", "+" if d[:1] in ("3", "4", "5", "6") else "-"
    elif kind == "phone":
        check, known = "+" if 10 <= len(d) <= 13 else "0", "+" if base or d[:1] not in ("0", "1") else "-"
    else:
        check, known = "-" if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else "+", "0"
    return "".join(
        (
            "+" if strict else "0" if base else "-" if any(c.isalnum() for c in around) else "0",
            check,
            known,
            "+" if near & {*FOR[kind]} else "-" if near & others else "0",
            "-" if near & {*AGAINST} else "+" if before.rstrip()[-1:] in (":", "") else "0",
            placeholder(kind, span, d),
        )
    )


def placeholder(kind: str, span: str, digits: str) -> str:
    """Whether this looks made up (-), or has the variety of a real one (+)."""
    if kind == "email":
        return "-" if re.split(r"[^A-Za-z]", span.lower())[0] in PLACEHOLDERS else "0"
    if kind == "ip":
        return "0"
    return "-" if len(set(digits)) <= 2 or digits in "01234567890123456789" else "+" if len(set(digits)) >= 5 else "0"


def shape(text: str, start: int, end: int) -> str:
    """Three signs for a span: its groups, what separates them, and what stands before and after."""
    span = text[start:end]
    groups = min(5, len(re.findall(r"[A-Za-z0-9]+", span)))
    signs = set(re.findall(r"[^A-Za-z0-9]", span))
    separators = "n" if not signs else {" ": "s", "-": "d", ".": "p"}.get(next(iter(signs)), "o") if len(signs) == 1 else "m" if signs <= set(" -().+") else "o"

    def beside(c: str) -> str:
        return "e" if not c or c == "\n" else "s" if c.isspace() else "w" if c.isalnum() else "o"

    return f"{groups}{separators}{beside(text[start - 1 : start] if start else '')}{beside(text[end : end + 1])}"


def extract(rows: DataFrame) -> DataFrame:
    """(_row, cands) of (_row, _text): base spans and candidates, array of (kind, start, end, base, key); key is kind:votes:shape."""
    span = "array<struct<kind:string,start:int,end:int,base:boolean,key:string>>"
    schema = T.StructType([rows.schema["_row"], T.StructField("cands", T._parse_datatype_string(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("key", pa.string())]))

    def one(text: str | None) -> list[dict]:
        if not text:
            return []
        found = base_spans(text)
        out = [(k, a, b, True) for k in BASE for a, b in found[k]]
        taken = Cover(s for k in BASE for s in found[k])
        out += [(k, a, b, False) for k, a, b in further(text) if not taken.within(a, b)]
        out.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
        return [dict(zip(("kind", "start", "end", "base", "key"), (*x, f"{x[0]}:{votes(text, *x)}:{shape(text, x[1], x[2])}"))) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            cands = pa.array([one(t) for t in batch.column("_text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), cands], names=["_row", "cands"])

    return rows.mapInArrow(run, schema)


def reliabilities(patterns: dict[str, int], rounds: int = 50) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """Expectation-maximisation over vote patterns kind:votes: (kind -> labeler -> how often its votes are right, pattern -> chance of being personal data)."""
    keys = sorted(patterns)
    if not keys:
        return {}, {}
    v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in k.partition(":")[2]] for k in keys])
    n = np.array([patterns[k] for k in keys], dtype=float)
    kinds = sorted({k.partition(":")[0] for k in keys})
    of = np.array([[k.partition(":")[0] == name for k in keys] for name in kinds], dtype=float)  # kinds x patterns
    least = np.array([0.55, 0.55, 0.05, 0.05, 0.05, 0.05])  # the first two anchor what is personal data
    right, prior = np.full((len(kinds), v.shape[1]), 0.8), np.full(len(kinds), 0.5)
    mine = of.argmax(0)
    for _ in range(rounds):
        weight = np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip((v * weight[mine]).sum(1) + np.log(prior / (1 - prior))[mine], -30, 30)))
        says = n[:, None] * (v != 0)
        agree = n[:, None] * np.where(v > 0, post[:, None], np.where(v < 0, 1 - post[:, None], 0))
        overall = (agree.sum(0) + 8) / (says.sum(0) + 10)
        right = np.clip((of @ agree + 10 * overall) / (of @ says + 10), least, 0.99)
        prior = np.clip((of @ (n * post) + 1) / (of @ n + 2), 0.05, 0.95)
    return {k: dict(zip(LABELERS, right[i].tolist())) for i, k in enumerate(kinds)}, dict(zip(keys, post.tolist()))


def features(key: str) -> list[float]:
    kind, signs, form = key.split(":")
    groups, separators, before, after = form
    return [
        1.0, *[float(kind == k) for k in KINDS], *[float(c == "+") for c in signs], *[float(c == "-") for c in signs],
        *[float(groups == c) for c in "2345"], *[float(separators == c) for c in "sdpmo"], *[float(before == c) for c in "swo"], *[float(after == c) for c in "swo"],
    ]


def classifier(patterns: dict[str, int], chance: dict[str, float], rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on counts of kind:votes:shape with the chances of kind:votes as soft labels, by Newton steps."""
    keys = sorted(patterns)
    x = np.array([features(k) for k in keys])
    n, y = np.array([patterns[k] for k in keys], dtype=float), np.array([chance[k.rpartition(":")[0]] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * w
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def accepted(patterns: dict[str, int]) -> list[str]:
    """Keys of patterns that the classifier takes."""
    if not patterns:
        return []
    voted: dict[str, int] = {}
    for k, n in patterns.items():
        voted[k.rpartition(":")[0]] = voted.get(k.rpartition(":")[0], 0) + n
    _, chance = reliabilities(voted)
    w = classifier(patterns, chance)
    return [k for k in sorted(patterns) if float(np.dot(w, features(k))) > 0]


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``spans``: array of (kind, start, end, base), by kind as listed, then start."""
    packed_rows, names = packed(df, text_col, ("spans",))
    rows = materialise(extract(packed_rows), "pii")
    keys = rows.select(F.explode("cands.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    patterns = {r["key"]: r["n"] for r in keys.collect()}  # at most len(KINDS) * 3**len(LABELERS) * 480
    good = F.array(*map(F.lit, accepted(patterns))).cast("array<string>")
    taken = F.filter("cands", lambda c: c["base"] | F.array_contains(good, c["key"]))
    spans = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return rows.select(*own(names, text_col, text=False), spans.alias("spans"))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

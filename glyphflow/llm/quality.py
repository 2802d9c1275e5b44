"""Quality rules as a bitmask ledger, in built-in expressions only.

``ledger`` measures a text once and stores which rules failed as bits of a long;
a policy is a mask over these bits, so new policies and ablations never read a text again.

Defined results: a null text counts as an empty one (no words; it fails ``few_words``);
texts of any length are measured whole; windows are ordered by hash but compared word by word;
extra columns pass through untouched, one named like a measure or fail_bits is replaced;
equal rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.common import NOT_SPACE, WORD, own, packed

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule name and failing condition over the measures; the place in the tuple is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
)

#: Policy version -> rules any of which rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(r) for r in rules)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns of MEASURES. Each step is one projection, so nothing is evaluated twice."""
    rows, names = packed(df, text_col, MEASURES)
    text = F.coalesce(F.col("_text"), F.lit(""))
    kept = ["_row", "_text"]
    step = rows.select(
        *kept,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE)).alias("_l"),
        F.char_length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    second, third = (lambda i: F.get("_w", i + 1)), (lambda i: F.get("_w", i + 2))
    window = F.transform(
        "_w",
        lambda w, i: F.struct(F.xxhash64(w, second(i), third(i)).alias("h"), w.alias("a"), second(i).alias("b"), third(i).alias("c"), i.alias("i")),
    )
    step = step.select(
        *kept, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.slice(window, F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))).alias("_s"),
    )

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    twice = F.filter("_s", lambda x, j: same(x, F.get("_s", j + 1)) | same(x, F.get("_s", j - 1)))
    step = step.select(*kept, *[m for m in MEASURES if m != "n_repeat_words"], F.transform(twice, lambda x: x["i"]).alias("_p"))
    covered = F.array_union(
        F.array_union("_p", F.transform("_p", lambda p: p + 1)), F.transform("_p", lambda p: p + 2)
    )
    step = step.select(*kept, *[m for m in MEASURES if m != "n_repeat_words"], F.size(covered).cast("long").alias("n_repeat_words"))
    return step.select(*own(names, text_col), *[m for m in MEASURES if m != "n_repeat_words"], "n_repeat_words")


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measures and ``fail_bits``: bit k is set if rule k failed."""
    bits = F.lit(0).cast("long")
    for k, (_, failing) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(df.drop("fail_bits"), text_col).withColumn("fail_bits", bits)


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that only it rejects.

    The ledger is folded to one row per bit pattern (at most 2**len(RULES)) before the rules look at it."""
    m = mask(POLICIES[policy])
    folded = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    return (
        folded.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def keep(df: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its own columns only, that pass the policy."""
    safe = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text_col).alias("_text"))
    # a filter is pushed below deterministic projections with all they compute, inside lambdas too; the row number keeps it above
    book = ledger(safe, "_text").withColumn("_at", F.monotonically_increasing_id())
    return book.where(passes(policy) & (F.col("_at") >= 0)).select("_row.*")

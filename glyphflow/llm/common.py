"""What the training-data operators share: shared storage, tables, word classes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.storage import materialise, release, shared_dir, sweep  # noqa: F401

#: A word is a run of characters other than these six.
NOT_SPACE = r"[^\x20\x09-\x0D]"
WORD = NOT_SPACE + "+"
#: Rows that workers get at once.
BATCH, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def few_at_once(spark: SparkSession) -> None:
    """Where the session sends workers the engine's usual 10,000 rows at once, it sends ``TEXTS`` from now on."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, TEXTS)


def packed(df: DataFrame, text_col: str, made: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``df`` as (_row, _text), so that no name of its own can meet an operator's; and the names to give back by ``own``.

    A column named like one of ``made``, the operator's results, is replaced by the result. Where the session sends workers the engine's usual 10,000 rows
    at once, it sends ``TEXTS`` from now on: rows are whole texts here."""
    few_at_once(df.sparkSession)
    names = [c for c in df.columns if c not in made]
    fields = [F.col(f"`{c}`") for c in names if c != text_col] or [F.lit(0).alias("none")]
    return df.select(F.struct(*fields).alias("_row"), F.col(f"`{text_col}`").alias("_text")), names


def own(names: list[str], text_col: str, text: bool = True) -> list[Column]:
    """The columns that ``packed`` put away, with or without the text."""
    return [F.col("_text" if c == text_col else f"_row.`{c}`").alias(c) for c in names if text or c != text_col]


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle: the engine sends neither side, however small it guesses it, to every executor."""
    return left.join(right.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Cover:
    """What a set of spans covers, as disjoint stretches in order."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def within(self, a: int, b: int) -> list[tuple[int, int]]:
        """The stretches that meet this one."""
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        return list(zip(self.starts[i:j], self.ends[i:j]))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece hold about ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)

"""Table functions for SQL: SELECT .. FROM name(TABLE(t) PARTITION BY .. ORDER BY ..), once register() was called."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pulseframe.shipping import ship


class Records:
    """(file, record, head, lines, total): records that span lines of a file, with as many lines and the sum of their last words.

    Takes TABLE(t) with (file, value) PARTITION BY file ORDER BY line and the mark with which a record's first line
    begins. One record is held at a time, whatever a file's length. Lines before the first mark and blank ones are
    skipped; a last word that isn't a number adds nothing, and a record without any number has a null total.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, mark: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"file", "value"} <= set(rows.dataType.fieldNames()):
            raise ValueError("multiline_records takes a table with columns file and value")
        if not mark.isConstantExpression or not mark.value:
            raise ValueError("multiline_records takes the mark of a record's first line as a constant")
        return AnalyzeResult(StructType().add("file", StringType()).add("record", IntegerType()).add("head", StringType()).add("lines", LongType()).add("total", DoubleType()))

    def __init__(self):
        self.file, self.record, self.head, self.lines, self.total = None, -1, None, 0, None

    def eval(self, row: Row, mark: str) -> Iterator[tuple]:
        value = (row["value"] or "").strip()
        if not value:
            return
        if value.startswith(mark):
            if self.head is not None:
                yield self._now()
            self.file, self.record, self.head, self.lines, self.total = row["file"], self.record + 1, value[len(mark) :].strip(), 0, None
        elif self.head is not None:
            self.lines += 1
            try:
                self.total = (self.total or 0.0) + float(value.rsplit(None, 1)[-1])
            except ValueError:
                pass

    def terminate(self) -> Iterator[tuple]:
        if self.head is not None:
            yield self._now()

    def _now(self) -> tuple:
        return self.file, self.record, self.head, self.lines, self.total


class Runs:
    """(key, first, last, n): stretches of rows no two neighbours of which are more than `gap` apart.

    Takes TABLE(t) with (key, at) PARTITION BY key ORDER BY at and the gap, both longs; rows without a time are skipped.
    """

    def __init__(self):
        self.key, self.first, self.last, self.n = None, None, None, 0

    def eval(self, row: Row, gap: int) -> Iterator[tuple]:
        at = row["at"]
        if at is None:
            return
        if self.n and at - self.last > gap:
            yield self.key, self.first, self.last, self.n
            self.n = 0
        self.key, self.first, self.last, self.n = row["key"], self.first if self.n else at, at, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.key, self.first, self.last, self.n


def register(spark: SparkSession) -> None:
    """Registers multiline_records and quiet_runs with the session."""
    ship(spark)
    spark.udtf.register("multiline_records", udtf(Records))
    spark.udtf.register("quiet_runs", udtf(Runs, returnType="key long, first long, last long, n long"))

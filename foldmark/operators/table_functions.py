"""Table functions for SQL: `register(spark)` makes them callable in FROM.

    SELECT * FROM gap_sessions(TABLE(SELECT user_id, ts_s FROM t) PARTITION BY user_id ORDER BY (ts_s, id), 'ts_s', 1800)
    SELECT * FROM numbers_of(text)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType


class GapSessions:
    """Each row of a table with `session_index` and `session_position` (from 1): a session ends where the named column rises by more than the gap, or is null.

    The caller partitions and orders the table; a row at a time is held.
    """

    def __init__(self):
        self.last, self.index, self.position = None, 0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, order: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("gap_sessions: the first argument is a table")
        if order.value not in rows.dataType.fieldNames():
            raise ValueError(f"gap_sessions: the table has no column {order.value}")
        return AnalyzeResult(schema=StructType(rows.dataType.fields).add("session_index", LongType()).add("session_position", LongType()))

    def eval(self, row, order, gap):
        now = row[order]
        if self.last is None or now is None or now - self.last > gap:
            self.index, self.position = self.index + 1, 0
        self.position += 1
        self.last = now
        yield (*row, self.index, self.position)


class NumbersOf:
    """(place, number) of the white-space separated tokens of a text record; a token that is no number gives null, a null text no rows."""

    def eval(self, text: str):
        for place, token in enumerate((text or "").split()):
            try:
                yield place, float(token)
            except ValueError:
                yield place, None


def register(spark: SparkSession) -> None:
    """Registers gap_sessions and numbers_of with the session."""
    spark.udtf.register("gap_sessions", udtf(GapSessions))
    spark.udtf.register("numbers_of", udtf(NumbersOf, returnType=StructType().add("place", IntegerType()).add("number", DoubleType())))

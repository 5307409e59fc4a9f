"""Table functions for statements in SQL that keep state from row to row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.conversations import TURN_GAP

_NEEDED = ("thread_id", "author", "ts", "msg_id")


@udtf
class Turns:
    """turns(TABLE(messages), gap): a row for each turn of each thread, a run of one author with at most `gap` seconds between messages. The function itself asks for the rows by thread and in order; it holds one turn. Columns of other names are let through unread, columns that are missing are named when the statement is read."""

    @staticmethod
    def analyze(messages: AnalyzeArgument, gap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not messages.isTable:
            raise ValueError("turns() takes a table: turns(TABLE(messages))")
        kinds = {f.name: f.dataType for f in messages.dataType}
        if lacking := [n for n in _NEEDED if n not in kinds]:
            raise ValueError(f"turns() lacks the columns {', '.join(lacking)}")
        long = lambda name, kind=None: StructField(name, kind or LongType())
        schema = StructType([long("thread_id", kinds["thread_id"]), long("turn_no"), long("author", kinds["author"]), long("start_ts"), long("end_ts"), long("n_messages"), long("first_msg", kinds["msg_id"])])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("thread_id")], orderBy=[OrderingColumn("ts"), OrderingColumn("msg_id")])

    def __init__(self):
        self.turn, self.number = None, 0

    def eval(self, row: Row, gap: int = TURN_GAP) -> Iterator[tuple]:
        held = self.turn
        if held is not None and held[2] == row["author"] and row["ts"] - held[4] <= gap:
            held[4], held[5] = row["ts"], held[5] + 1
            return
        if held is not None:
            yield tuple(held)
        self.number += 1
        self.turn = [row["thread_id"], self.number, row["author"], row["ts"], row["ts"], 1, row["msg_id"]]

    def terminate(self) -> Iterator[tuple]:
        if self.turn is not None:
            yield tuple(self.turn)


def register(spark: SparkSession) -> None:
    spark.udtf.register("turns", Turns)

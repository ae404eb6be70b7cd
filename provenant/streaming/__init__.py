"""Questions as a stream: each micro-batch is answered by the batch plan.

The index is a static table and questions are independent, so no state is
kept between batches; a failed batch is answered again as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..config import Settings
from ..plans.engine import answer

DEFAULTS = Settings()


def answer_stream(
    questions: DataFrame, index: dict[str, DataFrame], sink: Callable[[DataFrame, int], None], s: Settings = DEFAULTS
) -> DataStreamWriter:
    """A writer (not yet started) that hands each batch's answers to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        rows = df.where("trim(coalesce(question, '')) <> ''")
        if rows.limit(1).count():
            sink(answer(rows, index, s), number)

    return questions.writeStream.foreachBatch(batch)

"""Patches that arrive one after another.

All rules work inside one patch, so a micro-batch that holds whole patches gives the same rows as the whole table: the
batch operators run unchanged in foreachBatch. A batch's rows are written to a folder of its own number, so a batch
that is tried again replaces what its first try has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_to_arrivals(
    stream: DataFrame, rule: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Starts a query that writes rule(batch) to path/batch=<number> as Parquet.

    The source must deliver a patch as a whole, such as one file per patch or per lot of patches."""

    def each(batch: DataFrame, number: int) -> None:
        rule(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

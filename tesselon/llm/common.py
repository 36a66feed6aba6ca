"""Helpers shared by the corpus operators: table access, lineage cuts and batch chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.lineage import shared_dir

__all__ = ["chunks", "cut", "memories", "shared_dir", "table", "text_or_empty"]

#: Characters of text that one step of a batch function holds at a time.
CHUNK_BYTES = 1 << 20
#: What operators remember in a worker from task to task: how to forget it, by operator.
memories: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES, memory: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes in ``column``; one long value is one slice.

    A worker outlives its task and may go on with another operator's: all but ``memory`` is forgotten there.
    """
    for name, forget in memories.items():
        if name != memory:
            forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        width = (8 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else 4) * batch.num_rows
        step = max(1, int(batch.num_rows * size / max(1, values.nbytes - width)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch, values
        pa.default_memory_pool().release_unused()

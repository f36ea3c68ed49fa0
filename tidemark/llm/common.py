"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the control characters 9 to 13. ``bytes.split()`` splits at these.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What an operator keeps in this Python worker between tasks.

    A worker may serve several operators one after another; the caches of all others are dropped, so that it holds one's only.
    """
    others = [name for name in _KEPT if name != operator]
    for name in others:
        del _KEPT[name]
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _KEPT.setdefault(operator, {})


def slices(batches: Iterator[pa.RecordBatch], texts: int = 1, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column number ``texts`` holds about ``max_bytes`` per piece (one row at least).

    Arrow batches count rows; this keeps what Python builds from one piece bounded by bytes instead.
    """
    for batch in batches:
        lengths = [n or 0 for n in pc.binary_length(batch.column(texts)).to_pylist()]
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n + 16
        if begin < len(lengths):
            yield batch.slice(begin)

"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Bits of a filter that says which numbers may be in a column: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: Rows that a Python worker and the JVM hold at a time as a batch.
BATCH_ROWS, BATCH_CONF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let a batch sent to Python have at most BATCH_ROWS rows: both sides hold it, and texts may be long."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def map_rows(frame: DataFrame, fn: Callable[[tuple], tuple], schema: str) -> DataFrame:
    """One output row per input row, computed in Python over Arrow batches.

    ``fn`` gets the row's values in column order. Each batch is turned into Python values in
    slices, so a batch of very long texts is never held twice.
    """
    return flat_map_rows(frame, lambda row: (fn(row),), schema)


def flat_map_rows(frame: DataFrame, fn: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """Any number of output rows per input row, computed in Python over Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [made for row in zip(*(c.to_pylist() for c in part.columns)) for made in fn(row)]
                columns = zip(*made) if made else [[] for _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return frame.mapInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def span_text(kinds: list[str]) -> Callable[[list[tuple[int, int, int]]], str]:
    """``kind:start:end`` of (start, kind number, end) triples in order, comma-joined."""
    return lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def free_name(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken, name = {c.lower() for c in frame.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def bits_of(numbers: DataFrame, column: str) -> np.ndarray:
    """A filter of FILTER_BITS bits over a column of 64-bit numbers; its size does not depend on the rows."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = numbers.select(F.shiftright(bit, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint8)


def in_filter(bits: np.ndarray | bytes, value: int) -> bool:
    at = value & (FILTER_BITS - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)

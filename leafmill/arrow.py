"""Rows between Spark and Python workers: batches bounded by bytes, and groups of rows read one at a time after one shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a batch of rows between Spark and a Python worker.
BATCH_BYTES = 4 << 20

#: Rows and bytes of texts, about, that a worker gathers before it gives them back.
OUT_ROWS, OUT_BYTES = 2000, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets batches to and from Python workers be of a few megabytes, not of as many rows whatever their texts are.

    It is a setting of the session, lowered where it is higher and left alone where it is lower already.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", spark.conf.get(key).lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


class Out:
    """Gathers rows, dictionaries by column, and gives them back as a batch once they are many or large."""

    def __init__(self, kinds: pa.Schema):
        self.kinds, self.n, self.size = kinds, 0, 0
        self.columns: dict[str, list] = {name: [] for name in kinds.names}

    def add(self, row: dict) -> bool:
        """Whether ``batch`` should be asked for."""
        return self.extend(1, {name: [v] for name, v in row.items()})

    def extend(self, n: int, block: dict[str, list]) -> bool:
        """The same of n rows, given as columns."""
        for name, column in self.columns.items():
            values = block.get(name)
            if values is None:
                column += [None] * n
                continue
            column += values
            if isinstance(values[0], str | bytes):
                self.size += sum(len(v or "") for v in values)
            elif isinstance(values[0], list | np.ndarray):
                self.size += sum(8 * len(v) for v in values if v is not None)
            elif isinstance(values[0], tuple):
                self.size += sum(8 * len(v[0]) for v in values if v)
        self.n += n
        return self.n >= OUT_ROWS or self.size >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([_column(self.columns[f.name], f.type) for f in self.kinds], schema=self.kinds)
        self.n, self.size = 0, 0
        self.columns = {name: [] for name in self.columns}
        return made


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Lists of structs may be given as a tuple of lists for each field: no object is made for an item."""
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type) or not any(isinstance(v, tuple) for v in values):
        return pa.array(values, kind)
    ends, parts = [0], [[] for _ in kind.value_type]
    for v in values:
        for part, items in zip(parts, v or ()):
            part += items
        ends.append(len(parts[0]))
    made = pa.StructArray.from_arrays([pa.array(part, f.type) for part, f in zip(parts, kind.value_type)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, type=kind, mask=pa.array([v is None for v in values]))


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def over_groups(df: DataFrame, key: list[str], order: list[str], make: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``make`` gives for the rows of each key, in order. A task holds one group at a time."""
    bounded_batches(df.sparkSession)
    kinds = arrow_schema(df.sparkSession, schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                of = [row[k] for k in key]
                if held and of != last:
                    yield held
                    held = []
                held.append(row)
                last = of
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(kinds)
        for group in groups(batches):
            for row in make(group):
                if out.add(row):
                    yield out.batch()
        yield out.batch()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)

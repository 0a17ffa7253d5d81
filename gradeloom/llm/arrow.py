"""Arrow batches in and out of Python, without pandas objects in between."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradeloom.session import prepare

OUT_ROWS = 20_000


def map_rows(df: DataFrame, schema: str, function: Callable[[Iterable[tuple]], Iterator[tuple]]) -> DataFrame:
    """function gets an iterator over the rows of a partition, as tuples, and yields output tuples.

    Rows stream through: neither a partition nor its output is held as a whole.
    """
    prepare(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        held: list[tuple] = []
        for row in function(rows()):
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*held), target)], schema=target)

    return df.mapInArrow(run, schema)

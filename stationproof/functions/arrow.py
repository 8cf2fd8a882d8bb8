"""Columns computed from Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def add_columns(df: DataFrame, reads: list[str], make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]], ddl: str) -> DataFrame:
    """Add the columns `ddl` to every row, from batches of the columns `reads`.

    `make` builds, once in each task, a function from arrays of `reads` to the new arrays. A column named like a new one is
    replaced. Columns are numbered on the way, so names with dots pass.
    """
    new = list(_parse_datatype_string(ddl).fields)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    inner = [f"c{i}" for i in range(len(kept) + len(reads))]
    source = df.select(*[F.col(quoted(c)) for c in [f.name for f in kept] + reads]).toDF(*inner)
    outer = [f"c{i}" for i in range(len(kept) + len(new))]
    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(outer, kept + new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                made = fn([b.column(len(kept) + i) for i in range(len(reads))])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + made, names=outer)

    return source.mapInArrow(run, schema).toDF(*[f.name for f in kept + new])

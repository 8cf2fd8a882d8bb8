"""Helpers shared by the text operators: batches through Arrow, stored intermediate tables, byte-level words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from stationproof.functions.state import checkpoint_dir

#: Documents in one Arrow batch; very long documents are bounded by Spark's own byte limit of a batch.
BATCH_ROWS = 500

#: A-Z to a-z; every ASCII byte that is neither digit nor letter becomes a blank. Bytes of non-ASCII characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def blank_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs without blank, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the session's shared folder, in folders of `by`, and read it back: cuts the lineage and keeps column pruning."""
    return stored_in_turn([df], name, *by)


def stored_in_turn(tables: Iterable[DataFrame], name: str, *by: str) -> DataFrame:
    """`stored` of one or more tables of one schema as one; the next is asked for when the one before is written."""
    path = f"tables/{name}-{uuid.uuid4().hex}"
    for df in tables:
        spark, schema = df.sparkSession, df.schema
        df.write.mode("append").parquet(f"{checkpoint_dir(spark)}/{path}", partitionBy=list(by) or None)
        del df  # or its shuffles would stay on the disk
    return spark.read.schema(schema).parquet(f"{checkpoint_dir(spark)}/{path}")


def freed(df: DataFrame, folder: str = "") -> None:
    """Delete the files of a `stored` table, or of its folder `column=value`, once nothing reads them any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if place.endswith(f"/{folder}" if folder else ""):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(place))
            path.getFileSystem(conf).delete(path, True)


def fields(ddl: str) -> list[StructField]:
    return list(_parse_datatype_string(ddl).fields)


def quoted(name: str) -> str:
    """A column's name as Spark reads it back, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(df: DataFrame) -> None:
    """Fewer rows an Arrow batch where the session has the default."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns by exact name, also where a name holds dots or appears twice."""
    taken = {n.lower() for n in names}
    return df.select(*[df[quoted(c)] for c in df.columns if c.lower() not in taken])


def map_text(df: DataFrame, make: Callable[[], Callable[[list], dict[str, pa.Array]]], ddl: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the columns `ddl` to every row, computed from batches of texts.

    `make` builds, once in each task, a function from a list of texts (None for null) to arrays by column name. Other
    columns pass through unread; a column that has the name of a new one is replaced. `keep` restricts what passes.
    """
    new = fields(ddl)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    # Spark's own call looks columns up by bare name, which fails for names with dots: they are numbered on the way.
    chosen = [f.name for f in kept] + ([] if any(f.name == text_col for f in kept) else [text_col])
    at = chosen.index(text_col)
    source = df.select(*map(quoted, chosen)).toDF(*[f"c{i}" for i in range(len(chosen))])
    numbered = [f"c{i}" for i in range(len(kept) + len(new))]
    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(numbered, kept + new)])
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = fn(batch.column(at).to_pylist())
            arrays = [batch.column(i) for i in range(len(kept))] + [made[f.name] for f in new]
            yield pa.RecordBatch.from_arrays(arrays, names=numbered)

    return source.mapInArrow(run, schema).toDF(*[f.name for f in kept + new])


def sha(column) -> F.Column:
    """Lower-case hex SHA-256 of a string column in UTF-8."""
    return F.sha2(column.cast("binary"), 256)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")

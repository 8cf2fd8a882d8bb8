"""Stored tables: loads that can be repeated, run-stamped results, reports and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof import registry
from stationproof.functions.columns import iso
from stationproof.functions.state import cut
from stationproof.operators import adjudicate, canonical


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


#: A reading on record: the hash is rounded to six decimals, so the exact value belongs to it.
LOAD_KEY = ["row_hash", "timestamp_utc", "value"]


def new_rows(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of a batch not on record, each once."""
    once = batch.dropDuplicates(LOAD_KEY)
    if stored is None:
        return once
    known = stored.select(*[F.col(c).alias(f"_{c}") for c in LOAD_KEY])
    same = [once[c].eqNullSafe(known[f"_{c}"]) for c in LOAD_KEY]
    return once.join(known, same[0] & same[1] & same[2], "left_anti")


def load_batch(batch: DataFrame, root: str) -> tuple[str, int]:
    """Append a batch to `root`; loading the same content again changes nothing."""
    spark = batch.sparkSession
    batch_id = canonical.checksum(batch).first()["checksum"]
    done = f"{root}/ingest_batches"
    if exists(spark, done) and not spark.read.parquet(done).where(F.col("batch_id") == batch_id).isEmpty():
        return batch_id, 0
    path = f"{root}/readings"
    stored = None
    if exists(spark, path):
        span = batch.agg(F.min(F.to_date("timestamp_utc")).alias("lo"), F.max(F.to_date("timestamp_utc")).alias("hi")).first()
        # only the days of the batch are read: `day` is the partition column
        stored = spark.read.parquet(path).where(F.col("day").between(F.lit(span.lo), F.lit(span.hi)))
    fresh = cut(
        new_rows(batch, stored).withColumns(
            {"day": F.to_date("timestamp_utc"), "ingest_batch_id": F.lit(batch_id)}
        )
    )
    n = fresh.count()
    fresh.write.mode("append").partitionBy("day").parquet(path)
    spark.sql(f"SELECT '{batch_id}' AS batch_id, {n}L AS n_rows").write.mode("append").parquet(done)
    return batch_id, n


def station_dimension(readings: DataFrame) -> DataFrame:
    """Coverage map per station; parameters are a closed list, so the map is short."""
    n = readings.groupBy("station_id", "parameter").agg(F.count("value").alias("n"))
    return n.groupBy("station_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("parameter", "n")))).alias("coverage")
    )


def new_keys(rows: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    return rows if stored is None else rows.join(stored.select(key), key, "left_anti")


def stamped(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("audit_run_id", F.lit(run_id))


def write_run(tables: dict[str, DataFrame], run_id: str, root: str) -> None:
    """Results of one audit run; writing a run again replaces that run only."""
    for name, df in tables.items():
        (
            stamped(df, run_id)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("audit_run_id")
            .parquet(f"{root}/{name}")
        )


def store_residuals(residuals: DataFrame, version: str, root: str) -> None:
    """Residuals of one model version, replaced as a whole."""
    (
        residuals.withColumn("model_version", F.lit(version))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_version")
        .parquet(f"{root}/residuals")
    )


def write_report(sections: dict[str, DataFrame], folder: str) -> None:
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def ledger(defects: DataFrame, structural: DataFrame) -> DataFrame:
    """Defects and structural exclusions in one table of nine columns."""
    d = defects.where(~F.col("reason_code").isin("R18", "R19")).select(
        F.lit("defect").alias("record_type"),
        "station_id",
        "parameter",
        iso("timestamp_utc").alias("timestamp_utc"),
        "reason_code",
        "severity",
        registry.counts("reason_code").alias("counts_toward_rate"),
        F.lit("").alias("excluded_cells"),
        F.to_json("evidence").alias("evidence"),
    )
    s = structural.select(
        F.lit("structural_exclusion").alias("record_type"),
        "station_id",
        "parameter",
        F.lit("").alias("timestamp_utc"),
        "reason_code",
        F.lit("info").alias("severity"),
        F.lit(False).alias("counts_toward_rate"),
        F.col("excluded_cells").cast("string").alias("excluded_cells"),
        F.to_json(F.create_map(F.lit("domain"), F.col("domain"))).alias("evidence"),
    )
    return d.unionByName(s)


def write_ledger(rows: DataFrame, folder: str) -> None:
    order = ["record_type", "station_id", "parameter", "timestamp_utc", "reason_code"]
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(folder)


def verification(rows: DataFrame, accounting: DataFrame) -> DataFrame:
    """One digest over the ledger and the accounting, independent of order and of sign-offs."""
    text = F.concat_ws("\u001f", *[F.col(c).cast("string") for c in rows.columns if c != "evidence"])
    sums = F.concat_ws("\u001f", *[F.col(c).cast("string") for c in accounting.columns])
    both = rows.select(F.sha1(text).alias("row_hash")).unionByName(accounting.select(F.sha1(sums).alias("row_hash")))
    return canonical.checksum(both)


def top_codes(defects: DataFrame, limit: int = 8) -> DataFrame:
    return (
        defects.groupBy("reason_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "reason_code")
        .limit(limit)
    )


def write_bundles(verdicts: DataFrame, neighbours: DataFrame, folder: str, windy: DataFrame | None = None) -> None:
    """Evidence bundles: one header per event, its neighbour rows, and the wind that was assumed."""
    verdicts.write.mode("overwrite").json(f"{folder}/events")
    neighbours.write.mode("overwrite").json(f"{folder}/neighbours")
    if windy is not None:
        adjudicate.wind_note(windy).write.mode("overwrite").json(f"{folder}/wind")


def write_manifest(readings: DataFrame, folder: str) -> None:
    """Observed schema: per-parameter profile and the corpus line with its checksum."""
    canonical.profile(readings).coalesce(1).write.mode("overwrite").json(f"{folder}/parameters")
    canonical.checksum(readings).write.mode("overwrite").json(f"{folder}/corpus")

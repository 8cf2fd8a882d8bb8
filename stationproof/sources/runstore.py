"""Stored tables of audit runs, read as snapshots.

Every commit writes its tables to folders of their own, by day where a table has instants, and then adds one manifest: a small file that names the
folders of every table of every run. A reader takes the newest manifest, or an older one, and sees whole runs only; what a failed
load left behind is named by none. A manifest's number is taken by creating its file exclusively, so of two loaders that began from the same
snapshot the second is refused and must begin again. Writing a run again replaces that run in the next manifest only.

The file system has to refuse creating a file that exists, as HDFS and local disks do. The driver reads manifests, whose
size follows the number of runs; rows never pass through it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof.sources.sinks import children, exists

RUNS = "runs"


class Stale(RuntimeError):
    """Another loader has committed since the snapshot that a load began from."""


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest manifest; 0 for an empty store."""
        if not exists(self.spark, f"{self.root}/manifests"):
            return 0
        names = [n for n in children(self.spark, f"{self.root}/manifests") if n.endswith(".json")]
        return max((int(n.split(".")[0]) for n in names), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """Folder of every table by run."""
        version = self.version() if version is None else version
        if not version:
            return {}
        p, fs = self._path("manifests", f"{version:08d}.json")
        reader = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        try:
            return json.loads(reader.readLine())
        finally:
            reader.close()

    def commit(self, run_id: str, tables: dict[str, DataFrame], since: int | None = None) -> int:
        """Store a run's tables, among them `runs` with the one row that describes it, as one snapshot; gives its number.

        `since` is the snapshot that the load began from, by default the newest one now; raises `Stale` where another came after it.
        """
        since = self.version() if since is None else since
        known, own = self.manifest(since), {}
        for name, df in tables.items():
            folder = f"data/{name}/{uuid.uuid4().hex}"
            stamped = df.withColumn("audit_run_id", F.lit(run_id))
            if "timestamp_utc" in df.columns:
                stamped.withColumn("day", F.to_date("timestamp_utc")).repartition("day").write.partitionBy("day").parquet(f"{self.root}/{folder}")
            else:
                stamped.write.parquet(f"{self.root}/{folder}")
            own[name] = folder
        p, fs = self._path("manifests", f"{since + 1:08d}.json")
        text = json.dumps({**known, run_id: own}, sort_keys=True) + "\n"
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Stale(f"snapshot {since + 1} exists already") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return since + 1

    def table(self, name: str, run_id: str | None = None, version: int | None = None, days: tuple[str, str] | None = None) -> DataFrame:
        """A table of one run, or of all runs; `days` (first, last) reads no other partitions."""
        snapshot = self.manifest(version)
        paths = [f"{self.root}/{t[name]}" for r, t in sorted(snapshot.items()) if name in t and run_id in (None, r)]
        if not paths:
            raise KeyError(f"no table {name} of {run_id or 'any run'}")
        out = None
        for p in paths:  # folders are read one by one: each has its own partitions
            part = self.spark.read.parquet(p)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out if days is None else out.where(F.col("day").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))

    def runs(self) -> DataFrame:
        return self.table(RUNS)

    def latest_run(self) -> DataFrame:
        """The run generated last, of equals the one with the smaller id."""
        return self.runs().orderBy(F.col("generated_at").desc(), "audit_run_id").limit(1)

    def page(self, limit: int, after: str | None = None) -> DataFrame:
        """Runs by id, from behind a cursor."""
        rows = self.runs() if after is None else self.runs().where(F.col("audit_run_id") > after)
        return rows.orderBy("audit_run_id").limit(limit)

    def recent(self, limit: int = 10) -> DataFrame:
        return self.runs().orderBy(F.col("generated_at").desc(), "audit_run_id").limit(limit)

    def run_defects(self, run_id: str) -> DataFrame:
        """Every defect of a run in the order of the audit trail."""
        return self.table("defects", run_id).orderBy("station_id", "parameter", "timestamp_utc", "reason_code")

    def run_coverage_facts(self, run_id: str) -> DataFrame:
        return self.table("coverage_facts", run_id).orderBy("station_id", "parameter")

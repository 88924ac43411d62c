"""Tables kept in folders: a versioned manifest over immutable segments, read and written by Spark alone."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "kind string, bucket int, segment string, rows long, total long, batch_id long"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


class Segments:
    """Bucketed tables under one folder, of which a manifest says which segments of which buckets count.

    A segment is written whole before the manifest of the next version names it, so readers see all of a version or nothing,
    a lost writer leaves nothing that counts, and every version stays readable until its segments are removed. The manifest
    has one row for each live (kind, bucket, segment); only such rows reach the driver.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries: list[tuple] = []
        self.version = 0
        try:
            log = spark.read.schema(f"{_ENTRY}, version int").parquet(f"{self.root}/manifest")
            self.version = version or log.agg(F.max("version")).first()[0] or 0
        except AnalysisException:  # nothing was published yet
            log = None
        if log is not None:
            self.entries = [tuple(r) for r in log.where(F.col("version") == self.version).drop("version").collect()]

    def count(self, kind: str) -> tuple[int, int, int]:
        """Rows, total and batch id that the manifest keeps under a kind without segments."""
        return next(((r, t, b) for k, _, s, r, t, b in self.entries if k == kind and s == ""), (0, 0, -1))

    def buckets(self, kind: str) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for k, b, s, *_ in self.entries:
            if k == kind and s:
                out.setdefault(b, []).append(s)
        return out

    def write(self, df: DataFrame, kind: str, segment: str, sort: list[str], deal: bool = True) -> list[tuple]:
        """Writes ``df``, which has a column bucket, as one segment of a kind; its manifest entries, one a bucket.

        Rows are dealt by bucket, and adaptive execution splits buckets of many rows; without ``deal`` each task writes its own,
        for rows that lie by bucket already.
        """
        path = f"{self.root}/{kind}/segment={segment}"
        (df.hint("rebalance", "bucket") if deal else df).sortWithinPartitions("bucket", *sort).write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema("bucket int").parquet(path).distinct().collect()
        return [(kind, r.bucket, segment, 0, 0, 0) for r in written]

    def publish(self, entries: list[tuple]) -> None:
        self.version += 1
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={self.version}")
        self.entries = entries

    def read(self, kind: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        """The live rows of a kind, of all or some buckets; only their folders are listed and read."""
        paths = [f"{self.root}/{kind}/segment={s}/bucket={b}" for b, many in self.buckets(kind).items() if buckets is None or b in buckets for s in many]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths)

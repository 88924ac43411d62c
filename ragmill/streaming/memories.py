"""Long-term memories kept as a table while candidates stream in: near ones are merged, others inserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragmill.operators.near import MISS, settle, signatures
from ragmill.sources.store import Segments

#: Columns of candidates and of memories.
CANDIDATE = "candidate_id string, user_id string, seq long, content string, importance double, confidence double, tags array<string>, vector array<double>"
_MEMORY = "memory_id string, user_id string, content string, importance double, confidence double, tags array<string>, vector array<double>, version int, bucket int"
_MARK = "user_id string, memory_id string, band long, sign long, bucket int"


class MemoryTable:
    """Memories under one folder, in buckets by user, with a table of their signatures.

    ``apply`` takes a batch of candidates: those under the gates of importance and confidence go, the others are merged or
    inserted as ``near.settle`` says. A merge keeps the memory's content and takes the larger importance and confidence and
    the union of tags. Only the buckets of the batch's users are read and written, only signatures of new memories are made,
    and a batch id that is not larger than the last one applied changes nothing, so a repeated batch does no harm. However a
    sequence of candidates is cut into batches, the memories after it are the same: a pair at the threshold escapes its
    signatures with probability ``miss`` at most, and then does so in every cut. ``load`` puts in memories as they are.
    """

    def __init__(self, spark: SparkSession, root: str, least: float = 0.88, importance: float = 0.72, confidence: float = 0.65, bits: int = 12, miss: float = MISS, buckets: int = 16, most: int = 4):
        self.spark, self.least, self.gates, self.bits, self.miss, self.n, self.most = spark, least, (importance, confidence), bits, miss, buckets, most
        self.store = Segments(spark, root)

    def _bucket(self, column: str = "user_id"):
        return F.pmod(F.xxhash64(column), F.lit(self.n)).cast("int")

    def memories(self, buckets: set[int] | None = None) -> DataFrame:
        """The memories as they are: of each id the row of the last version."""
        rows = self.store.read("memories", _MEMORY, buckets)
        fields = [c for c in rows.columns if c not in ("memory_id", "bucket")]
        return rows.groupBy("bucket", "memory_id").agg(F.max_by(F.struct(*fields), "version").alias("m")).select("memory_id", "m.*", "bucket")

    def load(self, memories: DataFrame, batch_id: int) -> None:
        """Puts rows in that are memories already, as a table kept elsewhere has them: as ``apply`` does, but none is merged, however near others are."""
        self.apply(memories, batch_id, merge=False)

    def apply(self, candidates: DataFrame, batch_id: int, merge: bool = True) -> None:
        if batch_id <= self.store.count("applied")[2]:
            return
        version = self.store.version + 1
        path = f"{self.store.root}/staging/version={version}"
        names = [x.split()[0] for x in CANDIDATE.split(", ")]
        good = candidates.where((F.col("importance") >= self.gates[0]) & (F.col("confidence") >= self.gates[1]) & F.col("user_id").isNotNull() & F.col("candidate_id").isNotNull())
        good.select(*(F.col(c).cast(k) for c, k in (x.split(" ", 1) for x in CANDIDATE.split(", ")))).select(names).dropDuplicates(["candidate_id"]).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(path)
        batch = self.spark.read.parquet(path)
        touched = {r.bucket for r in batch.select("bucket").distinct().collect()}
        now = self.memories(touched)
        batch = batch.join(now.select(F.col("memory_id").alias("candidate_id")), "candidate_id", "left_anti")
        if merge:
            marks = self.store.read("signatures", _MARK, touched).drop("bucket")
            fate, new = settle(batch.select("user_id", "candidate_id", "seq", "vector"), now.select("user_id", "memory_id", "vector"), marks, self.least, self.bits, self.miss)
        else:
            fate = batch.select("candidate_id", F.col("candidate_id").alias("memory_id"))
            new = signatures(batch, "user_id", "candidate_id", self.bits, self.least, self.miss).withColumnRenamed("candidate_id", "memory_id")
        into = batch.drop("bucket").join(fate, "candidate_id").select("memory_id", "importance", "confidence", "tags", F.when(F.col("candidate_id") == F.col("memory_id"), F.struct("user_id", "content", "vector")).alias("own"))
        old = now.join(into.select("memory_id").distinct(), "memory_id", "left_semi").select("memory_id", "importance", "confidence", "tags", F.struct("user_id", "content", "vector").alias("own"))
        tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>"))))))
        rows = into.unionByName(old).groupBy("memory_id").agg(F.max("importance").alias("importance"), F.max("confidence").alias("confidence"), tags.alias("tags"), F.max("own").alias("own"))
        rows = rows.select("memory_id", "own.user_id", "own.content", "importance", "confidence", "tags", "own.vector", F.lit(version).alias("version")).withColumn("bucket", self._bucket())
        entries = [e for e in self.store.entries if e[0] != "applied"] + [("applied", 0, "", 0, 0, batch_id)]
        entries += self.store.write(rows, "memories", f"v{version}", ["user_id", "memory_id"])
        entries += self.store.write(new.withColumn("bucket", self._bucket()).select("user_id", "memory_id", "band", "sign", "bucket"), "signatures", f"v{version}", ["user_id", "band", "sign"])
        self.store.publish(entries)
        self._compact()

    def _compact(self) -> None:
        """Merges the segments of buckets that have more than ``most``."""
        entries = list(self.store.entries)
        for kind, rows in (("memories", self.memories), ("signatures", lambda b: self.store.read("signatures", _MARK, b))):
            full = {b for b, s in self.store.buckets(kind).items() if len(s) > self.most}
            if full:
                df = rows(full)
                order = ["user_id", "memory_id"] if kind == "memories" else ["user_id", "band", "sign"]
                entries = [e for e in entries if e[0] != kind or e[1] not in full] + self.store.write(df, kind, f"c{self.store.version + 1}", order)
        if entries != self.store.entries:
            self.store.publish(entries)


def memory_merge_stream(candidates: DataFrame, root: str, checkpoint: str, **params) -> StreamingQuery:
    """Keeps a MemoryTable under ``root`` as candidates (columns of CANDIDATE) arrive, in the order of their ``seq`` from batch to batch."""
    return candidates.writeStream.foreachBatch(lambda batch, i: MemoryTable(batch.sparkSession, root, **params).apply(batch, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

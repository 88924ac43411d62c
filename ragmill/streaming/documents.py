"""Arriving files to a chunk table that is kept compact: a manifest of files, and buckets of documents that are replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragmill.sources.store import Segments

_CHUNK = "doc_id string, content_hash string, chunk_id string, text string, version int, alive boolean, bucket int"


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.txt", files: int = 1000) -> DataFrame:
    """(path, doc_id, length, modified, content_hash, text): a stream of the files of a folder as they arrive, up to ``files`` a batch.

    doc_id is the file's name without its ending; the text is its content as UTF-8.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    return raw.select("path", name.alias("doc_id"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "utf-8").alias("text"))


class DocumentTable:
    """Chunks of documents under one folder, in buckets by document.

    A batch of documents is compared with the buckets of its own documents only: known content is skipped, other content
    replaces the document's chunks, an empty document takes them away. Buckets of more than ``most`` segments are merged when
    they are touched, so a batch reads and writes as much after a thousand batches as after ten. Every version that is kept
    can be read. A batch id that was applied is not applied again.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, most: int = 4, version: int | None = None):
        self.spark, self.n, self.most = spark, buckets, most
        self.store = Segments(spark, root, version)

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.n)).cast("int")

    def chunks(self, buckets: set[int] | None = None) -> DataFrame:
        """(doc_id, content_hash, chunk_id, text, version, bucket): the chunks of each document's last version."""
        rows = self.store.read("chunks", _CHUNK, buckets)
        last = rows.groupBy("bucket", "doc_id").agg(F.max("version").alias("version"))
        return rows.join(last, ["bucket", "doc_id", "version"], "left_semi").where("alive").drop("alive")

    def apply(self, documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], batch_id: int) -> None:
        """Applies documents(doc_id, content_hash, text); ``chunker`` turns those that are new into (doc_id, chunk_id, text)."""
        if batch_id <= self.store.count("applied")[2]:
            return
        version = self.store.version + 1
        d = documents.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "content_hash", F.coalesce("text", F.lit("")).alias("text"))
        path = f"{self.store.root}/staging/version={version}"
        d.groupBy("doc_id").agg(F.max(F.struct("content_hash", "text")).alias("d")).select("doc_id", "d.*").withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(path)
        batch = self.spark.read.parquet(path)
        touched = {r.bucket for r in batch.select("bucket").distinct().collect()}
        known = self.chunks(touched).groupBy("doc_id").agg(F.max("content_hash").alias("have"))
        new = batch.join(known, "doc_id", "left").where(F.col("have").isNull() | (F.col("have") != F.col("content_hash")))
        made = chunker(new.select("doc_id", "text")).select("doc_id", "chunk_id", "text").join(new.select("doc_id", "content_hash"), "doc_id").select("doc_id", "content_hash", "chunk_id", "text", F.lit(version).alias("version"), F.lit(True).alias("alive"))
        gone = new.where("text = '' and have is not null").select("doc_id", "content_hash", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("text"), F.lit(version).alias("version"), F.lit(False).alias("alive"))
        entries = [e for e in self.store.entries if e[0] != "applied"] + [("applied", 0, "", 0, 0, batch_id)]
        entries += self.store.write(made.unionByName(gone).withColumn("bucket", self._bucket()), "chunks", f"v{version}", ["doc_id", "chunk_id"])
        self.store.publish(entries)
        full = {b for b, s in self.store.buckets("chunks").items() if len(s) > self.most}
        if full:
            merged = self.chunks(full).withColumn("alive", F.lit(True)).select("doc_id", "content_hash", "chunk_id", "text", "version", "alive", "bucket")
            entries = [e for e in self.store.entries if e[0] != "chunks" or e[1] not in full]
            self.store.publish(entries + self.store.write(merged, "chunks", f"c{self.store.version + 1}", ["doc_id", "chunk_id"]))


def document_stream(documents: DataFrame, root: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame], **params) -> StreamingQuery:
    """Keeps a DocumentTable under ``root`` as documents(doc_id, content_hash, text) arrive, for instance from ``file_stream``."""
    return documents.writeStream.foreachBatch(lambda batch, i: DocumentTable(batch.sparkSession, root, **params).apply(batch, chunker, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

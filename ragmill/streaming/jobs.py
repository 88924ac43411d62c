"""Streaming jobs: arriving documents, session state, memory candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ragmill.operators.index import ingest_decision, not_deleted
from ragmill.operators.memory import ACTION, CONSTRAINT, SIGNALS, extract_candidates

STATE = "session_id string, current_goal string, current_step string, constraints array<string>, updated_at timestamp"


def merge_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The chunk table after incoming chunks(doc_id, content_hash, …): known content is skipped, other content replaces a document's
    active chunks, which stay as deleted, and new documents are added."""
    first = incoming.groupBy("doc_id").agg(F.max("content_hash").alias("content_hash"))
    decided = ingest_decision(first, current)
    changed = current.join(decided.where("decision = 'replace'").select("doc_id").withColumn("_hit", F.lit(True)), "doc_id", "left")
    old = changed.withColumn("status", F.when(F.col("_hit") & not_deleted(), "deleted").otherwise(F.col("status"))).drop("_hit")
    new = incoming.join(decided.where("decision <> 'skipped'"), "doc_id", "left_semi").withColumn("status", F.lit("active"))
    return old.unionByName(new, allowMissingColumns=True)


def _log(spark: SparkSession, table: str, before: int) -> DataFrame | None:
    """What the batches before a number wrote, with their version; None before the first."""
    try:
        log = spark.read.parquet(table)
    except AnalysisException:  # nothing was written yet
        return None
    return log.where(F.col("version") < before)


def ingest_stream(chunks: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps a log of chunks(doc_id, content_hash, …) under ``table`` as they arrive.

    A batch writes only its new and changed documents, to a folder of its own that a repeat of the batch replaces; documents
    whose newest content is known are skipped. ``read_version`` gives the chunk table with what was replaced as deleted.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        log = _log(batch.sparkSession, table, batch_id)
        new = batch
        if log is not None:
            ids = batch.select("doc_id").distinct()
            have = log.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("content_hash", F.struct("version", "content_hash")).alias("_have"))
            first = batch.groupBy("doc_id").agg(F.max("content_hash").alias("_hash"))
            known = first.join(have, "doc_id").where("_hash = _have").select("doc_id")
            new = batch.join(known, "doc_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, table: str, version: int) -> DataFrame | None:
    """The chunk table after a batch: all chunks with status active, or deleted where a later batch replaced their document."""
    log = _log(spark, table, version + 1)
    if log is None:
        return None
    last = log.groupBy("doc_id").agg(F.max("version").alias("_last"))
    return log.join(last, "doc_id").withColumn("status", F.when(F.col("version") < F.col("_last"), "deleted").otherwise("active")).drop("_last", "version")


class SessionState(StatefulProcessor):
    """Goal, step and constraints of a session, by event time within a batch; rows older than the state are ignored."""

    def __init__(self, action: str = ACTION, constraint: str = CONSTRAINT):
        self.action, self.constraint = action, constraint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "goal string, step string, constraints array<string>, updated_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        import re

        held = self.state.get()
        goal, step, constraints, at = (held[0], held[1], list(held[2] or ()), held[3]) if held else (None, None, [], None)
        batch = pd.concat(list(rows)).sort_values("created_at", kind="stable")
        for text, time in zip(batch["content"], batch["created_at"]):
            time = pd.Timestamp(time).to_pydatetime()
            if at is not None and time <= at.replace(tzinfo=time.tzinfo):
                continue
            q = " ".join(text.split())
            goal = goal or q[:60]
            if re.search(self.action, q):
                step = q[:50]
            found = re.search(self.constraint, text)
            if found and found[0].strip() not in constraints:
                constraints.append(found[0].strip())
            at = time
        self.state.update((goal, step, constraints, at))
        yield pd.DataFrame({"session_id": [key[0]], "current_goal": [goal], "current_step": [step], "constraints": [constraints], "updated_at": [at]})

    def close(self) -> None:
        pass


def session_stream(messages: DataFrame, action: str = ACTION, constraint: str = CONSTRAINT) -> DataFrame:
    """A stream of states, one row for each session that a batch of user messages touches.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    user = messages.where("role = 'user'").select("session_id", "content", "created_at")
    return user.groupBy("session_id").transformWithStateInPandas(SessionState(action, constraint), STATE, "Update", "None")


def memory_stream(messages: DataFrame, lateness: str = "1 day", signals: dict = SIGNALS) -> DataFrame:
    """A stream of memory candidates of user messages, each content of a user once within the watermark.

    A turn's sentences are scored row by row and all that count are kept; ``memory_job`` keeps the best two of a turn.
    """
    from ragmill.operators.memory import PREFIXES, score_importance

    s = messages.where("role = 'user'").withWatermark("created_at", lateness).select("user_id", "session_id", "created_at", F.explode(F.split("content", "[。！？!?\\n；;]")).alias("content"))
    s = score_importance(s.withColumn("content", F.trim("content")).where(F.length("content") >= 6), "content", signals).where("importance > 0")
    prefix = F.coalesce(*(F.when(F.array_contains("tags", t), p) for t, p in PREFIXES.items()), F.lit("记忆："))
    return s.withColumn("content", F.concat(prefix, F.regexp_replace("content", "[。！？!?. ]+$", ""))).dropDuplicatesWithinWatermark(["user_id", "content"])


def memory_job(messages: DataFrame, table: str, checkpoint: str, most: int = 2, signals: dict = SIGNALS) -> StreamingQuery:
    """Appends the best ``most`` memory candidates of each user turn to ``table``, each content of a user once.

    A turn is a row of messages(user_id, session_id, message_id, role, content). Each batch is ranked by turn and held against
    what is there already by an anti-join; its own folder is replaced if the batch is repeated.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        turns = batch.where("role = 'user'").select(F.concat_ws("-", "session_id", "message_id").alias("turn_id"), "user_id", "content")
        found = extract_candidates(turns, most, signals).dropDuplicates(["user_id", "content"])
        log = _log(batch.sparkSession, table, batch_id)
        if log is not None:
            found = found.join(log.select("user_id", "content").distinct(), ["user_id", "content"], "left_anti")
        found.select("turn_id", "user_id", "content", "importance", "confidence", "memory_type", "tags").write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    return messages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

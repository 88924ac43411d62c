"""Whole session state in a stream: goal, step, constraints, last results and updates, with a time to live."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragmill.operators.memory import ACTION, CONSTRAINT

#: kind is message (role and content), result (content) or update (content is the new pinned goal).
EVENT = "session_id string, event_id string, kind string, role string, content string, created_at timestamp"
#: status: active, expired (the state is gone), or rejected (an update of a session that is not known).
STATE = "session_id string, status string, current_goal string, current_step string, constraints array<string>, results array<string>, updated_at timestamp, rejected_id string"
_PICK = "at long, id string, text string"


class WholeState(StatefulProcessor):
    """State of one session that does not depend on the order its events come in, or on how often.

    Each part keeps the (time, event_id) that it is from: the goal the first, the step and the update the last, a constraint
    its first use, results the last ``most`` by time. So a late row takes its place as if it had come in time, and a repeated
    one changes nothing. Sessions are known from the table of first states or by a message; a timer of event time ends a
    session ``ttl_ms`` after its last event.
    """

    def __init__(self, most: int = 8, ttl_ms: int = 30 * 86_400_000, action: str = ACTION, constraint: str = CONSTRAINT):
        self.most, self.ttl, self.action, self.constraint = most, ttl_ms, action, constraint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last long, timer long")
        self.goal, self.step, self.update = (handle.getValueState(x, _PICK) for x in ("goal", "step", "update"))
        self.constraints = handle.getMapState("constraints", "phrase string", "at long, id string")
        self.results = handle.getListState("results", _PICK)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        at = int(initialState["at"].iloc[0])
        self.known.update((at, 0))
        goal = initialState["current_goal"].iloc[0]
        if goal:
            self.goal.update((at, "", goal))

    def _late(self, at: int) -> None:
        """The session lives ``ttl_ms`` after its last event."""
        last, timer = self.known.get() or (0, 0)
        if at > last or not timer:
            last = max(at, last)
            if timer:
                self.handle.deleteTimer(timer)
            timer = last // 1000 + self.ttl
            self.handle.registerTimer(timer)
            self.known.update((last, timer))

    def _message(self, new: tuple[int, str, str]) -> None:
        at, id_, content = new
        q = " ".join(content.split())
        goal, step = self.goal.get(), self.step.get()
        if goal is None or (at, id_) < (goal[0], goal[1]):
            self.goal.update((at, id_, q[:60]))
        if re.search(self.action, q) and (step is None or (at, id_) > (step[0], step[1])):
            self.step.update((at, id_, q[:50]))
        found = re.search(self.constraint, content)
        phrase = found[0].strip() if found else ""
        if phrase:
            first = self.constraints.getValue((phrase,)) if self.constraints.containsKey((phrase,)) else None
            if first is None or (at, id_) < (first[0], first[1]):
                self.constraints.updateValue((phrase,), (at, id_))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rejected, results = [], None
        for batch in rows:
            batch = batch.sort_values("kind")  # messages make a session known before its updates are looked at
            for id_, kind, role, content, time in zip(batch["event_id"], batch["kind"], batch["role"], batch["content"], batch["created_at"]):
                at, content = pd.Timestamp(time).value // 1000, content or ""
                if kind == "update":
                    if not self.known.exists():
                        rejected.append(id_)
                        continue
                    held = self.update.get()
                    if held is None or (at, id_) > (held[0], held[1]):
                        self.update.update((at, id_, content))
                elif kind == "result":
                    results = {r[1]: tuple(r) for r in self.results.get()} if results is None else results
                    results[id_] = (at, id_, content)
                elif role == "user":
                    self._message((at, id_, content))
                self._late(at)
        if results is not None:
            self.results.put(sorted(results.values())[-self.most :])
        if self.known.exists():
            yield self._row(key, "active")
        for id_ in rejected:
            yield pd.DataFrame({"session_id": [key[0]], "status": ["rejected"], "current_goal": [None], "current_step": [None], "constraints": [None], "results": [None], "updated_at": [None], "rejected_id": [id_]})

    def _row(self, key, status: str) -> pd.DataFrame:
        goal, step, update = self.goal.get(), self.step.get(), self.update.get()
        phrases = sorted((tuple(v), k[0]) for k, v in self.constraints.iterator())
        at = pd.Timestamp(self.known.get()[0] * 1000)
        return pd.DataFrame(
            {"session_id": [key[0]], "status": [status], "current_goal": [update[2] if update else goal[2] if goal else None], "current_step": [step[2] if step else None], "constraints": [[p for _, p in phrases]], "results": [[r[2] for r in self.results.get()]], "updated_at": [at], "rejected_id": [None]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            yield self._row(key, "expired")
            for state in (self.known, self.goal, self.step, self.update, self.constraints, self.results):
                state.clear()

    def close(self) -> None:
        pass


def whole_state_stream(events: DataFrame, sessions: DataFrame | None = None, lateness: str = "1 day", **params) -> DataFrame:
    """A stream of STATE rows: one for each session that a batch touches, for each that ends, and for each rejected update.

    ``events`` has the columns of EVENT; rows later than the watermark are dropped by Spark. ``sessions`` (session_id,
    current_goal, updated_at), a table, gives the states that are there before. The last row of a session is its state, the
    rejected ones are the side output. Needs the RocksDB state store.
    """
    e = events.where("session_id is not null").withWatermark("created_at", lateness).groupBy("session_id")
    first = None
    if sessions is not None:
        first = sessions.select("session_id", "current_goal", F.unix_micros("updated_at").alias("at")).groupBy("session_id")
    return e.transformWithStateInPandas(WholeState(**params), STATE, "Update", "EventTime", first)

"""Keyed streaming state: the ingest-job state machine and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sextant.settings import DEFAULTS, Settings

# --- fixed values: states, decisions and the retry rule ---
PROCESSING, SUCCEEDED, FAILED, RETRY = "processing", "succeeded", "failed", "retry_waiting"
MAX_BACKOFF_SECONDS = 30
# --- end of fixed values ---

STATE = "status string, attempts int, updated_at long"


def backoff_seconds(attempts: int) -> int:
    return min(2 ** max(attempts - 1, 0), MAX_BACKOFF_SECONDS)


def next_state(state, kind: str, redelivered: bool, at: int, settings: Settings = DEFAULTS):
    """One transition: (state, event) to (state, decision, wait seconds).

    ``state`` is (status, attempts, updated_at in microseconds) or None. Events: deliver,
    ok, error, invalid. A delivery is processed when the job is new, waits for a retry or
    went stale; a fresh one is only run again when redelivered, without a new attempt.
    """
    stale = settings.ingest_stale_seconds * 1_000_000
    if kind == "deliver":
        if state is None:
            return (PROCESSING, 1, at), "process", 0
        status, attempts, updated = state
        if status in (SUCCEEDED, FAILED):
            return state, f"skip_{status}", 0
        if status == RETRY or updated <= at - stale:
            return (PROCESSING, attempts + 1, at), "process", 0
        return state, ("rerun" if redelivered else "skip_processing"), 0
    if state is None or state[0] != PROCESSING:
        return state, "ignored", 0
    attempts = state[1]
    if kind == "ok":
        return (SUCCEEDED, attempts, at), "complete", 0
    if kind == "invalid" or attempts >= settings.ingest_max_retries:
        return (FAILED, attempts, at), "dead_letter", 0
    return (RETRY, attempts, at), "retry", backoff_seconds(attempts)


def job_decisions(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Decisions of a stream (or table) of job events.

    ``events``: job_key, seq, kind, redelivered, at (microseconds). Within a micro-batch
    the events of a job are taken in ``seq`` order; the state lives in the state store.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, kind, redelivered, at in zip(rows["seq"], rows["kind"], rows["redelivered"], rows["at"]):
            current, decision, wait = next_state(current, kind, bool(redelivered), int(at), settings)
            attempts = current[1] if current else 0
            out.append((key[0], int(seq), decision, attempts, wait))
        if current is not None:
            state.update((current[0], int(current[1]), int(current[2])))
        yield pd.DataFrame(out, columns=["job_key", "seq", "decision", "attempts", "wait_seconds"])

    return events.groupBy("job_key").applyInPandasWithState(
        run,
        "job_key string, seq long, decision string, attempts int, wait_seconds int",
        STATE,
        "append",
        GroupStateTimeout.NoTimeout,
    )


def stream_rate_limit(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Streaming form of the rate limit: (key, event_id, at in microseconds) to allowed."""
    length = seconds * 1_000_000

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = tuple(state.get) if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            if start is None or at >= start + length:
                start, count = int(at), 0
            count += 1
            allowed.append(count <= limit)
        state.update((start, count))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.groupBy("key").applyInPandasWithState(
        run, "key string, event_id long, allowed boolean", "start long, count long", "append", GroupStateTimeout.NoTimeout
    )

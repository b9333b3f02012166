"""Windows anchored at a key's first event: rate limits and answer reuse.

A window opens at the first event of a key, lasts a fixed time, and the next one opens
at the first event after it ended. The chain is sequential, so a long key is cut into
time chunks: each chunk is summarised as a step function (when the running window ends
before the chunk -> when it ends after it), the functions of a key are composed, and
every chunk is then resolved on its own. No task holds more than one chunk of events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.ranking import top_per_group

CHUNK_WINDOWS = 64
#: Events that a group of keys holds on average.
GROUP_ROWS = 50_000


def window_starts(times: np.ndarray, length: int, deadline: int) -> np.ndarray:
    """Window start of each event time (rising order); ``deadline`` ends the running window.

    Events before the deadline belong to the running window and get deadline - length.
    """
    starts = np.empty(len(times), dtype=np.int64)
    at = int(np.searchsorted(times, deadline))
    starts[:at] = deadline - length
    while at < len(times):
        stop = int(np.searchsorted(times, times[at] + length))
        starts[at:stop] = times[at]
        at = stop
    return starts


def _slices(*keys: np.ndarray) -> list[slice]:
    """Runs of rows with equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(new)))]


def _summarise(length: int, chunk: int):
    def one(times: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        after = np.searchsorted(times, times + length)
        exits = np.empty(len(times), dtype=np.int64)
        for i in range(len(times) - 1, -1, -1):
            exits[i] = times[i] + length if after[i] == len(times) else exits[after[i]]
        # a window running into the chunk ends within one length of the chunk's start
        reach = min(int(np.searchsorted(times, number * chunk + length)) + 1, len(times))
        bounds, ends = times[:reach], exits[:reach]
        last_of_run = np.append(ends[1:] != ends[:-1], True)
        return bounds[last_of_run], ends[last_of_run]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "chunk", "t"])
        keys, numbers, times = (pdf[c].to_numpy() for c in ("key", "chunk", "t"))
        parts = _slices(keys, numbers)
        steps = [one(times[p], int(numbers[p.start])) for p in parts]
        firsts = [p.start for p in parts]
        return pd.DataFrame(
            {"key": keys[firsts], "chunk": numbers[firsts], "bounds": [b for b, _ in steps], "ends": [e for _, e in steps]}
        )

    return summarise


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "chunk"])
    entries = []
    for part in _slices(pdf["key"].to_numpy()):
        deadline = np.iinfo(np.int64).min // 2
        for bounds, ends in zip(pdf["bounds"].iloc[part], pdf["ends"].iloc[part]):
            entries.append(deadline)
            at = int(np.searchsorted(bounds, deadline))
            deadline = int(ends[at]) if at < len(bounds) else deadline
    return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "deadline": entries})


def _resolve(length: int):
    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "chunk", "t"])
        times, deadlines = pdf["t"].to_numpy(), pdf["deadline"].to_numpy()
        parts = _slices(pdf["key"].to_numpy(), pdf["chunk"].to_numpy())
        starts = [window_starts(times[p], length, int(deadlines[p.start])) for p in parts]
        return pd.DataFrame({"key": pdf["key"], "t": times, "window_start": np.concatenate(starts)})

    return resolve


def anchored_windows(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Events with the start (in microseconds) of the window each one falls into; those without a key go.

    Most keys have few events, so a Python group holds the chunks of many keys.
    """
    length = seconds * 1_000_000
    chunk = length * CHUNK_WINDOWS
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    timed = events.withColumn("__t", micros)
    groups = max(1, -(-events.count() // GROUP_ROWS))
    # equal times of a key are one point
    points = (
        timed.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("__t").alias("t")).distinct()
        .withColumn("chunk", F.floor(F.col("t") / chunk).cast("long"))
    )
    kind = points.schema["key"].dataType.simpleString()

    def grouped(rows: DataFrame, *keys: str):
        return rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("group"))

    summary = grouped(points, "key", "chunk").applyInPandas(
        _summarise(length, chunk), f"key {kind}, chunk long, bounds array<long>, ends array<long>"
    )
    entries = grouped(summary, "key").applyInPandas(_compose, f"key {kind}, chunk long, deadline long")
    starts = grouped(points.join(entries, ["key", "chunk"]), "key", "chunk").applyInPandas(
        _resolve(length), f"key {kind}, t long, window_start long"
    )
    return timed.join(
        starts, (timed[key].eqNullSafe(starts["key"])) & (timed["__t"] == starts["t"])
    ).drop("key", "t", "__t")


def rate_limit(events: DataFrame, key: str, time: str, event_id: str, seconds: int, limit: int) -> DataFrame:
    """Events with ``allowed``: whether they are among the first ``limit`` of their window.

    Rejected events count as well. Only the allowed ones are ranked, so a burst is cut
    before it is shuffled.
    """
    windows = anchored_windows(events, key, time, seconds)
    first = top_per_group(
        windows.select(key, "window_start", time, event_id), [key, "window_start"], [F.col(time), F.col(event_id)], limit
    ).select(event_id, F.lit(True).alias("allowed"))
    return windows.join(first, event_id, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def answer_reuse(requests: DataFrame, key: str, time: str, event_id: str, seconds: int, bypass: str | None = None) -> DataFrame:
    """Requests with ``reused`` and the id of the request whose answer they got.

    The first request of a window is answered and kept for ``seconds``; the others reuse
    it. Requests flagged ``bypass`` are answered anew and keep nothing.
    """
    cached = requests if bypass is None else requests.filter(~F.col(bypass))
    windows = anchored_windows(cached, key, time, seconds)
    owners = windows.groupBy(key, "window_start").agg(F.min_by(event_id, F.struct(time, event_id)).alias("answered_by"))
    out = windows.join(owners, [key, "window_start"]).withColumn("reused", F.col("answered_by") != F.col(event_id))
    if bypass is not None:
        direct = requests.filter(F.col(bypass)).withColumn("answered_by", F.col(event_id)).withColumn("reused", F.lit(False))
        out = out.drop("window_start").unionByName(direct)
        return out
    return out.drop("window_start")

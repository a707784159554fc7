"""Structured Streaming jobs: the request queue and calendar periods with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE, KEEP_DAYS = 1800, 7
QUEUE = "record_id string, state string, requested_at timestamp, claimed_at timestamp, hint string, changes long"
_STATE = "state string, requested_at timestamp, claimed_at timestamp, hint string, changes long"


def queue_state(changes: DataFrame) -> DataFrame:
    """Latest state of each request from its change rows (record_id, at, state), for batch and stream alike."""
    return changes.groupBy("record_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"), F.count("*").alias("changes"))


def advanced(now: tuple | None, events: list[tuple]) -> tuple:
    """State (state, requested_at, claimed_at, hint, changes) after events (at, kind, hint) in order of time.

    request: a result or nothing becomes requested; a waiting one gains the hint; one
    in flight stays.  claim: a waiting one is claimed, and one whose lease has run
    out.  result: it is settled.
    """
    state, requested, claimed, hint, n = now or (None, None, None, None, 0)
    for at, kind, note in sorted(events, key=lambda e: (e[0], e[1], e[2] or "")):
        n += 1
        stale = state == "claimed" and (at - claimed).total_seconds() > LEASE
        if kind == "request" and state == "requested":
            hint = "; ".join(x for x in (hint, note) if x) or None
        elif kind == "request" and (state in (None, "result") or stale):
            state, requested, claimed, hint = "requested", requested if stale else at, None, note if not stale else hint
        elif kind == "claim" and (state == "requested" or stale):
            state, claimed = "claimed", at
        elif kind == "result" and state == "claimed":
            state, claimed = "result", at
    return state, requested, claimed, hint, n


def queue_stream(events: DataFrame) -> DataFrame:
    """Rows of QUEUE whenever a request changes, from a stream of events (record_id, at, kind, hint)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = [(r.at, r.kind, r.hint) for b in batches for r in b.itertuples()]
        clean = [None if x is None or x is pd.NaT or x != x else x for x in held.get] if held.exists else None
        now = advanced(tuple(clean) if clean else None, rows)
        held.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["record_id", "state", "requested_at", "claimed_at", "hint", "changes"])

    return events.groupBy("record_id").applyInPandasWithState(step, QUEUE, _STATE, "update", GroupStateTimeout.NoTimeout)


def period_counts(events: DataFrame, time_col: str, period: Column, key: str, late: str = "7 days") -> DataFrame:
    """Counts by day, period and key; a stream drops rows that come later than the watermark."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    return rows.groupBy(F.window(time_col, "1 day").alias("w"), period.alias("period"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "period", key, "n")


def attest_stream(listing: DataFrame, late: str = "1 hour") -> DataFrame:
    """First sight of each (path, size, mtime) in a stream of listings (path, size, mtime, at): only these need hashing."""
    return listing.withWatermark("at", late).dropDuplicatesWithinWatermark(["path", "size", "mtime"])

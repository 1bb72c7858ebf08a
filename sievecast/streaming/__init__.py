"""Structured Streaming: agent sessions as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "session_id string, seq long, turn int, active long, resolved long, report string"
_STATE = "turn int, preamble boolean, active array<string>, resolved array<string>, pending boolean"
#: A session without an event for so long may be given up.
IDLE_MS = 6 * 3600 * 1000
PREAMBLE = "Diagnostics of your last edits follow."


def _one(key: tuple[str], rows: Iterator[pd.DataFrame], state, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """One session's events in the order of seq. Emits a report at each ``context`` that has something pending."""
    if state.hasTimedOut:
        state.remove()
        return
    events = pd.concat(list(rows)).sort_values("seq")
    ended = False
    turn, said, active, resolved, pending = state.get if state.exists else (0, False, [], [], False)
    active, resolved, out = dict.fromkeys(active), list(resolved), []
    for e in events.itertuples(index=False):
        ended = e.kind == "session_end"
        if e.kind in ("session_start", "session_end"):
            turn, said, active, resolved, pending = 0, False, {}, [], False
        elif e.kind == "tool_execution_end":
            own = {i for i in active if i.split("|", 1)[0] == e.file_path}
            now = {f"{e.file_path}|{i}" for i in e.ids}
            gone = sorted(own - now)
            active = {i: None for i in active if i not in own} | dict.fromkeys(sorted(now))
            resolved = [i for i in resolved if i not in now] + gone
            pending = pending or bool(now or gone)
        elif e.kind == "turn_end":
            turn += 1
        elif e.kind == "context" and pending:
            text = f"Active: {len(active)}, resolved: {len(resolved)}"
            out.append((key[0], e.seq, turn, len(active), len(resolved), text if said else f"{PREAMBLE}\n{text}"))
            said, pending, resolved = True, False, []
    if ended:
        state.remove()
    else:
        state.update((turn, said, list(active), resolved, pending))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=["session_id", "seq", "turn", "active", "resolved", "report"])


def session_reports(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Events (session_id, seq, kind, file_path, ids) of a stream -> one report for each ``context`` after a change.

    State is kept by session and bounded by its open diagnostics; a session's resolved ones go with the
    report that names them. Events of one micro-batch are taken in the order of seq. The state of a session
    goes when it ends, and with ``idle_ms`` (IDLE_MS suits) also after so long without an event, for which the
    query then looks at every trigger.
    """
    run = lambda key, rows, state: _one(key, rows, state, idle_ms)
    return events.groupBy("session_id").applyInPandasWithState(run, SCHEMA, _STATE, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events with a timestamp by window and kind; late ones are dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")

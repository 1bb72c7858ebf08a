"""An agent's session as one state machine: snapshots, changed files, the lint queue, open diagnostics and the pending report."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an event has: kinds are session_start, tool_call, tool_execution_end, turn_end, context and session_end.
EVENT = "session_id string, seq long, kind string, tool_name string, file_path string, content string, command string, found array<struct<file_path:string,id:string>>"
ACTION = "session_id string, seq long, turn int, action string, file_path string, content string, active long, resolved long, first boolean"
#: Shell commands that edit files in place.
IN_PLACE = re.compile(r"\b(sed|perl|awk|ed)\b.*-i\b")
_COLUMNS = [c.split()[0] for c in ACTION.split(", ")]


class Session:
    """A session's state in memory, and what each event makes of it. Maps keep the order of their keys out of results."""

    def __init__(self, turn: int = 0, said: bool = False, changing: bool = False, pending: bool = False):
        self.turn, self.said, self.changing, self.pending = turn, said, changing, pending
        self.snapshots: dict[str, str] = {}
        self.changed: set[str] = set()
        self.queue: set[str] = set()
        self.open: dict[str, str] = {}
        self.resolved: set[str] = set()

    def take(self, e) -> list[tuple]:
        """The actions of one event: (action, file, content, active, resolved, first)."""
        kind, out = e.kind, []
        if kind in ("session_start", "session_end"):
            self.__init__()
        elif kind == "tool_call":
            if e.tool_name in ("edit", "write"):
                self.changing = True
                if isinstance(e.file_path, str):
                    self.changed.add(e.file_path)
                    if e.file_path not in self.snapshots:
                        self.snapshots[e.file_path] = e.content if isinstance(e.content, str) else ""
                        out.append(("snapshot", e.file_path, self.snapshots[e.file_path], None, None, None))
            elif e.tool_name == "bash" and isinstance(e.command, str) and IN_PLACE.search(e.command):
                self.changing = True
        elif kind == "tool_execution_end":
            if not self.changing:
                for f in sorted(set(self.snapshots) - self.changed):
                    del self.snapshots[f]
                    out.append(("stale", f, None, None, None, None))
                return out
            self.changing = False
            now = {x["id"]: x["file_path"] for x in (e.found if e.found is not None else ())}
            gone = {i for i, f in self.open.items() if f in self.changed and i not in now}
            self.open = {i: f for i, f in self.open.items() if i not in gone} | now
            self.resolved = (self.resolved | gone) - set(now)
            self.queue |= self.changed
            self.changed.clear()
            self.pending = bool(self.open or self.resolved)
        elif kind == "turn_end":
            if self.queue or self.changed:
                out += [("lint", f, None, None, None, None) for f in sorted(self.queue | self.changed)]
                self.pending = bool(self.open or self.resolved)
                self.queue.clear()
                self.changed.clear()
            self.snapshots.clear()
            self.turn += 1
        elif kind == "context" and self.pending:
            out.append(("report", None, None, len(self.open), len(self.resolved), not self.said))
            self.pending, self.said = False, True
            self.resolved.clear()
        return out


class SessionProcessor(StatefulProcessor):
    """Keeps each session in keyed state: a value for its flags, and maps by file or diagnostic, of which only what an event changes is written."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", "turn int, said boolean, changing boolean, pending boolean")
        self.maps = {name: handle.getMapState(name, "name string", "value string") for name in ("snapshots", "changed", "queue", "open", "resolved")}

    def _load(self) -> Session:
        flags = self.flags.get()
        s = Session(*flags) if flags is not None else Session()
        for name, state in self.maps.items():
            held = {k[0]: v[0] for k, v in state.iterator()}
            setattr(s, name, held if name in ("snapshots", "open") else set(held))
        return s

    def _store(self, before: dict[str, dict], s: Session) -> None:
        self.flags.update((s.turn, s.said, s.changing, s.pending))
        for name, state in self.maps.items():
            held = getattr(s, name)
            now, old = held if isinstance(held, dict) else dict.fromkeys(held, ""), before[name]
            for k in old.keys() - now.keys():
                state.removeKey((k,))
            for k, v in now.items():
                if old.get(k) != v:
                    state.updateValue((k,), (v,))

    def _clear(self) -> None:
        self.flags.clear()
        for state in self.maps.values():
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        before = {n: dict(getattr(s, n)) if isinstance(getattr(s, n), dict) else dict.fromkeys(getattr(s, n), "") for n in self.maps}
        out, ended = [], False
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            ended = e.kind == "session_end"
            turn = s.turn
            out += [(key[0], e.seq, turn, *a) for a in s.take(e)]
        if ended:
            self._clear()
        else:
            self._store(before, s)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        frame = pd.DataFrame(out, columns=_COLUMNS)
        yield frame.astype({"active": "Int64", "resolved": "Int64", "first": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        yield pd.DataFrame(columns=_COLUMNS)

    def close(self) -> None:
        pass


def session_actions(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Events (columns of EVENT) of a stream or a table -> what a session does at them (columns of ACTION).

    * ``snapshot``: a file as it was before the first edit since the last turn's end;
    * ``stale``: a snapshot that a turn left behind, dropped by the next tool that changes nothing, so that the next
      edit takes a fresh one;
    * ``lint``: at a turn's end, each file that was edited in it, once, whatever became of its edits' own checks;
    * ``report``: at a context after a change, with how many diagnostics are open and were resolved since the last one.

    ``found`` of a tool's end are the diagnostics of the files that it changed; open ones of these files that are
    not among them are resolved. A session starts from nothing at session_start, and its state goes at session_end or,
    with ``idle_ms``, by a timer after so long without an event. State is bounded by the files of a turn and the open
    diagnostics. Events of a micro-batch are taken by seq; ones that come in a later batch count as later. Null
    paths, contents and lists count as none. A stream needs the RocksDB state store.
    """
    if events.isStreaming:
        provider = events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
        if "RocksDB" not in provider:
            raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")
    else:
        events.sparkSession.streams.active  # noqa: B018  a batch finds its state stores only once a session has looked at its streams
    columns = [c.split()[0] for c in EVENT.split(", ")]
    grouped = events.select(*columns).groupBy("session_id")
    return grouped.transformWithStateInPandas(SessionProcessor(idle_ms), ACTION, "Append", "ProcessingTime" if idle_ms else "None")

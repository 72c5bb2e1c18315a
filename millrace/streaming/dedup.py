"""Stateful admission of streams: first wins by key with time to live, singly or by group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TtlAdmission(StatefulProcessor):
    """Rows (t, sequence) of one key: allowed from the winner's expiry on, else duplicates of the winner; force renews."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "until long, winner long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["t", "sequence"], kind="stable")
        until, winner = self.held.get() if self.held.exists() else (None, None)
        out = []
        for t, s, forced in zip(data["t"].tolist(), data["sequence"].tolist(), data["force"].tolist()):
            if forced or until is None or t >= until:
                until, winner = t + self.ttl, s
                out.append((s, "allow", s))
            else:
                out.append((s, "duplicate", winner))
        self.held.update((until, winner))
        yield pd.DataFrame(out, columns=["sequence", "decision", "winner"])

    def close(self) -> None:
        pass


class GroupAdmission(StatefulProcessor):
    """Rows (t, sequence, identity) of one group: an identity is admitted once; a new member renews the whole group."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long")
        self.members = handle.getMapState("members", "identity string", "winner long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["t", "sequence"], kind="stable")
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for t, s, who in zip(data["t"].tolist(), data["sequence"].tolist(), data["identity"].tolist()):
            if until is not None and t >= until:
                self.members.clear()
            if self.members.containsKey((who,)):
                out.append((s, "duplicate", self.members.getValue((who,))[0]))
            else:
                self.members.updateValue((who,), (s,))
                until = t + self.ttl
                out.append((s, "allow", s))
        if until is not None:
            self.until.update((until,))
        yield pd.DataFrame(out, columns=["sequence", "decision", "winner"])

    def close(self) -> None:
        pass


_OUT = "sequence long, decision string, winner long"


def admit_stream(rows: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Decisions of a stream with the columns t, sequence (long) and force (boolean); the clock is the column t.

    Needs the RocksDB state store (PROVIDER).
    """
    return rows.groupBy(*keys).transformWithStateInPandas(TtlAdmission(ttl), _OUT, "Append", "None")


def admit_group_stream(rows: DataFrame, group: list[str], ttl: int) -> DataFrame:
    """Decisions of a stream with the columns t, sequence (long) and identity (string), by group."""
    return rows.groupBy(*group).transformWithStateInPandas(GroupAdmission(ttl), _OUT, "Append", "None")

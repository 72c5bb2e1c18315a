"""What can be put in: the parts of an inlet and an outlet, by what is asked of them."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from .signals import Snapshot


@runtime_checkable
class Decoder(Protocol):
    """rows with is_poison and type, from their column value."""

    def __call__(self, rows: DataFrame, value_col: str = "value", exact: bool = True) -> DataFrame: ...


@runtime_checkable
class Encoder(Protocol):
    """The text of a record's data as a value of the wire."""

    def __call__(self, data: Column, kind: str, received_at: Column, source: str, version: str | None = None) -> Column: ...


@runtime_checkable
class Admission(Protocol):
    """Decisions (sequence, decision, via, summary, retry_after) on rows (key, identity, summary, t, sequence, force), remembered."""

    guarantee: str

    def admit(self, rows: DataFrame, batch: int | None = None, run: str = "") -> DataFrame: ...

    def renew(self, rows: DataFrame) -> None: ...


@runtime_checkable
class Backpressure(Protocol):
    """Whether the inlet is to refuse."""

    def snapshot(self) -> Snapshot: ...


@runtime_checkable
class Targets(Protocol):
    """Tables that a batch is upserted into at once."""

    def apply(self, batch: int, sources: dict, run: str = "") -> dict[str, int]: ...

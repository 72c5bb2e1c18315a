"""Upserts as a consumer's handler."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators.dedup import collapse_last
from ..operators.upsert import Upsert, VersionedTargets, key_missing
from ..plans.options import ConsumerOptions
from ..sources.sinks import SqlTargets
from .pipeline import Consumer, Context


def upsert_handler(targets: VersionedTargets | SqlTargets, upserts: list[Upsert], order: tuple[str, ...] = ("partition", "offset")) -> Callable[[DataFrame, Context], None]:
    """handler(rows, context) that upserts a batch into all targets at once, the last row of a key by `order`.

    A target's prepare must keep the columns of `order`.  A missing key is a
    ValueError, so it is poison, and then no target is changed.  A batch that was
    committed before changes nothing.
    """

    def handler(rows: DataFrame, context: Context) -> None:
        sources = {}
        for u in upserts:
            ready = u.prepare(rows) if u.prepare else rows
            if not ready.where(key_missing(ready, list(u.keys))).isEmpty():
                raise ValueError(f"a key of {u.name} is missing")
            last = collapse_last(ready, list(u.keys), list(order))
            sources[u.name] = (replace(u, prepare=None).project(last), u.stored_keys, None)
        targets.apply(context.batch, sources, context.run)

    return handler


def upsert_consumer(targets: VersionedTargets | SqlTargets, upserts: list[Upsert], options: ConsumerOptions | None = None, **overrides) -> Consumer:
    """A Consumer that upserts; overrides replace single options."""
    return Consumer(upsert_handler(targets, upserts), (options or ConsumerOptions()).merged(**overrides))

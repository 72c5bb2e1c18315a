"""Health reports of an inlet and an outlet, and the life cycle of the parts around a query."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from .observe import Meter

log = logging.getLogger("millrace")


def part_ok(part: object | None) -> bool | None:
    """None without a part; a part that has no check_health is well; one whose check raises isn't."""
    if part is None:
        return None
    check = getattr(part, "check_health", None)
    if check is None:
        return True
    try:
        return bool(check())
    except Exception:
        log.debug("health_check_failed", exc_info=True)
        return False


def query_ok(query) -> bool:
    """Whether a streaming query runs and has met no error."""
    return query is not None and query.isActive and query.exception() is None


def _linked(ok: bool | None) -> str | None:
    return None if ok is None else "connected" if ok else "disconnected"


def _rate(meters: dict[str, Meter] | None, name: str) -> float:
    return meters[name].per_second() if meters else 0.0


def inlet_report(kafka: bool, cache: bool | None, backfill: bool | None, meters: dict[str, Meter] | None = None) -> dict:
    """healthy only if the broker, the cache and the backfill all are; a part that is missing isn't."""
    said = [bool(x) for x in (kafka, cache, backfill)]
    found = {"status": "healthy" if all(said) else "degraded"} | dict(zip(("kafka", "cache", "backfill"), map(_linked, said)))
    found["timestamp"] = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
    rates = {"push_rate": "received", "duplicate_rate": "duplicate", "backpressure_reject_rate": "backpressure_rejected", "reject_rate": "rejected", "produce_success_rate": "produce_success", "produce_failure_rate": "produce_failure"}
    found |= {k: _rate(meters, name) for k, name in rates.items()}
    latency = meters["produce_latency"] if meters else None
    return found | {"produce_latency_ms_avg": latency.mean() if latency else 0.0, "produce_latency_ms_max": latency.most() if latency else 0.0}


def outlet_report(
    kafka: bool,
    outlet: bool | None = None,
    cache: bool | None = None,
    paused: bool = False,
    pending: int = 0,
    lag: int = 0,
    quarantined: int = 0,
    oldest: float | None = None,
    meters: dict[str, Meter] | None = None,
    now: float | None = None,
) -> dict:
    """healthy unless paused, or the broker or a part that is there fails; a missing part is passed over.

    oldest is the epoch second of the oldest row not yet handled.  An HttpProbe
    reads status, kafka and backlog_age_seconds of this report.
    """
    well = kafka and not paused and outlet is not False and cache is not False
    found = {"status": "healthy" if well else "degraded", "kafka": _linked(bool(kafka)), "outlet": _linked(outlet), "cache": _linked(cache)}
    found |= {"pending_count": pending, "lag": lag, "quarantined_count": quarantined, "paused": paused}
    found["backlog_age_seconds"] = None if oldest is None else (time.time() if now is None else now) - oldest
    rates = {"consume_rate": "consumed", "handle_rate": "handled", "handle_failure_rate": "handle_failed", "retry_rate": "retries"}
    found |= {k: _rate(meters, name) for k, name in rates.items()}
    latency = meters["handle_latency"] if meters else None
    return found | {"handle_latency_ms_avg": latency.mean() if latency else 0.0, "handle_latency_ms_max": latency.most() if latency else 0.0}


@contextmanager
def running(*parts: object | None) -> Iterator[None]:
    """Start the parts in order and close those begun in the reverse one; parts without start or close are passed over.

    A part that fails to start is logged and the rest go on; a part that fails to close never keeps another open.
    """
    begun = []
    try:
        for part in parts:
            if part is None:
                continue
            begun.append(part)
            try:
                if hasattr(part, "start"):
                    part.start()
            except Exception:
                log.error("startup_failed_degraded", exc_info=True)
        yield
    finally:
        for part in reversed(begun):
            try:
                if hasattr(part, "close"):
                    part.close()
            except Exception:
                log.warning("cleanup_error", exc_info=True)

"""Backpressure signals: what tells the inlet to refuse records, and the probe that one of them follows."""

from __future__ import annotations

import json
import logging
import threading
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from ..operators.flow import next_reason
from ..plans.options import BackpressureConfig
from .observe import emit

log = logging.getLogger("millrace")

#: Seconds between two probes while records are refused, and while they are taken.
REFUSING_WAIT, OPEN_WAIT = 5.0, 30.0


@dataclass(frozen=True)
class Snapshot:
    rejecting: bool = False
    reason: str | None = None
    retry_after: int | None = None


@dataclass(frozen=True)
class ProbeResult:
    """What an outlet says of itself: its status, its broker's state, its backlog's age in seconds, its rows and its lag."""

    status: str
    kafka: str
    age: float | None = None
    pending: int = 0
    lag: int = 0


class AlwaysOpen:
    def snapshot(self) -> Snapshot:
        return Snapshot()


class Manual:
    """Refuses or takes as it was last told."""

    def __init__(self, retry_after: int = 60):
        self._retry_after, self._now = retry_after, Snapshot()

    def set(self, rejecting: bool, reason: str | None = "manual") -> None:
        self._now = Snapshot(True, reason, self._retry_after) if rejecting else Snapshot()

    def snapshot(self) -> Snapshot:
        return self._now


class HttpProbe:
    """GET of an outlet's health as JSON, after 1 + retries tries at a fixed interval; whatever goes wrong gives None.

    A report that says nothing of the broker has it connected.
    """

    def __init__(self, url: str, timeout: float = 2.0, retries: int = 0, pause: float = 1.0, fetch: Callable[[str, float], bytes] | None = None):
        self.url, self.timeout, self.tries, self.pause = url, timeout, 1 + max(0, retries), pause
        self.fetch = fetch or self._get

    @staticmethod
    def _get(url: str, timeout: float) -> bytes:
        with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
            return reply.read()

    def once(self) -> ProbeResult | None:
        try:
            said = json.loads(self.fetch(self.url, self.timeout))
            age = said.get("backlog_age_seconds")
            counts = (int(said.get(k) or 0) for k in ("pending_count", "lag"))
            return ProbeResult(str(said.get("status", "")), str(said.get("kafka", "connected")), None if age is None else float(age), *counts)
        except Exception:
            log.debug("probe_failed", exc_info=True)
            return None

    def __call__(self) -> ProbeResult | None:
        for k in range(self.tries):
            if (found := self.once()) is not None:
                return found
            if k + 1 < self.tries:
                time.sleep(self.pause)
        return None


class ProbeSignal:
    """Follows a probe by the transitions of flow.hysteresis; polls more often while it refuses.

    A probe that raises counts as unreachable.  start() polls in a thread of its
    own until close(); poll() does one step where the caller keeps time.
    """

    def __init__(self, probe: Callable[[], ProbeResult | None], config: BackpressureConfig | None = None, state_ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.probe, self.config, self.clock = probe, config or BackpressureConfig(), clock
        self._reason: str | None = None
        self._since: float | None = None
        self._stop, self._thread = threading.Event(), None
        for what in self.config.warnings(state_ttl):
            log.warning(what)

    def snapshot(self) -> Snapshot:
        reason = self._reason
        return Snapshot() if reason is None else Snapshot(True, reason, self.config.retry_after)

    @property
    def wait(self) -> float:
        return OPEN_WAIT if self._reason is None else REFUSING_WAIT

    def take(self, found: ProbeResult | None) -> Snapshot:
        c, before, now = self.config, self._reason, self.clock()
        said = (False, None, None, None) if found is None else (True, found.status, found.kafka, found.age)
        self._reason = next_reason(before, *said, c.trip_seconds, c.recover_seconds, c.fail_closed, c.any_degraded)
        if before is None and self._reason is not None:
            self._since = now
            emit(log, logging.ERROR, "backpressure_tripped", reason=self._reason)
        elif before is not None and self._reason is None:
            emit(log, logging.INFO, "backpressure_recovered", reason=before, seconds=now - self._since)
            self._since = None
        return self.snapshot()

    def poll(self) -> Snapshot:
        try:
            found = self.probe()
        except Exception:
            log.warning("backpressure_probe_failed", exc_info=True)
            found = None
        return self.take(found)

    def _loop(self) -> None:
        while not self._stop.is_set():
            self.poll()
            self._stop.wait(self.wait)

    def start(self) -> None:
        if self._thread is None:
            self._stop.clear()
            self._thread = threading.Thread(target=self._loop, name="millrace-probe", daemon=True)
            self._thread.start()

    def close(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join(timeout=5)
            self._thread = None

"""Structured log events, rate meters of a driver, and a listener that watches a query's backlog."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql.streaming import StreamingQueryListener

from ..plans.options import MetricsConfig
from ..sources.tables import lag_of

log = logging.getLogger("millrace")

#: Attributes of every log record, and those that formatters add; an event's fields can't have these names.
RESERVED = frozenset(vars(logging.makeLogRecord({}))) | {"asctime", "exc_text", "message", "taskName"}
#: Names that a log line has of its own.
BASE = ("timestamp", "level", "logger", "event")


def emit(logger: logging.Logger, level: int, event: str, **fields) -> None:
    """Log an event with fields; a field of a reserved name is an error."""
    clash = sorted(RESERVED & set(fields))
    if clash:
        raise ValueError(f"reserved field names: {', '.join(clash)}")
    logger.log(level, event, extra=fields)


class JsonLines(logging.Formatter):
    """A log record as one line of JSON: time in UTC, level, logger, event, then its fields, then its error."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc)
        own = (at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z", record.levelname, record.name, record.getMessage())
        more = {k: v for k, v in vars(record).items() if k not in RESERVED and k not in BASE}
        if record.exc_info:
            more["error"] = self.formatException(record.exc_info)
        return json.dumps(dict(zip(BASE, own)) | more, ensure_ascii=False, default=str)


class Meter:
    """Counts, sums and maxima by second over the last `window` seconds; bounded by the window whatever the rate."""

    def __init__(self, window: int = 60, clock: Callable[[], float] = time.monotonic):
        MetricsConfig(window)
        self.window, self.clock, self.began = window, clock, clock()
        self.seconds: dict[int, tuple[int, float, float]] = {}

    def add(self, n: int = 1, amount: float = 0.0) -> None:
        at = int(self.clock())
        count, total, most = self.seconds.get(at, (0, 0.0, float("-inf")))
        self.seconds[at] = (count + n, total + amount, max(most, amount))
        self._live()

    def _live(self) -> list[tuple[int, float, float]]:
        last = int(self.clock())
        self.seconds = {s: x for s, x in self.seconds.items() if last - self.window < s <= last}
        return list(self.seconds.values())

    def per_second(self) -> float:
        """Over the window, or the time since the start where that is shorter, a second at least."""
        n = sum(x[0] for x in self._live())
        return n / min(self.window, max(self.clock() - self.began, 1.0)) if n else 0.0

    def mean(self) -> float:
        live = self._live()
        n = sum(x[0] for x in live)
        return sum(x[1] for x in live) / n if n else 0.0

    def most(self) -> float:
        return max((x[2] for x in self._live()), default=0.0)


#: What an inlet and an outlet count.
INLET = ("received", "duplicate", "backpressure_rejected", "rejected", "produce_success", "produce_failure", "produce_latency")
OUTLET = ("consumed", "handled", "handle_failed", "retries", "handle_latency")


def meters(names: tuple[str, ...], window: int = 60, clock: Callable[[], float] = time.monotonic) -> dict[str, Meter]:
    return {name: Meter(window, clock) for name in names}


def level_of(age: float | None, ttl: float) -> str:
    """The rule of functions.scalars.backlog_level for one value on the driver; no age is ok."""
    if age is None or age <= ttl / 2:
        return "ok"
    return "error" if age > 0.8 * ttl else "warning"


class BacklogWatch(StreamingQueryListener):
    """Reads the lag off each progress report, and logs the age of the oldest row of a batch by its level.

    The age is that of the least event time that a report has (a watermark is
    needed for it); a query without one has no age.  Reports of other queries are
    passed over where a name is given.
    """

    def __init__(self, ttl: float, query: str | None = None, clock: Callable[[], float] = time.time):
        self.ttl, self.query, self.clock = ttl, query, clock
        self.lag, self.age, self.rows, self.failure = 0, None, 0, None

    def take(self, report: dict) -> str:
        """The level of one progress report."""
        try:
            self.lag = lag_of(report)
        except (TypeError, ValueError, AttributeError):
            log.debug("lag_refresh_skipped")
        oldest = (report.get("eventTime") or {}).get("min")
        self.age = self.clock() - datetime.fromisoformat(oldest.replace("Z", "+00:00")).timestamp() if oldest else None
        self.rows += report.get("numInputRows") or 0
        level = level_of(self.age, self.ttl)
        if self.age is not None:
            emit(log, {"ok": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR}[level], "backlog_age", age_seconds=self.age, lag=self.lag)
        return level

    def onQueryStarted(self, event) -> None:
        if self.query in (None, event.name):
            self.failure = None

    def onQueryProgress(self, event) -> None:
        if self.query in (None, event.progress.name):
            report = json.loads(event.progress.json)
            for source in report.get("sources", []):
                for k in ("latestOffset", "endOffset"):
                    if isinstance(source.get(k), str):
                        source[k] = json.loads(source[k])
            self.take(report)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failure = event.exception

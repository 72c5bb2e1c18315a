"""Validated settings.  Defaults are fixed values, the pipeline's documented ones; wrong values raise at construction."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

UNSET = object()


def _positive(**values) -> None:
    for name, v in values.items():
        if v <= 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class KafkaConfig:
    brokers: str
    request_timeout_ms: int = 10_000
    max_poll_records: int = 500
    starting_offsets: str = "earliest"
    group_id: str | None = None
    session_timeout_ms: int = 30_000
    max_poll_interval_ms: int = 300_000

    def __post_init__(self):
        _positive(request_timeout_ms=self.request_timeout_ms, max_poll_records=self.max_poll_records)
        parts = [re.sub(r"(?i)^(https?|kafka)://", "", p.strip()) for p in self.brokers.split(",")]
        cleaned = ",".join(p for p in parts if p)
        if not cleaned:
            raise ValueError("brokers must name at least one broker")
        object.__setattr__(self, "brokers", cleaned)

    @property
    def send_wait_seconds(self) -> float:
        return self.request_timeout_ms / 1000 + 5


@dataclass(frozen=True)
class BackpressureConfig:
    trip_seconds: float = 9000
    recover_seconds: float = 7200
    retry_after: int = 60
    fail_closed: bool = True
    any_degraded: bool = False
    probe_retries: int = 0

    def warnings(self, state_ttl: float | None = None) -> list[str]:
        """What is odd but allowed."""
        found = []
        if self.recover_seconds >= self.trip_seconds:
            found.append("recover is not less than trip")
        if self.probe_retries < 0:
            found.append("probe_retries is negative")
        if state_ttl is not None and self.trip_seconds >= state_ttl:
            found.append("trip is not less than the state's time to live")
        return found


@dataclass(frozen=True)
class MetricsConfig:
    window_seconds: int = 60

    def __post_init__(self):
        if not 1 <= self.window_seconds <= 600:
            raise ValueError("window must be 1 to 600 seconds")


@dataclass(frozen=True)
class DedupOptions:
    """Key columns of the identity, and of the group where admission is by group; off without keys."""

    keys: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    ttl_seconds: int | None = 18_000
    fail_closed: bool = True

    def __post_init__(self):
        if self.ttl_seconds is not None:
            _positive(ttl_seconds=self.ttl_seconds)

    @property
    def guarantee(self) -> str | None:
        return "distributed" if self.keys else None


@dataclass(frozen=True)
class ProducerOptions:
    message_type: str = "millrace_record"
    source: str = "millrace"
    version: str | None = None
    dedup: DedupOptions = field(default_factory=DedupOptions)
    backpressure: BackpressureConfig = field(default_factory=BackpressureConfig)
    metrics: MetricsConfig = field(default_factory=MetricsConfig)


@dataclass(frozen=True)
class DlqOptions:
    """Where dead letters go: a folder, or a function that sends rows (topic, partition, offset, value); enabled without either is an error."""

    path: str | None = None
    enabled: bool = True
    send_retries: int = 3
    send: Callable | None = None

    def __post_init__(self):
        if self.enabled and not self.path and self.send is None:
            raise ValueError("an enabled dead-letter queue needs a path or a function that sends")
        _positive(send_retries=self.send_retries)


@dataclass(frozen=True)
class RuntimeTuning:
    max_retries: int = 3
    backoff_base: float = 1.0
    reconnect_base: float = 1.0
    reconnect_max: float = 30.0

    def __post_init__(self):
        _positive(max_retries=self.max_retries, backoff_base=self.backoff_base, reconnect_base=self.reconnect_base, reconnect_max=self.reconnect_max)

    def handler_wait(self, attempt: int) -> float:
        return self.backoff_base * 2**attempt

    def reconnect_wait(self, n: int) -> float:
        return min(self.reconnect_max, self.reconnect_base * 2 ** min(n, 5))


@dataclass(frozen=True)
class ConsumerOptions:
    expected_type: str | None = None
    batch_size: int = 500
    flush_seconds: float = 5.0
    exact_json: bool = True
    tuning: RuntimeTuning = field(default_factory=RuntimeTuning)
    dlq: DlqOptions = field(default_factory=lambda: DlqOptions(enabled=False))
    metrics: MetricsConfig = field(default_factory=MetricsConfig)
    collapse_keys: tuple[str, ...] = ()
    #: Time to live of what inlets remember, against which the backlog's age is judged.
    state_ttl_seconds: float = 18_000

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError("batch_size must be 1 or more")
        _positive(flush_seconds=self.flush_seconds, state_ttl_seconds=self.state_ttl_seconds)

    def merged(self, **overrides) -> ConsumerOptions:
        """These options with every override that isn't UNSET; a value equal to the default overrides too."""
        from dataclasses import replace

        return replace(self, **{k: v for k, v in overrides.items() if v is not UNSET})


@dataclass(frozen=True)
class DbConfig:
    url: str
    write_wait_seconds: float = 25
    statement_seconds: float = 20
    load_wait_seconds: float = 8

    def __post_init__(self):
        if not self.url:
            raise ValueError("a connection string is required")

    @property
    def dialect(self) -> str:
        return "sqlite" if "sqlite" in self.url.lower() else "mssql"

    @property
    def safe_url(self) -> str:
        head, at, tail = self.url.rpartition("@")
        return re.sub(r"^([^:]+://[^:/]*):.*$", r"\1:***", head) + at + tail if at else self.url


def resolve_db(db: str | DbConfig) -> DbConfig:
    if isinstance(db, str):
        return DbConfig(db)
    if not isinstance(db, DbConfig):
        raise TypeError("a connection string or a DbConfig is required")
    return db

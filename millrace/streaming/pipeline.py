"""The inlet and the outlet as Structured Streaming jobs.

A batch is decoded, gated and handed to the handler; what is gated out or found
to be poison is written to the dead-letter table before the batch is done.  The
engine's checkpoint commits a batch only after that, so a crash repeats it: the
handler must be idempotent, and the dead-letter table is, as each batch writes a
folder of its own.
"""

from __future__ import annotations

import logging
import threading
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import dedup, flow
from ..operators.carrier import Carrier
from ..plans.options import ConsumerOptions, KafkaConfig, ProducerOptions
from ..sources.tables import kafka_stream
from .health import outlet_report, query_ok, running
from .observe import INLET, OUTLET, BacklogWatch, Meter, emit, meters

log = logging.getLogger("millrace")


class Fatal(Exception):
    """A handler's error that ends the query."""


class Retry(Exception):
    """A handler's error that may pass."""


@dataclass
class Context:
    """What a handler is told besides its rows."""

    batch: int
    pending: int
    quarantined: int
    run: str = ""
    lag: int = 0
    paused: bool = False
    backlog_age_seconds: float | None = None


def classify(error: Exception) -> str:
    """fatal, retry (time-outs, lost connections) or poison (all else)."""
    if isinstance(error, Fatal):
        return "fatal"
    return "retry" if isinstance(error, (Retry, TimeoutError, ConnectionError)) else "poison"


@dataclass
class Consumer:
    """Runs handler(rows, context) over each batch of RECORD rows.

    probe, if given, says of a single row whether the outlet takes it, or raises;
    then a poisoned batch is searched row by row, as a stream on the driver, and its
    good rows count as handled.  Without a probe the whole batch is quarantined;
    without a dead-letter table it fails the query, to be run again from the
    checkpoint.  parts are started before the query and closed after it.
    """

    handler: Callable[[DataFrame, Context], None]
    options: ConsumerOptions = field(default_factory=ConsumerOptions)
    probe: Callable[[object], bool] | None = None
    persisted: Callable[[DataFrame], None] | None = None
    classifier: Callable[[Exception], str] = classify
    parts: tuple = ()
    name: str | None = None
    decoder: Callable[..., DataFrame] = codec.decode
    counts: Counter = field(default_factory=Counter)

    def __post_init__(self):
        self.meters = meters(OUTLET, self.options.metrics.window_seconds)
        self.watch = BacklogWatch(self.options.state_ttl_seconds, self.name)
        self.query, self.last_commit_at = None, None
        self.paused, self._fatal = False, False
        self._stopping = threading.Event()

    @staticmethod
    def _run(rows: DataFrame) -> str:
        """The id of the query that the batch belongs to; a query on a new checkpoint has a new one."""
        return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""

    def _quarantine(self, rows: DataFrame, run: str, batch: int, part: str, category: str, error: F.Column, stage: str) -> int:
        payload = codec.dlq_payload(F.col("value"), F.col("type"), category, F.substring(error, 1, 500), stage, F.col("partition"), F.col("offset"), F.col("key"), F.col("timestamp"))
        out = rows.select("topic", "partition", "offset", payload.alias("value"))
        for attempt in range(self.options.dlq.send_retries):
            try:
                if self.options.dlq.send is not None:
                    self.options.dlq.send(out)
                else:
                    out.write.mode("overwrite").parquet(f"{self.options.dlq.path}/run={run or 'none'}/batch={batch}/part={part}")
                break
            except Exception:
                if attempt + 1 == self.options.dlq.send_retries:
                    raise
                time.sleep(1)
        n = rows.count()
        self.counts["quarantined"] += n
        emit(log, logging.ERROR, "messages_quarantined", category=category, stage=stage, batch=batch, count=n)
        return n

    def _attempt(self, rows: DataFrame, context: Context) -> Exception | None:
        tuning = self.options.tuning
        for attempt in range(tuning.max_retries):
            began = time.monotonic()
            try:
                self.handler(rows, context)
                self.meters["handle_latency"].add(1, (time.monotonic() - began) * 1000)
                return None
            except Exception as error:
                self.counts["handle_failed"] += context.pending
                self.counts["retries"] += 1
                self.meters["handle_failed"].add(context.pending)
                self.meters["retries"].add()
                verdict = self.classifier(error)
                self._fatal |= verdict == "fatal"
                if verdict == "fatal" or (verdict == "retry" and attempt + 1 == tuning.max_retries):
                    raise
                if verdict == "poison":
                    return error
                time.sleep(tuning.handler_wait(attempt))
        return None

    def __call__(self, rows: DataFrame, batch: int) -> None:
        """The body of foreachBatch."""
        run = self._run(rows)
        seen = self.decoder(rows, exact=self.options.exact_json).persist()
        try:
            good = seen.where(~F.col("is_poison"))
            gate = codec.passes_gate(F.col("type"), self.options.expected_type)
            refused = good.where(~gate)
            taken = good.where(gate).drop("is_poison")
            n, skipped = taken.count(), seen.where("is_poison").count()
            self.meters["consumed"].add(n + skipped)
            if skipped:
                previews = [r.p for r in seen.where("is_poison").select(codec.poison_preview(F.col("value")).alias("p")).limit(20).collect()]
                emit(log, logging.ERROR, "poison_message_skipped", count=skipped, previews=previews)
            self.counts["poison"] += skipped
            bad = 0
            if self.options.dlq.enabled and not refused.isEmpty():
                bad = self._quarantine(refused, run, batch, "type", "unknown_type", F.lit("message type differs"), "decode")
            if n:
                error = self._attempt(taken, Context(batch, n, bad, run, self.watch.lag, self.paused, self.watch.age))
                if error is None:
                    self._done(taken, n)
                else:
                    self._poisoned(taken, n, run, batch, error)
            self.last_commit_at = time.time()
        finally:
            seen.unpersist()

    def _done(self, rows: DataFrame, n: int) -> None:
        self.counts["handled"] += n
        self.meters["handled"].add(n)
        if self.persisted and n:
            keys = list(self.options.collapse_keys)
            try:
                self.persisted(dedup.collapse_last(rows, keys, ["partition", "offset"]) if keys else rows)
            except Exception:
                log.warning("on_persisted_failed", exc_info=True)

    def _poisoned(self, rows: DataFrame, n: int, run: str, batch: int, error: Exception) -> None:
        if not self.options.dlq.enabled:
            raise error
        if self.probe is None:
            self._quarantine(rows, run, batch, "poison", "poison", F.lit(repr(error)), "batch")
            return
        said: dict[tuple, str] = {}

        def takes(row) -> bool:
            try:
                return bool(self.probe(row))
            except Exception as own:
                said[row["partition"], row["offset"]] = repr(own)
                return False

        outcome, handled, bad = flow.locate(rows.orderBy("partition", "offset").toLocalIterator(), takes)
        if outcome == "aborted":
            raise error
        good = rows
        if bad:
            marks = [(r["partition"], r["offset"], said.get((r["partition"], r["offset"]), repr(error))) for r in bad]
            for partition, offset, text in marks:
                emit(log, logging.ERROR, "message_quarantined", partition=partition, offset=offset, error=text[:500])
            listed = F.broadcast(rows.sparkSession.createDataFrame(marks, "partition int, offset bigint, __error string"))
            self._quarantine(rows.join(listed, ["partition", "offset"]), run, batch, "poison", "poison", F.col("__error"), "bisect")
            good = rows.join(listed, ["partition", "offset"], "left_anti").select(*rows.columns)
        self._done(good, handled)

    def stream(self, spark: SparkSession, config: KafkaConfig, topic: str) -> DataFrame:
        """The topic with whole polls a batch until batch_size rows are held."""
        poll = config.max_poll_records
        return kafka_stream(spark, config, topic, -(-self.options.batch_size // poll) * poll)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False):
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        writer = writer.queryName(self.name) if self.name else writer
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self.options.flush_seconds} seconds")
        self.query = writer.start()
        return self.query

    def run(self, stream: Callable[[], DataFrame], checkpoint: str, restarts: int | None = None, available_now: bool = False) -> None:
        """Start, and start again after a failure with growing waits; a fatal error, or stop(), ends it."""
        n = 0
        with running(*self.parts):
            while not self._stopping.is_set():
                rows = stream()
                streams = rows.sparkSession.streams
                streams.addListener(self.watch)
                try:
                    self.start(rows, checkpoint, available_now).awaitTermination()
                    return
                except Exception as error:
                    if self._stopping.is_set():
                        return
                    if self._fatal or (restarts is not None and n >= restarts):
                        raise
                    self.paused = True
                    emit(log, logging.WARNING, "consume_paused", attempt=n, error=str(error)[:500])
                    self._stopping.wait(self.options.tuning.reconnect_wait(n))
                    self.paused = False
                    n += 1
                finally:
                    streams.removeListener(self.watch)

    def stop(self, wait_seconds: float = 30.0) -> bool:
        """End run() after the batch it is at; whether that was within the wait."""
        self._stopping.set()
        query, until = self.query, time.monotonic() + wait_seconds
        while query is not None and query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.05)
        late = query is not None and query.isActive and query.status["isTriggerActive"]
        if query is not None:
            query.stop()
        return not late

    def health(self, outlet: bool | None = None, cache: bool | None = None) -> dict:
        """The outlet's report; a stopped one has no running query."""
        found = outlet_report(query_ok(self.query), outlet, cache, self.paused, 0, self.watch.lag, self.counts["quarantined"], meters=self.meters)
        found["backlog_age_seconds"] = self.watch.age
        found["last_commit_at"], found["stopped"] = self.last_commit_at, self._stopping.is_set()
        return found


@dataclass
class Producer:
    """The inlet: push() over tables of records, with a carrier that remembers, a signal, and a sink.

    send takes the accepted envelopes (key, value); if it fails, after the sink's own
    tries, the records are unavailable and keep their reservation.
    """

    send: Callable[[DataFrame], None]
    options: ProducerOptions = field(default_factory=ProducerOptions)
    carrier: Carrier | None = None
    signal: object | None = None
    encoder: Callable[..., F.Column] = codec.encode
    meters: dict[str, Meter] = field(default_factory=lambda: meters(INLET))
    last_failure: str | None = None

    def push(self, records: DataFrame, clock: str, sequence: str, key: F.Column, identity: F.Column | None = None, summary: F.Column | None = None, routing: F.Column | None = None, force: F.Column | None = None) -> DataFrame:
        """Verdicts (sequence, kind, reason, summary, retry_after, guarantee) of the records.

        key is the identity, or the group with identity given; sequence (long) is
        unique.  While the signal refuses, nothing is written.  A repeated push of the
        same records meets what the first one left, so they are duplicates.
        """
        snapshot = self.signal.snapshot() if self.signal is not None else None
        guarantee = F.lit(getattr(self.carrier, "guarantee", None)).cast("string").alias("guarantee")
        n = records.count()
        self.meters["received"].add(n)
        none = lambda kind: F.lit(None).cast(kind)
        if snapshot is not None and snapshot.rejecting:
            self.meters["backpressure_rejected"].add(n)
            return records.select(F.col(sequence).alias("sequence"), F.lit("backpressure").alias("kind"), F.lit(snapshot.reason).alias("reason"), none("string").alias("summary"), F.lit(snapshot.retry_after).cast("int").alias("retry_after"), guarantee)
        rows = records.withColumn("__key", key.cast("string")).withColumn("__identity", (identity if identity is not None else key).cast("string"))
        rows = rows.withColumn("__t", F.unix_micros(F.col(clock).cast("timestamp"))).withColumn("__summary", F.to_json(summary) if summary is not None else F.lit("{}"))
        rows = rows.withColumn("__force", force if force is not None else F.lit(False)).withColumn("__route", (routing if routing is not None else F.lit(None)).cast("string"))
        if self.carrier is None:
            judged = rows.select(F.col(sequence).alias("sequence"), F.lit("allow").alias("decision"), none("string").alias("via"), none("string").alias("summary"), none("int").alias("retry_after"))
        else:
            asked = rows.select(F.col("__key").alias("key"), F.col("__identity").alias("identity"), F.col("__summary").alias("summary"), F.col("__t").alias("t"), F.col(sequence).cast("long").alias("sequence"), F.col("__force").alias("force"))
            judged = self.carrier.admit(asked).select("sequence", "decision", "via", "summary", "retry_after")
        value = self.encoder(F.struct(*records.columns), self.options.message_type, F.col(clock), self.options.source, self.options.version)
        allowed = judged.where("decision = 'allow'").select(F.col("sequence").alias("__sequence"))
        out = rows.join(allowed, F.col(sequence) == F.col("__sequence"), "left_semi").select(F.col("__route").alias("key"), value.alias("value"))
        began, sent = time.monotonic(), True
        try:
            self.send(out)
        except Exception as error:
            sent, self.last_failure = False, repr(error)
            emit(log, logging.ERROR, "send_failed", error=self.last_failure[:500])
        kinds = judged.select("sequence", dedup.push_verdict(F.lit(False), F.col("decision"), F.lit(sent)).alias("kind"), F.when(F.col("decision") == "reject", F.col("via")).alias("reason"), F.when(F.col("decision") == "duplicate", F.coalesce("summary", F.lit("{}"))).alias("summary"), "retry_after", guarantee)
        said = {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
        for kind, meter in (("duplicate", "duplicate"), ("rejected", "rejected"), ("accepted", "produce_success"), ("unavailable", "produce_failure")):
            self.meters[meter].add(said.get(kind, 0))
        self.meters["produce_latency"].add(1, (time.monotonic() - began) * 1000)
        return kinds


def push(spark: SparkSession, records: DataFrame, options: ProducerOptions, clock: str, sequence: str, sink: str, rejecting: F.Column | None = None) -> DataFrame:
    """The inlet over a table of records: verdicts per record; what is accepted is appended to `sink` as envelopes.

    Under backpressure a record is refused first and takes no part in admission.
    """
    held = rejecting if rejecting is not None else F.lit(False)
    rows = records.withColumn("__held", held)
    open_ = rows.where(~F.col("__held"))
    keys = list(options.dedup.keys)
    if keys and options.dedup.ttl_seconds is not None:
        ticks = open_.withColumn("__t", F.unix_micros(F.col(clock).cast("timestamp")))
        judged = dedup.ttl_wins(ticks, keys, "__t", sequence, options.dedup.ttl_seconds * 1_000_000, sequence).drop("__t")
    elif keys:
        judged = dedup.first_wins(open_, keys, [clock, sequence], sequence)
    else:
        judged = open_.withColumn("decision", F.lit("allow")).withColumn("winner_id", F.col(sequence))
    data = [c for c in records.columns]
    accepted = judged.where("decision = 'allow'")
    value = codec.encode(F.struct(*data), options.message_type, F.col(clock), options.source, options.version)
    if sink is not None:
        accepted.select(value.alias("value")).write.mode("append").parquet(sink)
    refused = rows.where("__held").withColumn("decision", F.lit("allow")).withColumn("winner_id", F.lit(None).cast(records.schema[sequence].dataType))
    both = judged.unionByName(refused)
    return both.select(sequence, "winner_id", dedup.push_verdict(F.col("__held"), F.col("decision"), F.lit(True)).alias("kind"), F.when(F.col("__held"), options.backpressure.retry_after).alias("retry_after"))

"""Micro-batches, poison location, rates, lag, backlog, hysteresis and health."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold


def assign_batches(rows: DataFrame, partition: str, offset: str, size: int, poll: int | None = None) -> DataFrame:
    """rows with batch: exact chunks of `size` by partition, or, with a poll size, whole polls until `size` rows are held.

    Offsets start at 0 in each partition and have no gaps.
    """
    step = size if poll is None else -(-size // poll) * poll
    return rows.withColumn("batch", F.floor(F.col(offset) / step).cast("long"))


def locate(rows: Iterable, probe: Callable[[object], bool]) -> tuple[str, int, list]:
    """Which of a failed batch's rows are poison: (done or aborted, rows handled, rows quarantined), in one pass over a stream.

    A bad row needs a control: the latest good row probed again, else the next row.
    If the control fails too, the outlet is suspect and the pass is aborted.  A
    last bad row with nothing to compare is quarantined.
    """
    left = iter(rows)
    handled, quarantined, good = 0, [], None
    for row in left:
        if probe(row):
            handled, good = handled + 1, row
            continue
        if good is not None:
            if not probe(good):
                return "aborted", handled, quarantined
        elif (control := next(left, None)) is not None:
            if not probe(control):
                return "aborted", handled, quarantined
            handled, good = handled + 1, control
        quarantined.append(row)
    return "done", handled, quarantined


def locate_by_predicate(rows: DataFrame, batch: list[str], order: str, bad: Column) -> DataFrame:
    """Per batch, locate() for a deterministic predicate: outcome, handled and quarantined rows.

    A batch whose first two rows are bad has no control and is aborted.
    """
    marked = rows.withColumn("__bad", bad)
    sums = marked.groupBy(*batch).agg(
        F.count("*").alias("n"), F.count_if("__bad").alias("bad"), F.min(order).alias("first"), F.min(F.when(~F.col("__bad"), F.col(order))).alias("good")
    )
    second = marked.join(sums.select(*batch, "first"), batch).where(F.col(order) > F.col("first")).groupBy(*batch).agg(F.min(order).alias("second"))
    out = sums.join(second, batch, "left")
    aborted = F.col("second").isNotNull() & (F.col("good").isNull() | (F.col("good") > F.col("second")))
    return out.select(
        *batch,
        F.when(aborted, "aborted").otherwise("done").alias("outcome"),
        F.when(aborted, 0).otherwise(F.col("n") - F.col("bad")).cast("long").alias("handled"),
        F.when(aborted, 0).otherwise(F.col("bad")).cast("long").alias("quarantined"),
    )


def rate_windows(events: DataFrame, kind: str, second: str, amount: str, window: int) -> DataFrame:
    """(kind, second, events, total, most) of the last `window` seconds up to each second that has an event.

    Seconds are aggregated first.  Each goes into its own stretch of `window`
    seconds and the next one, so that a frame lies in one stretch and no partition
    holds more than two stretches of a kind.
    """
    if not 1 <= window <= 600:
        raise ValueError("window must be 1 to 600 seconds")
    per = events.groupBy(kind, second).agg(F.count("*").alias("__n"), F.sum(amount).alias("__s"), F.max(amount).alias("__m"))
    home = F.floor(F.col(second) / window)
    spread = per.withColumn("stretch", F.explode(F.array(home, home + 1)))
    frame = Window.partitionBy(kind, "stretch").orderBy(second).rangeBetween(-(window - 1), 0)
    out = spread.select(kind, second, "stretch", F.sum("__n").over(frame).alias("events"), F.sum("__s").over(frame).alias("total"), F.max("__m").over(frame).alias("most"))
    return out.where(F.col("stretch") == home).drop("stretch")


def rate_per_second(events: Column, elapsed: Column, window: int) -> Column:
    """Events over the window, or over the time since the start where that is shorter, a second at least."""
    return F.coalesce(events / F.least(F.lit(float(window)), F.greatest(elapsed.cast("double"), F.lit(1.0))), F.lit(0.0))


def lag(end: Column, committed: Column) -> Column:
    """What a partition lags; nothing committed counts as 0."""
    return F.greatest(end - F.greatest(F.coalesce(committed, F.lit(0)), F.lit(0)), F.lit(0))


def hysteresis_by_age(series: DataFrame, key: str, order: str, age: str, trip: float, recover: float) -> DataFrame:
    """series with rejecting: trips above `trip`, recovers below `recover` or without an age, else stays; recover <= trip."""
    mark = F.when(F.col(age) > trip, F.lit(True)).when((F.col(age) < recover) | F.col(age).isNull(), F.lit(False))
    return series.withColumn("rejecting", F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy(order)), F.lit(False)))


def next_reason(reason: str | None, reachable: bool, status: str | None, kafka: str | None, age: float | None, trip: float, recover: float, fail_closed: bool, any_degraded: bool) -> str | None:
    """Why records are refused after one more probe; None while they are taken.

    Unreachable trips (if fail-closed) unless rejecting already.  A lost broker, or
    a status that isn't healthy where that counts, trips over any reason.  Any other
    reason than backlog ends: in a backlog above `trip`, else open.  No age opens; a
    backlog ends below `recover` and begins above `trip`.
    """
    if not reachable:
        return "unreachable" if fail_closed and reason is None else reason
    if kafka != "connected" or (any_degraded and status != "healthy"):
        return "kafka_down"
    if reason not in (None, "backlog"):
        return "backlog" if age is not None and age > trip else None
    if age is None:
        return None
    if reason == "backlog":
        return None if age < recover else reason
    return "backlog" if age > trip else None


def hysteresis(series: DataFrame, key: str, order: str, trip: float, recover: float, fail_closed: bool = True, any_degraded: bool = False) -> DataFrame:
    """series (reachable, status, kafka, age) with state and reason, by the transitions of next_reason."""

    def step(reason, *said):
        reason = next_reason(reason, *said, trip, recover, fail_closed, any_degraded)
        return reason, "OPEN" if reason is None else "REJECTING", reason

    return ordered_fold(series, [key], [order], ["reachable", "status", "kafka", "age"], lambda: None, step, "state string, reason string")


def health(kafka: Column, cache: Column, backfill: Column) -> Column:
    """healthy only if all parts are; a part that is missing is not."""
    good = lambda c: F.coalesce(c, F.lit(False))
    return F.when(good(kafka) & good(cache) & good(backfill), "healthy").otherwise("degraded")

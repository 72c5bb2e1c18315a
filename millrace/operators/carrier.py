"""Admission that remembers: keys, or groups of keys, with time to live, a cold backfill, force and renewal, over batches.

What is remembered is a table (key, identity, summary, until) in versions.  A batch
is decided by one ordered fold over the remembered rows, the stored rows of its keys
and its own rows, dealt by key and sorted; the table's next version follows from the
fold by aggregates.  What has expired by the batch's clock is left out of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import RETRY_AFTER
from .fold import ordered_fold
from .upsert import VersionedTargets

STATE = "key string, identity string, summary string, until long"
_HELD, _STORED, _NEW = 0, 1, 2
_ORDER = ["kind", "t", "sequence"]


@dataclass(frozen=True)
class Decisions:
    """rows: the batch with decision, via, summary, retry_after; state: what to remember; held: what both are read from, to be unpersisted."""

    rows: DataFrame
    state: DataFrame
    held: DataFrame


def decide(rows: DataFrame, state: DataFrame, backfill: DataFrame | None, ttl: int | None, needs_backfill: bool = True, held: bool = True) -> Decisions:
    """Decide rows (key, identity, summary, t, sequence, force) by the remembered state and the stored rows (key, identity, summary).

    A key that isn't remembered, or no more, is loaded from the stored rows at its
    first row; an identity found there is a duplicate via backfill, the others are
    reserved, and a new one renews the whole key.  A duplicate tells the first one's
    summary and renews nothing; a forced row is allowed and renews.  With single
    keys, key and identity are the same.  Where a backfill is needed and there is
    none, an unknown key is rejected each time.  Nulls are keys like others.  held
    says whether what both results read is persisted meanwhile.
    """
    reject = needs_backfill and backfill is None
    far = 1 << 62

    def step(state, kind, identity, summary, t, until, forced):
        end, members, stored, epoch = state
        if kind == _HELD:
            return (until, {**members, identity: summary}, stored, epoch), None, None, summary, until, epoch
        if kind == _STORED:
            return (end, members, {**stored, identity: summary}, epoch), None, None, summary, end, epoch
        later = far if ttl is None else t + ttl
        loaded = False
        if end is None or t >= end:
            if reject and not forced:
                return state, "reject", "dependency", None, end, epoch
            end, members, epoch, loaded = (later if stored else None), dict(stored), epoch + 1, True
        if forced:
            return (later, {**members, identity: summary}, stored, epoch), "allow", "force", summary, later, epoch
        if identity in members:
            return (end, members, stored, epoch), "duplicate", "backfill" if loaded else "cache", members[identity], end, epoch
        return (later, {**members, identity: summary}, stored, epoch), "allow", "reserve", summary, later, epoch

    none = F.lit(None)
    new = rows.select("key", "identity", "summary", "t", "sequence", F.coalesce("force", F.lit(False)).alias("forced"), none.cast("long").alias("until"), F.lit(_NEW).alias("kind"))
    keys = new.select(F.col("key").alias("__key")).distinct()
    ofs = lambda d: d.join(keys, d["key"].eqNullSafe(keys["__key"]), "left_semi")
    zero = F.lit(0).cast("long")
    parts = ofs(state).select("key", "identity", "summary", zero.alias("t"), zero.alias("sequence"), F.lit(False).alias("forced"), "until", F.lit(_HELD).alias("kind"))
    if backfill is not None:
        parts = parts.unionByName(ofs(backfill.select("key", "identity", "summary")).select("*", zero.alias("t"), zero.alias("sequence"), F.lit(False).alias("forced"), none.cast("long").alias("until"), F.lit(_STORED).alias("kind")))
    adds = "decision string, via string, held string, ends long, epoch long"
    start = lambda: (None, {}, {}, 0)
    folded = ordered_fold(parts.unionByName(new), ["key"], _ORDER, ["kind", "identity", "summary", "t", "until", "forced"], start, step, adds)
    folded = folded.persist() if held else folded
    at = F.struct(*_ORDER)
    last = folded.groupBy(F.col("key").alias("__key")).agg(F.max_by("ends", at).alias("until"), F.max("epoch").alias("last"))
    joined = folded.join(last.withColumnRenamed("until", "__until"), folded["key"].eqNullSafe(last["__key"]))
    # of the last epoch: what was admitted, what was held if it never ended, and, from the first load on, what is stored
    alive = joined.where(f"kind = {_NEW} and decision = 'allow' and epoch = last or kind = {_HELD} and last = 0 or kind = {_STORED} and last > 0")
    members = alive.groupBy("key", "identity").agg(F.max_by("held", at).alias("summary"), F.max("__until").alias("until"))
    clock = new.agg(F.max("t")).first()[0]
    untouched = state.join(keys, state["key"].eqNullSafe(keys["__key"]), "left_anti")
    remembered = untouched.unionByName(members.select("key", "identity", "summary", "until")).where(F.col("until") > F.lit(clock if clock is not None else -far))
    decided = folded.where(f"kind = {_NEW}").select("key", "identity", "sequence", "decision", "via", F.col("held").alias("summary"), F.when(F.col("decision") == "reject", RETRY_AFTER["dependency"]).alias("retry_after"))
    return Decisions(decided, remembered, folded)


class Carrier:
    """A strategy of admission: what it remembers lies under `root`, and each batch is decided and remembered at once.

    Decisions and state are committed together.  admit() may be repeated for a batch
    that was decided last: the same number and run change nothing and give the same
    decisions.  They are kept until the batch after the next one.
    """

    def __init__(self, spark: SparkSession, root: str, ttl: int | None, backfill: DataFrame | None = None, needs_backfill: bool = True, gate: int | None = None):
        """gate is how many unknown keys one batch may load; the others are rejected (gate_full) and none or 0 sets no limit."""
        self.spark, self.ttl, self.backfill, self.needs_backfill, self.gate = spark, ttl, backfill, needs_backfill, gate
        self.tables = VersionedTargets(spark, root)

    guarantee = "distributed"

    def state(self) -> DataFrame:
        found = self.tables.read("state")
        return found if found is not None else self.spark.createDataFrame([], STATE)

    def admit(self, rows: DataFrame, batch: int | None = None, run: str = "") -> DataFrame:
        """The decisions of rows (key, identity, summary, t, sequence, force); what they change is remembered first."""
        number = self._next(run) if batch is None else batch
        if self.gate and self.backfill is not None:
            taken, turned = self._gated(rows)
            found = decide(taken, self.state(), self.backfill, self.ttl, self.needs_backfill)
            none = F.lit(None).cast("string")
            late = turned.select("key", "identity", "sequence", F.lit("reject").alias("decision"), F.lit("gate_full").alias("via"), none.alias("summary"), F.lit(RETRY_AFTER["gate_full"]).alias("retry_after"))
            found = Decisions(found.rows.unionByName(late), found.state, found.held)
        else:
            found = decide(rows, self.state(), self.backfill, self.ttl, self.needs_backfill)
        self._commit(found, number, run)
        return self.tables.read("decisions")

    def _gated(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that may be decided, and those of unknown keys beyond the gate, which the keys pass in the order of their first rows; forced rows pass."""
        first = rows.where(~F.coalesce("force", F.lit(False))).groupBy(F.col("key").alias("__k")).agg(F.min(F.struct("t", "sequence")).alias("at"))
        known = self.state().groupBy(F.col("key").alias("__s")).agg(F.max("until").alias("__until"))
        cold = first.join(known, first["__k"].eqNullSafe(known["__s"]), "left").where("__until is null or at.t >= __until").select("__k", "at")
        passing = cold.orderBy("at").limit(self.gate).select(F.col("__k").alias("__p"))
        shut = cold.join(F.broadcast(passing), cold["__k"].eqNullSafe(F.col("__p")), "left_anti").select(F.col("__k").alias("__x"))
        waits = rows["key"].eqNullSafe(shut["__x"]) & ~F.coalesce(rows["force"], F.lit(False))
        return rows.join(shut, waits, "left_anti"), rows.join(shut, waits, "left_semi")

    def lookup(self, keys: DataFrame, t: int) -> DataFrame:
        """What is remembered at the time t of the keys (key): key, identity, summary, and left, the clock units until it ends."""
        k = keys.select(F.col("key").alias("__key")).distinct()
        now = self.state().where(F.col("until") > t)
        return now.join(k, now["key"].eqNullSafe(k["__key"]), "left_semi").select("key", "identity", "summary", (F.col("until") - t).alias("left"))

    def _commit(self, found: Decisions, batch: int, run: str) -> None:
        try:
            self.tables.replace(batch, {"state": found.state, "decisions": found.rows}, run)
        finally:
            found.held.unpersist()

    def _next(self, run: str) -> int:
        return self.tables.pointer()["runs"].get(run, -1) + 1

    def renew(self, rows: DataFrame) -> None:
        """Write the summaries of handled rows (key, identity, summary, t) and renew their keys; rows without a key or identity are passed over."""
        kept = rows.where("key is not null and key != '' and identity is not null and identity != ''")
        kept = kept.withColumn("sequence", F.monotonically_increasing_id()).withColumn("force", F.lit(True)).persist()
        if not kept.isEmpty():
            self._commit(decide(kept, self.state(), None, self.ttl, False), self._next(""), "")
        kept.unpersist()

    def forget(self, keys: DataFrame) -> None:
        """Delete what is remembered of the keys (key)."""
        k = keys.select(F.col("key").alias("__key")).distinct()
        now = self.state()
        self.tables.replace(self._next(""), {"state": now.join(k, now["key"].eqNullSafe(k["__key"]), "left_anti")})

    def refill(self, keys: DataFrame, t: int) -> int:
        """Load the stored rows of the keys (key) into the state at the time t; how many. A key without any stays unknown."""
        if self.backfill is None:
            raise RuntimeError("a refill needs a backfill source")
        k = keys.select(F.col("key").alias("__key")).distinct()
        rows = self.backfill.join(k, self.backfill["key"].eqNullSafe(k["__key"]), "left_semi").select("key", "identity", "summary").persist()
        now = self.state()
        rest = now.join(rows.select(F.col("key").alias("__k"), F.col("identity").alias("__i")), now["key"].eqNullSafe(F.col("__k")) & now["identity"].eqNullSafe(F.col("__i")), "left_anti")
        until = F.lit((1 << 62) if self.ttl is None else t + self.ttl).cast("long")
        self.tables.replace(self._next(""), {"state": rest.unionByName(rows.withColumn("until", until))})
        n = rows.count()
        rows.unpersist()
        return n

    def check_health(self) -> bool:
        try:
            self.tables.pointer()
            return True
        except Exception:
            return False


class MemoryCarrier(Carrier):
    """A carrier that asks no backfill: an unknown key is always reserved."""

    guarantee = "process-local"

    def __init__(self, spark: SparkSession, root: str, ttl: int | None = None):
        super().__init__(spark, root, ttl, None, False)

"""First-wins admission with time to live, cold backfill, groups, and keep-last collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold

#: Reject reasons and the seconds after which to try again.
RETRY_AFTER = {"dependency": 5, "gate_full": 1, "redis_unavailable": 5}


def first_wins(rows: DataFrame, keys: list[str], order: list[str], winner: str) -> DataFrame:
    """rows with decision (allow or duplicate) and winner_id, the first row's `winner` of each key.

    The first row is found by an aggregate, which combines before it shuffles, and joined back.
    """
    first = rows.groupBy(*keys).agg(F.min_by(F.col(winner), F.struct(*order)).alias("winner_id"))
    joined = rows.join(first, [rows[k].eqNullSafe(first[k]) for k in keys]).select(rows["*"], first["winner_id"])
    return joined.withColumn("decision", F.when(F.col(winner) == F.col("winner_id"), "allow").otherwise("duplicate"))


def ttl_wins(rows: DataFrame, keys: list[str], clock: str, sequence: str, ttl: int, winner: str, force: str | None = None, renews: str | None = None) -> DataFrame:
    """rows with decision and winner_id where a reservation lasts `ttl` clock units from the winner on, its end excluded.

    A duplicate never renews.  A row whose `force` column is true is allowed and
    renews; one whose `renews` column is true - a handled record - renews without
    a change of winner.
    """

    def step(state, t, w, forced, renewed):
        until, held = state
        if forced or until is None or t >= until:
            return (t + ttl, w), "allow", w
        return (max(until, t + ttl) if renewed else until, held), "duplicate", held

    flags = rows.withColumn("__f", F.col(force) if force else F.lit(False)).withColumn("__r", F.col(renews) if renews else F.lit(False))
    kind = rows.schema[winner].dataType.simpleString()
    out = ordered_fold(flags, keys, [clock, sequence], [clock, winner, "__f", "__r"], lambda: (None, None), step, f"decision string, winner_id {kind}")
    return out.drop("__f", "__r")


def admit(rows: DataFrame, identity: str, order: list[str], backfill: DataFrame | None, backfill_key: str | None = None, reachable: bool = True, fail_closed: bool = True) -> DataFrame:
    """rows with decision, via and retry_after of the single-key carrier over an empty cache.

    Without a backfill source a cold key is rejected (dependency) each time.  With
    one, a key found there is a duplicate via backfill, the first of the others is
    allowed by a reservation, its followers are duplicates via cache.  With the
    cache out of reach a row is rejected, or, failing open, decided by the backfill
    alone without a reservation.
    """
    if backfill is None:
        reason = "dependency" if reachable else "redis_unavailable"
        return rows.select("*", F.lit("reject").alias("decision"), F.lit(reason).alias("via"), F.lit(RETRY_AFTER[reason]).alias("retry_after"))
    if not reachable and fail_closed:
        return rows.select("*", F.lit("reject").alias("decision"), F.lit("redis_unavailable").alias("via"), F.lit(RETRY_AFTER["redis_unavailable"]).alias("retry_after"))
    known = backfill.select(F.col(backfill_key or identity).alias("__known"), F.lit(True).alias("__there")).distinct()
    joined = rows.join(known, rows[identity].eqNullSafe(known["__known"]), "left")
    hit = F.coalesce("__there", F.lit(False))
    if not reachable:
        out = joined.withColumn("decision", F.when(hit, "duplicate").otherwise("allow")).withColumn("via", F.lit("direct"))
    else:
        # the first row of a key is a minimum, which combines before it shuffles
        at = F.struct(*order)
        first = rows.groupBy(F.col(identity).alias("__id")).agg(F.min(at).alias("__first"))
        out = joined.join(first, joined[identity].eqNullSafe(first["__id"])).withColumn("__later", at > F.col("__first"))
        out = out.withColumn("decision", F.when(hit | F.col("__later"), "duplicate").otherwise("allow"))
        out = out.withColumn("via", F.when(F.col("__later"), "cache").when(hit, "backfill").otherwise("reserve")).drop("__id", "__first", "__later")
    return out.drop("__known", "__there").withColumn("retry_after", F.lit(None).cast("int"))


def admit_group(
    rows: DataFrame, group: str, identity: str, order: list[str], backfill: DataFrame | None, failed: DataFrame | None = None, reachable: bool = True, fail_closed: bool = True
) -> DataFrame:
    """rows with decision, stage and retry_after of the group carrier over an empty cache; backfill has the columns (group, identity).

    A group's first row loads the whole group; later rows meet the cached group
    and touch no source.  A row is a duplicate if its identity was loaded or seen.
    A null group is a group and a null identity an identity.  Rows of equal order
    are told apart by nothing, so the order should be unique.

    Without a backfill source, and for groups in `failed` (column group), whose load
    fails, every row is rejected (dependency).  With the cache out of reach a row is
    rejected, or, failing open, decided by the backfill alone without a reservation.
    """
    none = F.lit(None).cast("int")

    def rejected(some: DataFrame, reason: str) -> DataFrame:
        return some.select("*", F.lit("reject").alias("decision"), F.lit(reason).alias("stage"), F.lit(RETRY_AFTER[reason]).alias("retry_after"))

    if not reachable and fail_closed:
        return rejected(rows, "redis_unavailable")
    if backfill is None:
        return rejected(rows, "dependency")
    lost = None
    if failed is not None:
        bad = failed.select(F.col(group).alias("__bad")).distinct()
        same = rows[group].eqNullSafe(bad["__bad"])
        lost, rows = rejected(rows.join(bad, same, "left_semi"), "dependency"), rows.join(bad, same, "left_anti")
    known = backfill.select(F.col(group).alias("__g"), F.col(identity).alias("__i"), F.lit(True).alias("__there")).distinct()
    joined = rows.join(known, rows[group].eqNullSafe(known["__g"]) & rows[identity].eqNullSafe(known["__i"]), "left").drop("__g", "__i")
    hit = F.coalesce("__there", F.lit(False))
    if not reachable:
        out = joined.withColumn("decision", F.when(hit, "duplicate").otherwise("allow")).withColumn("stage", F.lit("direct")).drop("__there")
    else:
        # both first rows are minima, which combine before they shuffle
        of_group = rows.groupBy(F.col(group).alias("__g")).agg(F.min(F.struct(*order)).alias("__first"))
        of_member = rows.groupBy(F.col(group).alias("__mg"), F.col(identity).alias("__mi")).agg(F.min(F.struct(*order)).alias("__member"))
        at = F.struct(*order)
        out = joined.join(of_group, joined[group].eqNullSafe(of_group["__g"]))
        out = out.join(of_member, out[group].eqNullSafe(of_member["__mg"]) & out[identity].eqNullSafe(of_member["__mi"]))
        out = out.withColumn("decision", F.when(hit | (at > F.col("__member")), "duplicate").otherwise("allow"))
        out = out.withColumn("stage", F.when(at == F.col("__first"), "load").otherwise("cached")).drop("__g", "__mg", "__mi", "__there", "__first", "__member")
    out = out.withColumn("retry_after", none)
    return out if lost is None else out.unionByName(lost)


def collapse_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in others]).select(*rows.columns)


def push_verdict(rejecting: Column, decision: Column, sent: Column) -> Column:
    """The kind a push ends with: backpressure first, then admission, then the send; a failed send keeps its reservation."""
    return (
        F.when(rejecting, "backpressure")
        .when(decision == "duplicate", "duplicate")
        .when(decision == "reject", "rejected")
        .when(~sent, "unavailable")
        .otherwise("accepted")
    )

"""Keyed upserts, their projection and key check, the latest row per key, and atomic versions of targets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_falsy
from .dedup import collapse_last


@dataclass(frozen=True)
class Upsert:
    """A target: its columns, its keys, a name, columns left out, an optional transform of the rows, types that columns are cast to, and stored names of columns."""

    columns: tuple[str, ...]
    keys: tuple[str, ...]
    name: str
    exclude: tuple[str, ...] = ()
    prepare: object = None
    types: dict[str, str] = field(default_factory=dict)
    stored: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.keys or not set(self.keys) <= set(self.columns):
            raise ValueError("keys must be there and be among the columns")

    def project(self, rows: DataFrame) -> DataFrame:
        """The target's columns of the prepared rows, cast where `types` says; a missing one is null, of its type in `types` or a string."""
        rows = self.prepare(rows) if self.prepare else rows

        def one(c: str) -> Column:
            value = F.col(c) if c in rows.columns else F.lit(None)
            kind = self.types.get(c, None if c in rows.columns else "string")
            return (value.cast(kind) if kind else value).alias(self.stored.get(c, c))

        return rows.select(*[one(c) for c in self.columns if c not in self.exclude])

    @property
    def stored_keys(self) -> list[str]:
        return [self.stored.get(k, k) for k in self.keys]


def key_missing(rows: DataFrame, keys: list[str]) -> Column:
    """Whether a key is missing by truth value."""
    types = dict(rows.dtypes)
    bad = F.lit(False)
    for k in keys:
        bad = bad | is_falsy(F.col(k), types[k])
    return bad


def merge(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The target after an upsert: source rows replace those of their key and the rest stay.

    With an order, the last source row of a key counts.  A null key matches nothing.
    """
    rows = collapse_last(source, keys, order) if order else source
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*target.columns))


def latest(rows: DataFrame, key: str, order: list[str], tie: list[str], summary: list[str]) -> DataFrame:
    """The row of each key (as text) that is greatest by the order columns, nulls lowest; ties go to the first by `tie`.

    Order columns keep their type.  Ties by numbers take one aggregate, by others a second one over the best rows.
    """
    types = dict(rows.dtypes)
    named = rows.withColumn("__key", F.col(key).cast("string"))
    rank = F.struct(*[F.col(c) for c in order])
    if all(types[t].startswith(("tinyint", "smallint", "int", "bigint")) for t in tie):
        best = named.groupBy("__key").agg(F.max_by(F.struct(*summary), F.struct(rank, *[F.bitwise_not(F.col(t)) for t in tie])).alias("s"))
    else:
        top = named.groupBy(F.col("__key").alias("__k")).agg(F.max(rank).alias("__top"))
        tied = named.join(top, F.col("__key").eqNullSafe(F.col("__k")) & rank.eqNullSafe(F.col("__top")))
        best = tied.groupBy("__key").agg(F.min_by(F.struct(*summary), F.struct(*tie)).alias("s"))
    return best.select(F.col("__key").alias(key), *[F.col(f"s.{c}").alias(c) for c in summary if c != key])


class VersionedTargets:
    """Tables as versions under one root; a batch writes new versions, then one pointer row commits all of them.

    A batch is known by the run it belongs to - a query's id - and its number; one
    that is committed already is skipped, so a replay changes nothing, while another
    run's batches count anew.  Versions without a pointer are never read; those that
    the last two pointers don't name are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, folder = self._fs(f"{self.root}/_pointers")
        if not fs.exists(folder):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(folder) if not x.getPath().getName().startswith("."))

    def _pointer(self, name: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/_pointers/{name}").collect()))

    def pointer(self) -> dict:
        """The committed state: its number, the last batch of each run, and the folder of each table."""
        names = self._names()
        return self._pointer(names[-1]) if names else {"number": -1, "runs": {}, "tables": {}}

    def read(self, name: str) -> DataFrame | None:
        at = self.pointer()["tables"].get(name)
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def apply(self, batch: int, sources: dict[str, tuple[DataFrame, list[str], list[str] | None]], run: str = "") -> dict[str, int]:
        """Upsert (rows, keys, order) into each table; returns the rows per table after collapse, or {} for a replay."""
        now = self.pointer()
        if batch <= now["runs"].get(run, -1):
            return {}
        held, merged, counts = [], {}, {}
        try:
            for name, (rows, keys, order) in sources.items():
                held.append((collapse_last(rows, keys, order) if order else rows).persist())
                before = self.read(name)
                merged[name], counts[name] = (held[-1] if before is None else merge(before, held[-1], keys)), held[-1].count()
            self.replace(batch, merged, run)
        finally:
            for rows in held:
                rows.unpersist()
        return counts

    def replace(self, batch: int, sources: dict[str, DataFrame], run: str = "") -> bool:
        """Write whole tables as the batch's new versions; whether it did, which it doesn't for a replay."""
        now = self.pointer()
        if batch <= now["runs"].get(run, -1):
            return False
        number, tables = now["number"] + 1, dict(now["tables"])
        for name, rows in sources.items():
            tables[name] = f"{name}/v{number:012d}"
            rows.write.mode("overwrite").parquet(f"{self.root}/{tables[name]}")
        fs, temp = self._fs(f"{self.root}/_pointers/.{number:012d}")
        stream = fs.create(temp, True)
        stream.write(bytearray(json.dumps({"number": number, "runs": now["runs"] | {run: batch}, "tables": tables}).encode()))
        stream.close()
        _, done = self._fs(f"{self.root}/_pointers/{number:012d}.json")
        if not fs.rename(temp, done):
            raise RuntimeError(f"pointer {number} could not be set")
        self._clean()
        return True

    def _clean(self) -> None:
        names = self._names()
        kept = {v for n in names[-2:] for v in self._pointer(n)["tables"].values()}
        for name in names[-3:-2]:
            for version in set(self._pointer(name)["tables"].values()) - kept:
                fs, path = self._fs(f"{self.root}/{version}")
                fs.delete(path, True)

"""Helpers shared by the corpus operators: table access, checkpoints, guarded id hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a list of keys may have to be broadcast; a longer one is joined by a shuffle.
LISTED_ROWS = 500_000
#: Folders that scratch() has handed out and release() removes.
_HANDED_OUT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one, for tables that an operator writes on its way."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored; one that isn't there is passed over."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, path: str, settings: dict[str, str] | None = None) -> DataFrame:
    """df as the table that is written at path, under session settings that hold for the write alone.

    The shuffles that made it are dropped from the executors' disks, since nothing
    reads them again.
    """
    spark = df.sparkSession
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all scratch folders; to be called when no result that reads them is wanted any more."""
    while _HANDED_OUT:
        remove(spark, _HANDED_OUT.pop())


def joined(rows: DataFrame, right: DataFrame, key: str, hot: Column) -> DataFrame:
    """rows with right's columns by key, which right has once each.

    The keys where `hot` is true, of which there must be a bounded number, meet a
    broadcast list, so that no key's rows come together in one task.
    """
    listed = F.broadcast(right.where(hot))
    rest = rows.join(listed.select(key), key, "left_anti").join(right.where(~hot), key)
    return rows.join(listed, key).unionByName(rest)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among keys (distinct, one column); up to LISTED_ROWS of them are broadcast, more are joined by a shuffle."""
    listed = checkpointed(keys)
    return rows.join(F.broadcast(listed) if listed.count() <= LISTED_ROWS else listed, key, "left_anti")


def merged_ranges(ranges: DataFrame, key: str, touching: bool = True) -> DataFrame:
    """(key, start, end): each key's ranges with overlapping ones, and touching ones where asked, made one; a sort, whatever their number."""
    by = Window.partitionBy(key).orderBy("start", "end")
    last = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") > last if touching else F.col("start") >= last
    opened = ranges.select(key, "start", "end").distinct().withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
    run = F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("run", run).groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def id_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def own_columns(docs: DataFrame, **names: str) -> DataFrame:
    """The columns an operator needs under private names, so that no column of the caller can clash."""
    return docs.select(*[docs[source].alias(name) for name, source in names.items()])

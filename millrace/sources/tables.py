"""Sources: Kafka-shaped streams, backfill tables, and probe series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import DbConfig, KafkaConfig

RECORD = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"


def has_kafka(spark: SparkSession) -> bool:
    """Whether the Kafka connector is on the class path."""
    return spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResource("org/apache/spark/sql/kafka010/KafkaSourceProvider.class") is not None


def kafka_stream(spark: SparkSession, config: KafkaConfig, topic: str, per_batch: int | None = None) -> DataFrame:
    """A topic as RECORD rows, `per_batch` of them in a batch, else one poll's.  Bytes that are no UTF-8 give a null value, so they are poison and block nothing."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", config.brokers)
        .option("subscribe", topic)
        .option("startingOffsets", config.starting_offsets)
        .option("maxOffsetsPerTrigger", per_batch or config.max_poll_records)
        .option("kafka.session.timeout.ms", config.session_timeout_ms)
        .option("kafka.max.poll.interval.ms", config.max_poll_interval_ms)
        .options(**({"kafka.group.id": config.group_id} if config.group_id else {}))
        .load()
    )
    text = lambda c: F.when(F.is_valid_utf8(F.col(c).cast("string")), F.col(c).cast("string"))
    return raw.select(text("key").alias("key"), text("value").alias("value"), "topic", "partition", "offset", "timestamp")


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files of RECORD rows as a stream: the same columns where there is no broker."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def backfill(source: DataFrame, key: str, summary: list[str], scope: Column | None = None, group: str | None = None) -> DataFrame:
    """Keys (as text) and summaries of a stored table within a scope; filter and columns reach the scan."""
    rows = source.where(scope) if scope is not None else source
    return rows.select(F.col(key).cast("string").alias(key), *([group] if group else []), *summary)


def jdbc_table(spark: SparkSession, db: DbConfig, table: str) -> DataFrame:
    """A stored table over JDBC; statements end after the configured seconds."""
    return spark.read.format("jdbc").option("url", db.url).option("dbtable", table).option("queryTimeout", int(db.statement_seconds)).load()


def jdbc_backfill(spark: SparkSession, db: DbConfig, table: str, key: str, summary: list[str], scope: Column | None = None, group: str | None = None) -> DataFrame:
    """backfill() of a stored table over JDBC; a load ends after the configuration's wait with the error of the database."""
    rows = spark.read.format("jdbc").option("url", db.url).option("dbtable", table).option("queryTimeout", int(db.load_wait_seconds)).load()
    return backfill(rows, key, summary, scope, group)


def lag_of(progress: dict) -> int:
    """The lag of a progress report's sources; a part without a committed offset counts from 0."""
    total = 0
    for source in progress.get("sources", []):
        latest, done = source.get("latestOffset") or {}, source.get("endOffset") or {}
        if isinstance(latest, dict) and isinstance(done, dict):
            for topic, parts in latest.items():
                if isinstance(parts, dict):
                    total += sum(max(end - max((done.get(topic) or {}).get(p) or 0, 0), 0) for p, end in parts.items())
    return total

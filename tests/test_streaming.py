import pytest
from pyspark.sql import functions as F

from millrace.plans.options import ConsumerOptions, DedupOptions, DlqOptions, ProducerOptions, RuntimeTuning
from millrace.sources import tables
from millrace.streaming import dedup, pipeline


def record(k, value):
    return ("key", value, "topic", k % 2, k)


@pytest.fixture
def folder(spark, tmp_path):
    values = ['{"type":"event","data":{"v":%d}}' % k for k in range(6)] + ["junk", '{"type":"other","data":{}}']
    df = spark.createDataFrame([record(k, v) for k, v in enumerate(values)], "key string, value string, topic string, partition int, offset bigint")
    df.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return tmp_path


def test_consumer_gates_and_quarantines(spark, folder):
    seen = []
    options = ConsumerOptions(expected_type="event", dlq=DlqOptions(str(folder / "dlq")))
    c = pipeline.Consumer(lambda rows, ctx: seen.extend(r.offset for r in rows.collect()), options)
    c.start(tables.file_stream(spark, str(folder / "in")), str(folder / "cp"), available_now=True).awaitTermination()
    assert sorted(seen) == list(range(6))
    assert (c.counts["handled"], c.counts["poison"], c.counts["quarantined"]) == (6, 1, 1)
    assert spark.read.parquet(str(folder / "dlq")).count() == 1


def test_poison_is_located(spark, folder):
    def handler(rows, ctx):
        if rows.where("offset = 3").count():
            raise ValueError("bad row")

    options = ConsumerOptions(expected_type="event", dlq=DlqOptions(str(folder / "dlq")))
    c = pipeline.Consumer(handler, options, probe=lambda r: r["offset"] != 3)
    c.start(tables.file_stream(spark, str(folder / "in")), str(folder / "cp"), available_now=True).awaitTermination()
    bad = spark.read.parquet(str(folder / "dlq")).where("part = 'poison'").collect()
    assert [r.offset for r in bad] == [3] and c.counts["handled"] == 5


def test_retry_then_success_and_failure(spark, folder):
    left = [1]

    def handler(rows, ctx):
        if left[0]:
            left[0] -= 1
            raise TimeoutError

    options = ConsumerOptions(tuning=RuntimeTuning(max_retries=2, backoff_base=0.01))
    c = pipeline.Consumer(handler, options)
    c.start(tables.file_stream(spark, str(folder / "in")), str(folder / "cp"), available_now=True).awaitTermination()
    assert c.counts["handled"] == 7 and c.counts["retries"] == 1
    left[0] = 5
    failing = pipeline.Consumer(handler, options)
    with pytest.raises(Exception):
        failing.start(tables.file_stream(spark, str(folder / "in")), str(folder / "cp2"), available_now=True).awaitTermination()


def test_push(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 2), (4, "a", 9)], "n long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = pipeline.push(spark, rows, ProducerOptions(dedup=DedupOptions(("k",), ttl_seconds=5)), "ts", "n", str(tmp_path / "sink"), F.col("n") == 3)
    assert {r.n: r.kind for r in out.collect()} == {1: "accepted", 2: "duplicate", 3: "backpressure", 4: "accepted"}
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_stateful_admission_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedup.PROVIDER)
    for k, ts in enumerate(((0, 3, 5), (9, 11, 20))):
        spark.createDataFrame([("u", t, t, False, str(t % 2)) for t in ts], "k string, t long, sequence long, force boolean, identity string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, t long, sequence long, force boolean, identity string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out, want in (("one", dedup.admit_stream(stream(), ["k"], 5), {0, 5, 11, 20}), ("group", dedup.admit_group_stream(stream(), ["k"], 5), {0, 3, 9, 20})):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r.sequence for r in spark.table(name).where("decision = 'allow'").collect()}
        assert got == want, name

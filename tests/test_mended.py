import json
import sqlite3
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import codec, scalars
from millrace.operators import carrier, dedup, upsert
from millrace.plans.options import ConsumerOptions, DbConfig, DlqOptions, KafkaConfig, ProducerOptions, RuntimeTuning
from millrace.sources import sinks, tables
from millrace.streaming import outlet, pipeline, signals


def test_valid_and_hostile_envelopes(spark):
    deep = '{"data":' + '{"a":' * 100_000 + "1" + "}" * 100_001
    cases = [('{"data":{"k":NaN}}', False), ('{"data":[1],"data":{}}', False), ('{"data":{}} xx', True), ('{"data":{}},{"data":{}}', True), ('{"data":{}}}', True), (deep, True), (None, True), ('{"data":{"n":1e400}}', False)]
    rows = spark.createDataFrame([(k, v, w) for k, (v, w) in enumerate(cases)], "k int, value string, want boolean")
    assert [(r.k, r.is_poison) for r in codec.decode(rows).orderBy("k").collect()] == [(k, w) for k, (_, w) in enumerate(cases)]
    assert codec.decode(rows).where("is_poison != want").count() == 0


def test_one_parse_a_value(spark):
    rows = spark.createDataFrame([('{"type":"event","data":{}}',)], "value string")
    taken = lambda exact: codec.decode(rows, exact=exact).where(~F.col("is_poison") & codec.passes_gate(F.col("type"), "event")).groupBy("type").count()
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(taken(True)).count("_envelopes(") == 1
    assert plan(taken(False)).count("try_parse_json") + plan(taken(False)).count("parse_json(") <= 2


def test_dead_letters_are_json(spark):
    values = ['{"data":{}} xx', "junk", None, '{"a":"é\\ud800"}', "[1]", '{"data":{"x":1}}']
    rows = spark.createDataFrame(list(enumerate(values)), "offset long, value string")
    at = F.lit("2024-01-01").cast("timestamp")
    p = rows.select("offset", codec.dlq_payload(F.col("value"), F.lit(None).cast("string"), "c", F.lit("e"), "s", F.lit(0), F.col("offset"), F.lit(None).cast("string"), at).alias("p"))
    got = {r.offset: json.loads(r.p)["original_message"] for r in p.collect()}
    assert got == {0: {"raw": values[0]}, 1: {"raw": "junk"}, 2: {"raw": None}, 3: {"a": "é\ud800"}, 4: {"raw": "[1]"}, 5: {"data": {"x": 1}}}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).select(
            scalars.iso_utc(F.timestamp_micros(F.lit(1_704_067_200_123_456))).alias("a"),
            scalars.iso_utc(F.lit("2024-03-10 02:30:00.5").cast("timestamp_ntz")).alias("b"),
            scalars.iso_utc(F.timestamp_seconds(F.lit(1_730_615_400))).alias("c"),
        ).first()
        assert tuple(row) == ("2024-01-01T00:00:00.123Z", "2024-03-10T02:30:00.500Z", "2024-11-03T06:30:00.000Z")
        texts = ["2024-03-10 02:30:00.123456+02:00", "2024-03-10T02:30:00Z", "2024-01-01 10:00:00", "2024-13-01 10:00:00", "2024-01-01T10:00+05:30", "abcd-ef-gh 00:00:00", "2024-01-01 10:00:00.000", "short"]
        want = ["2024-03-10T02:30:00.123456+02:00", "2024-03-10T02:30:00+00:00", "2024-01-01T10:00:00", "2024-13-01 10:00:00", "2024-01-01T10:00:00+05:30", "abcd-ef-gh 00:00:00", "2024-01-01T10:00:00", "short"]
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        assert [r.x for r in rows.orderBy("k").select(scalars.jsonable(F.col("t")).alias("x")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_keys_of_any_type(spark):
    rows = spark.sql("select date '2024-01-01' d, timestamp '2024-01-01' t, cast(null as date) n, 0.00 z, '' e, '0' s, false f, array(1) a, cast('' as binary) b, 1.5d g")
    missing = {c: rows.select(upsert.key_missing(rows, [c])).first()[0] for c in rows.columns}
    assert missing == {"d": False, "t": False, "n": True, "z": True, "e": True, "s": False, "f": True, "a": False, "b": True, "g": False}


def test_latest_keeps_large_numbers_texts_and_ties(spark):
    rows = spark.createDataFrame([("k", 2**60, "b", 1, "x"), ("k", 2**60 + 1, "a", 2, "y"), (None, None, "c", 3, "z"), (None, None, "d", 1, "w")], "k string, n long, s string, at int, v string")
    got = {r.k: r.v for r in upsert.latest(rows, "k", ["n"], ["at"], ["v"]).collect()}
    assert got == {"k": "y", None: "w"}
    assert {r.k: r.v for r in upsert.latest(rows, "k", ["s"], ["v"], ["v"]).collect()} == {"k": "x", None: "w"}
    tied = spark.createDataFrame([(1, None, "b"), (1, None, "a")], "k int, o string, t string")
    assert upsert.latest(tied, "k", ["o"], ["t"], ["t"]).first().t == "a"
    assert upsert.latest(rows.select("k", "n", F.col("n").cast("decimal(38,0)").alias("big"), "at"), "k", ["big"], ["at"], ["n", "big"]).where("k = 'k'").first().big == Decimal(2**60 + 1)


def test_admission_keeps_rows_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "g", None), (4, "g", None), (5, "g", "b")], "n int, g string, i string")
    stored = spark.createDataFrame([("g", "b")], "g string, i string")
    got = {r.n: (r.decision, r.stage) for r in dedup.admit_group(rows, "g", "i", ["n"], stored).collect()}
    assert got == {1: ("allow", "load"), 2: ("duplicate", "cached"), 3: ("allow", "load"), 4: ("duplicate", "cached"), 5: ("duplicate", "cached")}
    assert [(r.decision, r.stage, r.retry_after) for r in dedup.admit_group(rows, "g", "i", ["n"], None).collect()] == [("reject", "dependency", 5)] * 5
    failed = dedup.admit_group(rows, "g", "i", ["n"], stored, failed=spark.createDataFrame([("g",)], "g string"))
    assert {r.n: r.decision for r in failed.collect()} == {1: "allow", 2: "duplicate", 3: "reject", 4: "reject", 5: "reject"}
    assert {r.stage for r in dedup.admit_group(rows, "g", "i", ["n"], stored, reachable=False).collect()} == {"redis_unavailable"}
    opened = dedup.admit_group(rows, "g", "i", ["n"], stored, reachable=False, fail_closed=False)
    assert {r.n: r.decision for r in opened.collect()} == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "duplicate"}
    single = dedup.admit(rows, "i", ["n"], stored.select("i")).collect()
    assert {r.n: (r.decision, r.via) for r in single} == {1: ("allow", "reserve"), 2: ("duplicate", "cache"), 3: ("allow", "reserve"), 4: ("duplicate", "cache"), 5: ("duplicate", "backfill")}


def test_another_run_starts_anew(spark, tmp_path):
    targets = upsert.VersionedTargets(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    for n in range(4):
        assert targets.apply(n, {"t": (rows(("a", n)), ["k"], None)}, "one") == {"t": 1}
    assert targets.apply(3, {"t": (rows(("a", 9)), ["k"], None)}, "one") == {}
    assert targets.apply(0, {"t": (rows(("b", 7)), ["k"], None)}, "two") == {"t": 1}
    assert {tuple(r) for r in targets.read("t").collect()} == {("a", 3), ("b", 7)}
    assert len(list((tmp_path / "t").glob("v*"))) <= 3


KEYS = "key string, identity string, summary string, t long, sequence long, force boolean"


def told(decisions):
    return {r.sequence: (r.decision, r.via, r.summary) for r in decisions.collect()}


def test_carrier_remembers_over_batches(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(k, k, s, t, n, f) for k, s, t, n, f in x], KEYS)
    stored = spark.createDataFrame([("old", "old", "S")], "key string, identity string, summary string")
    c = carrier.Carrier(spark, str(tmp_path / "c"), 5, stored)
    first = rows(("a", "1", 0, 1, False), ("a", "2", 3, 2, False), ("old", "3", 3, 3, False), (None, "4", 3, 4, False))
    assert told(c.admit(first, 0)) == {1: ("allow", "reserve", "1"), 2: ("duplicate", "cache", "1"), 3: ("duplicate", "backfill", "S"), 4: ("allow", "reserve", "4")}
    second = rows(("a", "5", 4, 5, False), ("a", "6", 5, 6, False), ("old", "7", 4, 7, True), ("old", "8", 4, 8, False), (None, "9", 4, 9, False))
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert told(c.admit(first, 0)) == {1: ("allow", "reserve", "1"), 2: ("duplicate", "cache", "1"), 3: ("duplicate", "backfill", "S"), 4: ("allow", "reserve", "4")}
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held
    assert told(c.admit(second, 1)) == {5: ("duplicate", "cache", "1"), 6: ("allow", "reserve", "6"), 7: ("allow", "force", "7"), 8: ("duplicate", "cache", "7"), 9: ("duplicate", "cache", "4")}
    c.renew(rows(("a", "6", 8, 0, False), ("", "x", 8, 0, False)).select("key", "identity", "summary", "t"))
    assert told(c.admit(rows(("a", "10", 12, 10, False)), 3)) == {10: ("duplicate", "cache", "6")}
    # what has expired by the batch's clock isn't kept
    c.admit(rows(("z", "11", 100, 11, False)), 4)
    assert [r.key for r in c.state().collect()] == ["z"]
    c.forget(spark.createDataFrame([("z",)], "key string"))
    assert c.state().count() == 0 and c.refill(spark.createDataFrame([("old",), ("none",)], "key string"), 100) == 1
    assert told(c.admit(rows(("old", "12", 101, 12, False)))) == {12: ("duplicate", "cache", "S")} and c.check_health()
    none = carrier.Carrier(spark, str(tmp_path / "n"), 5)
    assert told(none.admit(rows(("a", "1", 0, 1, False), ("a", "1", 0, 2, True), ("a", "1", 1, 3, False)))) == {1: ("reject", "dependency", None), 2: ("allow", "force", "1"), 3: ("duplicate", "cache", "1")}


def test_carrier_of_groups(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(g, i, str(n), t, n, False) for g, i, t, n in x], KEYS)
    stored = spark.createDataFrame([("g", "a", "A"), ("g", "b", "B")], "key string, identity string, summary string")
    c = carrier.Carrier(spark, str(tmp_path / "g"), 5, stored)
    assert told(c.admit(rows(("g", "x", 0, 1), ("g", "a", 1, 2), ("h", "a", 1, 3)))) == {1: ("allow", "reserve", "1"), 2: ("duplicate", "cache", "A"), 3: ("allow", "reserve", "3")}
    # x renewed the whole group at 0, y does at 4, and at 9 it is loaded anew
    assert told(c.admit(rows(("g", "y", 4, 4), ("g", "x", 8, 5), ("g", "x", 9, 6), ("g", "b", 9, 7)))) == {4: ("allow", "reserve", "4"), 5: ("duplicate", "cache", "1"), 6: ("allow", "reserve", "6"), 7: ("duplicate", "cache", "B")}
    assert {(r.key, r.identity) for r in c.state().collect()} == {("g", "a"), ("g", "b"), ("g", "x")}


def test_producer_remembers_refuses_and_keeps_reservations(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n long, k string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    switch, broken = signals.Manual(7), [False]

    def send(out):
        if broken[0]:
            raise ConnectionError("no broker")
        sinks.table_sink(str(tmp_path / "sink"))(out)

    p = pipeline.Producer(send, ProducerOptions(), carrier.MemoryCarrier(spark, str(tmp_path / "s")), switch)
    push = lambda r: {x.sequence: x for x in p.push(r, "ts", "n", F.col("k"), summary=F.struct("n"), routing=F.col("k")).collect()}
    got = push(rows)
    assert {n: r.kind for n, r in got.items()} == {1: "accepted", 2: "duplicate", 3: "accepted"} and got[2].summary == '{"n":1}' and got[1].guarantee == "process-local"
    assert {r.kind for r in push(rows).values()} == {"duplicate"}
    assert {r.key for r in spark.read.parquet(str(tmp_path / "sink")).collect()} == {"a", "b"} and spark.read.parquet(str(tmp_path / "sink")).count() == 2
    switch.set(True)
    assert {(r.kind, r.retry_after) for r in push(rows).values()} == {("backpressure", 7)}
    switch.set(False)
    broken[0] = True
    more = rows.withColumn("k", F.lit("c"))
    assert {n: r.kind for n, r in push(more).items()} == {1: "unavailable", 2: "duplicate", 3: "duplicate"} and "no broker" in p.last_failure
    broken[0] = False
    assert {r.kind for r in push(more).values()} == {"duplicate"}
    assert p.meters["duplicate"].per_second() > 0


def test_sqlite_upserts_in_one_transaction(spark, tmp_path):
    path = str(tmp_path / "x.db")
    targets = sinks.SqlTargets(lambda: sqlite3.connect(path), DbConfig("sqlite:///x"))
    ask = lambda q: sqlite3.connect(path).execute(q).fetchall()
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert targets.apply(0, {"t": (rows(*((f"k{n}", n) for n in range(2_500))), ["k"], None)}, "q") == {"t": 2_500}
    assert targets.apply(1, {"t": (rows(("k1", 7), ("k1", 8), ("new", 9)), ["k"], ["v"])}, "q") == {"t": 2}
    assert targets.apply(1, {"t": (rows(("k1", 0)), ["k"], None)}, "q") == {}
    assert ask("select count(*), (select v from t where k = 'k1') from t") == [(2_501, 8)]
    con = sqlite3.connect(path)
    con.execute("create table plain (k text, v int)")
    con.execute("insert into plain values ('a', 1), ('a', 2), (null, 3)")
    con.commit()
    # no unique constraint: by delete and insert, and a failing table leaves the other as it was
    targets.apply(2, {"plain": (rows(("a", 5), (None, 6)), ["k"], None)}, "q")
    assert sorted(ask("select coalesce(k, ''), v from plain")) == [("", 3), ("", 6), ("a", 5)]
    with pytest.raises(sqlite3.Error):
        targets.apply(3, {"t": (rows(("k1", 99)), ["k"], None), "plain": (rows(("a", 1)).withColumn("w", F.lit(1)), ["k"], None)}, "q")
    assert ask("select v from t where k = 'k1'") == [(8,)] and targets.check_health()
    slow = sinks.SqlTargets(lambda: sqlite3.connect(path), DbConfig("sqlite:///x", write_wait_seconds=1e-9))
    with pytest.raises(TimeoutError):
        slow.apply(3, {"t": (rows(("k1", 99)), ["k"], None)}, "q")
    merge = sinks.upsert_statement("t]x", ["k", "v"], ["k"], 2, "mssql")
    assert merge.startswith("MERGE INTO [t]]x] WITH (HOLDLOCK) AS t USING (VALUES (?, ?), (?, ?)) AS s") and "WHEN MATCHED THEN UPDATE SET t.[v] = s.[v]" in merge


@pytest.fixture
def folder(spark, tmp_path):
    values = ['{"type":"event","data":{"id":"a%d","v":%d}}' % (k % 3, k) for k in range(6)]
    df = spark.createDataFrame([("key", v, "topic", k % 2, k) for k, v in enumerate(values)], "key string, value string, topic string, partition int, offset bigint")
    df.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return tmp_path


def test_a_stream_into_sqlite_and_a_new_checkpoint(spark, folder):
    path = str(folder / "x.db")
    read = lambda d: d.select("partition", "offset", F.get_json_object("value", "$.data.id").alias("id"), F.get_json_object("value", "$.data.v").cast("long").alias("v"))
    targets = sinks.SqlTargets(lambda: sqlite3.connect(path), DbConfig("sqlite:///x"))
    for n in range(2):
        c = outlet.upsert_consumer(targets, [upsert.Upsert(("id", "v"), ("id",), "things", prepare=read)], dlq=DlqOptions(str(folder / "dlq"), False))
        c.run(lambda: tables.file_stream(spark, str(folder / "in")), str(folder / f"cp{n}"), available_now=True)
        assert c.counts["handled"] == 6
    con = sqlite3.connect(path)
    assert con.execute("select count(*) from things").fetchall() == [(3,)] and con.execute("select count(*) from millrace_batches").fetchall() == [(2,)]


def test_dead_letters_of_two_checkpoints_stay(spark, folder):
    for n in range(2):
        c = pipeline.Consumer(lambda rows, ctx: None, ConsumerOptions(expected_type="other", dlq=DlqOptions(str(folder / "dlq"))))
        c.run(lambda: tables.file_stream(spark, str(folder / "in")), str(folder / f"cp{n}"), available_now=True)
    assert spark.read.parquet(str(folder / "dlq")).count() == 12


def test_located_rows_have_their_own_error_and_good_ones_are_persisted(spark, folder):
    persisted, sent = [], []
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()

    def handler(rows, ctx):
        raise ValueError("bad batch")

    def probe(row):
        if row["offset"] == 3:
            raise KeyError("own error")
        return row["offset"] != 4

    options = ConsumerOptions(dlq=DlqOptions(send=lambda rows: sent.extend(rows.collect())))
    c = pipeline.Consumer(handler, options, probe, persisted=lambda rows: persisted.extend(r.offset for r in rows.collect()))
    c.run(lambda: tables.file_stream(spark, str(folder / "in")), str(folder / "cp"), available_now=True)
    errors = {r.offset: json.loads(r.value)["reason"]["error"] for r in sent}
    assert errors == {3: "KeyError('own error')", 4: "ValueError('bad batch')"} and sorted(persisted) == [0, 1, 2, 5] and c.counts["handled"] == 4
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held
    report = c.health()
    assert report["quarantined_count"] == 2 and report["last_commit_at"] and report["handle_failure_rate"] > 0


def test_fatal_errors_retries_and_stop(spark, folder):
    tries = []

    def handler(rows, ctx):
        tries.append(ctx.run)
        raise pipeline.Fatal("end") if len(tries) > 2 else TimeoutError("Fatal is only a word here")

    tuning = RuntimeTuning(max_retries=1, reconnect_base=0.01, backoff_base=0.01)
    started = []

    class Part:
        def start(self):
            started.append("start")

        def close(self):
            started.append("close")

    c = pipeline.Consumer(handler, ConsumerOptions(tuning=tuning), parts=(Part(),))
    with pytest.raises(Exception):
        c.run(lambda: tables.file_stream(spark, str(folder / "in")), str(folder / "cp"), available_now=True)
    assert len(tries) == 3 and len(set(tries)) == 1 and tries[0] and started == ["start", "close"]
    import threading
    import time

    slow = pipeline.Consumer(lambda rows, ctx: time.sleep(0.5), ConsumerOptions(flush_seconds=0.1))
    t = threading.Thread(target=slow.run, args=(lambda: tables.file_stream(spark, str(folder / "in")), str(folder / "cp3")))
    t.start()
    until = time.time() + 20
    while not slow.counts["handled"] and time.time() < until:
        time.sleep(0.05)
    assert slow.stop(10)
    t.join(20)
    assert not t.is_alive() and slow.counts["handled"] == 6 and slow.health()["stopped"]


def test_kafka_options(spark):
    assert KafkaConfig("a:1", group_id="g").session_timeout_ms == 30_000
    if not tables.has_kafka(spark):
        with pytest.raises(Exception):
            sinks.kafka_sink(KafkaConfig("a:1"), "t")(spark.range(1).selectExpr("'v' as value"))


def test_the_gate_for_unknown_keys(spark, tmp_path):
    stored = spark.createDataFrame([("b", "b", "B")], "key string, identity string, summary string")
    c = carrier.Carrier(spark, str(tmp_path / "c"), 5, stored, gate=2)
    rows = lambda *x: spark.createDataFrame([(k, k, str(n), t, n, f) for k, t, n, f in x], KEYS)
    got = told(c.admit(rows(("a", 0, 1, False), ("b", 0, 2, False), ("c", 0, 3, False), ("c", 0, 4, False), ("d", 0, 5, True))))
    assert got == {1: ("allow", "reserve", "1"), 2: ("duplicate", "backfill", "B"), 3: ("reject", "gate_full", None), 4: ("reject", "gate_full", None), 5: ("allow", "force", "5")}
    assert told(c.admit(rows(("a", 1, 6, False), ("c", 1, 7, False))))[7] == ("allow", "reserve", "7")
    assert {(r.key, r.summary, r.left) for r in c.lookup(spark.createDataFrame([("a",), ("c",), ("x",)], "key string"), 2).collect()} == {("a", "1", 3), ("c", "7", 4)}


def test_parts_fit_their_protocols(spark, tmp_path):
    from millrace.streaming import protocols

    assert isinstance(carrier.MemoryCarrier(spark, str(tmp_path)), protocols.Admission) and isinstance(signals.Manual(), protocols.Backpressure)
    assert isinstance(upsert.VersionedTargets(spark, "x"), protocols.Targets) and isinstance(sinks.SqlTargets(None, DbConfig("sqlite:///x")), protocols.Targets)
    opened = sinks.connector(DbConfig(f"sqlite:///{tmp_path}/y.db"))()
    assert opened.execute("select 1").fetchone() == (1,)
    opened.close()
    try:
        import pyodbc  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            sinks.connector(DbConfig("mssql+pyodbc://h/d"))
    spec = upsert.Upsert(("id", "v"), ("id",), "t", types={"v": "double"}, stored={"id": "key_"})
    out = spec.project(spark.createDataFrame([("a", "1.5")], "id string, v string"))
    assert out.dtypes == [("key_", "string"), ("v", "double")] and spec.stored_keys == ["key_"]

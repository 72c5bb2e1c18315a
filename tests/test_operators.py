import pytest
from pyspark.sql import functions as F

from millrace.functions import codec, scalars
from millrace.operators import dedup, flow, upsert
from millrace.plans import options


def test_envelope_cases(spark):
    good = ['{"data":{}}', ' {"data":{}} ', '{"data":{"s":"qé"}}', '{"data":{"n":1}}']
    bad = [None, "", '{"a"', "[1]", "{}", '{"data":null}', '{"data":"x"}', '{"data":"{}"}', '{"data":[1]}']
    exact_only = [('{"data":{"k":NaN}}', False), ('{"data":{"a":1,"a":2}}', False), ('{"data":{}} xx', True)]
    rows = [(i, v, False) for i, v in enumerate(good)] + [(50 + i, v, True) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "i int, value string, want boolean")
    assert codec.decode(df).where("is_poison != want").count() == 0
    df = spark.createDataFrame(rows + [(100 + i, v, w) for i, (v, w) in enumerate(exact_only)], "i int, value string, want boolean")
    assert codec.decode(df, exact=True).where("is_poison != want").count() == 0


def test_type_text(spark):
    df = spark.createDataFrame([('{"data":{},"type":null}',), ('{"data":{},"type":7}',), ('{"data":{},"type":true}',), ('{"data":{}}',), ('{"data":{},"type":"a"}',)], "value string")
    assert [r.type for r in codec.decode(df).collect()] == ["None", "7", "True", None, "a"]


def test_ttl_cases(spark):
    df = spark.createDataFrame([("k", t, t, False, False) for t in (0, 3, 5, 9, 11, 20)], "k string, t long, s long, f boolean, r boolean")
    won = lambda d: [r.s for r in d.where("decision = 'allow'").orderBy("t").collect()]
    assert won(dedup.ttl_wins(df, ["k"], "t", "s", 5, "s")) == [0, 5, 11, 20]
    renewed = df.withColumn("r", F.col("t") == 3)
    assert won(dedup.ttl_wins(renewed, ["k"], "t", "s", 5, "s", renews="r")) == [0, 9, 20]


def test_group_admission(spark):
    rows = spark.createDataFrame([(1, "g1", "b"), (2, "g1", "a"), (3, "g1", "c"), (4, "g2", "x"), (5, "g2", "x")], "n int, g string, i string")
    got = dedup.admit_group(rows, "g", "i", ["n"], spark.createDataFrame([("g1", "a")], "g string, i string")).orderBy("n").collect()
    assert [r.decision for r in got] == ["allow", "duplicate", "allow", "allow", "duplicate"]
    assert [r.stage for r in got] == ["load", "cached", "cached", "load", "cached"]


def test_keep_last_latest_and_merge(spark):
    last = dedup.collapse_last(spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], "k string, v int, n int"), ["k"], ["n"])
    assert {(r.k, r.v) for r in last.collect()} == {("a", 3), ("b", 2)}
    rows = spark.createDataFrame([(1, None, 5, "n", 0), (1, 3, None, "m", 1), (1, 3, 1, "w", 2)], "k int, o1 int, o2 int, s string, at int")
    assert upsert.latest(rows, "k", ["o1", "o2"], ["at"], ["s"]).first().s == "w"
    target, source = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in upsert.merge(target, source, ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}


def test_versioned_targets(spark, tmp_path):
    targets = upsert.VersionedTargets(spark, str(tmp_path))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    two = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "k string, v int")
    assert targets.apply(0, {"t": (one, ["k"], None)}) == {"t": 2}
    assert targets.apply(1, {"t": (two, ["k"], ["v"]), "u": (one, ["k"], None)}) == {"t": 2, "u": 2}
    assert targets.apply(1, {"t": (one, ["k"], None)}) == {}
    assert {tuple(r) for r in targets.read("t").collect()} == {("a", 1), ("b", 9), ("c", 4)}


@pytest.mark.parametrize(
    "rows,want", [("gbbg", ("done", 2, 2)), ("bgg", ("done", 2, 1)), ("b", ("done", 0, 1)), ("bbg", ("aborted", 0, 0))]
)
def test_locate(spark, rows, want):
    outcome, handled, bad = flow.locate(list(rows), lambda r: r == "g")
    assert (outcome, handled, len(bad)) == want
    df = spark.createDataFrame([(1, k, c == "b") for k, c in enumerate(rows)], "batch int, k int, bad boolean")
    got = flow.locate_by_predicate(df, ["batch"], "k", F.col("bad")).first()
    assert (got.outcome, got.handled, got.quarantined) == want


def test_hysteresis(spark):
    series = [(1, True, "connected", 1.0), (2, True, "connected", 10.0), (3, True, "connected", 8.0), (4, True, "connected", 6.0), (5, True, "connected", 8.0), (6, True, "connected", None),
              (7, False, "connected", None), (8, True, "connected", 8.0), (9, True, "lost", 8.0), (10, True, "connected", 10.0), (11, False, "connected", None), (12, True, "lost", 1.0), (13, True, "connected", 8.0)]
    df = spark.createDataFrame([("s", t, r, "healthy", k, a) for t, r, k, a in series], "s string, t int, reachable boolean, status string, kafka string, age double")
    got = [r.reason for r in flow.hysteresis(df, "s", "t", 9, 7).orderBy("t").collect()]
    assert got == [None, "backlog", "backlog", None, None, None, "unreachable", None, "kafka_down", "backlog", "backlog", "kafka_down", None]


def test_rates_levels_lag(spark):
    one = spark.range(1)
    assert one.select(flow.rate_per_second(F.lit(30), F.lit(10), 60)).first()[0] == 3.0
    assert [one.select(scalars.backlog_level(F.lit(a), 18000)).first()[0] for a in (9000, 9001, 14400, 14401)] == ["ok", "warning", "warning", "error"]
    parts = spark.createDataFrame([(10, 4), (5, None), (7, 9)], "e int, c int")
    assert parts.agg(F.sum(flow.lag(F.col("e"), F.col("c")))).first()[0] == 11
    assert [one.select(scalars.chunk_of(F.lit(n), f)).first()[0] for n, f in ((1000, 2), (1001, 2), (2, 2001))] == [0, 1, 1]


def test_error_table(spark):
    rows = [("integrity", "x (2627) (y)", "poison"), ("operational", "(1205)", "retry"), ("other", "(8152) (1205)", "poison"), ("operational", "Login failed for x", "retry"), ("value", "", "poison"), ("timeout", "", "retry")]
    df = spark.createDataFrame(rows, "c string, m string, w string")
    assert df.where(scalars.classify_error(F.col("c"), F.col("m")) != F.col("w")).count() == 0


def test_options():
    assert options.KafkaConfig(" https://a:1,kafka://b:2 ").brokers == "a:1,b:2"
    for make in (lambda: options.DlqOptions(), lambda: options.ConsumerOptions(batch_size=0), lambda: options.MetricsConfig(601), lambda: options.KafkaConfig(" "), lambda: options.DbConfig("")):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        options.resolve_db(3)
    assert options.DbConfig("mssql://u:p@q@h/d").safe_url == "mssql://u:***@h/d"
    t = options.RuntimeTuning()
    assert [t.reconnect_wait(n) for n in range(7)] == [1, 2, 4, 8, 16, 30, 30] and [t.handler_wait(n) for n in range(3)] == [1, 2, 4]
    assert options.BackpressureConfig(5, 6, probe_retries=-1).warnings(4) == ["recover is not less than trip", "probe_retries is negative", "trip is not less than the state's time to live"]

import json
import logging

import pytest
from pyspark.sql import functions as F

from millrace.operators.upsert import Upsert, VersionedTargets
from millrace.plans.options import BackpressureConfig, DlqOptions
from millrace.sources import tables
from millrace.streaming import health, observe, outlet, signals


def test_log_lines_and_reserved_names(caplog):
    logger = logging.getLogger("millrace.test")
    with caplog.at_level(logging.INFO, "millrace.test"):
        observe.emit(logger, logging.INFO, "done", rows=3, who="é")
    line = json.loads(observe.JsonLines().format(caplog.records[0]))
    assert (line["event"], line["level"], line["logger"], line["rows"], line["who"]) == ("done", "INFO", "millrace.test", 3, "é")
    assert line["timestamp"].endswith("Z") and "error" not in line
    with pytest.raises(ValueError, match="message"):
        observe.emit(logger, logging.INFO, "done", message="x")


def test_meter_keeps_its_window():
    now = [100.0]
    m = observe.Meter(10, lambda: now[0])
    assert (m.per_second(), m.mean(), m.most()) == (0.0, 0.0, 0.0)
    m.add(5, 20.0)
    assert m.per_second() == 5.0 and m.mean() == 4.0 and m.most() == 20.0
    now[0] = 109.0
    m.add(5, 1.0)
    assert m.per_second() == pytest.approx(10 / 9)
    now[0] = 110.0
    assert m.per_second() == 0.5 and m.most() == 1.0
    with pytest.raises(ValueError):
        observe.Meter(601)


def test_backlog_levels():
    watch = observe.BacklogWatch(100, clock=lambda: 1_704_067_260.0)
    progress = lambda at: {"numInputRows": 2, "eventTime": {"min": at}, "sources": [{"latestOffset": {"t": {"0": 9}}, "endOffset": {"t": {"0": 4}}}]}
    assert watch.take(progress("2024-01-01T00:00:30.000Z")) == "ok" and watch.lag == 5
    assert watch.take(progress("2024-01-01T00:00:00.000Z")) == "warning" and watch.age == 60.0
    assert watch.take(progress("2023-12-31T23:59:00.000Z")) == "error"
    assert watch.take({}) == "ok" and watch.age is None and watch.rows == 6


def test_probe_retries_and_reads():
    left = [b"no json", b"[]", b'{"status":"healthy","backlog_age_seconds":3,"lag":7}']
    probe = signals.HttpProbe("http://x", retries=2, pause=0, fetch=lambda url, timeout: left.pop(0))
    assert probe() == signals.ProbeResult("healthy", "connected", 3.0, 0, 7)
    assert signals.HttpProbe("http://x", retries=-1, fetch=lambda url, timeout: 1 / 0)() is None


def test_signal_follows_the_probe():
    now, said = [0.0], []
    s = signals.ProbeSignal(lambda: said.pop(0), BackpressureConfig(trip_seconds=100, recover_seconds=50, retry_after=9), clock=lambda: now[0])
    ok = lambda age, kafka="connected": signals.ProbeResult("healthy", kafka, age)
    for found, reason in ((ok(10), None), (ok(101), "backlog"), (ok(70), "backlog"), (None, "backlog"), (ok(49), None), (ok(70), None), (None, "unreachable"), (ok(70), None), (ok(0, "disconnected"), "kafka_down"), (ok(None), None)):
        said.append(found)
        assert s.poll().reason == reason
        assert s.wait == (30.0 if reason is None else 5.0)
    said.append(ok(500))
    assert s.poll() == signals.Snapshot(True, "backlog", 9)
    assert s.poll().reason == "backlog"  # the probe raises
    manual = signals.Manual(5)
    manual.set(True)
    assert manual.snapshot() == signals.Snapshot(True, "manual", 5) and not signals.AlwaysOpen().snapshot().rejecting


def test_signal_polls_in_its_thread():
    asked = []
    s = signals.ProbeSignal(lambda: asked.append(1))
    with health.running(s):
        for _ in range(100):
            if asked and s.snapshot().rejecting:
                break
            s._stop.wait(0.05)
    assert s.snapshot().reason == "unreachable" and s._thread is None


def test_health_reports():
    assert health.inlet_report(True, True, True)["status"] == "healthy"
    assert health.inlet_report(True, None, True)["cache"] == "disconnected" and health.inlet_report(True, None, True)["status"] == "degraded"
    m = observe.meters(observe.OUTLET)
    m["handled"].add(4)
    found = health.outlet_report(True, meters=m, oldest=10.0, now=25.0)
    assert (found["status"], found["handle_rate"], found["backlog_age_seconds"], found["outlet"]) == ("healthy", 4.0, 15.0, None)
    assert health.outlet_report(True, paused=True)["status"] == health.outlet_report(True, outlet=False)["status"] == "degraded"

    class Broken:
        def check_health(self):
            raise OSError

    assert (health.part_ok(None), health.part_ok(object()), health.part_ok(Broken())) == (None, True, False)


def test_parts_are_closed_in_reverse():
    said = []

    class Part:
        def __init__(self, name, bad=False):
            self.name, self.bad = name, bad

        def start(self):
            said.append(f"+{self.name}")
            if self.bad:
                raise OSError

        def close(self):
            said.append(f"-{self.name}")
            if self.bad:
                raise OSError

    with pytest.raises(KeyError), health.running(Part("a"), None, Part("b", True), object()):
        raise KeyError
    assert said == ["+a", "+b", "-b", "-a"]


def test_upsert_consumer(spark, tmp_path):
    values = [(0, "a", 1), (1, "b", 2), (2, "a", 3)]
    rows = spark.createDataFrame([("k", '{"type":"event","data":{"id":"%s","v":%d}}' % (i, v), "t", 0, o) for o, i, v in values], "key string, value string, topic string, partition int, offset bigint")
    rows.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda d: d.select("partition", "offset", F.get_json_object("value", "$.data.id").alias("id"), F.get_json_object("value", "$.data.v").cast("long").alias("v"))
    targets = VersionedTargets(spark, str(tmp_path / "out"))
    spec = Upsert(("id", "v", "note"), ("id",), "things", prepare=read)
    c = outlet.upsert_consumer(targets, [spec], dlq=DlqOptions(str(tmp_path / "dlq")))
    c.start(tables.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert {(r.id, r.v, r.note) for r in targets.read("things").collect()} == {("a", 3, None), ("b", 2, None)}
    assert c.counts["handled"] == 3
    with pytest.raises(ValueError):
        c.handler(rows.withColumn("value", F.lit('{"data":{"id":""}}')), outlet.Context(9, 1, 0))
    (run, batch), = targets.pointer()["runs"].items()
    assert run and batch == 0

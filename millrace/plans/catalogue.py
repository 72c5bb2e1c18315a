"""The query catalogue: each operator over the driver's tables, with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, scalars
from ..operators import carrier, dedup, flow, upsert

DAY = 86_400_000_000
#: (table, query, SQL) by name, filled by @query.
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as Kafka-shaped rows; some values are cut, hold an array as data, are null, or have another or no type."""
    e = _table(spark, sf_dir, "events")
    body = F.struct("event_id", "user_id", "event_type")
    good = codec.encode(body, "event", F.col("ts"), "millrace")
    bare = F.to_json(F.struct(F.lit("millrace").alias("source"), body.alias("data")))
    k = F.col("event_id")
    value = (
        F.when(k % 97 == 0, F.substring(good, 1, 20))
        .when(k % 89 == 0, F.lit('{"type":"event","data":[1]}'))
        .when(k % 83 == 0, F.lit(None))
        .when(k % 79 == 0, codec.encode(body, "other", F.col("ts"), "millrace"))
        .when(k % 73 == 0, bare)
        .otherwise(good)
    )
    return e.select("event_id", F.col("user_id").cast("string").alias("key"), value.alias("value"), (F.col("user_id") % 4).cast("int").alias("partition"), k.alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


_BODY = "'\"data\":{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}}'"
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
_GOOD = "'{\"type\":\"' || (CASE WHEN event_id % 79 = 0 THEN 'other' ELSE 'event' END) || '\",\"received_at\":\"' || " + _STAMP + " || '\",\"source\":\"millrace\",' || " + _BODY
WIRE_SQL = f"""wire AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 97 = 0 THEN substr('{{"type":"event","received_at":', 1, 20)
 WHEN event_id % 89 = 0 THEN '{{"type":"event","data":[1]}}' WHEN event_id % 83 = 0 THEN NULL
 WHEN event_id % 79 <> 0 AND event_id % 73 = 0 THEN '{{"source":"millrace",' || {_BODY} ELSE {_GOOD} END AS value FROM events),
dec AS (SELECT *, NOT coalesce(CASE WHEN json_valid(value) THEN json_type(value, '$.data') = 'OBJECT' END, false) AS is_poison FROM wire),
typed AS (SELECT *, CASE WHEN NOT is_poison THEN json_extract_string(value, '$.type') END AS type FROM dec)"""


@query(f"""SELECT event_id, 'event' AS type, {_STAMP} AS received_at, 'millrace' AS source, user_id AS data_user, event_type AS data_type FROM events""")
def envelope_encode(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    v = e.select("event_id", codec.encode(F.struct("user_id", "event_type"), "event", F.col("ts"), "millrace").alias("v"))
    at = lambda p: F.get_json_object("v", p)
    return v.select("event_id", at("$.type").alias("type"), at("$.received_at").alias("received_at"), at("$.source").alias("source"), at("$.data.user_id").cast("long").alias("data_user"), at("$.data.event_type").alias("data_type"))


@query(f"WITH {WIRE_SQL} SELECT event_id, is_poison, type FROM typed")
def envelope_decode(spark, sf_dir):
    return codec.decode(wire(spark, sf_dir), exact=False).select("event_id", "is_poison", "type")


@query(f"WITH {WIRE_SQL} SELECT event_id, is_poison, type FROM typed")
def envelope_decode_exact(spark, sf_dir):
    return codec.decode(wire(spark, sf_dir)).select("event_id", "is_poison", "type")


@query(f"WITH {WIRE_SQL} SELECT event_id, substr(value, 1, 500) AS preview FROM dec WHERE is_poison")
def poison_split(spark, sf_dir):
    return codec.decode(wire(spark, sf_dir)).where("is_poison").select("event_id", codec.poison_preview(F.col("value")).alias("preview"))


@query(f"WITH {WIRE_SQL} SELECT coalesce(type, 'none') AS type, type IS NULL OR type = 'event' AS passed, count(*) AS n FROM typed WHERE NOT is_poison GROUP BY ALL")
def type_gate(spark, sf_dir):
    d = codec.decode(wire(spark, sf_dir)).where("not is_poison")
    return d.groupBy(F.coalesce("type", F.lit("none")).alias("type"), codec.passes_gate(F.col("type"), "event").alias("passed")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {WIRE_SQL} SELECT event_id, type, {_STAMP} AS quarantined_at, 'unknown_type' AS category, 'decode' AS stage, CAST(user_id % 4 AS BIGINT) AS source_partition,
 event_id AS source_offset, CAST(user_id AS VARCHAR) AS source_key, event_id AS original_id FROM typed WHERE NOT is_poison AND type <> 'event'"""
)
def dlq_payload(spark, sf_dir):
    d = codec.decode(wire(spark, sf_dir)).where(~F.col("is_poison") & ~codec.passes_gate(F.col("type"), "event"))
    p = d.select("event_id", codec.dlq_payload(F.col("value"), F.col("type"), "unknown_type", F.lit("type mismatch"), "decode", F.col("partition"), F.col("offset"), F.col("key"), F.col("timestamp")).alias("p"))
    at = lambda x: F.get_json_object("p", x)
    return p.select(
        "event_id", at("$.type").alias("type"), at("$.quarantined_at").alias("quarantined_at"), at("$.reason.category").alias("category"), at("$.reason.stage").alias("stage"),
        at("$.source.partition").cast("long").alias("source_partition"), at("$.source.offset").cast("long").alias("source_offset"), at("$.source.key").alias("source_key"),
        at("$.original_message.data.event_id").cast("long").alias("original_id"),
    )


@query(
    """SELECT event_id, first_value(event_id) OVER w AS winner_id, CASE WHEN row_number() OVER w = 1 THEN 'allow' ELSE 'duplicate' END AS decision
 FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"""
)
def dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(_table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id").select("event_id", "winner_id", "decision")


def _ttl_sql(allowed: str, renewed: str) -> str:
    return f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 f AS (SELECT user_id, rn, event_id, event_id AS winner_id, t + {DAY} AS until, 'allow' AS decision FROM r WHERE rn = 1
 UNION ALL SELECT r.user_id, r.rn, r.event_id, CASE WHEN {allowed} THEN r.event_id ELSE f.winner_id END,
 CASE WHEN {allowed} THEN r.t + {DAY} WHEN {renewed} THEN greatest(f.until, r.t + {DAY}) ELSE f.until END, CASE WHEN {allowed} THEN 'allow' ELSE 'duplicate' END
 FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT event_id, winner_id, decision FROM f"""


def _ttl(spark, sf_dir, **more):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", _micros("ts").alias("t"), (F.col("event_id") % 50 == 0).alias("fifty"))
    return dedup.ttl_wins(e, ["user_id"], "t", "event_id", DAY, "event_id", **more).select("event_id", "winner_id", "decision")


@query(_ttl_sql("r.t >= f.until", "false"))
def dedup_ttl(spark, sf_dir):
    return _ttl(spark, sf_dir)


@query(_ttl_sql("(r.t >= f.until OR r.event_id % 50 = 0)", "false"))
def dedup_force(spark, sf_dir):
    return _ttl(spark, sf_dir, force="fifty")


@query(_ttl_sql("r.t >= f.until", "r.event_id % 50 = 0"))
def dedup_persist_heartbeat(spark, sf_dir):
    return _ttl(spark, sf_dir, renews="fifty")


@query(
    """SELECT o_orderkey, CASE WHEN known OR n > 1 THEN 'duplicate' ELSE 'allow' END AS decision, CASE WHEN n > 1 THEN 'cache' WHEN known THEN 'backfill' ELSE 'reserve' END AS via
 FROM (SELECT o_orderkey, o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS known, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"""
)
def admit_with_backfill(spark, sf_dir):
    stored = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return dedup.admit(rows, "o_custkey", ["o_orderdate", "o_orderkey"], stored).select("o_orderkey", "decision", "via")


@query("SELECT o_orderkey, 'reject' AS decision, 'dependency' AS via, CAST(5 AS INTEGER) AS retry_after FROM orders")
def admit_without_backfill(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return dedup.admit(rows, "o_custkey", ["o_orderkey"], None).select("o_orderkey", "decision", "via", "retry_after")


@query(
    """SELECT o_orderkey, CASE WHEN n > 1 OR (o_custkey % 2 = 0 AND o_orderpriority = '1-URGENT') THEN 'duplicate' ELSE 'allow' END AS decision,
 CASE WHEN g = 1 THEN 'load' ELSE 'cached' END AS stage FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS g FROM orders)"""
)
def admit_group(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    stored = rows.where("o_custkey % 2 = 0").select("o_custkey", F.lit("1-URGENT").alias("o_orderpriority"))
    return dedup.admit_group(rows, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], stored).select("o_orderkey", "decision", "stage")


@query(
    """WITH p AS (SELECT *, hour(ts) IN (10, 11) AS rejecting FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY rejecting, user_id, event_type ORDER BY ts, event_id) AS n FROM p)
 SELECT event_id, CASE WHEN rejecting THEN 'backpressure' WHEN n > 1 THEN 'duplicate' WHEN event_id % 41 = 0 THEN 'unavailable' ELSE 'accepted' END AS kind FROM d"""
)
def push_verdicts(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("rejecting", F.hour("ts").isin(10, 11))
    # a rejected push writes nothing, so it takes no part in admission
    d = dedup.first_wins(e, ["rejecting", "user_id", "event_type"], ["ts", "event_id"], "event_id")
    return d.select("event_id", dedup.push_verdict(F.col("rejecting"), F.col("decision"), F.col("event_id") % 41 != 0).alias("kind"))


@query(
    f"""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 f AS (SELECT user_id, rn, event_id, event_id AS winner_id, t + {DAY} AS until, CASE WHEN user_id % 5 = 0 THEN 'duplicate' ELSE 'allow' END AS decision, CASE WHEN user_id % 5 = 0 THEN 'backfill' ELSE 'reserve' END AS via FROM r WHERE rn = 1
 UNION ALL SELECT r.user_id, r.rn, r.event_id, CASE WHEN r.t >= f.until THEN r.event_id ELSE f.winner_id END, CASE WHEN r.t >= f.until THEN r.t + {DAY} ELSE f.until END,
 CASE WHEN r.t < f.until OR r.user_id % 5 = 0 THEN 'duplicate' ELSE 'allow' END, CASE WHEN r.t < f.until THEN 'cache' WHEN r.user_id % 5 = 0 THEN 'backfill' ELSE 'reserve' END
 FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1) SELECT event_id, decision, via, CASE WHEN user_id % 5 = 0 THEN 'stored' ELSE CAST(winner_id AS VARCHAR) END AS summary FROM f"""
)
def admission_over_batches(spark, sf_dir):
    """Events in two batches, the second decided on what the first one left."""
    e = _table(spark, sf_dir, "events")
    key, long = F.col("user_id").cast("string"), F.col("event_id")
    rows = e.select(key.alias("key"), key.alias("identity"), long.cast("string").alias("summary"), _micros("ts").alias("t"), long.alias("sequence"), F.lit(False).alias("force"))
    stored = e.where("user_id % 5 = 0").select(key.alias("key"), key.alias("identity"), F.lit("stored").alias("summary")).distinct()
    middle = _table(spark, sf_dir, "events").agg(F.expr("(max(event_id) + min(event_id)) div 2").alias("m"))
    first = rows.join(F.broadcast(middle), F.col("sequence") <= F.col("m")).drop("m")
    second = rows.join(F.broadcast(middle), F.col("sequence") > F.col("m")).drop("m")
    one = carrier.decide(first, spark.range(0).selectExpr("cast(null as string) key", "cast(null as string) identity", "cast(null as string) summary", "cast(null as long) until"), stored, DAY, held=False)
    two = carrier.decide(second, one.state, stored, DAY, held=False)
    return one.rows.union(two.rows).select(F.col("sequence").alias("event_id"), "decision", "via", "summary")


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY {", ".join(c + " DESC" for c in _LINE_ORDER)}) AS n FROM lineitem) WHERE n = 1"""
)
def collapse_last(spark, sf_dir):
    out = dedup.collapse_last(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _order_halves(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # the target has the orders but those that 4 divides with a rest of 1; the source has these and every third one
    return o.where("o_orderkey % 4 != 1"), o.where("o_orderkey % 4 = 1 or o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))


_SOURCE = "(o_orderkey % 4 = 1 OR o_orderkey % 3 = 0)"
_MERGED = f"""SELECT o_orderkey, o_custkey, CASE WHEN {_SOURCE} THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"""


@query(_MERGED)
def upsert_merge(spark, sf_dir):
    target, source = _order_halves(spark, sf_dir)
    return upsert.merge(target, source, ["o_orderkey"])


@query(f"""SELECT 'orders' AS target, count(*) AS n, sum(CASE WHEN o_orderstatus = 'X' THEN 1 ELSE 0 END)::BIGINT AS changed FROM ({_MERGED})
 UNION ALL SELECT 'customers', count(DISTINCT o_custkey), count(DISTINCT CASE WHEN {_SOURCE} THEN o_custkey END) FROM orders""")
def upsert_multi_target(spark, sf_dir):
    target, source = _order_halves(spark, sf_dir)
    count = lambda name, df, changed: df.agg(F.lit(name).alias("target"), F.count("*").alias("n"), F.count_if(changed).cast("long").alias("changed"))
    people = lambda df, new: df.groupBy("o_custkey").agg(F.lit(new).alias("new"), F.max("o_orderkey").alias("o_orderkey"))
    customers = upsert.merge(people(target, False), people(source, True), ["o_custkey"], ["o_orderkey"])
    return count("orders", upsert.merge(target, source, ["o_orderkey"]), F.col("o_orderstatus") == "X").union(count("customers", customers, F.col("new")))


@query("SELECT event_id, event_id % 7 = 0 OR event_id % 11 IN (0, 1) AS missing FROM events")
def upsert_key_check(spark, sf_dir):
    k = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(k % 7 == 0, F.lit(0)).otherwise(k % 7).alias("a"), F.when(k % 11 == 0, F.lit("")).when(k % 11 == 1, F.lit(None)).otherwise("0").alias("b"))
    return rows.select("event_id", upsert.key_missing(rows, ["a", "b"]).alias("missing"))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
 ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END DESC, CASE WHEN o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) ELSE 0 END DESC, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def backfill_latest(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("at", F.when(F.col("o_orderkey") % 5 != 0, _micros("o_orderdate")))
    return upsert.latest(o, "o_custkey", ["at"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


_ERRORS = [
    ("integrity", "violation (2627) (SQLExecDirectW)", "poison"), ("operational", "deadlock (1205)", "retry"), ("other", "too long (8152) after (1205)", "poison"),
    ("operational", "Connection reset by peer", "retry"), ("operational", "no such table", "poison"), ("value", "bad key (1205)", "poison"),
    ("timeout", "(2627)", "retry"), ("kafka", "", "retry"), ("data", "out of range", "poison"), ("other", "login (-2) (x)", "retry"), ("other", "unknown", "poison"),
]
_ERROR_ROWS = ", ".join(f"({k}, '{c}', '{m}')" for k, (c, m, _) in enumerate(_ERRORS))


_NUMBERS = lambda codes: " OR ".join(f"message LIKE '%({c})%'" for c in codes)
_WORDS = " OR ".join(f"contains(lower(message), '{w}')" for w in scalars.INFRA_WORDS)


@query(
    f"""WITH t(k, class, message) AS (VALUES {_ERROR_ROWS}) SELECT event_id, class, message, CASE WHEN class IN ('timeout', 'kafka') THEN 'retry' WHEN class = 'value' THEN 'poison'
 WHEN {_NUMBERS(scalars.DATA_CODES)} THEN 'poison' WHEN {_NUMBERS(scalars.INFRA_CODES)} THEN 'retry' WHEN class IN ('integrity', 'data') THEN 'poison'
 WHEN class = 'operational' AND ({_WORDS}) THEN 'retry' ELSE 'poison' END AS verdict FROM events JOIN t ON event_id % {len(_ERRORS)} = k"""
)
def error_classify(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(m).alias("message")) for c, m, _ in _ERRORS])
    e = _table(spark, sf_dir, "events").select("event_id", F.get(rows, (F.col("event_id") % len(_ERRORS)).cast("int")).alias("x")).select("event_id", "x.*")
    return e.withColumn("verdict", scalars.classify_error(F.col("class"), F.col("message")))


@query(
    """WITH e AS (SELECT event_id // 500 AS batch, event_id, event_id % 97 = 0 OR event_id % 1500 < 2 AS bad, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS n FROM events),
 b AS (SELECT batch, count(*) AS rows_, count(*) FILTER (bad) AS bads, count(*) FILTER (bad AND n <= 2) AS head FROM e GROUP BY batch)
 SELECT batch, CASE WHEN head = 2 THEN 'aborted' ELSE 'done' END AS outcome, CASE WHEN head = 2 THEN 0 ELSE rows_ - bads END AS handled, CASE WHEN head = 2 THEN 0 ELSE bads END AS quarantined FROM b"""
)
def poison_locate(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 500).cast("long").alias("batch"))
    return flow.locate_by_predicate(e, ["batch"], "event_id", (F.col("event_id") % 97 == 0) | (F.col("event_id") % 1500 < 2))


@query(
    """SELECT event_id, (row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 100 AS exact_batch,
 (row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 120 AS poll_batch FROM events"""
)
def microbatch_assign(spark, sf_dir):
    from pyspark.sql import Window

    # the source numbers each partition; a test table has to be numbered here
    offset = F.row_number().over(Window.partitionBy("part").orderBy("event_id")) - 1
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("part")).withColumn("offset", offset)
    both = flow.assign_batches(flow.assign_batches(e, "part", "offset", 100).withColumnRenamed("batch", "exact_batch"), "part", "offset", 100, poll=40)
    return both.select("event_id", "exact_batch", F.col("batch").alias("poll_batch"))


@query("SELECT r AS row_number, (r - 1) // 1000 AS two_fields, r - 1 AS many_fields FROM range(1, 5001) t(r)")
def param_chunks(spark, sf_dir):
    r = spark.range(1, 5001).select(F.col("id").alias("row_number"))
    return r.select("row_number", scalars.chunk_of(F.col("row_number"), 2).alias("two_fields"), scalars.chunk_of(F.col("row_number"), 2001).alias("many_fields"))


@query("SELECT CAST(n AS BIGINT) AS n, least(30.0, pow(2.0, least(n, 5)))::DOUBLE AS capped, pow(2.0, n)::DOUBLE AS uncapped FROM range(0, 12) t(n)")
def backoff_schedule(spark, sf_dir):
    return spark.range(12).select(F.col("id").alias("n"), scalars.backoff_seconds(F.col("id")).alias("capped"), scalars.handler_backoff_seconds(F.col("id")).alias("uncapped"))


_SECONDS = "SELECT event_type, epoch_us(ts) // 1000000 AS s, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS c, max(CAST(round(value * 100) AS BIGINT)) AS m FROM events GROUP BY ALL"
_FRAME = "WINDOW w AS (PARTITION BY event_type ORDER BY s RANGE BETWEEN 599 PRECEDING AND CURRENT ROW)"


def _windows(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", F.floor(_micros("ts") / 1_000_000).cast("long").alias("s"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return flow.rate_windows(e, "event_type", "s", "cents", 600), e.agg(F.min("s").alias("t0"))


@query(f"""WITH q AS ({_SECONDS}), z AS (SELECT min(s) AS t0 FROM q) SELECT event_type, s, sum(n) OVER w::BIGINT AS events, round(sum(n) OVER w / least(600.0, greatest((s - t0)::DOUBLE, 1.0)), 9) AS rate FROM q, z {_FRAME}""".replace("sum(n) OVER w::BIGINT", "CAST(sum(n) OVER w AS BIGINT)"))
def rate_window(spark, sf_dir):
    w, start = _windows(spark, sf_dir)
    t0 = start.first().t0 or 0
    return w.select("event_type", "s", "events", F.round(flow.rate_per_second(F.col("events"), F.col("s") - t0, 600), 9).alias("rate"))


@query(f"SELECT event_type, s, round(sum(c) OVER w / sum(n) OVER w, 6) AS avg_ms, CAST(max(m) OVER w AS BIGINT) AS max_ms FROM ({_SECONDS}) {_FRAME}")
def latency_window(spark, sf_dir):
    w, _ = _windows(spark, sf_dir)
    return w.select("event_type", "s", F.round(F.col("total") / F.col("events"), 6).alias("avg_ms"), F.col("most").alias("max_ms"))


@query("""SELECT user_id, CASE WHEN age > 2073600 THEN 'error' WHEN age > 1296000 THEN 'warning' ELSE 'ok' END AS level, age FROM
 (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - max(epoch_us(ts)) + (user_id % 30) * 86400000000) // 1000000 AS age FROM events GROUP BY user_id)""")
def backlog_level(spark, sf_dir):
    # a user's last event counts as handled; what a user is behind differs by whole days so that all levels occur
    as_of = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    last = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(_micros("ts")).alias("last"))
    age = F.floor((as_of - F.col("last") + (F.col("user_id") % 30) * DAY) / 1_000_000).cast("long")
    return last.select("user_id", scalars.backlog_level(age, 2_592_000).alias("level"), age.alias("age"))


@query("""SELECT sum(greatest(n - greatest(coalesce(done, 0), 0), 0))::BIGINT AS lag FROM (SELECT user_id % 4 AS p, count(*) AS n, CASE WHEN user_id % 4 = 1 THEN NULL ELSE max(CASE WHEN event_id % 3 = 0 THEN event_id END) // 8 END AS done
 FROM events GROUP BY user_id % 4)""")
def consumer_lag(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("p", F.col("user_id") % 4)
    by = e.groupBy("p").agg(F.count("*").alias("n"), F.max(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("m"))
    return by.agg(F.sum(flow.lag(F.col("n"), F.when(F.col("p") != 1, F.floor(F.col("m") / 8)))).cast("long").alias("lag"))


_SERIES = """SELECT user_id % 4 AS signal, epoch_us(ts) // 3600000000 AS h, count(*) AS n, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE count(*)::DOUBLE END AS age,
 (epoch_us(ts) // 3600000000) % 13 <> 0 AS reachable, CASE WHEN (epoch_us(ts) // 3600000000) % 17 = 0 THEN 'lost' ELSE 'connected' END AS kafka FROM events GROUP BY ALL"""


def _series(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("signal"), F.floor(_micros("ts") / 3_600_000_000).cast("long").alias("h"))
    s = e.groupBy("signal", "h").agg(F.count("*").alias("n"))
    return s.select(
        "signal", "h", F.when(F.col("n") % 7 != 0, F.col("n").cast("double")).alias("age"), (F.col("h") % 13 != 0).alias("reachable"),
        F.lit("healthy").alias("status"), F.when(F.col("h") % 17 == 0, "lost").otherwise("connected").alias("kafka"),
    )


@query(
    f"""SELECT signal, h, coalesce(last_value(CASE WHEN age > 4 THEN true WHEN age < 3 OR age IS NULL THEN false END IGNORE NULLS) OVER (PARTITION BY signal ORDER BY h
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS rejecting FROM ({_SERIES})"""
)
def hysteresis_age(spark, sf_dir):
    return flow.hysteresis_by_age(_series(spark, sf_dir), "signal", "h", "age", 4, 3).select("signal", "h", "rejecting")


_NEXT = """CASE WHEN NOT r.reachable THEN coalesce(f.reason, 'unreachable') WHEN r.kafka <> 'connected' THEN 'kafka_down'
 WHEN f.reason IS NOT NULL AND f.reason <> 'backlog' THEN CASE WHEN r.age > 4 THEN 'backlog' END WHEN r.age IS NULL THEN NULL
 WHEN f.reason = 'backlog' THEN CASE WHEN r.age < 3 THEN NULL ELSE 'backlog' END WHEN r.age > 4 THEN 'backlog' END"""


@query(
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY h) AS rn FROM ({_SERIES})),
 f AS (SELECT signal, rn, h, reason FROM (SELECT r.signal, r.rn, r.h, {_NEXT} AS reason FROM s r, (SELECT NULL::VARCHAR AS reason) f WHERE r.rn = 1)
 UNION ALL SELECT r.signal, r.rn, r.h, {_NEXT} FROM f JOIN s r ON r.signal = f.signal AND r.rn = f.rn + 1)
 SELECT signal, h, CASE WHEN reason IS NULL THEN 'OPEN' ELSE 'REJECTING' END AS state, reason FROM f"""
)
def hysteresis_full(spark, sf_dir):
    return flow.hysteresis(_series(spark, sf_dir), "signal", "h", 4, 3).select("signal", "h", "state", "reason")


@query(
    """SELECT count(*) AS received, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'degraded' END AS status,
 'degraded' AS without_backfill FROM events"""
)
def health_snapshot(spark, sf_dir):
    e = _table(spark, sf_dir, "events").agg(F.count("*").alias("received"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))
    there = F.col("received") > 0
    return e.withColumn("status", flow.health(there, there, there)).withColumn("without_backfill", flow.health(there, there, F.lit(None).cast("boolean")))


# addresses made from the rows, so that each rule has many inputs
_ADDRESS = "(CASE c_custkey % 4 WHEN 0 THEN 'HTTPS://' WHEN 1 THEN ' kafka://' WHEN 2 THEN 'sqlite+x://' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN 'user:p@s' || c_custkey || '@' ELSE '' END || 'host' || c_custkey || ':9' || CASE WHEN c_custkey % 5 = 0 THEN ', http://b:1 ,,' ELSE '' END)"


@query(
    f"""WITH a AS (SELECT c_custkey, {_ADDRESS} AS url FROM customer),
 b AS (SELECT c_custkey, string_agg(p, ',' ORDER BY i) AS brokers FROM (SELECT c_custkey, i, CASE WHEN lower(p) LIKE 'https://%' THEN substr(p, 9) WHEN lower(p) LIKE 'http://%' THEN substr(p, 8)
 WHEN lower(p) LIKE 'kafka://%' THEN substr(p, 9) ELSE p END AS p FROM (SELECT c_custkey, i, trim(string_split(url, ',')[i]) AS p FROM a, unnest(range(1, len(string_split(url, ',')) + 1)) x(i))) WHERE p <> '' GROUP BY c_custkey)
 SELECT c_custkey, brokers, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 3 THEN split_part(url, 'user:', 1) || 'user:***@host' || split_part(url, '@host', 2) ELSE url END AS redacted,
 CASE WHEN c_custkey % 4 = 2 THEN 'sqlite' ELSE 'mssql' END AS dialect FROM a JOIN b USING (c_custkey)"""
)
def conn_normalize(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ADDRESS).alias("url"))
    u = F.col("url")
    return rows.select("c_custkey", scalars.clean_brokers(u).alias("brokers"), scalars.redact_connection(u).alias("redacted"), scalars.dialect(u).alias("dialect"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def parse_summary(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(scalars.parse_summary(F.col("props")), F.lit("k")).cast("long"), F.lit(-1)).alias("k"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, o_orderpriority AS plain FROM orders")
def iso_normalize(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalars.jsonable(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("iso"), scalars.jsonable(F.col("o_orderpriority")).alias("plain"))


@query(
    f"""WITH {WIRE_SQL}, ok AS (SELECT event_id, user_id, ts, json_extract_string(value, '$.data.event_type') AS event_type FROM typed WHERE NOT is_poison AND (type IS NULL OR type = 'event')),
 d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM ok) SELECT event_type, CASE WHEN n = 1 THEN 'allow' ELSE 'duplicate' END AS decision, count(*) AS n FROM d GROUP BY ALL"""
)
def pipeline_decisions(spark, sf_dir):
    """The flagship: encode, decode, gate and admit, counted by decision."""
    d = codec.decode(wire(spark, sf_dir)).where(~F.col("is_poison") & codec.passes_gate(F.col("type"), "event"))
    d = d.select("event_id", "key", F.get_json_object("value", "$.data.event_type").alias("event_type"))
    out = dedup.first_wins(d, ["key", "event_type"], ["event_id"], "event_id")
    return out.groupBy("event_type", "decision").agg(F.count("*").alias("n"))

"""Scalar rules of the pipeline as Column functions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error numbers of data and of infrastructure, and words of infrastructure errors.
DATA_CODES = (8152, 2628, 8114, 8169, 245, 2627, 2714, 547, 233, 515)
INFRA_CODES = (1205, 1204, 1222, -2, 4060, 18456, 40197, 40613, 40501, 49918, 49919, 49920)
INFRA_WORDS = ("connection", "timeout", "broken pipe", "reset by peer", "closed", "login failed", "pool")


def backoff_seconds(n: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Capped exponential backoff; the exponent stops at 5."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(n, F.lit(5))))


def handler_backoff_seconds(attempt: Column, base: float = 1.0) -> Column:
    """Backoff between handler attempts; uncapped."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def backlog_level(age: Column, ttl: float) -> Column:
    """error beyond 0.8 of the time to live, warning beyond half of it, else ok; both strict."""
    return F.when(age > 0.8 * ttl, "error").when(age > ttl / 2, "warning").otherwise("ok")


def clean_brokers(brokers: Column) -> Column:
    """A comma list with each part trimmed and freed of one scheme."""
    one = lambda x: F.regexp_replace(F.trim(x), r"(?i)^(https?|kafka)://", "")
    return F.array_join(F.filter(F.transform(F.split(brokers, ","), one), lambda x: x != ""), ",")


def redact_connection(url: Column) -> Column:
    """user:password@host with the password starred, cut at the last at sign."""
    return F.regexp_replace(url, r"^([^:]+://[^:/@]*):.*@", "$1:***@")


def dialect(url: Column) -> Column:
    return F.when(F.lower(url).contains("sqlite"), "sqlite").otherwise("mssql")


def iso_utc(ts: Column) -> Column:
    """ISO time in UTC with milliseconds and Z, whatever the session's zone; a time without zone is taken as UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = epoch + F.make_dt_interval(secs=(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    # as text, so that no zone takes part
    text = F.when(F.typeof(ts) == "timestamp_ntz", ts.cast("string")).otherwise(at.cast("string"))
    return F.concat(F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")), F.lit("."), F.rpad(F.substring(text, 21, 3), 3, "0"), F.lit("Z"))


_ISO = r"^(\d{4}-\d{2}-\d{2}).(\d{2}:\d{2})(:\d{2})?(?:[.,](\d+))?(?:(Z)|([+-]\d{2}):?(\d{2}))?$"


def jsonable(text: Column) -> Column:
    """A string that reads as a date and time becomes ISO, with its microseconds, if any, and its offset; any other stays."""
    looks = (F.length(text) >= 19) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & text.rlike(_ISO)
    part = lambda k: F.regexp_extract(text, _ISO, k)
    second = F.when(part(3) == "", ":00").otherwise(part(3))
    micros = F.rpad(F.substring(part(4), 1, 6), 6, "0")
    offset = F.when(part(5) == "Z", "+00:00").when(part(6) != "", F.concat(part(6), F.lit(":"), part(7))).otherwise("")
    there = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), second, F.lit("+00:00"))).isNotNull()
    made = F.concat(part(1), F.lit("T"), part(2), second, F.when((part(4) != "") & (micros != "000000"), F.concat(F.lit("."), micros)).otherwise(""), offset)
    return F.when(looks, F.when(there, made).otherwise(text)).otherwise(text)


def parse_summary(text: Column) -> Column:
    """A JSON object as a map; anything else is the empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def is_falsy(value: Column, kind: str) -> Column:
    """Missing by truth value: null, what is empty, zero, false; a date or time is missing only if it is null."""
    if kind == "string" or kind.startswith(("char", "varchar")):
        return value.isNull() | (value == F.lit(""))
    if kind == "boolean":
        return value.isNull() | ~value
    if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) and not kind.startswith("interval"):
        return value.isNull() | (value == F.lit(0))
    if kind == "binary":
        return value.isNull() | (F.length(value) == 0)
    return value.isNull() | (F.size(value) == 0) if kind.startswith(("array", "map")) else value.isNull()


def chunk_of(row_number: Column, fields: int, budget: int = 2000) -> Column:
    """The statement a row (from 1) goes to when one statement may hold `budget` parameters."""
    return F.floor((row_number - 1) / max(1, budget // fields)).cast("long")


def error_numbers(message: Column) -> Column:
    """Parenthesised numbers of an error message."""
    return F.transform(F.regexp_extract_all(message, F.lit(r"\((-?\d{1,10})\)"), F.lit(1)), lambda x: x.cast("long"))


def classify_error(kind: Column, message: Column) -> Column:
    """retry or poison, by error class and message.

    Order: time-outs and broker errors retry; value errors are poison; data codes
    are poison before infrastructure codes retry; integrity and data errors are
    poison; operational errors retry on an infrastructure word; all else is poison.
    """
    codes = error_numbers(message)
    has = lambda wanted: F.arrays_overlap(codes, F.array(*[F.lit(c).cast("long") for c in wanted]))
    words = F.lit(False)
    for w in INFRA_WORDS:
        words = words | F.contains(F.lower(message), F.lit(w))
    return (
        F.when(kind.isin("timeout", "kafka"), "retry")
        .when(kind == "value", "poison")
        .when(has(DATA_CODES), "poison")
        .when(has(INFRA_CODES), "retry")
        .when(kind.isin("integrity", "data"), "poison")
        .when((kind == "operational") & words, "retry")
        .otherwise("poison")
    )

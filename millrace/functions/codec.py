"""The wire envelope: encode, decode with poison separation, the type gate and the dead-letter payload."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .scalars import iso_utc

PREVIEW = 500


def encode(data: Column, kind: str, received_at: Column, source: str, version: str | None = None) -> Column:
    """JSON of type, received_at, source, data and, if a version is stamped, v."""
    fields = [F.lit(kind).alias("type"), iso_utc(received_at).alias("received_at"), F.lit(source).alias("source"), data.alias("data")]
    return F.to_json(F.struct(*fields, *([F.lit(version).alias("v")] if version else [])))


def _read(value: str | None):
    """What a strict JSON reader makes of a value; None where it is no JSON, or nested too deep to be read."""
    try:
        return json.loads(value) if isinstance(value, str) else None
    except (ValueError, RecursionError):
        return None


def _envelopes(values: pd.Series) -> pd.DataFrame:
    """is_poison and type of each value."""
    parsed = [_read(v) for v in values]
    good = [isinstance(p, dict) and isinstance(p.get("data"), dict) for p in parsed]
    kinds = [str(p["type"]).encode("utf-8", "replace").decode() if ok and "type" in p else None for ok, p in zip(good, parsed)]
    return pd.DataFrame({"is_poison": [not ok for ok in good], "type": kinds})


#: A value's poison test and type in one parse.  Not deterministic to the optimiser, so that no filter makes it parse again.
_envelope = F.pandas_udf(_envelopes, StructType([StructField("is_poison", BooleanType()), StructField("type", StringType())])).asNondeterministic()


@F.pandas_udf(StringType())
def original_message(value: pd.Series) -> pd.Series:
    """A value as JSON: itself where it is an object, else the object that has it as raw."""
    parsed = ((v, _read(v)) for v in value)
    return pd.Series([json.dumps(p if isinstance(p, dict) else {"raw": v if isinstance(v, str) else None}) for v, p in parsed], dtype=object)


def _loose(value: Column) -> Column:
    """(is_poison, type) on VARIANT, parsed once: the value is bound as an element of an array of one."""

    def read(parsed: Column) -> Column:
        data = F.schema_of_variant(F.try_variant_get(parsed, "$.data", "variant"))
        kind = F.schema_of_variant(F.try_variant_get(parsed, "$.type", "variant"))
        text = F.try_variant_get(parsed, "$.type", "string")
        bad = ~F.coalesce(data.like("OBJECT%"), F.lit(False))
        said = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
        return F.struct(bad.alias("is_poison"), F.when(~bad, said).alias("type"))

    return F.transform(F.array(F.try_parse_json(value)), read)


def decode(rows: DataFrame, value_col: str = "value", exact: bool = True) -> DataFrame:
    """rows with is_poison and type; poison is what is null, not JSON, not an object, or without an object as data.

    A poison row has no type; an absent type is null, a JSON null reads None, true
    and false True and False.  A value is parsed once, by a strict JSON reader: it
    takes NaN and repeated keys, the last of which counts, and no text after the
    object; what is nested too deep for it is poison.  Not `exact`, the parser is the
    JVM's, which takes text after the object and refuses NaN and repeated keys.
    """
    if exact:
        name = "__envelope"
        return rows.withColumn(name, _envelope(F.col(value_col))).select(*rows.columns, f"{name}.is_poison", f"{name}.type")
    # a generator's rows: no filter on them is pushed below the parse
    return rows.select("*", F.inline(_loose(F.col(value_col))))


def poison_preview(value: Column) -> Column:
    """What is logged of a poison row."""
    return F.substring(value, 1, PREVIEW)


def passes_gate(kind: Column, expected: str | None) -> Column:
    """A row passes unless its type is there and differs from the expected one."""
    return F.lit(True) if expected is None else (kind.isNull() | (kind == expected))


def dlq_payload(value: Column, kind: Column, category: str, error: Column, stage: str, partition: Column, offset: Column, key: Column, at: Column) -> Column:
    """The dead-letter message; the original is kept as an object, or under raw where it isn't one."""
    original = original_message(value)
    head = F.to_json(
        F.struct(
            kind.alias("type"),
            iso_utc(at).alias("quarantined_at"),
            F.struct(F.lit(category).alias("category"), error.alias("error"), F.lit(stage).alias("stage")).alias("reason"),
            F.struct(partition.alias("partition"), offset.alias("offset"), key.alias("key")).alias("source"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"original_message":'), original, F.lit("}"))

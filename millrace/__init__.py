"""Millrace: admission, validation and delivery of keyed event streams on Spark.

The public names are loaded when they are first asked for.
"""

from importlib import import_module

_WHERE = {
    "millrace.streaming.pipeline": ("Consumer", "Context", "Fatal", "Producer", "Retry", "classify", "push"),
    "millrace.streaming.outlet": ("upsert_consumer", "upsert_handler"),
    "millrace.streaming.signals": ("AlwaysOpen", "HttpProbe", "Manual", "ProbeResult", "ProbeSignal", "Snapshot"),
    "millrace.streaming.health": ("inlet_report", "outlet_report", "part_ok", "query_ok", "running"),
    "millrace.streaming.observe": ("BacklogWatch", "JsonLines", "Meter", "emit", "meters"),
    "millrace.streaming.dedup": ("admit_group_stream", "admit_stream"),
    "millrace.streaming.protocols": ("Admission", "Backpressure", "Decoder", "Encoder", "Targets"),
    "millrace.operators.carrier": ("Carrier", "Decisions", "MemoryCarrier", "decide"),
    "millrace.operators.dedup": ("admit", "admit_group", "collapse_last", "first_wins", "push_verdict", "ttl_wins"),
    "millrace.operators.flow": ("assign_batches", "hysteresis", "hysteresis_by_age", "lag", "locate", "locate_by_predicate", "rate_per_second", "rate_windows"),
    "millrace.operators.upsert": ("Upsert", "VersionedTargets", "key_missing", "latest", "merge"),
    "millrace.functions.codec": ("decode", "dlq_payload", "encode", "passes_gate"),
    "millrace.plans.options": ("BackpressureConfig", "ConsumerOptions", "DbConfig", "DedupOptions", "DlqOptions", "KafkaConfig", "MetricsConfig", "ProducerOptions", "RuntimeTuning", "resolve_db"),
    "millrace.sources.sinks": ("SqlTargets", "connector", "kafka_sink", "table_sink", "upsert_statement"),
    "millrace.sources.tables": ("RECORD", "backfill", "file_stream", "jdbc_backfill", "jdbc_table", "kafka_stream"),
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"millrace has no {name}")
    return getattr(import_module(_MODULE[name]), name)

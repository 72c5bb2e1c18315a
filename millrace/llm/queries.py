"""Thin queries over the corpus operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, langid, lm, oracles, packing, passages, secrets, simhash, toxicity
from .common import id_fold, scratch, table

#: Session setting: folder of the stored ledger of secret scans.
LEDGER_PATH = "spark.millrace.secretLedger"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is the table that the setting names, which later calls go on with; without it, one of this call."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, spark.conf.get(LEDGER_PATH, None) or scratch(spark, "secret-ledger"))
    found = secrets.findings(docs, ledger.update(docs))
    names = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in names]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = langid.fit(docs, langid.learnable())
    out = langid.identify(docs, parser)
    return out.select(F.col("id").alias("doc_id"), (id_fold("id", 3) == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.fit(docs, lm.learnable())
    out = lm.score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (id_fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.repeated_passages(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_words", "n_repeated", "n_within", F.size("spans").cast("long").alias("n_spans"), text.alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    out = toxicity.score(docs, model)
    return out.select(F.col("id").alias("doc_id"), (id_fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = chat.format_conversations(said.unionByName(more)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_langid": op2_langid,
    "op3_ann": op3_ann,
    "op4_lm": op4_lm,
    "op5_passages": op5_passages,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_decontaminate": op8_decontaminate,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL = {
    "op1_secret_scan": oracles.SECRETS,
    "op8_decontaminate": oracles.CONTAMINATION,
    "op9_chat": oracles.CHAT,
}

"""The stages of the corpus pipeline, from documents to sampled token ids; each takes (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import langid, minhash, mixing, pieces, secrets
from docloom.llm.common import shared_folder, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, or no letter) go, whether or not any document is labelled.

    Any text with a letter has a nearest language, however far, so labels decide nothing but its name.
    """
    return langid.accepted(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) the document of smallest doc_id stays, once.

    Documents without words are in no group and stay.  Equal ids may stand for different texts: rows are told apart by
    id and hash of the text.
    """
    rows = minhash.grouped(docs, percent=80)
    linked = rows.where("component is not null")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r"))
    kept = first.select("r.doc_id", "r.text_hash").union(rows.where("component is null").select("doc_id", "text_hash").distinct())
    again = linked.groupBy("doc_id", "text_hash").count().where("count > 1")

    def among(ids: DataFrame):
        return docs["doc_id"].eqNullSafe(ids["doc_id"]) & (F.xxhash64(docs["text"]) == ids["text_hash"])

    held = docs.join(kept, among(kept), "left_semi")
    single = held.join(again, among(again), "left_anti")
    return single.union(held.join(again, among(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced with a mark; all documents stay, others unchanged."""
    names = unused(docs, "_blob"), unused(docs, "_spans")
    rows, found = secrets.BlobLedger(spark).scan(docs, names=names), F.col(names[1])
    clean, changed = secrets.redacted(F.col("text"), found), F.size(found) > 0
    values = {"text": clean, "n_chars": F.when(changed, F.length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled token ids of each document."""
    return pieces.encode(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "lossless")


STAGES = [("language", language), ("near_dedup", near_dedup), ("redact_secrets", redact_secrets), ("mix_sources", mix_sources), ("sample_pieces", sample_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again before the next."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

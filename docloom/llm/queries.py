"""The ten queries, one for each operator, over its whole table, and the pipeline; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import langid, maxscore, minhash, mixing, pieces, pipeline, secrets, syncmers, toxicity, urlfilter, warc
from docloom.llm.oracle import oracle_sql as oracle_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return syncmers.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    folder, manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder, manifest).drop("url", "payload")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, linked from a similarity of 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels.withColumn("low_quality", 1 - F.col("quality"))))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secrets.findings(_table(spark, sf_dir, "documents"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", maxscore.scaled(F.col("embedding")).alias("v"))
    return maxscore.topk(rows, rows.where("vec_id % 50 = 0"), 5)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text."""
    return pieces.encode(_table(spark, sf_dir, "documents")).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "lossless")


#: The tables have no fetch times and no lists.  A capture's day and the lists' events are made from digests of the
#: page's id and host: a third of hosts is blocked for some time, a tenth of their parent domains is allowed.
def _number(column: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(column), start, 4), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (_number(F.col("page_id").cast("string"), 1) % 365).alias("day"))


def list_events(pages: DataFrame) -> DataFrame:
    hosts = pages.select(urlfilter.host(F.col("url")).alias("host")).where("host is not null").distinct()
    blocked = hosts.where(_number(F.col("host"), 1) % 3 == 0).select(F.lit("block").alias("list"), F.col("host").alias("pattern"), (_number(F.col("host"), 5) % 300).alias("day"), (_number(F.col("host"), 9) % 200 + 1).alias("days"))
    parents = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct()
    allowed = parents.where(_number(F.col("pattern"), 13) % 10 == 0).select(F.lit("allow").alias("list"), "pattern", (_number(F.col("pattern"), 17) % 300).alias("day"), (_number(F.col("pattern"), 21) % 200 + 1).alias("days"))
    both = blocked.union(allowed)
    return both.select("list", "pattern", F.lit("add").alias("action"), "day").union(both.select("list", "pattern", F.lit("remove").alias("action"), F.col("day") + F.col("days")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture judged by the entries active on its day."""
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.judged(captures(pages), list_events(pages))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.identify(docs, profiles).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict:
    own = (op1_closed_syncmers, op2_warc, op3_source_mix, op4_minhash_dedup, op5_toxicity, op6_secret_scan, op7_maxscore, op8_pieces, op9_url_filter, op10_language_id)
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}

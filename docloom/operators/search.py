"""Ranked retrieval over many queries at once: BM25, exact cosine search, fusion, reranking."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.sources.shared import held, shared_folder

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
SHARD, BLOCK = 4096, 256
#: Rows up to which a side of a join may be broadcast.
FEW = 1 << 18


def best(rows: DataFrame, k: int, score: str = "score", query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank, ties to the smaller item."""
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_counts(tokens: Column) -> Column:
    """array<struct<term string, tf int>>: the distinct tokens in order, and how often each occurs.

    Sorted tokens stand in runs, and a term's count is where the next run begins less where its own does.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return T.let(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(n + 1)), lambda at, after: F.struct(F.element_at(s, at).alias("term"), (after - at).alias("tf"))))

    return F.when(F.size(tokens) > 0, T.let(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def postings(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, dl) from (doc_id, text), counted in each row without a shuffle; of the terms in ``asked`` only."""
    toks = docs.select("doc_id", T.tokens(F.col("text")).alias("t"))
    each = toks.select("doc_id", F.size("t").alias("dl"), F.explode(term_counts(F.col("t"))).alias("p")).select("doc_id", "p.term", F.col("p.tf").cast("long").alias("tf"), "dl")
    return each if asked is None else each.join(asked, "term", "left_semi")


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf) of postings."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(term, df, words): df of each term; the row without a term has the number of documents and of all their words.

    One pass over the texts; counts are made on the map side first, so a term that is in every document costs no more.
    """
    toks = docs.select(T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    each = toks.select(F.size("t").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl")).otherwise(0)).alias("words"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of (query_id, text)."""
    return queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def small(rows: DataFrame, most: int = FEW) -> DataFrame:
    """``rows`` marked for broadcast if they are counted to be few, else as they are, for the optimizer to join."""
    return F.broadcast(rows) if rows.count() <= most else rows


def scored(post: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score and rank from postings, corpus statistics and (query_id, text).

    Terms of negative idf get EPSILON times the mean idf.  Only one row of totals goes to the driver.
    """
    totals = F.max(F.when(F.col("term").isNull(), F.struct("df", "words"))).alias("of")
    n, words = (lambda r: (r["of"]["df"], r["of"]["words"]) if r["of"] else (0, 0))(stats.agg(totals).first())
    raw = stats.where("term is not null").select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    asked = query_terms(queries)
    weights = raw.join(asked, "term").select("term", "query_id", (F.col("qtf") * F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))).alias("w"))
    # queries are grouped by term, so that a posting meets its term once
    weights = small(weights.groupBy("term").agg(F.collect_list(F.struct("query_id", "w")).alias("asked")))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(words / max(n, 1))))
    met = post.join(weights, "term").select("doc_id", tf.alias("tf"), F.explode("asked").alias("q"))
    scores = met.groupBy(F.col("q.query_id").alias("query_id"), "doc_id").agg(F.round(F.sum(F.col("tf") * F.col("q.w")), 6).alias("score"))
    return best(scores.where("score > 0"), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, keep: Column | None = None) -> DataFrame:
    """query_id, doc_id, score and rank; statistics are of all docs, ``keep`` filters candidates before ranking.

    Texts are read twice, for the statistics and for the postings of asked terms.
    """
    stats = held(corpus_stats(docs))
    terms = small(query_terms(queries).select("term").distinct())
    return scored(postings(docs if keep is None else docs.where(keep), terms), stats, queries, k)


class Index:
    """Postings and statistics of a corpus in a folder that all executors share.

    Parts are added under a name: adding one again replaces it, so a retried load changes nothing.  Files hold whole
    documents, evenly dealt, so that scores are summed where postings are read; they are sorted by term, so that a search
    reads the row groups of asked terms.  Deleted ids are a part of their own.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, part string").parquet(f"{self.folder}/{name}").drop("part")

    def add(self, docs: DataFrame, part: str = "0") -> None:
        """Index ``docs`` (doc_id, text) as a part."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        postings(docs).repartition(n, "doc_id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.folder}/postings/part={part}")
        corpus_stats(docs).write.mode("overwrite").parquet(f"{self.folder}/stats/part={part}")

    def delete(self, docs: DataFrame, part: str = "0") -> None:
        """Take documents (doc_id, text) out of results and statistics."""
        docs.select("doc_id").write.mode("overwrite").parquet(f"{self.folder}/gone/part={part}")
        corpus_stats(docs).select("term", (-F.col("df")).alias("df"), (-F.col("words")).alias("words")).write.mode("overwrite").parquet(f"{self.folder}/stats/part=gone-{part}")

    def stats(self) -> DataFrame:
        rows = self._table("stats", "term string, df long, words long")
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).where("df > 0")

    def postings(self) -> DataFrame:
        rows, gone = self._table("postings", "doc_id long, term string, tf long, dl int"), self._table("gone", "doc_id long")
        return rows if gone.isEmpty() else rows.join(gone, "doc_id", "left_anti")

    def search(self, queries: DataFrame, k: int = 10, keep: DataFrame | None = None) -> DataFrame:
        """As ``bm25`` over all that is indexed; of the documents in ``keep`` (doc_id), if given, and with the statistics of all."""
        post = self.postings().join(small(query_terms(queries).select("term").distinct()), "term", "left_semi")
        return scored(post if keep is None else post.join(keep.select("doc_id"), "doc_id", "left_semi"), self.stats(), queries, k)


_INDEXES: dict = {}


def index_of(docs: DataFrame) -> Index:
    """The index of a table of files (doc_id, text), written at its first use in a session.

    Files' names, lengths and times of change tell tables apart, so a table that has changed is indexed anew.
    """
    spark, files = docs.sparkSession, []
    for f in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, hashlib.sha256(repr(files).encode()).hexdigest())
    if key not in _INDEXES:
        index = Index(spark, shared_folder(spark, "index"))
        index.add(docs)
        _INDEXES[key] = index
    return _INDEXES[key]


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _directions(vectors):
    """A list of vectors as rows of length 1, and their widths; null, unbounded and zero vectors are rows of NaN."""
    widths = np.array([len(v or ()) for v in vectors])
    out = np.zeros((len(vectors), widths.max(initial=0)))
    for i, v in enumerate(vectors):
        out[i, : widths[i]] = [math.nan if x is None else x for x in v or ()]
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where((norms > 0) & np.isfinite(norms), norms, math.nan), widths


def _block_against_shard(k: int):
    def run(batches):
        for batch in batches:
            for queries, rows in zip(*(c.to_pylist() for c in batch.columns)):
                (q, qw), (d, dw) = (_directions([r["v"] for r in x]) for x in (queries, rows))
                width, ids, found = min(q.shape[1], d.shape[1]), np.array([r["id"] for r in rows], np.int64), []
                scores = q[:, :width] @ d[:, :width].T
                scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores)
                scores = np.where(np.isnan(scores) | (qw[:, None] != dw), -np.inf, scores)  # without a score: last
                for row, score in zip(queries, scores):
                    other = np.flatnonzero(ids != row["id"])
                    kept = other[np.lexsort((ids[other], -score[other]))[:k]]
                    found += [(row["id"], int(i), float(x) if np.isfinite(x) else None) for i, x in zip(ids[kept], score[kept])]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "doc_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine search of (query_id, q) in (vec_id, embedding): blocks of queries meet every shard by an equality join.

    Each pair of a block and a shard gives k rows a query, so neither all pairs of rows nor all queries are in one place;
    norms are computed once for each row of a pair.
    """

    def packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        rows = rows.toDF("id", "v").where("id is not null")
        parts = max(1, math.ceil(rows.count() / size))
        key = F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias("key")
        return rows.select(key, F.struct(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).alias("r")).groupBy("key").agg(F.collect_list("r").alias("rows")), parts

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))

    blocks, n_blocks = packed(queries.select("query_id", "q"), BLOCK)
    shards, n_shards = packed(vectors.select("vec_id", "embedding"), SHARD)
    left = blocks.select(F.col("key").alias("block"), every(n_shards).alias("shard"), F.col("rows").alias("asked"))
    right = shards.select(every(n_blocks).alias("block"), F.col("key").alias("shard"), "rows")
    met = left.join(right, ["block", "shard"]).select("asked", "rows")
    return best(met.mapInArrow(_block_against_shard(k), "query_id long, doc_id long, score double"), k)


def _both(vector: DataFrame, bm: DataFrame) -> DataFrame:
    v = vector.select("query_id", "doc_id", F.col("score").alias("vector_score"), F.col("rank").alias("rv"))
    b = bm.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("rb"))
    source = F.when(F.col("rv").isNull(), "bm25").when(F.col("rb").isNull(), "vector").otherwise("both")
    return v.join(b, ["query_id", "doc_id"], "full_outer").withColumn("source", source)


def rrf(vector: DataFrame, bm: DataFrame, wv: float = 0.6, wb: float = 0.4, k: int = RRF_K, parts: tuple = ()) -> DataFrame:
    """Weighted reciprocal ranks of two lists; ``parts`` may name vector_score and bm25_score, which are then kept."""
    score = F.coalesce(wv / (k + F.col("rv")), F.lit(0.0)) + F.coalesce(wb / (k + F.col("rb")), F.lit(0.0))
    return _both(vector, bm).select("query_id", "doc_id", "source", F.round(score, 8).alias("score"), *parts)


def weighted(vector: DataFrame, bm: DataFrame, wv: float = 0.6, wb: float = 0.4) -> DataFrame:
    """Weighted sum of min-max normalised scores; a list without spread normalises to 0."""

    def scale(c: str) -> Column:
        w = Window.partitionBy("query_id")
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.coalesce((F.col(c) - low) / F.when(high > low, high - low).otherwise(1.0), F.lit(0.0))

    both = _both(vector, bm)
    return both.select("query_id", "doc_id", "source", F.round(wv * scale("vector_score") + wb * scale("bm25_score"), 6).alias("score"))


def multi_rrf(variants: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over (query_id, variant, doc_id, score, rank); hits and the best component score."""
    return variants.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"), F.count(F.lit(1)).alias("hits"), F.max("score").alias("best_score"))


def first_variant(variants: DataFrame) -> DataFrame:
    """Each item of a query once: at its first variant, then rank."""
    order = Window.partitionBy("query_id", "doc_id").orderBy("variant", "rank")
    return variants.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def keyword_rerank(rows: DataFrame, k: int | None = None) -> DataFrame:
    """0.7 * score + 0.3 * share of the query's words that the text has as substrings; rows have query and text."""
    text = F.lower("text")
    share = T.let(T.words(F.col("query")), lambda own: T.let(text, lambda t: F.size(F.filter(own, lambda w: F.contains(t, w)))) / F.greatest(F.size(own), F.lit(1)))
    out = rows.withColumn("rerank_score", F.round(0.7 * F.col("score") + 0.3 * share, 4)).drop("rank")
    return best(out, k, "rerank_score") if k else out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "doc_id")))


def ladder(*steps: DataFrame, least: int = 3) -> DataFrame:
    """Results of the first step but the last that has at least ``least`` rows for a query, else of the step with most (first on ties)."""
    tagged = None
    for i, s in enumerate(steps):
        s = s.select("query_id", "doc_id", "score", "rank", F.lit(i).alias("step"))
        tagged = s if tagged is None else tagged.union(s)
    sized = tagged.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "step")))
    enough = (F.col("n") >= least) & (F.col("step") < len(steps) - 1)
    pick = F.min(F.struct(F.when(enough, 0).otherwise(1).alias("short"), F.when(enough, 0).otherwise(-F.col("n")).alias("less"), "step")).over(Window.partitionBy("query_id"))
    return sized.withColumn("p", pick).where("step = p.step").drop("n", "p")


def expand_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (doc_id) with the text of the parent chunk, or their own where there is none."""
    child = chunks.select(F.col("chunk_id").alias("doc_id"), "parent_id", F.col("content").alias("own"))
    parent = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("above"))
    return hits.join(child, "doc_id").join(parent, "parent_id", "left").select(*hits.columns, F.coalesce("above", "own").alias("context"))

"""Exact top-k search by MaxScore, in blocks of queries against shards of candidates.

A vector is a document whose terms are its dimensions; its postings are the columns of its shard's matrix, and each
dimension has the largest contribution that it can make to a query's score in the shard (weights may be negative, so
the bound is the larger of query weight times the column's largest and smallest entry).  For a query, dimensions are
sorted by bound.  Those whose bounds together cannot lift a candidate over the k-th best score so far are
non-essential: the others' postings are traversed for all candidates of the chunk, then non-essential ones are probed
by falling bound for the candidates that are still competitive.  Shards' best are merged at the end.

Shards and blocks have a bounded number of rows, whatever the table's size, each in one row of the narrowest whole
numbers that hold it, and meet by an equality join of their keys, so neither side is broadcast and no task holds more
than one shard and one block.  First each block meets one shard; the k-th best score that a query has there is a bound
that all other shards begin with.  Every query meets every candidate's shard, so that shards are read once for each block
of queries; what is skipped is skipped by bounds, so results are exact, ties to the smaller id.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as
padded with zeros; all rows with the same id are candidates of other ids, and as queries share the k best; null ids take
no part.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import cut

SHARD, BLOCK, CHUNK, PROBE = 8192, 1024, 1024, 8


def scaled(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as bigint; null where a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("bigint")))


def search(queries, query_ids, docs, doc_ids, k: int, floors: dict | None = None):
    """(query, doc, score) of one block against one shard; matrices of whole numbers as float64.

    ``floors`` has scores by query below which nothing is asked for.

    Scores are exact while the sum of absolute contributions is below 2**53; beyond, whole Python numbers are used.
    """
    floors = floors or {}
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(docs).max(initial=0)) * max(1, docs.shape[1])
    if bound >= 2**53:
        queries, docs = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (queries, docs))
    order = np.argsort(doc_ids, kind="stable")
    docs, doc_ids = docs[order], doc_ids[order]
    high, low = docs.max(axis=0), docs.min(axis=0)
    out = []
    for q, own in zip(queries, query_ids):
        bounds = np.maximum(q * high, q * low)
        terms = np.argsort(-bounds, kind="stable")
        after = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # most that the terms from here on can add
        best_scores, best_ids, floor = np.empty(0, docs.dtype), np.empty(0, np.int64), floors.get(int(own))
        for start in range(0, len(docs), CHUNK):
            part, ids = docs[start : start + CHUNK], doc_ids[start : start + CHUNK]
            rows = np.flatnonzero(ids != own)
            least = max((x for x in (floor, best_scores[-1] if len(best_scores) == k else None) if x is not None), default=None)
            if least is None:
                score = part[rows] @ q
            else:
                essential = max(1, int(np.argmax(after < least)) if (after < least).any() else len(terms))
                use = terms[:essential]
                score, done = part[rows][:, use] @ q[use], essential
                while done < len(terms) and len(rows):
                    competitive = score + after[done] >= least
                    rows, score = rows[competitive], score[competitive]
                    use = terms[done : done + PROBE]
                    score = score + part[rows][:, use] @ q[use]
                    done += len(use)
            scores, found = np.append(best_scores, score), np.append(best_ids, ids[rows])
            keep = np.lexsort((found, -scores))[:k]
            best_scores, best_ids = scores[keep], found[keep]
        out += [(int(own), int(d), int(s)) for d, s in zip(best_ids, best_scores)]
    return out


def _pack(batches):
    """Rows of (key, id, vector), all rows of a key together: one row for each key, its vectors padded to one width."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
        ids, vectors = zip(*((r[1], r[2]) for r in group))
        matrix = np.zeros((len(ids), max(map(len, vectors))), np.int64)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        matrix = matrix.astype(np.result_type(np.min_scalar_type(matrix.min(initial=0)), np.min_scalar_type(-matrix.max(initial=0) - 1)))
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([matrix.dtype.str]), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], ["key", "ids", "kind", "width", "data"])


def _searched(k: int):
    def matrix(part: dict, width: int):
        own = np.frombuffer(part["data"], part["kind"]).reshape(len(part["ids"]), part["width"])
        out = np.zeros((len(own), width))
        out[:, : part["width"]] = own
        return out

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, asked, shard, floors = (batch.column(c)[i].as_py() for c in range(4))
                width = max(asked["width"], shard["width"])
                at_least = {f["query_id"]: f["floor"] for f in floors or ()}
                found = search(matrix(asked, width), np.array(asked["ids"], np.int64), matrix(shard, width), np.array(shard["ids"], np.int64), k, at_least)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), *[pa.array([r[c] for r in found], pa.int64()) for c in range(3)]], ["block", "query_id", "vec_id", "score"])

    return run


def topk(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of ``docs`` for each of ``queries``, both (vec_id, v array<bigint>)."""

    def packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        rows = cut(rows.where("vec_id is not null and v is not null").select("vec_id", "v"))
        parts = max(1, math.ceil(rows.count() / size))
        # dealt by place too, else rows that are repeated many times would fill one shard
        keyed = rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).alias("key"), "vec_id", "v")
        packs = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_pack, "key long, ids array<long>, kind string, width int, data binary")
        return cut(packs.select(F.col("key").alias(name), F.struct("ids", "kind", "width", "data").alias(f"{name}_rows"))), parts

    def met(pairs: DataFrame) -> DataFrame:
        return cut(pairs.select("block", "block_rows", "shard_rows", "floors").mapInArrow(_searched(k), "block long, query_id long, vec_id long, score long"))

    shards, n_shards = packed(docs, SHARD, "shard")
    blocks, n_blocks = packed(queries, BLOCK, "block")
    first_shard = F.col("block") % n_shards
    none = F.lit(None).cast("array<struct<query_id:bigint,floor:bigint>>").alias("floors")
    best = met(blocks.withColumn("shard", first_shard).join(shards, "shard").select("*", none))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if n_shards > 1:
        kth = best.withColumn("n", F.row_number().over(Window.partitionBy("block", "query_id").orderBy(F.desc("score")))).where(F.col("n") == k)
        floors = kth.groupBy("block").agg(F.collect_list(F.struct("query_id", F.col("score").alias("floor"))).alias("floors"))
        asked = blocks.join(floors, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))).where(F.col("shard") != first_shard)
        read = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        best = best.union(met(asked.join(read, ["block", "shard"])))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

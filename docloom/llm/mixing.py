"""Mixing sources to target weights by systematic sampling of whole documents.

Targets: sources in code point order, null last, weigh 5, 2, 1 in turn and share ``budget`` times all words by weight;
no target goes beyond ``most`` times its source, and what is over is shared again by weight.  The end of this is the one
level at which targets min(most * source, level * weight) sum to the budget.  With the sources in the order of their
level when full, prefix sums give the level that is left once all sources before are full; it rises while the next
source is filled and falls after, so the largest is the level, found in one pass however many sources there are.

Sampling: every document of a source is expected rate = target / source_size times.  With documents in the order
(size, MD5, doc_id), the prefix sum after the i-th is rate * i, and one random offset of the source is added to it;
a document is taken once for each integer between the sums before and after it.  Order by size makes the words taken
differ from the target by little more than the longest document's words.  Numbers within a source come from
``ranked``, so no source is brought into one task.

Defined cases: a null text has size 0; documents without words are taken no words; a source without words has target 0;
repeated rows count each; null doc_ids are ordered first; the table may be empty.  Offsets depend on the seed and the
source alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD, cut, ranked

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST, SEED = 1.5, 2.0, 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    placed = ranked(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"]).drop("last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    full = F.lit(float(most)) * F.col("source_size")
    placed = cut(placed.withColumn("weight", weight).withColumn("full", full).withColumn("by", F.col("full") / F.col("weight")).drop("rank"))
    words, weights_sum = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    upto = ranked(placed.withColumn("last", F.col("source").isNull()), [], ["by", "last", "source"], sums={"full_upto": "full", "weight_upto": "weight"})
    rest = (words or 0) * budget - (F.col("full_upto") - F.col("full"))
    level = upto.agg(F.max(rest / (F.lit(weights_sum or 0.0) - (F.col("weight_upto") - F.col("weight"))))).first()[0] or 0.0
    return placed.select("source", "source_size", F.least("full", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of ``docs`` (doc_id, source, text)."""
    words = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    table = cut(words)
    aims = targets(table.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    placed = ranked(table.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), ["source"], ["size", "_hash", "doc_id"]).drop("_hash")
    aims = aims.withColumn("of", F.col("source")).drop("source")
    rows = placed.join(aims, placed["source"].eqNullSafe(aims["of"])).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    tagged = F.concat(F.lit(f"{seed + 1}"), F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")))
    offset = F.conv(F.substring(F.md5(tagged), 1, 13), 16, 10).cast("long") / float(1 << 52)
    copies = F.floor(rate * F.col("rank") + offset) - F.floor(rate * (F.col("rank") - 1) + offset)
    copies = F.least(copies, F.ceil(rate)).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, with the columns of ``docs``.

    Rows of one doc_id, source and size share what the mix takes of them as evenly as whole copies can.
    """
    plan = mix(docs, weights, budget, most, seed).groupBy(F.col("doc_id").alias("id"), F.col("size").alias("words"), F.col("source").alias("of"))
    plan = cut(plan.agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n")).where("total > 0"))
    rows = docs.select(F.struct("*").alias("row"))  # no other column of the table can clash with the plan's
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & size.eqNullSafe(F.col("words")) & F.col("row.source").eqNullSafe(F.col("of"))
    out = rows.join(plan.where("n = 1"), same).select("row", F.col("total").alias("times"))
    several = plan.where("n > 1")
    if not several.isEmpty():
        placed = ranked(rows.join(several, same).withColumn("hash", F.xxhash64("row.text")), ["id", "words", "of"], ["hash"])
        out = out.union(placed.select("row", F.expr("total div n + int(rank <= total % n)").alias("times")).where("times > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")

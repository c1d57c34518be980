"""Running sums over an order of all rows, and places in groups, by ranges, so that no task holds more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from docloom.sources.shared import held


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with columns of ``sums``: each the sum of a numeric column up to and including the row, by ``order``.

    Rows are dealt by range of the order; of each range only its sums go to the driver, which chose their number, and
    come back as what stands before it.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before, so_far = [], None
    for r in sorted(totals.collect(), key=lambda r: r["_range"]):
        so_far = so_far or [0] * len(sums)
        before.append((r["_range"], *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, r[1:])]
    schema = StructType([StructField("_range", IntegerType())] + [StructField(f"_b{i}", totals.schema[f"_t{i}"].dataType) for i in range(len(sums))])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    out = out.join(F.broadcast(spark.createDataFrame(before, schema)), "_range", "left")  # a row for each range
    return out.withColumns({name: F.col(name) + F.col(f"_b{i}") for i, name in enumerate(sums)}).drop("_range", *[f"_b{i}" for i in range(len(sums))])


def numbered(rows: DataFrame, by: str, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with a column ``name``: how many rows of the same ``by``, null too, stand before the row by ``order``.

    Rows are dealt by range of group and order, so a large group spreads over tasks; only rows equal in all of them stay
    together.  What each range holds of each group is counted in a table of its own; that is joined by broadcast where it is
    small, else by exchange.
    """
    place = F.monotonically_increasing_id()  # the range above 33 bits, below them the place in it
    dealt = held(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_id", place))
    dealt = dealt.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    parts = dealt.groupBy(F.col("_range").alias("_r"), F.col(by).alias("_g")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    moved = held(parts.select("_r", "_g", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_by")))
    out = dealt.join(moved, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_g")))  # a row for each range and group
    return out.withColumn(name, F.col("_at") + F.col("_by")).drop("_id", "_range", "_at", "_r", "_g", "_by")

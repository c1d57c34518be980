"""What the operators of this subpackage share: shared folders, lineage cuts, ranks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

#: Words are runs of characters other than space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


_APPLICATIONS: set = set()
BATCH_ROWS, _ROWS = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session of one process (tests in local mode) leaves it unset, a folder of this machine is taken; on a
    cluster an unset folder raises ValueError, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root is None and held.isDefined():
        root = held.get().rsplit("/", 1)[0]
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the application's folder in the shared one, which goes when the application ends."""
    base = f"{shared_root(spark)}/docloom-{spark.sparkContext.applicationId}"
    if base not in _APPLICATIONS:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _APPLICATIONS.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from there.

    A lost executor then costs no recomputation, and plans of loops start afresh (checkpoint() would carry the
    constraints of all plans before it along).
    """
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _give_back() -> None:
    """Return a Python worker's free memory to the system, as the process waits for other tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def in_batches(rows: DataFrame, run, schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with batches of BATCH_ROWS rows, where the session has not chosen another number.

    Texts are long, and Spark's 10,000 rows of them would be held several times, by the JVM and by the worker.
    """
    conf = rows.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(BATCH_ROWS))

    def task(batches):
        yield from run(batches)
        _give_back()

    return rows.mapInArrow(task, schema)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or if ``df`` has a column of that name, it with underscores in front."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _continued(cells: DataFrame, group: list[str], values: list[str]) -> DataFrame | None:
    """(_at, _g0, ..., _b0, ...): for each range that goes on with the group of the range before, the group and its sums so far.

    ``cells`` has the sums of each (range, group).  Only a range's first and last group can lie in other ranges, so a
    row for each range goes to the driver, which chose their number.  None if no group goes on.
    """
    key, sums = F.struct(*group) if group else F.struct(F.lit(0).alias("all")), F.struct(*values)
    ends = cells.groupBy("_range").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.min_by(sums, key).alias("low"), F.max_by(sums, key).alias("high"))
    out, last, total = [], None, []
    for r in sorted(ends.collect(), key=lambda r: r["_range"]):
        goes_on = last == r["first"]
        if goes_on:
            out.append((r["_range"], *(r["first"] if group else ()), *total))
        if r["first"] == r["last"]:
            total = [(t if goes_on else 0) + v for t, v in zip(total or [0] * len(values), r["low"])]
        else:
            total = list(r["high"])
        last = r["last"]
    schema = StructType([StructField("_at", IntegerType())] + [StructField(f"_g{i}", cells.schema[g].dataType) for i, g in enumerate(group)] + [StructField(f"_b{i}", cells.schema[v].dataType) for i, v in enumerate(values)])
    return cells.sparkSession.createDataFrame(out, schema) if out else None


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank", sums: dict | None = None) -> DataFrame:
    """Number the rows of each group from 1 by ``order`` without bringing a group into one task.

    Rows are dealt by range of (group, order); numbers inside a range come from a window, and a range that goes on with
    the group of the range before adds what that group has so far.  ``sums`` maps names of further columns to numeric
    columns, whose sums up to and including each row they hold.  ``order`` should be total if numbers must not change
    between runs.
    """
    sums = sums or {}
    dealt = cut(df.repartitionByRange(partitions(df.sparkSession), *group, *order).withColumn("_range", F.spark_partition_id()))
    values, totals = [f"_t{i}" for i in range(len(sums) + 1)], [F.count(F.lit(1)), *[F.sum(c) for c in sums.values()]]
    before = _continued(dealt.groupBy("_range", *group).agg(*[t.alias(v) for t, v in zip(totals, values)]), group, values)
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = [name, *sums]
    rows = dealt.select("*", *[t.over(inside).alias(n) for t, n in zip(totals, names)])
    if before is not None:
        same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_range") == F.col("_at"))
        rows = rows.join(F.broadcast(before), same, "left")  # a row for each range at most
        rows = rows.withColumns({n: F.col(n) + F.coalesce(F.col(f"_b{i}"), F.lit(0)) for i, n in enumerate(names)})
        rows = rows.drop("_at", *[f"_g{i}" for i in range(len(group))], *[f"_b{i}" for i in range(len(names))])
    return rows.drop("_range")

"""Metadata tables: upserts, deletes and listings as new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal key, and added where there is none."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def stamped(table: DataFrame, rows: DataFrame, key: str, now: Column) -> DataFrame:
    """``upsert`` into a table with created_at and updated_at: a row of known key keeps when it was created."""
    known = table.select(key, F.col("created_at").alias("_since"))
    fresh = rows.join(known, key, "left").withColumn("created_at", F.coalesce("_since", now)).withColumn("updated_at", now).drop("_since")
    return upsert(table, fresh.select(*table.columns), key)


def found(table: DataFrame, key: str, value) -> DataFrame:
    """The row of one key, or none."""
    return table.where(F.col(key) == value).limit(1)


def chunk_info(chunks: DataFrame) -> DataFrame:
    """doc_id, parents, children, orphans and tokens of (chunk_id, doc_id, parent_id, tokens): orphans name a parent that is not there."""
    above = chunks.select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("known"))
    rows = chunks.join(above, "parent_id", "left")
    child = F.col("parent_id").isNotNull()
    return rows.groupBy("doc_id").agg(F.count_if(~child).alias("parents"), F.count_if(child).alias("children"), F.count_if(child & F.col("known").isNull()).alias("orphans"), F.sum("tokens").alias("tokens"))


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def soft_delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return table.join(gone, key, "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def condition(where: dict) -> Column:
    """All of a filter's conditions: a list means any of its values, a dictionary of $gt, $gte, $lt, $lte, $ne and $eq a range."""
    tests = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__, "$ne": Column.__ne__, "$eq": Column.__eq__}
    out = F.lit(True)
    for name, wanted in where.items():
        c = F.col(name)
        for own in [tests[op](c, v) for op, v in wanted.items()] if isinstance(wanted, dict) else [c.isin(wanted) if isinstance(wanted, list) else c == wanted]:
            out = out & own
    return out


def listed(table: DataFrame, where: dict, newest: Column, key: str, limit: int) -> DataFrame:
    """Rows that fulfil all conditions (a list means any of its values), newest first, up to the limit."""
    return table.where(condition(where)).orderBy(newest.desc(), key).limit(limit)


def find_term(terms: DataFrame, wanted: str) -> DataFrame:
    """The first entry named so or with the text among its aliases."""
    hit = (F.col("term") == wanted) | F.contains(F.array_join("aliases", ","), F.lit(wanted))
    return terms.where(hit).orderBy("seq").limit(1)


def vector_condition(filters: dict) -> Column:
    """The filter of a vector store's language: equal strings, and lists; values of other types are passed over."""
    out = F.lit(True)
    for name, value in filters.items():
        if isinstance(value, str):
            out = out & (F.col(name) == value)
        elif isinstance(value, list):
            out = out & F.col(name).cast("string").isin([str(v) for v in value])
    return out


def term_condition(filters: dict) -> Column:
    """The filter of a text store's language: one term, or any of several terms."""
    out = F.lit(True)
    for name, value in filters.items():
        out = out & (F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return out


# What is kept of a file's metadata.
FILE_KEYS = ("title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate")
FILE_NAMES = {"creationDate": "creation_date", "modDate": "mod_date"}


def file_metadata(found: Column, pages: Column, own: Column) -> Column:
    """map<string,string> of a file's known keys, empty where it lacks them, and its pages; the caller's keys win."""
    known = [x for k in FILE_KEYS for x in (F.lit(FILE_NAMES.get(k, k)), F.when(F.map_contains_key(found, k), found[k]).otherwise(""))]
    base = F.create_map(*known, F.lit("total_pages"), pages.cast("string"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)

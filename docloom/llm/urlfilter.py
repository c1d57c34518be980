"""Temporal URL filters: dated list entries become validity intervals, captures meet those active when they were fetched.

Entries are events (list, pattern, action, day): ``add`` makes a pattern active from its day on, ``remove`` ends that on
its day; of several events of one day the removal counts last.  A pattern is a domain, which covers its subdomains, or
a whole URL.  Events of a pattern in order give intervals [from, until).  A capture looks up its URL, its whole host and
each suffix of the host of two labels or more (an IP address has none); keys and intervals meet by an equality join that splits large partitions, and days are
compared within.  The longest active pattern decides; on ties ``allow`` beats ``block``.

Defined cases: a capture without URL, host or day matches nothing and is not blocked; repeated rows keep their count, and
are looked up once; entries without pattern or day are ignored; hosts are compared in lower case, without port and login.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]+)"

#: Hosts that are addresses: four numbers, or anything in brackets.
ADDRESS = r"^([0-9.]+|\[.*)$"


def host(url: Column) -> Column:
    """The lower-case host of a URL, null if it has none."""
    found = F.regexp_extract(url, HOST, 1)
    return F.when(found != "", F.lower(found))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, from_day, until_day) from events; until_day is null while an entry is active."""
    events = entries.where("pattern is not null and day is not null").select("list", "pattern", "action", "day").distinct()
    days = events.groupBy("list", "pattern", "day").agg(F.max(F.struct((F.col("action") == "remove").alias("ends"), "action")).alias("last")).select("list", "pattern", "day", F.col("last.ends").alias("ends"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    turns = days.withColumn("was", F.lag("ends").over(order)).where(F.col("was").isNull() | (F.col("was") != F.col("ends")))
    spans = turns.withColumn("until_day", F.lead("day").over(order))
    return spans.where("not ends").select("list", "pattern", F.col("day").alias("from_day"), "until_day")


def keys(url: Column) -> Column:
    """What a capture is looked up by: its URL, its host and the suffixes of its host of two labels or more."""
    labels = F.split(host(url), r"\.")
    last = F.when(host(url).rlike(ADDRESS), F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    suffixes = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(F.array(url), F.coalesce(suffixes, F.array().cast("array<string>"))))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, day, n_active, pattern, list and blocked of each capture (page_id, url, day)."""
    rows = captures.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("rows"))
    asked = rows.withColumn("key", F.explode_outer(keys(F.col("url"))))
    active = intervals(entries)
    met = (F.col("key") == F.col("pattern")) & (F.col("day") >= F.col("from_day")) & (F.col("until_day").isNull() | (F.col("day") < F.col("until_day")))
    found = asked.join(active, met, "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("size"), (F.col("list") == "allow").alias("allows"), "pattern", "list")))
    out = found.groupBy("page_id", "url", "day", "rows").agg(F.count("pattern").alias("n_active"), best.alias("best"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select("page_id", "url", "day", "n_active", F.col("best.pattern").alias("pattern"), F.col("best.list").alias("list"), F.coalesce(F.col("best.list") == "block", F.lit(False)).alias("blocked"))

"""Sources: lines and HTML as elements, dated JSON logs, and slots for parsers that need libraries not present here."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def line_elements(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text): the non-empty lines of each text, in order."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")


def html_elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text): headings, paragraphs and list items of each page, in order, tags inside removed."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:h1|h2|h3|p|li)(?:\s[^>]*)?>.*?</(?:h1|h2|h3|p|li)>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "raw"))
    inner = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "pos", F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1)).alias("tag"), inner.alias("text"))


def html_table_rows(html: Column) -> Column:
    """array<array<string>>: cells of the rows of an HTML table, empty rows left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)(<tr[^>]*>.*?</tr>)"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))))
    return F.filter(cells, lambda r: F.size(r) > 0)


def write_log(log: DataFrame, path: str) -> None:
    """Append a log as JSON in one folder for each day."""
    log.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").json(path)


def read_log(spark: SparkSession, path: str, schema: str, first: date, last: date) -> DataFrame:
    """Log rows of the days from first to last; other days' folders are not read."""
    return spark.read.schema(f"{schema}, dt date").json(path).where(F.col("dt").between(first, last)).drop("dt")


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder; parsing their formats is a caller's function."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def write_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as JSON lines, in one folder for each value of ``by`` if given; a load that is run again replaces what it wrote."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)

"""Page layout: blocks in bands of a page, images and their captions, scan confidence, titles, tables at page ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values
BAND = 0.05
MIN_SIDE, IMAGES_PER_PAGE = 50, 20
MIN_CONFIDENCE = 0.6
CAPTION, CAPTION_GAP = r"(?i)^(图|Figure|Fig\.?|表|Table)\s*[\d\-\.]+", 30


def in_body(y0: Column, y1: Column, height: Column, band: float = BAND) -> Column:
    """Is a block outside the header and footer bands of its page?"""
    return (y0 >= height * band) & (y1 <= height * (1 - band))


def kept_images(images: DataFrame, side: int = MIN_SIDE, most: int = IMAGES_PER_PAGE) -> DataFrame:
    """The first ``most`` images (doc_id, page, pos, width, height) of each page that are large enough."""
    order = Window.partitionBy("doc_id", "page").orderBy("pos")
    large = images.where((F.col("width") >= side) & (F.col("height") >= side))
    return large.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def confidence(lines: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, pages and confidence: the mean over pages of the mean of the lines (doc_id, page, confidence) that are sure enough."""
    pages = lines.where(F.col("confidence") >= least).groupBy("doc_id", "page").agg(F.avg("confidence").alias("c"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("c"), 6).alias("confidence"))


def captions(images: DataFrame, blocks: DataFrame, gap: float = CAPTION_GAP) -> DataFrame:
    """doc_id, page, image and caption: of each image (bottom y1) the first block of its page that stands close and reads like a caption."""
    text = F.trim("text")
    told = blocks.where(text.rlike(CAPTION)).select("doc_id", "page", "pos", "y0", text.alias("caption"))
    near = images.select("doc_id", "page", "image", "y1").join(told, ["doc_id", "page"]).where(F.abs(F.col("y0") - F.col("y1")) < gap)
    return near.groupBy("doc_id", "page", "image").agg(F.min_by("caption", "pos").alias("caption"))


def titles(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and title: the given title, else the first largest span of page 1, else the file name's stem."""
    first = spans.where("page = 1").groupBy("doc_id").agg(F.max(F.struct("font_size", (-F.col("pos")).alias("p"), F.trim("text").alias("text")))["text"].alias("large"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return documents.join(first, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif("large", F.lit("")), stem).alias("title"))


def merged(elements: DataFrame, tables: DataFrame) -> DataFrame:
    """Elements and tables (doc_id, page, pos, content) in order, the tables of a page after its elements."""
    both = elements.select("doc_id", "page", F.lit(0).alias("late"), "pos", "content").union(tables.select("doc_id", "page", F.lit(1).alias("late"), "pos", "content"))
    order = Window.partitionBy("doc_id").orderBy("page", "late", "pos")
    return both.select("doc_id", "page", F.row_number().over(order).alias("place"), "content")

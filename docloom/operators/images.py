"""Images: elements and chunks for an index, and vectors of two kinds, told apart by their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import generation, search

# Types of an image's two vectors.
DESCRIPTION, PICTURE = "image_description", "image_clip"
PREVIEW = 100


def encoded(content: Column, chars: int = PREVIEW) -> Column:
    """The first characters of the base64 text of binary content, then three points; only the bytes they need are encoded."""
    return F.concat(F.substring(F.translate(F.base64(F.substring(content, 1, (chars + 3) // 4 * 3)), "\r\n", ""), 1, chars), F.lit("..."))


def unit(vector: Column) -> Column:
    """The vector as array<double> of length 1; null where it has no length or holds null."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return T.let(length, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def elements(images: DataFrame) -> DataFrame:
    """``images`` (page, caption, content binary) with text, image_data and has_caption; images without content are none."""
    named = F.coalesce(F.col("caption"), F.lit("")) != ""
    text = F.when(named, F.col("caption")).otherwise(F.concat(F.lit("[Image on page "), F.col("page").cast("string"), F.lit("]")))
    rows = images.where("content is not null")
    return rows.withColumn("text", text).withColumn("image_data", encoded(F.col("content"))).withColumn("has_caption", named)


def chunks(images: DataFrame) -> DataFrame:
    """chunk_id, content, content_type and metadata of ``images`` (image_id, description, further columns); those without description go."""
    further = [c for c in images.columns if c != "description"]
    kind = generation.first_kind(F.col("description"), generation.IMAGES, "unknown")
    rows = images.where("coalesce(description, '') <> ''")
    held = F.struct(*further, kind.alias("image_type"))
    return rows.select(F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("chunk_id"), F.col("description").alias("content"), F.lit("image").alias("content_type"), held.alias("metadata"))


def nearest(vectors: DataFrame, queries: DataFrame, kind: str, k: int = 5) -> DataFrame:
    """The k nearest of the vectors (vec_id, embedding, type) of one type: DESCRIPTION for text, PICTURE for an image."""
    return search.nearest(vectors.where(F.col("type") == kind), queries, k).withColumn("type", F.lit(kind))

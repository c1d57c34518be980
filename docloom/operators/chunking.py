"""Parent and child chunks: greedy packing with overlap as a fold over arrays, and section structure by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 1500, 200, 400, 50


def count_tokens(text: Column) -> Column:
    """Tokens of a text: the default counter is the BM25 tokenizer."""
    return F.size(T.tokens(text))


def pack(items: Column, size: int, overlap: int, glue: str) -> Column:
    """Pack texts in order up to ``size`` tokens; the next chunk begins with trailing texts of up to ``overlap`` tokens.

    Special blocks end the chunk before them and stand alone; a text over the size is never cut.
    """
    item = "struct<t:string,n:int>"
    none = F.array().cast(f"array<{item}>")
    rows = F.transform(items, lambda x: F.struct(x.alias("t"), count_tokens(x).alias("n"), T.special_block(x).alias("s")))

    def join(cur: Column) -> Column:
        return F.array_join(F.transform(cur, lambda c: c["t"]), glue)

    def tail(cur: Column) -> Column:
        start = F.struct(none.alias("l"), F.lit(0).alias("n"), F.lit(True).alias("go"))

        def back(a: Column, x: Column) -> Column:
            fits = a["go"] & (a["n"] + x["n"] <= overlap)
            return F.when(fits, F.struct(F.concat(F.array(x), a["l"]).alias("l"), (a["n"] + x["n"]).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["l"].alias("l"), a["n"].alias("n"), F.lit(False).alias("go")))

        return F.aggregate(F.reverse(cur), start, back)

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["t"].alias("t"), x["n"].alias("n")))
        held = F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(join(acc["cur"])))).otherwise(acc["done"])
        over = (acc["n"] + x["n"] > size) & (F.size(acc["cur"]) > 0)
        return (
            F.when(x["s"], F.struct(F.concat(held, F.array(x["t"])).alias("done"), none.alias("cur"), F.lit(0).alias("n")))
            .when(over, T.let(tail(acc["cur"]), lambda t: F.struct(held.alias("done"), F.concat(t["l"], one).alias("cur"), (t["n"] + x["n"]).alias("n"))))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], one).alias("cur"), (acc["n"] + x["n"]).alias("n")))
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), none.alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(rows, zero, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(join(a["cur"])))).otherwise(a["done"]))


def parents(docs: DataFrame, items: Column, size: int = PARENT, overlap: int = PARENT_OVERLAP) -> DataFrame:
    """(doc_id, parent_index, chunk_id, content, tokens) from texts already split into paragraphs."""
    whole = F.array_join(items, "\n\n")
    packed = F.when(count_tokens(whole) <= size, F.filter(F.array(whole), lambda x: x != "")).otherwise(pack(items, size, overlap, "\n\n"))
    rows = docs.select("doc_id", F.posexplode(packed).alias("parent_index", "content"))
    return rows.withColumn("chunk_id", T.short_id(F.col("doc_id").cast("string"), F.lit("0"), F.concat(F.lit("p"), F.col("parent_index")))).withColumn("tokens", count_tokens(F.col("content")))


def children(parent_rows: DataFrame, size: int = CHILD, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Sentences of each parent packed; parent_id links back."""
    c = F.col("content")
    packed = F.when((count_tokens(c) <= size) | T.special_block(c), F.array(c)).otherwise(pack(T.sentences(c), size, overlap, " "))
    rows = parent_rows.select("doc_id", "parent_index", F.col("chunk_id").alias("parent_id"), F.posexplode(packed).alias("child_index", "content"))
    suffix = F.concat(F.lit("p"), F.col("parent_index"), F.lit("c"), F.col("child_index"))
    return rows.withColumn("chunk_id", T.short_id(F.col("doc_id").cast("string"), F.lit("0"), suffix)).withColumn("tokens", count_tokens(F.col("content")))


def with_introduction(elements: DataFrame) -> DataFrame:
    """Elements (doc_id, pos, page, kind, level, content) with the heading that each stands under.

    Adds heading_pos (the last heading of level 1 or more at or before the element; -1 before the first), section_title
    ("Introduction" there) and in_section (elements that are no heading of their own).
    """
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = (F.col("kind") == "heading") & (F.col("level") > 0)
    last = F.last(F.when(heads, F.struct("pos", "content")), True).over(order)
    return elements.withColumn("_h", last).select(*elements.columns, F.coalesce("_h.pos", F.lit(-1)).alias("heading_pos"), F.coalesce("_h.content", F.lit("Introduction")).alias("section_title"), (~heads).alias("in_section"))


def section_text(elements: DataFrame) -> DataFrame:
    """(doc_id, heading_pos, section_title, page_start, n_elements, content): the text of each section, its elements in order."""
    rows = with_introduction(elements)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("in_section"), F.struct("pos", "content")))), lambda s: s["content"]), "\n\n")
    return rows.groupBy("doc_id", "heading_pos", "section_title").agg(F.min("page").alias("page_start"), F.count_if("in_section").alias("n_elements"), body.alias("content"))


def section_paths(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """section_path, parent_pos and page_end of headings (doc_id, pos, level, page) by running windows in each document."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    out = headings
    for n in range(1, deepest + 1):
        out = out.withColumn(f"g{n}", F.sum((F.col("level") < n).cast("int")).over(order))
    for n in range(1, deepest + 1):
        inside = Window.partitionBy("doc_id", f"g{n}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"c{n}", F.sum((F.col("level") == n).cast("int")).over(inside))
    counters = F.array(*[F.col(f"c{n}") for n in range(1, deepest + 1)])
    path = F.array_join(F.filter(F.slice(counters, F.lit(1), F.col("level")), lambda c: c > 0).cast("array<string>"), ".")
    parent = F.element_at(F.array(*[F.last(F.when(F.col("level") < n, F.col("pos")), True).over(before) for n in range(1, deepest + 1)]), F.col("level"))
    nexts = F.element_at(F.array(*[F.first(F.when(F.col("level") <= n, F.col("page")), True).over(after) for n in range(1, deepest + 1)]), F.col("level"))
    last = F.max("page").over(Window.partitionBy("doc_id"))
    return out.select("doc_id", "pos", "level", "page", path.alias("section_path"), parent.alias("parent_pos"), F.coalesce(nexts - 1, last).alias("page_end"))

"""Text functions as columns: tokens, paragraphs, sentences, element kinds, keywords, ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
TOKEN = r"[一-鿿]|[a-z0-9_\-\.]+"
LIST_ITEM = (r"^[•\-*◦▪]\s+", r"^\d+[.)]\s+\w")
CODE = (r"(?m)^\s*def\s+\w+", r"(?m)^\s*class\s+\w+", r"(?m)^\s*import\s+", r"(?m)^\s*#include", r"(?m)^\s*\$\s+", r"(?m)^\s*>\s+", r"(?m)^\s*\{.*\}\s*$")
HEADING = (r"^第[一二三四五六七八九十\d]+章\s+", r"^第[一二三四五六七八九十\d]+节\s+", r"^\d+\.\s+", r"^\d+\.\d+\s+", r"^\d+\.\d+\.\d+\s+", r"^[A-Z]\.\s+", r"^附录\s*[A-Z]?\s*")
#: Levels of headings by pattern, and by least font size.
LEVELS = ((r"^第[一二三四五六七八九十\d]+章", 1), (r"^\d+\.\d+\.\d+\s+", 3), (r"^\d+\.\d+\s+", 2), (r"^\d+\.\s+", 1))
SIZES, DEEPEST = ((18, 1), (16, 2), (14, 3)), 4
#: Levels by text alone, where no font sizes are known.
TEXT_LEVELS = (
    (r"^第[一二三四五六七八九十\d]+章", 1), (r"^第[一二三四五六七八九十\d]+节", 2), (r"^\d+\.\d+\.\d+\.\d+\s+", 4), (r"^\d+\.\d+\.\d+\s+", 3),
    (r"^\d+\.\d+\s+", 2), (r"^\d+\.\s+", 1), (r"^附录\s*[A-Z]?", 1),
)
KEYWORD = (r"\b[A-Z]{2,}\b", r"\b[a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+)+\b", r"\bv?\d+\.\d+(?:\.\d+)?(?:-\w+)?\b", r"\b(?:0x[0-9A-Fa-f]+|ERROR_\w+|ERR_\w+)\b", r"(?:/[\w/]+|--?\w+)")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def matches_any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def tokens(text: Column) -> Column:
    """Lower-case BM25 tokens: single CJK characters, runs of ASCII letters, digits, _ - and dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[。！？；.!?;])\s*"), lambda x: F.trim(x)), lambda p: p != "")


def special_block(text: Column) -> Column:
    """Is it a markdown table or a fenced block?"""
    t = F.trim(text)
    return (t.startswith("|") & t.contains("---")) | t.startswith("```") | t.startswith("~~~")


def element_kind(text: Column, font_size: Column, bold: Column, min_size: float = 12.0) -> Column:
    t = F.trim(text)
    return (
        F.when(matches_any(t, LIST_ITEM), "list")
        .when(matches_any(t, CODE), "code")
        .when(matches_any(t, HEADING), "heading")
        .when((font_size >= min_size) & bold & (F.length(t) < 100), "heading")
        .otherwise("paragraph")
    )


def heading_level(text: Column, font_size: Column) -> Column:
    """Level of a heading: the first pattern that fits, else by font size."""
    out = F.lit(DEEPEST)
    for least, level in reversed(SIZES):
        out = F.when(font_size >= least, level).otherwise(out)
    for pattern, level in reversed(LEVELS):
        out = F.when(text.rlike(pattern), level).otherwise(out)
    return out


def text_level(text: Column) -> Column:
    """Level of a heading by its text alone; 0 for other texts."""
    t, out = F.trim(text), F.lit(0)
    for pattern, level in reversed(TEXT_LEVELS):
        out = F.when(t.rlike(pattern), level).otherwise(out)
    return out


def prefix_sums(values: Column, bundle: int = 256) -> Column:
    """array<bigint>: running sums of an array<int>; made in bundles, as appending to an array copies it."""
    none = F.array().cast("array<bigint>")

    def one(acc: Column, v: Column) -> Column:
        at = acc["at"] + v
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def part(acc: Column, i: Column) -> Column:
        folded = F.aggregate(F.slice(values, i * bundle + 1, F.lit(bundle)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return let(folded, lambda f: F.struct(f["at"].alias("at"), F.concat(acc["out"], F.array(f["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(values) / bundle).cast("int")), start, part, lambda acc: F.flatten(acc["out"]))


def keywords(text: Column) -> Column:
    """Distinct keywords of six families, sorted; letters of all scripts are parts of words, as in Python."""
    found = [F.regexp_extract_all(text, F.lit(f"(?U)({p})"), F.lit(1)) for p in KEYWORD]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def short_id(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, size)

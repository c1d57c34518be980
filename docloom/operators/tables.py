"""Operators on tables held as array<array<string>> (raw, first row possibly headers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import let, matches_any

# Keywords and patterns that decide results.
HEADER_WORDS = ("名称", "参数", "说明", "类型", "值", "描述", "name", "type", "value", "description", "id")
SPEC_WORDS = ("参数", "配置", "规格", "spec", "config", "parameter", "项目", "属性", "property", "setting")
MAPPING_WORDS = ("错误码", "代码", "状态", "code", "error", "status", "id")
STEP_WORDS = ("步骤", "序号", "step", "no", "#", "操作")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "是", "否", "√", "×", "✓", "✗")
DATES = (r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{1,2}[-/]\d{1,2}[-/]\d{4}", r"\d{4}年\d{1,2}月\d{1,2}日")
CODES = (r"^[A-Za-z_][A-Za-z0-9_]*\s*\(", r"^[A-Za-z_][A-Za-z0-9_]*\s*=", r"^--\w+", r"^\$\w+", r"^[A-Z_]+$")
TITLES = (r"表\s*\d+[.:：]\s*([^\n]+)", r"Table\s*\d+[.:]\s*([^\n]+)", r"图表\s*\d+[.:：]\s*([^\n]+)")
NOT_A_NAME = r"^[\d,.\-+%]+$"
#: What stands for a floating-point number, the words in any case.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def has_word(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return out


def clean(raw: Column) -> Column:
    return F.transform(raw, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))


def empty_share(raw: Column) -> Column:
    cells = F.flatten(raw)
    return F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")) / F.greatest(F.size(cells), F.lit(1))


def valid(raw: Column, min_rows: int = 2, min_cols: int = 2) -> Column:
    full = F.size(F.filter(F.flatten(raw), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return (F.size(raw) >= min_rows) & (F.size(raw[0]) >= min_cols) & (full >= 0.3 * F.size(raw) * F.size(raw[0]))


def header_score(row: Column) -> Column:
    def cell(c: Column) -> Column:
        t = F.trim(F.coalesce(c, F.lit("")))
        return (F.length(t) < 30).cast("int") + ((t != "") & ~t.rlike(NOT_A_NAME)).cast("int") + 2 * has_word(t, HEADER_WORDS).cast("int")

    return F.aggregate(row, F.lit(0), lambda s, c: s + cell(c))


def has_header(raw: Column) -> Column:
    return (F.size(raw) >= 2) & (header_score(raw[0]) >= F.size(raw[0]))


def headers(raw: Column) -> Column:
    return F.transform(raw[0], lambda c, i: F.when(F.trim(c) != "", F.trim(c)).otherwise(F.concat(F.lit("列"), (i + 1).cast("string"))))


def numeric(value: Column) -> Column:
    return F.regexp_replace(value, r"[,%$€¥ ]", "").rlike(NUMBER)


def column_type(values: Column) -> Column:
    """Type by vote of the non-empty values of a column."""
    held = F.filter(values, lambda v: F.trim(v) != "")
    n = F.size(held)

    def share(test) -> Column:
        return F.size(F.filter(held, test)) / F.greatest(n, F.lit(1))

    return (
        F.when(n == 0, "text")
        .when(share(numeric) > 0.8, F.when(F.exists(held, lambda v: F.contains(v, F.lit("%"))), "percentage").otherwise("number"))
        .when(share(lambda v: matches_any(v, DATES)) > 0.8, "date")
        .when(share(lambda v: F.lower(v).isin(*BOOLEAN_WORDS)) > 0.8, "boolean")
        .when(share(lambda v: matches_any(v, CODES)) > 0.5, "code")
        .otherwise("text")
    )


def table_type(names: Column, rows: Column) -> Column:
    first = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: r[0])
    return (
        F.when(F.exists(names, lambda h: has_word(h, SPEC_WORDS)), "specification")
        .when((F.size(names) >= 3) & F.forall(first, lambda v: ~numeric(v)), "comparison")
        .when(F.exists(names, lambda h: has_word(h, MAPPING_WORDS)), "mapping")
        .when(F.exists(names, lambda h: has_word(h, STEP_WORDS)), "procedure")
        .otherwise("data")
    )


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def markdown(raw: Column, title: Column | None = None) -> Column:
    """A table whose first row is its header."""

    def line(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(r, _escaped), " | "), F.lit(" |"))

    n = F.size(raw[0])
    body = F.transform(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))), lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), F.lit(1), n)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    text = F.array_join(F.concat(F.array(line(raw[0]), rule), body), "\n")
    return text if title is None else F.concat(F.lit("**"), title, F.lit("**\n\n"), text)


def records(raw: Column) -> Column:
    """JSON records of a table whose first row is its header: a row's cells beyond the header, and names without a cell, are
    left out; of cells under one name the last counts."""

    def record(names: Column, row: Column) -> Column:
        n = F.least(F.size(names), F.size(row))
        pairs = F.zip_with(F.slice(names, F.lit(1), n), F.slice(row, F.lit(1), n), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        return F.map_from_entries(F.transform(F.array_distinct(F.slice(names, F.lit(1), n)), lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))

    return let(headers(raw), lambda names: F.to_json(F.transform(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))), lambda r: record(names, r))))


def padded_markdown(raw: Column) -> Column:
    """A table as markdown, cells on one line and rows padded to the widest; without rows the empty text."""

    def cell(c: Column) -> Column:
        return F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def text(n: Column) -> Column:
        rows = F.transform(raw, lambda r: line(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), n - F.size(r)))))
        return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(line(F.array_repeat(F.lit("---"), n))), F.slice(rows, F.lit(2), F.size(rows) - 1)), "\n")

    return F.when(F.size(raw) > 0, let(F.array_max(F.transform(raw, lambda r: F.size(r))), text)).otherwise("")


def table_title(text: Column) -> Column:
    """The first title of the first pattern that a page's text has, else the empty text."""
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 0)), F.lit("")) for p in TITLES]
    return F.coalesce(*found, F.lit(""))


def column_counts(raw: Column) -> Column:
    """The distinct numbers of cells of a table's rows, in order."""
    return F.array_sort(F.array_distinct(F.transform(raw, lambda r: F.size(r))))


def described(names: Column, row: Column) -> Column:
    pairs = F.zip_with(F.slice(names, F.lit(1), F.least(F.size(names), F.size(row))), F.slice(row, F.lit(1), F.least(F.size(names), F.size(row))), lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v)))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")

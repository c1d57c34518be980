"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is read as units: its runs of non-space characters cut into pieces of up to four code points.  In scripts that are
written without spaces (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han) every code point begins a unit of its own, with up
to three that follow it, so that no unit's border depends on how many code points stand before; so does every code point
that 16 others of its run follow (in long names, encoded data, code without spaces), so that pieces of a long run are cut
at its end only.  Of every k consecutive
units the k-mer is an anchor if the smallest hash of its inner s-unit substrings lies at its first or last
position (at either, on ties).  Whether a k-mer is an anchor depends on the k-mer alone, so texts that share a passage
share its anchors wherever it stands.  A text of fewer than k units has one anchor, all of its units.

Defined cases: a null text is empty; a text without units has no anchor and the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another 0.  Hashes of k-mers have 32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import let, partitions

K, S = 9, 2

#: Code points of scripts without spaces, for a class of characters.
UNSPACED = (
    r"\u0E00-\u109F\u1780-\u17FF\u1950-\u19FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u3029\u3040-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF"
    r"\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFF66-\uFF9F\x{1AFF0}-\x{1B16F}\x{20000}-\x{3FFFF}"
)
_SPACED = rf"[^\x20\x09-\x0D{UNSPACED}]"
#: Code points of a run that follow one that begins a unit in any case.
FAR = 16
UNIT = rf"(?=({_SPACED}{{1,4}}|[{UNSPACED}]{{1,4}}))(?:[{UNSPACED}]|(?={_SPACED}{{{FAR + 1}}}){_SPACED}|{_SPACED}{{1,4}})"

def _pairs(a: Column, shift: int, join) -> Column:
    """join(a[i], a[i + shift]) for every i that has both."""
    n = F.size(a) - shift
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + shift), n), join)


def _substrings(units: Column, s: int) -> Column:
    out = units
    for i in range(1, s):
        n = F.size(units) - i
        out = F.zip_with(F.slice(out, F.lit(1), n), F.slice(units, F.lit(1 + i), n), lambda x, y: F.xxhash64(x, y))
    return out


def _minima(values: Column, width: int, body) -> Column:
    """body(sliding minima of ``width`` values), the width doubled at each pass."""

    def widen(done: int):
        def step(a: Column) -> Column:
            if done == width:
                return body(a)
            shift = min(done, width - done)
            return let(_pairs(a, shift, lambda x, y: F.least(x, y)), widen(done + shift))

        return step

    return widen(1)(values)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position int, code bigint>>: the anchors in order; positions count units from 1."""
    width = k - s + 1
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(1)), lambda u: F.xxhash64(u))

    def chosen(h: Column) -> Column:
        n = F.size(h)

        def pick(sub: Column):
            return lambda low: F.transform(
                F.filter(F.sequence(F.lit(1), n - (k - 1)), lambda i: (F.element_at(low, i) == F.element_at(sub, i)) | (F.element_at(low, i) == F.element_at(sub, i + (width - 1)))),
                lambda i: F.struct(i.alias("position"), F.xxhash64(F.slice(h, i, F.lit(k))).alias("code")),
            )

        whole = F.array(F.struct(F.lit(1).alias("position"), F.xxhash64(h).alias("code")))
        many = let(_substrings(h, s), lambda sub: _minima(sub, width, pick(sub)))
        return F.when(n >= k, many).when(n > 0, whole).otherwise(F.slice(whole, 1, 0))

    return let(hashes, chosen)


def distinct_codes(found: Column) -> Column:
    """array<int>: the distinct codes of anchors, in the order of their first places."""
    return F.array_distinct(F.transform(found, lambda a: F.shiftright(a["code"], 32).cast("int")))


def codes(text: Column, k: int = K, s: int = S) -> Column:
    """The distinct codes of a text's anchors."""
    return distinct_codes(anchors(text, k, s))


def placed(found: Column) -> Column:
    """array<bigint>: anchors with their places, as one number each."""
    return F.transform(found, lambda a: F.shiftleft(a["position"].cast("bigint"), 32).bitwiseOR(F.shiftrightunsigned(a["code"], 32)))


def aligned(a: Column, b: Column) -> Column:
    """Positional matching of two texts' placed anchors: the share of the first's that the second has at the same place."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def matched(rows: DataFrame, others: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, other_id, shift and n: how many anchors two texts of (doc_id, text) share at places that differ by ``shift``.

    Anchors meet by an equality join on their codes, and only (pair, shift) counts meet again.  An anchor that stands
    often in both tables makes as many rows as pairs: give the table of queries as ``rows``.
    """

    def each(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("doc_id").alias(name), F.explode(anchors(F.col("text"), k, s)).alias("a")).select(name, F.col("a.code").alias("code"), F.col("a.position").alias(f"at_{name}"))

    met = each(rows, "doc_id").join(each(others, "other_id"), "code")
    return met.groupBy("doc_id", "other_id", (F.col("at_other_id") - F.col("at_doc_id")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as a string: eight hex digits for each anchor."""
    return F.array_join(F.transform(fingerprint, lambda c: F.lpad(F.lower(F.hex(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def with_next(docs: DataFrame, extra: Column | None = None) -> DataFrame:
    """doc_id, text, extra, next_text and next_extra: each row with the row after it by (doc_id, text), the last with the first.

    doc_id is numeric; null ids come first.  Rows are dealt to ranges of doc_id between percentiles of all ids, and the
    first row of each range is also dealt to the range before it, so that no order of all rows is needed in one place
    and texts are shuffled once.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * partitions(spark)
    low, nulls, cuts = base.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10000)).first()
    starts = sorted({c for c in cuts or [] if c > low or nulls})
    kind = base.schema["doc_id"].dataType

    def listed(values: list) -> Column:
        return F.array(*[F.lit(c) for c in values]).cast(f"array<{kind.simpleString()}>")

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= F.col("doc_id")))

    # the range of an id: first among every 128th edge, then among the edges from there on
    edges, coarse = listed(starts), listed(starts[::128])
    passed = F.greatest(upto(coarse) - 1, F.lit(0)) * 128
    spot = F.when(F.col("doc_id").isNull(), 0).otherwise(passed + upto(F.slice(edges, passed + 1, F.lit(128))))
    first = F.when(spot > 0, F.try_element_at(edges, spot) == F.col("doc_id"))
    begins = F.col("doc_id").eqNullSafe(F.lit(None if nulls else low).cast(kind)) | F.coalesce(first, F.lit(False))
    before = F.when(F.col("spot") == 0, len(starts)).otherwise(F.col("spot") - 1)
    here = F.struct(F.col("spot").alias("range"), F.lit(False).alias("guest"))
    both = F.array(here, F.struct(before.alias("range"), F.lit(True).alias("guest")))
    dealt = base.withColumn("spot", spot).withColumn("at", F.explode(F.when(begins, both).otherwise(F.array(here)))).select("doc_id", "text", "at.range", "at.guest")
    dealt = dealt.repartition(partitions(spark), "range").withColumn("extra", F.lit(None) if extra is None else extra)
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_extra", F.lead("extra").over(order)).where(~F.col("guest")).drop("range", "guest")


def fingerprint_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the beginning of the next document.

    Repeated doc_ids are ordered by text; the next document of a row is then the next row.
    """
    own = let(anchors(F.col("text"), k, s), lambda a: F.struct(distinct_codes(a).alias("codes"), placed(a).alias("placed")))
    rows = with_next(docs, own).withColumnRenamed("extra", "own").withColumn("n_chars", F.length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - part), F.substring("next_text", F.lit(1), part))
    rows = rows.withColumn("edited", edited)
    changed = let(anchors(F.col("edited"), k, s), lambda a: F.struct(distinct_codes(a).alias("codes"), placed(a).alias("placed")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own.codes").alias("own"), F.col("own.placed").alias("own_placed"), F.col("next_extra.codes").alias("next"), changed.alias("changed"))
    near = [likeness(F.col("own"), F.col("changed.codes")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), aligned(F.col("own_placed"), F.col("changed.placed")).alias("aligned_edited")]
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed.codes")).alias("edited_fingerprint"), *near)

"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

A text version is a blob, addressed by the SHA-256 of its UTF-8 bytes.  The ledger is a table of (rule version, blob)
with the blob's spans, blobs without any included.  A scan addresses all rows, scans each blob that the ledger does not
hold for the rule version once, appends what it found, and joins findings back to every row of the blob: give it the
table of all historical versions (path, version, text), and each path and version gets the findings of its blob.  Rows
meet by blob only in sorted joins that split large partitions, and blobs are made distinct on the map side first.

The rule version is a digest of the rules, so findings of other rules are never taken for theirs.  Two writers at once may
append a blob twice; a ledger with repeated blobs is read through their distinct rows.

Rules, leftmost matches that do not overlap within a kind, offsets in code points and ends exclusive; ``assign`` is a
keyword, a separator and a value of 6 or more characters, the span is all of it.  Matches that are too short are
dropped after matching.

Defined cases: a null text is the empty blob; a text without secrets has no spans; repeated rows keep their count; any
other columns are passed on by ``scan``, which raises ValueError if one has the name of a column that it adds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import cut, let, shared_folder

KINDS = ("assign", "access", "hex")
_VALUE = r"[A-Za-z0-9+/_.=-]+"
_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: For the last two, matching a minimal length finds the same spans as dropping short ones, as runs are matched whole.
PATTERNS = {"assign": _HEAD + _VALUE, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
MIN_VALUE = 6
RULE_VERSION = "base-" + hashlib.sha256(repr((KINDS, PATTERNS, MIN_VALUE)).encode()).hexdigest()[:12]

_SPAN = "struct<start:int,kind:int,end:int>"
#: Items that are folded into one array before the arrays are put together.
BUNDLE = 256


def _scan(items: Column, carry: Column, step, kind: str, body) -> Column:
    """body(array of ``kind`` that the steps emit, last carry); step(carry, item) gives (new carry, array to emit).

    Appending to an array copies it, so items are folded in bundles, and arrays of bundles are put together at the end.
    """
    none, bundles = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, item: Column) -> Column:
        after, emitted = step(acc["carry"], item)
        return F.struct(after.alias("carry"), F.concat(acc["out"], emitted).alias("out"))

    def bundle(acc: Column, i: Column) -> Column:
        folded = F.aggregate(F.slice(items, i * BUNDLE + 1, F.lit(BUNDLE)), F.struct(acc["carry"].alias("carry"), none.alias("out")), one)
        return let(folded, lambda f: F.struct(f["carry"].alias("carry"), F.concat(acc["out"], F.array(f["out"])).alias("out")))

    numbers = F.sequence(F.lit(0), F.floor(F.size(items) / BUNDLE).cast("int"))
    return F.aggregate(numbers, F.struct(carry.alias("carry"), bundles.alias("out")), bundle, lambda acc: body(F.flatten(acc["out"]), acc["carry"]))


def _kind_spans(text: Column, rank: int) -> Column:
    """array<struct<start, kind, end>>, kind as its place in KINDS.

    Each extracted piece is what stands between the match before and this one, and this one; lengths add up to offsets.
    """
    pattern = PATTERNS[KINDS[rank]]
    pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(at: Column, piece: Column) -> tuple:
        end = at + F.length(piece)
        match = F.regexp_extract(piece, rf"(?:{pattern})\z", 0)
        found = F.array(F.struct((end - F.length(match)).alias("start"), F.lit(rank).alias("kind"), end.alias("end")))
        if KINDS[rank] == "assign":
            enough = F.length(F.regexp_extract(piece, rf"{_HEAD}({_VALUE})\z", 1)) >= MIN_VALUE
            found = F.when(enough, found).otherwise(empty)
        return end, found

    folded = let(pieces, lambda own: _scan(own, F.lit(0), step, _SPAN, lambda out, _: out))
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind."""
    return F.array_sort(F.concat(*[_kind_spans(text, i) for i in range(len(KINDS))]))


def named(found: Column) -> Column:
    """Spans as kind:start:end, joined with commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover, overlapping ones as one, replaced by ``mark``.

    What stands between the stretches is cut out in bundles, first a bundle's part of the text and then its pieces, as
    each cut counts code points from the beginning of what it cuts.
    """

    def step(at: Column, s: Column) -> tuple:
        gap = F.array(F.struct(at.alias("begin"), s["start"].alias("end")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, gap).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))

    def cut_out(gaps: Column) -> Column:
        def pieces(part: Column) -> Column:
            first, last = part[0]["begin"], F.element_at(part, -1)["end"]
            return let(F.substring(text, first + 1, last - first), lambda own: F.transform(part, lambda g: F.substring(own, g["begin"] - first + 1, g["end"] - g["begin"])))

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / BUNDLE).cast("int")), lambda i: F.slice(gaps, i * BUNDLE + 1, F.lit(BUNDLE)))
        return F.array_join(F.flatten(F.transform(parts, pieces)), mark)

    def gaps(out: Column, at: Column) -> Column:
        return F.concat(out, F.array(F.struct(at.alias("begin"), F.length(text).alias("end"))))

    return F.when(F.size(found) > 0, let(_scan(found, F.lit(0), step, "struct<begin:int,end:int>", gaps), cut_out)).otherwise(text)


class BlobLedger:
    """The findings table in ``root``, one folder for each rule version; ``root`` is in storage that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None, rule_version: str = RULE_VERSION):
        self.spark, self.root, self.rule_version = spark, root or shared_folder(spark, "secret-ledger"), rule_version

    @property
    def path(self) -> str:
        return f"{self.root}/rules={self.rule_version}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def entries(self) -> DataFrame:
        """(blob, spans) of all blobs scanned under the rule version, each once."""
        schema = f"blob binary, spans array<{_SPAN}>"
        fs, path = self._fs()
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.path)
        repeated = not rows.groupBy("blob").count().where("count > 1").isEmpty()
        return cut(rows.groupBy("blob").agg(F.first("spans").alias("spans"))) if repeated else rows

    def update(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Scan the blobs of ``docs`` that are not in the ledger and append them; returns all entries."""
        blobs = docs.select(_address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        unseen = blobs.join(self.entries().select("blob"), "blob", "left_anti") if self._fs()[0].exists(self._fs()[1]) else blobs
        once = unseen.groupBy("blob").agg(F.first("_text").alias("_text"))
        once.select("blob", spans(F.col("_text")).alias("spans")).write.mode("append").parquet(self.path)
        return self.entries()

    def scan(self, docs: DataFrame, text: str = "text", names: tuple = ("_blob", "_spans")) -> DataFrame:
        """Every row of ``docs`` with its blob and spans, in columns of these names."""
        if taken := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
            raise ValueError(f"columns named {sorted(taken)} are in the table; choose other names")
        blob, found = names
        entries = self.update(docs, text).select(F.col("blob").alias(blob), F.col("spans").alias(found))
        return docs.withColumn(blob, _address(F.col(text))).join(entries, blob, "left")


def _count(found: Column, rank: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == rank)).cast("long")


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def findings(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans and all spans of each row."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    rows = ledger.scan(docs.select("doc_id", "text")).select("doc_id", F.col("_spans").alias("spans")).withColumn("named", named(F.col("spans")))
    counts = [_count(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2("named", 256).alias("base_sha256"), F.col("named").alias("spans"))

"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A text is lower-cased, runs of anything but letters become one space, and n-grams of one to three code points are
counted, spaces marking word ends.  A profile is the ``TOP`` most frequent n-grams in order, ties by code.  A document
takes the language whose profile has the smallest out-of-place distance: for each of the document's n-grams the
difference of ranks, or TOP if the profile lacks it.  ``score`` is 1 less the mean difference over TOP.

Profiles are fitted on a bounded sample: up to about ``sample`` labelled documents a language, drawn by a hash of the
id, of every language.  Every text is then classified whole.

Defined cases: texts that are null or have no letter are ``und`` with score 0, and so is every text if nothing was
learned; ties go to the language that sorts first; repeated rows keep their count; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.window import Window

from docloom.llm.common import in_batches, unused

TOP, SAMPLE = 400, 2000
UNKNOWN = "und"
#: The profile of a language without a name, for ``accepted`` where nothing was learned: no n-gram has code 0.
ANY = {"mis": [0]}


def _letters():
    """Is a code point below 65536 a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def grams(text: str | None, letters):
    """Distinct n-grams as whole numbers, and their counts; empty if the text has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    is_letter = letters[np.minimum(points, 0xFFFF)]
    if (wide := points > 0xFFFF).any():
        is_letter[wide] = [chr(c).isalpha() for c in points[wide]]
    if not is_letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    spaced = np.concatenate(([0], np.where(is_letter, points, 0), [0])).astype(np.uint64)
    held = (spaced != 0) | np.append(True, spaced[:-1] != 0)
    s = spaced[held]
    one = s[s != 0]
    s[s == 0] = 1  # a space is part of an n-gram's code, and no letter has code point 1
    two = s[:-1] | (s[1:] << np.uint64(21))
    three = two[:-1] | (s[2:] << np.uint64(42))
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def leading(codes, counts, top: int = TOP):
    """The ``top`` most frequent codes, in order."""
    if len(codes) > top:
        floor = np.partition(counts, len(counts) - top)[len(counts) - top]
        held = counts >= floor
        codes, counts = codes[held], counts[held]
    return codes[np.argsort(-counts, kind="stable")][:top]


def _counted(batches):
    letters = _letters()
    for batch in batches:
        held: dict = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, []).append(grams(text.as_py(), letters))
        for lang, parts in held.items():
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "code", "n"])


def train(labelled: DataFrame, sample: int = SAMPLE, top: int = TOP) -> dict:
    """Profiles {language: codes in order} from (doc_id, text, lang)."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rates = labelled.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.join(F.broadcast(rates), "lang").where(draw < F.col("rate"))
    counts = in_batches(drawn.select("lang", "text"), _counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out: dict = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return out


def classifier(profiles: dict, top: int = TOP):
    """A function of a text that gives its language and score."""
    tables = []
    for lang in sorted(profiles):
        codes = np.array(profiles[lang], np.int64).view(np.uint64)
        order = np.argsort(codes)
        tables.append((lang, codes[order], order))
    letters = _letters()

    def classify(text: str | None) -> tuple[str, float]:
        codes = leading(*grams(text, letters), top)
        if not len(codes) or not tables:
            return UNKNOWN, 0.0
        own, best = np.arange(len(codes)), (UNKNOWN, -1.0)
        for lang, known, ranks in tables:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            far = np.where(known[at] == codes, np.minimum(np.abs(ranks[at] - own), top), top)
            if (score := 1 - far.mean() / top) > best[1]:
                best = lang, float(score)
        return best

    return classify


def _classified(profiles: dict, top: int, names: tuple = ("lang_pred", "score")):
    def run(batches):
        classify = classifier(profiles, top)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names[:-1], *names])

    return run


def identify(docs: DataFrame, profiles: dict, top: int = TOP) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text")
    return in_batches(rows, _classified(profiles, top), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: dict, top: int = TOP) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with their columns; without profiles, those whose text has a letter."""
    names, (lang, score) = [c for c in docs.columns if c != "text"], (unused(docs, c) for c in ("_lang_pred", "_score"))
    held = unused(docs, "_text")
    schema = StructType([docs.schema[c] for c in names]).add(held, StringType()).add(lang, StringType()).add(score, DoubleType())
    rows = docs.select(*names, F.col("text").alias(held), "text")
    rows = in_batches(rows, _classified(profiles or ANY, top, (lang, score)), schema)
    return rows.where(F.col(lang) != UNKNOWN).select(*[F.col(held).alias("text") if c == "text" else F.col(c) for c in docs.columns])

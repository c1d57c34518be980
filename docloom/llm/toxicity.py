"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another.  Each is a logistic regression on the presence of words and of word
beginnings (so that inflected and compound forms count), with the probabilities of the categories before it as further features.  In training those probabilities are out of fold: they
come from models fitted without the row, so a later model sees them as it will see them at prediction.

Models are fitted on the driver from a bounded sample: up to ``SAMPLE`` labelled documents with the smallest hashes of
their ids, and the ``WORDS`` words of each category that separate its documents best in the sample.  Only ids, labels
and those words' presence reach the driver.  The table's labels are quality and toxic, so the default chain is low
quality, then toxic; any 0/1 columns of a labels table may form a chain.

Defined cases: a null or empty text has no words; of repeated labels of a document the largest counts, of several texts
of one doc_id the model learns from the smallest; documents with a null label are not learned from; a category with one class in the sample is predicted by its share; repeated rows
keep their count, other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, in_batches

SAMPLE, WORDS, FOLDS, RIDGE, ROUNDS = 8000, 256, 5, 1.0, 12
#: Lengths of the word beginnings that are features.
STEMS = (3, 4, 5, 6, 7, 8)
CHAIN = ("low_quality", "toxic")
THRESHOLD = 0.4


def words_of(text: str | None) -> set:
    """The distinct lower-case words (runs of letters), and their beginnings marked with a star."""
    whole = {m[0] for m in re.finditer(r"[^\W\d_]+", (text or "").lower())}
    return whole.union(*[{w[:n] + "*" for w in whole if len(w) >= n} for n in STEMS])


def _worded(batches):
    for batch in batches:
        found = [sorted(words_of(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["doc_id", "words"])


def fit(x, y):
    """Weights (intercept last) of a ridge logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return w
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x, w):
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x, labels, folds, count: int = FOLDS) -> list:
    """Weights of each category; ``labels`` has a column for each, ``folds`` the fold of each row."""
    out = []
    for y in labels.T:
        ahead = np.zeros(len(y))
        for k in range(count):
            if (held := folds == k).any():
                ahead[held] = probability(x[held], fit(x[~held], y[~held]))
        out.append(fit(x, y))
        x = np.hstack([x, ahead[:, None]])
    return out


def train(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, sample: int = SAMPLE, words: int = WORDS) -> dict:
    """A model from texts (doc_id, text) and labels (doc_id and a 0/1 column for each category)."""
    known = labels.where("doc_id is not null").dropna(subset=list(chain)).groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in chain])
    drawn = cut(known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample))
    # the sample's size is bounded, so its ids may be broadcast: texts are not shuffled
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = cut(in_batches(texts, _worded, f"doc_id {kind}, words array<string>").join(drawn, "doc_id"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in chain]).first()
    counts = rows.select(F.explode("words").alias("word"), *chain).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in chain])
    vocabulary: set = set()
    for c in chain:
        inside, outside = float(totals[c] or 0), float(totals["n"]) - float(totals[c] or 0)
        if inside and outside:
            a, b, p = F.col(c) / inside, (F.col("n") - F.col(c)) / outside, (F.col("n") + 1) / (totals["n"] + 2)
            z = F.abs(a - b) / F.sqrt(p * (1 - p) * (1 / inside + 1 / outside))
            vocabulary |= {r["word"] for r in counts.orderBy(F.desc(z), "word").limit(words).collect()}
    names = sorted(vocabulary)
    at = {w: i for i, w in enumerate(names)}
    held = F.array_intersect("words", F.array(*[F.lit(w) for w in names]).cast("array<string>")) if names else F.array().cast("array<string>")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(FOLDS)).cast("int")
    data = rows.select("doc_id", held.alias("held"), fold.alias("fold"), *chain).orderBy("doc_id").collect()
    x = np.zeros((len(data), len(names)))
    for i, r in enumerate(data):
        x[i, [at[w] for w in r["held"]]] = 1
    y = np.array([[r[c] for c in chain] for r in data]).reshape(len(data), len(chain))
    weights = fit_chain(x, y, np.array([r["fold"] for r in data]))
    return {"chain": list(chain), "words": at, "weights": weights}


def _scored(model: dict):
    def run(batches):
        at, known = model["words"], frozenset(model["words"])
        for batch in batches:
            x = np.zeros((batch.num_rows, len(at)))
            for i, t in enumerate(batch.column(1)):
                x[i, [at[w] for w in words_of(t.as_py()) & known]] = 1
            out = []
            for w in model["weights"]:
                out.append(probability(x, w))
                x = np.hstack([x, out[-1][:, None]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p) for p in out]], ["doc_id", *[f"p_{c}" for c in model["chain"]]])

    return run


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and whether the last one is at least the threshold."""
    rows = docs.select("doc_id", "text")
    kinds = ", ".join(f"p_{c} double" for c in model["chain"])
    last = model["chain"][-1]
    return in_batches(rows, _scored(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}").withColumn(last, F.col(f"p_{last}") >= threshold)

"""Slots for learned models: an Arrow UDF for each, with a deterministic stand-in that needs no model."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def embedder(encode=None, size: int = 64):
    """A column function text -> array<float>; ``encode`` takes a list of texts, the stand-in hashes their words."""

    def stand_in(texts):
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    run = encode or stand_in

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in run(texts.tolist())])

    return embed


def generator(answer=None):
    """A column function (question, context) -> text; the stand-in is extractive: the context's beginning."""

    @F.pandas_udf("string")
    def generate(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([answer(q, c) if answer else (c or "")[:500] for q, c in zip(questions, contexts)])

    return generate


def prefixed(query: Column) -> Column:
    """A query as the embedding model wants it; passages are embedded as they are."""
    return F.concat(F.lit(QUERY_PREFIX), query)


def reranker(score=None):
    """A column function (query, passage) -> double; ``score`` takes a list of pairs, the stand-in is the share of common words."""

    def stand_in(pairs):
        for pair in pairs:
            a, b = (set(re.findall(r"\S+", t.lower(), re.ASCII)) for t in pair)
            yield len(a & b) / max(len(a | b), 1)

    run = score or stand_in

    @F.pandas_udf("double")
    def rank(queries: pd.Series, passages: pd.Series) -> pd.Series:
        return pd.Series([float(s) for s in run([(q or "", p or "") for q, p in zip(queries, passages)])])

    return rank

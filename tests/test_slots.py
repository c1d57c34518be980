"""Images, filters, dictionaries, transforms and model slots against plain loops."""

import base64
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import models
from docloom.operators import generation, images, metadata, search, telemetry, terms
from docloom.plans import catalog
from docloom.streaming import telemetry as streams

SF = "/root/testdata/sf0.001"


def test_images(spark):
    contents = [None, b"", b"a", bytes(range(74)), bytes(range(75)), bytes(range(200)) * 50]
    rows = spark.createDataFrame([(i, i + 1, "" if i % 2 else None if i == 4 else "C", c) for i, c in enumerate(contents)], "id int, page int, caption string, content binary")
    out = {r["id"]: (r["text"], r["image_data"], r["has_caption"]) for r in images.elements(rows).collect()}
    plain = {i: base64.b64encode(c).decode()[:100] + "..." for i, c in enumerate(contents) if c is not None}
    assert {i: r[1] for i, r in out.items()} == plain
    assert out[2][0] == "C" and out[2][2] and out[1][0] == "[Image on page 2]" and out[4][0] == "[Image on page 5]" and not out[4][2]
    made = spark.createDataFrame([(1, "a flow", "x"), (2, "", "y"), (3, None, "z")], "image_id int, description string, path string")
    assert [(r["chunk_id"], r["metadata"]["image_type"], r["metadata"]["path"]) for r in images.chunks(made).collect()] == [("img_1", "diagram", "x")]
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],)], "v array<double>")
    assert [r[0] for r in vectors.select(images.unit(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None, None]


def test_filters_of_stores(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "a", 6), (4, None, 5)], "id int, s string, n int")
    found = {name: [r[0] for r in rows.where(c).collect()] for name, c in (("v", metadata.vector_condition({"s": "a", "n": 5})), ("t", metadata.term_condition({"s": "a", "n": 5})), ("l", metadata.term_condition({"s": ["a", "b"], "n": [6]})), ("none", metadata.term_condition({})))}
    assert found == {"v": [1, 3], "t": [1], "l": [3], "none": [1, 2, 3, 4]}


def test_a_dictionary_in_one_file(spark, tmp_path):
    entry = {"term": "t", "canonical": "T", "aliases": ["x"], "abbreviations": [], "related_terms": ["r"], "domain": "d"}
    (tmp_path / "own.json").write_text(json.dumps({"terms": [entry, entry | {"canonical": "U"}]}, indent=2))
    rows = terms.load(spark, f"file://{tmp_path}/own.json", whole=True).collect()
    assert [(r["canonical"], r["aliases"], r["related"]) for r in rows] == [("T", ["x"], ["r"]), ("U", ["x"], ["r"])]


def test_transformed_queries_keep_their_order(spark):
    out = {r["q"]: (r["expanded"], r["answer"]) for r in catalog.queries()["query_transform"](spark, SF).collect()}
    asked = spark.createDataFrame([(q,) for q in out], "q string")
    own = {r["q"]: r["variants"] for r in terms.expand_queries(asked, terms.dictionary(spark)).collect()}
    rules = {r["q"]: r["v"] for r in asked.select("q", terms.simple_expand(F.col("q")).alias("v")).collect()}
    assert out == {q: (list(dict.fromkeys([q, *own[q], *rules[q]])), q[:500]) for q in out} and any(len(v[0]) > 1 for v in out.values())
    alone = terms.transformed(asked.union(asked), terms.dictionary(spark)).collect()
    assert {r["q"]: r["expanded"] for r in alone} == own and len(alone) == len(own) and all(r["answer"] is None for r in alone)


def test_embedded_search_equals_a_plain_loop(spark):
    docs = {i: t for i, t in enumerate(["red fish", "blue fish", "red red sky", "", "fish and sky and red"])}
    embed = models.embedder()
    rows = spark.createDataFrame(list(docs.items()), "vec_id long, t string").select("vec_id", embed("t").alias("embedding"))
    held = {r[0]: r[1] for r in rows.collect()}
    asked = rows.select((-F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("q"))
    best = {}
    for r in search.nearest(rows, asked, 2).where("rank = 1 and score is not null").collect():
        best[-r["query_id"] - 1] = r["doc_id"]
    assert all(math.isclose(sum(x * x for x in v), 1, abs_tol=1e-5) for i, v in held.items() if docs[i]) and best == {i: i for i in docs if docs[i]}
    found = catalog.queries()["embedded_search"](spark, SF)
    n = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert found.count() == n * 10 and found.where("query_id < 0").isEmpty()
    docs, asked = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = docs.select("doc_id", embed("text").alias("v")).collect()
    matrix = np.array([r["v"] for r in rows], float)
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    for r in asked.select("item_id", embed(models.prefixed(F.col("text"))).alias("q")).collect():
        q = np.array(r["q"], float)
        norms = np.linalg.norm(matrix, axis=1) * np.linalg.norm(q)
        best = sorted((matrix @ q)[norms > 0] / norms[norms > 0], reverse=True)[:10]
        assert [out[r["item_id"]][i + 1] for i in range(10)] == pytest.approx(best, abs=2e-6)
    asked = spark.createDataFrame([("q", "p")], "q string, p string")
    assert asked.select(models.prefixed(F.col("q"))).first()[0] == models.QUERY_PREFIX + "q"
    assert asked.select(models.reranker(lambda pairs: [len(p) for p in pairs])("q", "p")).first()[0] == 2


def test_names_and_plans(spark):
    rows = spark.createDataFrame([("My App", "faq", "markdown"), ("A", "user_manual", "pdf")], "p string, t string, k string")
    assert [r[0] for r in rows.select(generation.export_name(F.col("p"), F.col("t"), F.col("k"))).collect()] == ["My_App_faq.md", None]
    asked = spark.createDataFrame([(1, "A", "user_manual"), (2, "B", "faq"), (3, "C", "faq")], "query_id int, product string, doc_type string")
    similar = spark.createDataFrame([(3, "found")], "query_id int, source string")
    out = {r["query_id"]: r for r in generation.plan(asked, similar).collect()}
    assert [len(out[i]["sections"]) for i in (1, 2, 3)] == [6, 0, 0] and [s["pos"] for s in out[1]["sections"]] == list(range(6))
    assert [out[i]["template_source"] for i in (1, 2, 3)] == ["内置模板: user_manual", None, "found"] and out[2]["title"] == "B faq"


def test_metrics_of_searches_without_results(spark):
    none = spark.createDataFrame([], "query_id long, source string, score double, vector_score double, bm25_score double")
    row = telemetry.search_metrics(none, spark.createDataFrame([(1,)], "query_id long")).first()
    assert list(row) == [1, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_a_reset_stream_reads_again(spark, tmp_path):
    catalog._log(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).write.json(f"file://{tmp_path}/in")
    state = f"file://{tmp_path}/state"

    def run(out: str) -> int:
        streams.run_once(streams.class_counts(streams.read_log(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/{out}", state, "complete")
        return spark.read.parquet(f"file://{tmp_path}/{out}").agg(F.sum("n")).first()[0]

    n = run("a")
    assert n > 0 and streams.reset(spark, state) and run("b") == n and not streams.reset(spark, f"{state}-none")

"""Every query against its SQL on the smallest tables, and those without SQL against plain loops."""

import hashlib
import json
import math
import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docloom.functions import models
from docloom.functions import text as T
from docloom.operators import chunking, generation, quality, ranges, search, tables, telemetry, terms
from docloom.plans import catalog
from docloom.sources import readers
from docloom.streaming import telemetry as streams

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rounded(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    expected = duck.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in out.collect()), key=repr)
    assert got == sorted((tuple(rounded(r[i]) for i in at) for r in expected.fetchall()), key=repr)


def test_whole_query_sets_are_searched(spark):
    ids = {r[0] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    out = QUERIES["vector_topk"](spark, "/root/testdata/sf0.1")
    assert len(ids) > 20 and {r[0]: r[1] for r in out.groupBy("query_id").count().collect()} == dict.fromkeys(ids, 10)
    passages = {r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
    assert {r["query_id"] for r in QUERIES["rrf_fusion"](spark, SF).collect()} >= passages


def test_nearest_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 7)
    monkeypatch.setattr(search, "BLOCK", 3)
    held = {i: [float(i % 5 + 1), float(i % 3), 1.0, -float(i % 7)] for i in range(60)}
    rows = spark.createDataFrame([*held.items(), (60, None)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = {}
    for r in search.nearest(rows, asked, 10).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)

    for q in range(0, 60, 5):
        best = sorted((-cosine(held[q], v), d) for d, v in held.items() if d != q)[:10]
        assert sorted(out[q]) == [(n + 1, d, -s) for n, (s, d) in enumerate(best)]


def test_an_index_equals_a_search_of_the_texts(spark, tmp_path):
    texts = ["Python 是一种编程语言", "机器学习是人工智能的分支", "深度学习使用神经网络", "python python and 编程", "", None, "of no use " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Python 编程"), (2, "学习"), (3, "nothing"), (4, "")], "query_id long, text string")

    def rows(df):
        return sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))

    index = search.Index(spark, f"file://{tmp_path}/index")
    index.add(docs.where("doc_id < 4"), "a")
    index.add(docs.where("doc_id >= 4"), "b")
    index.add(docs.where("doc_id >= 4"), "b")  # a load that is run again
    assert rows(index.search(asked)) == rows(search.bm25(docs, asked)) and next(r[1] for r in rows(index.search(asked)) if r[0] == r[3] == 1) == 3
    keep = docs.where("doc_id <> 3")
    assert rows(index.search(asked, 10, keep)) == rows(search.bm25(docs, asked, 10, F.col("doc_id") != 3))
    index.delete(docs.where("doc_id = 3"))
    assert rows(index.search(asked)) == rows(search.bm25(keep, asked))


def test_running_sums_equal_a_plain_loop(spark):
    values = [(i * 7919) % 100 for i in range(500)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    out = {r["id"]: (r["n"], r["s"]) for r in ranges.running(table, ["v", "id"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    order, total = sorted(range(500), key=lambda i: (values[i], i)), 0
    for n, i in enumerate(order):
        total += values[i]
        assert out[i] == (n + 1, total)
    assert telemetry.floor_percentiles(table, "v").first().asDict() == {f"p{p}": sorted(values)[min(500 * p // 100, 499)] for p in (50, 90, 99)}
    assert ranges.running(table.limit(0), ["v"], {"n": F.lit(1)}).count() == 0 and telemetry.floor_percentiles(table.limit(0), "v").first()["p50"] is None


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_places_in_groups_equal_a_plain_loop(spark, threshold):
    values = [("all" if i % 3 else None if i % 2 else str(i % 50), (i * 7919) % 1000 if i % 100 else None, i) for i in range(1000)]
    table = spark.createDataFrame(values, "g string, v long, id long").repartition(8)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:  # else so few rows are one range
        for k, v in zip(kept, ("false", threshold)):
            spark.conf.set(k, v)
        out = {r["id"]: r["n"] for r in ranges.numbered(table, "g", [F.col("v").asc_nulls_last(), "id"], "n").collect()}
        assert ranges.numbered(table.limit(0), "g", ["id"], "n").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    seen, expected = {}, {}
    for g, _, i in sorted(values, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        expected[i] = seen.get(g, 0)
        seen[g] = expected[i] + 1
    assert out == expected


def test_row_chunks_of_a_large_table_fit_a_small_heap(tmp_path):
    """One brand holds nearly all parts, so rows that each carry their whole table don't fit."""
    duck = duckdb.connect()
    brand = "CASE WHEN k % 1000 = 1 THEN NULL WHEN k % 100 = 2 THEN 'few' ELSE 'many' END"
    duck.sql(f"COPY (SELECT (k * 7919) % 6000 p_partkey, 'name ' || k p_name, {brand} p_brand, 'TYPE' p_type, (k % 50)::INT p_size FROM range(6000) r(k)) TO '{tmp_path}/part.parquet'")
    code = f"""
from pyspark.sql import SparkSession
from docloom.plans import catalog
conf = {{"spark.driver.memory": "600m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
catalog.queries()["row_chunks"](spark, "{tmp_path}").write.parquet("{tmp_path}/out")
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_", "_PYSPARK"))} | {"PYTHONPATH": os.path.dirname(__spark_entry__.__file__)}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=tmp_path, env=env)
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = duck.sql(f"SELECT table_id, i, chunk_id, content FROM '{tmp_path}/out/*.parquet'").fetchall()
    assert len(got) == 6000 and sorted(got, key=repr) == sorted(duck.sql(f"SELECT table_id, i, chunk_id, content FROM ({ORACLES['row_chunks']})").fetchall(), key=repr)


def test_records_of_ragged_tables(spark):
    raw = [(1, [["a", "a", ""], ["1", "2"], ["3", "4", "5", "6"], []]), (2, [["x"]]), (3, [["x", "y"], [None, "1"]])]
    out = {r[0]: json.loads(r[1]) for r in spark.createDataFrame(raw, "id int, raw array<array<string>>").select("id", tables.records(F.col("raw"))).collect()}
    assert out == {1: [{"a": "2"}, {"a": "4", "列3": "5"}, {}], 2: [], 3: [{"x": None, "y": "1"}]}


def test_the_first_named_product_counts(spark):
    prompts = {"产品：Foo with 'Bar'": "Foo", "\"Bar\" 产品: Foo": "Bar", "none": "Product", "it's '": "s "}
    out = spark.createDataFrame([(p,) for p in prompts], "p string").select("p", generation.product(F.col("p"))).collect()
    assert {r[0]: r[1] for r in out} == prompts


def test_a_repeated_batch_writes_its_rows_once(spark, tmp_path):
    catalog._log(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).write.json(f"file://{tmp_path}/in")
    first = streams.run_once(streams.slow(streams.read_log(spark, f"file://{tmp_path}/in", 1)), f"file://{tmp_path}/out", f"file://{tmp_path}/state").count()
    again = streams.run_once(streams.slow(streams.read_log(spark, f"file://{tmp_path}/in", 1)), f"file://{tmp_path}/out", f"file://{tmp_path}/new").count()
    assert first == again > 0


def test_slots_for_models(spark):
    rows = spark.createDataFrame([("a b", "ctx"), ("a b", None), (None, "x" * 600)], "q string, c string")
    out = rows.select(models.embedder(size=8)("q").alias("v"), models.generator()("q", "c").alias("a"), models.embedder(lambda ts: [[float(len(t or ""))] for t in ts])("q").alias("own")).collect()
    assert list(out[0]["v"]) == list(out[1]["v"]) and len(out[0]["v"]) == 8 and [r["a"] for r in out] == ["ctx", "", "x" * 500] and [r["own"][0] for r in out] == [3.0, 3.0, 0.0]


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF one")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF two")
    (tmp_path / "c.txt").write_bytes(b"no")
    assert sorted(bytes(r["content"]) for r in readers.files(spark, f"file://{tmp_path}").collect()) == [b"%PDF one", b"%PDF two"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def count(text):
    return len(re.findall(r"[一-鿿]|[a-z0-9_\-.]+", text.lower()))


def packed(items, size, overlap, glue):
    done, cur = [], []
    for t in items:
        n = count(t)
        if t.startswith("```") or (t.startswith("|") and "---" in t):
            done += [glue.join(cur)] if cur else []
            done.append(t)
            cur = []
            continue
        if cur and sum(map(count, cur)) + n > size:
            done.append(glue.join(cur))
            tail, total = [], 0
            for x in reversed(cur):
                if total + count(x) > overlap:
                    break
                tail, total = [x, *tail], total + count(x)
            cur = tail
        cur.append(t)
    return done + ([glue.join(cur)] if cur else [])


def test_packing_equals_a_plain_loop(spark):
    rows = [["a b c", "d e", "f g h i", "```\nx\n```", "j", "k l m n o p q r s"], [], ["one"], ["w " * n for n in (3, 1, 4, 1, 5, 9, 2, 6)]]
    rows = [[t.strip() for t in r] for r in rows]
    out = spark.createDataFrame([(r,) for r in rows], "items array<string>").select(chunking.pack(F.col("items"), 6, 2, " ").alias("p")).collect()
    assert [list(r["p"]) for r in out] == [packed(r, 6, 2, " ") for r in rows]


def test_children_have_parents(spark):
    up = {r["chunk_id"] for r in QUERIES["parent_chunks"](spark, SF).collect()}
    assert all(r["parent_id"] in up for r in QUERIES["child_chunks"](spark, SF).collect())


def test_all_children_are_expanded(spark):
    up = {r["chunk_id"]: r["content"] for r in QUERIES["parent_chunks"](spark, SF).collect()}
    expected = [(r["chunk_id"], r["parent_index"], hashlib.md5(up[r["parent_id"]].encode()).hexdigest()) for r in QUERIES["child_chunks"](spark, SF).collect()]
    out = [tuple(r[c] for c in ("chunk_id", "parent_index", "context_md5")) for r in QUERIES["parent_expand"](spark, SF).collect()]
    assert sorted(out) == sorted(expected) and any(r["child_index"] for r in QUERIES["child_chunks"](spark, SF).collect())


def test_keywords_of_mixed_scripts_equal_python(spark):
    texts = ["É API中文 API 中", "fooBar naïveBar größeÄnderung éfooBar", "snake_case_é a_b", "v1.2.3-béta ٣.٤ 1.2", "0xFFé 0xAB ERROR_Größe ERR_X", "/pfad/größe --größe -x 数据/库", "plain", ""]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(T.keywords(F.col("t"))).collect()
    assert [list(r[0]) for r in out] == [sorted({m[0] for p in T.KEYWORD for m in re.finditer(p, t)}) for t in texts]


def test_hourly_stream_equals_batch(spark):
    batch = {(r["h"], r["n"]) for r in catalog._log(lambda t: spark.read.parquet(f"{SF}/{t}.parquet")).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    stream = {(r["hour"], r["n"]) for r in QUERIES["stream_hourly_window"](spark, SF).collect()}
    assert stream <= batch and len(batch - stream) <= 2  # the last hours stay open


def test_detection_equals_a_plain_search(spark):
    texts = ["use the api, the API and DB", "用户界面 UI", ""]
    found = {(r["doc_id"], r["variant"], r["position"]) for r in terms.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    expected = {(i, m[0], m.start()) for i, t in enumerate(texts) for a, _ in terms.glossary() for m in re.finditer(rf"\b{re.escape(a)}\b", t, re.IGNORECASE)}
    assert found == expected


DOCUMENTS = [(1, "Cli first, then a cli; 端口: 80\n端口: 81"), (2, "the UI\n```\nx\n```\n    y"), (3, "plain, 8 GB or 16 GB, ünder, api"), (4, ""), (5, "DB " * 50 + "Db")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The folder of a table of documents, and its rows with those that are made by hand."""
    folder = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def with_made(texts):
    return DOCUMENTS + [(-i - 1, t) for i, t in enumerate(texts)]


def test_variants_and_normal_forms_of_documents(spark, written):
    rows, forms, normal = with_made(catalog._GLOSSED), {}, {}
    for i, t in rows:
        for a, term in terms.glossary():
            for m in re.finditer(rf"\b{re.escape(a)}\b", t, re.IGNORECASE):
                forms.setdefault(term, set()).add(m[0])
        for a, term in terms.glossary():
            t = re.sub(rf"\b{re.escape(a)}\b", term, t, flags=re.IGNORECASE)
        normal[i] = t
    out = {r["term"]: r["variants"] for r in QUERIES["term_variants"](spark, written).collect()}
    assert out == {t: sorted(f) for t, f in forms.items() if len(f) > 1} and out["Command Line Interface"] == ["CLI", "Cli", "cli"]
    assert {r["doc_id"]: r["standard"] for r in QUERIES["glossary_normalize_documents"](spark, written).collect()} == normal


def test_consistency_of_documents(spark, written):
    rows, values = with_made([t for _, t in catalog._SECTIONS]), {}
    for i, t in rows:
        for c, p in quality.CONTRADICTIONS.items():
            for m in re.finditer(p, t, re.ASCII):
                values.setdefault((i, c), set()).add(m[1])
    out = {(r["doc_id"], r["category"]): (r["n_values"], r["least"], r["greatest"]) for r in QUERIES["contradictions_documents"](spark, written).collect()}
    assert out == {k: (len(v), min(v), max(v)) for k, v in values.items() if len(v) > 1} and {(1, "端口号"), (3, "数值参数")} <= set(out)
    mixed = {r["doc_id"]: r["mixed"] for r in QUERIES["code_style_mix_documents"](spark, written).collect()}
    assert mixed == {i: "```" in t and re.search(r"(?m)^    \S", t) is not None for i, t in rows} and mixed[2]


def test_simple_expansion(spark):
    out = {r["q"]: r["variants"].split(" / ") for r in QUERIES["simple_expand"](spark, SF).collect()}
    assert out["API 配置"] == ["API 配置", "Application Programming Interface 配置", "API 设置", "API 参数"]
    assert out["plain words"] == ["plain words"]
    words = {r["q"]: r["variants"].split(" / ") for r in QUERIES["query_expand"](spark, SF).collect()}
    assert words["API认证 ok"] == ["API认证 ok"] and "HyperText Transfer Protocol server" in words["http server"]

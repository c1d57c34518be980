"""Queries of the catalog over images, stores' filters and files, plans of documents, and slots for learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import models
from docloom.operators import generation, images, metadata, search, telemetry, terms
from docloom.plans import catalog as C
from docloom.plans.catalog import query
from docloom.sources import readers
from docloom.sources.shared import shared_folder

# ---- images; vectors, documents and pages stand for them ---------------------------------------------------------------

_KIND = {images.DESCRIPTION: 0, images.PICTURE: 1}


@query(" UNION ALL ".join(f"SELECT s.query_id, s.doc_id // 2 image_id, '{kind}' AS type, s.score, s.rank::INT rank, e.label FROM ({C._cos(f'd.vec_id % 2 = {n}', 5)}) s JOIN embeddings e ON e.vec_id = s.doc_id" for kind, n in _KIND.items()))
def image_search(read, spark):
    """The images nearest to every query vector, by their descriptions (even vectors) and by their pictures (odd ones)."""
    rows = read("embeddings").withColumn("type", F.when(F.col("vec_id") % 2 == 0, images.DESCRIPTION).otherwise(images.PICTURE))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = images.nearest(rows, asked, images.DESCRIPTION).union(images.nearest(rows, asked, images.PICTURE))
    named = found.join(rows.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return named.select("query_id", F.expr("doc_id div 2").alias("image_id"), "type", "score", "rank", "label")


_IMAGE_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {C._text(w)})' for w in words)} THEN '{kind}'" for kind, words in generation.IMAGES.items()) + " ELSE 'unknown' END"


@query(f"SELECT 'img_' || doc_id chunk_id, length(text) chars, 'image' AS content_type, {_IMAGE_KIND} image_type, source FROM documents WHERE coalesce(text, '') <> ''")
def image_chunks(read, spark):
    """Documents as descriptions of images; those without one give no chunk."""
    rows = read("documents").select(F.col("doc_id").alias("image_id"), F.col("text").alias("description"), "source")
    return images.chunks(rows).select("chunk_id", F.length("content").cast("long").alias("chars"), "content_type", "metadata.image_type", "metadata.source")


@query(r"""WITH p AS (SELECT page_id, page_id % 9 + 1 AS page, regexp_extract(html, '<title>([^<]*)</title>', 1) caption, html FROM pages WHERE html IS NOT NULL)
SELECT page_id, CASE WHEN caption <> '' AND page < 5 THEN caption ELSE '[Image on page ' || page || ']' END AS text, substring(base64(encode(html)), 1, 100) || '...' image_data, caption <> '' AND page < 5 has_caption FROM p""")
def image_elements(read, spark):
    """Pages as images; some have a caption."""
    page = F.col("page_id") % 9 + 1
    caption = F.when(page < 5, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    rows = read("pages").select("page_id", page.alias("page"), caption.alias("caption"), F.encode("html", "UTF-8").alias("content"))
    return images.elements(rows).select("page_id", "text", "image_data", "has_caption")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) n FROM embeddings) SELECT vec_id, round(v[1] / n, 6) head, round(v[len(v)] / n, 6) tail FROM v WHERE n > 0")
def unit_vectors(read, spark):
    """The ends of every vector scaled to length 1."""
    rows = read("embeddings").select("vec_id", images.unit(F.col("embedding")).alias("u")).where("u is not null")
    return rows.select("vec_id", F.round(F.element_at("u", 1), 6).alias("head"), F.round(F.element_at("u", -1), 6).alias("tail"))


# ---- stores ------------------------------------------------------------------------------------------------------------

_FILTERS = {"o_orderstatus": ["O", "F"], "o_orderpriority": "1-URGENT", "o_custkey": 7}
_FILTERED = "o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT'"


@query(f"SELECT 'vector' store, o_orderkey FROM orders WHERE {_FILTERED} UNION ALL SELECT 'text', o_orderkey FROM orders WHERE {_FILTERED} AND o_custkey = 7")
def store_filters(read, spark):
    """One filter in the languages of two stores; the first passes over numbers."""
    rows = read("orders")
    each = (("vector", metadata.vector_condition(_FILTERS)), ("text", metadata.term_condition(_FILTERS)))
    found = [rows.where(c).select(F.lit(name).alias("store"), "o_orderkey") for name, c in each]
    return found[0].union(found[1])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 10) ELSE source END title, lang author, '' subject, '' mod_date, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE '5' END total_pages, 8 + 1 AS n_keys FROM documents")
def file_metadata(read, spark):
    """Documents as files with a title and an author; every second has keys of its own, which win."""
    found = F.create_map(F.lit("title"), "source", F.lit("author"), "lang", F.lit("format"), F.lit("PDF"))
    own = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("title"), F.substring("text", 1, 10), F.lit("total_pages"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = read("documents").select("doc_id", metadata.file_metadata(found, F.lit(5), own).alias("m"))
    return rows.select("doc_id", *[F.col("m")[k].alias(k) for k in ("title", "author", "subject", "mod_date", "total_pages")], F.size("m").alias("n_keys"))


@query(f"{C._CHUNKS} SELECT doc_id, parent_index, chunk_id, tokens, content FROM up")
def chunks_json(read, spark):
    """Parent chunks written as JSON and read again."""
    path = shared_folder(spark, "chunks")
    readers.write_rows(C._chunks(read)[0].select("doc_id", "parent_index", "chunk_id", "tokens", "content"), path)
    return readers.read_rows(spark, path, "doc_id long, parent_index int, chunk_id string, tokens int, content string")


@query(f"WITH d AS {C._values([(i, *row) for i, row in enumerate(terms.DICTIONARY)], 'seq, term, canonical, aliases, abbreviations, related, domain')} SELECT term, canonical, aliases, abbreviations, related, domain FROM d QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY seq DESC) = 1")
def dictionary_export(read, spark):
    """The dictionary written and read again."""
    path = shared_folder(spark, "dictionary")
    terms.export(terms.dictionary(spark), path)
    return terms.load(spark, path)


_FORMS = {a.lower(): t for t, aliases in terms.GLOSSARY for a in [t, *aliases]}


@query(f"WITH w AS (SELECT DISTINCT word FROM (SELECT n_name word FROM nation UNION ALL SELECT 'Api' UNION ALL SELECT 'DATABASE' UNION ALL SELECT '界面' UNION ALL SELECT unnest(string_split(text, ' ')) FROM benchmark)) SELECT word, term FROM w LEFT JOIN {C._values(sorted(_FORMS.items()), 'form, term')} g ON lower(word) = form")
def standard_terms(read, spark):
    """The glossary's terms of the nations' names, of some words, and of the words of all benchmark passages."""
    made = spark.createDataFrame([("Api",), ("DATABASE",), ("界面",)], "word string")
    words = read("benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return terms.standard(read("nation").select(F.col("n_name").alias("word")).union(made).union(words).distinct())


# ---- telemetry ---------------------------------------------------------------------------------------------------------


def _found(*sources: str) -> str:
    return f"count(*) FILTER (source IN ({', '.join(map(C._text, sources))}))"


def _mean(c: str, where: str) -> str:
    """The mean of values of eight places, in whole numbers, as ties must be rounded up."""
    total, n = f"sum(round({c} * 100000000)::BIGINT) FILTER ({where})", f"count(*) FILTER ({where})"
    return f"coalesce((2 * {total} + 100 * {n}) // (200 * {n}) / 1000000, 0)"


@query(f"""{C._LISTS}, r AS (SELECT query_id, source, round(coalesce(0.6 / (60 + rv), 0) + coalesce(0.4 / (60 + rb), 0), 8) score, vs, bs FROM bo)
SELECT item_id query_id, count(source) num_results, {_found('vector', 'both')} num_vector_hits, {_found('bm25', 'both')} num_bm25_hits, {_found('both')} num_both_hits,
{', '.join(f"round(coalesce({f}(score), 0), 6) {f}_score" for f in ('max', 'min'))}, {', '.join(_mean(a, f'{a} > 0') + f' avg_{b}_score' for a, b in (('vs', 'vector'), ('bs', 'bm25')))}, {_mean('score', 'score IS NOT NULL')} avg_score FROM benchmark LEFT JOIN r ON item_id = query_id GROUP BY item_id""")
def search_metrics(read, spark):
    """The whole log row of each fused search."""
    results = search.rrf(*C._two_lists(read), parts=("vector_score", "bm25_score"))
    return telemetry.search_metrics(results, read("benchmark").select(F.col("item_id").alias("query_id")))


@query(f"WITH {C._LOG}, d AS (SELECT ts::DATE AS day, count(*) FILTER (num_results = 0) zero, count(*) total FROM lo GROUP BY 1) SELECT day, 'High zero-result rate: ' || printf('%.2f', zero / total * 100) || '% (' || zero || '/' || total || ')' AS message FROM d WHERE zero > 0.1 * total")
def zero_messages(read, spark):
    """The alert of each day on which more than a tenth of the searches find nothing."""
    days = C._log(read).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("num_results") == 0).alias("zero"), F.count(F.lit(1)).alias("total"))
    return days.where(F.col("zero") > telemetry.ZERO_RATE * F.col("total")).select("day", telemetry.zero_message(F.col("zero"), F.col("total")).alias("message"))


# ---- plans of documents ------------------------------------------------------------------------------------------------

_TYPES = list(generation.TYPE_NAMES)
_KINDS = [*generation.ENDINGS, "pdf"]


@query(f"SELECT c_custkey, replace(c_name || '_' || {C._values([(t,) for t in _TYPES], 'x').replace('SELECT *', 'SELECT list(x)')}[c_custkey % 7 + 1], ' ', '_') || CASE c_custkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.docx' WHEN 2 THEN '.html' END AS name FROM customer")
def export_names(read, spark):
    """Names of files for documents about every customer, in known and unknown formats."""
    doc_type = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("c_custkey") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read("customer").select("c_custkey", generation.export_name(F.col("c_name"), doc_type, kind).alias("name"))


_PLANNED = f"""WITH {C._BM25}, ty AS {C._values([(i, t, generation.TYPE_NAMES[t], len(generation.TEMPLATES.get(t, []))) for i, t in enumerate(_TYPES)], 'i, doc_type, named, n')},
si AS (SELECT query_id, arg_min(source, rank) source FROM bm JOIN documents d USING (doc_id) WHERE d.doc_id % 7 = query_id % 7 GROUP BY 1)"""


@query(f"{_PLANNED} SELECT item_id query_id, 'P' || item_id || ' ' || named title, doc_type, n::INT n_sections, coalesce(source, CASE WHEN n > 0 THEN '内置模板: ' || doc_type END) template_source FROM benchmark JOIN ty ON item_id % 7 = i LEFT JOIN si ON si.query_id = item_id")
def doc_plan(read, spark):
    """A plan for every passage as a product; the best document found that is of its type is the source of its structure."""
    doc_type = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("item_id") % 7 + 1).cast("int"))
    asked = read("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("P"), F.col("item_id").cast("string")).alias("product"), doc_type.alias("doc_type"))
    hits = C._search(read, 20).where("doc_id % 7 = query_id % 7").groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    similar = hits.join(read("documents").select("doc_id", "source"), "doc_id")
    return generation.plan(asked, similar).select("query_id", "title", "doc_type", F.size("sections").alias("n_sections"), "template_source")


# ---- slots of learned models, with their stand-ins ---------------------------------------------------------------------


@query(f"{C._CHUNKS} SELECT doc_id, parent_id, chunk_id, 64 AS size FROM down")
def chunk_vectors(read, spark):
    """Every child chunk with its vector, met by its id."""
    down = C._chunks(read)[1]
    vectors = down.select("chunk_id", models.embedder()(F.col("content")).alias("embedding"))
    return down.join(vectors, "chunk_id").select("doc_id", "parent_id", "chunk_id", F.size("embedding").alias("size"))


@query()
def embedded_search(read, spark):
    """Documents whose stand-in vectors are nearest to those of the passages, asked with the model's prefix."""
    embed = models.embedder()
    rows = read("documents").select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding"))
    # a row is no neighbour of its own id, so queries are numbered apart
    asked = read("benchmark").select((-F.col("item_id") - 1).alias("query_id"), embed(models.prefixed(F.col("text"))).alias("q"))
    return search.nearest(rows, asked, 10).select((-F.col("query_id") - 1).alias("query_id"), "doc_id", "score", "rank")


@query(rf"""WITH {C._BM25}, x AS (SELECT bm.query_id, doc_id, score, list_distinct(regexp_extract_all(lower(b.text), '\S+')) q, list_distinct(regexp_extract_all(lower(d.text), '\S+')) t FROM bm JOIN benchmark b ON item_id = bm.query_id JOIN documents d USING (doc_id)),
y AS (SELECT query_id, doc_id, score, round(len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))), 6) rerank_score FROM x) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id)::INT AS rank FROM y QUALIFY rank <= 5""")
def neural_rerank(read, spark):
    """Hits of a word search in the order of a model's scores of (query, passage)."""
    texts = read("documents").select("doc_id", F.col("text").alias("passage"))
    rows = C._search(read, 20).join(texts, "doc_id").join(C._asked(read), "query_id")
    scored = rows.select("query_id", "doc_id", "score", F.round(models.reranker()(F.col("text"), F.col("passage")), 6).alias("rerank_score"))
    return search.best(scored, 5, "rerank_score").select("query_id", "doc_id", "score", "rerank_score", "rank")


@query()
def query_transform(read, spark):
    """Queries with their variants by the dictionary and by rules, which stand for a model's, and a supposed answer."""
    asked = spark.createDataFrame([(q,) for q in C._ASKS], "q string").union(C._asked(read).select("text"))
    return terms.transformed(asked, terms.dictionary(spark), terms.simple_expand, lambda q: models.generator()(q, q))

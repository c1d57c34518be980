"""Further queries of the catalog: hybrid search of variants, sections, chunk tables, full reports, glossaries, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, generation, metadata, search, tables, telemetry, terms
from docloom.plans import catalog as C
from docloom.plans.catalog import query
from docloom.sources import readers

# ---- hybrid search of variants -----------------------------------------------------------------------------------------

# each variant is searched in both indexes; the vector list of a passage is that of the vector of its number
_HYBRID = f"""WITH {C._VARIANTS}, vv AS (SELECT query_id * 10 + v query_id, doc_id, rank rv FROM ({C._cos(k=20)}), (VALUES (0), (1), (2)) x(v)),
fu AS (SELECT coalesce(b.query_id, v.query_id) query_id, doc_id, round(coalesce(0.6 / (60 + rv), 0) + coalesce(0.4 / (60 + rank), 0), 8) score FROM bm b FULL JOIN vv v USING (query_id, doc_id)),
pv AS (SELECT query_id // 10 query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM fu),
su AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 8) score, count(*) hits, max(score) best_score FROM pv WHERE rank <= 10 GROUP BY ALL)"""


@query(f"{_HYBRID} SELECT query_id, doc_id, score, hits, best_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM su QUALIFY rank <= 10")
def hybrid_multi_query(read, spark):
    """A hybrid search of every variant of every query, all in one plan, then fused over the variants."""
    asked = C.variant_queries(read)
    words = search.index_of(read("documents")).search(asked, 20)
    vectors = C._vectors(read, 20).withColumn("v", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    vectors = vectors.select((F.col("query_id") * 10 + F.col("v")).alias("query_id"), "doc_id", "score", "rank")
    each = search.best(search.rrf(vectors, words), 10)
    parts = each.select(F.expr("query_id div 10").alias("query_id"), (F.col("query_id") % 10).alias("variant"), "doc_id", "score", "rank")
    return search.best(search.multi_rrf(parts), 10)


@query(f"WITH {C._BM25} SELECT (SELECT n FROM tot) documents, count(DISTINCT term) terms, sum(tf)::BIGINT words FROM post")
def index_build(read, spark):
    """What the written index of the documents holds."""
    stats = search.index_of(read("documents")).stats()
    return stats.agg(F.max(F.when(F.col("term").isNull(), F.col("df"))).alias("documents"), F.count("term").alias("terms"), F.max(F.when(F.col("term").isNull(), F.col("words"))).alias("words"))


@query(f"{C._LISTS}, {C._RRF}, c AS (SELECT query_id, count(*) num_results, max(score) top FROM rrf GROUP BY 1) SELECT count(*) searches, round(avg(num_results), 6) avg_results, round(avg(top), 6) avg_top, count(*) FILTER (num_results < 3) low_recall FROM c")
def monitored_search(read, spark):
    """Averages over the log rows of all fused searches."""
    r = search.rrf(*C._two_lists(read)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    return r.agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("n"), 6).alias("avg_results"), F.round(F.avg("top"), 6).alias("avg_top"), F.count_if(F.col("n") < telemetry.LOW_RECALL).alias("low_recall"))


@query(f"WITH r AS ({C._cos(k=10)}), x AS (SELECT r.query_id, r.rank, a.label = b.label hit FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id), n AS (SELECT label, count(*) - 1 n FROM embeddings GROUP BY label), q AS (SELECT query_id, coalesce(1 / min(rank) FILTER (hit), 0) rr, count(*) FILTER (hit) found FROM x GROUP BY 1) SELECT round(avg(rr), 6) mrr, round(avg(found / n.n), 6) recall_at_10 FROM q JOIN embeddings e ON e.vec_id = query_id JOIN n ON n.label = e.label WHERE n.n > 0")
def rank_quality(read, spark):
    """Mean reciprocal rank and recall at 10, vectors of the query's label being relevant."""
    labels = read("embeddings").select("vec_id", "label")
    found = C._vectors(read, 10).join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other")), "doc_id")
    hit = F.col("label") == F.col("other")
    each = found.groupBy("query_id", "label").agg(F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"), F.count_if(hit).alias("found"))
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    return each.join(sizes, "label").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("found") / F.col("n")), 6).alias("recall_at_10"))


# ---- sections ----------------------------------------------------------------------------------------------------------

_PAGE = r"""WITH e AS (SELECT page_id, regexp_extract_all(html, '(?is)(<(?:h1|h2|h3|p|li)(?:\s[^>]*)?>.*?</(?:h1|h2|h3|p|li)>)', 1) f FROM pages), r AS (SELECT page_id, unnest(range(len(f)))::INT pos, unnest(f) raw FROM e),
h AS (SELECT page_id, pos, lower(regexp_extract(raw, '^<([A-Za-z0-9]+)', 1)) tag, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS content FROM r),
k AS (SELECT *, pos // 5 + 1 AS page, starts_with(tag, 'h') heads, max(CASE WHEN starts_with(tag, 'h') THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) hp FROM h),
s AS (SELECT k.*, coalesce(hp, -1)::INT heading_pos, coalesce(t.content, 'Introduction') section_title FROM k LEFT JOIN (SELECT page_id, pos, content FROM h) t ON t.page_id = k.page_id AND t.pos = k.hp)"""


def _elements(read) -> DataFrame:
    """Elements of web pages; five make a page."""
    heads = F.col("tag").startswith("h")
    return readers.html_elements(read("pages")).select(F.col("page_id").alias("doc_id"), "pos", (F.floor(F.col("pos") / 5) + 1).cast("int").alias("page"), F.when(heads, "heading").otherwise("paragraph").alias("kind"), F.when(heads, F.substring("tag", 2, 1).cast("int")).otherwise(0).alias("level"), F.col("text").alias("content"))


@query(f"{_PAGE} SELECT page_id AS doc_id, pos, heading_pos, section_title, NOT heads AS in_section FROM s")
def section_members(read, spark):
    """The section of every element; what stands before the first heading is the introduction."""
    return chunking.with_introduction(_elements(read)).select("doc_id", "pos", "heading_pos", "section_title", "in_section")


@query(f"{_PAGE} SELECT page_id AS doc_id, heading_pos, section_title, min(page)::INT page_start, count(*) FILTER (NOT heads) n_elements, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY pos) FILTER (NOT heads), '') AS content FROM s GROUP BY ALL")
def section_text(read, spark):
    return chunking.section_text(_elements(read))


_HEADED = [(1, "第三章 总则"), (2, "第2节 范围"), (3, "1.2.3.4 Deep"), (4, "1.2.3 Mid"), (5, "1.2 Upper"), (6, "3. Top"), (7, "附录 B"), (8, "plain"), (9, "  2.1 padded ")]


@query(rf"""WITH {C._LINES}, t AS (SELECT doc_id, pos, trim(text, ' ') t FROM el UNION ALL SELECT -id, 0, trim(txt, ' ') FROM {C._values(_HEADED, 'id, txt')})
SELECT doc_id, pos, CASE WHEN regexp_matches(t, '^第[一二三四五六七八九十\d]+章') THEN 1 WHEN regexp_matches(t, '^第[一二三四五六七八九十\d]+节') THEN 2 WHEN regexp_matches(t, '^\d+\.\d+\.\d+\.\d+\s+') THEN 4 WHEN regexp_matches(t, '^\d+\.\d+\.\d+\s+') THEN 3
WHEN regexp_matches(t, '^\d+\.\d+\s+') THEN 2 WHEN regexp_matches(t, '^\d+\.\s+') THEN 1 WHEN regexp_matches(t, '^附录\s*[A-Z]?') THEN 1 ELSE 0 END AS level FROM t""")
def text_levels(read, spark):
    """Heading levels by text alone, of all lines and of hand-made ones."""
    made = spark.createDataFrame(_HEADED, "id long, text string").select((-F.col("id")).alias("doc_id"), F.lit(0).alias("pos"), "text")
    return readers.line_elements(read("documents")).union(made).select("doc_id", "pos", T.text_level(F.col("text")).alias("level"))


# ---- chunks in tables ----------------------------------------------------------------------------------------------------


@query(f"{C._CHUNKS}, al AS (SELECT doc_id, chunk_id, NULL::VARCHAR AS parent_id, tokens FROM up UNION ALL SELECT doc_id, chunk_id, parent_id, tokens FROM down) SELECT doc_id, count(*) FILTER (parent_id IS NULL) parents, count(*) FILTER (parent_id IS NOT NULL) children, count(*) FILTER (parent_id IS NOT NULL AND parent_id NOT IN (SELECT chunk_id FROM up)) orphans, sum(tokens)::BIGINT tokens FROM al GROUP BY doc_id")
def chunk_info(read, spark):
    """Chunks of both kinds of each document, upserted twice into a table that then holds each once."""
    up, down = C._chunks(read)
    rows = up.select("chunk_id", "doc_id", F.lit(None).cast("string").alias("parent_id"), "tokens").union(down.select("chunk_id", "doc_id", "parent_id", "tokens"))
    return metadata.chunk_info(metadata.upsert(rows, rows, "chunk_id"))


@query(f"{C._CHUNKS} SELECT chunk_id, parent_id, doc_id FROM down")
def chunk_parents(read, spark):
    """The parent of every child chunk."""
    return C._chunks(read)[1].select("chunk_id", "parent_id", "doc_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' ELSE c_mktsegment END segment, TIMESTAMP '2024-01-01' created_at, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END updated_at FROM customer UNION ALL SELECT -1, 'NEW', TIMESTAMP '2024-06-01', TIMESTAMP '2024-06-01'")
def stamped_upsert(read, spark):
    """Rows of known key keep when they were created."""
    old, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-06-01").cast("timestamp")
    table = read("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), old.alias("created_at"), old.alias("updated_at"))
    rows = table.where("c_custkey % 10 = 0").select("c_custkey", F.lit("UPDATED").alias("segment")).union(spark.createDataFrame([(-1, "NEW")], "c_custkey long, segment string"))
    return metadata.stamped(table, rows, "c_custkey", now)


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 7")
def get_document(read, spark):
    return metadata.found(read("documents"), "doc_id", 7).select("doc_id", "source", "lang")


@query("SELECT doc_id, sum(len(text)) AS chars, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 500 AND n_chars < 2000 GROUP BY doc_id")
def range_filter(read, spark):
    """Conditions on several columns, by list and by range."""
    rows = read("documents").where(metadata.condition({"lang": ["de", "fr"], "n_chars": {"$gte": 500, "$lt": 2000}}))
    return rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))


# ---- tables ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {C._TABLE_SQL}, r AS (SELECT table_id, raw[1] h, raw[2:] b FROM tb), p AS (SELECT table_id, h, b, unnest(range((len(b) + 19) // 20))::INT part FROM r)
SELECT table_id, part, '| ' || array_to_string(h, ' | ') || ' |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || array_to_string(list_transform(b[part * 20 + 1 : part * 20 + 20], lambda x: '| ' || array_to_string(x, ' | ') || ' |'), chr(10)) AS content,
'表格共有 ' || (len(b[part * 20 + 1 : part * 20 + 20]) + 1) || ' 行 4 列' AS summary FROM p""")
def table_chunks(read, spark):
    """Slices of 20 rows of long tables under their header, as markdown with a summary."""
    rows = C._raw(read).withColumn("b", F.slice("raw", F.lit(2), F.size("raw") - 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.size("b") / 20).cast("int") - 1)))
    own = F.concat(F.slice("raw", 1, 1), F.slice("b", F.col("part") * 20 + 1, F.lit(20)))
    return rows.select("table_id", "part", own.alias("own")).select("table_id", "part", tables.markdown(F.col("own")).alias("content"), F.concat(F.lit("表格共有 "), F.size("own"), F.lit(" 行 "), F.size(F.col("own")[0]), F.lit(" 列")).alias("summary"))


_RAGGED = [(1, [["a", "b|c"], ["1"], ["2", "x\ny", "3"]]), (2, [["only"]]), (3, [["h", "h"], ["1", "2"], ["3", "4", "5"]])]


@query("WITH t AS (SELECT 1 AS id, [['a', 'b|c'], ['1'], ['2', 'x' || chr(10) || 'y', '3']] raw UNION ALL SELECT 2, [['only']] UNION ALL SELECT 3, [['h', 'h'], ['1', '2'], ['3', '4', '5']]), w AS (SELECT *, list_max(list_transform(raw, lambda r: len(r))) n FROM t), l AS (SELECT *, list_transform(raw, lambda r: '| ' || array_to_string(list_transform(list_resize(r, n, ''), lambda c: trim(replace(replace(c, chr(10), ' '), '|', '\\|'))), ' | ') || ' |') l FROM w) SELECT id, array_to_string(list_concat(l[1:1], ['| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |'], l[2:]), chr(10)) md, list_sort(list_distinct(list_transform(raw, lambda r: len(r)::INT))) counts FROM l")
def ragged_markdown(read, spark):
    """Tables whose rows differ in length, padded to the widest."""
    raw = F.col("raw")
    return spark.createDataFrame(_RAGGED, "id int, raw array<array<string>>").select("id", tables.padded_markdown(raw).alias("md"), tables.column_counts(raw).alias("counts"))


_TITLED = [(1, "x\n表 1: 参数\ny"), (2, "see Table 12. Results of it"), (3, "图表3：流程"), (4, "Table of contents"), (5, "Table 1: a\n表 2. b")]


@query(rf"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -id, txt FROM {C._values(_TITLED, 'id, txt')})
SELECT doc_id, coalesce({', '.join("nullif(trim(regexp_extract(text, '" + p + "', 0), ' '), '')" for p in tables.TITLES)}, '') title FROM t""")
def table_titles(read, spark):
    """Titles of tables in all documents and in hand-made pages."""
    made = spark.createDataFrame(_TITLED, "id long, text string").select((-F.col("id")).alias("doc_id"), "text")
    return read("documents").select("doc_id", "text").union(made).select("doc_id", tables.table_title(F.col("text")).alias("title"))


@query("WITH t(id, html) AS (VALUES (1, '<table><tr><th>a</th><th> b </th></tr><tr><td>1</td><td><b>2</b></td></tr></table>'), (2, '<p>none</p>')), r AS (SELECT id, unnest(regexp_extract_all(html, '(?is)(<tr[^>]*>.*?</tr>)', 1)) r FROM t) SELECT id, array_to_string(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(c, '<[^>]*>', '', 'g'))), ',') cells FROM r UNION ALL SELECT page_id, '' FROM pages WHERE contains(html, '<tr')")
def html_tables(read, spark):
    """Rows of HTML tables of all pages and of hand-made ones."""
    made = spark.createDataFrame([(1, "<table><tr><th>a</th><th> b </th></tr><tr><td>1</td><td><b>2</b></td></tr></table>"), (2, "<p>none</p>")], "id long, html string")
    rows = read("pages").select(F.col("page_id").alias("id"), "html").union(made)
    return rows.select("id", F.explode(readers.html_table_rows(F.col("html"))).alias("r")).select("id", F.array_join("r", ",").alias("cells"))


# ---- telemetry -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {C._LOG}, l AS (SELECT list(latency_ms ORDER BY latency_ms) l, list(num_results ORDER BY num_results) r, count(*) n FROM lo)
SELECT count(*) total, round(avg((num_results = 0)::INT), 6) zero_rate, round(avg(latency_ms), 4) avg_latency, round(avg((num_vector_hits > 0 AND num_bm25_hits > 0)::INT), 6) hybrid_rate, round(avg((num_vector_hits > 0 AND num_bm25_hits = 0)::INT), 6) vector_only_rate, round(avg((num_bm25_hits > 0 AND num_vector_hits = 0)::INT), 6) bm25_only_rate, count(*) FILTER (num_results < 3) low_recall,
round(avg(num_results), 6) avg_results, count(*) FILTER (num_results = 0) zero_results, {", ".join(f"(SELECT {a}[least((n * {p}) // 100, n - 1) + 1] FROM l) {b}_p{p}" for a, b in (("l", "latency"), ("r", "results")) for p in (50, 90, 99))} FROM lo""")
def full_report(read, spark):
    """The report of a period with its counts and percentiles."""
    return telemetry.full_report(C._log(read))


@query(f"WITH {C._LOG} SELECT event_id, num_results FROM lo WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def log_scan(read, spark):
    """The log written by days and read again for two of them."""
    from datetime import date

    from docloom.sources.shared import shared_folder
    from docloom.streaming.telemetry import SCHEMA

    path = shared_folder(spark, "log")
    readers.write_log(C._log(read), path)
    return readers.read_log(spark, path, SCHEMA, date(2024, 1, 10), date(2024, 1, 11)).select("event_id", "num_results")


# ---- terms and documents -----------------------------------------------------------------------------------------------------

_ADDED = [("gRPC", "Remote Procedure Call", ["grpc"], ["gRPC"], ["RPC"], "api"), ("API", "API Gateway", ["api"], [], [], "api")]


@query(f"WITH d AS {C._values([(i, *row) for i, row in enumerate([*terms.DICTIONARY, *sorted(_ADDED)])], 'seq, term, canonical, aliases, abbreviations, related, domain')}, fo AS (SELECT seq, canonical, lower(unnest(list_concat([term, canonical], aliases, abbreviations))) form FROM d) SELECT form, arg_max(canonical, seq) canonical FROM fo GROUP BY form")
def custom_terms(read, spark):
    """The dictionary with further terms, the last of a form counts."""
    added = spark.createDataFrame(_ADDED, "term string, canonical string, aliases array<string>, abbreviations array<string>, related array<string>, domain string")
    return terms.forms(terms.with_terms(terms.dictionary(spark), added))


@query(f"WITH {C._detected(C._GLOSSED)} SELECT doc_id, term, list_sort(list_distinct(list(variant))) variants, count(*) mentions FROM de GROUP BY doc_id, term HAVING count(DISTINCT variant) > 1")
def term_consistency(read, spark):
    """Terms that a document names in more than one way."""
    return terms.consistency(C._with_made(read, spark, C._GLOSSED))


@query(f"WITH g AS {C._values([(t, a) for t, a in terms.GLOSSARY], 'term, aliases')}, o AS (SELECT n_name term, [n_name, substring(n_name, 1, 1), lower(n_name) || 'x'] aliases FROM nation), m AS (SELECT term, unnest(aliases) alias FROM g WHERE term NOT IN (SELECT term FROM o) UNION ALL SELECT term, unnest(aliases) FROM o) SELECT DISTINCT alias, term FROM m WHERE length(alias) >= 2")
def glossary_from_table(read, spark):
    """The glossary with the terms of a table."""
    own = read("nation").select(F.col("n_name").alias("term"), F.array("n_name", F.substring("n_name", 1, 1), F.concat(F.lower("n_name"), F.lit("x"))).alias("aliases"))
    return spark.createDataFrame(terms.glossary_with(own), "alias string, term string")


_PARTS = f"WITH {C._BM25}, c AS (SELECT query_id % 5 doc_id, query_id, bm.doc_id chunk_id, rank FROM bm WHERE rank <= 3), u AS (SELECT doc_id, chunk_id, min(query_id * 100 + rank) pos FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, chunk_id) number FROM u)"


@query(f"{_PARTS}, s AS (SELECT item_id % 5 doc_id, string_agg('## ' || item_id || chr(10) || chr(10) || substring(text, 1, 80), chr(10) || chr(10) ORDER BY item_id) body FROM benchmark GROUP BY 1), f AS (SELECT n.doc_id, string_agg('[' || number || '] ' || source, chr(10) ORDER BY number) cited FROM n JOIN documents d ON d.doc_id = chunk_id GROUP BY 1) SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || body || coalesce(chr(10) || chr(10) || '## 参考资料' || chr(10) || chr(10) || cited, '') md FROM s LEFT JOIN f USING (doc_id)")
def doc_markdown(read, spark):
    """Five documents of passages as sections, with numbered references to what a search of each section found."""
    asked = read("benchmark")
    hits = C._search(read, 3)
    uses = hits.select((F.col("query_id") % 5).alias("doc_id"), F.col("doc_id").alias("chunk_id"), (F.col("query_id") * 100 + F.col("rank")).alias("pos"))
    cited = generation.numbered_citations(uses).join(read("documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    sections = asked.select((F.col("item_id") % 5).alias("doc_id"), F.col("item_id").alias("pos"), F.col("item_id").cast("string").alias("title"), F.substring("text", 1, 80).alias("content"))
    return generation.document(sections, cited, F.concat(F.lit("Document "), F.col("doc_id").cast("string")))


@query(f"{_PARTS} SELECT query_id, count(*) n_sources, min(chunk_id) least FROM c GROUP BY query_id")
def section_retrieval(read, spark):
    """What a search finds for each section."""
    return C._search(read, 3).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.min("doc_id").alias("least"))


@query(f"SELECT -i AS doc_id, {C._replaced('txt')} content FROM {C._values([(i + 1, t) for i, t in enumerate(C._GLOSSED)], 'i, txt')}")
def fix_terms(read, spark):
    """Sections with terms in their standard form."""
    rows = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(C._GLOSSED)], "doc_id int, content string")
    return rows.withColumn("content", terms.normalize_text(F.col("content")))

"""DuckDB SQL with the results of those queries that SQL can express, over the whole tables.

It follows the contracts and not the operators: links come from all shared shingles, searches from all products, and
spans from whole texts.
"""

from __future__ import annotations

from docloom.llm.urlfilter import ADDRESS, HOST

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = _UPPER + "234567"

#: 160 bits are 8 groups of 20: five hex digits, four base-32 ones.
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
r AS (SELECT doc_id, n, i, word || coalesce(' ' || lead(word, 1) OVER o, '') || coalesce(' ' || lead(word, 2) OVER o, '') || coalesce(' ' || lead(word, 3) OVER o, '') || coalesce(' ' || lead(word, 4) OVER o, '') AS s FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, s FROM r WHERE i = 1 OR i + 4 <= n),
z AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * shared >= 85 * (za.n + zb.n - shared)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT c.node, g.b FROM c JOIN g ON g.a = c.reached),
m AS (SELECT node, min(reached) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_HEAD = rf"(?:{_KEYWORDS})[\"'']?\x20*[:=]\x20*[\"'']?"
#: By kind: pattern, what of a match must be long enough, and how long.
_RULES = {"assign": (_HEAD + "[A-Za-z0-9+/_.=-]+", rf"^{_HEAD}([A-Za-z0-9+/_.=-]+)$", 6), "access": ("AKIA[A-Z0-9]+", "^(.*)$", 20), "hex": ("[0-9a-f]+", "^(.*)$", 24)}


def _spans(rank: int, kind: str) -> str:
    """Pieces of what stands before a match, and it, follow one another, so that their lengths add up to places."""
    pattern, part, least = _RULES[kind]
    return rf"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, stop - length(found) AS start, stop
FROM (SELECT doc_id, regexp_extract(piece, '(?:{pattern})$') AS found, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
      FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '(?s:.*?)(?:{pattern})') AS pieces FROM documents)))
WHERE length(regexp_extract(found, '{part}', 1)) >= {least}"""


SECRETS = f"""
WITH s AS ({" UNION ALL ".join(_spans(i, k) for i, k in enumerate(_RULES))}),
f AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _RULES)},
      string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in _RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def _number(text: str, start: int) -> str:
    return f"('0x' || substr(md5({text}), {start}, 4))::BIGINT"


#: Each list has one interval of a pattern, as the query's made-up events have one addition and one removal.
URLS = rf"""
WITH c AS (SELECT row_number() OVER () AS row, page_id, url, {_number("page_id::VARCHAR", 1)} % 365 AS day, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
p AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS parent FROM h),
e AS (SELECT 'block' AS list, host AS pattern, {_number("host", 5)} % 300 AS since, {_number("host", 5)} % 300 + {_number("host", 9)} % 200 + 1 AS until FROM h WHERE {_number("host", 1)} % 3 = 0
      UNION ALL SELECT 'allow', parent, {_number("parent", 17)} % 300, {_number("parent", 17)} % 300 + {_number("parent", 21)} % 200 + 1 FROM p WHERE parent <> '' AND {_number("parent", 13)} % 10 = 0),
l AS (SELECT row, page_id, url, day, string_split(host, '.') AS labels, regexp_matches(host, '{ADDRESS}') AS address FROM c WHERE host IS NOT NULL),
k AS (SELECT row, page_id, url, day, url AS key FROM c
      UNION ALL SELECT row, page_id, url, day, array_to_string(labels[i:], '.') FROM (SELECT *, unnest(range(1, CASE WHEN address THEN 2 ELSE greatest(len(labels), 2) END)) AS i FROM l)),
f AS (SELECT page_id, url, day, count(pattern) AS n_active, max(CASE WHEN pattern IS NOT NULL THEN {{'size': length(pattern), 'allows': list = 'allow', 'pattern': pattern, 'list': list}} END) AS best
      FROM k LEFT JOIN e ON key = pattern AND day >= since AND day < until GROUP BY row, page_id, url, day)
SELECT page_id, url, day, n_active, best.pattern AS pattern, best.list AS list, coalesce(best.list = 'block', false) AS blocked FROM f
"""

#: Targets by filling sources in the order of full / weight: the level rises while the next source is filled and falls after,
#: so it is the largest of the levels.
MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total FROM s),
c AS (SELECT most, weight, (total - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM f WINDOW before AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * coalesce((SELECT max(level) FROM c), 0)) AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5('17:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS n,
             ('0x' || substr(md5('18' || coalesce(':' || d.source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shift
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * least(floor(rate * n + shift) - floor(rate * (n - 1) + shift), ceil(rate)))::BIGINT AS taken FROM r
"""


def oracle_sql() -> dict:
    return {"op2_warc": WARC, "op3_source_mix": MIX, "op4_minhash_dedup": NEAR, "op6_secret_scan": SECRETS, "op7_maxscore": TOPK, "op9_url_filter": URLS}

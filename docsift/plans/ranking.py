"""Taxonomy, compatibility, constraints and final orders, on parts as documents.

A part's name is an attribute and a product. Queries are orders, told by their first part, candidates their other parts, in order of price. The taxonomy is data: product, family, and the pairs of families that go together.
"""

from __future__ import annotations

from .dialect import sql_query

TAX = """tax AS (SELECT * FROM (VALUES ('anvil', 'metalwork', 1), ('bolt', 'fastener', 2), ('gear', 'mechanism', 3), ('gizmo', 'mechanism', 4), ('plate', 'metalwork', 5), ('ring', 'fastener', 6), ('rod', 'fastener', 7)) AS t(product, family, ord)),
attr AS (SELECT * FROM (VALUES ('blue', 'colour', 1), ('red', 'colour', 2), ('cold', 'temperature', 3), ('hot', 'temperature', 4), ('large', 'extent', 5), ('small', 'extent', 6), ('new', 'age', 7), ('old', 'age', 8)) AS t(word, field, ord)),
p AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, @at{@split{p_name|' '}|1} AS word, @at{@split{p_name|' '}|2} AS noun FROM part),
m AS (SELECT p.*, tax.product, tax.family, attr.field FROM p LEFT JOIN tax ON noun = tax.product LEFT JOIN attr ON p.word = attr.word),
o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey, l_partkey),
f AS (SELECT l_orderkey, l_partkey, @rank{PARTITION BY l_orderkey ORDER BY line, l_partkey} AS place FROM o),
c AS (SELECT qo.l_orderkey AS query_id, d.p_partkey AS doc_id, q.product AS q_product, q.family AS q_family, d.product, d.family, q.word AS q_word, d.word, q.field AS q_field, d.field, q.p_type AS q_type, d.p_type,
 q.p_size AS q_size, d.p_size, @rank{PARTITION BY qo.l_orderkey ORDER BY d.p_retailprice DESC, d.p_partkey} AS rank
 FROM f qo JOIN m q ON qo.l_partkey = q.p_partkey JOIN f po ON po.l_orderkey = qo.l_orderkey JOIN m d ON po.l_partkey = d.p_partkey WHERE qo.place = 1 AND po.place > 1),
k AS (SELECT *, CASE WHEN q_product IS NULL THEN 'unknown_query_product' WHEN product IS NULL THEN 'unknown_candidate_product' WHEN q_product = product THEN 'compatible'
 WHEN (q_product = 'bolt' AND product = 'ring') OR (q_product = 'ring' AND product = 'bolt') THEN 'adjacent' WHEN q_family IS NOT DISTINCT FROM family THEN 'same_family' ELSE 'incompatible' END AS compatibility FROM c),
s AS (SELECT *, CASE compatibility WHEN 'compatible' THEN 8e0 WHEN 'adjacent' THEN 2e0 WHEN 'same_family' THEN 0.75e0 WHEN 'incompatible' THEN -10e0 ELSE 0e0 END
 + CASE WHEN q_word = word THEN 4e0 WHEN q_field = field THEN -8e0 ELSE 0e0 END + CASE WHEN q_type = p_type THEN 3e0 ELSE 0e0 END AS constraint_score,
 CASE WHEN q_word = word THEN 'EXACT' WHEN q_field = field THEN 'CONTRADICTION' ELSE 'UNKNOWN' END AS state FROM k)
"""


def _query(name: str, tail: str, doc: str) -> None:
    sql_query(name, f"WITH {TAX} {tail}", doc)


_query("contradiction_safe_order", "SELECT query_id, doc_id, @rank{PARTITION BY query_id ORDER BY CASE WHEN state = 'CONTRADICTION' THEN 1 ELSE 0 END, CASE WHEN constraint_score < 0 THEN 1 ELSE 0 END, constraint_score DESC, rank} AS safe_rank FROM s", "W9")
_query("function_priority", "SELECT query_id, doc_id, @rank{PARTITION BY query_id ORDER BY CASE WHEN any_match = 1 AND fits = 0 THEN 1 ELSE 0 END, rank} AS priority_rank FROM (SELECT *, max(fits) OVER (PARTITION BY query_id) AS any_match FROM (SELECT *, CASE WHEN q_type = p_type AND q_word = word THEN 1 ELSE 0 END AS fits FROM k) AS a) AS b", "W8: only if some candidate fits")
_query("debug_trace", "SELECT query_id, @join{@sort{@list{concat(lpad(@str{rank}, 3, '0'), ':', @str{doc_id})}}|','} AS trace FROM k WHERE rank <= 20 GROUP BY query_id", "Z14: twenty places a query")
_query("recommendation_view", "SELECT query_id, doc_id, rank, concat_ws('; ', CASE WHEN product IS NOT NULL THEN concat('product=', product) END, CASE WHEN family IS NOT NULL THEN concat('family=', family) END, concat('state=', state)) AS details FROM s WHERE rank <= 5", "X26, X28")
_query("metadata_integrity", "SELECT p_partkey, CASE WHEN product IS NULL THEN 'WEAK_PRODUCT_TEXT_EVIDENCE' WHEN family = 'mechanism' AND p_type LIKE 'S%' THEN 'PRODUCT_FAMILY_CONFLICT' ELSE 'SAME_FAMILY_MISMATCH' END AS issue FROM m WHERE product IS NULL OR (family = 'mechanism' AND p_type LIKE 'S%') OR (family = 'fastener' AND p_size > 45)", "F8")
_query("metadata_report", "SELECT coalesce(family, 'none') AS family, count(*) AS n, @if{product IS NOT NULL} AS with_product, @if{field IS NOT NULL} AS with_attribute, @if{product IS NOT NULL AND field IS NOT NULL} AS resolved, CASE WHEN count(product) = 0 THEN 'REVIEW' ELSE 'RESOLVED_PRODUCT' END AS status FROM m GROUP BY coalesce(family, 'none')", "G7, F10")
_query("known_subtypes", "SELECT family, @join{@set{concat(word, ' ', noun)}|','} AS subtypes FROM m WHERE family IS NOT NULL GROUP BY family", "Z7: the taxonomy bounds a family's subtypes")
_query("ambiguous_groups", "SELECT family, word, count(*) AS n, min(p_partkey) AS first_key FROM m WHERE family IS NOT NULL GROUP BY family, word HAVING count(*) >= 2", "D27, W12")
_query("round_robin_sample", "SELECT p_partkey, family, product, turn FROM (SELECT p_partkey, coalesce(family, 'unknown_family') AS family, coalesce(product, 'unknown_product') AS product, @rank{PARTITION BY family, product ORDER BY p_partkey} AS turn FROM m) AS r ORDER BY turn, family, product, p_partkey LIMIT 75", "W10: the sample size is the operator's")

# Products told by aliases in texts: scores by source, confidence by margin.
ALIAS = """alias AS (SELECT * FROM (VALUES ('article', 'the', 1), ('article', 'der', 2), ('article', 'les', 3), ('preposition', 'of', 4), ('preposition', 'von', 5), ('preposition', 'de', 6), ('verb', 'is', 7), ('verb', 'ist', 8), ('verb', 'est', 9)) AS t(product, word, ord)),
head AS (SELECT doc_id, @unnest{@distinct{@split{lower(@at{@split{text|chr(10)}|1})|' '}}} AS word FROM documents),
body AS (SELECT doc_id, @unnest{@distinct{@split{lower(text)|' '}}} AS word FROM documents),
hits AS (SELECT doc_id, product, min(ord) AS ord, @sum{h} AS in_title, @sum{b} AS in_text FROM (SELECT doc_id, product, ord, 1 AS h, 0 AS b FROM head JOIN alias ON head.word = alias.word UNION ALL SELECT doc_id, product, ord, 0, 1 FROM body JOIN alias ON body.word = alias.word) AS u GROUP BY doc_id, product),
scores AS (SELECT doc_id, product, ord, in_title, in_text, 3 * in_title + least(in_text, 3) AS score FROM hits),
ranked AS (SELECT *, @rank{PARTITION BY doc_id ORDER BY score DESC, ord} AS r, coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, ord), 0) AS runner FROM scores)
"""
sql_query("alias_matches", f"WITH {ALIAS} SELECT doc_id, product, in_title, in_text FROM hits", "J11, D2")
sql_query("product_scores", f"WITH {ALIAS} SELECT doc_id, product, score FROM scores", "D3")
sql_query("first_match_attribute", f"WITH {ALIAS} SELECT doc_id, @first{{product|ord}} AS attribute FROM (SELECT body.doc_id, product, ord FROM body JOIN alias ON body.word = alias.word) AS f GROUP BY doc_id", "D5")
sql_query("fallback_product", "SELECT doc_id, substring(@join{@slice{w|greatest(@size{w} - 3, 1)|4}|'_'}, 1, 128) AS product FROM (SELECT doc_id, @filter{@tok{@at{@split{text|chr(10)}|1}}|NOT x IN ('the', 'of', 'a', 'to', 'and') AND NOT (x >= '0' AND x < ':')} AS w FROM documents) AS t WHERE @size{w} > 0", "D6")
sql_query("title_reconstruct", "SELECT doc_id, CASE WHEN length(line) > length(source) + 2 AND @rlike{line|'^[A-Z]'} THEN line WHEN source LIKE '%AND' OR source LIKE '%FOR' OR source LIKE '%OF' OR source LIKE '%TO' OR source LIKE '%,' THEN line ELSE source END AS title FROM (SELECT doc_id, source, @at{@split{text|chr(10)}|1} AS line FROM documents) AS t", "D9")
sql_query("retrieval_text", "SELECT doc_id, concat_ws(chr(10), concat('source: ', nullif(source, '')), concat('language: ', nullif(lang, '')), concat('opening: ', nullif(@at{@split{text|chr(10)}|1}, ''))) AS retrieval_text FROM documents", "D10, X25")
sql_query("document_text", "SELECT p_partkey, concat_ws('. ', p_name, p_type, p_brand, concat('size ', @str{p_size})) AS document_text FROM part", "X25")

"""Search queries: facets, full text, keyword in context, structured queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stelae.operators import cover as D
from stelae.operators import search as S

from .base import Family, table

query = Family()

#: Period words and corpus markers of structured queries.
PERIODS = {"archaic": (-700, -500), "classical": (-500, -300), "late": (-300, -50)}
MARKERS = {"tm": "has_tm", "pleiades": "has_place"}


@query("""
SELECT d.doc_id, d.lang, d.source, l.quality, count(*) OVER () AS total
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.lang = 'en' AND d.text ILIKE '%tion%' AND d.n_chars >= 100
ORDER BY d.doc_id LIMIT 20 OFFSET 20
""")
def facet_search_page(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    found = S.facets(docs, contains={"text": "tion"}, equals={"lang": "en"}, at_least={"n_chars": 100})
    found = S.with_unpaged_total(found.select("doc_id", "lang", "source", "quality"))
    return S.page(S.ordered(found, "id", {"id": "doc_id"}, "doc_id"), 20, 20)


@query("SELECT count(*) AS total FROM documents WHERE lang = 'en' AND text ILIKE '%tion%' AND n_chars >= 100")
def facet_search_total(spark, d):
    return S.total(S.facets(table(spark, d, "documents"), contains={"text": "tion"}, equals={"lang": "en"}, at_least={"n_chars": 100}))


@query("""
SELECT 'with' AS state, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL
UNION ALL SELECT 'without', count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL
UNION ALL SELECT 'any', count(*) FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def tri_state_facets(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    parts = [S.facets(docs, has={"quality": v}).agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n") for s, v in (("with", True), ("without", False), ("any", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def sorted_page_descending(spark, d):
    return S.page(S.ordered(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "-date", {"date": "o_orderdate"}, "o_orderkey"), 25, 50)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%\\_%' ESCAPE '\\' OR c_name ILIKE '%#00000001%'")
def escaped_contains(spark, d):
    return table(spark, d, "customer").where(S.contains_any_ci("c_name", ["_", "#00000001"])).select("c_custkey", "c_name")


@query("""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)
WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'was')
""")
def fts_all_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.words("text").alias("w"))
    return docs.where(S.matches_all(F.col("w"), ["the", "and", "was"])).select("doc_id", F.size("w").cast("bigint").alias("n_tokens"))


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t)
SELECT doc_id FROM p WHERE (s LIKE '% of the %' AND NOT list_contains(w, 'stupid')) OR (list_contains(w, 'der') AND list_contains(w, 'die'))
""")
def fts_web_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", S.words("text").alias("w"))
    docs = docs.withColumn("s", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    return docs.where(S.web_query(F.col("w"), F.col("s"), '"of the" -stupid or der die')).select("doc_id")


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w,
  list_filter(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS s FROM documents),
r AS (SELECT doc_id, 1.0 * len(list_filter(w, lambda x: x IN ('the', 'src1'))) / (1 + ln(1 + len(w)))
  + 0.4 * len(list_filter(s, lambda x: x IN ('the', 'src1'))) / (1 + ln(1 + len(s))) AS rank FROM t)
SELECT doc_id, round(CAST(rank AS DOUBLE), 6) AS rank FROM r WHERE rank > 0 ORDER BY rank DESC, doc_id LIMIT 50
""")
def fts_weighted_rank(spark, d):
    docs = table(spark, d, "documents")
    rank = S.term_rank([(S.words("text"), 1.0), (S.words("source"), 0.4)], ["the", "src1"])
    return docs.select("doc_id", F.round(rank, 6).alias("rank")).where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(50)


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w,
  list_filter(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS s FROM documents),
u AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos, 1.0::DOUBLE AS weight FROM t
  UNION ALL SELECT doc_id, unnest(s), generate_subscripts(s, 1) + len(w), 0.2 FROM t),
p AS (SELECT * FROM u WHERE token IN ('the', 'src1', 'der', 'und')),
l AS (SELECT *, max(pos) FILTER (token = 'the') OVER o AS a, max(pos) FILTER (token = 'src1') OVER o AS b, max(pos) FILTER (token = 'der') OVER o AS c, max(pos) FILTER (token = 'und') OVER o AS d
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT doc_id, pos AS upto, greatest(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END, CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN least(c, d) END) AS begins FROM l),
g AS (SELECT *, lag(begins) OVER (PARTITION BY doc_id ORDER BY upto) AS was FROM f),
v AS (SELECT * FROM g WHERE begins IS NOT NULL AND (was IS NULL OR begins > was)),
r AS (SELECT v.doc_id, begins, upto, count(*) AS n, sum(1 / weight) AS inverse FROM v JOIN p ON p.doc_id = v.doc_id AND p.pos BETWEEN begins AND upto GROUP BY ALL)
SELECT doc_id, round(sum(n / inverse / (1 + upto - begins - (n - 1))), 6)::DOUBLE AS rank, count(*) AS n_covers FROM r GROUP BY doc_id
""")
def fts_cover_density(spark, d):
    """(the and src1) or (der and und), texts of class A before sources of class C."""
    fields = [(S.words("text"), "A"), (S.words("source"), "C")]
    found = D.cover_rank(table(spark, d, "documents"), "doc_id", fields, D.clauses_of("the src1 or der und"))
    return found.withColumn("rank", F.round("rank", 6))


@query("""
WITH h AS (SELECT doc_id, text, unnest(list_filter(range(1, length(text) - 2), lambda i: substring(lower(text), CAST(i AS INT), 4) = 'anan')) AS p
  FROM documents WHERE lower(text) LIKE '%anan%')
SELECT doc_id, CAST(p AS INT) AS position, substring(text, CAST(greatest(p - 12, 1) AS INT), CAST(least(p - 1, 12) AS INT)) AS "left",
  substring(text, CAST(p AS INT), 4) AS hit, substring(text, CAST(p + 4 AS INT), 12) AS "right" FROM h
""")
def kwic_occurrences(spark, d):
    return S.keyword_in_context(table(spark, d, "documents"), "anan", 12, "doc_id")


@query("""
WITH q AS (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' Archaic, TM' WHEN o_orderkey % 3 = 1 THEN ' late (classical)' ELSE '' END AS q FROM orders),
w AS (SELECT o_orderkey, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS raw FROM q),
b AS (SELECT o_orderkey, raw, list_transform(raw, lambda x: regexp_replace(lower(x), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')) AS f FROM w)
SELECT o_orderkey, array_to_string(list_filter(raw, lambda x: regexp_replace(lower(x), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')
    NOT IN ('archaic', 'classical', 'late', 'tm', 'pleiades')), ' ') AS residual,
  least(CASE WHEN list_contains(f, 'archaic') THEN -700 END, CASE WHEN list_contains(f, 'classical') THEN -500 END, CASE WHEN list_contains(f, 'late') THEN -300 END) AS year_from,
  greatest(CASE WHEN list_contains(f, 'archaic') THEN -500 END, CASE WHEN list_contains(f, 'classical') THEN -300 END, CASE WHEN list_contains(f, 'late') THEN -50 END) AS year_to,
  list_contains(f, 'tm') AS has_tm, list_contains(f, 'pleiades') AS has_place
FROM b
""")
def structured_query_filter(spark, d):
    k = F.col("o_orderkey") % 3
    tail = F.when(k == 0, " Archaic, TM").when(k == 1, " late (classical)").otherwise("")
    q = table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", tail).alias("q"))
    return S.structured_query(q, "q", PERIODS, MARKERS).drop("q")


@query("""
SELECT w AS token, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents)
GROUP BY w HAVING count(DISTINCT doc_id) >= 50
""")
def inverted_index_frequent(spark, d):
    index = S.inverted_index(table(spark, d, "documents"), "doc_id")
    return index.groupBy("token").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences")).where("documents >= 50")


@query("SELECT n_nationkey, n_name, ord FROM nation JOIN (VALUES (7, 1), (3, 2), (11, 3)) v(k, ord) ON k = n_nationkey")
def rows_by_id_list(spark, d):
    ids = spark.createDataFrame([(7, 1), (3, 2), (11, 3)], "n_nationkey int, ord int")
    return S.by_ids(table(spark, d, "nation").select("n_nationkey", "n_name"), ids, "n_nationkey", "ord")


@query("""SELECT sum(CASE WHEN regexp_full_match(o_orderpriority, '[0-9]+') THEN 0 ELSE 1 END)::BIGINT AS invalid, count(*) AS total FROM orders""")
def identifier_format_audit(spark, d):
    bad = ~F.col("o_orderpriority").rlike("^[0-9]+$")
    return table(spark, d, "orders").agg(F.sum(bad.cast("bigint")).alias("invalid"), F.count("*").alias("total"))

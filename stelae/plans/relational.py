"""Joins, aggregations, windows and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stelae.operators import aggregates as A
from stelae.operators import joins as J
from stelae.operators import search as S
from stelae.operators.ranks import running_sum

from .base import Family, table

query = Family()

#: Closed intervals of signed years, and the era around them.
TILES = [("orientalizing", -720, -581), ("archaic", -580, -481), ("classical", -480, -324), ("hellenistic", -323, -90)]
ERA = ("era", -720, -90)
#: Orders carry modern dates; this shifts them into the era, the same in both engines.
_YEAR_SQL = "(CAST(year(o_orderdate) - 1992 AS INT) * 97 - 720 + CAST(o_orderkey % 50 AS INT))"


def _year():
    return F.expr(_YEAR_SQL)


@query("""SELECT count(*) AS total, count(quality) AS labelled, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic,
count(CASE WHEN n_chars >= 1000 THEN 1 END) AS long_texts FROM documents LEFT JOIN labels USING (doc_id)""")
def summary_conditional_counts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return A.conditional_counts(docs, {"labelled": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 1, "long_texts": F.col("n_chars") >= 1000})


@query("""SELECT lang, count(*) AS total, count(quality) AS with_label, count(*) - count(quality) AS without_label,
round(100.0 * count(quality) / count(*), 1)::DOUBLE AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def provenance_breakdown(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = A.conditional_counts(docs, {"with_label": F.col("quality").isNotNull()}, ["lang"])
    return out.withColumn("without_label", F.col("total") - F.col("with_label")).withColumn("coverage", F.round(100.0 * F.col("with_label") / F.col("total"), 1))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20")
def top_sites(spark, d):
    return A.top_groups(table(spark, d, "documents"), "source", 20)


@query(f"""WITH y AS (SELECT ({_YEAR_SQL} // 100) * 100 AS century FROM orders), c AS (SELECT century, count(*) AS n FROM y GROUP BY century),
m AS (SELECT *, CASE WHEN century < 0 THEN century - 50 ELSE century + 50 END AS mid FROM c)
SELECT CAST(century AS INT) AS century, n, CASE WHEN mid BETWEEN -720 AND -581 THEN 'orientalizing' WHEN mid BETWEEN -580 AND -481 THEN 'archaic'
WHEN mid BETWEEN -480 AND -324 THEN 'classical' WHEN mid BETWEEN -323 AND -90 THEN 'hellenistic' WHEN mid BETWEEN -720 AND -90 THEN 'era' END AS period FROM m""")
def timeline_buckets_with_period(spark, d):
    years = table(spark, d, "orders").select(A.century(_year()).alias("century"))
    out = years.groupBy("century").agg(F.count("*").alias("n"))
    return out.withColumn("period", J.period_of(A.century_midpoint(F.col("century")), TILES, ERA))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def frequent_groups_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def sources_left_join_counts(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return J.counts_of(table(spark, d, "nation").select("n_nationkey", "n_name"), s, "n_nationkey", "suppliers")


_EDGES = "SELECT DISTINCT l_suppkey AS person, l_partkey % 100 AS other FROM lineitem"


@query(f"""WITH e AS ({_EDGES}) SELECT DISTINCT s_suppkey, s_name, person, other FROM supplier JOIN e ON s_suppkey = person OR s_suppkey = other""")
def or_join_members(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 100).alias("other")).distinct()
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return J.join_on_either(s, e, "s_suppkey", ["person", "other"])


@query("""WITH h AS (SELECT DISTINCT c_custkey, v FROM (SELECT c_custkey, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) AS v FROM customer
UNION ALL SELECT c_custkey, CAST(c_custkey % 5000 AS VARCHAR) FROM customer))
SELECT DISTINCT a.c_custkey, b.c_custkey AS mate FROM h a JOIN h b ON a.v = b.v AND a.c_custkey <> b.c_custkey""")
def shared_identifier_cluster(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.floor(F.abs("c_acctbal")).alias("a"), (F.col("c_custkey") % 5000).alias("b"))
    return J.shared_identifiers(c, "c_custkey", ["a", "b"])


@query("""WITH RECURSIVE h AS (SELECT DISTINCT c_custkey AS id, v FROM (SELECT c_custkey, CAST(CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS VARCHAR) AS v FROM customer
UNION ALL SELECT c_custkey, 'k' || c_custkey % 4000 FROM customer)), m AS (SELECT v, min(id) AS least, count(*) - 1 AS mates FROM h GROUP BY v), l AS (SELECT id, least FROM h JOIN m USING (v)),
e AS (SELECT id AS a, least AS b FROM l UNION SELECT least, id FROM l), r AS (SELECT id AS root, id AS node FROM (SELECT DISTINCT least AS id FROM l) UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node AND e.b > r.root),
c AS (SELECT node AS id, min(root) AS class FROM r GROUP BY node)
SELECT h.id AS c_custkey, any_value(c.class) AS class, CAST(sum(mates) AS BIGINT) AS n_mates FROM h JOIN m USING (v) JOIN c ON c.id = h.id GROUP BY h.id""")
def shared_identifier_classes(spark, d):
    """Classes and membership where shared_identifier_cluster has all pairs."""
    c = table(spark, d, "customer").select("c_custkey", F.floor(F.abs("c_acctbal") / 50).alias("a"), F.concat(F.lit("k"), F.col("c_custkey") % 4000).alias("b"))
    return J.identifier_classes(c, "c_custkey", ["a", "b"])


@query("""SELECT c_nationkey AS tomb, CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS marker, a, b FROM (
SELECT x.c_nationkey, x.c_acctbal, x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey
AND floor(abs(x.c_acctbal) / 100) = floor(abs(y.c_acctbal) / 100) AND x.c_custkey < y.c_custkey)""")
def kinship_pairs_shared_marker(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("tomb"), F.floor(F.abs("c_acctbal") / 100).alias("marker"))
    return J.unordered_pairs(c, ["tomb", "marker"], "c_custkey")


@query("""SELECT l_suppkey, l_partkey % 50 AS other, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS kinds FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1""")
def conflicting_pair_types(spark, d):
    e = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("other"), "l_returnflag")
    return A.conflicts(e, ["l_suppkey", "other"], "l_returnflag").withColumn("kinds", F.array_join("kinds", ","))


@query("""WITH n AS (SELECT doc_id, list_filter(['and', 'the', 'from', 'with', 'der', 'les', 'que', 'los'], lambda x: contains(' ' || lower(text) || ' ', ' ' || x || ' ')) AS names FROM documents),
e AS (SELECT doc_id, unnest(names) AS name FROM n)
SELECT a.name AS a, b.name AS b, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY ALL""")
def co_occurrence_network(spark, d):
    words = F.array(*[F.lit(w) for w in ("and", "the", "from", "with", "der", "les", "que", "los")])
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    docs = table(spark, d, "documents").select("doc_id", F.filter(words, lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))).alias("names"))
    return A.co_occurrence(docs, "doc_id", "names")


@query("""WITH h AS (SELECT DISTINCT o_custkey, o_orderdate FROM orders)
SELECT a.o_custkey AS a, b.o_custkey AS b, count(*) AS shared FROM h a JOIN h b ON a.o_orderdate = b.o_orderdate AND a.o_custkey < b.o_custkey GROUP BY ALL""")
def related_groups_by_overlap(spark, d):
    return A.overlap_of_groups(table(spark, d, "orders"), "o_custkey", "o_orderdate")


_KEY_SQL = "trim(regexp_replace(regexp_replace(lower(text), '[\\[\\]<>{}()?–—-]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT doc_id, {_KEY_SQL} AS k FROM documents), g AS (SELECT doc_id, substring(sha256(CASE WHEN k = '' THEN chr(0) || doc_id ELSE k END), 1, 12) AS group_id FROM k)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM g""")
def dup_groups_content_hash(spark, d):
    from stelae.functions.text import text_key

    return A.content_groups(table(spark, d, "documents"), "doc_id", text_key("text"))


@query("""SELECT lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS k, source, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1""")
def exact_dup_clusters(spark, d):
    k = F.lower(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    return table(spark, d, "documents").groupBy(k.alias("k"), "source").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH k AS (SELECT doc_id, {_KEY_SQL} AS k FROM documents), b AS (SELECT DISTINCT {_KEY_SQL} AS k FROM benchmark)
SELECT doc_id, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY k) THEN 'internal_duplicate' WHEN k IN (SELECT k FROM b) THEN 'remote_overlap' ELSE 'kept' END AS status FROM k""")
def first_seen_quarantine(spark, d):
    from stelae.functions.text import text_key

    b = table(spark, d, "benchmark").select(text_key("text").alias("key"))
    return A.quarantine(table(spark, d, "documents").select("doc_id", "text"), text_key("text"), "doc_id", b).select("doc_id", "status")


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) BETWEEN 3 AND 12
GROUP BY w ORDER BY n DESC, w LIMIT 200""")
def vocabulary_top_n(spark, d):
    return A.vocabulary(table(spark, d, "documents"), "text", "[a-z]+", 3, 12, 200)


@query("""WITH t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 6), x AS (SELECT doc_id, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM t, (VALUES (4), (5), (6)) v(n)), g AS (
SELECT DISTINCT doc_id, substring(text, CAST(i AS INT), n) AS gram FROM x),
f AS (SELECT gram, count(*) AS documents FROM g WHERE NOT regexp_matches(gram, '\\s') GROUP BY gram HAVING count(*) BETWEEN 3 AND 20 ORDER BY length(gram) DESC, documents, gram LIMIT 40)
SELECT f.gram, f.documents, array_to_string(list_sort(list(g.doc_id))[1:10], ',') AS ids FROM f JOIN g ON f.gram = g.gram GROUP BY ALL""")
def discriminating_ngrams(spark, d):
    found = A.ngram_gold(table(spark, d, "documents"), "doc_id", "text", (4, 6), (3, 20), 40, 10)
    return found.withColumn("ids", F.array_join("ids", ","))


@query("""SELECT lang, arg_max(source, {'c': c, 's': source}) AS site, list_sort(list(doc_id))[1] AS first_id, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) c FROM documents) GROUP BY lang HAVING count(*) >= 3""")
def place_gold_sets(spark, d):
    n = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("c"), F.min("doc_id").alias("f"))
    out = n.groupBy("lang").agg(F.max_by("source", F.struct("c", "source")).alias("site"), F.min("f").alias("first_id"), F.sum("c").alias("n"))
    return out.where("n >= 3")


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS trailing FROM events""")
def trailing_24h_cap(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return spark.sql("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS trailing FROM {e}", e=e)


@query("""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS position FROM events""")
def queue_position(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    at = e.groupBy("event_type", "ts").agg(F.count("*").alias("n"))  # events of one moment share a position
    at = running_sum(at, ["event_type"], ["ts"], F.col("n"), "position").select(F.col("event_type").alias("k"), F.col("ts").alias("t"), "position")
    return e.join(at, e["event_type"].eqNullSafe(at["k"]) & e["ts"].eqNullSafe(at["t"])).select("event_id", "position")


@query("""WITH r AS (SELECT event_type, user_id, sum(value) AS s FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, user_id) AS n,
s - lead(s) OVER (PARTITION BY event_type ORDER BY s DESC, user_id) AS margin FROM r) SELECT event_type, user_id, round(margin, 6) AS margin FROM k WHERE n = 1""")
def top_margin(spark, d):
    r = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("s"))
    w = Window.partitionBy("event_type").orderBy(F.desc("s"), "user_id")
    k = r.select("*", F.row_number().over(w).alias("n"), (F.col("s") - F.lead("s").over(w)).alias("margin"))
    return k.where("n = 1").select("event_type", "user_id", F.round("margin", 6).alias("margin"))


@query("""WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT - 1800 AS s, floor(epoch(ts))::BIGINT + 1800 AS e FROM events),
f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
i AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM i GROUP BY user_id, island""")
def interval_merge(spark, d):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return A.merged_intervals(table(spark, d, "events"), "user_id", at - 1800, at + 1800)


@query("""WITH g AS (SELECT l_returnflag, l_suppkey % 7 AS mode, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, mode) <= 3""")
def top_k_per_key(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag", (F.col("l_suppkey") % 7).alias("mode")).agg(F.count("*").alias("n"))
    return S.first_per(n, ["l_returnflag"], [F.desc("n"), F.col("mode")], 3)


@query("SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_difference(spark, d):
    o = table(spark, d, "orders")
    ids = lambda p: o.where(F.col("o_orderpriority") == p).select("o_custkey")
    return ids("1-URGENT").distinct().join(ids("5-LOW"), "o_custkey", "left_anti")


@query("""WITH p AS (SELECT c_custkey, c_mktsegment, c_acctbal, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h) AS turn_no FROM p) SELECT c_custkey, c_mktsegment, turn_no FROM r ORDER BY turn_no, c_mktsegment LIMIT 50""")
def round_robin_sample(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return A.round_robin(c, "c_mktsegment", [F.md5(F.col("c_custkey").cast("string").cast("binary"))], 50).withColumn("turn_no", F.col("turn_no").cast("bigint"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT -1, 'new', -1.0""")
def upsert_merge(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.when(F.col("c_custkey") % 6 == 0, -1.0).alias("c_acctbal"))
    new = new.unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS c_custkey, 'new' AS c_name, CAST(-1.0 AS DOUBLE) AS c_acctbal"))
    return J.merge(old, new, "c_custkey", preserve=["c_acctbal"])


@query("""SELECT o_orderkey, coalesce(r1.v, r2.v, r3.v) AS place, CASE WHEN r1.v IS NOT NULL THEN 'own' WHEN r2.v IS NOT NULL THEN 'prefix' WHEN r3.v IS NOT NULL THEN 'status' ELSE 'missing' END AS reason
FROM (SELECT *, o_custkey % 25 AS k1, o_orderkey % 10 AS k2 FROM orders) o
LEFT JOIN (SELECT n_nationkey AS k1, n_name AS v FROM nation WHERE n_nationkey < 10) r1 USING (k1)
LEFT JOIN (SELECT r_regionkey AS k2, r_name AS v FROM region) r2 USING (k2)
LEFT JOIN (SELECT 'F' AS o_orderstatus, 'filled' AS v) r3 USING (o_orderstatus)""")
def cascade_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 25).alias("k1"), (F.col("o_orderkey") % 10).alias("k2"))
    n = table(spark, d, "nation").where("n_nationkey < 10").withColumnRenamed("n_nationkey", "k1")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "k2")
    st = spark.sql("SELECT 'F' AS o_orderstatus, 'filled' AS v")
    return J.cascade(o, [("own", n, "k1", "n_name"), ("prefix", r, "k2", "r_name"), ("status", st, "o_orderstatus", "v")], "place").select("o_orderkey", "place", "reason")


@query(f"""WITH y AS (SELECT o_orderkey, {_YEAR_SQL} AS year FROM orders), p AS (SELECT * FROM (VALUES ('orientalizing', -720, -581), ('archaic', -580, -481), ('classical', -480, -324), ('hellenistic', -323, -90), ('era', -720, -90)) v(period, lo, hi))
SELECT period, count(*) AS n, min(o_orderkey) AS first_id FROM y JOIN p ON year BETWEEN lo AND hi GROUP BY period HAVING count(*) >= 5""")
def period_gold_sets(spark, d):
    p = spark.createDataFrame([*TILES, ERA], "period string, lo int, hi int")
    met = J.containing_intervals(table(spark, d, "orders").select("o_orderkey", _year().alias("year")), "year", p, "lo", "hi", 100)
    return met.groupBy("period").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id")).where("n >= 5")


@query("""WITH a AS (SELECT DISTINCT p_partkey AS a, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 50 = 0), b AS (SELECT DISTINCT p_partkey AS b, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 50 <> 0),
m AS (SELECT a, b, count(*) AS shared, max(length(w)) AS longest FROM a JOIN b USING (w) WHERE length(w) > 3 GROUP BY ALL HAVING count(*) >= 2 OR max(length(w)) >= 6)
SELECT a, b, shared FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) = 1""")
def word_overlap_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    left, right = p.where("p_partkey % 50 = 0").withColumnRenamed("p_partkey", "a"), p.where("p_partkey % 50 <> 0").withColumnRenamed("p_partkey", "b")
    return J.word_overlap(left, right, "a", "b", "w")

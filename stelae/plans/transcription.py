"""Transcription and names: normal forms, editors' marks, similarity and formulas on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stelae.functions import names as N
from stelae.functions import normalize as Z
from stelae.operators import joins as J
from stelae.operators.search import first_per

from .base import Family, table

query = Family()


@query()
def normalize_struct(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", Z.normalize_udf()(F.upper("p_name")).alias("n")).select("p_partkey", "n.*")


@query()
def leiden_spans(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.substring("p_name", 1, 3), F.lit("] (an) [..] "), "p_name").alias("t"))
    return p.select("p_partkey", Z.leiden_udf("t").alias("l")).select("p_partkey", "l.*")


@query()
def tei_editions(spark, d):
    p = table(spark, d, "part").select("p_partkey", Z.normalize_udf()(F.concat(F.lit("[LAR]TH "), F.upper("p_name"))).alias("n"))
    return p.select("p_partkey", Z.tei_edition(F.struct("n.canonical", "n.apparatus")).alias("xml"))


@query()
def name_formula(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.array(F.lit("larθ"), F.lit("arnθal"), F.lower("s_name")).alias("t"))
    out = s.select("s_suppkey", N.name_formula("t").alias("parts"))
    return out.withColumn("gentilicium", N.part_of_kind(F.col("parts"), "gentilicium"))


_KIND = "CASE " + " ".join(f"WHEN contains('{letters}', {{0}}) THEN '{kind}'" for kind, letters in N.SOUNDS.items()) + " END"
_X, _Y = "substring(a, CAST(i + 1 AS INT), 1)", "substring(b, CAST(k AS INT), 1)"


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT lower(p_name) AS a, lower(p_brand) AS b FROM part),
d AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: j::DOUBLE) AS r FROM p
UNION ALL SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN i + 1.0::DOUBLE ELSE least(r[k + 1] + 1, r[k] + CASE WHEN {_X} = {_Y} THEN 0
WHEN {_KIND.format(_X)} = {_KIND.format(_Y)} THEN 0.3 WHEN ({_KIND.format(_X)} = 'stops' AND {_KIND.format(_Y)} = 'aspirates') OR ({_KIND.format(_X)} = 'aspirates' AND {_KIND.format(_Y)} = 'stops') THEN 0.5 ELSE 1 END) END - k))::DOUBLE)
FROM d WHERE i < length(a))
SELECT p_partkey, round(r[length(b) + 1], 6)::DOUBLE AS distance FROM part JOIN d ON a = lower(p_name) AND b = lower(p_brand) AND i = length(a)""")
def phonological_distance(spark, d):
    """Equal pairs are measured once."""
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_brand").alias("b"))
    measured = p.select("a", "b").distinct().withColumn("distance", F.round(N.sound_distance_udf("a", "b"), 6))
    return p.join(measured, ["a", "b"]).select("p_partkey", "distance")


@query()
def gazetteer_links(spark, d):
    """Suppliers' names against nations' as places: blocked by first letters, the best two each, those without a match kept."""
    key = lambda c: N.place_key(Z.unmarked(F.col(c)))
    s = table(spark, d, "customer").select("c_custkey", key("c_mktsegment").alias("a")).withColumn("block", F.substring("a", 1, 1))
    n = table(spark, d, "nation").select("n_nationkey", key("n_name").alias("b")).withColumn("block", F.substring("b", 1, 1))
    pairs = s.select("block", "a").distinct().join(n, "block").select("a", "n_nationkey", N.name_similarity(F.col("a"), F.col("b")).alias("score"))
    best = first_per(pairs.where("score >= 0.2"), ["a"], [F.desc("score"), F.col("n_nationkey")], 2)
    return s.select("c_custkey", "a").join(best, "a", "left")


@query()
def near_equal_names(spark, d):
    """Of the host of each page read without encryption the most alike of hosts read with it; a test holds it against all pairs."""
    from stelae.operators.similar import near_equal

    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    other = p.where("scheme = 'https'").withColumnRenamed("page_id", "other_page")
    return near_equal(p.where("scheme = 'http'"), other, "page_id", "host", "other_page", "host").withColumn("ratio", F.round("ratio", 6))


@query("""WITH n AS (SELECT p_partkey, p_name, p_size FROM part), b AS (SELECT DISTINCT p_brand FROM part), x AS (SELECT p_partkey, p_brand, 1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)) AS score FROM n CROSS JOIN b)
SELECT p_partkey, p_brand, round(score, 6)::DOUBLE AS score FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, p_brand) = 1""")
def fuzzy_best_match_levenshtein(spark, d):
    from stelae.operators.edits import nearest_by_edits

    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    best = nearest_by_edits(p, p, "p_name", "p_brand").withColumnsRenamed({"a": "p_name", "b": "best"})
    return p.join(best, "p_name").select("p_partkey", F.col("best").alias("p_brand"), F.round("score", 6).alias("score"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS pages FROM pages""")
def pages_by_host(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    return J.counts_of(p, p, "host", "pages")


@query()
def site_clusters(spark, d):
    from stelae.operators.models import site_clusters as clusters

    return clusters(table(spark, d, "documents"), "source", "text", "abcdefghijklmnopqrstuvwxyz")


@query()
def naive_bayes_labels(spark, d):
    from stelae.operators import models

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", "quality")
    fitted = models.naive_bayes(rows, "text", "quality")
    return fitted.transform(models.with_grams(rows, "text")).select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


@query("""SELECT lang, substring(t, CAST(i AS INT), 2) AS context, substring(t, CAST(i + 2 AS INT), 1) AS next, count(*) AS n FROM (SELECT text AS t, lang, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE length(text) > 2) GROUP BY ALL""")
def character_contexts(spark, d):
    from stelae.operators.restoration import contexts

    return contexts(table(spark, d, "documents"), "text", 2, ["lang"])


_GAP = """g AS (SELECT doc_id, substring(text, 1, CAST(length(text) // 2 AS INT)) AS b, substring(text, CAST(length(text) // 2 + 2 AS INT)) AS a FROM documents WHERE length(text) >= 6),
t AS (SELECT text FROM documents),
c AS (SELECT o, substring(text, CAST(i AS INT), CAST(o AS INT)) AS context, substring(text, CAST(i + o AS INT), 1) AS next FROM (SELECT text, o, unnest(range(1, length(text) - o + 1)) AS i FROM t, (VALUES (0), (1), (2)) v(o) WHERE length(text) > o)),
n AS (SELECT o, context, next, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY o, context) AS p FROM n),
l AS (SELECT unnest(string_split('etaoinsr', '')) AS letter)"""


@query(f"""WITH {_GAP}, f AS (SELECT doc_id, letter, right(b, 2) AS k2, right(b, 1) AS k1, right(b, 1) || letter AS j2, letter AS j1, left(a, 1) AS y1, letter || left(a, 1) AS i2, left(a, 1) AS i1, substring(a, 2, 1) AS y2 FROM g, l),
q AS (SELECT f.*, ln(coalesce(a2.p, 0.4 * a1.p, 0.16 * a0.p, 1e-9)) + ln(coalesce(b2.p, 0.4 * b1.p, 0.16 * b0.p, 1e-9)) + CASE WHEN y2 = '' THEN 0 ELSE ln(coalesce(c2.p, 0.4 * c1.p, 0.16 * c0.p, 1e-9)) END AS score FROM f
LEFT JOIN s a2 ON a2.o = 2 AND a2.context = k2 AND a2.next = letter LEFT JOIN s a1 ON a1.o = 1 AND a1.context = k1 AND a1.next = letter LEFT JOIN s a0 ON a0.o = 0 AND a0.next = letter
LEFT JOIN s b2 ON b2.o = 2 AND b2.context = j2 AND b2.next = y1 LEFT JOIN s b1 ON b1.o = 1 AND b1.context = j1 AND b1.next = y1 LEFT JOIN s b0 ON b0.o = 0 AND b0.next = y1
LEFT JOIN s c2 ON c2.o = 2 AND c2.context = i2 AND c2.next = y2 LEFT JOIN s c1 ON c1.o = 1 AND c1.context = i1 AND c1.next = y2 LEFT JOIN s c0 ON c0.o = 0 AND c0.next = y2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, letter) AS rank, letter AS fills, round(score, 6)::DOUBLE AS score FROM q QUALIFY rank <= 3""")
def restored_gaps(spark, d):
    """The middle character of each document taken out: the three likeliest of some letters, by what stands before and after."""
    from stelae.operators import restoration

    docs = table(spark, d, "documents").where(F.length("text") >= 6)
    half = F.floor(F.length("text") / 2).cast("int")
    gaps = docs.select("doc_id", F.concat(F.substring("text", F.lit(1), half), F.lit("\x00"), F.substring(F.col("text"), half + 2, F.length("text"))).alias("text"))
    model = restoration.model(table(spark, d, "documents"), "text", 2)
    return restoration.restore(gaps, "doc_id", "text", model, 2, list("etaoinsr"), best=3, width=8).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT quality, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6)::DOUBLE AS weight FROM labels GROUP BY quality""")
def class_weights(spark, d):
    from stelae.operators.models import class_weights as weights

    return weights(table(spark, d, "labels"), "quality").withColumn("weight", F.round("weight", 6))


@query("""WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(trim('mi ' || p_name || ' turce arnθal')), '[:·•|/\\\\\\[\\]()<>{}、,.\\s]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[-–—0-9]+')) AS w FROM part),
r AS (SELECT p_partkey, list_filter(w, lambda x: x IN ('mi', 'turce')) AS k, list_filter(w, lambda x: x NOT IN ('mi', 'turce')) AS n FROM t)
SELECT p_partkey, array_to_string(list_concat(list_transform(k, lambda x: CASE WHEN x = 'mi' THEN 'EGO:mi' ELSE 'VERB:turce' END),
 list_transform(n, lambda x, i: CASE WHEN i = 1 THEN 'PRAENOMEN:' WHEN regexp_matches(x, '(al|ial|s|sa|isa|us|es)$') THEN 'PATRONYMIC:' ELSE 'GENTILICIUM:' END || x)), ' ') AS roles FROM r""")
def role_parse(spark, d):
    from stelae.operators import roles as O

    p = table(spark, d, "part").select("p_partkey", O.parse(O.tokens(F.concat(F.lit("mi "), "p_name", F.lit(" turce arnθal")))).alias("r"))
    return p.select("p_partkey", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["role"], x["filler"])), " ").alias("roles"))


@query()
def structural_neighbours(spark, d):
    from stelae.operators import roles as O
    from stelae.operators.vectors import neighbours

    p = table(spark, d, "supplier").select("s_suppkey", O.parse(O.tokens(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "mi ").otherwise(""), "s_name", F.lit(" arnθal")))).alias("r"))
    asked, v = (O.bundle(x, "s_suppkey", "r", wanted=("structure",)) for x in (p.where("s_suppkey % 50 = 0"), p))
    return neighbours(asked, v, "s_suppkey", "structure", 5)

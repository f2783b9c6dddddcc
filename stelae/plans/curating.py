"""Flags, routes, evidence, windows, samples and parallels on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stelae.functions import text as T
from stelae.operators import aggregates as A
from stelae.operators import evaluation as E
from stelae.operators import routing as R
from stelae.operators import spatial as P

from .base import Family, table

query = Family()
_ABC = "abcdefghijklmnopqrstuvwxyz .,\n"


@query("""SELECT page_id, CASE WHEN contains(u, 'example') THEN 'ex' WHEN contains(u, 'http') THEN 'web' END AS tag, CASE WHEN contains(u, 'example') THEN 1 WHEN contains(u, 'http') THEN 2 END AS score FROM (SELECT page_id, lower(url) AS u FROM pages)""")
def ordered_pattern_lookup(spark, d):
    p = spark.createDataFrame([("example", 1, "ex", 1), ("http", 2, "web", 2)], "pattern string, o int, tag string, score int")
    return R.first_pattern(table(spark, d, "pages"), "url", p, "pattern", "o", ["tag", "score"]).select("page_id", "tag", "score")


@query("""WITH x AS (SELECT doc_id, list_sort(list_filter(list_distinct(string_split(lower(text), '')), lambda c: NOT contains('abcdefghijklmnopqrstuvwxyz .,' || chr(10), c))) AS odd, 30 + doc_id % 20 AS lat, doc_id % 25 AS lon FROM documents)
SELECT doc_id, concat_ws(';', CASE WHEN len(odd) > 0 THEN 'non_alphabet_chars: ' || array_to_string(odd, ' ') END, CASE WHEN NOT lat BETWEEN 35 AND 48 THEN 'lat_out_of_range' END, CASE WHEN NOT lon BETWEEN 5 AND 18 THEN 'lon_out_of_range' END) AS flags FROM x""")
def auto_flags(spark, d):
    docs = table(spark, d, "documents")
    flags = R.auto_flags(F.col("text"), 30 + F.col("doc_id") % 20, F.col("doc_id") % 25, _ABC)
    return docs.select("doc_id", F.array_join(flags, ";").alias("flags"))


@query("""SELECT CASE WHEN p IS NULL THEN 'missing' WHEN lower(trim(p)) IN ('n/a', 'unknown', 'none', '-', '?', 'incerta', 'ignota', '') THEN 'placeholder' ELSE 'named' END AS route, count(*) AS n
FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' WHEN 2 THEN '' ELSE o_orderpriority END AS p FROM orders) GROUP BY 1""")
def placeholder_routing(spark, d):
    k = F.col("o_orderkey") % 4
    p = F.when(k == 1, " N/A ").when(k == 2, "").when(k == 3, F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy(R.place_route(p).alias("route")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter(['stupid', 'trash', 'scum'], lambda m: contains(text, m)), ',') AS markers FROM documents WHERE contains(text, 'stupid') OR contains(text, 'trash') OR contains(text, 'scum')""")
def rescue_candidates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", R.markers_found(F.col("text"), ["stupid", "trash", "scum"]).alias("m"))
    return docs.where(F.size("m") > 0).select("doc_id", F.array_join("m", ",").alias("markers"))


@query("""SELECT doc_id, regexp_matches(lower(text), '[a-zθφχśξ](tion|heit)([^\\p{L}]|$)') AND NOT regexp_matches(lower(text), '(^|[^\\p{L}])(stupid|scum)([^\\p{L}]|$)') AS rescued FROM documents""")
def genitive_rescue(spark, d):
    return table(spark, d, "documents").select("doc_id", R.rescue(F.col("text"), ["tion", "heit"], ["stupid", "scum"]).alias("rescued"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'model-en' WHEN 'de' THEN 'model-de' ELSE 'model-any' END AS model, 'urn:source:' || source AS uri FROM documents""")
def lookup_with_default(spark, d):
    return table(spark, d, "documents").select("doc_id", R.lookup(F.col("lang"), {"en": "model-en", "de": "model-de", "*": "model-any"}).alias("model"), R.uri(F.col("source"), "urn:source:").alias("uri"))


@query("""SELECT w AS token, count(*) AS n FROM (SELECT regexp_replace(w, '^(..+)[ms]$', '\\1') AS w FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS w FROM benchmark)) GROUP BY w""")
def loose_tokens(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")).alias("w"))
    return w.groupBy(R.loose_token(F.col("w")).alias("token")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, pattern, word FROM (SELECT doc_id, 'before_the' AS pattern, unnest(regexp_extract_all(text, '([A-Za-z]+) the\\b', 1)) AS word FROM documents UNION ALL
SELECT doc_id, 'after_und', unnest(regexp_extract_all(text, '\\bund ([A-Za-zäöüß]+)', 1)) FROM documents)""")
def gloss_patterns(spark, d):
    return R.glosses(table(spark, d, "documents"), "text", {"before_the": r"([A-Za-z]+) the\b", "after_und": r"\bund ([A-Za-zäöüß]+)"}, ["doc_id"])


@query("""SELECT doc_id, pattern, word FROM (SELECT doc_id, 'before_the' AS pattern, unnest(regexp_extract_all(text, '([A-Za-z]+) the\\b', 1)) AS word FROM documents UNION ALL
SELECT doc_id, 'after_und', unnest(regexp_extract_all(text, '\\bund ([A-Za-zäöüß]+)', 1)) FROM documents)""")
def gloss_patterns_in_sql(spark, d):
    """The same, called from SQL as a table function over a table argument."""
    from stelae.functions import tables

    tables.register(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    one = lambda pattern, name: spark.sql("SELECT CAST(id AS BIGINT) AS doc_id, pattern, word FROM gloss_matches(TABLE({docs}), 'doc_id', 'text', :pattern, :name)", {"pattern": pattern, "name": name}, docs=docs)
    return one(r"([A-Za-z]+) the\b", "before_the").unionByName(one(r"\bund ([A-Za-zäöüß]+)", "after_und"))


@query("""SELECT source, count(*) AS n, arg_min(text, {'a': -length(text), 'b': doc_id}) AS longest FROM documents GROUP BY source""")
def longest_text_by_source(spark, d):
    """A table function that is dealt its rows by PARTITION BY and speaks at the end of each part."""
    from stelae.functions import tables

    tables.register(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return spark.sql("SELECT part AS source, n, longest FROM longest_of('source', 'text', TABLE({docs}) PARTITION BY source ORDER BY doc_id)", docs=docs)


@query("""SELECT item_id, CASE WHEN trim(gloss) = '' THEN 'missing_field' WHEN lang NOT IN ('lat', 'grc') THEN 'unknown_language' WHEN NOT contains(text, quote) THEN 'quote_not_in_passage' END AS problem FROM (
SELECT item_id, text, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE 'g' END AS gloss, CASE WHEN item_id % 5 = 1 THEN 'xx' ELSE 'lat' END AS lang, CASE WHEN item_id % 5 = 2 THEN 'no such words' ELSE left(text, 12) END AS quote FROM benchmark)""")
def gloss_validation(spark, d):
    k = F.col("item_id") % 5
    b = table(spark, d, "benchmark")
    why = T.gloss_problem(F.lit("w"), F.when(k == 0, " ").otherwise("g"), F.when(k == 1, "xx").otherwise("lat"), F.when(k == 2, "no such words").otherwise(F.substring("text", 1, 12)), F.col("text"), ["lat", "grc"])
    return b.select("item_id", why.alias("problem"))


@query("""WITH t AS (SELECT doc_id, text, string_split(lower(text), 'stupid') AS parts FROM documents),
h AS (SELECT doc_id, text, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + 6 * (i - 1))) AS h FROM t WHERE len(parts) > 1),
w AS (SELECT doc_id, text, greatest(h - 40, 0) AS s, least(h + 46, length(text)) AS e FROM h),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e) AS k FROM n),
m AS (SELECT doc_id, k, substring(any_value(text), CAST(min(s) + 1 AS BIGINT), CAST(max(e) - min(s) AS BIGINT)) AS piece FROM i GROUP BY doc_id, k),
f AS (SELECT doc_id, string_agg(piece, ' [...] ' ORDER BY k) AS window FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(f.window, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 40) || ' [...] ' || right(text, 40) END) AS window FROM documents LEFT JOIN f USING (doc_id)""")
def keyword_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", R.keyword_windows(F.col("text"), "stupid", 40).alias("window"))


@query("""WITH p AS (SELECT item_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substring(text, CAST(i AS INT), 1), '\\p{L}'))) AS i FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5(item_id || '|' || i || '|42'), i) AS n FROM p)
SELECT item_id, CAST(i AS INT) AS position, left(text, CAST(i - 1 AS INT)) || '?' || substring(text, CAST(i + 1 AS INT)) AS masked, substring(text, CAST(i AS INT), 1) AS gold FROM r WHERE n <= 3""")
def masked_samples(spark, d):
    return R.masked_samples(table(spark, d, "benchmark"), "item_id", "text", 3)


@query("""WITH g AS (SELECT item_id, substring(lower(text), CAST(i AS INT), 3) AS g, count(*) AS c FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, g, c / sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS w FROM g), m AS (SELECT a.item_id AS query, b.item_id AS other, sum(a.w * b.w) AS cosine FROM w a JOIN w b USING (g) WHERE a.item_id <> b.item_id GROUP BY ALL),
f AS (SELECT m.* FROM m JOIN benchmark a ON a.item_id = query JOIN benchmark b ON b.item_id = other WHERE NOT contains(a.text, b.text) AND NOT contains(b.text, a.text) AND NOT (cosine > 0.9 AND abs(length(a.text) - length(b.text)) <= 2))
SELECT query, other, round(cosine, 6)::DOUBLE AS cosine FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, other) <= 2""")
def parallels_without_leakage(spark, d):
    b = table(spark, d, "benchmark")
    return R.parallels(b, "item_id", "text", b, 2).withColumn("cosine", F.round("cosine", 6))


@query("""SELECT p_partkey, array_to_string(list_slice(list_concat(list_transform(string_split(lower(p_name), ''), lambda c: CASE WHEN strpos('abcdefghijklmnopqrstuvwxyz ', c) > 0 THEN strpos('abcdefghijklmnopqrstuvwxyz ', c) + 1 ELSE 1 END),
list_transform(range(0, 24), lambda i: 0)), 1, 24), ',') AS ids FROM part""")
def character_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(R.encoded_characters(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz ", 24), ",").alias("ids"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS tag, unnest([0, 1]) AS p FROM orders), f AS (SELECT o_custkey, tag, min({'a': o_orderkey, 'b': p}) AS o FROM t GROUP BY ALL)
SELECT o_custkey, string_agg(tag, '|' ORDER BY o) AS tags FROM f GROUP BY o_custkey""")
def tags_by_file(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("t"))
    return R.tags_by_file(o, "o_custkey", "o_orderkey", "t").withColumn("tags", F.array_join("tags", "|"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'edited' ELSE n_name END AS n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'waiting' ELSE 'kept' END AS state FROM nation WHERE n_nationkey % 6 <> 2""")
def review_decisions(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    decided = n.where("n_nationkey % 3 <> 0").select("n_nationkey", F.when(k % 6 == 2, "skip").when(k % 3 == 1, "edit").otherwise("keep").alias("decision"), F.lit("edited").alias("override"))
    return R.review(decided, n, "n_nationkey", "n_name")


@query("""WITH c AS (SELECT c_custkey, 40 + (c_custkey * 7919 % 600) / 100.0 AS lat, 9 + (c_custkey * 104729 % 500) / 100.0 AS lon, CASE WHEN c_custkey % 2 = 0 THEN 0.05 ELSE 0.5 END AS off FROM customer)
SELECT c_custkey, CASE WHEN 2 * 6371.0 * asin(sqrt(power(sin(radians(off) / 2), 2))) <= 15 THEN 'VERIFIED' ELSE 'MANUAL_REVIEW_NEEDED' END AS verdict FROM c""")
def geocoder_agreement(spark, d):
    k = F.col("c_custkey")
    lat, lon = 40 + (k * 7919 % 600) / 100.0, 9 + (k * 104729 % 500) / 100.0
    return table(spark, d, "customer").select("c_custkey", P.agreement(lat, lon, lat + F.when(k % 2 == 0, 0.05).otherwise(0.5), lon).alias("verdict"))


@query("""SELECT w AS word, first AS first_id FROM (SELECT w, min(doc_id) AS first FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY w) ORDER BY first, w LIMIT 500""")
def first_seen_words(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")).alias("word"))
    return A.first_seen(w, "doc_id", "word", 500).withColumnRenamed("first", "first_id")


@query("""WITH w AS (SELECT doc_id, quality::DOUBLE AS a, (1 - toxic)::DOUBLE AS b, unnest(range(0, 40)) AS replica FROM labels), u AS (SELECT *, ('0x' || substring(md5(doc_id || '|' || replica || '|42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM w),
k AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.9999167588507119)::INT + (u >= 0.9999897508033253)::INT AS k FROM u),
m AS (SELECT replica, sum(k * a) / sum(k) - sum(k * b) / sum(k) AS d FROM k GROUP BY replica) SELECT round((SELECT avg(quality) - avg(1 - toxic) FROM labels), 6)::DOUBLE AS delta, round(avg((d <= 0)::INT), 6)::DOUBLE AS p_one_sided FROM m""")
def paired_bootstrap(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("a"), (1 - F.col("toxic")).cast("double").alias("b"))
    out = E.paired_bootstrap(rows, "doc_id", "a", "b", 40)
    return out.select(F.round("delta", 6).alias("delta"), F.round("p_one_sided", 6).alias("p_one_sided"))


@query("""SELECT p_partkey, round(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: (substring(p_name, CAST(i AS INT), 1) = substring(g, CAST(i AS INT), 1))::INT)) / length(p_name), 6)::DOUBLE AS accuracy, p_name = g AS exact
FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE reverse(p_name) END AS g FROM part)""")
def span_accuracy(spark, d):
    g = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.reverse("p_name"))
    p = table(spark, d, "part").select("p_partkey", "p_name", g.alias("g"))
    return p.select("p_partkey", F.round(E.character_accuracy(F.col("p_name"), F.col("g")), 6).alias("accuracy"), (F.col("p_name") == F.col("g")).alias("exact"))


@query("""SELECT residual AS c, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '[0-9+]') THEN 'ocr_failed' ELSE 'other' END AS residual FROM documents) GROUP BY 1""")
def data_quality_report(spark, d):
    q = F.when(F.col("text").rlike("[0-9+]"), "ocr_failed").otherwise("other")
    return table(spark, d, "documents").groupBy(q.alias("c")).agg(F.count("*").alias("n"))

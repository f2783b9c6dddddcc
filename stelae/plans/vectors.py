"""Vector retrieval, evaluation and curation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stelae.functions.text import text_key, tokens
from stelae.operators import cells
from stelae.operators import curation as C
from stelae.operators import evaluation as E
from stelae.operators import search as S
from stelae.operators import vectors as V

from .base import Family, table

query = Family()
_COS = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({a}::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform({b}::DOUBLE[], lambda x: x * x))))"
_NEAR = f"""q AS (SELECT vec_id AS query, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id, ql, label, {_COS.format(a="embedding", b="qe")} AS score FROM embeddings JOIN q ON vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _queries(e):
    """The stated query set: every id divisible by 50."""
    return e.where("vec_id % 50 = 0")


@query(f"""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round({_COS.format(a="embedding", b="qe")}, 6)::DOUBLE AS score FROM embeddings CROSS JOIN q ORDER BY score DESC, vec_id LIMIT 20""")
def knn_exact(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 7").first().embedding  # the query vector of one row
    return V.top_k(e, "vec_id", "embedding", q, 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_NEAR} SELECT query, vec_id, round(score, 6)::DOUBLE AS score, rank FROM r WHERE rank <= 10")
def knn_of_query_set(spark, d):
    e = table(spark, d, "embeddings")
    return V.neighbours(_queries(e), e, "vec_id", "embedding", 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def approximate_neighbours(spark, d):
    """The ten nearest of each stated query in the cells that it probes; a test holds recall at 0.9 or more."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    centroids, probes = cells.fit(e, "vec_id", "embedding", 32)
    return cells.cell_neighbours(_queries(e), cells.in_cells(e, "embedding", centroids), centroids, "vec_id", "embedding", 10, probes)


@query(f"WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM s WHERE label = ql) SELECT query, vec_id, round(score, 6)::DOUBLE AS score, n AS rank FROM k WHERE n <= 5")
def cross_partition_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    return V.neighbours(_queries(e), e, "vec_id", "embedding", 5, ["label"]).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {_NEAR}, m AS (SELECT query, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM r GROUP BY query)
SELECT query, vec_id, rank, round(margin, 6)::DOUBLE AS margin FROM r JOIN m USING (query) WHERE margin >= 0.01 AND rank <= 5""")
def margin_gate(spark, d):
    e = table(spark, d, "embeddings")
    hits = V.neighbours(_queries(e), e, "vec_id", "embedding", 5)
    return V.margin_gate(hits, "query", 0.01).select("query", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("margin", 6).alias("margin"))


@query(f"""WITH {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM r WHERE label <> ql)
SELECT query, vec_id, round(score, 6)::DOUBLE AS score, n AS rank FROM k WHERE n <= 3""")
def hard_negatives(spark, d):
    e = table(spark, d, "embeddings")
    return V.hard_negatives(_queries(e), e, "vec_id", "embedding", "label", 3).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


_SPARSE = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
sp AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and')))::DOUBLE / (1 + ln(1 + len(w))) AS sparse FROM t)"""


@query(f"""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7), {_SPARSE},
a AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY sparse DESC, doc_id) - 1) AS a FROM sp WHERE sparse > 0 QUALIFY row_number() OVER (ORDER BY sparse DESC, doc_id) <= 40),
c AS (SELECT vec_id AS doc_id, {_COS.format(a="embedding", b="qe")} AS score FROM embeddings CROSS JOIN q),
b AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id) - 1) AS b FROM c QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 40)
SELECT doc_id, round(coalesce(a, 0) + coalesce(b, 0), 9)::DOUBLE AS score FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def rrf_fusion(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 7").first().embedding
    docs = table(spark, d, "documents").select("doc_id", S.term_rank([(S.words("text"), 1.0)], ["the", "and"]).alias("sparse")).where("sparse > 0")
    a = V.reciprocal_ranks(docs, [F.desc("sparse"), F.col("doc_id")], "doc_id", "a", 40)
    dense = V.top_k(e, "vec_id", "embedding", q, 40).withColumnRenamed("vec_id", "doc_id")
    b = V.reciprocal_ranks(dense, [F.desc("score"), F.col("doc_id")], "doc_id", "b", 40)
    return V.fuse(a, b, "doc_id", 20).withColumn("score", F.round("score", 9))


@query(f"""WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 7), {_SPARSE}
SELECT doc_id, round({_COS.format(a="embedding", b="qe")} * sparse, 6)::DOUBLE AS score FROM embeddings CROSS JOIN q JOIN sp ON doc_id = vec_id WHERE sparse > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_product(spark, d):
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 7").first().embedding])
    docs = table(spark, d, "documents").select("doc_id", S.term_rank([(S.words("text"), 1.0)], ["the", "and"]).alias("sparse")).where("sparse > 0")
    met = docs.join(e.select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), q).alias("dense")), "doc_id")
    return met.select("doc_id", F.round(F.col("dense") * F.col("sparse"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("""WITH u AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL),
c AS (SELECT vec_id, label, i, x - m AS y FROM u JOIN m USING (label, i)), n AS (SELECT vec_id, sqrt(sum(y * y)) AS n FROM c GROUP BY 1)
SELECT c.label, c.vec_id, round(sum(y * i) / max(n), 4)::DOUBLE AS digest FROM c JOIN n USING (vec_id) GROUP BY ALL""")
def mean_center_by_group(spark, d):
    v = V.centred(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    digest = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("label", "vec_id", F.round(digest, 4).alias("digest"))


@query(f"""WITH {_NEAR} SELECT query, round(sum(CASE WHEN rank <= 1 AND label = ql THEN 1 ELSE 0 END) / 1.0, 6)::DOUBLE AS p_at_1, round(sum(CASE WHEN rank <= 5 AND label = ql THEN 1 ELSE 0 END) / 5.0, 6)::DOUBLE AS p_at_5,
round(sum(CASE WHEN rank <= 10 AND label = ql THEN 1 ELSE 0 END) / 10.0, 6)::DOUBLE AS p_at_10, round(coalesce(1.0 / min(CASE WHEN label = ql THEN rank END), 0), 6)::DOUBLE AS reciprocal_rank FROM r WHERE rank <= 10 GROUP BY query""")
def precision_at_k(spark, d):
    out = E.precision_at(_judged(spark, d), "query", F.col("label") == F.col("ql"), [1, 5, 10])
    return out.select("query", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _judged(spark, d):
    e = table(spark, d, "embeddings")
    hits = V.neighbours(_queries(e), e, "vec_id", "embedding", 10)
    own = _queries(e).select(F.col("vec_id").alias("query"), F.col("label").alias("ql"))
    return hits.join(e.select("vec_id", "label"), "vec_id").join(own, "query")


@query(f"""WITH {_NEAR}, t AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY 1), g AS (SELECT query, any_value(ql) AS ql, sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r WHERE rank <= 10 GROUP BY query)
SELECT query, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6)::DOUBLE AS ndcg FROM g JOIN t ON label = ql""")
def ndcg_at_10(spark, d):
    e = table(spark, d, "embeddings")
    n = e.groupBy("label").agg((F.count("*") - 1).alias("n"))
    totals = _queries(e).select(F.col("vec_id").alias("query"), "label").join(n, "label").select("query", "n")
    return E.ndcg(_judged(spark, d), "query", F.col("label") == F.col("ql"), totals).withColumn("ndcg", F.round("ndcg", 6))


@query(f"""WITH {_NEAR}, b AS (SELECT score, (label = ql)::INT AS ok FROM r WHERE rank <= 10), c AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS cut)
SELECT cut, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6)::DOUBLE AS share, round(avg(ok), 6)::DOUBLE AS accuracy FROM b JOIN c ON score >= cut GROUP BY cut""")
def calibration_curve(spark, d):
    out = E.calibration(_judged(spark, d), "score", F.col("label") == F.col("ql"), [0.0, 0.1, 0.2, 0.3, 0.5])
    return out.withColumn("share", F.round("share", 6)).withColumn("accuracy", F.round("accuracy", 6))


_PRED = "p AS (SELECT doc_id, quality AS gold, CASE WHEN contains(text, '!!') OR contains(text, '|') OR contains(text, '$$$') THEN 0 ELSE 1 END AS predicted FROM documents JOIN labels USING (doc_id))"


def _predicted(spark, d):
    t = F.col("text")
    rule = F.when(t.contains("!!") | t.contains("|") | t.contains("$$$"), 0).otherwise(1)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("gold"), rule.alias("predicted"))


@query(f"""WITH {_PRED}, l AS (SELECT DISTINCT gold AS label FROM p UNION SELECT predicted FROM p), c AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp,
count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn FROM l CROSS JOIN p GROUP BY label)
SELECT CAST(label AS INT) AS label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1 FROM c""")
def per_class_scores(spark, d):
    out = E.per_class(_predicted(spark, d), "gold", "predicted")
    return out.select(F.col("label").cast("int").alias("label"), "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_PRED}, c AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn
FROM (VALUES (0), (1)) l(label) CROSS JOIN p GROUP BY label)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg((gold = predicted)::INT) FROM p), 6)::DOUBLE AS accuracy, round(avg(2 * tp / (2 * tp + fp + fn)), 6)::DOUBLE AS macro_f1 FROM c""")
def confusion_macro_f1(spark, d):
    return E.overall(_predicted(spark, d), "gold", "predicted").select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_RATINGS = """rt AS (SELECT l_orderkey AS item, l_linenumber AS rater, CASE WHEN l_linenumber = 6 AND l_orderkey % 9 = 0 THEN 'api_error' WHEN l_orderkey % 11 = 0 THEN 'unsure' ELSE l_returnflag END AS label, 1 - l_discount AS confidence FROM lineitem)"""


def _ratings(spark, d):
    k = F.col("l_orderkey")
    label = F.when((F.col("l_linenumber") == 6) & (k % 9 == 0), "api_error").when(k % 11 == 0, "unsure").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").select(k.alias("item"), F.col("l_linenumber").alias("rater"), label.alias("label"), (1 - F.col("l_discount")).alias("confidence"))


@query(f"""WITH {_RATINGS}, c AS (SELECT item, label, count(*) AS n FROM rt GROUP BY ALL), m AS (SELECT item, sum(n) AS m FROM c GROUP BY 1 HAVING sum(n) > 1), l AS (SELECT * FROM c JOIN m USING (item)),
v AS (SELECT label, sum(n) AS nv FROM l GROUP BY 1), t AS (SELECT sum(nv) AS t, sum(nv * (nv - 1)) AS same FROM v), a AS (SELECT sum(n * (n - 1) / (m - 1)) AS agree FROM l)
SELECT round(1 - (1 - agree / t) / (1 - same / (t * (t - 1))), 9)::DOUBLE AS alpha, t::BIGINT AS pairable FROM a CROSS JOIN t""")
def krippendorff_alpha(spark, d):
    return E.krippendorff_alpha(_ratings(spark, d), "item", "label").withColumn("alpha", F.round("alpha", 9))


@query(f"""WITH {_RATINGS}, g AS (SELECT item, count(*) FILTER (label <> 'api_error') AS raters, count(*) FILTER (label = 'api_error') AS errors, count(DISTINCT label) FILTER (label <> 'api_error') AS kinds,
min(label) FILTER (label <> 'api_error') AS one, min(confidence) FILTER (label <> 'api_error') AS sure FROM rt GROUP BY item)
SELECT item, raters, CASE WHEN kinds = 1 AND one = 'unsure' THEN 'all_unsure' WHEN kinds = 1 AND errors = 0 AND sure >= 0.92 THEN 'candidate_gold' ELSE 'queue' END AS decision,
CASE WHEN kinds = 1 AND one <> 'unsure' AND errors = 0 AND sure >= 0.92 THEN one END AS gold FROM g""")
def jury_disposition(spark, d):
    return C.jury(_ratings(spark, d), "item", "rater", "label", "confidence", 0.92)


@query(f"WITH {_RATINGS}, e AS (SELECT DISTINCT item, label FROM rt) SELECT x.label AS a, y.label AS b, count(*) AS n FROM e x JOIN e y ON x.item = y.item AND x.label < y.label GROUP BY ALL")
def disagreement_pairs(spark, d):
    return C.disagreements(_ratings(spark, d), "item", "label")


@query(f"""WITH {_RATINGS} SELECT item, max(label) FILTER (rater = 1) AS r1_label, max(confidence) FILTER (rater = 1) AS r1_confidence, max(label) FILTER (rater = 2) AS r2_label, max(confidence) FILTER (rater = 2) AS r2_confidence
FROM rt WHERE rater <= 2 GROUP BY item""")
def wide_rating_pivot(spark, d):
    r = _ratings(spark, d).where("rater <= 2").withColumn("rater", F.concat(F.lit("r"), "rater"))
    return C.wide_ratings(r, "item", "rater", ["r1", "r2"], ["label", "confidence"])


_KEY = "trim(regexp_replace(regexp_replace(lower(text), '[\\[\\]<>{}()?–—-]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT doc_id, quality, {_KEY} AS k FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM k),
t AS (SELECT DISTINCT k FROM r WHERE r <= greatest(2, floor(n * 0.2))) SELECT doc_id, CASE WHEN k IN (SELECT k FROM t) THEN 'test' ELSE 'train' END AS split FROM k""")
def stratified_split(spark, d):
    k = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", text_key("text").alias("k"))
    return C.text_disjoint_split(k, "doc_id", "quality", "k", 0.2).select("doc_id", "split")


@query(f"""WITH k AS (SELECT quality, {_KEY} AS k FROM documents JOIN labels USING (doc_id)), c AS (SELECT k, quality, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT k, arg_max(quality, [n, quality]) AS major FROM c GROUP BY k),
l AS (SELECT major, row_number() OVER (ORDER BY major) - 1 AS l FROM (SELECT DISTINCT major FROM m)), d AS (SELECT k, major, row_number() OVER (PARTITION BY major ORDER BY md5(k || '|42'), k) - 1 AS r FROM m)
SELECT md5(k) AS text_md5, CAST(major AS INT) AS major, CAST((r + l) % 5 AS INT) AS fold FROM d JOIN l USING (major)""")
def kfold_group_atomic(spark, d):
    k = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", text_key("text").alias("k"))
    out = C.group_folds(k, "k", "quality", 5)
    return out.select(F.md5(F.col("k").cast("binary")).alias("text_md5"), F.col("major").cast("int").alias("major"), "fold")


@query(f"""WITH a AS (SELECT {_KEY} AS k, count(*) AS twins FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT doc_id, {_KEY} AS k FROM documents WHERE lang <> 'en' OR source = 'src0')
SELECT doc_id, twins, true AS same_label, NOT contains(k, ' ') AS single_token FROM b JOIN a USING (k)""")
def benchmark_leakage_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", text_key("text").alias("k"), F.lit(1).alias("label"))
    return C.leaks(docs.where("lang = 'en'"), docs.where("lang <> 'en' or source = 'src0'"), "k", "doc_id", "label")


@query("""WITH l AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS lemma FROM benchmark), w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS lemma FROM documents),
n AS (SELECT doc_id, lemma, count(*) AS n FROM w GROUP BY ALL) SELECT lemma, count(*) AS documents, sum(n)::BIGINT AS occurrences FROM n JOIN l USING (lemma) GROUP BY lemma""")
def lemma_contamination(spark, d):
    lemmas = table(spark, d, "benchmark").select(F.explode(tokens("text")).alias("lemma"))
    return C.lemma_hits(table(spark, d, "documents"), "doc_id", tokens("text"), lemmas, "lemma")


@query("""WITH i AS (SELECT doc_id, quality::DOUBLE AS v, unnest(range(0, 50)) AS replica FROM labels), u AS (SELECT *, ('0x' || substring(md5(doc_id || '|' || replica || '|42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM i),
w AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.9999167588507119)::INT + (u >= 0.9999897508033253)::INT AS w FROM u),
m AS (SELECT replica, sum(w * v) / sum(w) AS m FROM w GROUP BY replica), s AS (SELECT list_sort(list(m)) AS s FROM m) SELECT round(s[2], 6)::DOUBLE AS low, round(s[48], 6)::DOUBLE AS high FROM s""")
def bootstrap_ci_hash(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("v"))
    out = E.percentile_interval(E.bootstrap_means(rows, "doc_id", ["v"], 50), "v")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""WITH e AS (SELECT event_id, user_id, ts, user_id || ':' || event_type || ':' || date_trunc('hour', ts) AS k FROM events), f AS (SELECT *, first_value(event_id) OVER (PARTITION BY k ORDER BY ts, event_id) AS f,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM e)
SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'attested' WHEN event_id <> f THEN 'duplicate' WHEN recent > 4 THEN 'capped' ELSE 'pending' END AS decision FROM f""")
def moderation_gates(spark, d):
    t = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select("event_id", "user_id", t.alias("ts"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_trunc("hour", t).cast("string")).alias("k"))
    known = e.where("user_id % 10 = 0").select("k")
    return C.moderate(e, "event_id", "k", "user_id", "ts", known, 4).select("event_id", "decision")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), x AS (SELECT *, greatest(200 - count(*) OVER () * 3, 0) * n / sum(n) OVER () AS x, greatest(200 - count(*) OVER () * 3, 0) AS l FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS r, l - sum(floor(x)) OVER () AS spare FROM x) SELECT source, CAST(3 + floor(x) + CASE WHEN r <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def floor_remainder_allocation(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return C.allocate(s, "source", "n", 200, 3)


@query("""WITH b AS (SELECT item_id AS doc_id, text FROM benchmark), w AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM b),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substring(w, CAST(i AS INT), n))) AS g FROM w, (VALUES (2), (3), (4)) v(n)),
tf AS (SELECT doc_id, g, count(*) AS tf FROM g GROUP BY ALL), i AS (SELECT g, ln((1 + (SELECT count(*) FROM b)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY g), x AS (SELECT doc_id, g, tf * idf AS w FROM tf JOIN i USING (g)),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1), u AS (SELECT doc_id, g, w / l AS w FROM x JOIN l USING (doc_id))
SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 6)::DOUBLE AS cosine FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.6""")
def near_dup_ngram_cosine(spark, d):
    docs = table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")
    return V.cosine_pairs(V.ngram_weights(docs, "doc_id", "text"), "doc_id", 0.6).withColumn("cosine", F.round("cosine", 6))


@query("""SELECT p_partkey, p_size, round(1 - (1 - p_size / 1000.0::DOUBLE) * (1 - p_size / 999.0::DOUBLE) * (1 - p_size / 998.0::DOUBLE), 6)::DOUBLE AS p FROM part""")
def random_baseline(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.round(E.random_precision(F.lit(1000), F.col("p_size"), 3), 6).alias("p"))

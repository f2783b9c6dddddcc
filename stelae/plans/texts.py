"""Text cleaning, tags, masks, letter statistics and dating on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stelae.functions import text as T
from stelae.operators import stats as S

from .base import Family, table

query = Family()
ALPHABET = "abcdefghijklmnopqrstuvwxyz .,\n"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("""WITH c AS (SELECT doc_id, text, translate(text, 'êÇ', 'ec') AS c FROM documents),
r AS (SELECT doc_id, text, list_sort(list_filter(list_distinct(string_split(lower(c), '')), lambda x: NOT contains('abcdefghijklmnopqrstuvwxyz .,' || chr(10), x))) AS r FROM c)
SELECT doc_id, array_to_string(r, '') AS residual, CASE WHEN regexp_matches(text, '[0-9+]') THEN 'ocr_failed' WHEN len(r) > 0 THEN 'needs_review' ELSE 'clean' END AS quality FROM r""")
def ocr_clean_quality(spark, d):
    docs = table(spark, d, "documents")
    left = T.residual_characters(F.lower(T.unscanned("text")), ALPHABET)
    return docs.select("doc_id", F.array_join(left, "").alias("residual"), T.scan_quality(F.col("text"), left).alias("quality"))


@query("""SELECT c, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ''))) AS c FROM documents)
WHERE c <> '' AND NOT contains('abcdefghijklmnopqrstuvwxyz .,' || chr(10), c) GROUP BY c ORDER BY documents DESC, c LIMIT 25""")
def residual_chars(spark, d):
    rows = table(spark, d, "documents").select(F.explode(T.residual_characters(F.lower("text"), ALPHABET)).alias("c"))
    return rows.groupBy("c").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "c").limit(25)


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s·•|:;]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, list_filter(w, lambda x: NOT regexp_matches(x, '[\\[\\]()<>{}?…⸢⸣-]')) AS k FROM t)
SELECT doc_id, md5(array_to_string(k, ' ')) AS digest, round(CASE WHEN len(w) > 0 THEN len(k) / len(w) ELSE 0 END, 6)::DOUBLE AS ratio FROM i""")
def intact_tokens(spark, d):
    r = table(spark, d, "documents").select("doc_id", T.intact_tokens("text").alias("r"))
    return r.select("doc_id", F.md5(F.col("r.text").cast("binary")).alias("digest"), F.round("r.ratio", 6).alias("ratio"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: (length(x) >= 2 AND regexp_full_match(x, '[A-Z]+') AND NOT regexp_full_match(x, '[IVXLCDM]+'))
 OR (length(x) >= 4 AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 0.75 * length(x) AND NOT regexp_full_match(x, '[IVXLCDM]+'))
 OR (length(x) >= 4 AND regexp_full_match(x, '[A-Z][a-z]+')))) > 0 AS latin FROM w""")
def latin_spelling(spark, d):
    return table(spark, d, "documents").select("doc_id", T.latin_spelling("text").alias("latin"))


@query("""SELECT s_suppkey, CASE WHEN trim(n) = '' THEN 'unknown' WHEN regexp_matches(n, '[bdgo]') THEN 'likely_latin'
WHEN list_has_any(regexp_split_to_array(n, '[^\\p{L}]+'), ['supplier', 'mi']) THEN 'confident' ELSE 'candidate' END AS hint
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'bog' WHEN s_suppkey % 5 = 1 THEN ' ' ELSE lower(s_name) END AS n FROM supplier)""")
def language_hint(spark, d):
    k = F.col("s_suppkey") % 5
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k == 0, "bog").when(k == 1, " ").otherwise(F.col("s_name")).alias("n"))
    return s.select("s_suppkey", T.language_hint("n", ["supplier", "mi"]).alias("hint"))


@query("""SELECT o_orderkey, CASE WHEN t LIKE 'CIE %' THEN 'cie' WHEN t LIKE 'ETP %' THEN 'etp' WHEN regexp_matches(t, '^[A-Z][a-z] [0-9]') THEN 'et' ELSE 'other' END AS tag
FROM (SELECT o_orderkey, ['CIE ', 'ETP ', 'Cr ', 'x'][CAST(o_orderkey % 4 + 1 AS INT)] || o_orderkey AS t FROM orders)""")
def source_tag(spark, d):
    pick = F.element_at(F.array(*[F.lit(x) for x in ("CIE ", "ETP ", "Cr ", "x")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.source_tag(F.concat(pick, F.col("o_orderkey").cast("string"))).alias("tag"))


@query("""SELECT doc_id, (regexp_matches(lower(text), '[q]') OR regexp_matches(lower(text), '(^|[^\\p{L}])(the|and)([^\\p{L}]|$)') OR regexp_matches(lower(text), '[a-z](ung|heit)([^\\p{L}]|$)'))
 AND NOT regexp_matches(lower(text), '(^|[^\\p{L}])(stupid|trash)([^\\p{L}]|$)') AS foreign_text FROM documents""")
def latin_sieve(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sieve("text", "q", ["the", "and"], ["ung", "heit"], ["stupid", "trash"]).alias("foreign_text"))


@query("""WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '-' || (o_orderkey + 3) WHEN 1 THEN o_orderkey || ' et ' || (o_orderkey + 9)
WHEN 2 THEN o_orderkey || ', 7,8' ELSE o_orderkey::VARCHAR END AS r FROM orders)
SELECT o_orderkey, unnest(CASE WHEN regexp_full_match(r, '[0-9]+-[0-9]+') THEN list_transform(range(o_orderkey, o_orderkey + 4), lambda x: x::VARCHAR)
ELSE regexp_split_to_array(r, '\\s*,\\s*|\\s+et\\s+') END) AS id FROM k""")
def id_range_expand(spark, d):
    k, o = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    r = F.when(k % 4 == 0, F.concat(o, F.lit("-"), k + 3)).when(k % 4 == 1, F.concat(o, F.lit(" et "), k + 9)).when(k % 4 == 2, F.concat(o, F.lit(", 7,8"))).otherwise(o)
    return T.expand_ids(table(spark, d, "orders").select("o_orderkey", r.alias("r")), "r").select("o_orderkey", "id")


_LACUNA = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN left(text, 10) || '[' || substring(text, 11, CAST(doc_id % 9 AS INT)) || ']' || substring(text, 30)
WHEN 1 THEN '[' || text || ']' WHEN 2 THEN text || '[..]' ELSE text || '[ab] x [cd]' END AS t FROM documents"""


@query(f"""WITH t AS ({_LACUNA}), f AS (SELECT doc_id, t, regexp_extract_all(t, '\\[([^\\[\\]]*)\\]', 1) AS f FROM t),
u AS (SELECT *, list_filter(f, lambda x: NOT regexp_matches(x, '[.…?\\-]') AND trim(x) <> '') AS u FROM f),
w AS (SELECT doc_id, u[1] AS restoration, CAST(length(regexp_replace(u[1], '[\\s.]', '', 'g')) AS INT) AS width FROM u
 WHERE len(u) = 1 AND len(f) = 1 AND trim(regexp_replace(t, '\\[[^\\[\\]]*\\]', '', 'g')) <> '')
SELECT doc_id, restoration, width, CASE WHEN width = 1 THEN 'w1' WHEN width <= 3 THEN 'w2_3' WHEN width <= 6 THEN 'w4_6' ELSE 'w7_plus' END AS bucket FROM w WHERE width >= 1""")
def lacuna_mine(spark, d):
    k, t = F.col("doc_id") % 4, F.col("text")
    made = (
        F.when(k == 0, F.concat(F.substring(t, 1, 10), F.lit("["), F.substring(t, F.lit(11), (F.col("doc_id") % 9).cast("int")), F.lit("]"), F.substring(t, F.lit(30), F.length(t))))
        .when(k == 1, F.concat(F.lit("["), t, F.lit("]")))
        .when(k == 2, F.concat(t, F.lit("[..]")))
        .otherwise(F.concat(t, F.lit("[ab] x [cd]")))
    )
    out = table(spark, d, "documents").select("doc_id", T.lacunae(made).alias("l"))
    return out.where("l is not null").select("doc_id", "l.*")


@query("""SELECT source, l.letter, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY source), 9)::DOUBLE AS share
FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS letter) l
LEFT JOIN (SELECT source, c AS letter, count(*) AS n FROM (SELECT source, unnest(string_split(lower(text), '')) AS c FROM documents) GROUP BY ALL) USING (source, letter)""")
def letter_frequency_by_site(spark, d):
    out = S.letter_frequencies(table(spark, d, "documents"), "source", "text", _LETTERS)
    return out.withColumn("share", F.round("share", 9))


@query("""WITH n AS (SELECT source, c AS letter, count(*) AS n FROM (SELECT source, unnest(string_split(lower(text), '')) AS c FROM documents WHERE source IN ('src1', 'src2'))
WHERE contains('abcdefghijklmnopqrstuvwxyz', c) AND c <> '' GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n), r AS (SELECT source, sum(n) AS r FROM n GROUP BY 1), c AS (SELECT letter, sum(n) AS c FROM n GROUP BY 1),
x AS (SELECT power(coalesce(n.n, 0) - r.r * c.c / t.t, 2) / (r.r * c.c / t.t) AS x FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN n ON n.source = r.source AND n.letter = c.letter),
m AS (SELECT sum(x) AS chi2, (SELECT count(*) - 1 FROM c) AS dof, (SELECT t FROM t) AS t FROM x),
g AS (SELECT *, dof / 2 AS a, chi2 / 2 AS z FROM m), s AS (SELECT *, unnest(range(0, CAST(least(z, 700) * 2 + 200 AS BIGINT))) AS k FROM g),
b AS (SELECT chi2, dof, t, z, sum(exp((a + k) * ln(z) - z - lgamma(a + k + 1))) AS below FROM s GROUP BY ALL)
SELECT round(chi2, 6)::DOUBLE AS chi2, dof, t::BIGINT AS total, round(sqrt(chi2 / t), 9)::DOUBLE AS cramers_v,
round(CASE WHEN z > 700 THEN 0 ELSE greatest(0, 1 - below) END, 6)::DOUBLE AS p_value, (CASE WHEN z > 700 THEN 0 ELSE greatest(0, 1 - below) END) < 0.05 AS significant FROM b""")
def chi2_two_sites(spark, d):
    two = S.letter_frequencies(table(spark, d, "documents").where("source in ('src1', 'src2')"), "source", "text", _LETTERS)
    out = S.chi_squared(two, "source", "letter", "n")
    return out.withColumns({"chi2": F.round("chi2", 6), "cramers_v": F.round("cramers_v", 9), "p_value": F.round("p_value", 6)})


def _feature_sql() -> str:
    return """SELECT doc_id, c, trim(c) = '' AS blank, contains(c, 'ka') AS k_before_a, contains(c, 'q') AS q_present, NOT contains(c, 'f') AS no_f,
(contains(c, 's')::INT + contains(c, 'ś')::INT + contains(c, 'ξ')::INT + contains(c, 'z')::INT) >= 2 AS three_sibilants,
contains(c, 'c') AND NOT contains(c, 'k') AND NOT contains(c, 'q') AS c_dominant, regexp_matches(c, '[θφχ]') AS aspirates_frequent,
regexp_matches(c, 'al(\\s|$)') AS genitive_al, contains(c, 'f') AS f_present, contains(c, 's') AND NOT contains(c, 'ś') AND NOT contains(c, 'ξ') AS simplified_sibilants,
regexp_matches(c, '[dbgo]') AS latin_influence FROM (SELECT doc_id, lower(text) AS c FROM documents)"""


def _canonical(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower("text").alias("c"))


def _tags_sql() -> str:
    sums = ", ".join(
        f"round(CASE WHEN blank THEN 0 ELSE {' + '.join(f'CASE WHEN {k} THEN {w} ELSE 0 END' for k, w in ws.items())} END, 4)::DOUBLE AS {p}" for p, ws in S.TAG_WEIGHTS.items()
    )
    return f"""WITH f AS ({_feature_sql()}), s AS (SELECT doc_id, {sums} FROM f), r AS (SELECT *, list_reverse_sort([archaic, classical, late]) AS r FROM s)
SELECT doc_id, archaic, classical, late, CASE WHEN r[1] < 0.2 OR round(r[1] - r[2], 4) < 0.1 THEN 'indeterminate'
WHEN archaic = r[1] THEN 'archaic' WHEN classical = r[1] THEN 'classical' ELSE 'late' END AS period FROM r"""


@query(_tags_sql())
def dating_tag_scores(spark, d):
    return S.dating_tags(_canonical(spark, d), "doc_id", F.col("c"))


def _posterior_sql() -> str:
    rows = ", ".join(f"('{k}', {b}, {p}::DOUBLE)" for k, ps in S.LIKELIHOODS.items() for b, p in enumerate(ps))
    names = ", ".join(S.LIKELIHOODS)
    return f"""WITH f AS ({_feature_sql()}), u AS (UNPIVOT (SELECT doc_id, {names} FROM f) ON {names} INTO NAME k VALUE v),
l AS (SELECT * FROM (VALUES {rows}) v(k, bin, p)), s AS (SELECT doc_id, bin, sum(ln(greatest(CASE WHEN v THEN p ELSE 1 - p END, 1e-10))) AS s FROM u JOIN l USING (k) GROUP BY ALL),
e AS (SELECT doc_id, bin, exp(s - max(s) OVER (PARTITION BY doc_id)) AS w FROM s), p AS (SELECT doc_id, bin, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM e)"""


@query(_posterior_sql() + " SELECT doc_id, CAST(bin AS INT) AS bin, CAST(-675 + 50 * bin AS INT) AS year, round(p, 6)::DOUBLE AS p FROM p")
def bayesian_posterior(spark, d):
    return S.dating_posterior(_canonical(spark, d), "doc_id", F.col("c")).withColumn("p", F.round("p", 6))


@query(
    _posterior_sql()
    + """, r AS (SELECT *, -675 + 50 * bin AS year, sum(p) OVER (PARTITION BY doc_id ORDER BY p DESC, bin ROWS UNBOUNDED PRECEDING) - p AS before FROM p)
SELECT doc_id, CAST(arg_max(year, [p, -bin]) AS INT) AS map_year, CAST(min(year) - 25 AS INT) AS low, CAST(max(year) + 25 AS INT) AS high FROM r WHERE before < 0.95 GROUP BY doc_id"""
)
def credible_interval(spark, d):
    return S.credible_interval(S.dating_posterior(_canonical(spark, d), "doc_id", F.col("c")), "doc_id")


VOCABULARY = {"function": ["the", "and", "der", "die", "les"], "abuse": ["stupid", "trash", "scum"], "place": ["ing", "heit", "ción"]}


def _keywords_sql() -> str:
    sums = ", ".join(f"({' + '.join(f'CASE WHEN list_contains(w, {w!r}) THEN 1.0 WHEN contains(c, {w!r}) THEN 0.5 ELSE 0 END' for w in ws)})::DOUBLE / {len(ws)} AS {k}" for k, ws in VOCABULARY.items())
    return f"""WITH t AS (SELECT doc_id, lower(text) AS c, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents), s AS (SELECT doc_id, {sums} FROM t)
SELECT doc_id, CASE WHEN greatest("function", abuse, place) = 0 THEN 'unknown' WHEN "function" = greatest("function", abuse, place) THEN 'function'
WHEN abuse = greatest("function", abuse, place) THEN 'abuse' ELSE 'place' END AS label, round(greatest("function", abuse, place), 6)::DOUBLE AS score FROM s""".replace("AS function", 'AS "function"')


@query(_keywords_sql())
def keyword_classifier(spark, d):
    return S.keyword_labels(table(spark, d, "documents"), "doc_id", F.col("text"), VOCABULARY).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, CASE WHEN text LIKE '%worthless%' OR text LIKE '%stupid%' THEN 'toxic' WHEN n_chars < 50 THEN 'short' WHEN source = 'src0' THEN 'hot' END AS label,
CASE WHEN text LIKE '%worthless%' OR text LIKE '%stupid%' THEN 'words' WHEN n_chars < 50 THEN 'length' WHEN source = 'src0' THEN 'source' END AS rule FROM documents""")
def tiered_rule_labels(spark, d):
    words = F.col("text").contains("worthless") | F.col("text").contains("stupid")
    rules = [("toxic", "words", words), ("short", "length", F.col("n_chars") < 50), ("hot", "source", F.col("source") == "src0")]
    return S.tiered_labels(table(spark, d, "documents"), "doc_id", rules)


@query("""SELECT c_custkey, CASE WHEN y IS NULL THEN 'undated' ELSE abs(y) || CASE WHEN u > 0 THEN ' ± ' || u ELSE '' END || CASE WHEN y < 0 THEN ' BCE' ELSE ' CE' END END AS shown,
CAST(floor((y + y2) / 2) AS INT) AS middle, CAST(floor(abs(y2 - y) / 2) AS INT) AS half
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 900 - 600 AS INT) END AS y, CAST(c_custkey % 3 * 25 AS INT) AS u, CAST(c_custkey % 900 - 600 + c_custkey % 101 AS INT) AS y2 FROM customer)""")
def dates_displayed(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 7 != 0, (k % 900 - 600).cast("int")).alias("y"), (k % 3 * 25).cast("int").alias("u"), (k % 900 - 600 + k % 101).cast("int").alias("y2"))
    mid, half = T.midpoint(F.col("y"), F.col("y2"))
    return c.select("c_custkey", T.date_display(F.col("y"), F.col("u")).alias("shown"), mid.alias("middle"), half.alias("half"))


@query("""SELECT doc_id, concat_ws(' | ', CASE WHEN trim(lang) <> '' THEN 'lang: ' || lang END, CASE WHEN trim(source) <> '' THEN 'source: ' || source END, CASE WHEN trim(text) <> '' THEN 'notes: ' || left(text, 500) END) AS context FROM documents""")
def embedding_context(spark, d):
    parts = {"lang": F.col("lang"), "source": F.col("source"), "notes": F.col("text")}
    return table(spark, d, "documents").select("doc_id", T.context_text(parts, {"notes": 500}).alias("context"))

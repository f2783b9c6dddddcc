"""One query for each operator, over its whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontaminate, passages, pii, quality, ranked, robust, rollup, secrets, simhash, suffixes
from .common import shared_dir, stage, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, network).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.verdicts(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over all documents: inserts; a move of the languages other than English to the next
    tokenizer version; that batch again, which changes nothing; revised counts of documents of quality 0, without their
    symbols; deletes of toxic ones."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    bare = F.translate(F.col("text"), "#*$%&|<>", "")
    per_doc = docs.select(
        "doc_id", "source", "lang", *[rollup.tokens(v).alias(v) for v in rollup.VERSIONS], *[rollup.tokens(v, bare).alias(f"{v} bare") for v in rollup.VERSIONS]
    )
    counted = stage(per_doc.join(labels, "doc_id", "left"), "token-counts")
    as_version = lambda df, v, n="n": df.withColumn("tokenizer", F.lit(v)).withColumn(n, F.col(f"`{v}`"))
    now = F.when(F.col("lang") != "en", "marks-2").otherwise("words-1")
    at_now = lambda suffix="": F.when(F.col("lang") != "en", F.col(f"`marks-2{suffix}`")).otherwise(F.col(f"`words-1{suffix}`"))
    moved = counted.where("lang <> 'en'")
    move = rollup.deletes(as_version(moved, "words-1")).unionByName(rollup.inserts(as_version(moved, "marks-2")))
    revised = counted.where("quality = 0").withColumn("tokenizer", now).withColumn("n_old", at_now()).withColumn("n", at_now(" bare"))
    gone = counted.where("toxic = 1").withColumn("tokenizer", now)
    gone = gone.withColumn("n", F.when(F.col("quality") == 0, at_now(" bare")).otherwise(at_now()))
    kept = rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for batch_id, changes in (
        ("1-insert", rollup.inserts(as_version(counted, "words-1"))),
        ("2-move", move),
        ("2-move", move),
        ("3-revise", rollup.revisions(revised)),
        ("4-delete", rollup.deletes(gone)),
    ):
        kept.commit(batch_id, changes)
    return kept.totals()


_TOKENS_SQL = {
    "words-1": r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))",
    "marks-2": r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\x20\x09-\x0D]'))",
}
_OP6_SQL = f"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.source, d.lang, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN l.quality = 0 THEN translate(d.text, '#*$%&|<>', '') ELSE d.text END AS t
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id
)
SELECT source, lang, CASE WHEN lang <> 'en' THEN 'marks-2' ELSE 'words-1' END AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs,
  CAST(sum(CASE WHEN lang <> 'en' THEN {_TOKENS_SQL["marks-2"].format("t")} ELSE {_TOKENS_SQL["words-1"].format("t")} END) AS BIGINT) AS n_tokens
FROM d WHERE toxic <> 1 GROUP BY ALL
"""


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.dialogues(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return made.withColumn("masks", masks)


_OP9_SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations WHERE conv_id IS NOT NULL),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
parts AS (
  SELECT s.conv_id, p.perspective, turn, speaker, content, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head,
    CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS block
  FROM said s JOIN seats p ON s.conv_id = p.conv_id
),
placed AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered,
    coalesce(sum(length(head) + length(content) + 11) OVER w, 0) AS before, row_number() OVER w2 AS nth
  FROM parts
  WINDOW w AS (PARTITION BY conv_id, perspective, block ORDER BY turn, speaker, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    w2 AS (PARTITION BY conv_id, perspective, block ORDER BY turn, speaker, content)
)
SELECT conv_id, perspective, block, string_agg(rendered, '' ORDER BY nth) AS rendered,
  coalesce(string_agg(CAST(before + length(head) AS BIGINT)::VARCHAR || ':' || CAST(before + length(head) + length(content) AS BIGINT)::VARCHAR, ',' ORDER BY nth) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, perspective, block
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(docs, secrets.train(docs))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
_OP11_SQL = f"""
WITH places AS (SELECT doc_id, {_TERMS_SQL.format("text")} AS term FROM documents),
asked AS (SELECT item_id, {_TERMS_SQL.format("text")} AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
found AS (SELECT doc_id, term, count(*) AS tf FROM places WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, corpus GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS q FROM asked GROUP BY item_id, term)
  JOIN found USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus
  GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_quality_classifier,
        op3_pii,
        op4_simhash,
        op5_quality_rules,
        op6_token_rollup,
        op7_passages,
        op8_bpe,
        op9_chat_rotation,
        op10_secrets,
        op11_ranked_search,
        op12_token_alignment,
        op13_suffix_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_token_rollup": _OP6_SQL, "op9_chat_rotation": _OP9_SQL, "op11_ranked_search": _OP11_SQL}

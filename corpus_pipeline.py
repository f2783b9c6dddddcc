"""The documents' way to token ids, stage by stage: quality, near-duplicates, benchmark passages, secrets, encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stelae.llm import bpe, decontaminate, quality, secrets, simhash
from stelae.llm.common import map_rows, stage, table, unstage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network predicts as good (2). Scored and dropped in one pass, so nothing is joined: rows with null
    or shared ids are judged each by its text, null texts as empty ones, very long ones whole; an empty table gives none."""
    network = quality.train(docs, table(spark, sf_dir, "labels"))

    def good(part, texts):
        return part.filter(pa.array(network.score(texts) >= quality.THRESHOLD))

    return map_rows(docs, good, docs.schema)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component (4): that of the least doc_id, nulls last, then of the least text hash. Rows that share a
    doc_id, or have none, stand for themselves. The least of a group is an aggregation with partial results, so none is held in one task."""
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, fp bigint"

    def marks(part, texts):
        fp = np.frombuffer(b"".join(simhash.fingerprint(t) for t in texts), ">i8").astype(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp)], ["doc_id", "h", "fp"])

    marked = stage(map_rows(named, marks, schema), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("x")
    chosen = marked.join(simhash.component_of(marked).hint("merge"), "fp").groupBy("root").agg(first)
    chosen = stage(chosen.select("root", F.col("x.doc_id").alias("_id"), F.col("x.h").alias("_h")), "near-copies-chosen")
    packed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row"))  # no column of docs stands beside ours
    # rows meet on one key, so the aggregation that makes equal rows one needs no shuffle of its own; the rest is compared beside it
    packed = packed.withColumn("k", F.xxhash64("h", "id"))
    same_id = (F.isnull("id").cast("int") + F.isnull("_id").cast("int") != 1) & F.coalesce(F.greatest("id", "_id") == F.least("id", "_id"), F.lit(True))
    kept = packed.join(chosen.withColumn("k", F.xxhash64("_h", "_id")), "k").where(same_id & (F.greatest("h", "_h") == F.least("h", "_h")))
    return kept.groupBy("k", "_id", "_h").agg(F.min("row").alias("row")).select("row.*")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item (1). A row goes by its own text: rows that share an id, or have none,
    are judged one by one; null and empty texts match nothing and stay; texts are read whole; an empty table gives none."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    leaks = stage(decontaminate.matches(keyed, table(spark, sf_dir, "benchmark"), id_col="key").select("doc_id.*").distinct(), "leaks")
    packed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row"))
    return packed.join(leaks, packed["id"].eqNullSafe(leaks["doc_id"]) & (packed["h"] == leaks["h"]), "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret found (10) replaced by a mark; n_chars follows the text. Null texts become empty; ids do not matter;
    repeated rows stay; texts are read whole; an empty table gives none."""
    network = secrets.train(docs)
    names, text_type = docs.columns, to_arrow_schema(docs.schema)

    def masked(part, texts):
        clean = [secrets.redacted(t.decode(), network) for t in texts]
        new = {"text": clean, "n_chars": [len(t) for t in clean]}
        return pa.RecordBatch.from_arrays([pa.array(new[c], type=text_type.field(c).type) if c in new else part.column(c) for c in names], names)

    return map_rows(docs, masked, docs.schema)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): token ids (8), and whether they decode to the text itself, for every row. Null and
    empty texts have no ids; null ids, languages and sources stay null; repeated rows are encoded each; an empty table gives none."""
    path, kept = bpe.public_path(), ["doc_id", "lang", "source"]

    def made(part, texts):
        t = bpe.tokenizer(path)
        found = [np.array(t.encode(x.decode()), np.int32) for x in texts]
        exact = [t.automaton.decode(f.tolist()) == x for f, x in zip(found, texts)]
        new = [pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(exact, pa.bool_())]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], [*kept, "n_tokens", "ids", "exact"])

    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept), "n_tokens bigint, ids array<int>, exact boolean"])
    return map_rows(docs, made, schema)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]

#: The stages are learned models, a closure and an alignment, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unstage(before)
        before = docs
    return docs

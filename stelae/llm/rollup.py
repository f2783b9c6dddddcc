"""Token counts as delta-maintained rollups.

Additive totals (documents and tokens by source, language and tokenizer version) are kept as one small table of signed
sums for each batch of changes. A batch is aggregated before anything is written, lands by one atomic commit, and is
known by its id: a batch that is committed already changes nothing, one that died half-way is written again. Totals
are the sums over committed batches; ``compact`` folds them into one table, which names the batches it holds.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
#: Tokenizer versions: what counts as one token.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def tokens(version: str, text: str | Column = "text") -> Column:
    """How many tokens of ``version`` a text has; null texts have none."""
    if version not in VERSIONS:
        raise ValueError(f"unknown tokenizer version {version!r}; known: {sorted(VERSIONS)}")
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(VERSIONS[version])), F.lit(0)).cast("bigint")


def inserts(counted: DataFrame) -> DataFrame:
    """Signed changes of new documents: ``counted`` has the keys and ``n`` tokens."""
    return counted.select(*KEYS, F.lit(1).cast("bigint").alias("d_docs"), F.col("n").alias("d_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).cast("bigint").alias("d_docs"), (-F.col("n")).alias("d_tokens"))


def revisions(counted: DataFrame) -> DataFrame:
    """Changed counts of known documents: ``n_old`` tokens become ``n``; another version or source is a delete and an insert."""
    return counted.select(*KEYS, F.lit(0).cast("bigint").alias("d_docs"), (F.col("n") - F.col("n_old")).alias("d_tokens"))


class Rollup:
    """Totals in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, where: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"a batch id has letters, digits, dots, dashes and underscores only: {batch_id!r}")
        return f"{self.path}/batch={batch_id}"

    def _there(self, where: str) -> bool:
        fs, p = self._fs(where)
        return fs.exists(p)

    def _put(self, beside: str, where: str) -> bool:
        """Rename a table written beside to its name: of two writers one wins, and the other's table is deleted."""
        context = self.spark.sparkContext
        fs, source = self._fs(beside)
        target = self._fs(where)[1]
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), context._jsc.hadoopConfiguration())
        none = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(source), fs.makeQualified(target), none)
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            fs.delete(source, True)
            return False
        return True

    def _names(self, prefix: str) -> list[str]:
        fs, p = self._fs(self.path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n[len(prefix) :] for n in found if n.startswith(prefix))

    def _folded(self) -> tuple[str | None, set[str]]:
        """The latest folded table and the ids of the batches it holds (one short string for each batch ever folded)."""
        folds = self._names("fold=")
        if not folds:
            return None, set()
        where = f"{self.path}/fold={folds[-1]}"
        return where, {r.id for r in self.spark.read.schema("id string").parquet(f"{where}/ids").collect()}

    def committed(self, batch_id: str) -> bool:
        return self._there(f"{self._batch(batch_id)}/_SUCCESS") or batch_id in self._folded()[1]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes once. False, and no change, where the batch is committed already, be it by a writer at the same time.

        Null keys are groups of their own; an empty batch commits; keys whose changes cancel are dropped. Other columns are ignored.
        """
        if self.committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        fs, half = self._fs(self._batch(batch_id))
        if fs.exists(half) and not self._there(f"{self._batch(batch_id)}/_SUCCESS"):  # a table without its mark of success was never committed
            fs.delete(half, True)
        beside = f"{self.path}/_beside-{uuid.uuid4().hex}"
        sums.where("d_docs <> 0 or d_tokens <> 0").coalesce(1).write.parquet(beside)
        return self._put(beside, self._batch(batch_id))

    def _landed(self) -> list[str]:
        return [b for b in self._names("batch=") if self._there(f"{self._batch(b)}/_SUCCESS")]

    def batches(self) -> list[str]:
        return sorted({*self._landed(), *self._folded()[1]})

    def _sums(self, fold: str | None, ids: set[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"
        paths = [self._batch(b) for b in self._landed() if b not in ids] + ([f"{fold}/sums"] if fold else [])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def compact(self) -> bool:
        """Fold all batches into one table. Batches that the fold before held are deleted; those folded now stay for readers that
        have begun, until the next time. False where nothing is new, or another writer folded at the same time."""
        fold, ids = self._folded()
        new = set(self._landed()) - ids
        if not new:
            return False
        beside, number = f"{self.path}/_beside-{uuid.uuid4().hex}", len(self._names("fold=")) + 1
        self._sums(fold, ids).where("d_docs <> 0 or d_tokens <> 0").coalesce(1).write.parquet(f"{beside}/sums")
        self.spark.createDataFrame([(i,) for i in sorted(ids | new)], "id string").coalesce(1).write.parquet(f"{beside}/ids")
        if not self._put(beside, f"{self.path}/fold={number:09d}"):
            return False
        for old in set(self._names("batch=")) & ids:
            fs, p = self._fs(self._batch(old))
            fs.delete(p, True)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over committed batches, without keys that came to nothing."""
        out = self._sums(*self._folded())
        return out.where("d_docs <> 0 or d_tokens <> 0").withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})

"""Shared helpers: reading tables, cutting lineage in the shared folder, text columns as bytes."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Folders made here, by application, where spark.checkpoint.dir is unset.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-stelae-')}"
    return _OWN[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stage_path = path
    return back


def unstage(df: DataFrame) -> None:
    """Delete a table written by :func:`stage` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_stage_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text as UTF-8 bytes, ...): null texts become empty; other columns of ``docs`` never collide."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
        *[F.col(c).alias(c) for c in more],
    )


def id_type(docs: DataFrame, id_col: str = "doc_id") -> T.DataType:
    return docs.schema[id_col].dataType


def map_texts(docs: DataFrame, rows_of, schema: str | T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``rows_of(ids: list, texts: list[bytes]) -> dict[str, list]`` to Arrow batches of whole texts."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def work(batches):
        for batch in batches:
            for part in pieces(batch):
                made = rows_of(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(work, out)


def map_rows(docs: DataFrame, make, schema: str | T.StructType, text_col: str = "text") -> DataFrame:
    """Apply ``make(part: RecordBatch, texts: list[bytes]) -> RecordBatch`` to slices of Arrow batches with all columns of ``docs``:
    what a stage does not change stays in Arrow. Null texts come as empty bytes."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            for part in pieces(batch, column=at):
                yield make(part, [b"" if t is None else t for t in part.column(at).cast(pa.binary()).to_pylist()])

    return docs.mapInArrow(work, out)


def pieces(batch: pa.RecordBatch, rows: int = 512, most: int = 4 << 20, column: int = 1):
    """Slices of a batch with at most ``rows`` rows and about ``most`` bytes of text (``column``), so that a worker's memory is bounded."""
    size = batch.column(column).nbytes if batch.num_rows else 0
    step = max(1, min(rows, int(batch.num_rows * most / max(size, 1)) or 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)

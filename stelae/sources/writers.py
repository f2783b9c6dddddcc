"""Writers: CSV, JSON lines, GeoJSON, text lines, keyed tables, tiles and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Columns of the CSV export.
CSV_COLUMNS = ("id", "canonical", "phonetic", "old_italic", "findspot", "date_display", "medium", "object_type")


def csv(df: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS, mode: str = "errorifexists") -> None:
    df.select(*[c for c in columns if c in df.columns]).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, without: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """One object a line; columns of vectors and the like are left out by name."""
    df.drop(*without).write.mode(mode).json(path)


def text_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """One line for each non-null value: features, triples, nodes or records."""
    df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).write.mode(mode).text(path)


def partitioned(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """Parquet in folders by key, which prune scans; rows are dealt by key and a salt of 8, so a hot key fills several files."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns[:1]]), F.lit(8))
    df.repartition(*[F.col(c) for c in by], salt).write.mode(mode).partitionBy(*by).parquet(path)


def counted(df: DataFrame, good: Column, by: Column, values: list[str], path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write the rows that are ``good`` and count them in the same pass: {value of ``by``: rows written, "other": ..., "skipped": ...}. The counts are
    observed on the frame that is written, so nothing is read twice; ``values`` are a stated list."""
    seen, ok = Observation(), F.coalesce(good, F.lit(False))
    listed = F.coalesce(by.isin(values), F.lit(False))
    each = [F.count_if(ok & (by == v)).alias(f"v{i}") for i, v in enumerate(values)]
    df.observe(seen, *each, F.count_if(ok & ~listed).alias("other"), F.count_if(~ok).alias("skipped")).where(ok).write.mode(mode).parquet(path)
    found = seen.get
    return {**{v: found[f"v{i}"] for i, v in enumerate(values)}, "other": found["other"], "skipped": found["skipped"]}


def audit(changes: DataFrame, path: str, actor: str) -> None:
    """Append who changed what from what to what; nothing is ever rewritten."""
    changes.select("id", "old_status", "new_status", F.lit(actor).alias("actor"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def history(df: DataFrame, record: str) -> DataFrame:
    return df.where(F.col("id") == record).orderBy(F.desc("at"), "new_status")


def upload_table(df: DataFrame, extras: list[str]) -> DataFrame:
    """``id,text`` and the extra columns, for annotation tools."""
    return df.select("id", F.coalesce("canonical", "raw_text").alias("text"), *extras)

"""Connected components by alternating star contraction, on Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    # least is a table of its own, so both sides of the join are plain exchanges that AQE may split where a node is hot; joins are by sorting,
    # as a table's size in files is less than in the driver's memory
    out = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    done = stage(out.where("u <> v").distinct(), "cc-large")
    unstage(least)
    return done


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    out = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = stage(out.where("u <> v").distinct(), "cc-small")
    unstage(least)
    return done


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (u, v) of any orderable type, (node, root) for every node with a link; root is the least node of its component.

    Rounds grow with the logarithm of the longest chain. Every round is written to the shared folder, nothing
    but a count and a checksum reaches the driver. Loops and repeated links are allowed; no links give no rows.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-links")
    was = _digest(now)
    for _ in range(most_rounds):
        if was[0] == 0:
            break
        large = _large_star(now)
        unstage(now)
        now = _small_star(large)
        unstage(large)
        new = _digest(now)
        if new == was:
            break
        was = new
    else:
        raise RuntimeError(f"components: no convergence in {most_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    out._stage_path = now._stage_path  # the caller may unstage it when it has used the result
    return out

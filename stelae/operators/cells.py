"""Approximate neighbours: vectors in cells around fitted centroids, several cells probed for each query, exact scores of what they hold."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .nearest import nearest
from .vectors import norm, query_blocks, ranked

#: Rows that the centroids are fitted on at most, and cells at most: with 3,072 numbers a vector, 250 MB on the driver and 13 MB in a task.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(vectors: DataFrame, id_col: str, vec_col: str, cells: int, k: int = 10, recall: float = 0.95, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """(centroids on the unit sphere, probes): k-means over the ``sample`` rows of least id hash, which is all that comes to the driver, and
    the cells that a query must look into for ``recall``: of the ``k`` nearest of up to 500 of these rows, so many lie in as many cells."""
    rows = vectors.where(norm(F.col(vec_col)) > 0).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vec_col).collect()
    if not rows:
        return np.zeros((0, 0), np.float32), 0
    wide = Counter(len(r[0]) for r in rows).most_common(1)[0][0]  # vectors of another length are in no cell
    x = _unit(np.array([r[0] for r in rows if len(r[0]) == wide], np.float32))
    centre = x[: min(cells, MOST_CELLS)].copy()
    for _ in range(rounds):
        of = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, x)
        used = np.bincount(of, minlength=len(centre)) > 0
        centre[used] = _unit(total[used])
    of, asked = (x @ centre.T).argmax(axis=1), x[-min(500, len(x)) :]
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centre.T), axis=1), axis=1)  # of each cell, for each query
    needed = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
    return centre, int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1 if len(needed) else len(centre)


def in_cells(df: DataFrame, vec_col: str, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """The rows with ``cell``: a row for each of the ``probes`` nearest centroids; a vector without length or of another one has none."""
    spec = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
    arrow, at, wide = to_arrow_schema(spec), df.columns.index(vec_col), centroids.shape[1]

    def work(batches):
        for batch in batches:
            column = batch.column(at)
            fits = pc.fill_null(pc.equal(pc.list_value_length(column), wide), False).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, bool)
            rows = np.flatnonzero(fits)
            if not len(rows) or not len(centroids):
                continue
            x = np.stack([v.values.to_numpy(zero_copy_only=False) for v in column.take(pa.array(rows))]).astype(np.float32)
            score = x @ centroids.T
            k = min(probes, len(centroids))
            cell = np.argpartition(-score, k - 1, axis=1)[:, :k]
            some = np.repeat(np.linalg.norm(x, axis=1) > 0, k)
            picked = batch.take(pa.array(np.repeat(rows, k)[some]))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(picked.columns, arrow)), pa.array(cell.ravel()[some].astype(np.int32))], schema=arrow)

    return df.mapInArrow(work, spec)


def cell_neighbours(queries: DataFrame, index: DataFrame, centroids: np.ndarray, id_col: str, vec_col: str, k: int, probes: int) -> DataFrame:
    """(query, id, score, rank): the ``k`` nearest by cosine among the rows of ``index`` (:func:`in_cells`) in the query's ``probes`` cells.

    A task multiplies a block of queries with its rows of each cell; scores are exact. For all rows use
    :func:`stelae.operators.vectors.neighbours`, which this equals where all cells are probed.
    """
    rows, found = index.select(id_col, vec_col, "cell"), None
    for block in query_blocks(queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("_q"))):
        best = nearest(rows, block, k, centroids=centroids, probes=probes)
        found = best if found is None else found.unionByName(best)
    return ranked(found, id_col, k)


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """(recall): the share of exact (query, id) rows that were found."""
    hit = exact.join(found.select("query", id_col, F.lit(1).alias("_hit")), ["query", id_col], "left")
    return hit.agg((F.count("_hit") / F.count("*")).alias("recall"))

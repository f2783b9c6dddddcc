"""The nearest rows of blocks of queries: products of matrices choose, sums in the order of a plain loop decide, so that scores and ties
are those of an expression evaluated pair by pair."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that meet a block of queries in one product, and bytes of numbers that a step holds, about.
SLICE, STEP_BYTES = 1024, 8 << 20
_LOWEST = np.finfo(np.float32).min


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])


def _unit(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rounded, of length 1; NaN where lengths are so far out that rounding is unbounded: what is NaN is always scored exactly."""
    fits = np.isfinite(n) & (n > 1e-100)
    return (x / np.where(fits, n, np.nan)[:, None]).astype(np.float32)


def _positive(n: np.ndarray) -> np.ndarray:
    return (n > 0) | np.isnan(n)  # as in Spark, where NaN is above all numbers


def matrices(column: pa.Array):
    """(rows, numbers) for each length of vector: rows whose vector is neither null nor empty nor holds a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for wide in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == wide)
        flat = column.take(pa.array(rows)).flatten()
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, wide)
        if flat.null_count:
            whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, wide).all(axis=1)
            rows, x = rows[whole], x[whole]
        yield rows, x


class Best:
    """Queries of one length of vector and the ``k`` best rows of each so far. Of ``keys``, columns of values, the first ``same`` must agree
    between a query and a row and the others must not; ``probed``, where given, says for each query the cells that it looks into."""

    def __init__(self, ids: list, x: np.ndarray, keys: list[list], same: int, k: int, probed: np.ndarray | None = None):
        self.ids, self.x, self.same, self.k, self.probed = ids, x, same, k, probed
        self.n = lengths(x)
        self.u = _unit(x, self.n)
        self.odd = bool(np.isnan(self.u).any())
        self.slack = (x.shape[1] + 8) * 2.0**-22  # beyond what rounding to floats moves a product by
        self.codes = [{v: i for i, v in enumerate(dict.fromkeys(c))} for c in keys]
        self.of = [np.array([m[v] for v in c], np.int64) for m, c in zip(self.codes, keys)]
        self.at: dict = {}
        for i, q in enumerate(ids):
            self.at.setdefault(q, []).append(i)
        self.best: list[list] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # the k-th score, where there are k

    def meet(self, ids: list, x: np.ndarray, keys: list[list], cell: np.ndarray | None = None) -> None:
        step = max(1, STEP_BYTES // (8 * x.shape[1]))
        for a in range(0, len(ids), step):
            part = slice(a, a + step)
            self._meet(ids[part], x[part], [c[part] for c in keys], None if cell is None else cell[part])

    def _meet(self, ids, x, keys, cell) -> None:
        n = lengths(x)
        codes = [np.array([m.get(v, -1) for v in c], np.int64) for m, c in zip(self.codes, keys)]
        rows = self._few_of_equal(np.flatnonzero(_positive(n)), ids, x, codes if cell is None else [*codes, cell])
        u = _unit(x, n)
        if cell is None:
            parts = [(rows, np.arange(len(self.ids)))]
        else:
            parts = [(rows[cell[rows] == c], np.flatnonzero(self.probed[:, c])) for c in np.unique(cell[rows])]
        for some, asked in parts:
            for a in range(0, len(some) if len(asked) else 0, SLICE):
                self._slice(some[a : a + SLICE], asked, ids, x, n, u, codes)

    def _few_of_equal(self, rows, ids, x, codes) -> np.ndarray:
        """Of rows with one vector and one key only those of the k + 1 least ids, as others are no query's."""
        packed = np.column_stack([x[rows].view(np.int64), *(c[rows].astype(np.int64) for c in codes)]) if len(rows) else np.zeros((0, 1), np.int64)
        raw, wide, seen = packed.tobytes(), packed.shape[1] * 8, {}
        for i in range(len(rows)):
            seen.setdefault(raw[i * wide : (i + 1) * wide], []).append(i)
        if len(seen) == len(rows):
            return rows
        kept = []
        for group in seen.values():
            if len(group) > self.k + 1:
                few = set(sorted({ids[rows[i]] for i in group})[: self.k + 1])
                group = [i for i in group if ids[rows[i]] in few]
            kept += group
        return rows[np.sort(np.array(kept, np.int64))]

    def _slice(self, rows, asked, ids, x, n, u, codes) -> None:
        every = len(asked) == len(self.ids)
        near = (self.u if every else self.u[asked]) @ u[rows].T
        if self.odd or np.isnan(u[rows]).any():
            near[np.isnan(near)] = np.inf
        for i, code in enumerate(codes):
            alike = self.of[i][asked][:, None] == code[rows]
            near[~alike if i < self.same else alike] = -np.inf
        place = {} if every else {q: i for i, q in enumerate(asked.tolist())}
        for j, r in enumerate(rows.tolist()):
            for q in self.at.get(ids[r], ()):
                if every or q in place:
                    near[q if every else place[q], j] = -np.inf
        least = self.least[asked] - self.slack
        short = np.flatnonzero(self.least[asked] == -np.inf)
        if len(short) and len(rows) > self.k:
            at = len(rows) - self.k
            least[short] = np.partition(near[short], at, axis=1)[:, at].astype(np.float64) - 2 * self.slack
        qi, ri = np.nonzero(near >= np.maximum(least, _LOWEST).astype(np.float32)[:, None])
        qi, ri, step = asked[qi], rows[ri], max(1, STEP_BYTES // (8 * x.shape[1]))
        for a in range(0, len(qi), step):
            self._add(qi[a : a + step], ri[a : a + step], ids, x, n)

    def _add(self, qi, ri, ids, x, n) -> None:
        score = np.add.accumulate(x[ri] * self.x[qi], axis=1)[:, -1] / (n[ri] * self.n[qi])
        good = np.isnan(score) | (score >= self.least[qi])
        qi, ri, score = qi[good], ri[good], score[good]  # asked is in order, so qi is
        cuts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1], True]) if len(qi) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            q = int(qi[a])
            new = [(-math.inf if s != s else -s, ids[r], s) for s, r in zip(score[a:b].tolist(), ri[a:b].tolist())]
            held = sorted(self.best[q] + new, key=lambda t: t[:2])[: self.k]
            self.best[q] = held
            if len(held) == self.k:
                self.least[q] = -held[-1][0]

    def found(self):
        for q, held in zip(self.ids, self.best):
            for _, i, s in held:
                yield q, i, s


def _whole(ids: list, keys: list[list], rows: np.ndarray) -> np.ndarray:
    """Those of the rows, as a mask, that have an id and all keys."""
    return np.array([ids[r] is not None and all(c[r] is not None for c in keys) for r in rows.tolist()], bool)


def nearest(rows: DataFrame, asked: pa.Table, k: int, same: int = 0, centroids: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """(query, id, score): of each task's rows (id, vector, keys...) the ``k`` nearest by cosine of each query (id, vector, keys...), itself
    left out. With ``centroids`` the last column of ``rows`` is a cell, and a query meets the rows of its ``probes`` nearest."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, asked.schema) as out:
        out.write_table(asked)
    sent, id_field, columns = sink.getvalue().to_pybytes(), rows.schema.fields[0], asked.num_columns
    query_type = asked.schema.field(0).type
    spec = T.StructType([T.StructField("query", _spark_type(query_type)), T.StructField("id", id_field.dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(spec)

    def work(batches):
        queries = pa.ipc.open_stream(sent).read_all()
        ids, keys = queries.column(0).to_pylist(), [queries.column(i).to_pylist() for i in range(2, columns)]
        met: dict[int, Best] = {}
        for at, x in matrices(queries.column(1)):
            good = _whole(ids, keys, at) & _positive(lengths(x))
            at, x, probed = at[good], x[good], None
            if centroids is not None:
                if x.shape[1] != centroids.shape[1]:
                    continue
                probed = np.zeros((len(x), len(centroids)), bool)
                cell = np.argpartition(-(x.astype(np.float32) @ centroids.T), min(probes, len(centroids)) - 1, axis=1)[:, :probes]
                np.put_along_axis(probed, cell, True, axis=1)
            if len(at):
                met[x.shape[1]] = Best([ids[i] for i in at], x, [[c[i] for i in at] for c in keys], same, k, probed)
        for batch in batches:
            mine, own = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in range(2, columns)]
            cells = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) if centroids is not None else None
            for at, x in matrices(batch.column(1)):
                if x.shape[1] in met:
                    good = _whole(mine, own, at)
                    at, x = at[good], np.ascontiguousarray(x[good])
                    met[x.shape[1]].meet([mine[i] for i in at], x, [[c[i] for i in at] for c in own], None if cells is None else cells[at])
        for best in met.values():
            out = list(best.found())
            for a in range(0, len(out), 1 << 15):
                q, i, s = zip(*out[a : a + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((q, i, s), arrow)], schema=arrow)

    return rows.mapInArrow(work, spec)


def _spark_type(kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)

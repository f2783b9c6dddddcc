"""Vector tiles: points as features of map tiles, encoded where they are gathered."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelae.operators.spatial import tile

#: Units along a tile's side, and features in one part of a tile.
EXTENT, MOST = 4096, 20_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _number(7, int(v))
    if isinstance(v, int):
        return _number(6, _zigzag(v))
    return _field(1, str(v).encode())


def layer(name: str, points: list[tuple[int, list[tuple[int, int]], dict]], extent: int = EXTENT) -> bytes:
    """A tile with one layer of features (id, points, attributes). The points of a feature are one command, each the difference to the
    one before; keys and values are tables of the layer, and attributes that are null are left out."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    features = b""
    for number, places, attributes in points:
        tags = b"".join(
            _varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v), v), len(values))) for k, v in attributes.items() if v is not None
        )
        x = y = 0
        shape = _varint(1 | len(places) << 3)  # move to each
        for px, py in places:
            shape += _varint(_zigzag(px - x)) + _varint(_zigzag(py - y))
            x, y = px, py
        features += _field(2, (_number(1, number) if number >= 0 else b"") + _field(2, tags) + _number(3, 1) + _field(4, shape))
    tables = b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values)
    return _field(3, _field(1, name.encode()) + features + tables + _number(5, extent) + _number(15, 2))


def vector_tiles(points: DataFrame, zoom: int, name: str, id_col: str, attributes: list[str], lat: str = "lat", lon: str = "lon", most: int = MOST) -> DataFrame:
    """(x, y, part, n, tile): the tiles of a zoom level that hold points. A tile of more than ``most`` points is cut by a hash of the id into
    parts, layers ``name``, ``name-1``, ...; parts put end to end are one tile. Rows without a point are left out."""
    here = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    x, y = tile(F.col(lat), F.col(lon), zoom)
    n, r = 2**zoom, F.radians(lat)
    px = F.floor(((F.col(lon) + 180.0) / 360.0 * n - x) * EXTENT).cast("int")
    py = F.floor(((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n - y) * EXTENT).cast("int")
    told = F.to_json(F.struct(*attributes), {"ignoreNullFields": "true"})
    placed = here.select(x.alias("x"), y.alias("y"), F.col(id_col).cast("bigint").alias("id"), px.alias("px"), py.alias("py"), told.alias("told"))
    parts = placed.groupBy("x", "y").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    cut = placed.join(parts, ["x", "y"]).withColumn("part", F.pmod(F.xxhash64("id", "px", "py"), F.col("parts")).cast("int"))
    cut = cut.select("x", "y", "part", "id", "px", "py", "told").repartition("x", "y", "part").sortWithinPartitions("x", "y", "part", "id", "px", "py", "told")

    def encoded(batches):
        import json

        now, held = None, []

        def row():
            a, b, part = now
            body = layer(name if part == 0 else f"{name}-{part}", held)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((a, pa.int64()), (b, pa.int64()), (part, pa.int32()), (len(held), pa.int64()), (body, pa.binary()))], ["x", "y", "part", "n", "tile"])

        for batch in batches:
            for a, b, part, number, i, j, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b, part) != now:
                    if held:
                        yield row()
                    now, held = (a, b, part), []
                held.append((-1 if number is None else number, [(i, j)], json.loads(t)))
        if held:
            yield row()

    return cut.mapInArrow(encoded, "x bigint, y bigint, part int, n bigint, tile binary")

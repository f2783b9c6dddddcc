"""Roles of words in short formulas, and hypervectors that bind roles to fillers and places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words that fill a role wherever they stand.
EGO = "mi mini"
VERBS = "turce turuce muluvanice muluvanece zinace mulu alice cerine tece"
OBJECTS = "śuθi suθi θui"
STATUSES = "lautni lautniθa lautn clan sec seχ śeχ puia etera papals nefts cliniiaras cliniar"
THEONYMS = "tin tinia uni menrva turan fufluns aritimi hercle herecele nethuns śuri catha selvans veive vetis culsu θesan"
ROLE = "struct<role:string,filler:string>"
#: Atoms that a task keeps: 2 KB each at 256 dimensions.
MOST_ATOMS = 4096


def tokens(text: Column) -> Column:
    """Lower-case words between dividers, brackets and stops; dashes and numbers alone are none."""
    return F.filter(F.split(F.lower(F.trim(text)), r"[:·•|/\\\[\]()<>{}、,.\s]+"), lambda t: (t != "") & ~t.rlike(r"^[-–—0-9]+$"))


def parse(words: Column, known: dict[str, str] | None = None) -> Column:
    """An array of (role, filler): words of known roles in order, then the names: the first left over is a first name, genitives
    after it are the father's, others the family's."""
    known = known or {"EGO": EGO, "VERB": VERBS, "OBJECT": OBJECTS, "STATUS": STATUSES, "THEONYM": THEONYMS}

    def role_of(w: Column) -> Column:
        out = F.lit(None).cast("string")
        for role, ws in reversed(known.items()):
            out = F.when(w.isin(*ws.split()), role).otherwise(out)
        return out

    fixed = F.filter(F.transform(words, lambda w: F.struct(role_of(w).alias("role"), w.alias("filler"))), lambda r: r["role"].isNotNull())
    rest = F.filter(words, lambda w: role_of(w).isNull())
    names = F.transform(
        rest,
        lambda w, i: F.struct(F.when(i == 0, "PRAENOMEN").when(w.rlike("(al|ial|s|sa|isa|us|es)$"), "PATRONYMIC").otherwise("GENTILICIUM").alias("role"), w.alias("filler")),
    )
    return F.concat(fixed, names)


def atom(key: Column, dim: int = 256) -> Column:
    """A vector of plus and minus ones from the bits of hashes of the key: the same anywhere."""
    words = [_signs(F.xxhash64(key, F.lit(k))) for k in range(-(-dim // 64))]
    return F.slice(F.flatten(F.array(*words)), 1, dim)


def _signs(h: Column) -> Column:
    bits = F.split(F.lpad(F.bin(h), 64, "0"), "")
    return F.transform(F.filter(bits, lambda b: b != ""), lambda b: F.when(b == "1", 1.0).otherwise(-1.0))


def bind(a: Column, b: Column) -> Column:
    """Element-wise product, its own inverse."""
    return F.zip_with(a, b, lambda x, y: x * y)


def bundle(df: DataFrame, id_col: str, roles: str, dim: int = 256, most_places: int = 12, wanted: tuple[str, ...] = ("content", "structure")) -> DataFrame:
    """(id, content, structure), or those ``wanted``: sums of role * filler and of role * place, added up within each row. Places after the
    first ``most_places`` share an atom, as the number of atoms for places is fixed. Rows without roles have no vectors."""
    kept = df.where(F.size(roles) > 0).select(id_col, F.transform(roles, lambda r: r["role"]).alias("_r"), F.transform(roles, lambda r: r["filler"]).alias("_f"))
    spec = T.StructType([kept.schema.fields[0], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in wanted]])
    arrow = to_arrow_schema(spec)

    def work(batches):
        known: dict = {}

        def kept_of(key, make) -> np.ndarray:
            if key not in known:
                if len(known) >= MOST_ATOMS:
                    known.clear()
                known[key] = make()
            return known[key]

        def signs(kind: str, key: str | None) -> np.ndarray:
            return kept_of((kind, key), lambda: signs_of(None if key is None else kind + key, dim))

        def structure(rs, fs) -> np.ndarray:  # rows of the same roles share it
            return kept_of(tuple(rs), lambda: sum(signs("role ", r) * signs("place ", str(min(j, most_places - 1))) for j, r in enumerate(rs)))

        def content(rs, fs) -> np.ndarray:
            return sum(signs("role ", r) * signs("word ", f) for r, f in zip(rs, fs))

        make = {"content": content, "structure": structure}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))
                ends = pa.array(np.arange(0, len(rows) * dim + 1, dim, dtype=np.int32))
                made = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([make[c](*r) for r in rows]))).cast(arrow.field(c).type) for c in wanted]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *made], schema=arrow)

    return kept.mapInArrow(work, spec)


def signs_of(key: str | None, dim: int = 256) -> np.ndarray:
    """What :func:`atom` gives for a key, from the same hashes."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.encode(), 42)
    words = b"".join(xxhash.xxh64_digest(k.to_bytes(4, "little"), seed) for k in range(-(-dim // 64)))
    return np.unpackbits(np.frombuffer(words, np.uint8))[:dim] * 2.0 - 1.0


def unbound(content: Column, role: str, dim: int = 256) -> Column:
    """What fills a role, with noise: the nearest filler's atom names it."""
    return bind(content, atom(F.lit(f"role {role}"), dim))

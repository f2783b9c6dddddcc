"""Name similarity and name formulas."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import pandas_udf
from .text import stem

#: Classes of sounds; within one a change costs 0.3, between stops and aspirates 0.5, else 1.
SOUNDS = {"stops": "ckqtp", "aspirates": "θφχ", "sibilants": "sśξz", "nasals": "mn", "vowels": "aeiu", "liquids": "lr", "labials": "vf"}
#: Words of places that name none, and case endings.
PLACE_WORDS = (
    "in agro ager agri prope apud loc localita località near presso dintorni di da del della the of territorio territory cum et "
    "museo museum publico pubblico collezione collection coll raccolta"
)
ENDINGS = "ensibus ensis ensi ibus arum orum ae is os us um am as es em im o a i e"
#: First names by gender, family names, genitive and female endings.
MALE = "larθ arnθ vel velθur aule setre laris marce avle caile larce θefare vipie"
FEMALE = "ramθa θanχvil θana larthi velia fasti ravnθu θania hastia arnthi"
FAMILIES = "spurina lecne velcha tarchna cuclnie petru seθre matunas tlesna herini ceicna pulfna calisna aulina larecna pumpu rumate svenia ancarni cucrina"
GENITIVES, FEMALE_ENDINGS = ("sa", "al", "s"), ("i", "ia", "a", "ei")
COMPONENT = "struct<form:string,type:string,gender:string,base_form:string,match_confidence:double,match_method:string>"


def ratio(a: str, b: str) -> float:
    """Matching blocks over both lengths."""
    return SequenceMatcher(None, a, b).ratio()


@pandas_udf("double")
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)])


def place_key(unmarked: Column) -> Column:
    """Letters and digits of a place name (marks taken off before), without words that name none."""
    ws = F.split(F.regexp_replace(F.lower(unmarked), r"[^\p{L}\p{N}]+", " "), " ")
    stop = F.array(*[F.lit(w) for w in PLACE_WORDS.split()])
    return F.array_join(F.filter(ws, lambda w: (w != "") & ~F.array_contains(stop, w)), " ")


def place_stem(key: Column) -> Column:
    return F.array_join(F.transform(F.split(key, " "), lambda w: stem(w, ENDINGS.split())), " ")


def name_similarity(a: Column, b: Column) -> Column:
    """The better of the ratios of keys and of stems; 0 where a key is empty."""
    whole = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
    return whole.otherwise(F.greatest(ratio_udf(a, b), ratio_udf(place_stem(a), place_stem(b))))


@lru_cache(maxsize=1)
def _class_of() -> dict[str, str]:
    return {c: k for k, cs in SOUNDS.items() for c in cs}


def sound_distance(a: str, b: str) -> float:
    """Edit distance with a change priced by the classes of the sounds; an insertion or deletion costs 1."""
    kind = _class_of()

    def change(x: str, y: str) -> float:
        p, q = kind.get(x), kind.get(y)
        if x == y:
            return 0.0
        if p is None or q is None:
            return 1.0
        return 0.3 if p == q else 0.5 if {p, q} == {"stops", "aspirates"} else 1.0

    row = [float(j) for j in range(len(b) + 1)]
    for x in a:
        last, row = row, [row[0] + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + change(x, y)))
    return row[-1]


@pandas_udf("double")
def sound_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sound_distance(x, y) if x is not None and y is not None else None for x, y in zip(a, b)])


#: The confidence of a name up to each distance, and beyond them.
CONFIDENCE = ((0.0, 1.0), (0.5, 0.9), (1.0, 0.8), (1.5, 0.7), (2.0, 0.6))
LEAST_CONFIDENCE = 0.4


def fuzzy_confidence(distance: float) -> float:
    return next((c for d, c in CONFIDENCE if distance <= d), LEAST_CONFIDENCE)


def closest(token: str, names: list[str], most: float = 2.0) -> tuple[str, float] | None:
    """The name at the least distance above 0 and up to ``most``; the first of equals."""
    found = [(sound_distance(token, n), k) for k, n in enumerate(names)]
    found = [x for x in found if 0 < x[0] <= most]
    return (names[min(found)[1]], min(found)[0]) if found else None


def component(token: str, position: int) -> dict:
    """What part of a name a token is: a known first name; a family name, whole or as a beginning; a genitive of a first name
    (or any genitive in second place); something close to a known name; else by its place."""
    male, female, families = MALE.split(), FEMALE.split(), FAMILIES.split()

    def made(kind: str, gender: str, base: str, sure: float = 1.0, how: str = "exact") -> dict:
        return {"form": token, "type": kind, "gender": gender, "base_form": base, "match_confidence": sure, "match_method": how}

    gender_of = lambda n: "male" if n in male else "female" if n in female else "unknown"
    if token in male or token in female:
        return made("praenomen", gender_of(token), token)
    for f in families:
        if token.startswith(f):
            return made("gentilicium", "unknown", f)
    for end in sorted(GENITIVES, key=len, reverse=True):
        base = token.removesuffix(end)
        if base and base != token:
            if base in male or base in female:
                return made("patronymic" if base in male else "metronymic", gender_of(base), base)
            if position == 1:
                return made("patronymic", "unknown", base)
    for kind, names in (("praenomen", male + female), ("gentilicium", families)):
        if near := closest(token, names):
            return made(kind, gender_of(near[0]), near[0], fuzzy_confidence(near[1]), "fuzzy")
    if position == 0:
        ends_female = any(token.endswith(e) and len(token) > len(e) for e in FEMALE_ENDINGS)
        return made("praenomen", "female" if ends_female else "unknown", token, 0.5, "positional")
    return made("gentilicium", "unknown", token, 0.5, "positional")


@pandas_udf(f"array<{COMPONENT}>")
def name_formula(tokens: pd.Series) -> pd.Series:
    """The parts of a name, from its canonical tokens."""
    return tokens.map(lambda ts: [component(t, i) for i, t in enumerate(ts)] if ts is not None else None)


def part_of_kind(components: Column, kind: str) -> Column:
    """The first part of a kind, or null."""
    return F.try_element_at(F.transform(F.filter(components, lambda c: c["type"] == kind), lambda c: c["form"]), F.lit(1))

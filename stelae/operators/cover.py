"""Full-text rank by cover density: a positional index of the query's terms and a sweep over the least intervals that satisfy it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a position of each class weighs.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def clauses_of(query: str) -> list[list[str]]:
    """The alternatives of a web-style query, each a list of terms that must all occur: ``or`` joins alternatives, quoted words are
    terms, words with a minus are left out."""
    out: list[list[str]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query.lower()):
        if word == "or":
            out.append([])
        elif not minus and not word.startswith("-"):
            out[-1] += [t for t in re.split(r"[^\w]+", phrase or word) if t]
    return [list(dict.fromkeys(c)) for c in out if c]


def _placed(tokens: Column, before: Column, weight: float) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (i + 1 + before).cast("int").alias("pos"), F.lit(weight).alias("weight")))


def positions(df: DataFrame, id_col: str, fields: list[tuple[Column, str]], terms: list[str] | None = None) -> DataFrame:
    """(id, token, pos, weight): where each token stands, from 1 on through all fields in order, and the weight of its field's class.
    With ``terms``, those alone, so that the rest of a text is never a row. Write it bucketed by token to serve many queries."""
    before, parts = F.lit(0), []
    for tokens, name in fields:
        tokens = F.coalesce(tokens, F.array().cast("array<string>"))
        at = _placed(tokens, before, WEIGHTS[name])
        parts.append(F.filter(at, lambda x: x["token"].isin(*terms)) if terms is not None else at)
        before = before + F.size(tokens)
    return df.select(id_col, F.explode(F.concat(*parts)).alias("x")).select(id_col, "x.*")


def covers(index: DataFrame, id_col: str, clauses: list[list[str]]) -> DataFrame:
    """(id, begin, end, n, inverse): the least intervals of positions within which all terms of a clause occur, how many of the query's
    positions each holds, and the sum of their inverse weights.

    Up to each position, the latest place of every term gives the latest beginning that satisfies a clause; an interval is a
    least one where that moves on. The window holds one document's positions of the query's terms.
    """
    here = Window.partitionBy(id_col).orderBy("pos")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    counted = index.withColumn("n", F.count("*").over(so_far)).withColumn("inverse", F.sum(1 / F.col("weight")).over(so_far))
    mark = F.struct("pos", F.col("n"), (F.col("inverse") - 1 / F.col("weight")).alias("before"))
    last = {t: F.last(F.when(F.col("token") == t, mark), ignorenulls=True).over(so_far) for t in dict.fromkeys(t for c in clauses for t in c)}
    placed = counted.select("*", *[c.alias(f"_{i}") for i, c in enumerate(last.values())])
    at = {t: F.col(f"_{i}") for i, t in enumerate(last)}

    def begin(clause: list[str]) -> Column:
        there = reduce(Column.__and__, [at[t].isNotNull() for t in clause])
        return F.when(there, F.least(*[at[t] for t in clause]) if len(clause) > 1 else at[clause[0]])

    latest = F.greatest(*[begin(c) for c in clauses]) if len(clauses) > 1 else begin(clauses[0])
    swept = placed.withColumn("from", latest).withColumn("was", F.lag("from.pos").over(here))
    least = swept.where(F.col("from").isNotNull() & (F.col("was").isNull() | (F.col("from.pos") > F.col("was"))))
    return least.select(id_col, F.col("from.pos").alias("begin"), F.col("pos").alias("end"), (F.col("n") - F.col("from.n") + 1).alias("n"), (F.col("inverse") - F.col("from.before")).alias("inverse"))


def cover_rank(df: DataFrame, id_col: str, fields: list[tuple[Column, str]], clauses: list[list[str]]) -> DataFrame:
    """(id, rank, n_covers) of documents that satisfy the query: each least interval adds the harmonic mean of its positions' weights,
    divided by one more than the other words in it."""
    terms = list(dict.fromkeys(t for c in clauses for t in c))
    found = covers(positions(df, id_col, fields, terms), id_col, clauses)
    noise = F.col("end") - F.col("begin") - (F.col("n") - 1)
    return found.groupBy(id_col).agg(F.sum(F.col("n") / F.col("inverse") / (1 + noise)).alias("rank"), F.count("*").alias("n_covers"))

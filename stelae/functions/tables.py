"""Table functions for SQL: each takes a table argument, which PARTITION BY deals out, and gives rows."""

from __future__ import annotations

import re

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="id string, pattern string, word string")
class GlossMatches:
    """``gloss_matches(TABLE(t), id column, text column, pattern, name)``: the first group of every match, as (id, name, word)."""

    def eval(self, row: Row, id_col: str, text_col: str, pattern: str, name: str):
        text = row[text_col]
        if text is not None:
            for m in re.finditer(pattern, text, re.ASCII):
                yield str(row[id_col]), name, m[1]


@udtf(returnType="listed string, id string")
class ExpandIds:
    """``expand_ids(TABLE(t), column)``: a row for each identifier of ``a et b``, ``a-b`` and ``a, b, c``; others as they are."""

    def eval(self, row: Row, column: str):
        listed = row[column]
        if listed is None:
            return
        span = re.fullmatch(r"([0-9]+)-([0-9]+)", listed.strip(" "))
        if span:
            a, b = int(span[1]), int(span[2])
            found = range(a, b + 1) if a <= b else range(a, b - 1, -1)
        else:
            found = (x for x in re.split(r"[ \t\n\x0b\f\r]*,[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+et[ \t\n\x0b\f\r]+", listed.strip(" ")) if x)
        for x in found:
            yield listed, str(x)


@udtf(returnType="part string, n bigint, longest string")
class LongestOf:
    """``longest_of(partition column, text column, TABLE(t) PARTITION BY column ORDER BY ...)``: of each partition its rows and its longest text, the first
    of equals in the order given; said when the partition ends, so only one text is held."""

    def __init__(self):
        self.part, self.n, self.longest = None, 0, None

    def eval(self, part_col: str, text_col: str, row: Row):
        self.part, self.n = row[part_col], self.n + 1
        if row[text_col] is not None and (self.longest is None or len(row[text_col]) > len(self.longest)):
            self.longest = row[text_col]

    def terminate(self):
        if self.n:
            yield None if self.part is None else str(self.part), self.n, self.longest


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, function in (("gloss_matches", GlossMatches), ("expand_ids", ExpandIds), ("longest_of", LongestOf)):
        spark.udtf.register(name, function)

"""Faceted search, sorting and paging, full-text match, keyword in context, structured queries."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contains_ci(col: str | Column, needle: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the needle are plain characters."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (F.col(col) if isinstance(col, str) else col).ilike(f"%{escaped}%")


def contains_any_ci(col: str, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.coalesce(contains_ci(col, n), F.lit(False))
    return out


def present(col: str) -> Column:
    """Neither null nor blank: both stand for absence."""
    return F.col(col).isNotNull() & (F.trim(F.col(col).cast("string")) != "")


def facets(
    df: DataFrame,
    contains: dict[str, str] | None = None,
    equals: dict[str, object] | None = None,
    at_least: dict[str, object] | None = None,
    at_most: dict[str, object] | None = None,
    has: dict[str, bool | None] | None = None,
) -> DataFrame:
    """Rows that meet every facet. ``has`` is tri-state: None skips, True wants a value, False wants none."""
    for c, v in (contains or {}).items():
        df = df.where(contains_ci(c, v))
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    for c, v in (at_least or {}).items():
        df = df.where(F.col(c) >= F.lit(v))
    for c, v in (at_most or {}).items():
        df = df.where(F.col(c) <= F.lit(v))
    for c, v in (has or {}).items():
        if v is not None:
            df = df.where(F.col(c).isNotNull() if v else F.col(c).isNull())
    return df


def ordered(df: DataFrame, sort: str, allowed: dict[str, str], id_col: str = "id") -> DataFrame:
    """Order by a name of ``allowed`` (to columns), descending with a leading dash; unknown names order by id. Nulls last
    ascending, first descending; ties by id."""
    down, name = sort.startswith("-"), sort.lstrip("-")
    if name not in allowed:
        return df.orderBy(F.asc(id_col))
    by = F.desc_nulls_first(allowed[name]) if down else F.asc_nulls_last(allowed[name])
    return df.orderBy(by, F.asc(id_col))


def page(df: DataFrame, limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an ordered frame; the limit is clamped to 1..``most``."""
    return df.offset(max(0, offset)).limit(max(1, min(limit, most)))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def by_ids(df: DataFrame, ids: DataFrame, id_col: str, ord_col: str) -> DataFrame:
    """Rows of the listed ids, in the list's order."""
    return df.join(ids, id_col).orderBy(ord_col)


def words(col: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def matches_all(tokens: Column, terms: list[str]) -> Column:
    """Every term is a token: the plain full-text query."""
    return F.forall(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.array_contains(tokens, t))


def web_query(tokens: Column, padded: Column, query: str) -> Column:
    """Web-style query: terms are anded, ``or`` joins alternatives, ``-term`` excludes, quotes hold a phrase.

    ``padded`` is the tokens joined by single blanks, with a blank before and after.
    """
    clauses: list[list[Column]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', query.lower()):
        if m[3] == "or":
            clauses.append([])
            continue
        minus, body = (m[1], m[2]) if m[3] is None else (("-", m[3][1:]) if m[3].startswith("-") else ("", m[3]))
        terms = [t for t in re.split(r"[^\w]+", body) if t]
        if not terms:
            continue
        hit = padded.contains(" " + " ".join(terms) + " ") if len(terms) > 1 else F.array_contains(tokens, terms[0])
        clauses[-1].append(~hit if minus else hit)
    out = F.lit(False)
    for c in clauses:
        if c:
            whole = c[0]
            for x in c[1:]:
                whole = whole & x
            out = out | whole
    return out


def term_rank(weighted: list[tuple[Column, float]], terms: list[str]) -> Column:
    """Sum over fields of weight times term occurrences over (1 + log of the field's length)."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    out = F.lit(0.0)
    for tokens, weight in weighted:
        hits = F.size(F.filter(tokens, lambda t: F.array_contains(wanted, t)))
        out = out + F.lit(weight) * hits / (1 + F.log1p(F.size(tokens)))
    return out


def lexical_score(tokens: Column, terms: list[str]) -> Column:
    """How alike a text's words and a query's are, whatever their number and order: twice the shared words over those of both."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(t.lower() for t in terms)])
    own = F.array_distinct(tokens)
    both = F.size(own) + F.size(wanted)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(own, wanted)) / both).otherwise(0.0)


def keyword_in_context(df: DataFrame, keyword: str, context: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Every occurrence, overlapping ones included, whatever the case: (id, position, left, hit, right), positions from 1."""
    n, text, key = len(keyword), F.col(text_col), keyword.lower()
    # a text is cut before each occurrence, so one pass finds them all and their places are sums of lengths
    # of the text as it stands, since lower case may be longer
    found = "(?iu)" + re.escape(key)
    parts = F.split(text, "(?iu)(?=" + re.escape(key) + ")")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x)).alias("at"), F.when((a["at"] > 0) | text.rlike("^" + found), F.concat(a["found"], F.array(a["at"] + 1))).otherwise(a["found"]).alias("found")
    )
    at = F.aggregate(parts, none, step, lambda a: a["found"])
    hits = df.where(text.rlike(found)).select(id_col, text_col, F.explode(at).alias("position"))
    p = F.col("position")
    return hits.select(
        id_col,
        "position",
        F.substring(text, F.greatest(p - context, F.lit(1)), F.least(p - 1, F.lit(context))).alias("left"),
        F.substring(text, p, F.lit(n)).alias("hit"),
        F.substring(text, p + n, F.lit(context)).alias("right"),
    )


def structured_query(queries: DataFrame, query_col: str, periods: dict[str, tuple[int, int]], markers: dict[str, str]) -> DataFrame:
    """Split query texts into a residual and filters: ``year_from``/``year_to`` span all period words found, and there is a
    boolean for each marker's flag. Words match whole, without case or outer punctuation."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    raw = F.filter(F.split(F.col(query_col), r"\s+"), lambda w: w != "")
    known = F.array(*[F.lit(k) for k in [*periods, *markers]])
    found = F.transform(raw, bare)

    def bound(k: int) -> Column:
        cases = F.array(*[F.when(F.array_contains(found, p), F.lit(y[k])) for p, y in periods.items()])
        return (F.array_min if k == 0 else F.array_max)(F.array_compact(cases))

    flags = {flag: F.lit(False) for flag in markers.values()}
    for word, flag in markers.items():
        flags[flag] = flags[flag] | F.array_contains(found, word)
    return queries.select(
        "*",
        F.array_join(F.filter(raw, lambda w: ~F.array_contains(known, bare(w))), " ").alias("residual"),
        bound(0).alias("year_from"),
        bound(1).alias("year_to"),
        *[c.alias(flag) for flag, c in flags.items()],
    )


def inverted_index(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(token, id, tf, first_position): write it bucketed by token to serve term lookups without scanning texts."""
    return (
        df.select(id_col, F.posexplode(words(text_col)).alias("pos", "token"))
        .groupBy("token", id_col)
        .agg(F.count("*").alias("tf"), F.min("pos").alias("first_position"))
    )


def with_unpaged_total(df: DataFrame) -> DataFrame:
    """Each row beside the number of all rows; the count is one row, so no window gathers the rows."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def first_per(df: DataFrame, keys: list[str], order: list[str], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep).drop("nth")

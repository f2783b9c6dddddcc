"""Gaps in texts filled by a character model: back-off probabilities of contexts, and a beam that meets them by joins."""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .ranks import fixed

#: What a character that a context lacks keeps of its chance in the next shorter one, and the chance of one never seen.
BACK, LEAST = 0.4, 1e-9
#: Different runs that a task holds before it says what it has counted.
MOST_RUNS = 1_000_000
#: A missing character in a text.
GAP = "\x00"


def _characters(text: Column) -> Column:
    """The characters of a text as an array, so that a place is found at once, however long the text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def contexts(df: DataFrame, text: str, order: int, by: list[str] | None = None) -> DataFrame:
    """(by..., context, next, n): how often each character follows each run of ``order``. A task counts what it reads, in batches of rows,
    and says each run once or, where it holds MOST_RUNS, now and then, so that no character becomes a row."""
    by = by or []
    spec = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in by), *T._parse_datatype_string("context string, next string, n bigint").fields])
    arrow = to_arrow_schema(spec)

    def work(batches):
        held: dict[tuple, Counter] = defaultdict(Counter)

        def said():
            for key, found in held.items():
                runs, n = list(found), list(found.values())
                columns = [*([v] * len(n) for v in key), [r for r, _ in runs], [c for _, c in runs], n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            held.clear()

        for batch in batches:
            for *key, t in zip(*(c.to_pylist() for c in batch.columns)):
                if t is not None and len(t) > order:
                    held[tuple(key)].update(zip((t[i : i + order] for i in range(len(t) - order)), t[order:]))
            if sum(map(len, held.values())) > MOST_RUNS:
                yield from said()
        yield from said()

    return df.select(*by, text).mapInArrow(work, spec).groupBy(*by, "context", "next").agg(F.sum("n").alias("n"))


def model(df: DataFrame, text: str, order: int) -> DataFrame:
    """(context, next, p) for runs of 0 to ``order`` characters: the share of ``next`` after the context. Texts are cut into runs once: the
    counts of a shorter run are sums over the longer ones that end with it, and one more at each text's beginning."""
    t = F.col(text)
    n = fixed(contexts(df, text, order))
    shares = []
    for o in range(order, -1, -1):
        total = n.groupBy("context").agg(F.sum("n").alias("total"))
        shares.append(n.join(total, "context").select("context", "next", (F.col("n") / F.col("total")).alias("p")))
        if o:
            shorter = n.select(F.substring("context", 2, o).alias("context"), "next", "n")
            begins = df.where(F.length(t) >= o).select(F.substring(t, 1, o - 1).alias("context"), F.substring(t, o, 1).alias("next")).groupBy("context", "next").agg(F.count("*").alias("n"))
            n = fixed(shorter.unionByName(begins).groupBy("context", "next").agg(F.sum("n").alias("n")))
    out = shares[0]
    for part in shares[1:]:
        out = out.unionByName(part)
    return fixed(out)


def _with_chance(df: DataFrame, known: DataFrame, order: int, before: Column, letter: str) -> DataFrame:
    """``df`` with ``_p``: the chance of a letter after what stands before it. Its contexts, of ``order`` characters and fewer, meet the model in one
    join, and the longest that is known decides. A row is itself again by its number."""
    numbered = fixed(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_before", before))
    run = lambda o: F.when(F.lit(o == 0), F.lit("")).otherwise(F.expr(f"right(_before, {o})"))
    tries = F.filter(F.array(*[F.when(F.length("_before") >= o, F.struct(F.lit(o).alias("o"), run(o).alias("context"))) for o in range(order + 1)]), lambda x: x.isNotNull())
    asked = numbered.select("_row", F.col(letter).alias("next"), F.explode(tries).alias("x")).select("_row", "next", "x.o", "x.context")
    found = asked.join(known, ["context", "next"]).groupBy("_row").agg(F.max(F.struct("o", "p")).alias("m"))
    chance = F.coalesce(F.col("m.p") * F.pow(F.lit(BACK), F.lit(order) - F.col("m.o")), F.lit(LEAST))
    return numbered.join(found, "_row", "left").withColumn("_p", chance).drop("_row", "_before", "m")


def restore(df: DataFrame, id_col: str, text: str, known: DataFrame, order: int, letters: list[str], best: int = 5, width: int = 16) -> DataFrame:
    """(id, rank, fills, score): for each text with gaps (``GAP``, one for each missing character) the ``best`` fillings, their characters in order
    of place, by the sum of logarithms of chances (:func:`model`) over the gaps and the ``order`` characters after each.

    All texts go on together, a place a step, each from its own first gap: a step with a gap opens every one of ``letters`` for each
    filling held, one with a character takes that alone, and the ``width`` highest of a text are held (of equals the lesser filling).
    With ``width`` of all fillings the result is exact. Steps are as many as the widest stretch from a text's first gap to
    ``order`` characters behind its last. Places between far gaps that no gap reaches are passed over. Ids must be unique;
    texts without gaps and null texts have no rows.
    """
    t = F.col(text)
    cut = df.where(t.contains(GAP)).select(F.col(id_col).alias("id"), _characters(t).alias("c"))
    places = F.filter(F.transform("c", lambda x, i: F.when(x == GAP, i + 1)), lambda i: i.isNotNull())
    cut = cut.withColumn("gaps", places)
    within = lambda low, high: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("gaps", lambda i: F.sequence(i + low, i + high))), lambda i: (i >= 1) & (i <= F.size("c")))))
    near = F.map_from_entries(F.transform(within(-order, order), lambda i: F.struct(i, F.get("c", i - 1))))  # all that a filling sees of its text
    rows = fixed(cut.select("id", near.alias("near"), "gaps", within(0, order).alias("steps")))
    steps = rows.agg(F.max(F.size("steps"))).first()[0] or 0
    held = rows.select("*", F.lit("").alias("fills"), F.lit(0.0).alias("score"))
    open_ = F.array(*[F.lit(x) for x in letters])
    for k in range(steps):
        at = F.try_element_at("steps", F.lit(k + 1))
        now = held.withColumn("_at", at)
        done, more = now.where("_at is null").drop("_at"), now.where("_at is not null")
        here = F.try_element_at("near", F.col("_at"))
        more = more.withColumn("_c", F.explode(F.when(here == GAP, open_).otherwise(F.array(here))))
        # what stands before, gaps filled: they take the fillings' characters in order
        span = F.transform(
            F.sequence(F.greatest(F.col("_at") - order, F.lit(1)), F.col("_at") - 1),
            lambda i: F.when(F.try_element_at("near", i) == GAP, F.substring("fills", F.array_position("gaps", i).cast("int"), F.lit(1))).otherwise(F.try_element_at("near", i)),
        )
        before = F.when(F.col("_at") > 1, F.array_join(span, "")).otherwise("")
        met = _with_chance(more, known, order, before, "_c")
        filled = F.when(here == GAP, F.concat("fills", "_c")).otherwise(F.col("fills"))
        met = met.select("id", "near", "gaps", "steps", filled.alias("fills"), (F.col("score") + F.ln("_p")).alias("score"))
        order_by = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "fills")  # at most width * letters rows
        met = met.withColumn("_n", F.row_number().over(order_by)).where(F.col("_n") <= width).drop("_n")
        held = fixed(met.unionByName(done))
    order_by = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "fills")
    ranked = held.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= best)
    return ranked.select(F.col("id").alias(id_col), "rank", "fills", "score")

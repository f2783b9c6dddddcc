"""Kinship and name graphs: closure, edges by context, exports as rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import fixed, running_sum


def descendants(seeds: DataFrame, edges: DataFrame, parent: str, child: str, most_depth: int | None = None) -> DataFrame:
    """(root, node, depth): all that is reached from each seed (column ``root``) over parent -> child edges, each at its least depth.

    Rounds join the newest nodes alone and drop those known, so cycles end; the frontier's emptiness is all that the driver learns.
    Rounds go on until it is empty; with ``most_depth``, an answer that would be cut there is an error.
    """
    found = seeds.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    newest = found
    step = edges.select(F.col(parent).alias("node"), F.col(child).alias("_next")).where("node is not null and _next is not null").distinct()
    depth = 0
    while True:
        depth += 1
        reached = newest.join(step, "node").select("root", F.col("_next").alias("node")).distinct()
        newest = reached.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        newest = fixed(newest)
        if newest.isEmpty():
            return found
        if most_depth is not None and depth > most_depth:
            raise ValueError(f"nodes lie deeper than {most_depth}")
        found = found.unionByName(newest)


def classes(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, class) of all nodes with a link: the least node that can be reached, itself included.

    Stars are contracted in turn: each node's larger neighbours, then its smaller ones, are linked to the least node it sees, until nothing
    changes; rounds grow with the logarithm of the longest chain. A round is three aggregations and joins of links, never more links
    than there were; a count and a checksum reach the driver. Links to oneself and null ends are left out, but the former name a node.
    """
    named = links.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.col(u).alias("u"), F.col(v).alias("v"))
    alone = named.where("u = v").select(F.col("u").alias("node")).distinct()
    now = fixed(named.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fixed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        larger = fixed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = fixed(larger.groupBy("u").agg(F.min("v").alias("m")))
        smaller = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = fixed(smaller.where("u <> v").distinct())
        size = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if size == seen:
            break
        seen = size
    found = now.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("class")))


def network(entities: DataFrame, relations: DataFrame, entity: str, source: str, target: str, around: DataFrame) -> DataFrame:
    """Edges that touch, at either end, the entities listed in ``around``, each once."""
    ids = around.select(entity).distinct()
    a = relations.join(ids.withColumnRenamed(entity, source), source, "left_semi")
    b = relations.join(ids.withColumnRenamed(entity, target), target, "left_semi")
    return a.unionByName(b).distinct()


def named_edges(relations: DataFrame, names: DataFrame, source: str, target: str, id_col: str, name_col: str) -> DataFrame:
    """Relations with both ends' names; a target without a name stays."""
    a = names.select(F.col(id_col).alias(source), F.col(name_col).alias("source_name"))
    b = names.select(F.col(id_col).alias(target), F.col(name_col).alias("target_name"))
    return relations.join(a, source).join(b, target, "left")


def numbered(df: DataFrame, order: str, prefix: str = "P", digits: int = 5, cut: bool = False) -> DataFrame:
    """``df`` with ids ``P00000``... in order: rows are ranged by ``order``, and a rank within each range adds to the ranges before. Numbers of
    more digits stay whole; with ``cut`` they keep their first ``digits``, as SQL's lpad has it, so ids repeat."""
    ranked = running_sum(df, [], [order], F.lit(1), "_r")
    number = (F.col("_r") - 1).cast("string")
    padded = F.lpad(number, digits, "0")
    made = F.concat(F.lit(prefix), padded if cut else F.when(F.length(number) < digits, padded).otherwise(number))
    return ranked.withColumn("person_id", made).drop("_r")


def parent_links(roles: DataFrame, person: str, gens: str, name: str, patronymic_stem: str) -> DataFrame:
    """(child, parent): the same gens, and the child's patronymic stem is the parent's first name; names of 3 letters or more."""
    child = roles.where(F.length(patronymic_stem) >= 3).select(F.col(person).alias("child"), gens, F.col(patronymic_stem).alias("_n"))
    parent = roles.where(F.length(name) >= 3).select(F.col(person).alias("parent"), gens, F.col(name).alias("_n"))
    return child.join(parent, [gens, "_n"]).where("child <> parent").select("child", "parent").distinct()


def entity_pairs(df: DataFrame, block: str, id_col: str, name: str, gender: str, least: float, semantic: float = 0.5, place: float = 1.0) -> DataFrame:
    """(a, b, score), a < b, of one block: 0.4 name + 0.4 semantic + 0.2 place; known and different genders veto the name part.

    Where a pair needs names alike to pass, only such names meet: equal ones, and those of one edit on what is left without a letter, each pair
    on one key; where more edits pass, names first meet by parts (:func:`within_edits`). Where all pairs pass, all are made.
    """
    from .edits import within_edits

    veto = F.col("_ga").isNotNull() & F.col("_gb").isNotNull() & (F.col("_ga") != F.col("_gb"))
    longest = F.greatest(F.length("_na"), F.length("_nb"), F.lit(1))

    def score(edits: Column) -> Column:
        return 0.4 * F.when(veto, 0.0).otherwise(1 - edits / longest) + 0.4 * semantic + 0.2 * place

    def side(id_as: str, n: str, g: str, *more: Column) -> DataFrame:
        return df.select(F.col(block).alias("_block"), F.col(id_col).alias(id_as), F.col(name).alias(n), F.col(gender).alias(g), *more)

    def passing(met: DataFrame, edits: Column) -> DataFrame:
        return met.where("a < b").select("a", "b", score(edits).alias("score")).where(F.col("score") > least)

    needed = (least - 0.4 * semantic - 0.2 * place) / 0.4  # likeness of names that a pair must exceed
    if needed < 1e-9:
        return passing(side("a", "_na", "_ga").join(side("b", "_nb", "_gb").hint("merge"), "_block"), F.levenshtein("_na", "_nb"))
    size = df.agg(F.min(F.length(name)).alias("low"), F.max(F.length(name)).alias("high")).first()
    most = math.floor((1 - needed) * max(size.high or 0, 1) + 1e-9)
    if most > 1:
        near = within_edits(df.select(F.col(name).alias("a")).where("a is not null").distinct(), df.select(F.col(name).alias("b")).where("b is not null").distinct(), most)
        near = near.where(1 - F.col("edits") / F.greatest(F.length("a"), F.length("b"), F.lit(1)) > needed - 1e-9).select(F.col("a").alias("_na"), F.col("b").alias("_nb"), "edits")
        there = df.select(F.col(block).alias("_block"), F.col(name).alias("_nb")).distinct()
        held = df.select(F.col(block).alias("_block"), F.col(name).alias("_na")).distinct().join(near.hint("merge"), "_na").join(there.hint("merge"), ["_block", "_nb"])
        met = side("a", "_na", "_ga").join(held.hint("merge"), ["_block", "_na"]).join(side("b", "_nb", "_gb").hint("merge"), ["_block", "_nb"])
        return passing(met, F.col("edits"))

    def keys(n: str, other: bool) -> Column:
        """(kind, at, letters): 0 for equal names; 1 for names without the letter at a place; 2 and 3 for a longer name of a or b, less a letter."""
        key = lambda kind, at, letters: F.struct(F.lit(kind).alias("kind"), at.alias("at"), letters.alias("letters"))
        nowhere, places = F.lit(0), F.when(F.length(n) > 0, F.sequence(F.lit(1), F.length(n))).otherwise(F.array().cast("array<int>"))
        without = F.transform(places, lambda i: F.concat(F.substring(F.col(n), F.lit(1), i - 1), F.substring(F.col(n), i + 1, F.length(n))))
        made = [F.array(key(0, nowhere, F.col(n)))]
        if most == 1:
            made.append(F.transform(without, lambda w, i: key(1, i, w)))
            if size.low != size.high:
                shorter = F.transform(F.array_distinct(without), lambda w: key(3 if other else 2, nowhere, w))
                made += [shorter, F.array(key(2 if other else 3, nowhere, F.col(n)))]
        return F.explode(F.concat(*made)).alias("_key")

    a = side("a", "_na", "_ga", keys(name, False)).where("_na is not null")
    b = side("b", "_nb", "_gb", keys(name, True)).where("_nb is not null")
    flat = lambda x: x.select("*", "_key.*").drop("_key")
    met = flat(a).join(flat(b).hint("merge"), ["_block", "kind", "at", "letters"]).where((F.col("kind") != 1) | (F.col("_na") != F.col("_nb")))
    return passing(met, F.when(F.col("kind") == 0, 0).otherwise(1))

"""Exact cosine joins over sparse vectors: pairs above a threshold, and the nearest neighbours (JOIN5, SNK6).

Input is the long form (item, term, weight). Items with equal vectors form one class
that takes part once, under its smallest item; ``vector_classes`` lists the members, so
copies are never expanded into pairs.

Terms are ordered by how many classes hold them, rarest first. Two unit vectors whose
cosine reaches t must share a term within their prefixes: the leading terms up to the
point where what remains has a norm below t (if they shared none, all shared terms would
lie in the remainder of the one whose prefix ends first, and their product would stay
below t). Prefixes meet by an equi-join on the term; a pair whose product over the
prefixes plus that remainder stays below t is dropped, the others are scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize as write_once

#: Slack of the bounds for sums of doubles; cosines are compared after rounding to DIGITS.
EPS = 1e-9
DIGITS = 9
#: Thresholds at which neighbours are looked for, until everyone has enough of them.
STEPS = (0.9, 0.6, 0.3, 0.0)


@dataclass
class Vectors:
    """Classes of equal vectors: ``members`` (item, rep), ``reps`` (rep, n_members, vec) and ``terms`` (rep, term, w, place,
    tail): unit weights, the term's place in the rarest-first order, the norm of the vector from there on."""

    members: DataFrame
    reps: DataFrame
    terms: DataFrame


def vector_classes(weights: DataFrame, item_col: str = "doc_id", materialize: bool = True) -> Vectors:
    """Vectors with no weight other than 0 have no direction and take no part."""
    keep = write_once if materialize else (lambda df: df)
    long = weights.select(F.col(item_col).alias("item"), "term", "weight").where("weight <> 0 and item is not null and term is not null")
    entries = F.sort_array(F.collect_list(F.struct("term", F.round("weight", 12).alias("weight"))))  # as long as the vocabulary at most
    signed = long.groupBy("item").agg(entries.alias("e")).withColumn("sign", F.md5(F.to_json("e")))
    reps = signed.groupBy("sign").agg(F.min("item").alias("rep"), F.count(F.lit(1)).alias("n_members"), F.first("e").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]))
    unit = F.transform("e", lambda x: F.struct(x["term"].alias("term"), (x["weight"] / norm).alias("w")))
    reps = keep(reps.select("sign", "rep", "n_members", unit.alias("e")))
    members = signed.select("item", "sign").join(reps.select("sign", "rep"), "sign").select("item", "rep")
    flat = reps.select("rep", F.inline("e"))
    n = flat.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct("n", "term").alias("place")
    onward = Window.partitionBy("rep").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    terms = flat.join(n, "term").select("rep", "term", "w", place).withColumn("tail", F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward)))
    return Vectors(members, reps.select("rep", "n_members", F.map_from_entries("e").alias("vec")), keep(terms))


def _prefixes(terms: DataFrame, threshold: float, side: str) -> DataFrame:
    """Prefix terms at the threshold, with the place where the prefix ends and the norm of what follows it."""
    whole = Window.partitionBy("rep")
    inside = F.col("tail") >= threshold - EPS
    rows = terms.withColumn("rest", F.coalesce(F.max(F.when(~inside, F.col("tail"))).over(whole), F.lit(0.0)))
    rows = rows.withColumn("last", F.max(F.when(inside, F.col("place"))).over(whole)).where(inside)
    return rows.select("term", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "w", "rest", "last")])


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col(b), e["key"]), F.lit(0.0)))


def _pairs(v: Vectors, threshold: float, left: DataFrame | None = None) -> DataFrame:
    """(rep_a, rep_b, cosine) with rep_a < rep_b; with ``left`` (rep), the pairs of those with all, rep_a from ``left``."""
    mine = v.terms if left is None else v.terms.join(left, "rep", "left_semi")
    a, b = _prefixes(mine, threshold, "a"), _prefixes(v.terms, threshold, "b")
    met = a.join(b, "term").where("rep_a < rep_b" if left is None else "rep_a <> rep_b")
    rest = F.max(F.when(F.col("last_a") <= F.col("last_b"), F.col("rest_a")).otherwise(F.col("rest_b")))
    bound = met.groupBy("rep_a", "rep_b").agg((F.sum(F.col("w_a") * F.col("w_b")) + rest).alias("most"))
    near = bound.where(F.col("most") >= threshold - EPS).select("rep_a", "rep_b")
    for side in ("a", "b"):
        near = near.join(v.reps.select(F.col("rep").alias(f"rep_{side}"), F.col("vec").alias(f"vec_{side}")), f"rep_{side}")
    scored = near.select("rep_a", "rep_b", F.round(_dot("vec_a", "vec_b"), DIGITS).alias("cosine"))
    return scored.where(F.col("cosine") >= threshold)


def similar_pairs(v: Vectors, threshold: float) -> DataFrame:
    """(item_a, item_b, cosine, members_a, members_b): all pairs of different vectors whose cosine reaches the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    out = _pairs(v, threshold)
    for side in ("a", "b"):
        out = out.join(v.reps.select(F.col("rep").alias(f"rep_{side}"), F.col("n_members").alias(f"members_{side}")), f"rep_{side}")
    return out.select(F.col("rep_a").alias("item_a"), F.col("rep_b").alias("item_b"), "cosine", "members_a", "members_b")


def top_neighbours(v: Vectors, k: int) -> DataFrame:
    """(item, rank, neighbour, cosine): the k nearest other vectors of each vector that have a cosine above 0 (nearest first,
    ties by smaller item). Thresholds fall step by step; who has k neighbours at one of them is done."""
    order = Window.partitionBy("rep_a").orderBy(F.desc("cosine"), "rep_b")
    open_, done = v.reps.select("rep"), None
    for step in STEPS:
        found = write_once(_pairs(v, step, open_).where("cosine > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        full = found.where(F.col("rank") == k).select(F.col("rep_a").alias("rep")) if step > STEPS[-1] else open_
        part = found.join(full.withColumnRenamed("rep", "rep_a"), "rep_a", "left_semi")
        done = part if done is None else done.unionByName(part)
        if step > STEPS[-1]:
            open_ = write_once(open_.join(full, "rep", "left_anti"))
    return done.select(F.col("rep_a").alias("item"), "rank", F.col("rep_b").alias("neighbour"), "cosine")

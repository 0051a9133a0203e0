"""Small tables with the awkward cases that every training-data operator must define."""

import random

SCHEMA = "doc_id long, text string, chunk string, sha int, block long, node string, label string, slot double"
WORDS = "the of and a in to is was river stone cloud market garden window letter north quiet silver paper bridge".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "ing", "ed", "s"]) for _ in range(n))


def awkward(spark, more=()):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    base = prose(120, 1)
    rows = [(1, base), (2, base), (1, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None), (6, "short"),
            (7, prose(30_000, 2)), (8, "é" * 70 + " ü" * 40), (9, base.upper()), (10, "a b\x00c " * 40), *more]
    full = [(i, t, "x", 1, None, None, "y", 0.5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

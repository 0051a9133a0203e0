"""Substring and regular-expression search over many texts, by a trigram posting index (FLT4).

The index lists every text under each of its distinct substrings of one, two and
three characters and under the empty one: at most three rows a character, so it
grows linearly with the texts. A search term probes the single rarest of its own
grams by an equi-join and the texts found there are compared with the term itself.
A regular expression probes the literal that every match must hold (one for each
top-level alternative); where none can be told, it probes the empty gram, so each
search is one equi-join that Spark can split, never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize as write_once

GRAM = 3
_CUT = "\u0001"
#: Escapes of more than one character first, then any escaped character.
_ESCAPE = (r"(?s)\\(?:[pP]\{[^}]*\}|[pP].|x\{[^}]*\}|x..|u....|0[0-7]{1,3}|c.|k<[^>]*>|N\{[^}]*\}|[0-9]+|.)")
#: Inline flags change what a literal means; quoted parts and classes that hold a bracket are not looked into.
_OPAQUE = r"\(\?[a-zA-Z-]+[):]|\\Q|\[\^?\]|" + _CUT
_NESTING = 8


def _grams(c: Column, n: int) -> Column:
    """Substrings of n characters, in one pass over the characters."""
    chars = F.split(c, "")
    chars = F.filter(chars, lambda x: x != "")
    every = F.transform(chars, lambda x, i: F.concat(x, *[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, n)]))
    return F.slice(every, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))


def build_index(texts: DataFrame, text_col: str = "text", materialize: bool = True) -> DataFrame:
    """(gram, text): the posting rows of all distinct, non-null texts."""
    rows = texts.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    postings = rows.select(F.explode(keys).alias("gram"), "text")
    return write_once(postings) if materialize else postings


def _probes(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``terms`` (distinct rows with a column ``literal``) with the rarest gram of the literal; literals with a gram that no
    text has are left out."""
    keys = terms.columns
    n = F.char_length("literal")
    own = F.when(n < GRAM, F.array("literal")).otherwise(F.array_distinct(_grams(F.col("literal"), GRAM)))
    grams = terms.withColumn("gram", F.explode(own))
    counts = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = grams.join(counts, "gram", "left").groupBy(*keys).agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    return found.where("rarest.n > 0").select(*keys, F.col("rarest.gram").alias("gram"))


def containing(index: DataFrame, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, text) of every text that contains the term; the empty term is in all of them, a null one in none."""
    asked = terms.select(F.col(term_col).alias("term")).where("term is not null").distinct().withColumn("literal", F.col("term"))
    hits = _probes(asked, index).join(index, "gram")
    return hits.where(F.contains("text", "term")).select("term", "text")


def required_literals(pattern: Column) -> Column:
    """One literal for each top-level alternative of a regular expression, each held by every match of that alternative; a
    single empty literal if one of them has none. Groups, classes, escapes, wildcards and optional characters are cut out."""
    p = F.regexp_replace(pattern, _ESCAPE, _CUT)
    for _ in range(2):  # a class may hold another one
        p = F.regexp_replace(p, r"\[[^\[\]]*\]", _CUT)
    for _ in range(_NESTING):
        p = F.regexp_replace(p, r"\([^()]*\)", _CUT)
    opaque = F.rlike(pattern, F.lit(_OPAQUE)) | F.rlike(p, F.lit(r"[\[\]()]"))
    p = F.regexp_replace(p, r"(?s).(?:[?*]|\{[^}]*\})[?+]?", _CUT)
    p = F.regexp_replace(p, r"[.^$+?*{}]", _CUT)
    longest = F.transform(F.split(p, r"\|", -1), lambda b: F.reduce(
        F.split(b, _CUT, -1), F.lit(""), lambda best, x: F.when(F.char_length(x) > F.char_length(best), x).otherwise(best)))
    return F.when(opaque | F.exists(longest, lambda x: x == ""), F.array(F.lit(""))).otherwise(F.array_distinct(longest))


def matching(index: DataFrame, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """(pattern, text) of every text in which the regular expression finds a match; the empty pattern finds one in all."""
    asked = patterns.select(F.col(pattern_col).alias("pattern")).where("pattern is not null").distinct()
    asked = asked.withColumn("literal", F.explode(required_literals(F.col("pattern"))))
    hits = _probes(asked, index).select("pattern", "gram").distinct().join(index, "gram")
    return hits.where(F.rlike("text", F.col("pattern"))).select("pattern", "text").distinct()

"""Text features: tokenizer, document text of an item, TF-IDF as a long table (FEA8, FEA10).

TF-IDF follows the usual smoothed definition: lower-cased tokens of two or
more word characters, a vocabulary of the ``max_features`` most frequent
terms over the corpus (ties by term), idf = ln((1 + n) / (1 + df)) + 1,
weight = count * idf, then L2 normalisation per document.

Scale notes: corpus counts are grouped by term with map-side combine, so a term
present in a third of all texts costs one partial row per task. The vocabulary is
a distributed top-k of bounded size (``max_features``) and is the only broadcast
side. Only its tokens move, once, by document; counts, document frequencies and
norms are taken from that one exchange. A document's rows are bounded by the
vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize

# Fixed value: a token is a run of at least two word characters (letters, digits, underscore).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 500


def tokens(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


# FEA10
def item_text(cols: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def exploded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term), one row per token."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(text)).alias("term"))


def top_terms(docs: DataFrame, doc_id: str, text: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` terms with the largest corpus counts (ties by term)."""
    counts = exploded(docs, doc_id, text).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return counts.orderBy(F.desc("cf"), "term").limit(max_features).select("term")


def term_counts(docs: DataFrame, doc_id: str, text: str, terms: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of the listed terms. Tokens outside the list are dropped before anything moves;
    the rest move once, by document, and every later step per document finds them there."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = exploded(docs, doc_id, text).join(F.broadcast(terms), "term")  # bounded by max_features
    return known.repartition(parts, "doc_id").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequencies(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) of the terms in ``tf``."""
    held = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return held.select("term", (F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weigh(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, weight) — L2-normalised tf*idf over in-vocabulary terms."""
    v = F.broadcast(vocab.select("term", "idf"))  # bounded by max_features
    raw = tf.join(v, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def tfidf(docs: DataFrame, doc_id: str, text: str, max_features: int = MAX_FEATURES):
    """Fit on ``docs`` and return (weights, vocabulary).

    The term list (at most ``max_features`` rows) is found first and written; it moves one
    partial row per term and task. The second pass counts the listed terms of each document;
    document frequencies and weights read the same exchange, which Spark writes once."""
    ensure_checkpoint_dir(docs.sparkSession)
    terms = materialize(top_terms(docs, doc_id, text, max_features))
    tf = term_counts(docs, doc_id, text, terms)
    vocab = inverse_frequencies(tf, docs.count())
    return weigh(tf, vocab), vocab

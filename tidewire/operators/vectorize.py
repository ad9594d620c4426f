"""Terms and TF-IDF weights as tidy tables, and as MLlib vectors.

Tokens are words of 2 characters or more of the cleaned text; terms are tokens and pairs of neighbouring tokens. A term
is kept if it is in ``min_df`` documents at least and in ``max_df`` of all documents at most; of these the ``most``
frequent (ties: alphabetical) are the vocabulary, a table of at most ``most`` rows, which is what gets broadcast.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text

MIN_DF, MAX_DF, MOST_TERMS = 2, 0.8, 3000


def tokens(clean: Column | str) -> Column:
    return F.filter(F.split(clean, " "), lambda t: F.length(t) >= 2)


def terms_of(clean: Column | str) -> Column:
    """Tokens, then pairs of neighbours joined by a space."""

    def both(one: Column) -> Column:
        n = F.greatest(F.size(one) - 1, F.lit(0))
        return F.concat(one, F.zip_with(F.slice(one, F.lit(1), n), F.slice(one, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))

    # a lambda's variable is evaluated once, an expression wherever it stands
    return F.transform(F.array(tokens(clean)), both)[0]


def term_counts(docs: DataFrame, clean: str = "contenido_limpio") -> DataFrame:
    """(doc_idx, term, tf). The documents are partitioned by doc_idx once; counting then needs no further shuffle, nor
    does the norm over a document's terms."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_idx", clean).repartition(n, "doc_idx").select("doc_idx", F.explode(terms_of(F.col(clean))).alias("term"))
    return rows.groupBy("doc_idx", "term").agg(F.count("*").alias("tf"))


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, df, ctf)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))


def vocabulary(stats: DataFrame, n_docs: int, min_df: int = MIN_DF, max_df: float = MAX_DF, most: int = MOST_TERMS) -> DataFrame:
    """(term, df, ctf, idf): at most ``most`` rows, by a top-k without a full sort."""
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).orderBy(F.desc("ctf"), "term").limit(most)
    return kept.withColumn("idf", idf(F.col("df"), n_docs))


def idf(df: Column, n_docs: int) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_idx, term, tf, weight), weights of length 1 for each document. ``vocab`` has a bounded number of rows."""
    raw = counts.join(F.broadcast(vocab.select("term", "idf")), "term").select("doc_idx", "term", "tf", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("doc_idx")))  # a document's terms, one shuffle
    return raw.select("doc_idx", "term", "tf", (F.col("raw") / norm).alias("weight"))


class Tfidf:
    """A fitted vocabulary, and what it makes of documents."""

    def __init__(self, docs: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF, most: int = MOST_TERMS) -> None:
        self.docs = docs if "contenido_limpio" in docs.columns else docs.withColumn("contenido_limpio", clean_text("contenido"))
        self.counts = term_counts(self.docs).persist()
        self.n_docs = docs.count()
        self.vocab = vocabulary(term_stats(self.counts), self.n_docs, min_df, max_df, most).persist()

    def weights(self) -> DataFrame:
        return tfidf(self.counts, self.vocab)

    def vectors(self) -> tuple[DataFrame, list[str]]:
        """(doc_idx, features: sparse vector of length 1) and the vocabulary in order; counting, scaling and norming
        are MLlib's, in the JVM."""
        rows = sorted(self.vocab.select("term", "ctf", "idf").collect(), key=lambda r: (-r["ctf"], r["term"]))
        words = [r["term"] for r in rows] or [""]
        counted = CountVectorizerModel.from_vocabulary(words, "terms", "counts").transform(self.docs.select("doc_idx", terms_of(F.col("contenido_limpio")).alias("terms")))
        scaled = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows] or [0.0]), inputCol="counts", outputCol="raw").transform(counted)
        normed = Normalizer(p=2.0, inputCol="raw", outputCol="features").transform(scaled)
        return normed.select("doc_idx", "features"), words

    def close(self) -> None:
        self.counts.unpersist()
        self.vocab.unpersist()

"""Corpus statistics: document frequencies, term frequencies and TF-IDF."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import fresh, sized


def term_rows(docs: DataFrame, terms: str = "tokens", key: str = "doc_id") -> DataFrame:
    """``(key, term)``, a row per occurrence."""
    return docs.select(key, F.explode(terms).alias("term"))


def document_count(docs: DataFrame) -> DataFrame:
    """One row ``n_docs``; documents without terms count."""
    return docs.agg(F.count("*").alias("n_docs"))


def doc_freq(docs: DataFrame, terms: str = "tokens", key: str = "doc_id") -> DataFrame:
    """``(term, df)``: in how many documents each term occurs."""
    return docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_freq(docs: DataFrame, terms: str = "tokens", key: str = "doc_id") -> DataFrame:
    """``(key, term, tf)``: how often each term occurs in each document; a row is a document.

    Runs of equal terms are counted in the sorted row, so nothing is exchanged.
    """
    s, b, e = fresh(docs.select(key), "sorted", "begins", "entry")
    rows = docs.select(key, F.array_sort(terms).alias(s))
    first = F.transform(s, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(s, i - 1)), i))
    rows = rows.select(key, s, F.filter(first, lambda i: i.isNotNull()).alias(b))
    entry = F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    return rows.select(key, F.explode(entry).alias(e)).select(key, f"{e}.term", f"{e}.tf")


def frequencies(docs: DataFrame, terms: str = "tokens", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``term_freq`` and ``doc_freq`` of the same documents, the second counted from the first."""
    tf = term_freq(docs, terms, key)
    return tf, tf.groupBy("term").agg(F.count("*").alias("df"))


def add_documents(df: DataFrame, n_docs: int, docs: DataFrame, terms: str = "tokens", compat: bool = False) -> tuple[DataFrame, Column]:
    """Document frequencies and number with further documents added.

    With ``compat`` the new documents' occurrences are counted, not the documents.
    """
    own = F.col(terms) if compat else F.array_distinct(terms)
    new = docs.select(F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    both = df.select("term", "df").unionByName(new).groupBy("term").agg(F.sum("df").alias("df"))
    return both, document_count(docs).select((F.col("n_docs") + n_docs).alias("n_docs"))


def term_counts(df: DataFrame, terms: DataFrame) -> DataFrame:
    """The document frequency of each asked-for ``term``, 0 for unknown ones."""
    return terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def idf_value(n_docs, df) -> Column:
    """``ln((1 + N) / (2 + df))``: negative for a term of every document."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(2.0) + df))


def idf(df: DataFrame, counts: DataFrame) -> DataFrame:
    """``(term, df, idf)``; ``counts`` is the one-row ``n_docs``."""
    return df.crossJoin(F.broadcast(counts)).select("term", "df", idf_value(F.col("n_docs"), F.col("df")).alias("idf"))


def tf_idf(tf: DataFrame, df: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, term, weight)``; a term that the corpus hasn't has document frequency 0.

    The frequencies are counted first; where they are small enough to be sent to
    all tasks, the documents' terms are not exchanged.
    """
    rows = tf.join(sized(df), "term", "left").crossJoin(F.broadcast(counts))
    return rows.select(key, "term", (F.col("tf") * idf_value(F.col("n_docs"), F.coalesce("df", F.lit(0)))).alias("weight"))

"""The transforms on streams.

Tokenizing, pattern extraction, and tagging by perceptrons and by dictionaries of
at most ``taggers.SMALL`` terms keep no state, so they run on a streaming
DataFrame as they are. Chunk features, chunks and larger dictionaries need
windows or joins over sentences, which a stream has not: use them in
``foreachBatch``. Corpus frequencies are kept by a complete-mode aggregate.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def tokens(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with ``tokens``."""
    return stream.withColumn("tokens", X.tokenize(text))


def doc_freq(stream: DataFrame, terms: str = "tokens") -> DataFrame:
    """``(term, df)`` so far; write it in complete mode."""
    return stream.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def keep_doc_freq(stream: DataFrame, name: str, checkpoint: str, terms: str = "tokens") -> StreamingQuery:
    """Keeps the frequencies in a table in memory of the given name; the caller stops the query."""
    return doc_freq(stream, terms).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()

"""Packing of documents into batches by optimal length buckets.

The global histogram of token lengths decides the bucket boundaries: dynamic
programming finds the at most ``buckets`` boundaries that make the padding of
all documents least, when each is padded to the boundary of its bucket. Inside
a bucket, documents in the order of doc_id fill batches of ``budget`` tokens,
``max(1, budget // boundary)`` documents a batch.

Only the histogram, whose size follows the longest text and not the number of
texts, and a count for each bucket and range of documents come to the driver.
The place of a document within its bucket is the count of the bucket's documents
in earlier ranges plus its place in its own range. The ranges are of equal size
however the ids are spread, and also within one id, so no task holds a whole
bucket.

Null text counts as empty; an empty text has length 0 and is packed as if of
length 1. Rows with a null doc_id are left out. Repeated ids are packed once
per row; rows equal in doc_id and length can change places. An empty table gives
no rows. A text longer than the budget makes a batch of its own, whole. Other
columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._tokens import VOCABULARY, encoder

BUCKETS, BUDGET = 16, 16384
PACKED = "doc_id long, n_tokens long, bucket int, boundary long, batch long"


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document."""

    def run(batches):
        for part in X.slices(batches, chars=2 * X.CHARS):
            codes, offs = X.flat(part.column(1).to_pylist())
            n = encoder(vocabulary).lengths(codes, offs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, n_tokens long")


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The boundaries of least padding: ``lengths`` ascending and distinct, each with its count.

    ``best[j] = min_i best[i] + pad(i, j)`` over one bucket more, where ``pad``
    pads the lengths from ``i`` to ``j`` to the last of them. As a function of
    ``i`` this is a line in that length, so a lower hull gives each layer in
    linear time. Integers throughout; of equal choices the earliest is taken.
    """
    n = len(lengths)
    if not n:
        return []
    c, s = [0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        c[i + 1], s[i + 1] = c[i] + counts[i], s[i] + counts[i] * lengths[i]
    best = [0] + [lengths[j - 1] * c[j] - s[j] for j in range(1, n + 1)]
    choice = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        nxt, came = best[:], [0] * (n + 1)
        hull: list[int] = []
        front = 0

        def icpt(i):
            return best[i] + s[i]

        for j in range(2, n + 1):
            k = j - 1  # the line of i = k, of slope -c[k], may be used from now on
            while len(hull) - front >= 2 and (icpt(k) - icpt(hull[-2])) * (c[hull[-1]] - c[hull[-2]]) <= (icpt(hull[-1]) - icpt(hull[-2])) * (c[k] - c[hull[-2]]):
                hull.pop()
            hull.append(k)
            front = min(front, len(hull) - 1)
            x = lengths[j - 1]
            while front + 1 < len(hull) and icpt(hull[front + 1]) - x * c[hull[front + 1]] < icpt(hull[front]) - x * c[hull[front]]:
                front += 1
            i = hull[front]
            nxt[j], came[j] = icpt(i) - x * c[i] + x * c[j] - s[j], i
        if nxt[n] >= best[n]:
            break
        best = nxt
        choice.append(came)
    out, j = [], n
    for came in reversed(choice):
        out.append(lengths[j - 1])
        j = came[j]
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, bucket, boundary, batch)``; batches are numbered from 0 in each bucket."""
    spark = docs.sparkSession
    sized = X.cut(token_lengths(docs, vocabulary)).withColumn("size", F.greatest("n_tokens", F.lit(1)))
    hist = sized.groupBy("size").count().orderBy("size").collect()
    edges = boundaries([r[0] for r in hist], [r[1] for r in hist], buckets)
    if not edges:
        return spark.createDataFrame([], PACKED)
    bucket = F.lit(0)
    for e in edges[:-1]:
        bucket = bucket + (F.col("size") > e).cast("int")
    put = sized.select("doc_id", "n_tokens", bucket.alias("bucket"), F.monotonically_increasing_id().alias("row"))
    order = ["bucket", "doc_id", "n_tokens", "row"]
    ranges = X.cut(put.repartitionByRange(X.partitions(spark), *order).sortWithinPartitions(*order).select(*order[:3], F.spark_partition_id().alias("part")))
    before, total = {}, [0] * len(edges)
    for p, k, n in ranges.groupBy("part", "bucket").count().orderBy("part", "bucket").toLocalIterator():
        before[p, k], total[k] = total[k], total[k] + n
    sent = spark.sparkContext.broadcast(before)
    edge = np.array(edges, np.int64)

    def number(batches):
        held: dict[int, int] = {}
        for b in batches:
            k, part = b.column(0).to_numpy(), b.column(3)
            if not len(k):
                continue
            place = np.empty(len(k), np.int64)
            for x in np.unique(k).tolist():
                own = np.flatnonzero(k == x)
                first = held.get(x, sent.value[part[0].as_py(), x])
                place[own] = first + np.arange(len(own))
                held[x] = first + len(own)
            limit = edge[k]
            batch = place // np.maximum(1, budget // limit)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(limit), pa.array(batch)], ["doc_id", "n_tokens", "bucket", "boundary", "batch"])

    return ranges.select("bucket", "doc_id", "n_tokens", "part").mapInArrow(number, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(X.read(spark, sf_dir, "documents"))

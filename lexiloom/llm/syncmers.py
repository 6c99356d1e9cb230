"""Document fingerprints by closed syncmers.

A k-mer of a text is a closed syncmer if the least of its s-mers, by a hashed
order, is its first or its last. Whether a k-mer is chosen depends on its own
characters alone, so equal passages give equal anchors whatever surrounds them,
and two chosen neighbours are at most ``k - s`` characters apart unless ties
are involved (ties choose more, never fewer).

The order is ``(h * 1103515245 + 12345) mod P`` where ``h`` is the s-mer's
polynomial hash mod ``P = 2^31 - 1``; the fingerprint has 62 bits made of the
hashes of the k-mer's ``k / s`` disjoint s-mers. Both can be written in SQL.

A text without a closed syncmer (each below ``k`` characters, some up to
``2 k - s``) has one anchor: position 0 and a fingerprint of all its characters,
so that short copies are found too.

Null text or null doc_id and empty texts give no rows; very long texts are read
whole. Repeated rows give repeated anchors. An empty table gives no rows. Other
columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

K, S = 44, 4
P, B, C1, C2 = 2147483647, 1000003, 69069131, 16807003


def _hashes(codes: np.ndarray, s: int) -> np.ndarray:
    """Polynomial hash mod P of every s-mer; s is a power of two."""
    h, base, width = codes.astype(np.int64) % P, B, 1
    while width < s:
        h = (h[:-width] * base + h[width:]) % P
        base, width = base * base % P, width * 2
    return h


def anchors_of(codes: np.ndarray, offs: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, position, fingerprint) of the closed syncmers of flat texts, or of a whole text that has none."""
    doc, pos, fp = _syncmers(codes, offs, k, s)
    bare = np.flatnonzero((np.bincount(doc, minlength=len(offs) - 1) == 0) & (np.diff(offs) > 0))
    whole = []
    for d in bare.tolist():
        one = two = 0
        for c in codes[offs[d] : offs[d + 1]].tolist():
            one, two = (one * C1 + c) % P, (two * C2 + c) % P
        whole.append(one << 31 | two)
    order = np.argsort(np.append(doc, bare), kind="stable")
    return tuple(np.append(x, y)[order] for x, y in ((doc, bare), (pos, np.zeros(len(bare), np.int64)), (fp, np.array(whole, np.int64))))


def _syncmers(codes: np.ndarray, offs: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(codes) < k:
        z = np.zeros(0, np.int64)
        return z, z, z
    h = _hashes(codes, s)
    order = ((h * 1103515245 + 12345) % P).astype(np.int32)
    w = k - s + 1
    low, width = order, 1
    while width * 2 <= w:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if width < w:
        low = np.minimum(low[: len(order) - w + 1], low[w - width :])
    at = np.flatnonzero((low == order[: len(low)]) | (low == order[w - 1 :]))
    doc = np.searchsorted(offs, at, "right") - 1
    inside = at + k <= offs[doc + 1]
    at, doc = at[inside], doc[inside]
    one = two = np.zeros(len(at), np.int64)
    for j in range(0, k, s):
        one, two = (one * C1 + h[at + j]) % P, (two * C2 + h[at + j]) % P
    return doc, at - offs[doc], one * (1 << 31) + two


def syncmers(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row ``(doc_id, pos, fingerprint)`` per anchor of each text; ``pos`` counts characters from 0."""
    if s & (s - 1) or k % s or k <= s:
        raise ValueError("s must be a power of two and k a larger multiple of it")

    def run(batches):
        for part in X.slices(batches):
            codes, offs = X.flat(part.column(1).to_pylist())
            doc, pos, fp = anchors_of(codes, offs, k, s)
            yield pa.RecordBatch.from_arrays([pa.array(X.ids(part.column(0))[doc]), pa.array(pos.astype(np.int32)), pa.array(fp)], ["doc_id", "pos", "fingerprint"])

    return X.usable(docs, "doc_id", "text").mapInArrow(run, "doc_id long, pos int, fingerprint long")


def match_positions(queries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Positional matching: ``(left_id, right_id, shift, anchors)``, the anchors that a stated set of query documents shares with others at each shift of positions.

    Repeated anchors of a document are counted once at each position. Anchors
    that stand in many documents are split by the adaptive join.
    """
    a = queries.select(F.col("doc_id").alias("left_id"), F.col("pos").alias("p"), "fingerprint").distinct()
    b = anchors.select(F.col("doc_id").alias("right_id"), F.col("pos").alias("q"), "fingerprint").distinct()
    return a.join(b, "fingerprint").filter("left_id <> right_id").groupBy("left_id", "right_id", (F.col("q") - F.col("p")).alias("shift")).agg(F.count("*").alias("anchors"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers(X.read(spark, sf_dir, "documents"))


def sql(k: int = K, s: int = S) -> str:
    """The same rows by windows over one row per character."""
    w, over = k - s + 1, "OVER (PARTITION BY doc_id, rid ORDER BY pos)"
    horner = "c"
    for j in range(1, s):
        horner = f"(({horner}) * {B} + lead(c, {j}) {over}) % {P}"
    one = two = "0"
    for j in range(0, k, s):
        h = f"lead(h, {j}) {over}"
        one, two = f"(({one}) * {C1} + {h}) % {P}", f"(({two}) * {C2} + {h}) % {P}"
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, length(text) AS n, regexp_extract_all(text, '(?s).') AS cs FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT doc_id, rid, n, unnest(range(len(cs))) AS pos, CAST(unicode(unnest(cs)) AS BIGINT) AS c FROM t),
x AS (SELECT doc_id, rid, list_transform(cs, lambda y: CAST(unicode(y) AS BIGINT)) AS xs FROM t WHERE n BETWEEN 1 AND {2 * k}),
h AS (SELECT doc_id, rid, n, pos, {horner} AS h FROM c),
o AS (SELECT *, (h * 1103515245 + 12345) % {P} AS o FROM h),
m AS (SELECT doc_id, rid, n, pos, o, min(o) OVER (PARTITION BY doc_id, rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS low, lead(o, {w - 1}) {over} AS last, ({one}) * 2147483648 + ({two}) AS fingerprint FROM o),
f AS (SELECT doc_id, rid, pos, fingerprint FROM m WHERE pos + {k} <= n AND (low = o OR low = last))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, fingerprint FROM f
UNION ALL SELECT doc_id, 0, list_reduce(list_prepend(CAST(0 AS BIGINT), xs), lambda a, y: (a * {C1} + y) % {P}) * 2147483648 + list_reduce(list_prepend(CAST(0 AS BIGINT), xs), lambda a, y: (a * {C2} + y) % {P}) FROM x WHERE rid NOT IN (SELECT rid FROM f)"""

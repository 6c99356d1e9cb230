"""Toxicity by a factorization machine over hashed terms.

A text's terms are the distinct 64-bit hashes of its lower-cased words, each
present or absent. The score is ``b + sum w_i + sum_{i<j} <v_i, v_j>`` over all
terms of the training sample, so a pair of terms (an insult beside the mention of
a group) can weigh more, or less, than its parts; the probability is its
logistic function.

Training takes at most ``rows`` labelled documents (a bounded sample, the
lowest key hashes), four fifths to fit and one fifth to choose the epoch and
the threshold. No term of the sample is left out, however rare; terms that are
common, or that go with either class more than chance allows, alone or beside a
toxic-leaning term, learn fast and the others slowly (``COMMON``, ``ODD``,
``SLOW``), or else a document's hundreds of rare terms would learn it by heart.
The model's size is bounded by the sample, so it is sent to all tasks. Of rows
that repeat an id one is taken, and of labels that contradict each other the
worse one. Scoring reads every document, whole, however long.

Null or empty text has no terms and scores the bias alone; a text at the
threshold is not called toxic; rows with a null doc_id are left out; repeated
rows are scored each. With no labelled rows, or rows of one class only, nothing
is called toxic and the probability is the share of toxic rows (0 where there
are none). An empty table of documents gives no rows. Other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

#: The most labelled rows that training takes.
ROWS = 20000
FACTORS, EPOCHS, RATE, L2 = 8, 30, 0.1, 2e-4
#: A term of 5 documents or more learns at the full rate if it is in this share of them, or if its toxic share, alone or beside
#: a toxic-leaning term, is this far (chi-squared) from the usual. All others learn too, at ``SLOW`` of the rate.
COMMON, ODD, SLOW = 0.02, 12.0, 0.01


@dataclass
class Model:
    keys: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    threshold: float = 0.0

    def scores(self, doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents from (document, term) rows without repeats."""
        i = np.searchsorted(self.keys, key)
        ok = i < len(self.keys)
        ok[ok] = self.keys[i[ok]] == key[ok]
        return self._of(doc[ok], i[ok], n)

    def _of(self, doc, i, n):
        out = self.bias + np.bincount(doc, self.w[i], n)
        for f in range(self.v.shape[1]):
            x = self.v[i, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of the distinct terms of each text."""
    codes, offs = X.flat(texts, lower=True)
    start, end, doc = X.word_spans(codes, offs)
    h = X.word_hashes(codes, start, end)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the neighbouring groups of these sizes."""
    out = np.zeros(len(size))
    full = size > 0
    if len(x):
        out[full] = np.add.reduceat(x, (np.cumsum(size) - size)[full])
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def telling(row: np.ndarray, at: np.ndarray, count: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which terms are common, or go with a class alone, or do so beside a toxic-leaning term; ``row[at[d]:at[d + 1]]`` are document d's terms."""
    n, p = len(y), y.mean()
    size = np.diff(at)
    gain = np.bincount(row, np.repeat(y, size), len(count)) - count * p
    odd = gain**2 / (count * p * (1 - p))
    often = count >= 5
    out = often & ((count >= COMMON * n) | (odd >= ODD))
    place = np.cumsum(often) - 1
    few = often[row]
    short, start = place[row[few]], np.append(0, np.cumsum(few))[at]
    by_term = np.argsort(row, kind="stable")
    owner = np.repeat(np.arange(n), size)[by_term]
    first = np.append(0, np.cumsum(count))
    lean = np.flatnonzero(often & (odd >= ODD) & (gain > 0))
    least = ODD + 2 * np.log(max(1, len(lean) * int(often.sum())))  # so many pairs are looked at
    beside = np.zeros(int(often.sum()))
    for a in lean:
        docs = owner[first[a] : first[a + 1]]
        q = y[docs].mean()
        if q < 1:
            k = start[docs + 1] - start[docs]
            i = short[np.repeat(start[docs] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            m, hit = np.bincount(i, minlength=len(beside)), np.bincount(i[np.repeat(y[docs] > 0, k)], minlength=len(beside))
            u = np.flatnonzero(m >= 5)
            m, hit = m[u], hit[u]
            beside[u] = np.maximum(beside[u], (hit - m * q) ** 2 / (m * q * (1 - q)))
    out[often] |= beside >= least
    return out


def fit(doc: np.ndarray, key: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = 7) -> Model:
    """Fits by AdaGrad on mini-batches; ``doc`` indexes ``y``. Of documents with the same terms and class one counts."""
    mark = np.zeros(len(y), np.uint64)
    np.add.at(mark, doc, X.mix64(key))
    once = np.unique(np.stack([mark, y.astype(np.uint64)], 1), axis=0, return_index=True)[1] if len(y) else np.zeros(0, np.int64)
    place = np.full(len(y), -1, np.int64)
    place[np.sort(once)] = np.arange(len(once))
    y, doc = y[np.sort(once)], place[doc]
    doc, key = doc[doc >= 0], key[doc >= 0]
    n = len(y)
    if n < 10 or y.min() == y.max():
        p = float(y.mean()) if n else 0.0
        return Model(np.zeros(0, np.uint64), float(np.log((p + 1e-9) / (1 - p + 1e-9))), np.zeros(0), np.zeros((0, factors)), np.inf)
    keys, row, count = np.unique(key, return_inverse=True, return_counts=True)
    order = np.argsort(doc, kind="stable")
    row = row[order].astype(np.int32)
    at = np.searchsorted(doc[order], np.arange(n + 1))
    del doc, key, order
    part = np.where(telling(row, at, count, y), 1.0, SLOW)
    pace = rate * part
    r = np.random.default_rng(seed)
    held = np.flatnonzero(np.arange(n) % 5 == 4)
    own = np.flatnonzero(np.arange(n) % 5 != 4)
    p = y[own].mean()
    m = Model(keys, float(np.log(p / (1 - p))), np.zeros(len(keys)), r.normal(0, 0.01, (len(keys), factors)) * part[:, None])
    gw, gv, gb = np.full(len(keys), 1e-6), np.full((len(keys), factors), 1e-6), 1e-6

    def batch(part):
        """Classes, terms and, by document, their places in the terms; documents by term."""
        size = at[part + 1] - at[part]
        u, c = np.unique(row[np.repeat(at[part] - np.cumsum(size) + size, size) + np.arange(size.sum())], return_inverse=True)
        back = np.repeat(np.arange(len(part), dtype=np.int32), size)[np.argsort(c, kind="stable")]
        return y[part], size, u, c.astype(np.int32), back, np.bincount(c, minlength=len(u))

    def forward(size, c, w, v):
        s = np.stack([sums(x[c], size) for x in v])
        return s, m.bias + sums((w - 0.5 * (v * v).sum(0))[c], size) + 0.5 * (s * s).sum(0)

    batches = [batch(x) for x in np.array_split(r.permutation(own), max(1, len(own) // 256))]
    apart = batch(held)
    del row, at
    best = (np.inf,)
    for _ in range(epochs):
        for b in r.permutation(len(batches)):
            truth, size, u, c, back, uses = batches[b]
            w, v = m.w[u], np.ascontiguousarray(m.v[u].T)
            s, z = forward(size, c, w, v)
            err = (sigmoid(z) - truth) / len(truth)
            dw = sums(err[back], uses)
            dv = np.stack([sums(x[back], uses) for x in err * s], 1) + (l2 - dw[:, None]) * v.T
            dw += l2 * w
            gw[u] += dw * dw
            m.w[u] = w - pace[u] * dw / np.sqrt(gw[u])
            gv[u] += dv * dv
            m.v[u] = v.T - 0.2 * pace[u, None] * dv / np.sqrt(gv[u])
            db = err.sum()
            gb += db * db
            m.bias -= rate * db / np.sqrt(gb)
        truth, size, u, c, *_ = apart
        z = forward(size, c, m.w[u], np.ascontiguousarray(m.v[u].T))[1]
        loss = float(np.mean(np.logaddexp(0, z) - truth * z))
        if loss < best[0]:
            best = (loss, z, Model(keys, m.bias, m.w.copy(), m.v.copy()))
    best[2].threshold = cut_point(best[1], truth)
    return best[2]


def cut_point(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the greatest F1; of equal ones the middle between the neighbouring scores."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(1, y.sum()))
    last = np.append(s[1:] != s[:-1], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    return float(s[i] if i + 1 == len(s) else (s[i] + s[i + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` labelled documents."""
    marked = X.usable(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), "doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = X.sample_rows(marked, "doc_id", rows)
    joined = X.one_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), few, "doc_id")

    def run(batches):
        for part in X.slices(batches):
            doc, key = terms(part.column(1).to_pylist())
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key.view(np.int64)))], ["doc_id", "toxic", "terms"])

    got = joined.mapInArrow(run, "doc_id long, toxic int, terms array<long>").toArrow().combine_chunks().sort_by("doc_id")
    lists = got.column("terms").combine_chunks()
    size = np.array([len(x) for x in lists], np.int64)
    y = got.column("toxic").to_numpy().astype(float)
    parts = [np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in lists]).view(np.uint64) if len(size) else np.zeros(0, np.uint64)]
    del got, lists
    return fit(np.repeat(np.arange(len(size)), size), parts.pop(), y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, probability, toxic)`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for part in X.slices(batches):
            z = m.scores(*terms(part.column(1).to_pylist()), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(z)), pa.array((z > m.threshold).astype(np.int32))], ["doc_id", "probability", "toxic"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, probability double, toxic int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    return score(docs, train(docs, X.read(spark, sf_dir, "labels")))

"""Quality by compression: zstandard dictionaries of good and bad text.

Two dictionaries are built, from labelled good and from labelled bad
documents. A text is compressed with each, in pieces of ``PIECE`` bytes so that
the dictionary, not the text's own beginning, explains it; whole texts are
read. The normalised difference ``(bad - good) / (bad + good)`` of the
compressed sizes is positive where good text explains the document better. A
logistic function of it, fitted on labelled rows that the dictionaries have
not seen, turns it into a calibrated probability of good quality.

Training takes at most ``rows`` labelled documents (a bounded sample, the
lowest key hashes): two thirds for the dictionaries, one third to calibrate,
all of them whole. Of rows that repeat an id one is taken, and of labels that
contradict each other the worse one. The threshold is where the F1 of the bad
class on the calibration rows is greatest, so that the many good rows weigh
against calling one of them bad; a text at the threshold counts as bad.

Null or empty text has difference 0; very long texts are read whole; rows with a
null doc_id are left out; repeated rows are scored each. Where a class has too
few labelled rows, as in an empty table of labels, every difference is 0, the
probability is the share of good rows (1 without any) and every document counts
as good. An empty table of documents gives no rows. Other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

#: The most labelled rows that training takes.
ROWS = 8000
PIECE, DICTIONARY, LEVEL = 4096, 262144, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    bias: float = 0.0
    threshold: float = 0.0


def cutter(text: str) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Scorer:
    """Compresses with the two dictionaries of a model."""

    def __init__(self, model: Model):
        self.own = []
        for raw in (model.good, model.bad):
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.own.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        pieces = cutter(text)
        if len(self.own) < 2 or not pieces:
            return 0.0
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.own)
        return (bad - good) / (bad + good)


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the texts' own distinct pieces where there are too few to train one."""
    samples = [p for t in texts for p in cutter(t)]
    size = min(DICTIONARY, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's steps, slightly regularised."""
    a, b = 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.sum((p - y) * z) + 1e-2 * a, np.sum(p - y)])
        h = p * (1 - p)
        step = np.linalg.solve(np.array([[np.sum(h * z * z) + 1e-2, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-6]]), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """A model from (doc_id, text, quality) rows."""
    rows = sorted(rows)
    share = float(np.mean([q for _, _, q in rows])) if rows else 1.0
    none = Model(b"", b"", 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))), -1.0)
    parts = {q: [t for _, t, x in rows if x == q and t] for q in (0, 1)}
    if min(map(len, parts.values())) < 6:
        return none
    learn = {q: [t for i, t in enumerate(ts) if i % 3] for q, ts in parts.items()}
    m = Model(dictionary(learn[1]), dictionary(learn[0]))
    s = Scorer(m)
    held = [(s.difference(t), q) for q, ts in parts.items() for i, t in enumerate(ts) if i % 3 == 0]
    x, y = np.array([a for a, _ in held]), np.array([float(b) for _, b in held])
    m.slope, m.bias = logistic(x, y)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    gain = 2 * np.cumsum(1 - ys) / (np.arange(1, len(xs) + 1) + (1 - ys).sum())
    last = np.append(xs[1:] != xs[:-1], True)
    i = int(np.argmax(np.where(last, gain, -1)))
    m.threshold = float(xs[i] if i + 1 == len(xs) else (xs[i] + xs[i + 1]) / 2)
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` labelled documents."""
    marked = X.usable(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = X.sample_rows(marked, "doc_id", rows)
    got = X.one_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), few, "doc_id").toArrow()
    return fit(list(zip(got.column("doc_id").to_pylist(), got.column("text").to_pylist(), got.column("quality").to_pylist())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, difference, probability, good)`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        s = Scorer(m)
        for part in X.slices(batches):
            x = np.array([s.difference(t) for t in part.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x), pa.array(p), pa.array((x > m.threshold).astype(np.int32))], ["doc_id", "difference", "probability", "good"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, difference double, probability double, good int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    return score(docs, train(docs, X.read(spark, sf_dir, "labels")))

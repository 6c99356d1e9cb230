"""Vectorised text primitives and Spark helpers shared by the operators.

All helpers work on flat arrays: the texts of a slice of an Arrow batch are
laid end to end as code points, with ``offs`` giving where each one begins.
Slices are bounded in characters, so memory does not follow the batch size;
a single text longer than the bound makes a slice of its own, whole.
"""

import functools
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read  # noqa: F401

CHARS = 1 << 20
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def slices(batches, column: str = "text", chars: int = CHARS):
    """Slices of the record batches of at most about ``chars`` characters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(n) // chars
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def flat(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the offsets (len + 1)."""
    texts = [(t or "") for t in texts]
    if lower:
        texts = [t.lower() for t in texts]
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offs[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


@functools.cache
def _table(kind: str) -> np.ndarray:
    if kind == "space":  # the white space of RE2's \s
        t = np.ones(0x110000, bool)
        t[[9, 10, 12, 13, 32]] = False
        return t
    test = {"alnum": str.isalnum, "alpha": str.isalpha}[kind]
    return np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)


def word_spans(codes: np.ndarray, offs: np.ndarray, kind: str = "alnum") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of word characters; a run never crosses two texts."""
    if not len(codes):
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = _table(kind)[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[0] = edge[-1] = True
    edge[offs] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = mask[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offs, start, "right") - 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for b in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


def word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands; ``start`` ascends.

    It is the word's polynomial in BASE, mixed: a difference of running sums,
    moved to the word's own beginning by the inverse of BASE.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + CHARS, "right")))  # so many words at a time as the tables are long
        n = int(end[j - 1]) - a
        up, down = _powers(max(CHARS, 1 << (n - 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((codes[a : a + n] + np.uint64(1)) * up[:n], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix64((total[e] - total[s]) * down[np.minimum(s, len(down) - 1)])
        i = j
    return out


def window_hashes(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rolling hash of every ``n`` neighbours of ``h`` (len - n + 1 values), in log2(n) passes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    have, out, width = h.astype(np.uint64), None, 0
    size, power = 1, base
    while True:
        if n & size:
            if out is None:
                out, width = have, size
            else:  # out covers the first `width`, have the `size` after it
                m = len(h) - width - size + 1
                out = out[:m] * np.uint64(power) + have[width : width + m]
                width += size
        size *= 2
        if size > n:
            return out
        m = len(h) - size + 1
        have = have[:m] * np.uint64(power) + have[size // 2 : size // 2 + m]
        power = power * power % (1 << 64)


def ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names, or a temporary one in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lexiloom-")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    """Buckets to spread keyed work over; the cluster sets it in proportion to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose keys hash lowest: a fixed pseudo-random sample."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


#: Rows (of a few integers) up to which a table that was counted is sent to all tasks.
SENT = 1 << 19


def sent(df: DataFrame) -> DataFrame:
    """A table whose lineage is cut, with a broadcast hint if it was counted to have at most ``SENT`` rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= SENT else df


def one_each(docs: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """``few`` with the ``text`` of its ``keys``: of rows with equal keys that of the least text hash, so there are no more rows than in ``few``."""
    joined = docs.join(F.broadcast(few), [*keys])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text")))
    name = fresh(joined, "nth")
    return joined.withColumn(name, place).filter(F.col(name) == 1).drop(name)


def usable(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, of the rows where none of them is null."""
    out = docs.select(*columns)
    for c in columns:
        out = out.filter(F.col(c).isNotNull())
    return out


def pack(columns: list[np.ndarray], deltas: tuple[bool, ...]) -> bytes:
    """Columns of 8-byte integers as compressed bytes: differences where asked for, byte planes, zstandard."""
    planes = []
    for c, delta in zip(columns, deltas):
        c = c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)
        c = np.diff(c, prepend=np.int64(0)) if delta else c
        c = (c << np.int64(1)) ^ (c >> np.int64(63)) if delta else c  # signs to the last bit
        planes.append(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, deltas: tuple[bool, ...]) -> list[np.ndarray]:
    """The columns that ``pack`` was given, as int64."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (8 * len(deltas))
    out = []
    for k, delta in enumerate(deltas):
        c = np.ascontiguousarray(raw[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T).view(np.int64).ravel()
        if delta:
            c = ((c >> np.int64(1)) & np.int64((1 << 63) - 1)) ^ -(c & np.int64(1))
            c = np.cumsum(c)
        out.append(c)
    return out


def bucketed(bucket: np.ndarray, columns: list[np.ndarray], deltas: tuple[bool, ...], tag: int = 0) -> pa.RecordBatch:
    """Rows ``(bucket, tag, data)``: the columns' rows of each bucket packed together, in the order they come."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    data = [pack([c[order[a:b]] for c in columns], deltas) for a, b in zip(first, np.append(first[1:], len(bucket)))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), tag, np.int32)), pa.array(data, pa.binary())], ["bucket", "tag", "data"])


BUCKETED = "bucket int, tag int, data binary"


def gathered(batches, *deltas: tuple[bool, ...]) -> list[list[np.ndarray]]:
    """All columns of the packed rows of a partition, for each tag; empty columns where there are none."""
    parts: list[list] = [[] for _ in deltas]
    for b in batches:
        for tag, x in zip(b.column(1).to_pylist(), b.column(2)):
            parts[tag].append(unpack(x.as_py(), deltas[tag]))
    return [[np.concatenate(c) for c in zip(*p)] if p else [np.zeros(0, np.int64) for _ in d] for p, d in zip(parts, deltas)]


def flushed(parts, rows: int = 1 << 20):
    """Joins small groups of columns to groups of about ``rows`` rows."""
    held, n = [], 0
    for p in parts:
        if len(p[0]):
            held.append(p)
            n += len(p[0])
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]

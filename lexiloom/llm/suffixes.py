"""Repeated passages by a suffix sort in blocks with a difference-cover sample.

The suffixes of a text begin at its words (maximal runs of letters and
digits, case kept). A passage of ``DEPTH`` words that occurs more than once is
a tie of suffixes to that depth. The ties are found without ever holding, or
sending, all suffixes:

* Cover sample. The places with ``place mod 31`` in ``COVER`` form a difference
  cover: for any two places i and j there is a shift below 31 that takes both
  into the sample. So two suffixes that agree for ``DEPTH`` words have, at such
  a shift, sample suffixes that agree for ``DEPTH - 30`` words. The rank of a
  sample suffix is the fingerprint of that many words (any total order of the
  suffixes serves to find ties, so fingerprints stand for the alphabet's). One
  exchange by rank finds the ranks that are tied.
* Suffixes none of whose sample places within 31 words has a tied rank cannot
  tie to the depth; they are resolved by the sample and go no further.
* Blocks. The others are sent to buckets by the fingerprint of their ``DEPTH``
  words, and each task sorts one bucket. The number of buckets follows
  ``spark.sql.shuffle.partitions``, which bounds a bucket's memory.

A passage may stand in a third of all documents. Where one fingerprint fills more
of what a task has read than an eighth of a partition's share, only its least
occurrence there goes to the bucket, so that no bucket fills with one
fingerprint. The others are known to be copies, and travel with their documents;
the bucket tells them their original.

Suffixes travel in packed columns, and texts compressed, as the exchanges are
what the work is bound by.

All fingerprints have 64 bits. In a tie the occurrence of the least (doc_id,
text hash, place) is the original, the others are copies. The words of
overlapping or touching copies form one span, and so do those of originals.

Output: ``doc_id, start, stop`` (characters), ``n_words``, ``copy`` (1 for
copies, 0 for originals) and ``first_id``, the document of the original of the
span's first tie. ``deduplicate`` removes the copies from the texts.

A passage may repeat within one document, and overlap itself. Null or empty
texts and those below ``DEPTH`` words give no rows; very long texts are read
whole; rows with a null doc_id are left out; rows equal in doc_id and text are
one document. An empty table gives no rows. Other columns are ignored
(``deduplicate`` keeps them).
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X

#: Words that make a passage.
DEPTH = 50
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Rows that a task holds together before they are sent.
HELD = 1 << 20
SPANS = "doc_id long, rid long, start int, stop int, n_words int, copy int, first_id long"


def _words(part: pa.RecordBatch, column: int):
    codes, offs = X.flat(part.column(column).to_pylist())
    start, end, doc = X.word_spans(codes, offs)
    first = np.searchsorted(doc, np.arange(part.num_rows))
    size = np.bincount(doc, minlength=part.num_rows)
    return X.word_hashes(codes, start, end), start - offs[doc], end - offs[doc], doc, np.arange(len(doc)) - first[doc], size


def _prints(h: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the words, fingerprints of the ``n`` words from there) where so many follow in the same text."""
    at = np.flatnonzero(place + n <= size[doc])
    return at, X.mix64(X.window_hashes(h, n)[at]) if len(at) else np.zeros(0, np.uint64)


def _named(docs: DataFrame) -> DataFrame:
    whole = X.usable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    return whole.select("doc_id", F.xxhash64("text").alias("rid"), "text")


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    """The bucket of ``n`` by the upper bits of fingerprints."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _heavy(keys: np.ndarray, partitions: int) -> np.ndarray:
    """Which rows have a key that fills more than an eighth of a partition's share of them."""
    most = max(2, len(keys) // (8 * partitions))
    x = np.sort(keys)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    many = x[first[np.diff(np.append(first, len(x))) > most]]
    return np.isin(keys, many) if len(many) else np.zeros(len(keys), bool)


def _least(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns (key, doc_id, text hash, place, ...) in order and without repeats, and whether each row is the first of its key."""
    order = np.lexsort(columns[3::-1])
    c = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in c[:4]], axis=0)
    c = [x[new] for x in c]
    return c, np.append(True, c[0][1:] != c[0][:-1])


def _by_document(doc: np.ndarray, rid: np.ndarray, n: int) -> np.ndarray:
    return _bucket(X.mix64((doc ^ rid).view(np.uint64)), n)


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column(0).to_numpy(), part.column(1).to_numpy()


def tied_places(docs: DataFrame, depth: int) -> DataFrame:
    """``(doc_id, rid, places)``: sample places of each text whose rank another place shares."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    p = X.partitions(docs.sparkSession)
    n = 2 * p
    #: rank, doc_id, text hash, place; and what is tied already: doc_id, text hash, place
    sent, known = (False, True, True, True), (True, True, True)

    def ranks(batches):
        for part in X.slices(batches):
            h, _, _, doc, place, size = _words(part, 2)
            at, rank = _prints(h, doc, place, size, depth - PERIOD + 1)
            keep = inside[place[at] % PERIOD]
            at, rank = at[keep], rank[keep]
            d, r = _ids(part)
            yield rank, d[doc[at]], r[doc[at]], place[at]

    def sample(batches):
        for c in X.flushed(ranks(batches), HELD):
            heavy = _heavy(c[0], p)
            if heavy.any():
                own, first = _least([x[heavy] for x in c])
                c = [np.concatenate([x[~heavy], y[first]]) for x, y in zip(c, own)]
                yield X.bucketed(_by_document(own[1], own[2], n), own[1:], known, 1)
            yield X.bucketed(_bucket(c[0], n), c, sent)

    def ties(batches):
        c, tied = X.gathered(batches, sent, known)
        rank = np.sort(c[0])
        twice = np.unique(rank[1:][rank[1:] == rank[:-1]])
        i = np.searchsorted(twice, c[0])
        i[i == len(twice)] = 0
        again = np.flatnonzero(twice[i] == c[0]) if len(twice) else np.zeros(0, np.int64)
        doc, rid, place = (np.concatenate([x[again], y]) for x, y in zip(c[1:], tied))
        order = np.lexsort((place, rid, doc))
        doc, rid, place = doc[order], rid[order], place[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]))) if len(doc) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(rid[new]), pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), pa.array(place.astype(np.int32)))], ["doc_id", "rid", "places"])

    tied = docs.mapInArrow(sample, X.BUCKETED).repartitionById(n, F.col("bucket")).mapInArrow(ties, "doc_id long, rid long, places array<int>")
    return tied.groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("places")).alias("places"))


def _spans(docs: DataFrame, depth: int) -> DataFrame:
    """Rows of SPANS."""
    if depth < PERIOD:
        raise ValueError(f"the depth must be {PERIOD} at least")
    spark = docs.sparkSession
    p = X.partitions(spark)
    n = 2 * p
    own = _named(docs)
    #: fingerprint, doc_id, text hash, place, first character, last character
    sent = (False, True, True, True, True, True)
    #: doc_id, text hash, place, first character, last character, copy, first_id
    back = (True, True, True, True, True, True, True)
    #: fingerprint and doc_id of its original, where copies of it are waiting
    origin = (False, True)

    def squeezed(batches):
        for part in X.slices(batches):
            z = zstandard.ZstdCompressor(level=1)
            text = pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["doc_id", "rid", "text"])

    def opened(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            held, chars, a = [], 0, 0
            for i, t in enumerate(batch.column(2)):
                held.append(z.decompress(t.as_py()).decode("utf-8", "surrogatepass"))
                chars += len(held[-1])
                if chars >= X.CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(a, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, pa.string()), part.column(3)], ["doc_id", "rid", "text", "places"])
                    held, chars, a = [], 0, i + 1

    def candidates(batches):
        for part in opened(batches):
            h, start, end, doc, place, size = _words(part, 2)
            at, key = _prints(h, doc, place, size, depth)
            if not len(at):
                continue
            places = part.column(3)
            counts = np.diff(places.offsets.to_numpy())
            mark = np.zeros(len(h) + 1, np.int32)
            first = np.searchsorted(doc, np.arange(part.num_rows))
            mark[1:][np.repeat(first, counts) + places.flatten().to_numpy()] = 1
            seen = np.cumsum(mark)
            keep = seen[np.minimum(at + PERIOD, len(h))] > seen[at]
            at, key = at[keep], key[keep]
            d, r = _ids(part)
            yield key, d[doc[at]], r[doc[at]], place[at], start[at], end[at + depth - 1]

    def suffixes(batches):
        for c in X.flushed(candidates(batches), HELD):
            heavy = _heavy(c[0], p)
            if heavy.any():
                some, first = _least([x[heavy] for x in c])
                c = [np.concatenate([x[~heavy], y[first]]) for x, y in zip(c, some)]
                rest = [x[~first] for x in some]
                yield X.bucketed(_by_document(rest[1], rest[2], n), rest, sent, 1)
                lead = np.unique(rest[0])
                yield X.bucketed(_bucket(lead, n), [lead], origin[:1], 2)
            yield X.bucketed(_bucket(c[0], n), c, sent)

    def ties(batches):
        """Sorts a bucket of suffixes and marks the originals and copies of its ties."""
        c, waiting, asked = X.gathered(batches, sent, sent, origin[:1])
        if len(waiting[0]):
            yield X.bucketed(_by_document(waiting[1], waiting[2], n), waiting, sent, 1)
        if not len(c[0]):
            return
        (key, doc, rid, place, start, stop), first = _least(c)
        copy = ~first
        original = doc[np.maximum.accumulate(np.where(copy, 0, np.arange(len(key))))]
        # an original whose copies wait in other buckets is tied too
        several = copy | np.append(copy[1:], False) | np.isin(key, asked[0])
        out = [x[several] for x in (doc, rid, place, start, stop, copy.astype(np.int64), original)]
        order = np.lexsort((out[2], out[1], out[0]))
        out = [x[order] for x in out]
        yield X.bucketed(_by_document(out[0], out[1], n), out, back)
        led = first & np.isin(key, asked[0])
        if led.any():
            yield X.bucketed(np.zeros(int(led.sum()), np.int64), [key[led], doc[led]], origin, 2)

    def islands(told):
        def run(batches):
            """Joins suffixes whose words overlap or touch."""
            c, waiting = X.gathered(batches, back, sent)
            if len(waiting[0]):
                keys, docs_ = told()
                firsts = docs_[np.searchsorted(keys, waiting[0])]
                c = [np.concatenate(x) for x in zip(c, (*waiting[1:], np.ones(len(firsts), np.int64), firsts))]
            if not len(c[0]):
                return
            order = np.lexsort((c[2], c[5], c[1], c[0]))
            doc, rid, place, start, stop, copy, first = (x[order] for x in c)
            # a place that comes twice was read from a row that comes twice
            once = np.append(True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]) | (copy[1:] != copy[:-1]) | (place[1:] != place[:-1]))
            doc, rid, place, start, stop, copy, first = (x[once] for x in (doc, rid, place, start, stop, copy, first))
            new = np.append(True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]) | (copy[1:] != copy[:-1]) | (place[1:] > place[:-1] + depth))
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(new)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(rid[a]), *(pa.array(x.astype(np.int32)) for x in (start[a], stop[b], place[b] - place[a] + depth, copy[a])), pa.array(first[a])], ["doc_id", "rid", "start", "stop", "n_words", "copy", "first_id"])

        return run

    texts = own.mapInArrow(squeezed, "doc_id long, rid long, text binary")
    rows = texts.join(tied_places(own, depth), ["doc_id", "rid"]).select("doc_id", "rid", "text", "places").mapInArrow(suffixes, X.BUCKETED)
    found = X.cut(rows.repartitionById(n, F.col("bucket")).mapInArrow(ties, X.BUCKETED))

    def opened_rows(batches):
        c, waiting, led = X.gathered(batches, back, sent, origin)
        x = led if len(led[0]) else waiting
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in x], names[: len(x)])

    def closed(batches):
        for b in batches:
            x = [b.column(i).to_numpy() for i in range(7)]
            yield X.bucketed(_by_document(x[1], x[2], n), [*x[1:6], np.ones(len(x[0]), np.int64), x[6]], back)

    names = ["key", "doc_id", "rid", "place", "start", "stop"]
    led = found.filter("tag = 2").mapInArrow(opened_rows, "key long, doc_id long")
    if (n_led := led.count()) <= X.SENT:
        got = np.array(led.collect(), np.int64).reshape(n_led, 2)
        told = spark.sparkContext.broadcast(tuple(got[np.argsort(got[:, 0])].T))
        rest = found.filter("tag < 2")
        return rest.repartitionById(n, F.col("bucket")).mapInArrow(islands(lambda: told.value), SPANS)
    waiting = found.filter("tag = 1").mapInArrow(opened_rows, ", ".join(f"{c} long" for c in names))
    rest = waiting.join(led.withColumnRenamed("doc_id", "first_id"), "key").select(*names, "first_id").mapInArrow(closed, X.BUCKETED)
    return found.filter("tag = 0").unionByName(rest).repartitionById(n, F.col("bucket")).mapInArrow(islands(None), SPANS)


def repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, start, stop, n_words, copy, first_id)`` of the passages that occur more than once."""
    return _spans(docs, depth).drop("rid")


def deduplicate(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The documents without the copies of passages; all columns as they were.

    Each copy's characters are cut out. A document with no word left goes; one
    without copies stays as it was, also where its text is null.
    """
    a, b, r, d = (X.fresh(docs, n) for n in ("starts", "stops", "rid", "did"))
    gone = _spans(docs, depth).filter("copy = 1").groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    gone = X.sent(X.cut(gone.select(F.col("doc_id").alias(d), F.col("rid").alias(r), F.col("s.start").alias(a), F.col("s.stop").alias(b))))
    place, schema, width = docs.columns.index("text"), docs.schema, len(docs.columns)

    def cut(batches):
        for part in X.slices(batches):
            starts, stops = part.column(width + 2).to_pylist(), part.column(width + 3).to_pylist()
            texts, keep = part.column(place).to_pylist(), np.ones(part.num_rows, bool)
            for i, (s, e) in enumerate(zip(starts, stops)):
                if s:
                    t = texts[i]
                    texts[i] = "".join(t[x:y] for x, y in zip([0, *e], [*s, len(t)]))
                    keep[i] = any(map(str.isalnum, texts[i]))
            columns = [part.column(i) for i in range(width)]
            columns[place] = pa.array(texts, part.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, docs_names).filter(pa.array(keep))

    docs_names = docs.columns
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(r)), "left").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(X.read(spark, sf_dir, "documents"))


def sql(depth: int = DEPTH) -> str:
    """The same rows from all passages of ``depth`` words, each spelt out."""
    word, other = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    return f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS ws, regexp_extract_all(text, '{other}') AS os, CAST(regexp_matches(text, '^{other}') AS INTEGER) AS lead FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(len(ws) - {depth} + 1)) AS place, ws FROM t WHERE len(ws) >= {depth}),
k AS (SELECT doc_id, place, md5(array_to_string(ws[place + 1 : place + {depth}], ' ')) AS key FROM w),
m AS (SELECT doc_id, place, row_number() OVER r AS nth, count(*) OVER (PARTITION BY key) AS n, first_value(doc_id) OVER r AS first_id FROM k WINDOW r AS (PARTITION BY key ORDER BY doc_id, place)),
c AS (SELECT doc_id, place, CAST(nth > 1 AS INTEGER) AS copy, first_id FROM m WHERE n > 1),
i AS (SELECT *, CASE WHEN place <= lag(place) OVER o + {depth} THEN 0 ELSE 1 END AS new FROM c WINDOW o AS (PARTITION BY doc_id, copy ORDER BY place)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, copy ORDER BY place) AS island FROM i),
s AS (SELECT doc_id, copy, min(place) AS a, max(place) + {depth} AS b, arg_min(first_id, place) AS first_id FROM g GROUP BY doc_id, copy, island)
SELECT s.doc_id, CAST(length(array_to_string(ws[1 : a], '')) + length(array_to_string(os[1 : a + lead], '')) AS INTEGER) AS start,
CAST(length(array_to_string(ws[1 : b], '')) + length(array_to_string(os[1 : b - 1 + lead], '')) AS INTEGER) AS stop,
CAST(b - a AS INTEGER) AS n_words, copy, first_id FROM s JOIN t USING (doc_id)"""

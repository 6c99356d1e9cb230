"""Phrase chunks and named entities.

Prediction needs no order between tokens: six features of the tags around are
joined to the weights, summed and the best class taken; runs of equal labels
are the chunks. Trees are span rows ``(keys, node_id, parent_id, depth, label,
start, stop)`` over token rows ``(keys, pos, token, tag)``.

Tagged-sentence columns are chunked in place, without token rows: ``chunked`` is
``array<struct<token, tag, chunk, chunk_id>>``.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tags as T
from ..sources import models as M
from . import perceptron as P
from . import taggers as G
from .sizes import fresh

OUT = "O"
#: Weights up to which a model is sent to all tasks, to chunk sentences in place.
SMALL = 2_000_000
CHUNKED = "array<struct<token:string,tag:string,chunk:string,chunk_id:int>>"
SPANS = "array<struct<node_id:int,label:string,start:int,stop:int>>"


def tags_since_determiner(tokens: DataFrame, *keys: str, tagset: T.TagSet = T.RAW) -> DataFrame:
    """Token rows with ``tags_since_dt``: the tags before, nearest first, down to a determiner (without it), joined by ``-``."""
    w = Window.partitionBy(*keys).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max(F.when(T.is_determiner("tag", tagset), F.col("pos"))).over(before), F.lit(-1))
    (name,) = fresh(tokens, "last")
    rows = tokens.withColumn(name, last)
    # only the tags since the last determiner are gathered
    run = Window.partitionBy(*keys, name).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("tags_since_dt", F.array_join(F.reverse(F.collect_list("tag").over(run)), "-")).drop(name)


def features(tokens: DataFrame, *keys: str, tagset: T.TagSet = T.RAW, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, pos, feature, value)``: the six features of each tagged token; columns to ``keep`` come along."""
    w = Window.partitionBy(*keys).orderBy("pos")
    prev = F.coalesce(F.lag("tag").over(w), F.lit(tagset.start))
    after = F.coalesce(F.lead("tag").over(w), F.lit(tagset.end))
    p, n = fresh(tokens, "prev", "next")
    t = tags_since_determiner(tokens, *keys, tagset=tagset).withColumn(p, prev).withColumn(n, after)
    named = [("pos", F.col("tag")), ("word", F.col("token")), ("prevpos", F.col(p)), ("prevpos+pos", F.concat_ws("+", p, "tag")), ("pos+nextpos", F.concat_ws("+", "tag", n)), ("since", F.col("tags_since_dt"))]
    return t.select(*keys, "pos", *keep, F.explode(F.array(*[F.concat(F.lit(f"{n}="), c) for n, c in named])).alias("feature"), F.lit(1).alias("value"))


def features_of(tokens: list[str], tags: list[str], tagset: T.TagSet = T.RAW) -> list[list[str]]:
    """The same features outside Spark, for training."""
    out, since = [], []
    for i, (w, t) in enumerate(zip(tokens, tags)):
        p = tags[i - 1] if i else tagset.start
        n = tags[i + 1] if i + 1 < len(tags) else tagset.end
        out.append([f"pos={t}", f"word={w}", f"prevpos={p}", f"prevpos+pos={p}+{t}", f"pos+nextpos={t}+{n}", f"since={'-'.join(since)}"])
        since = [] if t in tagset.determiners else [t, *since]
    return out


def predict(tokens: DataFrame, weights: DataFrame, *keys: str, tagset: T.TagSet = T.RAW, compat: bool = False) -> DataFrame:
    """Token rows with ``chunk``: the predicted label, the set's outside label where none is known or it is none of the set's.

    With ``compat``, tokens of labels that are none of the set's are lost before
    labels and tokens are put side by side, so later labels move to the left and
    the last tokens vanish.
    """
    kept = [c for c in tokens.columns if c not in (*keys, "pos", "chunk")]
    name, packed = fresh(tokens, "label_", "kept")
    if any("map<" in kind for _, kind in tokens.dtypes):  # no map can be grouped by
        best = tokens.drop("chunk").join(P.predict(features(tokens, *keys, tagset=tagset), weights, *keys, "pos").withColumnRenamed("class", name), [*keys, "pos"], "left")
    else:  # all columns go through the sums, so the tokens need not be joined with what is predicted
        rows = tokens.withColumn(packed, F.struct(*kept))
        best = P.predict(features(rows, *keys, tagset=tagset, keep=(packed,)), weights, *keys, "pos", packed, how="left").withColumnRenamed("class", name).select(*keys, "pos", f"{packed}.*", name)
    rows = best.withColumn(name, F.coalesce(name, F.lit(OUT)))
    label = F.col(name) if tagset.chunks is None else F.when(F.col(name).isin(*sorted(tagset.chunks)), F.col(name))
    if not compat:
        return rows.withColumn("chunk", F.coalesce(label, F.lit(tagset.out))).drop(name)
    (own,) = fresh(rows, "good")
    good = rows.withColumn(own, label).filter(F.col(own).isNotNull())
    place = Window.partitionBy(*keys).orderBy("pos")
    moved = good.select(*keys, (F.row_number().over(place) - 1).alias("pos"), F.col(own).alias("chunk"))
    return tokens.drop("chunk").join(moved, [*keys, "pos"])


def with_islands(tokens: DataFrame, *keys: str, out: str = OUT) -> DataFrame:
    """Token rows with ``chunk_id``: runs of equal ``chunk`` labels, numbered in order; null outside of chunks."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.when(F.col("chunk") != out, F.when(F.coalesce(F.lag("chunk").over(w), F.lit(out)) == F.col("chunk"), 0).otherwise(1)).otherwise(0)
    (name,) = fresh(tokens, "new")
    rows = tokens.withColumn(name, new)
    return rows.withColumn("chunk_id", F.when(F.col("chunk") != out, F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))).drop(name)


def iob_chunks(rows: DataFrame, *keys: str, compat: bool = False) -> DataFrame:
    """IOB token rows as token rows with ``chunk`` and ``chunk_id``.

    A chunk begins at ``B``, or at ``I`` after ``O`` or at the start, and has its
    first entry's type whatever the types inside. With ``compat`` each chunk has
    lost its first token.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    head = (F.col("iob") == "B") | ((F.col("iob") == "I") & (F.coalesce(F.lag("iob").over(w), F.lit("O")) == "O"))
    (h,) = fresh(rows, "head")
    marked = rows.withColumn(h, head).withColumn("chunk_id", F.when(F.col("iob") != "O", F.sum(F.col(h).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")))
    first = F.first(F.when(F.col(h), F.col("chunk")), ignorenulls=True).over(Window.partitionBy(*keys, "chunk_id"))
    marked = marked.withColumn("chunk", F.when(F.col("chunk_id").isNotNull(), first).otherwise(F.lit(OUT)))
    return (marked.filter(~F.col(h)) if compat else marked).drop(h)


def spans(tokens: DataFrame, *keys: str) -> DataFrame:
    """Span rows of flat chunks: ``(keys, node_id, parent_id, depth, label, start, stop)``."""
    rows = tokens.filter("chunk_id IS NOT NULL").groupBy(*keys, F.col("chunk_id").alias("node_id"))
    return rows.agg(F.first("chunk").alias("label"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).select(*keys, "node_id", F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("depth"), "label", "start", "stop")


def innermost(tokens: DataFrame, spans_: DataFrame, *keys: str, out: str = OUT) -> DataFrame:
    """Token rows with the label of the deepest span that covers each, ``out`` where none does."""
    deep = F.max_by("label", F.struct("depth", "node_id")).alias("chunk")
    inside = tokens.join(spans_.select(*keys, "node_id", "depth", "label", "start", "stop"), [*keys]).filter("pos >= start AND pos < stop").groupBy(*keys, "pos").agg(deep)
    return tokens.join(inside, [*keys, "pos"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(out)))


def brackets(tokens: DataFrame, *keys: str) -> DataFrame:
    """``(keys, text)``: flat chunks as ``[NP The/DT dog/NN] ./.``."""
    word = F.concat_ws("/", "token", "tag")
    part = F.coalesce(F.col("chunk_id"), -F.col("pos") - 1)
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", c.alias("w")))), lambda x: x["w"]), " ")
    groups = tokens.groupBy(*keys, part.alias("_g")).agg(F.min("pos").alias("pos"), F.first("chunk").alias("_c"), ordered(word).alias("_t"))
    shown = F.when(F.col("_g") >= 0, F.concat(F.lit("["), F.col("_c"), F.lit(" "), F.col("_t"), F.lit("]"))).otherwise(F.col("_t"))
    return groups.groupBy(*keys).agg(ordered(shown).alias("text"))


def bracket_tree(words: list[str], spans_: list[dict]) -> str:
    """Bracket text of nested spans; an empty chunk prints as its label alone."""
    open_, close = {}, {}
    for s in sorted(spans_, key=lambda s: (s["depth"], s["node_id"])):
        open_.setdefault(s["start"], []).append(s)
        if s["stop"] > s["start"]:
            close[s["stop"] - 1] = close.get(s["stop"] - 1, 0) + 1
    out = []
    for i in range(len(words) + 1):
        lead = ""
        for s in open_.get(i, []):
            if s["stop"] == s["start"]:
                out.append(f"[{s['label']}]")
            else:
                lead += f"[{s['label']} "
        if i < len(words):
            out.append(lead + words[i] + "]" * close.get(i, 0))
    return " ".join(out)


@functools.cache
def nested_brackets():
    """An Arrow function of (printed words, spans) to bracket text."""

    @F.arrow_udf("string")
    def show(words: pa.Array, spans_: pa.Array) -> pa.Array:
        return pa.array([bracket_tree(w, s or []) for w, s in zip(words.to_pylist(), spans_.to_pylist())], pa.string())

    return show


class Decoder:
    """``predict`` of many sentences at once, by array operations."""

    def __init__(self, weights: list[tuple[str, str, float]], tagset: T.TagSet):
        self.tagset = tagset
        self.classes = sorted({c for _, c, _ in weights})
        number = {c: i for i, c in enumerate(self.classes)}
        by: dict[str, list[tuple[int, float]]] = {}
        for f, c, w in weights:
            by.setdefault(f, []).append((number[c], w))
        self.rows: dict[str, dict[str, int]] = {n: {} for n in ("pos", "word", "prevpos", "prevpos+pos", "pos+nextpos", "since")}
        own = []
        for f, x in by.items():
            name, _, value = f.partition("=")
            if name in self.rows:
                self.rows[name][value] = len(own)
                own.append(x)
        self.size = np.array([len(x) for x in own], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.cls = np.array([c for x in own for c, _ in x], np.int64)
        self.weight = np.array([w for x in own for _, w in x], float)
        self.words = pa.array(self.rows["word"], pa.string())
        self.word_row = np.array(list(self.rows["word"].values()), np.int64)
        #: All texts to which tags can still be put so that a known one comes out.
        self.ends = {v[i:] for v in self.rows["since"] for i in range(len(v) + 1) if i == 0 or v[i - 1] == "-"} | {""}
        known = lambda c: c if tagset.chunks is None or c in tagset.chunks else tagset.out
        self.labels = pa.array([*map(known, self.classes), known(OUT)], pa.string())

    def add(self, item: np.ndarray, row: np.ndarray, score: np.ndarray, known: np.ndarray) -> None:
        """Adds the weights of feature rows to the items that have them."""
        have = row >= 0
        item, row = item[have], row[have]
        size = self.size[row]
        at = np.repeat(self.begin[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(item, size) * len(self.classes) + self.cls[at]
        score += np.bincount(cell, self.weight[at], score.size).reshape(score.shape)
        known |= (np.bincount(cell, minlength=score.size) > 0).reshape(score.shape)

    def pairs(self, name: str, a: np.ndarray, b: np.ndarray, names: list) -> np.ndarray:
        """The feature rows of two tags with a plus between."""
        n = len(names)
        used, back = np.unique(a * n + b, return_inverse=True)
        text = ["+".join(x for x in (names[k // n], names[k % n]) if x is not None) for k in used.tolist()]
        return np.array([self.rows[name].get(t, -1) for t in text], np.int64)[back]

    def since(self, tag: np.ndarray, first: np.ndarray, names: list) -> np.ndarray:
        """The feature rows of the tags before, down to a determiner: all runs between determiners side by side, while any can be a known one."""
        n, known = len(tag), self.rows["since"]
        head = first.copy()
        head[1:] |= np.isin(tag[:-1], [i for i, t in enumerate(names) if t in self.tagset.determiners])
        out = np.full(n, -1)
        at, text = np.flatnonzero(head), np.zeros(int(head.sum()), np.int64)
        texts, number, after = [""], {("", 0): 0}, {}
        count = [0]  # a text of no tags takes no hyphen before it
        while len(at):
            out[at] = np.array([known.get(t, -1) for t in texts], np.int64)[text]
            go = (at + 1 < n) & ~head[np.minimum(at + 1, n - 1)]
            at, text = at[go], text[go]
            key = text * len(names) + tag[at]
            used, back = np.unique(key, return_inverse=True)
            to = []
            for k in used.tolist():
                if k not in after:
                    i, t = k // len(names), names[k % len(names)]
                    new = (texts[i], count[i]) if t is None else (f"{t}-{texts[i]}" if count[i] else t, 1)
                    if new[0] not in self.ends:
                        after[k] = -1
                    else:
                        after[k] = number.setdefault(new, len(texts))
                        if after[k] == len(texts):
                            texts.append(new[0])
                            count.append(new[1])
                to.append(after[k])
            text = np.array(to, np.int64)[back] if len(back) else text
            at, text = at[text >= 0] + 1, text[text >= 0]
        return out

    def __call__(self, sentences: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offs = np.append(0, np.cumsum(size))
        flat = sentences.flatten()
        n = len(flat)
        token, tags = flat.field("token"), flat.field("tag").dictionary_encode()
        names = [*tags.dictionary.to_pylist(), self.tagset.start, self.tagset.end, None]
        none, start, end = len(names) - 1, len(names) - 3, len(names) - 2
        tag = pc.fill_null(tags.indices, none).to_numpy(zero_copy_only=False).astype(np.int64)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[offs[:-1][size > 0]] = True
        last[offs[1:][size > 0] - 1] = True
        before, behind = np.full(n, start), np.full(n, end)
        before[1:], behind[:-1] = tag[:-1], tag[1:]
        before[first | (before == none)], behind[last | (behind == none)] = start, end
        best = np.full(n, len(self.classes))
        if self.classes and n:
            score, known, item = np.zeros((n, len(self.classes))), np.zeros((n, len(self.classes)), bool), np.arange(n)
            single = lambda name, x: np.array([-1 if t is None else self.rows[name].get(t, -1) for t in names], np.int64)[x]
            word = pc.fill_null(pc.index_in(token, value_set=self.words), -1).to_numpy(zero_copy_only=False) if len(self.words) else np.full(n, -1)
            rows = [single("pos", tag), np.where(word >= 0, self.word_row[np.maximum(word, 0)], -1) if len(self.words) else word, single("prevpos", before)]
            rows += [self.pairs("prevpos+pos", before, tag, names), self.pairs("pos+nextpos", tag, behind, names), self.since(tag, first, names)]
            for row in rows:
                self.add(item, row, score, known)
            best = np.where(known.any(1), np.where(known, np.round(score, 6), -np.inf).argmax(1), best)
        chunk = self.labels.take(pa.array(best))
        codes = pc.index_in(self.labels, value_set=pc.unique(self.labels)).to_numpy(zero_copy_only=False)[best]
        inside = pc.not_equal(chunk, self.tagset.out).to_numpy(zero_copy_only=False)
        new = inside.copy()
        new[1:] &= first[1:] | (codes[1:] != codes[:-1])
        total = np.append(0, np.cumsum(new))
        number = total[1:] - np.repeat(total[offs[:-1]], size)
        own = pa.StructArray.from_arrays([token, flat.field("tag"), chunk, pa.array(number.astype(np.int32), mask=~inside)], ["token", "tag", "chunk", "chunk_id"])
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), own, mask=pc.is_null(sentences))


def _heads(sentences: pa.Array):
    """Of chunked sentences: offsets, flat rows, their chunks' numbers (-1 outside), and where chunks or tokens outside of them begin."""
    size = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offs, flat = np.append(0, np.cumsum(size)), sentences.flatten()
    number = pc.fill_null(flat.field("chunk_id"), -1).to_numpy(zero_copy_only=False)
    head = np.ones(len(flat), bool)
    head[1:] = (number[1:] < 0) | (number[1:] != number[:-1])
    head[offs[:-1][size > 0]] = True
    return offs, flat, number, head


@functools.cache
def column_spans():
    """An Arrow function of a ``chunked`` column to its chunks ``(node_id, label, start, stop)``."""

    @F.arrow_udf(SPANS)
    def run(sentences: pa.Array) -> pa.Array:
        offs, flat, number, head = _heads(sentences)
        begin = np.flatnonzero(head)
        stop = np.append(begin[1:], len(flat))[: len(begin)]
        own = number[begin] >= 0
        begin, stop = begin[own], stop[own]
        first = offs[np.searchsorted(offs, begin, "right") - 1]
        rows = [pa.array(number[begin].astype(np.int32)), flat.field("chunk").take(pa.array(begin)), pa.array((begin - first).astype(np.int32)), pa.array((stop - first).astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, offs), pa.int32()), pa.StructArray.from_arrays(rows, ["node_id", "label", "start", "stop"]), mask=pc.is_null(sentences))

    return run


@functools.cache
def column_brackets():
    """An Arrow function of a ``chunked`` column to bracket text, as ``brackets`` gives it."""

    @F.arrow_udf("string")
    def run(sentences: pa.Array) -> pa.Array:
        offs, flat, number, head = _heads(sentences)
        inside = number >= 0
        last = np.append(head[1:], True)[: len(flat)]
        word = pc.binary_join_element_wise(flat.field("token"), flat.field("tag"), "/", null_handling="skip")
        opened = pc.binary_join_element_wise("[", flat.field("chunk"), " ", "")
        word = pc.binary_join_element_wise(pc.if_else(pa.array(head & inside), opened, ""), word, pc.if_else(pa.array(last & inside), "]", ""), "")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), word, mask=pc.is_null(sentences)), " ")

    return run


class Chunker:
    """The averaged perceptron over the six features."""

    kind = "chunker"
    backoff = None

    def __init__(self, weights: DataFrame, tagset: T.TagSet = T.CONLL, iterations: int = G.ITERATIONS, seed: int = 0):
        """``weights`` has rows of ``perceptron.WEIGHTS``, or of ``perceptron.STATE`` to train on from where it stopped."""
        self.state, self.tagset, self.iterations, self.seed = weights, tagset, iterations, seed

    @property
    def weights(self) -> DataFrame:
        return P.weights_only(self.state)

    def transform(self, tokens: DataFrame, *keys: str) -> DataFrame:
        """Token rows with ``chunk`` and ``chunk_id``."""
        return with_islands(predict(tokens, self.weights, *keys, tagset=self.tagset), *keys, out=self.tagset.out)

    def transform_column(self, df: DataFrame, tagged: str = "tagged") -> DataFrame:
        """Adds ``chunked`` to rows with a tagged-sentence column.

        A model that is counted to be small is applied in place; with a larger one
        the distinct sentences' tokens are joined with it.
        """
        few = self.weights.limit(SMALL + 1).toArrow()
        if few.num_rows <= SMALL:
            sent = df.sparkSession.sparkContext.broadcast(Decoder(list(zip(*(few.column(c).to_pylist() for c in ("feature", "class", "weight")))), self.tagset))

            @F.arrow_udf(CHUNKED)
            def run(sentences: pa.Array) -> pa.Array:
                return sent.value(sentences)

            return df.withColumn("chunked", run(F.col(tagged)))
        (key,) = fresh(df, "row")
        rows = df.withColumn(key, F.sha2(F.to_json(F.struct(tagged)), 256))
        flat = rows.select(key, tagged).dropDuplicates([key]).select(key, F.posexplode(tagged).alias("pos", "_t")).select(key, "pos", "_t.token", "_t.tag")
        own = column_of(self.transform(flat, key), key)
        return rows.join(own, key, "left").withColumn("chunked", F.when(F.col(tagged).isNotNull(), F.coalesce("chunked", F.array().cast(CHUNKED)))).drop(key)

    def fit(self, tokens: DataFrame, *keys: str) -> "Chunker":
        """Trains on token rows with ``chunk`` labels."""
        iterations, seed, tagset = self.iterations, self.seed, self.tagset
        row = F.sort_array(F.collect_list(F.struct("pos", "token", "tag", "chunk")))
        sentences = tokens.groupBy(*keys).agg(row.alias("tagged")).select(F.to_json(F.struct(*keys, "tagged")).alias("order"), "tagged")

        def fold(many):
            examples = []
            for s in many:
                f = features_of([t["token"] for t in s], [t["tag"] for t in s], tagset)
                examples.append([(x, t["chunk"]) for x, t in zip(f, s)])
            return P.train(examples, iterations, seed, OUT, start.value.copy()).state()

        start = tokens.sparkSession.sparkContext.broadcast(P.Perceptron.of(self.state))
        return Chunker(P.fit_in_one_task(sentences, fold, P.STATE).cache(), tagset, iterations, seed)

    def chunk_text(self, tagger: G.Tagger, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """``(key, text)``: the bracketed chunks of texts, tagged by a tagger."""
        rows = self.transform_column(tagger.tag(df, text, key).filter(F.size("tagged") > 0).select(key, "sent_id", "tagged"))
        shown = rows.select(key, "sent_id", column_brackets()(F.col("chunked")).alias("text"))
        return shown.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "text"))), lambda x: x["text"]), " ").alias("text"))

    def save(self, spark: SparkSession, path: str) -> None:
        M.save(spark, path, {"kind": self.kind, "tagset": self.tagset.name, "iterations": self.iterations, "seed": self.seed}, {"weights": self.state})


def new_chunker(spark: SparkSession, tagset: T.TagSet = T.CONLL, iterations: int = G.ITERATIONS, seed: int = 0) -> Chunker:
    return Chunker(spark.createDataFrame([], P.WEIGHTS), tagset, iterations, seed)


@M.register("chunker")
def _chunker(spark, path, m):
    return Chunker(spark.read.parquet(f"{path}/weights"), T.TAGSETS[m["tagset"]], m["iterations"], m["seed"])


def noun_phrases(tokens: DataFrame, *keys: str, heads: tuple[str, ...] = ("NN", "DT", "AT", "JJ")) -> DataFrame:
    """Span rows ``(keys, start, stop, label)`` of all maximal runs of noun-phrase tags."""
    flagged = tokens.withColumn("chunk", F.when(F.col("tag").isin(*heads), F.lit("C_NP")).otherwise(F.lit(OUT)))
    return with_islands(flagged, *keys).filter("chunk_id IS NOT NULL").groupBy(*keys, "chunk_id").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.first("chunk").alias("label")).drop("chunk_id")


def column_of(tokens: DataFrame, *keys: str) -> DataFrame:
    """Tagged sentences with their chunk labels, and the numbers of chunks where there are any, one row per sentence."""
    names = ["token", "tag", "chunk", *(["chunk_id"] if "chunk_id" in tokens.columns else [])]
    t = F.sort_array(F.collect_list(F.struct("pos", *names)))
    return tokens.groupBy(*keys).agg(F.transform(t, lambda x: F.struct(*(x[n].alias(n) for n in names))).alias("chunked"))


def exists_chunk(chunked: str | Column, label: str) -> Column:
    return F.exists(F.col(chunked) if isinstance(chunked, str) else chunked, lambda t: t["chunk"] == label)

"""Part-of-speech taggers: dictionary, unambiguous and perceptron, with back-off.

A tagger works on rows with a column of tokens (``array<string>``) and adds
``tagged`` (``array<struct<token, tag>>``). What it can't tag is ``Unk`` and
goes to its back-off.
"""

import copy
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tags as T
from ..functions import text as X
from ..sources import corpora as S
from ..sources import models as M
from . import perceptron as P
from .sizes import fresh, sized

UNKNOWN = T.UNKNOWN
ITERATIONS = 5
#: Terms up to which a dictionary is sent to all tasks.
SMALL = 500_000
PADDING = ("-START-", "-START2-"), ("-END-", "-END2-")


def sentence_rows(df: DataFrame, text: str = "text", key: str = "doc_id", splitter: Callable[[Column], Column] = X.sentences) -> DataFrame:
    """``(key, sent_id, sentence)`` of texts."""
    return df.select(key, F.posexplode(splitter(F.col(text))).alias("sent_id", "sentence"))


def token_rows(df: DataFrame, tokens: str = "tokens", *keys: str) -> DataFrame:
    """``(keys, pos, token)`` of token arrays."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def dictionary_tags(tokens: DataFrame, table: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Token rows with the ``tag`` of ``(term, tag)`` rows, else ``Unk``.

    Without case, of terms that fall together the greatest one's tag counts.
    """
    w, t = fresh(tokens, "word", "known")
    words = folded(table, case_sensitive).select(F.col("term").alias(w), F.col("tag").alias(t))
    look = F.col("token") if case_sensitive else F.lower("token")
    return tokens.join(sized(words), look == F.col(w), "left").withColumn("tag", F.coalesce(t, F.lit(UNKNOWN))).drop(w, t)


def folded(table: DataFrame, case_sensitive: bool) -> DataFrame:
    """The dictionary, in lower case where case does not count."""
    return table.select("term", "tag") if case_sensitive else table.groupBy(F.lower("term").alias("term")).agg(F.max_by("tag", "term").alias("tag"))


def unambiguous(tagged_tokens: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """``(term, tag)`` of tokens with one tag; a token with several, or once known as ambiguous, is ``Unk``."""
    rows = tagged_tokens.select(F.col("token").alias("term"), "tag")
    if prior is not None:
        rows = rows.unionByName(prior.select("term", "tag"))
    return rows.groupBy("term").agg(F.when(F.min("tag") == F.max("tag"), F.min("tag")).otherwise(F.lit(UNKNOWN)).alias("tag"))


def accuracy(predicted: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """One row ``(accuracy, n_tokens)`` of token rows that stand at the same places; no tokens give null."""
    (p,) = fresh(gold.select(*keys, "tag"), "predicted")
    both = predicted.select(*keys, F.col("tag").alias(p)).join(gold.select(*keys, "tag"), [*keys])
    right = F.sum((F.col(p) == F.col("tag")).cast("double"))
    return both.agg(F.try_divide(right, F.count("*")).alias("accuracy"), F.count("*").alias("n_tokens"))


def static_features(tokens: DataFrame, *keys: str) -> DataFrame:
    """``(keys, pos, feature, value)``: the ten features of a token that don't depend on earlier tags."""
    w = Window.partitionBy(*keys).orderBy("pos")

    def near(k: int) -> Column:
        if k < 0:
            pad = F.when(F.col("pos") + k == -1, F.lit(PADDING[0][1])).otherwise(F.lit(PADDING[0][0]))
            return F.coalesce(F.lag("token", -k).over(w), pad)
        n = F.count("*").over(Window.partitionBy(*keys))
        pad = F.when(F.col("pos") + k == n, F.lit(PADDING[1][0])).otherwise(F.lit(PADDING[1][1]))
        return F.coalesce(F.lead("token", k).over(w), pad)

    t = tokens.select(*keys, "pos", "token", near(-2).alias("p2"), near(-1).alias("p1"), near(1).alias("n1"), near(2).alias("n2"))
    named = [("bias", F.lit("")), ("suf", X.suffix("token")), ("pre", X.prefix("token")), ("w", F.col("token")), ("p1w", F.col("p1")), ("p1suf", X.suffix("p1")), ("p2w", F.col("p2")), ("n1w", F.col("n1")), ("n1suf", X.suffix("n1")), ("n2w", F.col("n2"))]
    return t.select(*keys, "pos", F.explode(F.array(*[F.concat(F.lit(f"{n}="), c) for n, c in named])).alias("feature"), F.lit(1).alias("value"))


def sentence_features(sentences: DataFrame, *keys: str, tokens: str = "tokens", with_token: bool = False) -> DataFrame:
    """``static_features`` of rows with token arrays, whose neighbours need no exchange; optionally with the ``token`` itself."""
    all_, n = F.col(tokens), F.size(tokens)
    first, second = (F.lit(x) for x in PADDING[0])
    end, end2 = (F.lit(x) for x in PADDING[1])

    def of(t: Column, i: Column) -> Column:
        p1 = F.coalesce(F.get(all_, i - 1), second)
        p2 = F.coalesce(F.get(all_, i - 2), F.when(i == 1, second).otherwise(first))
        n1 = F.coalesce(F.get(all_, i + 1), end)
        n2 = F.coalesce(F.get(all_, i + 2), F.when(i + 2 == n, end).otherwise(end2))
        named = [("bias", F.lit("")), ("suf", X.suffix(t)), ("pre", X.prefix(t)), ("w", t), ("p1w", p1), ("p1suf", X.suffix(p1)), ("p2w", p2), ("n1w", n1), ("n1suf", X.suffix(n1)), ("n2w", n2)]
        return F.array(*[F.concat(F.lit(f"{name}="), c) for name, c in named])

    own = F.transform(all_, lambda t, i: F.struct(t.alias("token"), of(t, i).alias("features")))
    (f,) = fresh(sentences.select(*keys), "own")
    rows = sentences.select(*keys, F.posexplode(own).alias("pos", f))
    return rows.select(*keys, "pos", *([f"{f}.token"] if with_token else []), F.explode(f"{f}.features").alias("feature"), F.lit(1).alias("value"))


def fixed_features(tokens: list[str]) -> list[list[str]]:
    """The ten features of each token as ``static_features`` has them."""
    c = [*PADDING[0], *tokens, *PADDING[1]]
    out = []
    for i in range(2, len(c) - 2):
        w, p1, p2, n1, n2 = c[i], c[i - 1], c[i - 2], c[i + 1], c[i + 2]
        out.append(["bias=", f"suf={w[-3:]}", f"pre={w[:1]}", f"w={w}", f"p1w={p1}", f"p1suf={p1[-3:]}", f"p2w={p2}", f"n1w={n1}", f"n1suf={n1[-3:]}", f"n2w={n2}"])
    return out


def history_features(token: str, prev: str, prev2: str) -> list[str]:
    """The four features of a token that depend on the two tags before."""
    return [f"p1t={prev}", f"p2t={prev2}", f"p12t={prev} {prev2}", f"p1tw={prev} {token}"]


def decode(p: P.Perceptron, tokens: list[str]) -> list[str]:
    """Tags of a sentence from left to right, each with the two tags before as predicted."""
    weights, prev, prev2, out = p.weights, PADDING[0][0], PADDING[0][1], []
    for token, fixed in zip(tokens, fixed_features(tokens)):
        score: dict[str, float] = {}
        for f in (*fixed, *history_features(token, prev, prev2)):
            own = weights.get(f)
            if own:
                for c, w in own.items():
                    score[c] = score.get(c, 0.0) + w
        tag = min(score, key=lambda c: (-round(score[c], 6), c)) if score else UNKNOWN
        prev, prev2 = tag, prev
        out.append(tag)
    return out


class Decoder:
    """``decode`` of many sentences at once: all static features by array operations, then place by place over all sentences.

    Weights are kept by the feature's name (``suf``, ``w``, ...), and its values
    are looked up in Arrow dictionaries, so that no feature is ever spelt out.
    """

    NAMES = {"bias": ("", 0), "suf": ("suffix", 0), "pre": ("prefix", 0), "w": ("token", 0), "p1w": ("token", -1), "p1suf": ("suffix", -1), "p2w": ("token", -2), "n1w": ("token", 1), "n1suf": ("suffix", 1), "n2w": ("token", 2)}
    #: Tokens whose scores are held together.
    TOGETHER = 1 << 16

    def __init__(self, weights: dict[str, dict[str, float]]):
        self.classes = sorted({c for own in weights.values() for c in own})
        number = {c: i for i, c in enumerate(self.classes)}
        self.tags = [*self.classes, *(t for t in (UNKNOWN, *PADDING[0]) if t not in number)]
        tag = {t: i for i, t in enumerate(self.tags)}
        self.unknown, self.first, self.second = (tag[t] for t in (UNKNOWN, *PADDING[0]))
        rows = sorted((f.partition("=")[0], f.partition("=")[2], [(number[c], w) for c, w in own.items()]) for f, own in weights.items() if own)
        self.size = np.array([len(own) for *_, own in rows], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.cls = np.array([c for *_, own in rows for c, _ in own], np.int64)
        self.weight = np.array([w for *_, own in rows for _, w in own], float)
        by: dict[str, list[tuple[str, int]]] = {}
        for i, (name, value, _) in enumerate(rows):
            by.setdefault(name, []).append((value, i))
        self.values = {n: (pa.array([v for v, _ in x], pa.string()), np.array([i for _, i in x])) for n, x in by.items() if n in self.NAMES}
        n = len(self.tags)
        self.one, self.two, self.both = np.full(n, -1), np.full(n, -1), np.full(n * n, -1)
        for table, name in ((self.one, "p1t"), (self.two, "p2t")):
            for v, i in by.get(name, []):
                if v in tag:
                    table[tag[v]] = i
        for v, i in by.get("p12t", []):
            a, _, b = v.partition(" ")
            if a in tag and b in tag:
                self.both[tag[a] * n + tag[b]] = i
        pairs = [(tag[v.partition(" ")[0]], v.partition(" ")[2], i) for v, i in by.get("p1tw", []) if v.partition(" ")[0] in tag]
        words = sorted({w for _, w, _ in pairs})
        place = {w: k for k, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        keys = sorted((t * len(words) + place[w], i) for t, w, i in pairs)
        self.pair, self.pair_row = np.array([k for k, _ in keys], np.int64), np.array([i for _, i in keys], np.int64)

    def _add(self, item: np.ndarray, row: np.ndarray, n: int, score: np.ndarray, known: np.ndarray) -> None:
        """Adds the weights of feature rows to the items that have them."""
        have = row >= 0
        item, row = item[have], row[have]
        size = self.size[row]
        at = np.repeat(self.begin[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(item, size) * len(self.classes) + self.cls[at]
        score += np.bincount(cell, self.weight[at], n * len(self.classes)).reshape(score.shape)
        known += np.bincount(cell, minlength=n * len(self.classes)).reshape(known.shape) > 0

    @staticmethod
    def _look(column: pa.Array, values: pa.Array, rows: np.ndarray) -> np.ndarray:
        i = pc.fill_null(pc.index_in(column, value_set=values), -1).to_numpy(zero_copy_only=False)
        return np.where(i >= 0, rows[np.maximum(i, 0)], -1) if len(rows) else np.full(len(column), -1)

    def tag(self, tokens: pa.Array, offs: np.ndarray) -> np.ndarray:
        """Numbers in ``tags`` of the flat tokens of sentences."""
        out = np.full(len(tokens), self.unknown)
        if not self.classes:
            return out
        cuts = [0]
        for k in range(1, len(offs)):  # whole sentences
            if offs[k] - offs[cuts[-1]] > self.TOGETHER and k - 1 > cuts[-1]:
                cuts.append(k - 1)
        for a, b in zip(cuts, [*cuts[1:], len(offs) - 1]):
            x, y = int(offs[a]), int(offs[b])
            out[x:y] = self._tag(tokens.slice(x, y - x), np.asarray(offs[a : b + 1]) - x)
        return out

    def _tag(self, tokens: pa.Array, offs: np.ndarray) -> np.ndarray:
        n, size = len(tokens), np.diff(offs)
        # the tokens between two marks before and two behind each sentence
        marks = pa.array([*PADDING[0], *PADDING[1]], pa.string())
        at = np.arange(n) + 4 * np.repeat(np.arange(len(size)), size) + 2
        take = np.empty(n + 4 * len(size), np.int64)
        take[at] = np.arange(n)
        for k, shift in enumerate((0, 1, 2, 3)):
            take[offs[:-1] + 4 * np.arange(len(size)) + shift + (size if k > 1 else 0)] = n + k
        padded = pa.concat_arrays([pc.fill_null(tokens.cast(pa.string()), ""), marks]).take(pa.array(take))
        columns = {"token": padded, "suffix": pc.utf8_slice_codeunits(padded, start=-3), "prefix": pc.utf8_slice_codeunits(padded, start=0, stop=1)}
        score, known = np.zeros((n, len(self.classes))), np.zeros((n, len(self.classes)), np.int32)
        item = np.arange(n)
        for name, (values, rows) in self.values.items():
            column, shift = self.NAMES[name]
            row = self._look(columns[column], values, rows)[at + shift] if column else np.full(n, rows[0] if values[0].as_py() == "" else -1)
            self._add(item, row, n, score, known)
        word = self._look(padded, self.words, np.arange(len(self.words)))[at]
        out = np.full(n, self.unknown)
        order = np.argsort(-size, kind="stable")
        start, size = offs[:-1][order], size[order]
        one, two = np.full(len(order), self.first), np.full(len(order), self.second)
        for i in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -i, "left"))  # sentences that have a token here
            t = start[:m] + i
            s, k, who = score[t], known[t], np.arange(m)
            p1, p2 = one[:m], two[:m]
            for row in (self.one[p1], self.two[p2], self.both[p1 * len(self.tags) + p2]):
                self._add(who, row, m, s, k)
            if len(self.pair):
                key = np.where(word[t] >= 0, p1 * len(self.words) + word[t], -1)
                j = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                self._add(who, np.where(self.pair[j] == key, self.pair_row[j], -1), m, s, k)
            best = np.where(k > 0, np.round(s, 6), -np.inf).argmax(1)
            got = np.where(k.any(1), best, self.unknown)
            out[t] = got
            two[:m], one[:m] = p1.copy(), got
        return out

    def tag_arrays(self, sentences: pa.Array) -> pa.Array:
        """``array<string>`` of tags of an ``array<string>`` of tokens; null stays null."""
        offs = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)))
        names = pa.array(self.tags, pa.string()).take(pa.array(self.tag(sentences.flatten(), offs)))
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), names, mask=pc.is_null(sentences)) if sentences.null_count else pa.ListArray.from_arrays(pa.array(offs, pa.int32()), names)


def training_sequence(tagged: list[dict]) -> list[tuple[list[str], str]]:
    """(features, class) of each token, with the true tags as history."""
    tokens, tags = [t["token"] for t in tagged], [t["tag"] for t in tagged]
    history = [PADDING[0][1], PADDING[0][0], *tags]
    return [(fixed + history_features(w, history[i + 1], history[i]), tag) for i, (w, fixed, tag) in enumerate(zip(tokens, fixed_features(tokens), tags))]


class Tagger:
    """What all taggers do; ``kind`` names them in the registry of models."""

    kind = ""
    backoff: "Tagger | None" = None

    def using(self, tokenizer: Callable[[Column], Column] | None = None, splitter: Callable[[Column], Column] | None = None) -> "Tagger":
        """The same tagger with another tokenizer or sentence splitter, each a function of a text column to an array."""
        other = copy.copy(self)
        if tokenizer is not None:
            other.tokenizer = tokenizer
        if splitter is not None:
            other.splitter = splitter
        return other

    def tokenizer(self, text: Column) -> Column:
        return X.tokenize(text)

    def splitter(self, text: Column) -> Column:
        return X.sentences(text)

    def own(self, df: DataFrame, tokens: str) -> DataFrame:
        raise NotImplementedError

    def fit(self, tagged: DataFrame) -> "Tagger":
        """Trains on rows with a ``tagged`` column, this tagger and its back-offs alike."""
        raise NotImplementedError

    def transform(self, df: DataFrame, tokens: str = "tokens") -> DataFrame:
        """Adds ``tagged``; what is unknown comes from the back-off."""
        out = self.own(df, tokens)
        if self.backoff is not None:
            (first,) = fresh(out, "first")
            out = self.backoff.transform(out.withColumnRenamed("tagged", first), tokens)
            out = out.withColumn("tagged", X.combine(first, "tagged")).drop(first)
        return out

    def tag(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """``(key, sent_id, tokens, tagged)`` of texts."""
        rows = sentence_rows(df, text, key, self.splitter)
        return self.transform(rows.select(key, "sent_id", self.tokenizer(F.col("sentence")).alias("tokens")))

    def tag_text(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """``(key, text)`` of printed tags, the sentences in order with spaces between."""
        rows = self.tag(df, text, key).select(key, "sent_id", X.print_tagged("tagged").alias("_s"))
        return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "_s"))), lambda x: x["_s"]), " ").alias("text"))

    def fit_text(self, df: DataFrame, text: str = "text", tagset: T.TagSet = T.RAW, key: str = "doc_id", compat: bool = False) -> "Tagger":
        """Trains on ``token/TAG`` texts, a sentence per line; with ``compat`` every token is a sentence."""
        rows = S.lines(df, text, key)
        if compat:
            words = F.explode(X.tokenize("line")).alias("line")
            rows = rows.select(key, "line_no", words)
        return self.fit(rows.select(key, "line_no", S.tagged_words("line", tagset).alias("tagged")).filter(F.size("tagged") > 0))

    def fit_files(self, spark: SparkSession, paths: list[str], tagset: T.TagSet = T.RAW) -> "Tagger":
        """Trains on files of ``token/TAG`` lines one after the other, each going on from what the one before left (its averages, totals and dictionary)."""
        tagger = self
        for path in paths:
            tagger = tagger.fit_text(S.read_text(spark, path), tagset=tagset)
        return tagger

    def evaluate(self, gold: DataFrame, use_backoff: bool = True) -> DataFrame:
        """``(accuracy, n_tokens)`` on rows with a ``tagged`` column; null without tokens."""
        rows = gold.select(F.col("tagged").alias("_gold"), X.strip_tags("tagged").alias("tokens"))
        out = self.transform(rows) if use_backoff else self.own(rows, "tokens")
        both = out.select(F.explode(F.arrays_zip(X.only_tags("_gold").alias("g"), X.only_tags("tagged").alias("p"))).alias("z"))
        return both.agg(F.try_divide(F.sum((F.col("z.g") == F.col("z.p")).cast("double")), F.count("*")).alias("accuracy"), F.count("*").alias("n_tokens"))


def _mapped(df: DataFrame, tokens: str, table: DataFrame, case_sensitive: bool) -> DataFrame:
    """Dictionary look-up of token arrays.

    A dictionary counted to be small is looked up in place; with a larger one the
    distinct arrays' tokens are joined.
    """
    words = folded(table, case_sensitive)
    few = words.limit(SMALL + 1).toArrow()
    if few.num_rows <= SMALL:
        few = few.combine_chunks().filter(pc.is_valid(few.column("term"))) if few.num_rows else few
        sent = df.sparkSession.sparkContext.broadcast((few.column("term").combine_chunks(), few.column("tag").combine_chunks()))

        @F.arrow_udf("array<string>")
        def tags(sentences: pa.Array) -> pa.Array:
            terms, own = sent.value
            flat = sentences.flatten()
            i = pc.index_in(flat if case_sensitive else pc.utf8_lower(flat), value_set=terms) if len(terms) else pa.nulls(len(flat), pa.int32())
            found = pc.fill_null(own.take(i) if len(terms) else pa.nulls(len(flat), pa.string()), UNKNOWN)
            offs = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)))
            return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), found)

        return df.withColumn("tagged", X.apply_tags(tokens, tags(F.coalesce(F.col(tokens), F.array().cast("array<string>")))))
    (key,) = fresh(df, "row")
    rows = df.withColumn(key, F.sha2(F.to_json(F.struct(tokens)), 256))
    flat = rows.select(key, tokens).dropDuplicates([key]).select(key, F.posexplode(tokens).alias("pos", "token"))
    tagged = dictionary_tags(flat, table, case_sensitive)
    arrays = tagged.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))), lambda x: F.struct(x["token"], x["tag"])).alias("tagged"))
    empty = F.array().cast("array<struct<token:string,tag:string>>")
    return rows.join(arrays, key, "left").withColumn("tagged", F.coalesce("tagged", empty)).drop(key)


class LiteralTagger(Tagger):
    """Tags by a dictionary of terms; terms of several words stay one token."""

    kind = "literal"

    def __init__(self, table: DataFrame, case_sensitive: bool = True, backoff: Tagger | None = None, terms: list[str] | None = None):
        """``table`` has rows ``(term, tag)``. ``terms`` are the ones to protect; by default those with other than word characters."""
        self.table, self.case_sensitive, self.backoff, self._terms = table, case_sensitive, backoff, terms

    @functools.cached_property
    def terms(self) -> list[str]:
        return self._terms if self._terms is not None else [r[0] for r in self.table.filter(F.col("term").rlike(r"\W")).select("term").distinct().toLocalIterator()]

    def tokenizer(self, text):
        return X.protect_terms(text, self.terms, self.case_sensitive)

    def own(self, df, tokens):
        return _mapped(df, tokens, self.table, self.case_sensitive)

    def fit(self, tagged):
        """A dictionary has nothing to learn; its back-off has."""
        return type(self)(self.table, self.case_sensitive, self.backoff and self.backoff.fit(tagged), self._terms)

    def save(self, spark: SparkSession, path: str) -> None:
        M.save(spark, path, {"kind": self.kind, "case_sensitive": self.case_sensitive, "terms": self._terms}, {"table": self.table}, self.backoff)


class UnambiguousTagger(LiteralTagger):
    """A dictionary of the tokens that had one tag only in training."""

    kind = "unambiguous"

    def __init__(self, table: DataFrame, case_sensitive: bool = True, backoff: Tagger | None = None, terms: list[str] | None = None):
        super().__init__(table, case_sensitive, backoff, terms if terms is not None else [])

    def fit(self, tagged):
        rows = tagged.select(F.explode("tagged").alias("t")).select("t.token", "t.tag")
        return type(self)(unambiguous(rows, self.table), self.case_sensitive, self.backoff and self.backoff.fit(tagged))


class PerceptronTagger(Tagger):
    """The averaged perceptron, decoded from left to right."""

    kind = "perceptron"

    def __init__(self, weights: DataFrame, backoff: Tagger | None = None, iterations: int = ITERATIONS, seed: int = 0):
        """``weights`` has rows of ``perceptron.WEIGHTS``, or of ``perceptron.STATE`` to train on from where it stopped."""
        self.state, self.backoff, self.iterations, self.seed = weights, backoff, iterations, seed

    @property
    def weights(self) -> DataFrame:
        return P.weights_only(self.state)

    @functools.cached_property
    def model(self) -> P.Perceptron:
        return P.Perceptron.of(self.state)

    def own(self, df, tokens):
        sent = df.sparkSession.sparkContext.broadcast(Decoder(self.model.weights))

        @F.arrow_udf("array<string>")
        def tags(sentences: pa.Array) -> pa.Array:
            return sent.value.tag_arrays(sentences)

        return df.withColumn("tagged", X.apply_tags(tokens, tags(F.col(tokens))))

    def fit(self, tagged):
        iterations, seed = self.iterations, self.seed
        start = tagged.sparkSession.sparkContext.broadcast(self.model)

        def fold(sentences):
            return P.train([training_sequence(s) for s in sentences], iterations, seed, UNKNOWN, start.value.copy()).state()

        rows = tagged.select(F.to_json(F.struct(*[c for c in tagged.columns if c != "tagged"], "tagged")).alias("order"), "tagged")
        return type(self)(P.fit_in_one_task(rows, fold, P.STATE).cache(), self.backoff and self.backoff.fit(tagged), iterations, seed)

    def save(self, spark, path):
        M.save(spark, path, {"kind": self.kind, "iterations": self.iterations, "seed": self.seed}, {"weights": self.state}, self.backoff)


def new_tagger(spark: SparkSession, iterations: int = ITERATIONS, seed: int = 0) -> Tagger:
    """The untrained stack: unambiguous tokens first, then the perceptron."""
    empty = spark.createDataFrame([], "term string, tag string")
    return UnambiguousTagger(empty, backoff=PerceptronTagger(spark.createDataFrame([], P.WEIGHTS), None, iterations, seed))


@M.register("literal")
def _literal(spark, path, m):
    return LiteralTagger(spark.read.parquet(f"{path}/table"), m["case_sensitive"], None, m["terms"])


@M.register("unambiguous")
def _unambiguous(spark, path, m):
    return UnambiguousTagger(spark.read.parquet(f"{path}/table"), m["case_sensitive"], None, m["terms"])


@M.register("perceptron")
def _perceptron(spark, path, m):
    return PerceptronTagger(spark.read.parquet(f"{path}/weights"), None, m["iterations"], m["seed"])

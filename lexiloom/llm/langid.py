"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability in a language is the sum, over all ways to cut it into
pieces, of the product of their probabilities; a forward pass finds the sum. A
text's score is that of its words together, and the language of the greatest
score is given (of equal ones the first in the alphabet).

Words are the maximal runs of letters of the lower-cased text, with the
vocabulary's mark of a word's beginning put before. A letter that is no piece
counts as a piece of probability ``FLOOR``. Words above ``LONGEST`` letters are
summed in logarithms, as products of so many letters leave the range of a
number; that is slower and gives the same. Distinct words are scored once per
worker process and looked up after that.

Training takes at most ``rows`` documents of each of at most ``languages``
languages in the column ``lang`` (a bounded sample: the languages of the most
documents, and of each the lowest key hashes; of rows that repeat an id one) and
fits the probabilities by expectation-maximisation; a part of the mean over
languages is mixed in.

``accepted`` is 0 for texts without letters, and for those whose mean
log-probability per letter lies more than ``FAR`` nats below that of the
training sample and so far below that its spread makes chance impossible
(``SURE`` standard errors). Such texts have no or no known language; all others
are accepted.

Null or empty texts have no language, score 0 and are not accepted; rows with
a null doc_id are left out; repeated rows are scored each; very long texts are
read whole. Without labelled languages, no text has a language and texts with
letters are accepted. An empty table gives no rows. Other columns are ignored
(``keep_known`` keeps them).
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as X
from ._tokens import FOLDER

VOCABULARY = f"{FOLDER}/piece_bpe_32k.model"
#: The most training documents of a language, and the most languages.
ROWS, LANGUAGES = 400, 200
ROUNDS, MIXED, FLOOR, LONGEST = 5, 0.02, 1e-7, 60
FAR, SURE = 1.0, 6.0
#: Probabilities are multiplied by this per letter, so that long words don't underflow.
SCALE = np.e**4
MARK = 0x2581
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 1_500_000
#: Words whose lattices are worked on together.
PORTION = 20_000
B = np.uint64(0x9E3779B97F4A7C15)


def piece_hash(piece: str) -> int:
    h = len(piece) * 0xD6E8FEB86659FD93
    p = 0
    for c in piece:
        p = (p * int(B) + ord(c) + 1) & (1 << 64) - 1
    return (p ^ h) & (1 << 64) - 1


def vocabulary(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, lengths) of the pieces of lower-case letters, with or without the mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    fit = [chr(MARK), *(p for p in found if p.lstrip(chr(MARK)).isalpha() and p == p.lower() and chr(MARK) not in p[1:])]
    keys, at = np.unique(np.array([*map(piece_hash, fit)], np.uint64), return_index=True)
    return keys, np.array([len(p) for p in fit])[at]


@dataclass
class Lattice:
    """The pieces that may stand in each of some words, in order of their ends."""

    start: np.ndarray  # node before the piece; the nodes of word w begin at first[w]
    end: np.ndarray
    piece: np.ndarray  # row of the piece, the last row being that of unknown letters
    first: np.ndarray
    last: np.ndarray
    steps: np.ndarray  # pieces that end after t letters begin at steps[t]


def lattice(words: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, longest: int) -> Lattice:
    """All pieces, of at most ``longest`` letters, in the words given as (codes, starts, ends)."""
    codes, a, b = words
    n = b - a + 1  # with the mark
    first = np.cumsum(n + 1) - n - 1  # one node more than letters
    total = int(n.sum())
    begin = np.cumsum(n) - n
    inner = np.arange(total) - np.repeat(begin, n)
    c = np.full(total, MARK, np.uint64)
    plain = inner > 0
    c[plain] = codes[(np.repeat(a, n) + inner - 1)[plain]]
    left = np.repeat(n, n) - inner  # letters from here to the word's end
    node = np.repeat(first, n) + inner
    bits = np.zeros(1 << 20, bool)
    bits[(keys >> np.uint64(44)).astype(np.int64)] = True
    starts, ends, pieces, known = [], [], [], np.zeros(total, bool)
    h = np.zeros(total, np.uint64)
    for size in range(1, min(longest, int(n.max(initial=0))) + 1):
        h = h[: total - size + 1] * B + c[size - 1 :] + np.uint64(1)
        g = h ^ np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        at = np.flatnonzero(bits[(g >> np.uint64(44)).astype(np.int64)] & (left[: len(g)] >= size))
        i = np.searchsorted(keys, g[at])
        i[i == len(keys)] = 0
        ok = keys[i] == g[at]
        at, i = at[ok], i[ok]
        if size == 1:
            known[at] = True
        starts.append(node[at])
        ends.append(node[at] + size)
        pieces.append(i)
    lone = np.flatnonzero(~known)
    starts.append(node[lone])
    ends.append(node[lone] + 1)
    pieces.append(np.full(len(lone), len(keys)))
    start, end, piece = map(np.concatenate, (starts, ends, pieces))
    step = np.zeros(int((n + 1).sum()), np.int32)
    step[:] = np.arange(len(step)) - np.repeat(first, n + 1)
    order = np.argsort(step[end].astype(np.int64) << 40 | end, kind="stable")
    start, end, piece = (v[order].astype(np.int32) for v in (start, end, piece))
    return Lattice(start, end, piece, first, first + n, np.searchsorted(step[end], np.arange(int(n.max(initial=0)) + 2)))


def forward(x: Lattice, p: np.ndarray) -> np.ndarray:
    """Of every node, the sum over the segmentations of what lies before it; a column per language."""
    alpha = np.zeros((int(x.last[-1]) + 1 if len(x.last) else 0, p.shape[1]))
    alpha[x.first] = 1
    for t in range(1, len(x.steps) - 1):
        a, b = x.steps[t], x.steps[t + 1]
        if a < b:
            end = x.end[a:b]
            cut = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            alpha[end[cut]] = np.add.reduceat(alpha[x.start[a:b]] * p[x.piece[a:b]], cut, axis=0)
    return alpha


def expected(x: Lattice, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by language; ``weight`` has the words' counts."""
    alpha = forward(x, p)
    beta = np.zeros_like(alpha)
    beta[x.last] = weight / np.maximum(alpha[x.last], 1e-300)
    out = np.zeros_like(p)
    for t in range(len(x.steps) - 2, 0, -1):
        a, b = x.steps[t], x.steps[t + 1]
        if a < b:
            s, e, k = x.start[a:b], x.end[a:b], x.piece[a:b]
            flow = p[k] * beta[e]
            use = alpha[s] * flow
            for g in range(p.shape[1]):
                out[:, g] += np.bincount(k, use[:, g], len(p))
                beta[:, g] += np.bincount(s, flow[:, g], len(beta))
    return out


def forward_log(x: Lattice, q: np.ndarray) -> np.ndarray:
    """``forward`` in logarithms."""
    alpha = np.full((int(x.last[-1]) + 1 if len(x.last) else 0, q.shape[1]), -np.inf)
    alpha[x.first] = 0
    for t in range(1, len(x.steps) - 1):
        a, b = x.steps[t], x.steps[t + 1]
        if a < b:
            end = x.end[a:b]
            cut = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            alpha[end[cut]] = np.logaddexp.reduceat(alpha[x.start[a:b]] + q[x.piece[a:b]], cut, axis=0)
    return alpha


def expected_log(x: Lattice, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``expected`` in logarithms."""
    alpha = forward_log(x, q)
    beta = np.full_like(alpha, -np.inf)
    with np.errstate(divide="ignore"):
        beta[x.last] = np.log(weight) - alpha[x.last]
    out = np.zeros_like(q)
    for t in range(len(x.steps) - 2, 0, -1):
        a, b = x.steps[t], x.steps[t + 1]
        if a < b:
            s, e, k = x.start[a:b], x.end[a:b], x.piece[a:b]
            flow = q[k] + beta[e]
            np.add.at(out, k, np.exp(alpha[s] + flow))
            np.logaddexp.at(beta, s, flow)
    return out


def portions(size: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """The words of these sizes in parts that are worked on together, and whether a part's words are long."""
    long = size > LONGEST
    out = []
    for flag in (False, True):
        own = np.flatnonzero(long == flag)
        if len(own):
            part = np.cumsum(size[own]) // (PORTION * 10)
            out += [(x, flag) for x in np.split(own, np.flatnonzero(np.diff(part)) + 1)]
    return out


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends, document) of the words of the texts."""
    codes, offs = X.flat(texts, lower=True)
    a, b, doc = X.word_spans(codes, offs, "alpha")
    return codes, a, b, doc


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray
    p: np.ndarray  # probability times SCALE to the length, by piece and language; the last row is an unknown letter's
    longest: int = 16  # letters of the longest piece
    mean: float = 0.0
    spread: float = 0.0
    memory: tuple = field(default=None, repr=False)

    def word_scores(self, codes, a, b) -> np.ndarray:
        """Log-probabilities of words, a column per language."""
        h = X.word_hashes(codes, a, b)
        uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
        if self.memory is None or len(self.memory[0]) + len(uniq) > REMEMBERED:
            self.memory = (np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32))
        have, scores = self.memory
        i = np.searchsorted(have, uniq)
        new = np.ones(len(uniq), bool)
        inside = i < len(have)
        new[inside] = have[i[inside]] != uniq[inside]
        fresh = np.flatnonzero(new)
        if len(fresh):
            begin, end = a[where[fresh]], b[where[fresh]]
            own = np.zeros((len(fresh), len(self.langs)), np.float32)
            for part, long in portions(end - begin):
                x = lattice((codes, begin[part], end[part]), self.keys, self.longest)
                last = forward_log(x, np.log(self.p))[x.last] if long else np.log(forward(x, self.p)[x.last])
                own[part] = last - np.log(SCALE) * (end[part] - begin[part] + 1)[:, None]
            have = np.insert(have, i[fresh], uniq[fresh])
            scores = np.insert(scores, i[fresh], own, axis=0)
            self.memory = have, scores
            i = np.searchsorted(have, uniq)
        return scores[i][back]

    def text_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities by language, letters) of texts."""
        codes, a, b, doc = letter_runs(texts)
        letters = np.bincount(doc, b - a, len(texts))
        out = np.zeros((len(texts), len(self.langs)))
        if len(a) and self.langs:
            s = self.word_scores(codes, a, b)
            for g in range(len(self.langs)):
                out[:, g] = np.bincount(doc, s[:, g], len(texts))
        return out, letters

    def accept(self, best: np.ndarray, letters: np.ndarray) -> np.ndarray:
        below = self.mean - best / np.maximum(letters, 1)
        return (letters > 0) & ~((below > FAR) & (below * np.sqrt(letters) > SURE * self.spread))


def fit(rows: list[tuple[str, str]], path: str = VOCABULARY) -> Model:
    """A model from (lang, text) rows."""
    keys, size = vocabulary(path)
    rows = sorted(rows)
    langs = sorted({g for g, _ in rows})
    p = np.full((len(keys) + 1, len(langs)), 1 / len(keys))
    m = Model(langs, keys, p, int(size.max()))
    if not langs:
        return m
    texts = [t for _, t in rows]
    own = np.array([langs.index(g) for g, _ in rows])
    codes, a, b, doc = letter_runs(texts)
    if not len(a):
        return Model([], keys, p[:, :0], int(size.max()))
    h = X.word_hashes(codes, a, b)
    uniq, where, back = np.unique(h, return_index=True, return_inverse=True)
    weight = np.bincount(back * len(langs) + own[doc], minlength=len(uniq) * len(langs)).reshape(len(uniq), len(langs)).astype(float)
    # scaled by length: the scale cancels where words are compared, and in the expectations
    scale = SCALE ** np.append(size, 1.0)[:, None]
    parts = portions(b[where] - a[where])
    lattices = [lattice((codes, a[where[i]], b[where[i]]), keys, m.longest) for i, _ in parts]
    for _ in range(ROUNDS):
        q = np.where(np.arange(len(p))[:, None] < len(keys), p, FLOOR) * scale
        e = sum(expected_log(x, np.log(q), weight[i]) if long else expected(x, q, weight[i]) for x, (i, long) in zip(lattices, parts))[:-1]
        e = e / np.maximum(e.sum(0), 1e-300) + 1e-9
        e = (1 - MIXED) * e + MIXED * e.mean(1, keepdims=True)
        p[:-1] = e / e.sum(0)
    m.p = np.where(np.arange(len(p))[:, None] < len(keys), p, FLOOR) * scale
    score, letters = m.text_scores(texts)
    some = letters > 0
    each = (score.max(1) / np.maximum(letters, 1))[some]
    m.mean = float(np.average(each, weights=letters[some]))
    m.spread = float(np.sqrt(np.average((each - m.mean) ** 2 * letters[some])))
    m.memory = None
    return m


def train(docs: DataFrame, rows: int = ROWS, path: str = VOCABULARY, languages: int = LANGUAGES) -> Model:
    """A model from at most ``rows`` documents of each of at most ``languages`` languages."""
    key, lang = F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")
    named = X.usable(docs.select(key, lang, "text"), "doc_id", "lang", "text")
    many = X.usable(docs.select(key, lang), "doc_id", "lang").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = named.select("doc_id", "lang").join(F.broadcast(many), "lang").withColumn("place", place).filter(F.col("place") <= rows).select("doc_id", "lang").distinct()
    got = X.one_each(named, few, "doc_id", "lang").select("lang", "text").toArrow()
    return fit(list(zip(got.column("lang").to_pylist(), got.column("text").to_pylist())), path)


def _score(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        names = np.array([*m.langs, None], object)
        for part in X.slices(batches, chars=2 * X.CHARS):
            score, letters = m.text_scores(part.column(1).to_pylist())
            if m.langs:
                best = score.argmax(1)
                top = score[np.arange(len(best)), best]
                rest = np.sort(score, 1)[:, -2] if len(m.langs) > 1 else top
                lang = names[np.where(letters > 0, best, -1)]
            else:
                top = rest = np.zeros(len(letters))
                lang = np.full(len(letters), None)
            per = np.maximum(letters, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(top / per), pa.array((top - rest) / per), pa.array(m.accept(top, letters).astype(np.int32))], ["doc_id", "lang", "score", "margin", "accepted"])

    return docs.mapInArrow(run, "doc_id long, lang string, score double, margin double, accepted int")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang, score, margin, accepted)``; ``score`` is per letter and ``margin`` its lead over the second language."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _score(whole.filter(F.col("doc_id").isNotNull()), model)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are accepted, with all their columns; rows with a null doc_id or text go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        m = sent.value
        for part in X.slices(batches, docs_text, 2 * X.CHARS):
            score, letters = m.text_scores(part.column(place).to_pylist())
            top = score.max(1) if m.langs else np.zeros(len(letters))
            yield part.filter(pa.array(m.accept(top, letters)))

    docs_text = "text"
    schema = docs.schema
    return docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    return identify(docs, train(docs))

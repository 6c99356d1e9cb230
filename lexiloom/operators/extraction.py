"""Patterns over tagged sentences: parser combinators and their use on DataFrames.

A parser takes (sentence, place) and tells whether it succeeded and whether it
consumed anything. As is usual for predictive parsers, an alternative is tried
only if the one before failed without consuming; ``attempt`` makes a failure
count as if nothing had been consumed. A sentence is a list of (token, tag).
"""

import functools
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<ok:boolean,error:string,label:string,start:int,stop:int,spans:array<struct<node_id:int,parent_id:int,depth:int,label:string,start:int,stop:int>>>"


class Result(NamedTuple):
    ok: bool
    consumed: bool
    value: Any
    at: int


class Watch:
    """A sentence that notes what a parser reads of it: the farthest place, and for which tests of tokens."""

    def __init__(self, items: list):
        self.items, self.far, self.near, self.reads, self.calls, self.plain = items, -1, 0, set(), 0, False

    def look(self, i: int, reads):
        if i > self.far:
            self.far = i
        if i < self.near:
            self.near = i
        if reads is not None:
            self.reads.add(reads)
        return self.items[i] if i < len(self.items) else None

    def __len__(self):
        self.plain = True  # what a parser does with it is not known
        return len(self.items)

    def __getitem__(self, i):
        self.plain = True
        return self.items[i]


#: What a test reads besides the tag: the whole token, or whether it is a certain text.
WHOLE = ("token", None, True)


def _look(s, i: int, reads=None):
    """The element at a place, or None behind the last."""
    if type(s) is Watch:
        return s.look(i, reads)
    return s[i] if i < len(s) else None


class Parser:
    __slots__ = ("run", "watched")

    def __init__(self, run: Callable[[list, int], Result], watched: bool = False):
        """``watched`` if ``run`` reads sentences through ``_look`` and runs other parsers through ``go`` only."""
        self.run, self.watched = run, watched

    def go(self, s, i: int) -> Result:
        if not self.watched and type(s) is Watch:
            s.plain = True
        return self.run(s, i)

    def then(self, f: Callable[[Any], "Parser"]) -> "Parser":
        """This parser, then the one that its value gives."""

        def run(s, i):
            a = self.go(s, i)
            if not a.ok:
                return a
            if type(s) is Watch:
                s.calls += 1
            b = f(a.value).go(s, a.at)
            return b if b.consumed or not a.consumed else Result(b.ok, True, b.value, b.at)

        return Parser(run, True)

    def map(self, f: Callable[[Any], Any]) -> "Parser":
        return self.then(lambda v: pure(f(v)))

    def shaped(self, f: Callable[[Any], Any]) -> "Parser":
        """``map`` by a function to which the number of the place means nothing."""

        def run(s, i):
            a = self.go(s, i)
            return Result(True, a.consumed, f(a.value), a.at) if a.ok else a

        return Parser(run, True)

    def __or__(self, other: "Parser") -> "Parser":
        def run(s, i):
            a = self.go(s, i)
            return a if a.ok or a.consumed else other.go(s, i)

        return Parser(run, True)


class Item(NamedTuple):
    """An element of a chunked sentence: a token, or with ``chunk`` a whole chunk, whose text and label stand for token and tag."""

    token: str
    tag: str
    chunk: bool
    start: int
    stop: int


class Node(NamedTuple):
    """A chunk, or with ``children`` None a token, over the places start to stop."""

    label: str
    start: int
    stop: int
    children: tuple | None


def pure(value) -> Parser:
    return Parser(lambda s, i: Result(True, False, value, i), True)


def fail(message: str) -> Parser:
    return Parser(lambda s, i: Result(False, False, message, i), True)


def attempt(p: Parser) -> Parser:
    """Fails without consuming where ``p`` fails."""

    def run(s, i):
        r = p.go(s, i)
        return r if r.ok else Result(False, False, r.value, i)

    return Parser(run, True)


def look_ahead(p: Parser) -> Parser:
    """The value of ``p`` without moving on; a failure after consuming stays one."""

    def run(s, i):
        r = p.go(s, i)
        return Result(True, False, r.value, i) if r.ok else r

    return Parser(run, True)


def choice(*parsers: Parser) -> Parser:
    out = fail("no alternative")
    for p in reversed(parsers):
        out = p | out
    return out


def in_order(*parsers: Parser) -> Parser:
    """One parser behind the other; the list of their values."""

    def run(s, i):
        out, moved, at = [], False, i
        for p in parsers:
            r = p.go(s, at)
            moved = moved or r.consumed
            if not r.ok:
                return Result(False, moved, r.value, r.at)
            out.append(r.value)
            at = r.at
        return Result(True, moved, out, at)

    return Parser(run, True)


def many(p: Parser) -> Parser:
    def run(s, i):
        out, at, moved = [], i, False
        while True:
            r = p.go(s, at)
            if not r.ok:
                return Result(False, True, r.value, r.at) if r.consumed else Result(True, moved, out, at)
            if not r.consumed:
                raise ValueError("a repeated parser must consume")
            out.append(r.value)
            at, moved = r.at, True

    return Parser(run, True)


def many1(p: Parser) -> Parser:
    return in_order(p, many(p)).shaped(lambda x: [x[0], *x[1]])


def many_till(p: Parser, end: Parser) -> Parser:
    """``p`` until ``end`` succeeds; a consuming failure of ``end`` fails it all."""

    def run(s, i):
        out, at, moved = [], i, False
        while True:
            e = end.go(s, at)
            if e.ok:
                return Result(True, moved or e.consumed, out, e.at)
            if e.consumed:
                return Result(False, True, e.value, e.at)
            r = p.go(s, at)
            if not r.ok:
                return r._replace(consumed=moved or r.consumed)
            out.append(r.value)
            at, moved = r.at, moved or r.consumed

    return Parser(run, True)


def followed_by(fill: Parser, end: Parser) -> Parser:
    """Skips by ``fill`` up to ``end`` and gives the value of ``end``."""
    return in_order(many_till(fill, look_ahead(end)), end).shaped(lambda x: x[1])


def satisfy(test: Callable[[str, str], bool], name: str, reads=WHOLE) -> Parser:
    """One token for which ``test(token, tag)`` holds.

    ``reads`` is what the test knows of the token: None for nothing, or
    ``("token", text, case_sensitive)`` for whether it is that text.
    """

    def run(s, i):
        t = _look(s, i, reads)
        if t is not None and not (len(t) > 2 and t.chunk) and test(*t[:2]):
            a, b = (i, i + 1) if len(t) == 2 else t[3:]
            return Result(True, True, Node(t[1], a, b, None), i + 1)
        return Result(False, False, f"expected {name} at {i}", i)

    return Parser(run, True)


def chunk_is(label: str | None = None) -> Parser:
    """One chunk of a chunked sentence, with this label or with any."""

    def run(s, i):
        t = _look(s, i)
        if t is not None and len(t) > 2 and t.chunk and label in (None, t.tag):
            return Result(True, True, Node(t.tag, t.start, t.stop, ()), i + 1)
        return Result(False, False, f"expected chunk {label or ''} at {i}", i)

    return Parser(run, True)


def items(tokens: list[dict]) -> list[Item]:
    """The elements of a chunked sentence of rows ``(token, tag, chunk, chunk_id)``."""
    out: list[Item] = []
    last = None
    for i, t in enumerate(tokens):
        if t["chunk_id"] is None:
            out.append(Item(t["token"], t["tag"], False, i, i + 1))
        elif t["chunk_id"] == last:
            out[-1] = out[-1]._replace(token=f"{out[-1].token} {t['token']}", stop=i + 1)
        else:
            out.append(Item(t["token"], t["chunk"], True, i, i + 1))
        last = t["chunk_id"]
    return out


def tag_is(tag: str) -> Parser:
    return satisfy(lambda _, t: t == tag, f"tag {tag}", None)


def tag_starts(prefix: str) -> Parser:
    return satisfy(lambda _, t: t.startswith(prefix), f"tag {prefix}*", None)


def token_is(text: str, case_sensitive: bool = True) -> Parser:
    return satisfy(lambda w, _: w == text if case_sensitive else w.lower() == text.lower(), f"{text!r}", ("token", text, case_sensitive))


def any_token() -> Parser:
    return satisfy(lambda w, _: w != "", "a token", ("token", "", True))


def one_of(texts: list[str], case_sensitive: bool = True) -> Parser:
    return choice(*(attempt(token_is(t, case_sensitive)) for t in texts))


def chunk(label: str, p: Parser) -> Parser:
    return p.shaped(lambda nodes: Node(label, nodes[0].start, nodes[-1].stop, tuple(nodes)))


def tag_of(*tags: str) -> Parser:
    """``choice`` of ``tag_is`` of each."""
    own = satisfy(lambda _, t: t in tags, "", None)

    def run(s, i):
        r = own.run(s, i)
        return r if r.ok else Result(False, False, "no alternative", i)

    return Parser(run, True)


@functools.cache
def noun_phrase() -> Parser:
    return chunk("C_NP", many1(tag_of("NN", "DT", "AT", "JJ")))


@functools.cache
def prep_phrase() -> Parser:
    return chunk("C_PP", in_order(tag_is("IN"), noun_phrase()))


@functools.cache
def _within() -> Parser:
    return choice(attempt(clause()), attempt(noun_phrase()), prep_phrase())


@functools.cache
def verb_phrase() -> Parser:
    # the clause within is built when it is needed, as the two need each other
    inner = Parser(lambda s, i: _within().go(s, i), True)
    return chunk("C_VP", in_order(tag_starts("V"), many1(inner)).shaped(lambda x: [x[0], *x[1]]))


@functools.cache
def clause() -> Parser:
    return chunk("C_CL", in_order(noun_phrase(), verb_phrase()))


def find_clause() -> Parser:
    """A clause after skipping tokens; a noun phrase without a verb phrase after it before the clause fails it all."""
    return followed_by(any_token(), clause())


def parse(p: Parser, sentence: list[tuple[str, str]]) -> Result:
    """Runs a parser at the start of a sentence; the sentence need not be used up."""
    return p.run(sentence, 0)


def search_all(p: Parser, sentence: list[tuple[str, str]], places: list[int] | None = None) -> list[Node]:
    """All matches from left to right, without overlaps; where the parser fails the next place is tried.

    With ``places`` the others are known to fail.
    """
    out, at = [], 0
    for i in range(len(sentence)) if places is None else places:
        if i >= at:
            r = p.run(sentence, i)
            if r.ok and r.at > i:
                out.append(r.value)
                at = r.at
    return out


def span_rows(nodes: list[Node]) -> list[dict]:
    """The chunks of trees as span rows, parents before children."""
    out: list[dict] = []

    def add(n, parent, depth):
        if n.children is None:
            return
        me = len(out)
        out.append({"node_id": me, "parent_id": parent, "depth": depth, "label": n.label, "start": n.start, "stop": n.stop})
        for c in n.children:
            add(c, me, depth + 1)

    for n in nodes:
        add(n, None, 0)
    return out


KIND = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("spans", pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))])


class Sentences:
    """The elements of a batch of sentences in flat arrays: tokens, or chunks and the tokens between them."""

    def __init__(self, sentences: pa.Array):
        self.null = pc.is_null(sentences).to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.offs = np.append(0, np.cumsum(size))
        flat = sentences.flatten()
        self.token, tag = flat.field("token"), flat.field("tag")
        self.places = None
        self.chunk = np.zeros(len(flat), bool)
        if any(f.name == "chunk_id" for f in flat.type):
            number = pc.fill_null(flat.field("chunk_id"), -1).to_numpy(zero_copy_only=False)
            head = np.ones(len(flat), bool)
            head[1:] = (number[1:] < 0) | (number[1:] != number[:-1])
            head[self.offs[:-1][size > 0]] = True
            self.places, end = np.flatnonzero(head), len(flat)
            self.stops = np.append(self.places[1:], end)[: len(self.places)]
            self.chunk = number[self.places] >= 0
            tag = pc.if_else(pa.array(number >= 0), flat.field("chunk"), tag).take(pa.array(self.places))
            self.first = self.offs[:-1]  # each sentence's first token
            self.words = self.token
            self.token = self.token.take(pa.array(self.places))
            self.offs = np.searchsorted(self.places, self.offs)
        self.tag = tag.dictionary_encode()

    @functools.cached_property
    def tags(self) -> list:
        names = np.array([*self.tag.dictionary.to_pylist(), None], object)
        return names[pc.fill_null(self.tag.indices, -1).to_numpy(zero_copy_only=False)].tolist()

    @functools.cached_property
    def tokens(self) -> list:
        return (self.token if self.places is None else self.words).to_numpy(zero_copy_only=False).tolist()

    def items(self, k: int) -> list:
        """A sentence as parsers take it."""
        a, b = int(self.offs[k]), int(self.offs[k + 1])
        if self.places is None:
            return list(zip(self.tokens[a:b], self.tags[a:b]))
        first = int(self.first[k])
        return [Item(" ".join(self.tokens[x:y]), t, c, x - first, y - first) for x, y, t, c in zip(self.places[a:b].tolist(), self.stops[a:b].tolist(), self.tags[a:b], self.chunk[a:b].tolist())]


class Matcher:
    """A parser over many sentences.

    Elements that the parser's tests can't tell apart have one code. At the start
    of a sentence the result follows from the codes that were read, so it is kept
    in a tree of these. Elsewhere only places are tried whose first element does
    not fail by itself; results are kept there too, but not of parsers that call a
    user's function, which may ask where it is. Parsers of unknown making are run
    everywhere.
    """

    #: Nodes of the tree, and codes, beyond which they are begun anew.
    KEPT = 1 << 18
    END = 0

    def __init__(self, parser: Parser, everywhere: bool):
        self.parser, self.everywhere, self.tests, self.exact, self.folded = parser, everywhere, [], {}, {}
        self.plain = False
        self.forget()

    def forget(self) -> None:
        self.code: dict[tuple, int] = {}
        self.dead: dict[int, bool] = {}
        self.next: dict[int, int] = {}
        self.leaf: list[tuple | None] = [None]

    def learnt(self, w: Watch) -> bool:
        """Whether a run read tokens in a way that the codes do not show yet."""
        new = [r for r in w.reads if r not in self.tests]
        if new:
            self.tests += new
            self.exact, self.folded = {}, {}
            for k, (_, text, exact) in enumerate(self.tests):
                own, text = (self.exact, text) if exact else (self.folded, text.lower())
                own[text] = own.get(text, 0) | 1 << k
            self.forget()
        return bool(new)

    def codes(self, s: Sentences) -> np.ndarray:
        if len(self.code) > self.KEPT:
            self.forget()
        tag = pc.fill_null(s.tag.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        names = [None, *s.tag.dictionary.to_pylist()]
        key = tag * 2 + s.chunk
        kinds: list = [0]
        if self.tests:
            # only texts that may be one of the tests' are looked at; Python folds case other than Arrow beyond ASCII
            some = pc.or_(pc.is_in(s.token, value_set=pa.array(self.exact, pa.string())), pc.is_in(pc.ascii_lower(s.token), value_set=pa.array(self.folded, pa.string())))
            some = np.flatnonzero(pc.fill_null(pc.or_(some, pc.invert(pc.string_is_ascii(s.token))), False).to_numpy(zero_copy_only=False))
            seen: dict = {0: 0}
            at = np.zeros(len(s.token), np.int64)
            at[some] = [seen.setdefault(self.kind(w), len(seen)) for w in s.token.take(pa.array(some)).to_numpy(zero_copy_only=False).tolist()]
            kinds = list(seen)
            if s.places is not None:  # the text of a chunk shows only as a whole
                at[s.chunk] = 0
            key = key * len(kinds) + at
        long = 1
        if s.places is not None:  # the places of what follows show in the result
            size = s.stops - s.places
            long = int(size.max(initial=0)) + 1
            key = key * long + size
        if key.size and int(key.max()) < 1 << 20:
            used = np.flatnonzero(np.bincount(key))
            back = np.zeros(int(key.max()) + 1, np.int64)
            back[used] = np.arange(len(used))
            back = back[key]
        else:
            used, back = np.unique(key, return_inverse=True)
        number = [self.code.setdefault((names[k // long // len(kinds) // 2], k // long // len(kinds) % 2, kinds[k // long % len(kinds)], k % long), len(self.code) + 1) for k in used.tolist()]
        return np.array(number, np.int64)[back] if len(number) else np.zeros(0, np.int64)

    def kind(self, w: str) -> int:
        """Which of the tests of tokens hold, as bits."""
        return self.exact.get(w, 0) | self.folded.get(w.lower(), 0)

    def __call__(self, sentences: pa.Array) -> pa.Array:
        s = Sentences(sentences)
        found = (self.search if self.everywhere else self.start)(s)
        own: dict = {}
        which = [own.setdefault(r, len(own)) for r in found]
        return pa.array([shown(*r) for r in own], KIND).take(pa.array(np.array(which, np.int64), mask=s.null))

    def start(self, s: Sentences) -> list[tuple]:
        """Results at the start of each sentence."""
        while True:
            codes = self.codes(s).tolist()
            out = []
            for k, (a, b) in enumerate(zip(s.offs[:-1].tolist(), s.offs[1:].tolist())):
                if self.plain:
                    out.append(outcome(self.parser.run(s.items(k), 0)))
                    continue
                leaf = self.walk(codes, a, b)
                if leaf is not None:
                    out.append(leaf)
                    continue
                w = Watch(s.items(k))
                result = outcome(self.parser.go(w, 0))
                self.plain = self.plain or w.plain or WHOLE in w.reads
                if not self.plain:
                    if self.learnt(w):
                        break
                    self.keep([*codes[a:b], self.END][: w.far + 1], result)
                out.append(result)
            else:
                return out

    def walk(self, codes: list[int], i: int, end: int) -> tuple | None:
        """What is kept for the elements from a place on."""
        node, after = 0, self.next
        while self.leaf[node] is None:
            node = after.get(node << 32 | (codes[i] if i < end else self.END))
            if node is None:
                return None
            i += 1
        return self.leaf[node]

    def keep(self, path: list[int], result: tuple) -> None:
        if len(self.leaf) > self.KEPT:
            self.next, self.leaf = {}, [None]
        node = 0
        for c in path:
            after = self.next.setdefault(node << 32 | c, len(self.leaf))
            if after == len(self.leaf):
                self.leaf.append(None)
            node = after
        self.leaf[node] = result

    def search(self, s: Sentences) -> list[tuple]:
        """Results of ``search_all`` over each sentence."""
        while True:
            codes = self.codes(s)
            some, first = np.unique(codes, return_index=True)
            for c, at in zip(some.tolist(), first.tolist()):
                if c in self.dead:
                    continue
                k = int(np.searchsorted(s.offs, at, "right")) - 1
                place = at - int(s.offs[k])
                w = Watch(s.items(k))
                r = self.parser.go(w, place)
                # a failure that only the first element's tests have part in is one wherever such an element stands
                self.dead[c] = not r.ok and not w.plain and w.calls == 0 and w.far <= place and WHOLE not in w.reads
                if WHOLE not in w.reads and self.learnt(w):
                    break
            else:
                break
        out = [NOTHING] * (len(s.offs) - 1)
        alive = np.flatnonzero(~np.array([self.dead[c] for c in some.tolist()], bool)[np.searchsorted(some, codes)]) if len(codes) else np.zeros(0, np.int64)
        owner = np.searchsorted(s.offs, alive, "right") - 1
        cuts = np.flatnonzero(np.append(True, np.diff(owner) > 0)) if len(alive) else np.zeros(0, np.int64)
        codes, alive = codes.tolist(), alive.tolist()
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(alive)]):
            k = int(owner[a])
            first, end = int(s.offs[k]), int(s.offs[k + 1])
            rows, at, items, head = [], first, None, None
            for i in alive[a:b]:
                if self.plain:
                    break
                if i < at:
                    continue
                leaf = self.walk(codes, i, end)
                if leaf is None:
                    items = items or s.items(k)
                    w = Watch(items)
                    w.near = i - first
                    r = self.parser.go(w, i - first)
                    # a user's function may look at the place that a value has
                    self.plain = w.plain or w.calls > 0 or WHOLE in w.reads or w.near < i - first
                    if self.plain:
                        break
                    if self.learnt(w):
                        return self.search(s)
                    shift = self.place(s, i, first)
                    leaf = (r.at - (i - first), tuple((*x[:4], x[4] - shift, x[5] - shift) for x in span_tuples([r.value])), (r.value.label, r.value.start - shift, r.value.stop - shift)) if r.ok else (0, (), None)
                    self.keep([*codes[i:end], self.END][: w.far - (i - first) + 1], leaf)
                size, own, top = leaf
                if size > 0:
                    shift, base = self.place(s, i, first), len(rows)
                    head = head or (top[0], top[1] + shift, top[2] + shift)
                    rows += [(n + base, p if p is None else p + base, d, label, x + shift, y + shift) for n, p, d, label, x, y in own]
                    at = i + size
            if self.plain:
                out[k] = outcome_of(search_all(self.parser, s.items(k), [i - first for i in alive[a:b]]), None)
            elif head:
                out[k] = (True, None, *head, tuple(rows))
        return out

    @staticmethod
    def place(s: Sentences, i: int, first: int) -> int:
        """The place of an element among its sentence's tokens."""
        return i - first if s.places is None else int(s.places[i] - s.places[first])


def outcome(r: Result) -> tuple:
    return outcome_of([r.value], None) if r.ok else outcome_of([], str(r.value))


def span_tuples(nodes: list[Node]) -> tuple:
    return tuple(tuple(r.values()) for r in span_rows(nodes))


def outcome_of(nodes: list[Node], error: str | None) -> tuple:
    first = nodes[0] if nodes else Node(None, None, None, ())
    return bool(nodes), error, first.label, first.start, first.stop, span_tuples(nodes)


NOTHING = outcome_of([], None)


def shown(ok, error, label, start, stop, spans) -> dict:
    names = ("node_id", "parent_id", "depth", "label", "start", "stop")
    return {"ok": ok, "error": error, "label": label, "start": start, "stop": stop, "spans": [dict(zip(names, r)) for r in spans]}


def extract(tagged: str | Column, make: Callable[[], Parser], everywhere: bool = False) -> Column:
    """The struct RESULT of a pattern over a tagged-sentence column.

    At the sentence's start, or with ``everywhere`` at all places (``label`` and
    the places are then the first match's). A sentence whose structs have a
    ``chunk_id`` (``chunking.column_of``) is read as its chunks and the tokens
    between them. A null sentence gives null.
    """
    kept: list[Matcher] = []  # filled in each task

    @F.arrow_udf(RESULT)
    def run(sentences: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Matcher(make(), everywhere))
        return kept[0](sentences)

    return run(F.col(tagged) if isinstance(tagged, str) else tagged)


def extracted_spans(df: DataFrame, make: Callable[[], Parser], *keys: str, tagged: str = "tagged", everywhere: bool = True) -> DataFrame:
    """Span rows of a pattern's matches in all sentences."""
    return df.select(*keys, F.explode(extract(tagged, make, everywhere)["spans"]).alias("s")).select(*keys, "s.*")

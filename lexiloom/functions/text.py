"""Splitting, token predicates and printing, as Column expressions.

A tagged sentence is an ``array<struct<token, tag>>``; a sentence an
``array<string>``. All expressions run inside code generation.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space, spelt out: the flag for Unicode classes makes a split several times slower.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: What is taken off the front and the end of a word by ``tokenize``.
OPENING, CLOSING = r'(^|\s)(["(\[{]+)', r'([.,;:!?")\]}]+)(\s|\z)'


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """The words between white space (Unicode's)."""
    return F.filter(F.split(_c(text), SPACE), lambda w: w != "")


def tokenize(text) -> Column:
    """Words, with runs of opening marks before and of closing marks after a word as tokens of their own.

    Marks inside a word (``O'Sullivan``, ``$2,000,000``) and other signs stay with it.
    """
    apart = F.regexp_replace(_c(text), OPENING, "$1$2 ")
    return words(F.regexp_replace(apart, CLOSING, " $1$2"))


def sentences(text) -> Column:
    """Sentences: they end at a line break, or at ``.``, ``!`` or ``?`` before white space."""
    cut = F.split(F.regexp_replace(_c(text), r"([.!?])\s+", "$1\n"), "\n")
    # the function itself would be given each sentence's number too, as the characters to take off
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def suffix(token, n: int = 3) -> Column:
    return F.right(_c(token), F.lit(n))


def prefix(token, n: int = 1) -> Column:
    return F.left(_c(token), F.lit(n))


def all_but_last(text) -> Column:
    """All characters but the last; empty stays empty."""
    return F.left(_c(text), F.greatest(F.length(_c(text)) - 1, F.lit(0)))


def matches(a, b, case_sensitive: bool = True) -> Column:
    a, b = _c(a), b if isinstance(b, Column) else F.lit(b)
    return a == b if case_sensitive else F.lower(a) == F.lower(b)


def contains(tagged, token: str) -> Column:
    """Whether a tagged sentence has exactly this token."""
    return F.exists(_c(tagged), lambda t: t["token"] == token)


def contains_tag(tagged, tag: str) -> Column:
    return F.exists(_c(tagged), lambda t: t["tag"] == tag)


def length(tagged) -> Column:
    return F.size(_c(tagged))


def apply_tags(tokens, tags) -> Column:
    """A tagged sentence from tokens and tags; the longer one is cut."""
    n = F.least(F.size(_c(tokens)), F.size(_c(tags)))
    return F.zip_with(F.slice(_c(tokens), F.lit(1), n), F.slice(_c(tags), F.lit(1), n), lambda a, b: F.struct(a.alias("token"), b.alias("tag")))


def strip_tags(tagged) -> Column:
    return F.transform(_c(tagged), lambda t: t["token"])


def only_tags(tagged) -> Column:
    return F.transform(_c(tagged), lambda t: t["tag"])


def concat_sentences(array_of_tagged) -> Column:
    return F.flatten(_c(array_of_tagged))


def print_token(t: Column) -> Column:
    return F.concat(t["token"], F.lit("/"), t["tag"])


def print_tagged(tagged) -> Column:
    """``token/TAG`` words with spaces between."""
    return F.array_join(F.transform(_c(tagged), print_token), " ")


def combine(first, second, unknown: str = "Unk") -> Column:
    """The first tagging, with the second's tag where the first has none; cut to the shorter one."""
    n = F.least(F.size(_c(first)), F.size(_c(second)))

    def pick(a, b):
        same = F.when(a["token"] != b["token"], F.raise_error(F.lit("taggings of different tokens"))).otherwise(a["token"])
        return F.struct(same.cast("string").alias("token"), F.when(a["tag"] != unknown, a["tag"]).otherwise(b["tag"]).alias("tag"))

    return F.zip_with(F.slice(_c(first), F.lit(1), n), F.slice(_c(second), F.lit(1), n), pick)


def _protector(terms: list[str], case_sensitive: bool) -> re.Pattern | None:
    some = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not some:
        return None
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, some)) + r")(?!\w)", 0 if case_sensitive else re.I)


#: A word character, as Python has it.
_WORD = r"[\p{L}\p{N}_]"


def protect_pieces(text: str, terms: list[str], case_sensitive: bool = True) -> list[tuple[bool, str]]:
    """(protected?, piece) of a text; the longest term that begins at a place is taken."""
    pattern = _protector(terms, case_sensitive)
    out, at = [], 0
    for m in pattern.finditer(text) if pattern else ():
        out += [(False, text[at : m.start()]), (True, m.group())]
        at = m.end()
    return [p for p in [*out, (False, text[at:])] if p[1]]


def protect_terms(text, terms: list[str], case_sensitive: bool = True, split: bool = True) -> Column:
    """Tokens of a text in which each term stays one token; with ``split=False`` the pieces between stay whole.

    Terms stand between characters that are no word characters, in any script. Without terms this is ``tokenize``.
    """
    pattern = _protector(terms, case_sensitive)
    text = _c(text)
    if pattern is None:
        return tokenize(text) if split else F.filter(F.array(text), lambda t: t != "")
    flags = "(?s)" if case_sensitive else "(?isu)"
    body = "|".join(_quoted(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    # each match is what lies before a term, and the term; the last one has no term
    piece = F.lit(rf"{flags}(.*?)(?:(?<!{_WORD})({body})(?!{_WORD})|\z)")
    between, term = (F.regexp_extract_all(text, piece, F.lit(i)) for i in (1, 2))
    some = lambda p: F.filter(F.array(p), lambda x: x != "")
    return F.flatten(F.zip_with(between, term, lambda a, b: F.concat(tokenize(a) if split else some(a), some(b))))


def _quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)

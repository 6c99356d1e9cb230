"""Token ids of whole texts with a public byte-level BPE vocabulary.

The texts are cut into the pieces of the vocabulary's own pattern with array
operations; each distinct piece is encoded once per worker process and looked
up after that. The result is that of ``Encoding.encode_ordinary``.
"""

import base64
import functools
import os
import unicodedata
from itertools import chain

import numpy as np

from . import _text as X

#: Where the public vocabularies lie; each operator takes a path as parameter.
FOLDER = "/opt/tokenizers"
VOCABULARY = f"{FOLDER}/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 1_500_000
#: Bits of the slots of the nearer memory.
SLOTS = 21


@functools.cache
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    kind = {"L": 1, "N": 2}
    t = np.fromiter((kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)
    t[SPACES] = 3
    return t


def pieces(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pattern's pieces in the flat texts, ascending."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    c = _classes()[codes]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[offs] = True
    new = first[:n].copy()
    new[1:] |= c[1:] != c[:-1]
    new[0] = True
    space = c == 3
    # of white space before a word, the last character stands apart or joins the word
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    new[last] = True
    new[last[codes[last] == 32] + 1] = False
    # contractions: a lone apostrophe before s, t, re, ve, m, ll, d
    at = np.flatnonzero(codes == 39)
    at = at[new[at]]
    at = at[(at + 1 < n)]
    at = at[new[at + 1] & ~first[at + 1] & (c[at + 1] == 1)] if len(at) else at
    for p in at.tolist():
        end = int(offs[np.searchsorted(offs, p, "right")])
        tail = "".join(map(chr, codes[p + 1 : min(p + 3, end)]))
        size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            new[p + 1] = False
            if p + 1 + size < n and not first[p + 1 + size] and c[p + 1 + size] == 1:
                new[p + 1 + size] = True
    return np.flatnonzero(new)


class Encoder:
    """Encodes flat texts; remembers the ids of the pieces it has met."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.own = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)
        #: the last piece seen of each slot, and its row: most pieces are found here
        self.near, self.near_at = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)

    def _rows(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each piece, its row in what is remembered."""
        key = X.word_hashes(codes, start, end)
        slot = (key >> np.uint64(64 - SLOTS)).astype(np.int32)
        row = self.near_at[slot]
        away = np.flatnonzero(self.near[slot] != key)
        if len(away):
            new = self._found(codes, start[away], end[away], key[away])
            if new is None:  # all is forgotten: also what was found near
                return self._rows(codes, start, end)
            row[away] = new
            self.near[slot[away]], self.near_at[slot[away]] = key[away], new
        return row

    def _found(self, codes, start, end, key) -> np.ndarray | None:
        uniq, where, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) and len(self.keys) + len(uniq) > REMEMBERED:
            self._forget()
            return None
        i = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == uniq[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            encode = self.own._core_bpe.encode_single_piece
            whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
            got = [encode(whole[a:b].encode("utf-8", "replace")) for a, b in zip(start[where[fresh]].tolist(), end[where[fresh]].tolist())]
            at = (np.arange(len(fresh)) + len(self.offs) - 1).astype(np.int32)
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.int32)])
            self.keys = np.insert(self.keys, i[fresh], uniq[fresh])
            self.at = np.insert(self.at, i[fresh], at)
            i = np.searchsorted(self.keys, uniq)
        return self.at[i][back]

    def _spans(self, codes, offs):
        start = pieces(codes, offs)
        end = np.append(start[1:], len(codes))
        return start, self._rows(codes, start, end)

    def lengths(self, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Ids in each text."""
        if not len(codes):
            return np.zeros(len(offs) - 1, np.int64)
        start, row = self._spans(codes, offs)
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.offs[row + 1] - self.offs[row], out=total[1:])
        return np.diff(total[np.searchsorted(start, offs)])

    def encode(self, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of the texts in them."""
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        start, row = self._spans(codes, offs)
        n = self.offs[row + 1] - self.offs[row]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ids = self.ids[np.repeat(self.offs[row] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offs)]

    def decode(self, ids) -> str:
        return self.own.decode_bytes(list(map(int, ids))).decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file; its memory of pieces lasts over tasks."""
    return Encoder(path)

"""Hashed character n-grams and words of whole texts, counted with numpy.

A text is a stream of code points between runs of four zeros, so that n-grams at its ends
are told apart and none spans two texts. Every n-gram and every word hashes to a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

PAD = 4
#: Code points that are handled at a time; longer texts go in pieces, see ``pieces``.
PIECE = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = re.compile(r"[\x00-\x20]+")
#: Blanks and two words, of four code points or more together, which the next blank ends.
_TWO = re.compile(r"[\x00-\x20]+[^\x00-\x20]+[\x00-\x20]+[^\x00-\x20]+[\x00-\x20]+[^\x00-\x20]+(?=[\x00-\x20])")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters or digits; those beyond the basic plane count as such."""
    out = np.array([chr(i).isalnum() for i in range(0x10000)])
    out[0xFFFF] = True
    return out


class Subwords:
    """Buckets for n-grams of the lengths ``ns``, for words, and for pairs of words in a row."""

    def __init__(self, bits: int = 16, ns: tuple[int, ...] = (2, 3, 4), words: bool = True, pairs: bool = False, lower: bool = False, letters: bool = False, times: int = 1):
        self.bits, self.ns, self.words, self.pairs, self.lower = bits, ns, words, pairs, lower
        self.times = times  # how often a word or pair counts, of which there are fewer than n-grams
        self.letters = letters  # words are runs of letters and digits, not of what isn't white space
        self.buckets = 1 << bits
        self._pow = self._inv = None

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self._pow is None or len(self._pow) < n:
            room = max(n, 1 << 16)
            p, q = np.full(room, _BASE, np.uint64), np.full(room, pow(_BASE, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            self._pow, self._inv = np.multiply.accumulate(p), np.multiply.accumulate(q)
        return self._pow[:n], self._inv[:n]

    def _points(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        gap = "\0" * PAD
        if self.lower:
            texts = [t.lower() for t in texts]
        lengths = np.fromiter((len(t) + PAD for t in texts), np.int64, len(texts))
        joined = gap + gap.join(texts) + gap
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return c, starts

    def streams(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(buckets, text index of each, times) for each kind of feature."""
        c, starts = self._points(texts)
        n = len(c) - PAD
        owner = np.zeros(len(c), np.int32)
        owner[starts[1:]] = 1
        owner = np.cumsum(owner, dtype=np.int32)
        shift = np.uint32(32 - self.bits)
        h = np.full(n, np.uint32(2166136261), np.uint32)
        for k in range(1, max(self.ns) + 1):
            h = (h ^ c[k - 1 : k - 1 + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if k in self.ns:
                yield ((h * np.uint32(0x85EBCA6B)) >> shift).astype(np.int32), owner[:n], 1
        if not self.words and not self.pairs:
            return
        word, of = self._words(c, owner)
        top = np.uint64(64 - self.bits)
        if self.words:
            yield (word >> top).astype(np.int32), of, self.times
        if self.pairs and len(word) > 1:
            within = of[1:] == of[:-1]
            # a word said again has one bucket for all words, since no text shares such a pair with another
            pair = np.where(word[1:] == word[:-1], np.uint64(_BASE), pair_hashes(word))
            yield (pair[within] >> top).astype(np.int32), of[1:][within], self.times

    def _words(self, c: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each run of code points above 32, and its text's index.

        The polynomial of a run is the difference of two running sums, moved to power 0 by
        the inverse of the base, which is odd and so has one.
        """
        solid = _letters()[np.minimum(c, 0xFFFF)] if self.letters else c > 32
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        begin, end = edge[0::2], edge[1::2]
        p, q = self._powers(len(c))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c.astype(np.uint64) * p, dtype=np.uint64)])
        word = (total[end] - total[begin]) * q[begin]
        word ^= word >> np.uint64(29)
        word *= np.uint64(0xBF58476D1CE4E5B9)
        word ^= word >> np.uint64(32)
        return word, owner[begin]

    def word_hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of all texts in their order, and the index of each one's text."""
        c, starts = self._points(texts)
        owner = np.zeros(len(c), np.int32)
        owner[starts[1:]] = 1
        return self._words(c, np.cumsum(owner, dtype=np.int32))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of one text and how often each occurs."""
        bins = np.zeros(self.buckets, np.int64)
        for piece, sign in pieces(text):
            for b, _, times in self.streams([piece]):
                bins += sign * times * np.bincount(b, minlength=self.buckets)
        at = np.flatnonzero(bins)
        return at.astype(np.int32), bins[at].astype(np.float32)

    def sums(self, texts: Iterable[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the sums of the weights (buckets x columns) over its features, and their number."""
        texts = list(texts)
        out, number = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
        group: list[str] = []
        of: list[int] = []
        signs: list[int] = []

        def flush() -> None:
            if not group:
                return
            ids, sign = np.array(of), np.array(signs)
            m = len(group)
            for b, owner, times in self.streams(group):
                np.add.at(number, ids, sign * times * np.bincount(owner, minlength=m))
                for j in range(weights.shape[1]):
                    np.add.at(out[:, j], ids, sign * times * np.bincount(owner, weights[b, j], minlength=m))
            for held in (group, of, signs):
                held.clear()

        size = 0
        for i, t in enumerate(texts):
            for piece, sign in pieces(t):
                group.append(piece)
                of.append(i)
                signs.append(sign)
                size += len(piece)
                if size > PIECE // 4:
                    flush()
                    size = 0
        flush()
        return out, number


def pair_hashes(word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each two neighbours in an array of word hashes."""
    h = (word[:-1] * np.uint64(_BASE)) ^ word[1:]
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(text: str) -> list[tuple[str, int]]:
    """Parts of a long text whose features, added up with their signs, are those of the whole.

    Neighbours overlap by two words at least, and the overlap counts once more with the sign
    -1: a feature in the overlap counts 1 + 1 - 1 times, and the features at a part's ends
    cancel against the overlap's own. Parts begin and end where a word does, so a word is never
    cut, however long it is.
    """
    out, lo = [], 0
    while len(text) - lo > 2 * PIECE:
        # two words before the end of the part, and the blank before them
        cut = _SPACE.search(text, lo + PIECE)
        over = _TWO.match(text, cut.start()) if cut else None
        if not over or over.end() >= len(text):
            break
        begin, end = cut.end(), over.end()
        out += [(text[lo:end], 1), (text[begin:end], -1)]
        lo = begin
    out.append((text[lo:], 1))
    return out

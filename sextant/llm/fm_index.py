"""A bidirectional FM-index over a delimited vocabulary, and its one-error search schemes.

The text is ``#w1#w2#...#wk#`` with the words in order, so the suffix that starts at the
mark before a word has the word's number as its rank. A pattern is a pair of equally long
intervals of suffix ranks, one in the index of the text and one in that of the reversed
words; it grows by a symbol to the left or to the right, and both intervals follow.

A search has a window of places for its error. What lies before the window is matched
exactly first, from the window outwards to the mark, then the pattern grows across the window, with
one error, to the other mark. Windows that begin at a word's first place do this mirrored,
from the word's end. The error is placed where the two words first differ, so each near
word is found by exactly one window, once.

Searches of many words advance together, a symbol a step, in numpy arrays.
"""

from __future__ import annotations

import numpy as np

#: Symbols: the start of the text (never searched), the mark, then letters.
START, MARK, LETTER = 0, 1, 2
#: Places between two stored counts (as a power of two), and states that branch at once.
SHIFT, CHUNK = 5, 4096


def _suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of the text in the order of their suffixes; marks are in the order of their places."""
    n, width = len(text), 62 // bits
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(width):
        symbol = np.where(open_, np.roll(text, -k), 0)
        key = key << bits | symbol
        open_ &= symbol != MARK
    order = np.argsort(key, kind="stable")
    # equal beginnings that hold a mark are in order already, the others are told apart by doubling
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]]) | ~open_[order]
    while not fresh.all():
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        key = rank * n + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        width *= 2
    return order


class _Ranks:
    """Symbol counts before any place of a text's transform."""

    def __init__(self, words: list[np.ndarray], symbols: int) -> None:
        marks = np.full(1, MARK, np.int64)
        text = np.concatenate([marks, *(part for w in words for part in (w, marks))])
        order = _suffix_order(text, int(symbols).bit_length())
        self.size, self.symbols = len(text), symbols
        before = np.where(order == 0, START, text[order - 1])
        block = 1 << SHIFT
        padded = -(-(self.size + 1) // block) * block
        self.before = np.full(padded, symbols, np.int16)
        self.before[: self.size] = before
        each = np.zeros((padded // block + 1, symbols + 1), np.int32)
        np.add.at(each, (np.arange(self.size) // block + 1, before), 1)
        stored = np.cumsum(each, axis=0, dtype=np.int32)
        #: of each block's first place, the symbols before it that are smaller than each symbol
        self.less = np.concatenate([np.zeros((len(stored), 1), np.int32), np.cumsum(stored, axis=1, dtype=np.int32)], axis=1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.inside = np.arange(block)

    def _window(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = places >> SHIFT
        found = self.before[(block << SHIFT)[:, None] + self.inside]
        return block, found, self.inside < (places & ((1 << SHIFT) - 1))[:, None]

    def smaller(self, places: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Before each place: symbols smaller than the given one, and those equal to it."""
        block, found, valid = self._window(places)
        less = self.less[block, symbol]
        equal = self.less[block, symbol + 1] - less
        below = found < symbol[:, None]
        same = found == symbol[:, None]
        return less + (below & valid).sum(1), equal + (same & valid).sum(1)

    def all_smaller(self, places: np.ndarray) -> np.ndarray:
        """Before each place: the symbols up to each symbol, one row a place."""
        block, found, valid = self._window(places)
        wide = self.symbols + 1
        at = (np.arange(len(places))[:, None] * wide + found)[valid]
        each = np.bincount(at, minlength=len(places) * wide).reshape(len(places), wide)
        return self.less[block, 1:] + np.cumsum(each, axis=1)


class _Patterns:
    """The searched words, each with a mark behind it, read by word and place."""

    def __init__(self, words: list[np.ndarray]) -> None:
        mark = np.full(1, MARK, np.int64)
        self.start = np.cumsum([0, *(len(w) + 1 for w in words)])
        self.symbols = np.concatenate([part for w in words for part in (w, mark)])

    def __getitem__(self, at: tuple) -> np.ndarray:
        word, place = at
        return self.symbols[self.start[word] + place]


class FmIndex:
    """Both directions over distinct words."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words)
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in self.words]
        letters = np.unique(np.concatenate([np.empty(0, np.uint32), *points]))
        symbols = len(letters) + LETTER
        self.codes = [np.searchsorted(letters, p) + LETTER for p in points]
        self.lengths = np.array([len(p) for p in points], np.int64)
        self.forward = _Ranks(self.codes, symbols)
        mirrored = sorted((c[::-1] for c in self.codes), key=lambda c: c.tolist())
        self.backward = _Ranks(mirrored, symbols)

    def near(self, number: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Near words of the words with these numbers, the error lying in ``[first, last)``.

        A window that ends with the word holds the place behind it too. Gives the searches'
        indexes and the numbers of the words found.
        """
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for mirrored in (False, True):
            which = np.flatnonzero((first == 0) == mirrored)
            if len(which):
                q, x = self._search(number[which], first[which], last[which], mirrored)
                found.append((which[q], x))
        return np.concatenate([q for q, _ in found]), np.concatenate([x for _, x in found])

    def _search(self, number: np.ndarray, first: np.ndarray, last: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """One mode: the pattern grows on one side only once its exact part is matched.

        ``grow`` is the index whose intervals are extended, ``other`` follows.
        """
        length = self.lengths[number]
        pattern = _Patterns([self.codes[k][::-1] if mirrored else self.codes[k] for k in number])
        if mirrored:
            first, last = length - last, length
            exact, grow = self.backward, self.forward
        else:
            exact, grow = self.forward, self.backward

        def step(index: _Ranks, q, own, other, size, symbol):
            low, low_equal = index.smaller(own, symbol)
            high, high_equal = index.smaller(own + size, symbol)
            left = high_equal - low_equal
            kept = left > 0
            return q[kept], (index.first[symbol] + low_equal)[kept], (other + high - low)[kept], left[kept]

        # the exact part, from the window's edge out to the mark
        q = np.arange(len(number))
        own, other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), exact.size)
        for back in range(int(first.max()) + 1):
            active = first[q] >= back
            at = first[q[active]] - 1 - back
            symbol = np.where(at >= 0, pattern[q[active], at], MARK)
            moved = step(exact, q[active], own[active], other[active], size[active], symbol)
            q, own, other, size = (np.concatenate([a[~active], b]) for a, b in zip((q, own, other, size), moved))
        # from here on the pattern grows to the other side
        none = tuple(np.empty(0, np.int64) for _ in range(4))
        exactly, erred, done = (q, other, own, size), none, []
        for at in range(int(first.min()), int(length.max()) + 1):
            q, own, other, size = exactly
            # a pattern with one word left holds the searched word alone
            keep = size > 1
            q, own, other, size = q[keep], own[keep], other[keep], size[keep]
            here = (first[q] <= at) & (at <= length[q])
            window = here & ((at < last[q]) | (last[q] == length[q]))
            replaced, inserted = self._branch(grow, pattern, at, length, first, mirrored, *(a[window] for a in (q, own, other, size)))
            k, end = pattern[q, at], at == length[q]
            if mirrored:
                drop = window & ~end & (pattern[q, at - 1] != k)
            else:
                drop = window & ~end & (pattern[q, np.minimum(at + 1, length[q])] != k)
            dropped = tuple(a[drop] for a in (q, own, other, size))
            erred = tuple(np.concatenate(x) for x in zip(erred, inserted))
            erred = step(grow, *erred, pattern[erred[0], at])
            over = at == length[erred[0]]
            done.append((erred[0][over], erred[2][over] if grow is self.backward else erred[1][over]))
            erred = tuple(np.concatenate([a[~over], b, c]) for a, b, c in zip(erred, replaced, dropped))
            go = here & ~end
            moved = step(grow, q[go], own[go], other[go], size[go], k[go])
            exactly = tuple(np.concatenate([a[~here], b]) for a, b in zip((q, own, other, size), moved))
        return np.concatenate([q for q, _ in done]), np.concatenate([x for _, x in done])

    def _branch(self, grow, pattern, at, length, first, mirrored, q, own, other, size):
        """All letters that may stand next, but the right one: as a replaced and as an inserted one."""
        replaced, inserted = [], []
        for part in range(0, len(q), CHUNK):
            cut = slice(part, part + CHUNK)
            low = grow.all_smaller(own[cut])
            each = grow.all_smaller(own[cut] + size[cut]) - low
            before = np.concatenate([np.zeros((len(each), 1), each.dtype), each[:, :-1]], axis=1)
            counts = each - before
            counts[:, :LETTER] = 0
            counts[:, grow.symbols :] = 0
            state, symbol = np.nonzero(counts)
            low_before = np.concatenate([np.zeros((len(low), 1), low.dtype), low[:, :-1]], axis=1)
            qs = q[cut][state]
            next_ = (
                qs,
                grow.first[symbol] + (low - low_before)[state, symbol],
                other[cut][state] + before[state, symbol],
                counts[state, symbol].astype(np.int64),
            )
            end = at == length[qs]
            replace = ~end & (symbol != pattern[qs, at])
            if mirrored:
                insert = (at > first[qs]) & (symbol != pattern[qs, at - 1])
            else:
                insert = symbol != pattern[qs, at]
            replaced.append(tuple(a[replace] for a in next_))
            inserted.append(tuple(a[insert] for a in next_))
        none = tuple(np.empty(0, np.int64) for _ in range(4))
        return tuple(tuple(np.concatenate(x) for x in zip(none, *parts)) for parts in (replaced, inserted))

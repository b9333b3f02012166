"""Byte-level BPE encoding and decoding on Arrow batches.

Encoding works on the distinct pieces of a batch. The texts of a batch become one array of
code points, whose character classes give all piece boundaries at once; the pieces are
dictionary-encoded without making a string of each. A distinct piece is encoded by
backtracking: an Aho-Corasick automaton gives the longest token at each place, a token is
taken if it may stand after the one before it, else the next shorter one is tried, else
the last one is taken back. Two tokens may stand side by side if no merge of a lower rank
crosses their border; that table is computed from the merges when a pair is first asked
for. Each place is left at most once for good, so the time is linear in the piece.

Decoding gathers the tokens' bytes from one buffer through an offset table.

Cases: a null text is empty and has no tokens; an empty table gives no rows; the special
token's name in a text is its id, as the tokenizers library reads it; repeated rows give
equal rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct pieces that a worker remembers; when full it starts anew.
REMEMBERED = 400_000
#: Pair answers that a worker remembers, as a power of two.
ASKED_BITS = 20
#: Code points worked on at a time (a longer text is a batch of its own).
BATCH_CHARS = 2_000_000

LETTER, NUMBER, SPACE, OTHER = range(4)
# --- fixed values: white space of the pattern, and the endings that are pieces of their own ---
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every, at = "".join(map(chr, points)), np.array(points)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(name, every):
            kinds[at[run.start() : run.end()]] = kind
    kinds[list(SPACES)] = SPACE
    return kinds


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places where pieces begin, in code points of several texts laid end to end.

    ``text_starts`` are the texts' first places (empty texts left out), the first being 0.
    """
    n = len(points)
    kinds = character_classes()[points]
    border = np.zeros(n + 1, bool)
    border[1:n] = kinds[1:] != kinds[:-1]
    border[text_starts] = True
    border[n] = True
    begins = np.flatnonzero(border)
    starts, ends = begins[:-1], begins[1:]
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[text_starts] = True
    last_of_text[n] = True
    mark = border[:n].copy()
    # the last blank of a run belongs to what follows: a space joins it, another stands alone
    spaces = kinds[starts] == SPACE
    inner = spaces & ~last_of_text[ends]
    mark[ends[inner] - 1] = True
    joins = inner & (points[np.maximum(ends - 1, 0)] == 0x20)
    mark[ends[joins]] = False
    # an apostrophe that begins a piece takes a known ending with it
    quote = np.flatnonzero((points == 0x27) & mark[:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        bounded = np.concatenate([last_of_text, np.ones(3, bool)])
        for ending in ENDINGS:
            k = len(ending)
            hit = ~bounded[quote + 1]
            for j, c in enumerate(ending):
                hit &= padded[quote + 1 + j] == ord(c)
                if j:
                    hit &= ~bounded[quote + 1 + j]
            at = quote[hit]
            mark[at + 1] = False
            after = at + 1 + k
            mark[after[after < n]] = True
    return np.flatnonzero(mark)


class Vocabulary:
    """A tokenizer file's tokens as bytes, with the tables that encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        ids = model["model"]["vocab"]
        spelled = {t: bytes(letters[c] for c in t) for t in ids}
        self.special = {a["content"]: a["id"] for a in model["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for text, i in ids.items():
            tokens[i] = spelled[text]
        for text, i in self.special.items():
            tokens[i] = text.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.tokens = [t.decode("latin-1") for t in tokens]
        self.size = size
        # rank of a token: the merge that makes it; single bytes come first
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}
        self.rank = [-1] * size
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[left + right]
            self.rank[whole] = rank
            self.parts[whole] = (ids[left], ids[right])
            self.merged[ids[left] * size + ids[right]] = rank
        # the merges as sorted keys, and each token's parts, for whole arrays of pairs
        keys = np.array(list(self.merged), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.merged.values()), np.int64)[order]
        self.ranks = np.array(self.rank, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for whole, (left, right) in self.parts.items():
            self.left[whole], self.right[whole] = left, right
        self.automaton = ahocorasick.Automaton()
        by_text = {self.tokens[i]: i for i in ids.values()}
        for text, i in by_text.items():
            if len(text) > 1:  # single bytes match everywhere and need no search
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.single = np.array([by_text.get(chr(b), -1) for b in range(256)] + [-1], np.int64)
        self.shorter = np.full(size, -1, np.int64)
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in by_text), -1)
        self.asked = np.full(1 << ASKED_BITS, -1, np.int64)
        self.answers = np.zeros(1 << ASKED_BITS, bool)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_ids, self.known_heads, self.known_sizes, self.used = [], [], [], 0

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of two tokens leaves exactly these two, pair by pair."""
        keys = left * self.size + right
        slots = ((keys * -7046029254386353131) >> (64 - ASKED_BITS)) & ((1 << ASKED_BITS) - 1)
        new = np.flatnonzero(self.asked[slots] != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            answers = self._no_merge_crosses(fresh // self.size, fresh % self.size)
            out = self.answers[slots]
            out[new] = answers[back]
            self.asked[slots[new]] = keys[new]
            self.answers[slots[new]] = out[new]
            return out
        return self.answers[slots]

    def _no_merge_crosses(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # undo the later of the two last merges at the border again and again: at each
        # moment the pair that then stood there must not have merged earlier than that
        answer = np.ones(len(left), bool)
        limit = np.full(len(left), 1 << 60, np.int64)
        live = np.arange(len(left))
        while len(live):
            a, b, bound = left[live], right[live], limit[live]
            keys = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < bound)
            answer[live[crossed]] = False
            ra, rb = self.ranks[a], self.ranks[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            # of two equal tokens the left one is made first, so the right one is undone first
            undo_left = go & (ra > rb)
            undo_right = go & ~undo_left
            at_left, at_right = live[undo_left], live[undo_right]
            limit[at_left], left[at_left] = ra[undo_left], self.right[a[undo_left]]
            limit[at_right] = rb[undo_right] + (ra[undo_right] != rb[undo_right])
            right[at_right] = self.left[b[undo_right]]
            live = live[go]
        return answer

    def _longest(self, joined: str) -> np.ndarray:
        """The longest token that starts at each place."""
        points = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        longest = np.append(self.single[np.minimum(points, 256)], -1)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64)
        ends, tokens = found[::2], found[1::2]
        # matches come by their ends, so the last one written to a place is the longest
        longest[ends + 1 - self.lengths[tokens]] = tokens
        return longest

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces laid end to end, and each piece's number of ids.

        All pieces backtrack side by side, one step of each at a time.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        longest = self._longest("\u0100".join(p.decode("latin-1") for p in pieces) + "\u0100")
        first = ends - sizes + np.arange(len(pieces))  # one place between pieces, where nothing matches
        stop = first + sizes
        dead = np.zeros(len(longest), bool)
        taken = np.full(len(longest), -1, np.int64)  # the token taken at each place
        previous = np.full(len(longest), -1, np.int64)  # the place of the token before it
        at, last = first.copy(), np.full(len(pieces), -1, np.int64)
        token = longest[at]
        live = np.arange(len(pieces))
        while len(live):
            here, now, before = at[live], token[live], last[live]
            tried = now >= 0
            end = here + self.lengths[np.maximum(now, 0)]
            good = tried & ~dead[np.where(tried, end, here)]
            check = np.flatnonzero(good & (before >= 0))
            good[check] = self.may_follow(taken[before[check]], now[check])
            # take the token
            g = live[good]
            taken[here[good]], previous[here[good]] = now[good], before[good]
            last[g], at[g] = here[good], end[good]
            token[g] = longest[end[good]]
            # try the next shorter one
            shorter = tried & ~good
            token[live[shorter]] = self.shorter[now[shorter]]
            # none is left: take the one before back
            back = ~tried
            b = live[back]
            dead[here[back]] = True
            at[b], last[b] = before[back], previous[before[back]]
            token[b] = self.shorter[taken[before[back]]]
            live = live[at[live] < stop[live]]
        # walk back from the last tokens
        on_path = np.zeros(len(longest), bool)
        place = last[sizes > 0]
        while len(place):
            on_path[place] = True
            place = previous[place]
            place = place[place >= 0]
        places = np.flatnonzero(on_path)
        counts = np.searchsorted(places, stop) - np.searchsorted(places, first)
        return taken[places], counts

    def _lookup(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(flat, heads, sizes)``: the ids of piece k are ``sizes[k]`` ones from ``heads[k]``."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self._forget()
        get = self.known.get
        which = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(which < 0)
        if len(new):
            fresh = [pieces[k] for k in new]
            ids, counts = self.encode_new(fresh)
            n = len(self.known)
            self.known.update(zip(fresh, range(n, n + len(fresh))))
            which[new] = np.arange(n, n + len(fresh))
            self.known_heads.append(self.used + np.cumsum(counts) - counts)
            self.known_sizes.append(counts)
            self.known_ids.append(ids.astype(np.uint16 if self.size <= 65536 else np.uint32))
            self.used += len(ids)
            for name in ("known_heads", "known_sizes", "known_ids"):
                setattr(self, name, [np.concatenate(getattr(self, name))])
        return self.known_ids[0], self.known_heads[0][which], self.known_sizes[0][which]

    def encode(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, and each text's number of ids.

        Unless ``special``, the names of special tokens are ordinary text.
        """
        if not special or not any(name in t for name in self.special for t in texts):
            return self._encode_ordinary(texts)
        # the special tokens stand between ordinary stretches
        stretches, whose, fixed = [], [], []
        for k, text in enumerate(texts):
            for part, special in _cut(text, self.special):
                stretches.append(part)
                whose.append(k)
                fixed.append(special)
        ids, counts = self._encode_ordinary(stretches)
        ends = np.cumsum(counts)
        fixed, whose = np.array(fixed), np.array(whose)
        has = fixed >= 0
        ids = np.insert(ids, ends[has], fixed[has].astype(ids.dtype))
        return ids, np.bincount(whose, counts + has, minlength=len(texts)).astype(np.int64)

    def _encode_ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kind = np.uint16 if self.size <= 65536 else np.uint32
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, kind), np.zeros(len(texts), np.int64)
        chars = np.array([len(t) for t in texts], np.int64)
        first = np.r_[0, np.cumsum(chars)]
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = piece_starts(points, first[:-1][chars > 0])
        width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        octets = np.r_[0, np.cumsum(width)]
        cuts = np.r_[octets[starts], octets[-1]].astype(np.int32)
        data = whole.encode("utf-8", "surrogatepass")
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        flat, heads, sizes = self._lookup(coded.dictionary.to_pylist())
        n = sizes[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(heads[which] - (ends - n), n) + np.arange(ends[-1])]
        # pieces never cross texts
        before = np.r_[0, ends][np.searchsorted(starts, first)]
        return ids, np.diff(before)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after the other."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.buffer[np.repeat(self.offsets[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def _cut(text: str, special: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Ordinary stretches, each with the id of the special token behind it, or -1."""
    at = 0
    while True:
        found = min(((text.find(name, at), name) for name in special if text.find(name, at) >= 0), default=None)
        if found is None:
            yield text[at:], -1
            return
        yield text[at : found[0]], special[found[1]]
        at = found[0] + len(found[1])


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``BATCH_CHARS`` code points, with their first place."""
    group, size, first = [], 0, 0
    for k, text in enumerate(texts):
        text = text or ""
        if group and size + len(text) > BATCH_CHARS:
            yield first, group
            group, size, first = [], 0, k
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def encoded(batch: pa.RecordBatch, vocab: Vocabulary, special: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ids)`` of every text of a batch."""
    for first, texts in text_groups(batch.column("text").to_pylist()):
        ids, counts = vocab.encode(texts, special)
        ends = np.cumsum(counts)
        for k, end in enumerate(ends):
            yield first + k, ids[end - counts[k] : end]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: ``doc_id``, token count and the checksums of both."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            n, sums, back = [], [], []
            for _, ids in encoded(batch, vocab):
                n.append(len(ids))
                sums.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text = vocab.decode(ids).decode("utf-8", "replace")
                back.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

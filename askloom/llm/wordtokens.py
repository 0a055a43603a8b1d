"""Token ids of texts, looked up once per distinct piece of a word.

The tokenizer drops white space and splits at it, so the ids of a text are those of its
words one after the other; added special tokens hold no white space either. Words of ASCII
characters and Latin letters are cut into runs of letters, single digits and runs of other
marks, as the vocabulary's own rules cut them; what else there is, is left to the library word
by word. That these cuts are the vocabulary's is tested on ``PROBES`` when it is loaded; if they are
not, the library gets every word.

A run of rows is handled with numpy: equal pieces are found by sorting, distinct ones in a
hash table of arrays, and the ids of all are gathered from one array.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from askloom.llm import textkernel
from askloom.llm.workers import kept

MEMO_PIECES = 1 << 20
MEMO_WORDS = 200_000  # words that the library gets whole
WHOLE_BYTES = 16  # pieces up to this length are compared by two numbers
MEMO_BYTES = 256  # longer words are not remembered

PROBES = (
    "Hello WORLD a End. so... what?! x;:,", "a1b22c 3.14 $5.00 x--y foo_bar A&B&&", "É élan ÇA straße ÀÖØÞ àöøÿ",
    "ouè. «x» naïve1é2 (é) [ÿ]", "don't I'LL it's 'quoted' ''s", "<|endoftext|> a<|b|>", "é 12 34 × ÷ µ",
)

# Kinds of bytes: white space, letters, digits, other ASCII marks, and what the library must judge.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[33:127] = MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[48:58] = DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[39] = ODD  # an apostrophe may begin a piece of its own
_LATIN = 0xC3  # first byte of the letters U+00C0 to U+00FF, of which two are no letters
_NO_LETTERS = (0x97, 0xB7)
# The characters by which byte-level vocabularies write bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


def kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of every byte, and the bytes with capital letters folded."""
    kind, folded = _KIND[data], textkernel._LOWER[data]
    lead = np.flatnonzero(data[:-1] == _LATIN)
    if len(lead):
        low = data[lead + 1]
        letter = (low >= 0x80) & (low < 0xC0) & (low != _NO_LETTERS[0]) & (low != _NO_LETTERS[1])
        lead, low = lead[letter], low[letter]
        kind[lead] = kind[lead + 1] = LETTER
        folded[lead + 1] = np.where(low < 0x9F, low + 0x20, low)
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # "<|"
    kind[special] = ODD
    return kind, folded


def edges_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a row end is a word end."""
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = ([0] if len(inside) and inside[0] else []), ([len(inside)] if len(inside) and inside[-1] else [])
    edges = np.concatenate((first, turns, last)).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    at = np.searchsorted(starts, offsets, side="right") - 1
    held, at = offsets[at >= 0], at[at >= 0]
    cuts = np.unique(held[(starts[at] < held) & (held < ends[at])])
    if len(cuts):  # words of two rows that touch
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends


def whole_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per piece of up to ``WHOLE_BYTES`` its first and last eight bytes, its length, and a
    hash of these, which say all about it; one row each."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    n = (ends - starts).astype(np.uint64)
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    first = eight[starts] & masks[np.minimum(n, 8).astype(np.int64)]
    last = np.where(n > 8, eight[np.maximum(ends - 8, 0)], 0).astype(np.uint64)
    return np.stack((textkernel.mixed(first + textkernel.mixed(last + n)), first, last, n), axis=1)


def distinct_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place per distinct row, and the number of each row among them."""
    order = np.argsort(numbers[:, 0])
    ordered = numbers[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    if (fresh[1:] & (ordered[1:, 0] == ordered[:-1, 0])).any():  # unlike pieces of one hash may alternate
        _, chosen, number = np.unique(numbers, axis=0, return_index=True, return_inverse=True)
        return chosen, number.ravel()
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


class PieceTable:
    """An open hash table of pieces in arrays, searched and filled many at a time."""

    def __init__(self, pieces: int):
        self.size = 1 << (2 * pieces - 1).bit_length()
        self.held = np.zeros((self.size, 4), np.uint64)
        self.slot = np.full(self.size, -1, np.int64)

    def _places(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers[:, 0] & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The slot of every row, -1 where there is none."""
        place = self._places(numbers)
        found = self.slot[place]
        left = np.flatnonzero((found >= 0) & (self.held[place] != numbers).any(axis=1))
        place = place[left]
        while len(left):  # those that met another piece go on to the next place
            place = (place + 1) & (self.size - 1)
            found[left] = self.slot[place]
            other = (found[left] >= 0) & (self.held[place] != numbers[left]).any(axis=1)
            left, place = left[other], place[other]
        return found

    def add(self, numbers: np.ndarray, slots: np.ndarray) -> None:
        """Rows that are not there yet, each once."""
        left, place = np.arange(len(numbers)), self._places(numbers)
        while len(left):
            free = self.slot[place] < 0
            self.slot[place[free]] = slots[left[free]]  # of several, the last one gets the place
            won = free & (self.slot[place] == slots[left])
            self.held[place[won]] = numbers[left[won]]
            left, place = left[~won], (place[~won] + 1) & (self.size - 1)


class Growing:
    """An array with room at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate((self.held, np.zeros(max(n, len(self.held)), self.held.dtype)))
        self.held[self.n : n] = values
        self.n = n


class Words:
    """Pieces and whole words with their ids, which lie end to end in one array."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo_pieces = memo_pieces
        self.forget()
        self.cuts = True
        self.cuts = all(self._fits(p) for p in PROBES)
        self.forget()

    def _fits(self, text: str) -> bool:
        data = text.encode()
        run = textkernel.Run(0, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return np.frombuffer(next(self.row_ids(run, 0)), "<u4")[:-1].tolist() == self.look_up(data)

    def forget(self) -> None:
        self.table = PieceTable(self.memo_pieces)
        self.used, self.piece_slots = Growing(np.int64), Growing(np.int64)
        self.words: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = Growing("<u4"), Growing(np.int64), Growing(np.int64)
        self.turn = 0

    def look_up(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids

    def _piece(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_WRITTEN))]

    def _store(self, found: list[list[int]]) -> np.ndarray:
        """New slots for lists of ids."""
        counts = np.array([len(x) for x in found], np.int64)
        first, slot = self.ids.n, self.starts.n
        self.ids.add([i for x in found for i in x])
        self.starts.add(first + np.cumsum(counts) - counts)
        self.counts.add(counts)
        return slot + np.arange(len(found))

    def _make_room(self) -> None:
        """Keep the half of the pieces that was used last, and no whole words."""
        if self.used.n <= self.memo_pieces and len(self.words) <= MEMO_WORDS:
            return
        last = np.argsort(-self.used.held[: self.used.n], kind="stable")[: self.memo_pieces // 2]
        filled = np.flatnonzero(self.table.slot >= 0)
        numbers = self.table.held[filled[np.argsort(self.table.slot[filled])]][last]
        used, old = self.used.held[last], self.piece_slots.held[last]
        counts, ids, turn = self.counts.held[old], self._gather(old), self.turn
        self.forget()
        self.turn = turn
        self.used.add(used)
        self.ids.add(ids)
        self.counts.add(counts)
        self.starts.add(np.cumsum(counts) - counts)
        self.piece_slots.add(np.arange(len(last)))
        self.table.add(numbers, np.arange(len(last)))

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        counts = self.counts.held[slots]
        before = np.cumsum(counts) - counts
        return self.ids.held[np.repeat(self.starts.held[slots] - before, counts) + np.arange(counts.sum())]

    def _short_slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        numbers = whole_numbers(data, starts, ends)
        places = self.table.find(numbers)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            chosen, number = distinct_of(numbers[missing])
            at = missing[chosen]
            pieces = [data[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            fresh = self.used.n + np.arange(len(at))
            self.piece_slots.add(self._store([*map(self._piece, pieces)]))
            self.used.add(np.zeros(len(at), np.int64))
            self.table.add(numbers[at], fresh)
            places[missing] = fresh[number]
        self.used.held[places] = self.turn
        return self.piece_slots.held[places]

    def _long_slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, read) -> np.ndarray:
        slots = np.zeros(len(starts), np.int64)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            word = (read, data[a:b].tobytes())
            found = self.words.get(word)
            if found is None:
                found = int(self._store([read(word[1])])[0])
                if b - a <= MEMO_BYTES:
                    self.words[word] = found
            slots[i] = found
        return slots

    def slots_in(self, run: textkernel.Run) -> tuple[np.ndarray, np.ndarray]:
        """The slots of a run in order, and where each row's begin."""
        self._make_room()
        self.turn += 1
        kind, folded = kinds(run.data)
        word_starts, word_ends = edges_of(kind != SPACE, run.offsets)
        whole = np.full(len(word_starts), not self.cuts)
        whole[np.searchsorted(word_starts, np.flatnonzero(kind == ODD), side="right") - 1] = True
        begins = np.zeros(len(kind), bool)
        begins[1:] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        begins[word_starts] = True
        starts = np.flatnonzero(begins)
        word = np.searchsorted(word_starts, starts, side="right") - 1
        kept_ = ~whole[word] | (starts == word_starts[word])
        starts, word = starts[kept_], word[kept_]
        ends = np.minimum(np.concatenate((starts[1:], [len(run.data)])), word_ends[word]) if len(starts) else starts
        ends = np.where(whole[word], word_ends[word], ends)
        slots = np.zeros(len(starts), np.int64)
        by_library = whole[word]
        short = np.flatnonzero(~by_library & (ends - starts <= WHOLE_BYTES))
        long = np.flatnonzero(~by_library & (ends - starts > WHOLE_BYTES))
        slots[short] = self._short_slots(folded, starts[short], ends[short])
        slots[long] = self._long_slots(folded, starts[long], ends[long], self._piece)
        rest = np.flatnonzero(by_library)
        slots[rest] = self._long_slots(run.data, starts[rest], ends[rest], self.look_up)
        return slots, np.searchsorted(starts, run.offsets)

    def row_counts(self, run: textkernel.Run) -> np.ndarray:
        """Tokens of every row of a run."""
        slots, bounds = self.slots_in(run)
        return np.diff(np.concatenate(([0], np.cumsum(self.counts.held[slots])))[bounds])

    def row_ids(self, run: textkernel.Run, end: int) -> Iterator[bytes]:
        """Ids of every row as unsigned little-endian 32-bit integers, each closed by ``end``."""
        slots, bounds = self.slots_in(run)
        at = np.concatenate(([0], np.cumsum(self.counts.held[slots])))[bounds]
        closed = np.insert(self._gather(slots), at[1:], end).astype("<u4").tobytes()
        places = (at + np.arange(len(at))).tolist()
        for a, b in zip(places, places[1:]):
            yield closed[4 * a : 4 * b]


class WordCounts(dict):
    """Word bytes to its number of ids, for single words."""

    def __init__(self, path: str):
        super().__init__()
        self.words = Words(path, 1 << 10)

    def __missing__(self, word: bytes) -> int:
        found = len(self.words.look_up(word))
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                for old in [*self][: MEMO_WORDS // 2]:
                    del self[old]
            self[word] = found
        return found


def words_of(path: str) -> Words:
    return kept(("words", path), lambda: Words(path))


def word_counts(path: str) -> WordCounts:
    return kept(("counts", path), lambda: WordCounts(path))

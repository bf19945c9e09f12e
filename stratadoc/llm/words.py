"""Words of many texts at once: where they lie, and what is known of each, by hash.

White space separates words. A mark after a plain letter also begins one, as a pre-token ends there in any case. All
steps are over arrays: words are read eight bytes at a time, hashed twice, and found in an open table; only words that
the table lacks are worked out one by one. The second hash tells words of one first hash apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

#: Longer words, in bytes, aren't kept; the table is emptied above this many entries.
LONGEST, ENTRIES = 64, 1 << 19
SPACE, PADDING = 32, LONGEST + 16
#: The marks that begin a word after a letter.
MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?)", np.uint8))
#: Letters that end in themselves when normalised: ASCII, and what these first bytes of two begin (Latin up to U+024F, IPA, Cyrillic to U+047F).
PLAIN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
FIRST = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
#: Of those, the multiplication and division signs, and the capital I with a dot, whose small form ends in a combining dot.
OTHERS = (0xC397, 0xC3B7, 0xC4B0)
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def simplified(text: str) -> str:
    """Text of the same tokens, character for character, with fewer different words: lower case where that is safe."""
    if "<|" not in text and "Σ" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
        low = text.lower()
        if len(low) == len(text) and (text.isascii() or unicodedata.is_normalized("NFC", low)):
            text = low
    return text.replace("\n", " ")


class Layout:
    """Texts in one buffer, a space after each, and their words."""

    def __init__(self, texts: list[str]):
        parts = [simplified(t).encode() for t in texts]
        self.stops = np.cumsum([len(p) + 1 for p in parts]) - 1  # where each text ends
        self.data = b" ".join(parts) + b" " + bytes(PADDING)
        every = np.frombuffer(self.data, np.uint8)
        self.bytes = every[: len(every) - PADDING]
        self.gap = self.bytes == SPACE
        after_gap = np.concatenate([[True], self.gap[:-1]])
        start, stop = ~self.gap & after_gap, self.gap & ~after_gap
        at = np.flatnonzero(MARKS[self.bytes])
        before, first = every[at - 1], every[at - 2]  # at a start, bytes of the padding
        both = first.astype(np.int64) << 8 | before
        at = at[PLAIN[before] | (FIRST[first] & ~np.isin(both, OTHERS))]
        start[at] = stop[at] = True
        self.starts = np.flatnonzero(start)
        self.sizes = np.flatnonzero(stop) - self.starts

    def per_text(self) -> np.ndarray:
        """How many of the words lie before each text's end."""
        return np.searchsorted(self.starts, self.stops)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        size = self.sizes.astype(np.uint64)
        x = eight[self.starts] & KEEP[np.minimum(self.sizes, 8)]
        one, two = (x ^ size * C) * A, (x + size * A) * C
        at, k = np.flatnonzero(self.sizes > 8), 8
        while len(at):
            x = eight[self.starts[at] + k] & KEEP[np.minimum(self.sizes[at] - k, 8)]
            h, g = one[at], two[at]
            one[at], two[at] = ((h ^ h >> np.uint64(32)) * B ^ x) * A, ((g ^ g >> np.uint64(29)) * A + x) * C
            k += 8
            at = at[(self.sizes[at] > k) & (k < LONGEST)]
        one = (one ^ one >> np.uint64(31)) * B
        return (one ^ one >> np.uint64(30)) | np.uint64(1), two ^ two >> np.uint64(32)

    def words(self, which: np.ndarray) -> list[str]:
        return [self.data[a : a + n].decode() for a, n in zip(self.starts[which].tolist(), self.sizes[which].tolist(), strict=True)]


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices data[start : start + size], one after the other."""
    if not len(starts):
        return data[:0]
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1]) + np.repeat(starts - np.concatenate([[0], ends[:-1]]), sizes)]


class WordTable:
    """For each word a run of values, by a function of lists of words that gives all their values and the sizes of the runs."""

    def __init__(self, kind: np.dtype, values: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.kind, self.values = kind, values
        self.clear()

    def clear(self) -> None:
        self.slots = 4 * ENTRIES
        self.shift = np.uint64(64 - (self.slots - 1).bit_length())
        self.keys, self.at = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.count = 0
        self.check, self.begin, self.sizes = np.zeros(1024, np.uint64), np.zeros(1025, np.int64), np.zeros(1024, np.int32)
        self.flat = np.zeros(1 << 14, self.kind)

    def append(self, count: int, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Values of the next places after the first `count`."""
        total, used = count + len(sizes), int(self.begin[count])
        while total > len(self.sizes):
            self.check, self.sizes, self.begin = (np.concatenate([x, np.zeros(n, x.dtype)]) for x, n in ((self.check, len(self.sizes)), (self.sizes, len(self.sizes)), (self.begin, len(self.sizes))))
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.kind)])
        self.flat[used : used + len(flat)] = flat
        self.sizes[count:total] = sizes
        self.begin[count + 1 : total + 1] = used + np.cumsum(sizes)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each word; -1 for words that aren't there, -2 for those whose place another word has."""
        slot = (one >> self.shift).astype(np.int64)
        key = self.keys[slot]
        place = np.where(key == one, self.at[slot], -1)
        live = np.flatnonzero((key != one) & (key != 0))
        while len(live):
            slot[live] = (slot[live] + 1) % self.slots
            key = self.keys[slot[live]]
            hit = key == one[live]
            place[live[hit]] = self.at[slot[live[hit]]]
            live = live[~hit & (key != 0)]
        return np.where((place >= 0) & (self.check[place] != two), -2, place)

    def insert(self, one: np.ndarray, two: np.ndarray) -> None:
        """Distinct new first hashes, for the places after the last."""
        n = len(one)
        self.check[self.count : self.count + n] = two
        slot, live, places = (one >> self.shift).astype(np.int64), np.arange(n), np.arange(self.count, self.count + n)
        while len(live):
            free = live[self.keys[slot[live]] == 0]
            self.keys[slot[free]] = one[free]
            done = self.keys[slot[live]] == one[live]
            self.at[slot[live[done]]] = places[live[done]]
            live = live[~done]
            slot[live] = (slot[live] + 1) % self.slots
        self.count += n

    def of(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words of a layout one after the other, and how many each word has."""
        if self.count > ENTRIES:
            self.clear()
        one, two = layout.hashes()
        place = self.find(one, two)
        place[layout.sizes > LONGEST] = -2
        new = np.flatnonzero(place == -1)
        if len(new):
            _, first = np.unique(one[new], return_index=True)
            for low in range(0, len(first), ENTRIES):
                own = new[first[low : low + ENTRIES]]
                if self.count + len(own) > 2 * ENTRIES:
                    return self.apart(layout, place)
                self.append(self.count, *self.values(layout.words(own)))
                self.insert(one[own], two[own])
            place[new] = self.find(one[new], two[new])
        return self.apart(layout, place)

    def apart(self, layout: Layout, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, with those of words without a place worked out for this once."""
        rest = np.flatnonzero(place < 0)
        if len(rest):
            self.append(self.count, *self.values(layout.words(rest)))
            place[rest] = np.arange(self.count, self.count + len(rest))
        sizes = self.sizes[place]
        return gather(self.flat, self.begin[place], sizes), sizes

"""Word-by-word encoding with a memory, for tasks that meet the same words over and over."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Numbered(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Memo:
    """Ids of words, worked out once for each (word, variant) and then looked up.

    ``encode`` gets the words and variants that are new and returns their ids end
    to end with the ids per word. At ``limit`` words the memory starts afresh, so it stays bounded.
    """

    def __init__(self, encode: Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]], variants: int = 1, limit: int = 600_000):
        self.encode, self.variants, self.limit = encode, variants, limit
        self._reset()

    def _reset(self) -> None:
        self.numbers = Numbered()
        self.words: list = []
        self.slot = np.full(1 << 12, -1, np.int32)
        self.start, self.length, self.filled = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    @staticmethod
    def room(array: np.ndarray, n: int, fill: int = 0) -> np.ndarray:
        if n <= len(array):
            return array
        bigger = np.full(max(n, 2 * len(array)), fill, array.dtype)
        bigger[: len(array)] = array
        return bigger

    def _learn(self, keys: np.ndarray) -> None:
        v = self.variants
        if len(self.words) < len(self.numbers):
            self.words.extend(list(self.numbers)[len(self.words) :])
        flat, lengths = self.encode([self.words[k] for k in (keys // v).tolist()], keys % v)
        new, total = len(lengths), len(flat)
        self.flat = self.room(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = flat
        self.start = self.room(self.start, self.filled + new)
        self.length = self.room(self.length, self.filled + new)
        self.start[self.filled : self.filled + new] = self.used + np.cumsum(lengths) - lengths
        self.length[self.filled : self.filled + new] = lengths
        self.slot[keys] = np.arange(self.filled, self.filled + new)
        self.filled, self.used = self.filled + new, self.used + total

    def ids(self, words: Sequence, variant: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, ids per word)."""
        if len(self.numbers) > self.limit:
            self._reset()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        keys = numbers * self.variants + variant
        self.slot = self.room(self.slot, len(self.numbers) * self.variants, -1)
        slots = self.slot[keys]
        if (unknown := slots < 0).any():
            self._learn(np.unique(keys[unknown]))
            slots = self.slot[keys]
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[slots] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.flat[at], lengths

"""Words and word shingles of whole texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np
import xxhash

SLICE_BYTES = 1 << 22  # a longer text is split into words slice by slice
CACHE_BYTES = 32 << 20  # about what a worker's cache holds before it starts anew

ODD = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    held = 0  # bytes, estimated

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        self.held += len(word) + 160
        return value

    def clear(self) -> None:
        super().clear()
        self.held = 0


class Numbered(dict):
    """Key -> number in the order of arrival, with how often each was used; ``trim`` forgets the keys used once."""

    def __init__(self):
        super().__init__()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.held = 0  # bytes, estimated
        self.uses = np.zeros(1 << 10, np.int64)

    def count(self, numbers: np.ndarray, times: np.ndarray | int = 1) -> None:
        """Note that distinct ``numbers`` were used so many times."""
        if len(self) > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(len(self), np.int64)])
        self.uses[numbers] += times

    def trim(self) -> np.ndarray:
        """Keep the keys used more than once, half of all at most, under new numbers; returns their old numbers."""
        uses = self.uses[: len(self)]
        kept = np.flatnonzero(uses > 1)
        if 2 * len(kept) > len(self):
            kept = np.sort(kept[np.argpartition(-uses[kept], len(self) // 2)[: len(self) // 2]])
        names, share = list(self), self.held // max(1, len(self))
        uses = uses[kept]
        self.clear()
        for number, k in enumerate(kept.tolist()):
            self[names[k]] = number
        self.held = share * len(kept)
        self.count(np.arange(len(kept)), uses // 2)
        return kept


_KEPT: dict = {}


def worker_cache(kind: Hashable, make: Callable):
    """The worker's cache of this kind. A worker serves many stages, so only the kind asked for last is kept."""
    if kind not in _KEPT:
        _KEPT.clear()
        _KEPT[kind] = make()
    return _KEPT[kind]


def forgetting(run: Callable) -> Callable:
    """``run`` over the batches of a task, emptying the worker's cache at its end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            for cache in _KEPT.values():
                cache.clear()

    return task


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD[40]
    x = (x ^ (x >> np.uint64(29))) * ODD[41]
    return x ^ (x >> np.uint64(32))


def split_words(text: str, lower: bool = False):
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as byte strings, in lists of a slice each; ``lower`` maps A-Z to a-z."""
    data = text.encode()
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        part = data[at:end]
        yield (part.lower() if lower else part).split()
        at = end


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """One hash per word of the whole text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    cache, parts = worker_cache("word hashes", _Hashes), []
    for words in split_words(text, lower):
        if cache.held > CACHE_BYTES:
            cache.clear()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * ODD[k]
    return mixed(total)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's shingles; a shorter text is one shingle, no words give none."""
    words = word_hashes(text, lower=True)
    if 0 < len(words) < size:
        return mixed((words * ODD[: len(words)]).sum(keepdims=True, dtype=np.uint64) + ODD[50 + len(words) % 14])
    hashes = np.sort(windows(words, size))
    return hashes[np.r_[True, hashes[1:] != hashes[:-1]]] if len(hashes) else hashes

"""Longest phrase matches over the token lists of a whole Arrow batch: a trie over token numbers, walked for all places at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


#: Tokens that are matched at once: the arrays of a match are several times as large as its tokens.
TOKENS_AT_ONCE = 1 << 18


def parts(lists: pa.Array, most: int = TOKENS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices of at most ``most`` tokens, or of one row that has more."""
    ends, at = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
    while at < len(lists) or at == 0:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, min(stop, len(lists)) - at
        at = stop


class Phrases:
    """Phrases as a trie in arrays. A key is a state and a token number; states of deeper levels have larger numbers, so
    the keys of all levels are one sorted array. State 0 is the root and 0 the number of every token in no phrase."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.number: dict[str, int] = {}
        rows = [[self.number.setdefault(w, len(self.number) + 1) for w in p.split(" ")] for p in phrases]
        self.base = len(self.number) + 1
        self.longest = max(map(len, rows), default=0)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((w for r in rows for w in r), np.int64, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        state, keys, ends, count = np.zeros(len(rows), np.int64), [], [np.zeros(1, bool)], 1
        for k in range(self.longest):
            live = np.flatnonzero(lengths > k)
            found, place = np.unique(state[live] * self.base + flat[begin[live] + k], return_inverse=True)
            state[live] = count + place
            end = np.zeros(len(found), bool)
            end[place[lengths[live] == k + 1]] = True
            keys.append(found)
            ends.append(end)
            count += len(found)
        #: the state behind key i is i + 1
        self.keys, self.ends = (np.concatenate(keys) if keys else np.zeros(0, np.int64)), np.concatenate(ends)
        self.first = np.zeros(self.base, np.int64)
        roots = self.keys[self.keys < self.base]
        self.first[roots] = np.arange(1, len(roots) + 1)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))

    def longest_at(self, numbers: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each place the words of the longest phrase that starts there and ends in its row (0: none)."""
        best = np.zeros(len(numbers), np.int64)
        at, state = np.arange(len(numbers)), self.first[numbers]
        for depth in range(1, self.longest + 1):
            hit = state > 0
            at, state = at[hit], state[hit]
            done = self.ends[state]
            best[at[done]] = depth
            go = at + depth < end[at]
            at, state = at[go], state[go]
            if not len(at):
                break
            key = state * self.base + numbers[at + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            state = np.where(self.keys[i] == key, i + 1, 0)
        return best


def greedy(best: np.ndarray) -> np.ndarray:
    """Places that a walk from left to right stops at, which jumps over the rest of each phrase that it takes."""
    stops, free = np.ones(len(best), bool), 0
    for i in np.flatnonzero(best > 1).tolist():
        if i >= free:
            free = i + int(best[i])
            stops[i + 1 : free] = False
    return stops


class Batch:
    """Token lists of a batch: the distinct words, their numbers in order, and each row's share."""

    def __init__(self, lists: pa.Array) -> None:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.n, self.row = len(lists), np.repeat(np.arange(len(lists)), sizes)

    def kept(self, keep: np.ndarray) -> Batch:
        out = object.__new__(Batch)
        out.words, out.n, out.codes, out.row = self.words, self.n, self.codes[keep], self.row[keep]
        return out

    def match(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Places where the walk stops, and the words of the phrase taken there (0: a word in no phrase)."""
        sizes = np.bincount(self.row, minlength=self.n)
        best = phrases.longest_at(phrases.numbers(self.words)[self.codes], np.cumsum(sizes)[self.row])
        stops = np.flatnonzero(greedy(best))
        return stops, best[stops]

    def texts(self, stops: np.ndarray, size: np.ndarray) -> pa.Array:
        """The words, or phrases of size words, at the stops."""
        codes, longer = self.codes[stops], np.flatnonzero(size > 1)
        joined = [" ".join(self.words[c] for c in self.codes[s : s + k].tolist()) for s, k in zip(stops[longer].tolist(), size[longer].tolist())]
        codes[longer] = len(self.words) + np.arange(len(longer))
        return pa.array(self.words + joined, pa.string()).take(pa.array(codes))

    def lists(self, values: pa.Array, row: np.ndarray) -> pa.Array:
        """values, in the order of their rows, as a list for each row."""
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values)

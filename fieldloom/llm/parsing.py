"""Prefix-free parsing: rolling hashes, triggers, dictionary and parse, and the order of suffixes.

All functions work on NumPy arrays of one task's bytes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Rolling:
    """Polynomial hashes of substrings modulo 2^64 over random numbers for the bytes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, U)
        self.base = int(rng.integers(0, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, x, U)])) for x in (self.base, self.inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(sums) - width)
        return mix((sums[width:] - sums[:n]) * self.down[:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from least values within blocks, forwards and backwards."""
    n = len(v)
    if n < width:
        return v[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    blocks[:n] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(windows: np.ndarray, width: int) -> np.ndarray:
    """For each position the trigger of its next `width` windows: the one with the least hash, the last of equals."""
    low = U((1 << 24) - 1)
    at = np.arange(len(windows), dtype=U)
    least = sliding_min((windows & ~low) | (low - at), width)
    return (low - (least & low)).astype(np.int64)


def suffix_ranks(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The place in lexicographic order of each string data[start : start + length]; equal strings have equal places.

    Strings are told apart seven bytes at a time; only those still tied go on.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    rank, active, depth = np.zeros(len(start), np.int64), np.arange(len(start)), 0
    while len(active):
        left = length[active] - depth
        word = words[start[active] + depth].astype(U) >> U(8)
        word = word & ~((U(1) << (U(8) * (U(7) - np.minimum(left, 7).astype(U)))) - U(1))
        key, group = (word << U(8)) | np.minimum(left, 8).astype(U), rank[active]
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        active, key, group, left = active[order], key[order], group[order], left[order]
        fresh_group = np.concatenate([[True], group[1:] != group[:-1]])
        fresh = fresh_group | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(active))
        first, first_group = np.maximum.accumulate(np.where(fresh, at, 0)), np.maximum.accumulate(np.where(fresh_group, at, 0))
        rank[active] = group + first - first_group
        sizes = np.diff(np.concatenate([np.flatnonzero(fresh), [len(active)]]))
        active = active[(np.repeat(sizes, sizes) > 1) & (left > 7)]
        depth += 7
    return rank


def parse_ranks(phrases: np.ndarray, most: int) -> np.ndarray:
    """The place in order of each suffix of the sequence, by doubling, equal up to `most` entries being equal."""
    rank = np.unique(phrases, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < most and rank.max(initial=0) + 1 < len(rank):
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


class Parse:
    """The prefix-free parse of some texts, and the order of any of their suffixes.

    A window of `width` bytes whose hash is 0 modulo `one_in` is a trigger. Phrases go from trigger to
    trigger, the second included, so that no suffix of a phrase that is longer than a trigger starts
    another. The suffix array of the dictionary (the distinct phrases) orders a position by the rest of
    its phrase, the suffix array of the parse (the phrases in sequence) by what follows.
    """

    def __init__(self, texts: list[bytes], rolling: Rolling, width: int = 8, one_in: int = 32):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.sums = rolling.sums(self.data)
        self.rolling = rolling
        hit = np.flatnonzero(rolling.windows(self.sums, width) % U(one_in) == 0)
        hit = hit[hit + width <= self.ends[np.searchsorted(self.ends, hit, side="right")]]
        self.cuts = np.union1d(self.starts, hit)  # where phrases start
        owner = np.searchsorted(self.ends, self.cuts, side="right")
        following = np.concatenate([self.cuts[1:], [len(self.data)]])
        last = np.concatenate([owner[1:] != owner[:-1], [True]])
        phrase_end = np.where(last, self.ends[owner], np.minimum(following + width, self.ends[owner]))
        _, first, number = np.unique(rolling.of(self.sums, self.cuts, phrase_end), return_index=True, return_inverse=True)
        # the dictionary: its phrases one after the other
        size = (phrase_end - self.cuts)[first]
        self.base = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(self.base, size)
        self.dictionary = self.data[np.repeat(self.cuts[first], size) + at]
        self.left = np.repeat(size, size) - at
        self.number = number
        # where each phrase stands in the parse, in which every text is closed by an end
        self.place = np.arange(len(self.cuts)) + owner
        self.entries = len(self.cuts) + len(texts)

    def order(self, positions: np.ndarray, depth: int) -> np.ndarray:
        """The positions in the order of the suffixes that start there (right for the first `depth` bytes).

        Of the dictionary's suffix array only the suffixes that positions ask for and the whole phrases are made.
        """
        phrase = np.searchsorted(self.cuts, positions, side="right") - 1
        spot = self.base[self.number[phrase]] + positions - self.cuts[phrase]
        asked = np.zeros(len(self.dictionary), bool)
        asked[spot] = asked[self.base] = True
        asked = np.flatnonzero(asked)
        ranks = np.zeros(len(self.dictionary), np.int64)
        ranks[asked] = suffix_ranks(self.dictionary, asked, self.left[asked])
        parse = np.zeros(self.entries, np.int64)
        parse[self.place] = ranks[self.base[self.number]] + 1
        return np.lexsort((parse_ranks(parse, depth)[self.place[phrase] + 1], ranks[spot]))

    def repeated(self, positions: np.ndarray, length: int) -> np.ndarray:
        """Whether the `length` bytes at each position also start at another of the positions: neighbours in order are compared."""
        order = self.order(positions, length)
        ranked = positions[order]
        code = self.rolling.of(self.sums, ranked, ranked + length)
        same = np.flatnonzero(code[1:] == code[:-1])
        view = np.lib.stride_tricks.sliding_window_view(self.data, length)
        out = np.zeros(len(positions), bool)
        for at in range(0, len(same), 8192):
            k = same[at : at + 8192]
            k = k[(view[ranked[k]] == view[ranked[k + 1]]).all(axis=1)]
            out[order[k]] = out[order[k + 1]] = True
        return out

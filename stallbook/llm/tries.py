"""Double-array tries of code sequences, walked by numpy from many places at once.

A code is cut into bytes, highest first, all codes of a trie into the same number, so a node has
at most 256 children and `base` and `check` stay compact. The child of node s by byte b is
t = base[s] + b if check[t] == s. All sequences of a trie have the same length.
"""

import numpy as np


class Trie:
    """A double-array trie of the rows of `codes` (a matrix of distinct rows of numbers > 0)."""

    def __init__(self, codes: np.ndarray):
        self.words = codes.shape[1]
        self.width = max(1, -(-int(codes.max(initial=1)).bit_length() // 8))
        order = np.lexsort(codes.T[::-1])
        symbols = self._bytes(codes[order]).reshape(len(codes), -1)
        self.depth = symbols.shape[1]
        # node of each row at each depth, numbered level by level; the root is node 0
        new = np.ones(len(symbols), dtype=bool)
        node, count = np.zeros(len(symbols), dtype=np.int64), 1
        parents, labels = [], []
        changed = np.zeros(len(symbols), dtype=bool)
        changed[:1] = True
        for level in range(self.depth):
            new = changed.copy()
            new[1:] |= symbols[1:, level] != symbols[:-1, level]
            parents.append(node[new])
            labels.append(symbols[new, level])
            node = count + np.cumsum(new) - 1
            count += int(new.sum())
            changed = new
        self._place(np.concatenate(parents), np.concatenate(labels).astype(np.int64), count)
        #: the row of `codes` that ends at a place, or -1
        self.entry = np.full(len(self.check), -1, dtype=np.int32)
        self.entry[self._at[node]] = order
        del self._at

    def _bytes(self, codes: np.ndarray) -> np.ndarray:
        shifts = 8 * np.arange(self.width - 1, -1, -1)
        return (codes[..., None] >> shifts) & 255

    def _place(self, parents: np.ndarray, labels: np.ndarray, count: int) -> None:
        """Give every node a base, so that no two children share a place.

        Nodes with many children go one after the other behind each other; those with a few draw
        places at random, in rounds, the larger ones first, while the array is sparse. Only children,
        which most are, then take the places that are free, so the array is little longer than their
        number: every Python worker holds a copy.
        """
        draw = np.random.default_rng(0)
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(parents)) + 1])
        owners, ends = parents[firsts], np.append(firsts[1:], len(parents))
        sizes = ends - firsts
        large = np.flatnonzero(sizes > 16)
        few = (sizes > 1) & (sizes <= 16)
        room = 4 * int(sizes[few].sum()) + 256 * (len(large) + 2)
        base = np.zeros(count, dtype=np.int64)
        at = np.zeros(count, dtype=np.int64)  # place of each node; child i is node i + 1
        used = np.zeros(room, dtype=bool)
        used[0] = True
        low = 1
        for i in large:
            own = labels[firsts[i]:ends[i]]
            base[owners[i]] = low - own[0]
            at[1 + firsts[i]:1 + ends[i]] = places = low + own - own[0]
            used[places] = True
            low = int(places[-1]) + 1
        for upper, lower in ((16, 5), (4, 3), (2, 2)):
            left = np.flatnonzero((sizes <= upper) & (sizes >= lower))
            while len(left):
                tried = draw.integers(1, room - 256, len(left))
                lengths = sizes[left]
                rows = np.repeat(np.arange(len(left)), lengths)
                child = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) \
                    + np.repeat(firsts[left], lengths)
                shift = tried - labels[firsts[left]]
                places = shift[rows] + labels[child]
                # of several that want one place the first in order has it
                first = np.full(room, len(left), dtype=np.int64) if len(left) > room // 8 else None
                if first is not None:
                    np.minimum.at(first, places, rows)
                    clash = used[places] | (first[places] != rows)
                else:
                    order = np.argsort(places, kind="stable")
                    same = np.zeros(len(places), dtype=bool)
                    same[order[1:]] = places[order[1:]] == places[order[:-1]]
                    clash = used[places] | same
                bad = np.bincount(rows, clash, len(left)) > 0
                good = ~bad[rows]
                base[owners[left[~bad]]] = shift[~bad]
                at[1 + child[good]] = places[good]
                used[places[good]] = True
                left = left[bad]
        only = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~used[1:])[:len(only)] + 1
        places = np.append(free, np.arange(room, room + len(only) - len(free)))
        base[owners[only]] = places - labels[firsts[only]]
        at[1 + firsts[only]] = places
        length = int(at.max(initial=0)) + 257
        self.base = np.zeros(length, dtype=np.int32)
        self.check = np.full(length, -1, dtype=np.int32)
        self.base[at[owners]] = base[owners]
        self.check[at[1:]] = at[parents]
        self._at = at

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row that begins at each place of `codes`, or -1.

        All places advance together, one byte of one word at a time; those that leave the trie
        drop out. Code 0 is in no sequence.
        """
        out = np.full(len(codes), -1, dtype=np.int64)
        here = np.arange(max(0, len(codes) - self.words + 1))
        state = np.zeros(len(here), dtype=np.int64)
        limit = 1 << (8 * self.width)
        for word in range(self.words):
            read = codes[here + word]
            inside = (read > 0) & (read < limit)
            here, state, read = here[inside], state[inside], read[inside]
            for shift in range(8 * (self.width - 1), -1, -8):
                after = self.base[state] + ((read >> shift) & 255)
                on = (after >= 0) & (after < len(self.check))
                on &= self.check[np.where(on, after, 0)] == state
                here, state, read = here[on], after[on].astype(np.int64), read[on]
        out[here] = self.entry[state]
        return out

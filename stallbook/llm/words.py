"""Words and their hashes for whole Arrow batches of texts, without a Python loop over words.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Hashes are 64-bit and
the same on every machine. Batches are worked through in slices of about `SLICE` bytes,
so that the arrays beside the text stay small however long the batch; a text is never cut.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_STEP2 = 0xD1342543DE82EF95
_BACK2 = pow(_STEP2, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits; one to one."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: One random 64-bit number per byte value, made by rule.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_STEP))
_BYTE2 = mix(np.arange(257, 513, dtype=np.uint64) * _U(_STEP2))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(salt << 32)) * _U(_STEP)) | _U(1)


class _Powers:
    """Powers of one odd number modulo 2**64, extended when a longer slice comes."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) <= n:
            steps = np.full(max(n, SLICE) + 1, self.base, dtype=np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known


_UP, _DOWN = _Powers(_STEP), _Powers(_BACK)
_UP2, _DOWN2 = _Powers(_STEP2), _Powers(_BACK2)


@dataclass
class Slice:
    """Some texts of a batch: their bytes and the words in them."""

    first: int  # row in the batch of the first text
    data: np.ndarray  # bytes of all texts, one after the other
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    text: np.ndarray  # the word's text, counted from `first`

    @property
    def size(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=self.size).astype(np.int64)

    def spans(self) -> np.ndarray:
        """Text i has the words spans[i] to spans[i + 1]."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans."""
        return self._rolled(starts, ends, _BYTE, _UP, _DOWN)

    def twin_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Second hashes of the byte spans, made from other numbers: 128 bits with the first."""
        return self._rolled(starts, ends, _BYTE2, _UP2, _DOWN2)

    def _rolled(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, up: _Powers,
                down: _Powers) -> np.ndarray:
        n = len(self.data)
        rolled = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[self.data] * up.upto(n)[:n], dtype=np.uint64, out=rolled[1:])
        return mix((rolled[ends] - rolled[starts]) * down.upto(n)[starts]
                   + (ends - starts).astype(np.uint64))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text and number (from 0, in its text) of every line with a word."""
        ends = np.flatnonzero(self.data == 10)
        text = np.searchsorted(self.bounds, ends, "right") - 1
        starts = np.sort(np.concatenate([self.bounds[:-1], ends + 1]), kind="stable")
        stops = np.sort(np.concatenate([self.bounds[1:], ends]), kind="stable")
        text = np.sort(np.concatenate([np.arange(self.size), text]), kind="stable")
        number = np.arange(len(text)) - np.searchsorted(text, text, "left")
        full = np.searchsorted(self.starts, stops) > np.searchsorted(self.starts, starts)
        return starts[full], stops[full], text[full], number[full]

    def words(self) -> np.ndarray:
        """Hash of each word."""
        return self.hash_spans(self.starts, self.ends)


def slices(column: pa.Array, lower: bool = False, blank: np.ndarray = SPACE,
           limit: int = SLICE, rows: int = 1 << 14) -> Iterator[Slice]:
    """The texts of an Arrow column, null as empty, in slices of about `limit` bytes.

    A slice has `rows` texts at most.

    `lower` turns A-Z to a-z, `blank` says for each byte whether it parts words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, bytes_ = column.buffers()
    offsets = np.zeros(1, dtype=width) if places is None else np.frombuffer(places, dtype=width)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ else np.zeros(0, dtype=np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, at + rows)
        bounds = offsets[at:to + 1] - offsets[at]
        data = whole[offsets[at]:offsets[to]]
        yield _slice(at, LOWER[data] if lower else data, bounds, blank)
        at = to


def _slice(first: int, data: np.ndarray, bounds: np.ndarray, blank: np.ndarray) -> Slice:
    inside = ~blank[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = bounds[:-1][bounds[1:] > bounds[:-1]]
    before[full] = False
    after[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Slice(first, data, bounds, starts, ends, np.searchsorted(bounds, starts, "right") - 1)


def sequences(hashes: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each sequence hashes[first:end], the same wherever it stands."""
    n = len(hashes)
    rolled = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _UP.upto(n)[:n], dtype=np.uint64, out=rolled[1:])
    return mix((rolled[ends] - rolled[firsts]) * _DOWN.upto(n)[firsts]
               + (ends - firsts).astype(np.uint64))


def runs(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `n` words within a text, and the first word of each run."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    last = len(hashes) - n + 1
    total = np.zeros(last, dtype=np.uint64)
    for j, seed in enumerate(seeds(n)):
        total += hashes[j:last + j] * seed
    firsts = np.flatnonzero(text[:last] == text[n - 1:])
    return mix(total[firsts]), firsts


def shingle_sets(part: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `n`-word shingles of each text: hashes by text, and their bounds.

    A text of fewer words has its whole sequence as one shingle, an empty one has none.
    """
    hashes, counts = part.words(), part.counts()
    found, firsts = runs(hashes, part.text, n)
    owner = part.text[firsts]
    spans = part.spans()
    few = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.zeros(len(few), dtype=np.uint64)
    for i, t in enumerate(few):
        own = hashes[spans[t]:spans[t + 1]]
        whole[i] = mix((own * seeds(len(own), 1)).sum(dtype=np.uint64)[None] + _U(len(own)))[0]
    owner, found = np.concatenate([owner, few]), np.concatenate([found, whole])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found = owner[new], found[new]
    return found, np.searchsorted(owner, np.arange(part.size + 1), "left")

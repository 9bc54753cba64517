"""External induced suffix sorting with common-prefix values.

Suffixes are ordered as in induced sorting: the S* suffixes first, by the order of the
substrings between them and, above that, of the reduced string of their names; the L
suffixes are induced from these in one ascending pass, the S suffixes in one descending
pass. Each pass takes its tuples (first byte, order of entry, place, common prefix with
the tuple before) out of a priority queue and puts a suffix's left neighbour back in. The
queue is one run per first byte; runs beyond the memory allowed lie in scratch files.
Common prefixes are carried along, up to the depth asked for.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

MEMORY = 256_000_000
_BOUNDS = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)


class TupleQueue:
    """Tuples (place, common prefix) by first byte, each byte's in order of entry."""

    def __init__(self, folder: Path, memory: int):
        self.folder, self.memory, self.held = folder, memory, 0
        self.runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.spilled: set[int] = set()

    def push(self, byte: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.runs.setdefault(byte, []).append((places, prefixes))
        self.held += places.nbytes + prefixes.nbytes
        if self.held > self.memory:
            for b, run in self.runs.items():
                for name, arrays in zip(("p", "x"), zip(*run)):
                    with open(self.folder / f"{b}{name}", "ab") as f:
                        np.concatenate(arrays).tofile(f)
                self.spilled.add(b)
            self.runs, self.held = {}, 0

    def pop(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a byte, in order; they leave the queue."""
        parts = self.runs.pop(byte, [])
        self.held -= sum(p.nbytes + x.nbytes for p, x in parts)
        if byte in self.spilled:
            self.spilled.discard(byte)
            files = [self.folder / f"{byte}{name}" for name in "px"]
            parts.insert(0, (np.fromfile(files[0], np.int64), np.fromfile(files[1], np.int16)))
            for f in files:
                f.unlink()
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


def _s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is not."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(np.append(step, -1)[following] > 0, False)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each pair of suffixes, at most ``depth``; eight bytes at a time."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    eights = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    out = np.full(len(a), depth, np.int64)
    live = np.arange(len(a))
    for at in range(0, depth, 8):
        x = (eights[a[live] + at] ^ eights[b[live] + at]).astype(np.uint64)
        differ = x != 0
        gone = live[differ]
        out[gone] = at + 7 - np.searchsorted(_BOUNDS, x[differ], "right")
        live = live[~differ]
        live = live[np.maximum(a[live], b[live]) + at + 8 < n]
    return np.minimum(np.minimum(out, depth), n - np.maximum(a, b)).astype(np.int16)


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Rank of each S* substring, from an S* place to the next one inclusive.

    Seven symbols of nine bits make a key; a substring is named to its end mark, also where
    that mark begins a key. The end of the text ranks below all bytes;
    the end of a substring above all, as a suffix that goes on there is an L suffix.
    """
    symbols = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    ends = np.append(stars[1:] + 1, len(text) + 1)
    rank, tied, at = np.zeros(len(stars), np.int64), np.arange(len(stars)), 0
    while len(tied):
        key = np.zeros(len(tied), np.uint64)
        for k in range(at, at + 7):
            place = stars[tied] + k
            symbol = np.where(place < ends[tied], symbols[np.minimum(place, len(text))], np.uint64(257))
            key = (key << np.uint64(9)) | symbol
        at += 7
        rank[tied] = _dense(rank[tied], key, rank, tied)
        counts = np.bincount(rank, minlength=len(stars) + 1)
        tied = tied[(counts[rank[tied]] > 1) & (stars[tied] + at <= ends[tied])]
    return rank


def _dense(major: np.ndarray, minor: np.ndarray, rank: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Ranks among all after ``minor`` breaks the ties of ``major``.

    A rank is the number of members below, so breaking ties inside a rank moves no other.
    """
    top = int(minor.max()) + 1
    if not major.any():
        order = np.argsort(minor)
    elif top < 2**62 // len(rank):
        order = np.argsort(major * top + minor.astype(np.int64))
    else:
        order = np.lexsort((minor, major))
    a, b = major[order], minor[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    group = np.append(True, a[1:] != a[:-1])
    first = np.maximum.accumulate(np.where(group, np.arange(len(a)), 0))
    own = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    out = np.empty(len(a), np.int64)
    out[order] = a + own - first
    return out


def _order_stars(text: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """S* places in the order of their suffixes, ties beyond ``depth`` bytes by place, and
    their ranks; suffixes of one rank agree over ``depth`` bytes.

    The names' ranks are the reduced string; its suffixes are ordered by ranks of twice
    as many names each round, among the tied alone.
    """
    rank, m, step = _names(text, stars), len(stars), 1
    bounds = np.append(stars, len(text))
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        reach = bounds[np.minimum(tied + step, m)] - stars[tied]
        tied = tied[reach < depth]
        if not len(tied):
            order = np.argsort(rank, kind="stable")
            return stars[order], rank[order]
        # A tied suffix whose twin reaches the depth does so itself, so ranks stay whole.
        after = tied + step
        minor = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        rank[tied] = _dense(rank[tied], minor, rank, tied)
        step *= 2


class _Minima:
    """For each first byte, the least common prefix since its last tuple was put in."""

    def __init__(self, depth: int):
        self.depth = depth
        self.least = np.full(256, depth, np.int16)
        self.seen = np.zeros(256, bool)

    def spread(self, byte: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per byte: which of the taken tuples put a neighbour in, and its common prefix
        with the one put in before it: one more than the least in between."""
        out, whole = [], prefix.min()
        order = np.argsort(byte, kind="stable")
        cuts = np.append(0, np.flatnonzero(np.diff(byte[order])) + 1)
        self.least, before = np.minimum(self.least, whole), self.least
        for begin, end in zip(cuts, np.append(cuts[1:], len(order))):
            own = order[begin:end]
            b, places = int(byte[own[0]]), at[own]
            starts = np.append(0, places + 1)
            inside = starts[starts < len(prefix)]
            least = np.minimum.reduceat(prefix, inside)
            gained = least[: len(places)].copy()
            gained[0] = min(gained[0], before[b])
            values = np.minimum(gained + 1, self.depth).astype(np.int16)
            if not self.seen[b]:
                values[0], self.seen[b] = 0, True
            self.least[b] = least[-1] if len(inside) > len(places) else self.depth
            out.append((b, own, values))
        return out


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, by their first ``depth`` bytes at least, and the common
    prefix of each with the one before it, up to ``depth``."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    small = _s_types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    star_prefix = np.zeros(len(stars), np.int16)
    if len(stars):
        stars, rank = _order_stars(text, stars, depth)
        new = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        star_prefix[1:] = depth
        star_prefix[new] = _common(text, stars[new - 1], stars[new], depth)
    star_at = np.searchsorted(text[stars], np.arange(257))
    with tempfile.TemporaryDirectory() as scratch:
        larges = _induce_large(text, small, stars, star_prefix, star_at, depth, Path(scratch), memory)
        return _induce_small(text, small, larges, depth, Path(scratch), memory)


def _seam(text: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
    """The common prefix of the last suffix below and the first above, up to ``depth``."""
    if not len(low) or not len(high):
        return 0
    a, b = int(low[-1]), int(high[0])
    n = min(depth, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def _induce_large(text, small, stars, star_prefix, star_at, depth, scratch, memory) -> TupleQueue:
    queue, done, minima = TupleQueue(_made(scratch / "a"), memory), TupleQueue(_made(scratch / "l"), memory), _Minima(depth)
    last = len(text) - 1
    queue.push(int(text[last]), np.array([last]), np.zeros(1, np.int16))  # the empty suffix's neighbour
    minima.seen[text[last]] = True
    minima.least[text[last]] = 0
    for c in range(256):
        places, prefix = queue.pop(c)
        final, first = [], True
        while len(places):
            if first:
                prefix[0], first = 0, False
            final.append((places, prefix))
            _put(text, ~small, places, prefix, minima, queue)
            places, prefix = queue.pop(c)
        whole = [np.concatenate(x) for x in zip(*final)] if final else [np.zeros(0, np.int64), np.zeros(0, np.int16)]
        if len(whole[0]):
            done.push(c, *whole)
        own = slice(star_at[c], star_at[c + 1])
        if own.start < own.stop:
            prefix = star_prefix[own].copy()
            prefix[0] = _seam(text, whole[0], stars[own], depth)
            _put(text, ~small, stars[own], prefix, minima, queue)
    return done


def _induce_small(text, small, larges, depth, scratch, memory) -> tuple[np.ndarray, np.ndarray]:
    queue, minima = TupleQueue(_made(scratch / "s"), memory), _Minima(depth)
    order, common = [], []
    for c in range(255, -1, -1):
        places, prefix = queue.pop(c)
        final, first = [], True
        while len(places):
            if first:
                prefix[0], first = 0, False
            final.append((places, prefix))
            _put(text, small, places, prefix, minima, queue)
            places, prefix = queue.pop(c)
        smalls, below = [np.concatenate(x) for x in zip(*final)] if final else [np.zeros(0, np.int64), np.zeros(0, np.int16)]
        large, large_prefix = larges.pop(c)
        seam = _seam(text, large, smalls[::-1], depth)
        if len(large):
            # Descending: a tuple's prefix is that with the next larger suffix.
            falling = np.append(large_prefix[1:], np.int16(seam))[::-1].copy()
            _put(text, small, large[::-1].copy(), falling, minima, queue)
        if len(smalls):
            rising = np.append(below[1:][::-1], 0).astype(np.int16)
            order.append(smalls[::-1])
            common.append(np.append(np.int16(seam), rising[:-1]))
        if len(large):
            order.append(large)
            common.append(large_prefix)
    return np.concatenate(order[::-1]), np.concatenate(common[::-1])


def _put(text, kind, places, prefix, minima, queue) -> None:
    """Put the left neighbours of the wanted kind into the queue, in the order taken."""
    left = places - 1
    at = np.flatnonzero((left >= 0) & kind[left])
    if not len(at):
        minima.least = np.minimum(minima.least, prefix.min())
        return
    moved = left[at]
    for byte, own, values in minima.spread(text[moved], at, prefix):
        queue.push(byte, moved[own], values)


def _made(folder: Path) -> Path:
    folder.mkdir()
    return folder

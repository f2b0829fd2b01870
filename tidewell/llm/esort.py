"""External induced suffix sorting with common-prefix lengths.

Suffixes are split into types L (larger than their successor suffix) and S.  The S suffixes that follow an L one (S*) are
named by their substrings and sorted by recursion on the string of names; one ascending pass then induces the L suffixes
and one descending pass the S suffixes.  In a pass every induced suffix is a tuple (position, common prefix with its
predecessor) that waits in a priority queue keyed by first symbol and order of arrival.  As arrivals come in order, such
a queue is a first-in-first-out run for each symbol and a heap of the symbols that have one; when the tuples held in
memory exceed the budget, all runs move to a scratch file, so queues may be far larger than memory.

Common prefixes are carried along: of two suffixes induced one after the other under a symbol it is one more than the
smallest value scanned between their successors.  Values are cut at ``cap``.
"""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np

_BATCH = 1 << 16


class TupleQueues:
    """The priority queue: runs of (position, prefix) tuples by symbol, in memory up to ``budget`` tuples, else on disk."""

    def __init__(self, sign: int, budget: int, folder: str):
        self.sign, self.budget = sign, budget
        self.runs: dict[int, list] = {}
        self.stored: dict[int, list[tuple[int, int]]] = {}
        self.symbols: list[int] = []
        self.held, self.folder, self.file, self.end = 0, folder, None, 0

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if symbol not in self.runs:
            self.runs[symbol] = []
            heapq.heappush(self.symbols, self.sign * symbol)
        self.runs[symbol].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(self.end)
        for symbol, chunks in self.runs.items():
            if chunks:
                pos, lcp = np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks])
                self.stored.setdefault(symbol, []).append((self.end, len(pos)))
                self.file.write(pos.tobytes())
                self.file.write(lcp.tobytes())
                self.end += 9 * len(pos)
                chunks.clear()
        self.held = 0

    def smallest(self) -> int | None:
        return self.sign * self.symbols[0] if self.symbols else None

    def take(self, symbol: int):
        """All tuples of a symbol in order of arrival, in chunks; the symbol's run is empty then."""
        for at, n in self.stored.pop(symbol, ()):
            for a in range(0, n, _BATCH):  # a piece at a time
                m = min(_BATCH, n - a)
                self.file.seek(at + 8 * a)
                pos = np.frombuffer(self.file.read(8 * m), np.int64)
                self.file.seek(at + 8 * n + a)
                yield pos, np.frombuffer(self.file.read(m), np.uint8)
        chunks, self.runs[symbol] = self.runs.get(symbol, []), []
        self.held -= sum(len(c[0]) for c in chunks)
        if chunks:
            yield np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks])

    def waiting(self, symbol: int) -> bool:
        return bool(self.runs.get(symbol)) or symbol in self.stored

    def done(self, symbol: int) -> None:
        if self.symbols and self.sign * self.symbols[0] == symbol:
            heapq.heappop(self.symbols)
            self.runs.pop(symbol, None)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima over [low, high] (inclusive) by a sparse table."""
    table, width = [values], 1
    while 2 * width <= len(values):
        prev = table[-1]
        table.append(np.minimum(prev[: len(prev) - width], prev[width:]))
        width *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << int(k)) + 1])
    return out


class _Pass:
    """One inducing scan over symbols in ascending (sign 1) or descending (sign -1) order."""

    def __init__(self, x, wanted, run, sign: int, cap: int, budget: int, folder: str, prefixes: bool = True):
        self.x, self.wanted, self.run, self.cap, self.prefixes = x, wanted, run, cap, prefixes
        self.queue = TupleQueues(sign, budget, folder)
        self.sign, self.at = sign, 0
        self.last: dict[int, int] = {}  # scan index of the latest induction under a symbol
        self.recent = np.full(cap + 1, -1, np.int64)  # latest scan index whose prefix is at most v

    def start(self, pos: int) -> None:
        """A suffix without a scanned successor (the last of the string)."""
        self.queue.push(int(self.x[pos]), np.array([pos], np.int64), np.zeros(1, np.uint8))
        self.last[int(self.x[pos])] = -1

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for a in range(0, len(pos), _BATCH):
            self._batch(pos[a : a + _BATCH], lcp[a : a + _BATCH])

    def _batch(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        base, self.at = self.at, self.at + len(pos)
        prev = pos - 1
        here = np.flatnonzero(prev >= 0)
        here = here[self.wanted[prev[here]]]
        if len(here):
            symbol = self.x[prev[here]]
            order = np.argsort(symbol, kind="stable")
            here, symbol = here[order], symbol[order]
            first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
            starts = np.flatnonzero(first)
            if not self.prefixes:
                none = np.zeros(len(here), np.uint8)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(here)]):
                    self.queue.push(int(symbol[a]), prev[here[a:b]], none[a:b])
                return
            low = np.where(first, 0, np.concatenate([[0], here[:-1] + 1]))
            value = np.minimum(_range_min(lcp, low, here).astype(np.int64) + 1, self.cap)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(here)]):
                c = int(symbol[a])
                since = self.last.get(c)
                if since is None:
                    value[a] = 0
                else:
                    before = int(np.searchsorted(self.recent, since, side="right"))  # smallest value scanned after that
                    value[a] = min(int(value[a]), before + 1, self.cap)
                self.last[c] = base + int(here[b - 1])
                self.queue.push(c, prev[here[a:b]], value[a:b].astype(np.uint8))
        if not self.prefixes:
            return
        latest = np.full(self.cap + 1, -1, np.int64)
        latest[lcp] = base + np.arange(len(lcp))
        self.recent = np.maximum(self.recent, np.maximum.accumulate(latest))

    def go(self, seeds, emit) -> None:
        """``seeds``: (symbol, positions, prefixes) in scan order, scanned after the symbol's own run; ``emit`` gets (symbol, from the run?, positions, prefixes)."""
        seeds = iter(seeds)
        seed = next(seeds, None)
        while True:
            c, d = self.queue.smallest(), seed[0] if seed else None
            if c is None and d is None:
                break
            now = d if c is None else c if d is None else self.sign * min(self.sign * c, self.sign * d)
            tail = None
            while self.queue.waiting(now):
                for pos, lcp in self.queue.take(now):
                    emit(now, True, pos, lcp)
                    self.scan(pos, lcp)
                    tail = int(pos[-1])
            self.queue.done(now)
            if seed and d == now:
                pos, lcp = seed[1], seed[2].copy()
                lcp[0] = 0 if tail is None else min(int(self.run[tail]), int(self.run[pos[0]]), self.cap)
                emit(now, False, pos, lcp)
                self.scan(pos, lcp)
                seed = next(seeds, None)
        self.queue.close()


def _by_symbol(x, pos: np.ndarray, lcp: np.ndarray):
    symbol = x[pos]
    starts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(pos) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pos)]):
        yield int(symbol[a]), pos[a:b], lcp[a:b]


def _types(x) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and how often its first symbol repeats."""
    n = len(x)
    change = np.flatnonzero(x[1:] != x[:-1])
    ends = np.concatenate([change, [n - 1]])  # last position of each run of equal symbols
    lengths = np.diff(np.concatenate([[-1], ends]))
    rising = np.concatenate([x[change] < x[change + 1], [False]])  # the string's end is smaller than any symbol
    run = np.repeat(ends, lengths) - np.arange(n) + 1
    return np.repeat(rising, lengths), np.minimum(run, 255).astype(np.uint8)


def _common(x, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, cut at ``cap``."""
    n, out, live = len(x), np.zeros(len(a), np.int64), np.arange(len(a))
    if x.dtype == np.uint8:  # eight symbols at a time
        padded = np.concatenate([x, np.zeros(8, np.uint8)])
        words = np.ndarray((n,), "<u8", padded, strides=(1,))
        while len(live):
            p, q = a[live] + out[live], b[live] + out[live]
            both = (p < n) & (q < n)
            live, p, q = live[both], p[both], q[both]
            diff = words[p] ^ words[q]
            low = diff & (~diff + np.uint64(1))
            same = np.where(diff == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            out[live] += np.minimum(same, n - np.maximum(p, q))
            live = live[(diff == 0) & (out[live] < cap)]
        return np.minimum(out, cap)
    while len(live):
        p, q = a[live] + out[live], b[live] + out[live]
        ok = (p < n) & (q < n)
        ok[ok] = x[p[ok]] == x[q[ok]]
        live = live[ok]
        out[live] += 1
        live = live[out[live] < cap]
    return out


def _doubling(names: np.ndarray, cap: int) -> np.ndarray:
    """Suffixes of a string of names that fits in memory, in order of what at least ``cap`` symbols under their names say."""
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + after + 1
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or 2 * width >= cap:  # a name stands for two symbols at least
            return order


def _sorted_stars(x, cap: int, budget: int, in_memory: int, folder: str):
    """Types and the S* suffixes in order with their common prefixes."""
    is_s, run = _types(x)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(star) > 1:
        # order of the S* substrings: both passes from unsorted heads
        heads = star[np.argsort(x[star], kind="stable")]
        found: list[np.ndarray] = []
        is_star = np.zeros(len(x), bool)
        is_star[star] = True
        _induce(x, is_s, run, heads, np.zeros(len(heads), np.uint8), cap, budget, folder, lambda pos, lcp: found.append(pos[is_star[pos]]), prefixes=False)
        order = np.concatenate(found)[::-1]
        number = np.empty(len(x) + 1, np.int32)
        number[star] = np.arange(len(star))
        ends = np.concatenate([star[1:] + 1, [len(x)]])
        size = (ends - star)[number[order]]
        same = np.zeros(len(order), bool)
        equal = np.flatnonzero(size[1:] == size[:-1]) + 1
        length = size[equal]
        same[equal] = _common(x, order[equal - 1], order[equal], int(length.max(initial=1))) >= length
        last = np.flatnonzero(order == star[-1])  # only it reaches the end of the string
        same[last] = False
        same[np.minimum(last + 1, len(order) - 1)] &= last + 1 >= len(order)
        names = np.empty(len(star), np.int32)
        named = np.cumsum(~same) - 1
        names[number[order]] = named
        if named[-1] == len(star) - 1:
            star = order
        elif len(star) <= in_memory:
            star = star[_doubling(names, cap)]
        else:
            deeper: list[np.ndarray] = []
            suffix_sort(names, cap, lambda pos, lcp: deeper.append(pos), budget, in_memory, folder)
            star = star[np.concatenate(deeper)[::-1]]
    lcp = np.zeros(len(star), np.uint8)
    if len(star) > 1:
        lcp[1:] = _common(x, star[:-1], star[1:], cap)
    return is_s, run, star, lcp


def _induce(x, is_s, run, star, lcp, cap: int, budget: int, folder: str, emit, prefixes: bool = True) -> None:
    rising = _Pass(x, ~is_s, run, 1, cap, budget, folder, prefixes)
    large = TupleQueues(-1, budget, folder)  # L suffixes by symbol, for the second pass
    rising.start(len(x) - 1)
    rising.go(_by_symbol(x, star, lcp), lambda c, own, pos, p: large.push(c, pos, p) if own else None)

    def backwards():
        while (c := large.smallest()) is not None:
            chunks = list(large.take(c))
            large.done(c)
            pos, p = np.concatenate([k[0] for k in chunks]), np.concatenate([k[1] for k in chunks])
            yield c, pos[::-1], np.concatenate([p[:1], p[1:][::-1]])

    _Pass(x, is_s, run, -1, cap, budget, folder, prefixes).go(backwards(), lambda c, own, pos, p: emit(pos, p))
    large.close()


def suffix_sort(x: np.ndarray, cap: int, emit, budget: int = 4_000_000, in_memory: int = 8_000_000, folder: str | None = None) -> None:
    """Calls ``emit(positions, prefixes)`` with all suffixes of ``x`` in descending order.

    ``prefixes`` are common prefixes with the suffix emitted before, cut at ``cap`` (at most 255); suffixes that agree in
    their first ``cap`` symbols come together, in any order.  ``budget`` bounds the tuples a queue holds in memory,
    ``in_memory`` the strings of names that are sorted without further recursion.
    """
    if not len(x):
        return
    folder = folder or os.environ.get("TMPDIR") or tempfile.gettempdir()
    is_s, run, star, lcp = _sorted_stars(x, cap, budget, in_memory, folder)
    _induce(x, is_s, run, star, lcp, cap, budget, folder, emit)

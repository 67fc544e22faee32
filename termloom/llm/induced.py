"""Suffix order and common prefixes of a string by external induced sorting.

Suffixes pass through queues, one for each first symbol, as tuples: position, length of the prefix shared with the tuple
before, and the symbols that precede, so that inducing reads no text at random. Beyond a bound of tuples in memory the queues
go to a file, are read back in pieces, and take what those pieces induce at their ends. Names of the substrings between
leftmost smaller suffixes are told apart by the common prefixes that the first induction carries; the string of names
goes through the same induction until it fits in memory, where it is ordered at once, and its common prefixes, in names, become
common prefixes in symbols for the induction above.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np

TUPLE = np.dtype([("at", "<i8"), ("window", "<u8"), ("lcp", "<i4"), ("left", "<i4")])
#: Alphabets up to this have a queue a symbol; larger ones a queue for a range of symbols, ordered by a heap when its turn comes.
QUEUES = 512
FAR = 2**31 - 1
#: Tuples that queues of this process have written to files.
SPILLED = 0


def scratch() -> str:
    """Where Spark keeps what a task spills; nothing there outlives or leaves the task."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0]


class Spool:
    """First-in, first-out queues of tuples, one a kind; beyond `memory` tuples together they go to a file of the task."""

    def __init__(self, kinds: int, memory: int):
        self.parts: list[deque] = [deque() for _ in range(kinds)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, kinds: np.ndarray, tuples: np.ndarray) -> None:
        """Each tuple at the end of its kind's queue, in the order given."""
        if len(tuples):
            order = np.argsort(kinds.astype(np.uint16) if len(self.parts) <= 1 << 16 else kinds, kind="stable")
            kinds, tuples = kinds[order], tuples[order]
            cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
            for k, a, b in zip(kinds[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
                self.parts[k].append(tuples[a:b])
            self._grown(len(tuples))

    def add(self, kind: int, tuples: np.ndarray) -> None:
        if len(tuples):
            self.parts[kind].append(tuples)
            self._grown(len(tuples))

    def _grown(self, n: int) -> None:
        global SPILLED
        self.held += n
        if self.held <= self.memory:
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=scratch())
        at = self.file.seek(0, os.SEEK_END)
        for q in self.parts:
            for i, part in enumerate(q):
                if isinstance(part, np.ndarray):
                    self.file.write(part.tobytes())
                    q[i] = (at, len(part))
                    at += len(part) * TUPLE.itemsize
                    SPILLED += len(part)
        self.held = 0

    def _get(self, part, a: int, n: int) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part[a : a + n]
        self.file.seek(part[0] + a * TUPLE.itemsize)
        return np.frombuffer(self.file.read(n * TUPLE.itemsize), TUPLE)

    def pieces(self, kind: int, last_first: bool = False) -> Iterator[np.ndarray]:
        """A queue's tuples, gone from it, some at a time; what is put meanwhile follows. Or from its end, last first."""
        q, most = self.parts[kind], max(1, self.memory // 2)
        while q:
            some, n = [], 0
            while q and n < most:
                part = q.pop() if last_first else q.popleft()
                size = len(part) if isinstance(part, np.ndarray) else part[1]
                if isinstance(part, np.ndarray):
                    self.held -= size
                for a in range(0, size, most):
                    if last_first:
                        stop = size - a
                        some.append(self._get(part, max(0, stop - most), min(most, stop))[::-1])
                    else:
                        some.append(self._get(part, a, min(most, size - a)))
                    n += len(some[-1])
                    if n >= most:
                        yield np.concatenate(some)
                        some, n = [], 0
            if some:
                yield np.concatenate(some)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Least:
    """Range minima of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 ** len(self.levels) <= len(x):
            h = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-h], self.levels[-1][h:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of x[a] to x[b], b included; a <= b."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            x = self.levels[level]
            out[at] = np.minimum(x[a[at]], x[b[at] - 2**level + 1])
        return out


class Since:
    """For each symbol, the least common prefix of tuples met since the last one that was preceded by it: one more is the common
    prefix of what the two induce."""

    def __init__(self, kinds: int):
        self.least = np.full(kinds, -1, np.int64)  # -1: none was met, so what is induced is the first of its queue

    def of(self, lcp: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For tuples in order with `lcp`, of which those at `at` induce in the queues `before`: the induced ones' lcp."""
        if not len(at):
            self.least = np.minimum(self.least, lcp.min())
            return np.zeros(0, np.int64)
        least = Least(lcp.astype(np.int64))
        order = np.argsort(before.astype(np.uint16), kind="stable")  # queues of this kind are few
        kind, place = before[order], at[order]
        first = np.append(True, kind[1:] != kind[:-1])
        found = least(np.where(first, 0, np.append(0, place[:-1] + 1)), place)
        found[first] = np.minimum(found[first], self.least[kind[first]])
        last = np.append(first[1:], True)
        self.least = np.minimum(self.least, lcp.min())
        rest = place[last] + 1
        self.least[kind[last]] = np.where(rest < len(lcp), least(np.minimum(rest, len(lcp) - 1), np.full(len(rest), len(lcp) - 1)), FAR)
        out = np.empty(len(at), np.int64)
        out[order] = found + 1
        return out


def _leftmost(t: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """Positions of leftmost smaller suffixes, from the end of t on, a run of symbols at a time, each run ascending."""
    after, smaller, stop = -1, False, len(t)  # the symbol after the run, and whether its suffix is smaller than the next one
    while stop > 0:
        start = max(0, stop - piece)
        x = np.append(t[start:stop].astype(np.int64), after)
        change = np.flatnonzero(x[:-1] != x[1:])
        kind = np.full(len(x), smaller)
        if len(change):
            up = x[change] < x[change + 1]
            kind[: change[-1] + 1] = np.repeat(up, np.diff(np.append(-1, change)))
            if change[-1] + 1 < len(x) - 1:
                kind[change[-1] + 1 : -1] = smaller
        if start > 0:
            before = np.append(int(t[start - 1]), x[:-2])
            yield np.flatnonzero(kind[:-1] & (before > x[:-1])) + start
        else:
            yield np.flatnonzero(kind[1:-1] & (x[:-2] > x[1:-1])) + 1
        after, smaller, stop = int(x[0]), bool(kind[0]), start


class Text:
    """The string, with the windows of symbols before positions that tuples carry."""

    def __init__(self, t: np.ndarray):
        self.t, self.bits = t, 8 if t.dtype == np.uint8 else 32
        self.room, self.mask = 64 // self.bits, np.uint64(2**self.bits - 1)

    def tuples(self, at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), TUPLE)
        out["at"], out["lcp"] = at, lcp
        return self.filled(out, np.arange(len(at)))

    def filled(self, tuples: np.ndarray, which: np.ndarray) -> np.ndarray:
        at, w = tuples["at"][which], np.zeros(len(which), np.uint64)
        for k in range(self.room):
            ok = at > k
            w[ok] |= self.t[at[ok] - 1 - k].astype(np.uint64) << np.uint64(self.bits * k)
        tuples["window"][which], tuples["left"][which] = w, np.minimum(at, self.room)
        return tuples

    def stepped(self, tuples: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """The tuples of the positions before."""
        out = np.empty(len(tuples), TUPLE)
        out["at"], out["lcp"], out["left"] = tuples["at"] - 1, lcp, tuples["left"] - 1
        out["window"] = tuples["window"] >> np.uint64(self.bits)
        empty = np.flatnonzero((out["left"] == 0) & (out["at"] > 0))
        return self.filled(out, empty) if len(empty) else out

    def before(self, tuples: np.ndarray) -> np.ndarray:
        return (tuples["window"] & self.mask).astype(np.int64)

    def same(self, a: int, b: int) -> int:
        """Common prefix of a larger and a smaller suffix with one first symbol: the shorter of their runs of it."""
        n, c = 0, self.t[a]
        while max(a, b) + n < len(self.t) and self.t[a + n] == c and self.t[b + n] == c:
            n += 1
        return n


def _induced(text: Text, kinds: int, seeds: Spool, memory: int, named: bool) -> Iterator[np.ndarray]:
    """All suffixes from the last in order to the first, some at a time; a tuple's lcp is that with the one before it here,
    the larger one. seeds: leftmost smaller suffixes by first symbol; `named` if they are in order with true common
    prefixes, else they count as their first symbols alone, and what is induced as what leads up to the next of them."""
    n = len(text.t)
    heads, larger, since = Spool(kinds, memory), Spool(kinds, memory), Since(kinds)
    last = int(text.t[n - 1])
    heads.add(last, text.tuples(np.array([n - 1]), np.array([0])))
    since.least[last] = FAR
    for c in range(kinds):
        final = -1
        for piece in heads.pieces(c):
            final = int(piece["at"][-1])
            larger.add(c, piece)
            before = text.before(piece)
            go = np.flatnonzero((before >= c) & (piece["at"] > 0))
            heads.put(before[go], text.stepped(piece[go], since.of(piece["lcp"], go, before[go])))
        first = True
        for piece in seeds.pieces(c):
            if first:
                piece["lcp"][0] = 0 if final < 0 else text.same(final, int(piece["at"][0])) if named else 1
                first = False
            before = text.before(piece)
            heads.put(before, text.stepped(piece, since.of(piece["lcp"], np.arange(len(piece)), before)))
    heads.close()
    tails, since = Spool(kinds, memory), Since(kinds)
    for c in range(kinds - 1, -1, -1):
        final = -1
        for piece in tails.pieces(c):
            final = int(piece["at"][-1])
            before = text.before(piece)
            go = np.flatnonzero((before <= c) & (piece["at"] > 0))
            tails.put(before[go], text.stepped(piece[go], since.of(piece["lcp"], go, before[go])))
            yield piece
        carried = None
        for piece in larger.pieces(c, last_first=True):
            piece = piece.copy()
            own = piece["lcp"].copy()
            piece["lcp"][1:] = own[:-1]
            piece["lcp"][0] = carried if carried is not None else 0 if final < 0 else text.same(int(piece["at"][0]), final)
            carried = int(own[-1])
            before = text.before(piece)
            go = np.flatnonzero((before < c) & (piece["at"] > 0))
            tails.put(before[go], text.stepped(piece[go], since.of(piece["lcp"], go, before[go])))
            yield piece
    larger.close()
    tails.close()


class _Heap:
    """One pass over ranges of symbols: what a range's queue holds goes through a heap, by symbol and arrival."""

    def __init__(self, text: Text, ranges: np.ndarray, kinds: int, memory: int, sign: int):
        self.text, self.ranges, self.sign = text, ranges, sign
        self.spool = Spool(int(ranges[-1]) + 1, memory)
        self.last = np.full(kinds, -2, np.int64)
        self.at: list[int] = []  # places of what was popped, with rising common prefixes
        self.lcp: list[int] = []
        self.n = 0

    def load(self, r: int, fixed: list[np.ndarray]) -> None:
        """fixed: pieces that follow what is induced of the same symbol."""
        own = [(p["at"], p["lcp"]) for p in self.spool.pieces(r)]
        self.r, self.seq, heap = r, 0, []
        for kind, pieces in ((0, own), (1, [(p["at"], p["lcp"]) for p in fixed])):
            for at, lcp in pieces:
                for a, x, s in zip(at.tolist(), lcp.tolist(), self.text.t[at].tolist(), strict=True):
                    heap.append((self.sign * s, kind, self.seq, a, x))
                    self.seq += 1
        heapq.heapify(heap)
        self.heap = heap

    def met(self, lcp: int) -> None:
        while self.lcp and self.lcp[-1] >= lcp:
            self.lcp.pop()
            self.at.pop()
        self.at.append(self.n)
        self.lcp.append(lcp)
        self.n += 1

    def induce(self, at: int, before: int) -> None:
        j = int(self.last[before])
        lcp = 0 if j == -2 else 1 + self.lcp[bisect_right(self.at, j)]
        self.last[before] = self.n - 1
        if self.ranges[before] == self.r:
            heapq.heappush(self.heap, (self.sign * before, 0, self.seq, at - 1, lcp))
            self.seq += 1
        else:
            new = np.zeros(1, TUPLE)
            new["at"], new["lcp"] = at - 1, lcp
            self.spool.add(int(self.ranges[before]), new)


def _induced_by_heap(text: Text, kinds: int, seeds: Spool, ranges: np.ndarray, memory: int, named: bool) -> Iterator[np.ndarray]:
    """_induced for large alphabets; seeds are by range."""
    t, n, count = text.t, len(text.t), int(ranges[-1]) + 1
    up, larger = _Heap(text, ranges, kinds, memory, 1), Spool(count, memory)
    first = np.zeros(1, TUPLE)
    first["at"] = n - 1
    up.spool.add(int(ranges[t[n - 1]]), first)
    up.last[t[n - 1]] = -1
    rows = lambda x: np.array(x, dtype=[("at", "<i8"), ("lcp", "<i4")])

    def tuples(found: list) -> np.ndarray:
        out, x = np.zeros(len(found), TUPLE), rows(found)
        out["at"], out["lcp"] = x["at"], x["lcp"]
        return out

    for r in range(count):
        up.load(r, list(seeds.pieces(r)))
        final, done, out = (-1, -1), -1, []
        while up.heap:
            symbol, seed, _, at, lcp = heapq.heappop(up.heap)
            if seed:
                if done != symbol:
                    lcp = 0 if final[0] != symbol else text.same(final[1], at) if named else 1
                    done = symbol
            else:
                final = (symbol, at)
                out.append((at, lcp))
            up.met(lcp)
            if at > 0 and (seed or t[at - 1] >= symbol):
                up.induce(at, int(t[at - 1]))
        if out:
            larger.add(r, tuples(out))
    up.spool.close()
    down = _Heap(text, ranges, kinds, memory, -1)
    for r in range(count - 1, -1, -1):
        down.load(r, list(larger.pieces(r, last_first=True)))
        final, before, out = (-1, -1), (-1, 0), []
        while down.heap:
            symbol, large, _, at, lcp = heapq.heappop(down.heap)
            symbol = -symbol
            if large:
                own = lcp
                lcp = before[1] if before[0] == symbol else text.same(at, final[1]) if final[0] == symbol else 0
                before = (symbol, own)
            else:
                final = (symbol, at)
            out.append((at, lcp))
            down.met(lcp)
            if at > 0 and (t[at - 1] < symbol or not large and t[at - 1] == symbol):
                down.induce(at, int(t[at - 1]))
        if out:
            yield tuples(out)
    larger.close()
    down.spool.close()


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string that fits in memory, by prefix doubling."""
    rank, n, step = names.astype(np.int64), len(names), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (max(n, int(rank.max()) + 1) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each suffix in order and the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    k = 0
    while len(live):
        a, b = order[live] + k, order[live - 1] + k
        inside = np.maximum(a, b) < len(t)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[t[a] == t[b]]
        k += 1
        out[live] = k
    return out


def suffix_order(t: np.ndarray, memory: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes of t in order, a suffix that is another's beginning first, and the length of the common
    beginning of each and the one before it. t: bytes, or whole numbers from 0 on, ideally without gaps.

    memory: tuples that queues hold in memory; names are ordered in memory once there are at most four times as many."""
    t = t if t.dtype == np.uint8 else t.astype(np.int32)
    n = len(t)
    if n < 3:
        order = np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
        return order, common_prefixes(t, order)
    text, kinds = Text(t), int(t.max()) + 1
    piece = max(16, memory)
    lms = np.concatenate([*_leftmost(t, piece)][::-1])
    ranges = None
    if kinds > QUEUES:
        load = np.cumsum(np.bincount(t, minlength=kinds))
        ranges = np.unique((load - 1) // max(1, memory // 4), return_inverse=True)[1]

    def seeded(at: np.ndarray, lcp: np.ndarray) -> Spool:
        out = Spool(kinds if ranges is None else int(ranges[-1]) + 1, memory)
        for i in range(0, len(at), piece):
            kind = t[at[i : i + piece]].astype(np.int64)
            out.put(kind if ranges is None else ranges[kind], text.tuples(at[i : i + piece], lcp[i : i + piece]))
        return out

    def induced(seeds: Spool, named: bool) -> Iterator[np.ndarray]:
        return _induced(text, kinds, seeds, memory, named) if ranges is None else _induced_by_heap(text, kinds, seeds, ranges, memory, named)

    ordered, lcp = lms, np.zeros(len(lms), np.int64)
    if len(lms) > 1:
        ordered, lcp = _ordered_lms(t, lms, induced(seeded(lms, np.ones(len(lms), np.int64)), False), memory)
    order, common = np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    stop = n
    for part in induced(seeded(ordered, lcp), True):
        order[stop - len(part) : stop] = part["at"][::-1]
        common[stop - len(part) + 1 : stop + 1] = part["lcp"][::-1]
        stop -= len(part)
    return order, common[:n]


def _ordered_lms(t: np.ndarray, lms: np.ndarray, found: Iterator[np.ndarray], memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost smaller suffixes in order and their common prefixes, given an induction that ordered the substrings from
    each to the next."""
    ordered, between, least = [], [], FAR
    leftmost = np.zeros(len(t), bool)
    leftmost[lms] = True
    for part in found:
        at = part["at"]
        hit = np.flatnonzero(leftmost[at])
        if not len(hit):
            least = min(least, int(part["lcp"].min()))
            continue
        low = np.minimum.reduceat(part["lcp"][: hit[-1] + 1], np.concatenate([[0], hit[:-1] + 1]))
        low[0] = min(low[0], least)
        ordered.append(at[hit])
        between.append(low)
        least = int(part["lcp"][hit[-1] + 1 :].min(initial=FAR))
    # From the last in order to the first; shared: the common prefix with the one before in ascending order.
    down, shared = np.concatenate(ordered), np.concatenate(between).astype(np.int64)
    up, shared = down[::-1], np.append(0, shared[::-1][:-1])
    index = np.searchsorted(lms, up)
    size = np.append(np.diff(lms) + 1, FAR)[index]  # the last one is like no other
    same = np.append(False, (size[1:] == size[:-1]) & (shared[1:] >= size[1:]) & (size[1:] < FAR))
    rank = np.cumsum(~same) - 1
    names = np.empty(len(lms), np.int64)
    names[index] = rank
    apart = shared[~same]  # of each name and the one before it
    if rank[-1] == len(lms) - 1:
        order, lcp = index, np.zeros(len(lms), np.int64)
    elif len(names) <= 4 * memory:
        order = _doubled(names)
        lcp = common_prefixes(names, order)
    else:
        order, lcp = suffix_order(names, memory)
    a, b = order[:-1] + lcp[1:], order[1:] + lcp[1:]
    x, y = np.minimum(names[a], names[b]), np.maximum(names[a], names[b])
    more = Least(apart)(x + 1, y) if len(a) else np.zeros(0, np.int64)
    # Where one substring ends inside the other, what goes on is a run of one symbol, smaller and larger: the shorter run counts.
    size = np.append(np.diff(lms) + 1, len(t) - lms[-1])
    ends = np.flatnonzero(more == np.minimum(size[a], size[b]))
    p, q = lms[a[ends]] + more[ends] - 1, lms[b[ends]] + more[ends] - 1
    symbol, live, k = t[p], np.arange(len(ends)), 0
    while len(live):
        k += 1
        live = live[np.maximum(p[live], q[live]) + k < len(t)]
        live = live[(t[p[live] + k] == symbol[live]) & (t[q[live] + k] == symbol[live])]
        more[ends[live]] += 1
    return lms[order], np.append(0, lms[a] - lms[order[:-1]] + more)

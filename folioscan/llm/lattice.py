"""Byte-pair encodings as shortest paths in a piece lattice, over many words at once.

A merge-based encoding of a string is the only path through the lattice of its
pieces on which every two neighbours are *compatible*, that is, on which encoding
the two pieces' joined text gives the same two pieces.  So the encoder is a finite
automaton whose state is the last piece: an arc costs nothing where it is compatible
and infinity where it is not, and for each prefix of the input one state has a
finite distance.  Dynamic programming over prefixes finds it, and stores for every
prefix the last piece and the number of pieces.

Compatibility needs no encoding.  Undoing merges from the latest backwards on the
right edge of the left piece and the left edge of the right piece, the two edge
symbols of each moment must not have a merge that would have come first (on equal
ranks the leftmost merge comes first).

The work is vectorised over words: substrings are looked up by polynomial hashes,
and all words advance one position at a time.
"""

from __future__ import annotations

import heapq

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LONG = 48
_FOREVER = np.int64(1 << 40)


class HashTable:
    """An immutable map from unsigned longs to ints with vectorised look-up; -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        todo = np.arange(len(keys))
        slot = self._slots(keys)
        while len(todo):
            free = self.values[slot] < 0
            # of several keys that want a free slot, one gets it
            got, which = np.unique(slot[free], return_index=True)
            won = todo[free][which]
            self.keys[got], self.values[got] = keys[won], values[won]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[which]] = False
            todo, slot = todo[left], (slot[left] + np.uint64(1)) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        out = self.values[slot]
        odd = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(odd):
            slot[odd] = (slot[odd] + np.uint64(1)) & self.mask
            out[odd] = self.values[slot[odd]]
            odd = odd[(out[odd] >= 0) & (self.keys[slot[odd]] != keys[odd])]
        return out


class Lattice:
    """The automaton of one vocabulary.

    ``pieces``: a tuple of symbols (small ints) for each id, empty where the id is no
    piece.  ``merges``: ``(left id, right id) -> (rank, id)``.  Symbols that are no
    piece are arcs of their own, with id ``unknown`` = ``len(pieces)``.
    """

    def __init__(self, pieces: list[tuple[int, ...]], merges: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.unknown = len(pieces)
        self.merges = merges
        self.by_symbols = {p: i for i, p in enumerate(pieces) if p}
        self.left = np.full(len(pieces) + 1, -1, np.int64)
        self.right = np.full(len(pieces) + 1, -1, np.int64)
        self.time = np.full(len(pieces) + 1, -1, np.int64)
        usable = np.zeros(len(pieces) + 1, bool)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                usable[i] = True
            elif p:
                usable[i], split, when = self._derive(p, i)
                if usable[i]:
                    (self.left[i], self.right[i]), self.time[i] = split, when
        self.by_symbols = {p: i for p, i in self.by_symbols.items() if usable[i]}
        self.longest = max(map(len, self.by_symbols), default=1)
        self.power = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        ids = np.fromiter(self.by_symbols.values(), np.int64, len(self.by_symbols))
        hashes = np.array([self._hash(p) for p in self.by_symbols], np.uint64)
        self.vocabulary = HashTable(hashes, ids)
        pairs = np.array([(a << 32) | b for a, b in merges], np.uint64)
        self.joined = HashTable(pairs, np.array([r for r, _ in merges.values()], np.int64))
        self._fits: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _hash(symbols: tuple[int, ...]) -> int:
        h = 0
        for s in symbols:
            h = (h * int(_BASE) + s + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _derive(self, symbols: tuple[int, ...], want: int) -> tuple[bool, tuple[int, int], int]:
        """Whether merging the symbols gives ``want``; the last merge and the latest rank."""
        row = [self.by_symbols.get((s,), self.unknown) for s in symbols]
        split, when = (-1, -1), -1
        while len(row) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(row, row[1:])) if p in self.merges), default=None)
            if best is None:
                return False, split, when
            rank, k = best
            split, when = (row[k], row[k + 1]), max(when, rank)
            row[k : k + 2] = [self.merges[split][1]]
        return row[0] == want, split, when

    def merge(self, symbols: tuple[int, ...]) -> list[int]:
        """The encoding by definition, with a heap of merges; for tests and comparisons."""
        row: list[int | None] = [self.by_symbols.get((s,), self.unknown) for s in symbols]
        nxt, prv = list(range(1, len(row) + 1)), list(range(-1, len(row) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and nxt[k] < len(row) and (m := self.merges.get((row[k], row[nxt[k]]))):
                heapq.heappush(heap, (m[0], k, row[k], row[nxt[k]]))

        for k in range(len(row) - 1):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if row[k] != a or nxt[k] >= len(row) or row[nxt[k]] != b:
                continue
            j = nxt[k]
            row[k], row[j], nxt[k] = self.merges[a, b][1], None, nxt[j]
            if nxt[k] < len(row):
                prv[nxt[k]] = k
            offer(prv[k])
            offer(k)
        return [x for x in row if x is not None]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``b`` may follow piece ``a``, elementwise."""
        ok = np.zeros(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), _FOREVER)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            rank = self.joined.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            stays = (rank < 0) | (rank >= limit)
            ta, tb = self.time[a], self.time[b]
            done = stays & (ta < 0) & (tb < 0)
            ok[at[done]] = True
            on = stays & ~done
            at, a, b, ta, tb = at[on], a[on], b[on], ta[on], tb[on]
            undo = ta > tb
            limit = np.where(undo, ta, tb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def _fit(self, a: int, b: int) -> bool:
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) > 1 << 18:
                self._fits.clear()
            known = self._fits[a, b] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return known

    def solve(self, symbols: np.ndarray, lengths: np.ndarray, closing: int | None = None):
        """Last piece and number of pieces of every prefix of every word.

        ``symbols``: the words' symbols end to end.  Returns two arrays aligned with
        them.  With ``closing``, a word's last symbol is its plain symbol plus
        ``closing`` (an end-of-word mark); a third array then has the number of
        pieces of each prefix taken as a whole word.
        """
        last = np.full(len(symbols), -1, np.int64)
        count = np.zeros(len(symbols), np.int64)
        closed = np.zeros(len(symbols) if closing is not None else 0, np.int64)
        starts = np.cumsum(lengths) - lengths
        short = np.flatnonzero((lengths <= _LONG) & (lengths > 0))
        short = short[np.argsort(-lengths[short], kind="stable")]
        for lo in range(0, len(short), 1 << 15):
            self._solve_short(symbols, starts, lengths, short[lo : lo + (1 << 15)], last, count, closed, closing)
        for w in np.flatnonzero(lengths > _LONG):
            self._solve_long(symbols, int(starts[w]), int(lengths[w]), last, count, closed, closing)
        return (last, count, closed) if closing is not None else (last, count)

    def _solve_short(self, symbols, starts, lengths, words, last, count, closed, closing) -> None:
        n, size = len(words), lengths[words]
        most = int(size[0])
        where = starts[words][:, None] + np.minimum(np.arange(most), size[:, None] - 1)
        grid = symbols[where].astype(np.uint64) + np.uint64(1)
        h = np.zeros((n, most + 1), np.uint64)
        for i in range(most):
            h[:, i + 1] = h[:, i] * _BASE + grid[:, i]
        state = np.full((n, most + 1), -1, np.int64)
        steps = np.zeros((n, most + 1), np.int64)
        whole = np.zeros((n, most + 1), np.int64)
        for i in range(1, most + 1):
            rows = np.arange(int(np.searchsorted(-size, -i, "right")))
            self._arcs(h, state, steps, rows, i, h[rows, i])
            if closing is not None:
                # the words that end here are closed already
                whole[rows, i] = steps[rows, i]
                on = rows[size[rows] > i]
                kept = state[on, i].copy(), steps[on, i].copy()
                self._arcs(h, state, steps, on, i, h[on, i] + np.uint64(closing))
                whole[on, i] = steps[on, i]
                state[on, i], steps[on, i] = kept
        inside = np.arange(most) < size[:, None]
        last[where[inside]] = state[:, 1:][inside]
        count[where[inside]] = steps[:, 1:][inside]
        if closing is not None:
            closed[where[inside]] = whole[:, 1:][inside]

    def _arcs(self, h, state, steps, rows, i, upto) -> None:
        """Find the one arc into position ``i`` that is compatible, for the given rows."""
        for size in range(min(i, self.longest), 0, -1):
            if not len(rows):
                return
            piece = self.vocabulary.get(upto - h[rows, i - size] * self.power[size])
            if size == 1:
                piece[piece < 0] = self.unknown
            cand = np.flatnonzero(piece >= 0)
            if size < i and len(cand):
                cand = cand[self.compatible(state[rows[cand], i - size], piece[cand])]
            got = rows[cand]
            state[got, i] = piece[cand]
            steps[got, i] = steps[got, i - size] + 1
            left = np.ones(len(rows), bool)
            left[cand] = False
            rows, upto = rows[left], upto[left]

    def _solve_long(self, symbols, start, length, last, count, closed, closing) -> None:
        row = tuple(symbols[start : start + length].tolist())
        pieces = self.by_symbols

        def arc(i: int, tail: tuple[int, ...]) -> tuple[int, int]:
            for size in range(min(i, self.longest), 0, -1):
                piece = pieces.get(row[i - size : i - 1] + tail, self.unknown if size == 1 else None)
                if piece is not None and (size == i or self._fit(int(last[start + i - size - 1]), piece)):
                    return piece, (int(count[start + i - size - 1]) if size < i else 0) + 1
            raise AssertionError("a position no piece leads to")

        for i in range(1, length + 1):
            if closing is not None and i < length:
                closed[start + i - 1] = arc(i, (row[i - 1] + closing,))[1]
            last[start + i - 1], count[start + i - 1] = arc(i, row[i - 1 : i])
        if closing is not None:
            closed[start + length - 1] = count[start + length - 1]

    def paths(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of every word, end to end, and their number for each word."""
        last, count = self.solve(symbols, lengths)
        ends = np.cumsum(lengths)
        n = np.where(lengths > 0, count[np.maximum(ends - 1, 0)] if len(count) else 0, 0)
        out = np.zeros(int(n.sum()), np.int64)
        at, put = ends - 1, np.cumsum(n) - 1
        live = np.flatnonzero(lengths > 0)
        first = ends - lengths
        while len(live):
            piece = last[at[live]]
            out[put[live]] = piece
            at[live] -= self.width[piece]
            put[live] -= 1
            live = live[at[live] >= first[live]]
        return out, n

    @property
    def width(self) -> np.ndarray:
        """Symbols of each piece; one for an unknown symbol."""
        if not hasattr(self, "_width"):
            self._width = np.ones(self.unknown + 1, np.int64)
            for p, i in self.by_symbols.items():
                self._width[i] = len(p)
        return self._width

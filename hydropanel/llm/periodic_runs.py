"""Periodic runs of words, found online by catchers over dyadic blocks.

Words are appended to a growing sequence. As soon as a block of 2^k words starting at a multiple of 2^k is complete, it is a catcher: it waits for
itself to come again 2^(k+1) - 1 to 2^(k+2) - 2 words later. Any square (two equal neighbouring stretches) of a period in that range has such a block in its first half, whose copy
in the second half the catcher meets; so the levels together miss no period. Every appended word ends one window per level, which is compared with the
at most two blocks that wait for it, by a rolling hash. A hit at distance q is compared on: backwards by binary search over the hashes, and
forwards as words are appended, for as long as words q apart agree. A stretch of q agreeing words is a square, squares that follow one another merge
into one run, and what still agrees at the end of the sequence stays open for the next words. Appending words one by one or in pieces of any size gives the same
runs; pieces only let numpy take a step for many words at once.

Hits inside a known run of a period no longer than the block are skipped: there the distance is a multiple of that period (periodicity
lemma). A run with the extent of one of a smaller period is that one. Hashes never decide alone: a stretch is compared word for
word before it counts, and a false hit is cut into its true stretches.

A run is a stretch with smallest period q, of at least ``least`` words and ``exponent`` times q, that no neighbouring word extends.

Null and empty texts have no runs and an empty collapsed text. Repeated rows are treated alike, a null key is kept, an empty table gives an empty
one. Runs have no ties: they are ordered by start, then period. Only the key and the text are read, so other columns cannot clash. A
text is held whole, with about 60 bytes per word.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from hydropanel.llm.common import mix, pieces, raw_texts, rowwise, start

EXPONENT = 4
LEAST = 6
PIECE = 1 << 16  # words appended at once
_P = np.uint64((1 << 31) - 1)
_BASE, _INVERSE = 1_186_418_593, pow(1_186_418_593, -1, (1 << 31) - 1)


class _Powers:
    """Powers of the hash's base and of its inverse, as far as any sequence has needed them."""

    def __init__(self) -> None:
        self.base, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.base) < n:
            m = len(self.base)
            self.base = np.concatenate([self.base, self.base * np.uint64(pow(_BASE, m, int(_P))) % _P])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(pow(_INVERSE, m, int(_P))) % _P])
        return self.base, self.inverse


_powers = _Powers()


class Catchers:
    """Runs of a sequence of word numbers that grows by :meth:`append`; ``longest`` bounds the periods looked for."""

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest
        self.n = 0
        self.word, self.sums = np.zeros(64, np.int64), np.zeros(65, np.uint64)
        self.open: dict[tuple[int, int], None] = {}  # (period, first agreeing position) of what agrees up to the end
        self.extents: set[tuple[int, int]] = set()
        self.closed: list[tuple[int, int, int]] = []

    def _store(self, words: np.ndarray) -> None:
        a, b = self.n, self.n + len(words)
        if b > len(self.word):
            size = max(b, 2 * len(self.word))
            self.word = np.concatenate([self.word[:a], np.zeros(size - a, np.int64)])
            self.sums = np.concatenate([self.sums[: a + 1], np.zeros(size - a, np.uint64)])
        base, self.inverse = _powers.upto(b + 1)
        self.word[a:b] = words
        value = mix(words.astype(np.uint64) + np.uint64(1)) % _P
        self.sums[a + 1 : b + 1] = (np.cumsum(value * base[a:b] % _P) + self.sums[a]) % _P
        self.n = b

    def _hash(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] + _P - self.sums[at]) % _P * self.inverse[at] % _P

    def _agree(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from positions x and y on, or before them; never too few."""
        low, high = np.zeros(len(x), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = self._hash(x - mid, mid) == self._hash(y - mid, mid) if back else self._hash(x, mid) == self._hash(y, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def _true(self, q: int, low: int, high: int) -> list[tuple[int, int]]:
        """Stretches of [low, high) whose words equal those q before."""
        same = self.word[low:high] == self.word[low - q : high - q]
        if same.all():
            return [(low, high)]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        return [(low + int(i), low + int(j)) for i, j in edge.reshape(-1, 2)]

    def append(self, words: np.ndarray) -> None:
        """Add words and advance every comparison to the new end."""
        if not len(words):
            return
        a = self.n
        self._store(np.asarray(words, np.int64))
        b = self.n
        found: dict[tuple[int, int], int] = {}  # (period, first agreeing position): end
        if self.open:
            period = np.array([q for q, _ in self.open], np.int64)
            here = np.full(len(period), a)
            ahead = self._agree(here, here - period, np.full(len(period), b - a), back=False)
            for (q, low), more in zip(self.open, ahead.tolist(), strict=True):
                same = self.word[a : a + more] == self.word[a - q : a + more - q]
                found[q, low] = a + (more if same.all() else int(same.argmin()))
        since = None
        waiting = sorted(found)  # stretches that may cover hits of higher levels
        size = 1
        while 3 * size - 1 <= b and (self.longest is None or 2 * size - 1 <= self.longest):
            at, period = self._hits(size, a, b)
            if len(at) and waiting:
                while waiting and waiting[0][0] <= size:
                    q, low = waiting.pop(0)
                    if found[q, low] - low >= q:
                        since = np.arange(a, b) if since is None else since
                        part = since[max(low - q - a, 0) : found[q, low] - a]
                        np.minimum(part, low - q, out=part)
                if since is not None:
                    new = since[at + size - 1 - a] > at - period
                    at, period = at[new], period[new]
            if len(at):
                for q, low, high in self._stretches(size, at, period, a, b):
                    for i, j in self._true(q, low, high) if (q, low) not in found else ():
                        if j - i >= q or j == b:
                            if (q, i) not in found:
                                waiting.append((q, i))
                            found[q, i] = j
                waiting.sort()
            size *= 2
        self.open = {k: None for k in sorted(found) if found[k] == b}
        self._close(sorted((q, low, high) for (q, low), high in found.items() if high < b))

    def _stretches(self, size: int, at: np.ndarray, period: np.ndarray, a: int, b: int) -> list[tuple[int, int, int]]:
        """(distance, start, end) of what agrees around these hits, where it makes a square or reaches the end."""
        # Hits of one distance come every ``size`` words; a chain of them is one stretch.
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        new = np.ones(len(at), bool)
        new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + size)
        low, q = at[new], period[new]
        high = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + size
        if size > 1 or a:
            # A square needs a word more than the block on either side.
            word = self.word
            before, after = low - 1, np.minimum(high, b - 1)
            more = (high == b) | (high - low >= q) | (word[before] == word[before - q]) & (low > q) | (word[after] == word[after - q])
            low, high, q = low[more], high[more], q[more]
            if not len(low):
                return []
            high = high + self._agree(high, high - q, b - high, back=False)
            low = low - self._agree(low, low - q, low - q, back=True)
        keep = (high - low >= q) | (high == b)
        return sorted(set(zip(q[keep].tolist(), low[keep].tolist(), high[keep].tolist(), strict=True)))

    def _hits(self, size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of ``size`` words, ending among the words from a to b, that equal a waiting block, and their distances."""
        near = 2 * size - 1
        low, high = max(a - size + 1, near), b - size + 1
        if low >= high:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums, inverse = self.sums, self.inverse
        window = (sums[low + size : high + size] + _P - sums[low:high]) % _P * inverse[low:high] % _P
        first = (low - near) // size  # of the nearer of the two blocks that wait for a window
        number = np.arange(max(first - 1, 0), (high - 1 - near) // size + 1) * size
        block = np.repeat(self._hash(number, size), size)
        skip = (low - near) - first * size
        # The nearer block of window t is (t - near) // size; before it stands the farther one.
        begin = skip if first == 0 else skip + size
        one = np.flatnonzero(window == block[begin : begin + len(window)])
        shift = size - skip if first == 0 else 0  # the first windows have no farther block
        begin = skip + shift if first else 0
        two = np.flatnonzero(window[shift:] == block[begin : begin + len(window) - shift]) + shift if shift < len(window) else one[:0]
        t1, t2 = one + low, two + low
        at = np.concatenate([t1, t2])
        return at, np.concatenate([near + (t1 - near) % size, near + (t2 - near) % size + size])

    def _close(self, ended: list[tuple[int, int, int]]) -> None:
        for q, low, high in ended:
            if high - low >= q and (low - q, high) not in self.extents:
                self.extents.add((low - q, high))
                self.closed.append((low - q, high - low + q, q))

    def runs(self, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the words so far, by start, then period. Ends the sequence."""
        self._close([(q, low, self.n) for q, low in self.open])
        self.open = {}
        return sorted((r for r in self.closed if r[1] >= max(least, exponent * r[2])), key=lambda r: (r[0], r[2]))


def runs_of(words: list[bytes], exponent: int = EXPONENT, least: int = LEAST, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words."""
    n = len(words)
    if n < least:
        return []
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    catchers = Catchers(n // exponent)
    for at in range(0, n, piece):
        some = words[at : at + piece]
        catchers.append(np.fromiter(map(numbers.__getitem__, some), np.int64, len(some)))
    return catchers.runs(exponent, least)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single spaces, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for begin, length, period in runs:
        keep[begin + period : begin + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """key, ``runs`` (array of start, length, period in words) and ``collapsed`` (the text without the repetitions) of every row."""
    start(docs.sparkSession)

    def run(batch) -> dict:
        raw = raw_texts(batch, text)
        found, short = [], []
        for lo, hi in pieces([len(t) for t in raw]):
            for t in raw[lo:hi]:
                words = t.split()  # ASCII white space
                runs = runs_of(words, exponent, least)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                short.append(collapsed(words, runs).decode())
        return {"runs": found, "collapsed": short}

    return rowwise(docs, [key, text], run, "runs array<struct<start:long,length:long,period:long>>, collapsed string", keep=[key])

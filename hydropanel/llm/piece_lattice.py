"""Sampled segmentations over the lattice of a SentencePiece vocabulary, and lossless decoding.

A text is a lattice: nodes are positions between characters, edges the pieces of the vocabulary that lie there. Forward
filtering gives each node the total weight of all ways to reach it; backward sampling then walks from the end and takes each edge with
its share of that weight. So whole segmentations are drawn from the distribution over all of them, each with probability proportional
to the product of its pieces' probabilities raised to ``alpha``.

The vocabulary's scores are ranks, not probabilities. A piece of rank r is given the probability 1/((r+2) ln R), R the last rank, as word
frequencies fall with rank; single bytes, which spell what no piece covers, and pieces without a rank (the space alone) have the
weight of the last rank.

A piece has the mark of a space only at its start and none spans a line break, so the lattice of a text falls apart at spaces and line
breaks. The weights of a part are computed once per distinct part of a batch, and the walks of all parts of all rows of a batch
are stepped together.

Random numbers are a hash of seed, row key and step, so a row's segmentation depends on nothing but its key, its text and the seed: not on
partitioning, order, or a task that is run again.

Decoding joins the pieces, turns marks into spaces and bytes into characters, and takes off the space put before the text. A
literal mark in a text is spelled in bytes, so decoding always gives the text back, to the byte.

Null and empty texts have no pieces. Rows with equal keys and texts get equal segmentations; a null key is a key of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from hydropanel.llm.common import mix, rowwise, start, texts

SPACE = "▁"
# Stands for a literal mark of the text. Lone surrogates do not occur in text.
_LITERAL = "\ud800"
_GROUP = 150_000  # nodes whose edges are laid out at once
_CHUNK = 4_000_000  # characters sampled at once


def split(text: str) -> list[str]:
    """Parts that no piece spans. A space is the start of the part it precedes, a line break a part of its own."""
    if not text:
        return []
    marked = SPACE + text.replace(SPACE, _LITERAL).replace(" ", "\udfff" + SPACE).replace("\n", "\udfff\n\udfff")
    return [p for p in marked.split("\udfff") if p]


class Lattice:
    """Piece vocabulary as a tree of characters, and the lattices of many parts at a time."""

    def __init__(self, pieces: list[tuple[str, float, bool]], alpha: float) -> None:
        """``pieces``: piece, score, whether it is a single byte, by id. Control pieces are empty strings."""
        usable = [(i, p) for i, (p, _, b) in enumerate(pieces) if p and not b and SPACE not in p[1:] and "\n" not in p]
        last = max((-s for _, s, _ in pieces if s > -1e8), default=0)
        share = np.log(last + 2)  # so that the probabilities sum to about 1
        self.plain, self.is_byte = [p for p, _, _ in pieces], [b for _, _, b in pieces]
        self.spelled = np.array([bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode() for p, _, b in pieces], dtype=object)
        self.bytes = [-1] * 256
        weight = []
        for i, (piece, score, is_byte) in enumerate(pieces):
            weight.append(((2 + (last if is_byte else min(-score, last))) * share) ** -alpha)
            if is_byte:
                self.bytes[int(piece[3:5], 16)] = i
        self.longest = max((len(p) for _, p in usable), default=1)
        letters = sorted({c for _, p in usable for c in p})
        self.letter = np.zeros(0x110000, np.int64)
        for k, c in enumerate(letters):
            self.letter[ord(c)] = k + 1
        self.width = len(letters) + 1
        nodes: dict[str, int] = {"": 0}
        for _, p in usable:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.piece_of = np.full(len(nodes), -1, np.int32)
        for i, p in usable:
            self.piece_of[nodes[p]] = i
        moves = [(nodes[x[:-1]] * self.width + int(self.letter[ord(x[-1])]), n) for x, n in nodes.items() if x]
        self._hash(np.array([m for m, _ in moves], np.int64), np.array([n for _, n in moves], np.int32))
        # Per character about the inverse of a piece's weight, which keeps sums of products near 1; it cancels out.
        self.scale = 100.0**alpha
        self.weight = np.array([*weight, 0.0])
        self.base = len(pieces)
        self.odd: dict[int, int] = {}  # characters without a piece, numbered after the pieces
        self.spelling: list[list[int]] = []

    def _hash(self, key: np.ndarray, value: np.ndarray) -> None:
        """Open addressing, filled round by round."""
        self.bits = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(key), 1) * 3)))))
        self.slot_key = np.full(1 << (64 - int(self.bits)), -1, np.int64)
        self.slot_value = np.full(len(self.slot_key), -1, np.int32)
        at = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            place, first = np.unique(at[free], return_index=True)
            self.slot_key[place], self.slot_value[place] = key[free[first]], value[free[first]]
            left = left[self.slot_key[at[left]] != key[left]]
            at[left] = (at[left] + 1) % len(self.slot_key)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def _move(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next node of the tree, or -1."""
        key = state * self.width + letter
        at = self._slot(key)
        there = self.slot_key[at]
        out = np.where(there == key, self.slot_value[at], -1)
        going = np.flatnonzero((there != key) & (there >= 0))
        while len(going):
            at[going] = (at[going] + 1) % len(self.slot_key)
            there = self.slot_key[at[going]]
            same = there == key[going]
            out[going[same]] = self.slot_value[at[going[same]]]
            going = going[~same & (there >= 0)]
        return out

    def _odd(self, code: int) -> int:
        """Number of a character that no piece is: its bytes, as one edge."""
        if code not in self.odd:
            raw = (SPACE if chr(code) == _LITERAL else chr(code)).encode("utf-8", "surrogatepass")
            ids = [self.bytes[b] for b in raw]
            self.odd[code] = len(self.weight) - 1
            self.spelling.append(ids)
            self.weight = np.concatenate([self.weight[:-1], [float(np.prod(self.weight[ids])), 0.0]])
        return self.odd[code]

    def filtered(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filtering of all parts. Nodes are numbered part by part; of the edges into node k, those at
        first[k] to first[k + 1], ``below`` has the cumulative shares, ``back`` their start nodes, ``piece`` their pieces. Last: the
        end node of each part."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        bounds = np.searchsorted(np.cumsum(size + 1), np.arange(_GROUP, int((size + 1).sum()) + _GROUP, _GROUP), side="left") + 1
        bounds = np.unique(np.minimum(np.concatenate([[0], bounds]), len(parts)))
        out = [[], [], [], []]
        done = 0
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for x, y in zip(out, self._group(parts[lo:hi], size[lo:hi], done), strict=True):
                x.append(y)
            done += int((size[lo:hi] + 1).sum())
        edges, below, back, piece = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return np.concatenate([[0], np.cumsum(edges)]), below, back, piece, np.cumsum(size + 1) - 1

    def _group(self, parts: list[str], size: np.ndarray, offset: int) -> tuple[np.ndarray, ...]:
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        part = np.repeat(np.arange(len(parts)), size)
        start = np.cumsum(size) - size
        room = np.repeat(start + size, size) - np.arange(n)
        node = np.arange(n) + part
        letter = self.letter[code]
        into = np.full((n + len(parts), self.longest), -1, np.int32)
        at, state = np.arange(n), np.zeros(n, np.int64)
        for k in range(self.longest):
            inside = room[at] > k
            at, state = at[inside], state[inside]
            state = self._move(state, letter[at + k]).astype(np.int64)
            known = state >= 0
            at, state = at[known], state[known]
            if not len(at):
                break
            into[node[at] + k + 1, k] = self.piece_of[state]
        bare = np.flatnonzero(into[node + 1, 0] < 0)
        if len(bare):
            kinds, where = np.unique(code[bare], return_inverse=True)
            into[node[bare] + 1, 0] = np.array([self._odd(int(c)) for c in kinds], np.int32)[where]
        end, k = np.nonzero(into >= 0)
        k += 1
        piece = into[end, k - 1]
        weight = self.weight[piece] * (self.scale ** np.arange(self.longest + 1))[k]
        n_nodes = n + len(parts)
        first = start + np.arange(len(parts))
        depth = (np.arange(n_nodes) - np.repeat(first, size + 1))[end]
        if size.max(initial=0) < 1 << 15:
            depth = depth.astype(np.int16)
        order = np.argsort(depth, kind="stable")
        stops = np.cumsum(np.bincount(depth)).tolist()
        total, share = np.zeros(n_nodes), np.empty(len(end))
        total[first] = 1.0
        by_depth, origin, weight = end[order], (end - k)[order], weight[order]
        lo = 0
        for hi in stops:
            if hi > lo:
                here = by_depth[lo:hi]
                flow = weight[lo:hi] * total[origin[lo:hi]]
                begin = np.concatenate([[0], np.flatnonzero(here[1:] != here[:-1]) + 1])
                sums = np.add.reduceat(flow, begin)
                share[lo:hi] = flow / np.repeat(sums, np.diff(np.concatenate([begin, [hi - lo]])))
                node_ = here[begin]
                total[node_] = sums
                wild = (sums < 1e-60) | (sums > 1e60)
                if wild.any():  # long parts: only ratios among the last nodes matter
                    for at_node, by in zip(node_[wild].tolist(), sums[wild].tolist(), strict=True):
                        total[max(int(first[np.searchsorted(first, at_node, side="right") - 1]), at_node - self.longest) : at_node + 1] /= by
            lo = hi
        shares = np.empty(len(end))
        shares[order] = share
        edges = np.bincount(end, minlength=n_nodes)
        run = np.cumsum(shares)
        stop = np.cumsum(edges)
        below = run - np.concatenate([[0.0], run])[(stop - edges)[end]]
        below[stop[edges > 0] - 1] = 1.0
        return edges, below, end - k + offset, piece

    def sample(self, rows: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows, one after the other, and their number per row."""
        split_rows = [split(t) for t in rows]
        size = np.array([len(p) for p in split_rows], np.int64)
        flat = [p for parts in split_rows for p in parts]
        row = np.repeat(np.arange(len(rows)), size)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        state = mix(keys[row] ^ mix(within.astype(np.uint64)))
        length = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
        cuts = np.searchsorted(length, np.arange(_CHUNK, (int(length[-1]) if len(flat) else 0) + _CHUNK, _CHUNK), side="left") + 1
        cuts = np.unique(np.minimum(np.concatenate([[0], cuts]), len(flat))).tolist()
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            i, c = self._walk(flat[lo:hi], state[lo:hi])
            ids.append(i)
            counts.append(c)
        out = np.concatenate(ids)
        per_row = np.bincount(row, weights=np.concatenate(counts), minlength=len(rows)).astype(np.int64)
        return self._spell(out, per_row) if (out >= self.base).any() else (out, per_row)

    def _walk(self, flat: list[str], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of all parts side by side."""
        number = {p: k for k, p in enumerate(dict.fromkeys(flat))}
        first, below, back, piece, ends = self.filtered(list(number))
        n = len(flat)
        node = ends[np.fromiter(map(number.__getitem__, flat), np.int64, n)]
        walk = np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(n, np.int64)
        while len(walk):
            u = (mix(state[walk] + np.uint64(len(steps))) >> np.uint64(11)).astype(float) * 2.0**-53
            edge = first[node]
            again = np.flatnonzero(below[edge] <= u)
            while len(again):
                edge[again] += 1
                again = again[below[edge[again]] <= u[again]]
            steps.append((walk, piece[edge]))
            count[walk] += 1
            node = back[edge]
            going = first[node + 1] > first[node]  # the first node of a part has no edges
            walk, node = walk[going], node[going]
        # walks run backwards: the last step of a part is its first piece
        stop = np.cumsum(count) - 1
        out = np.zeros(int(count.sum()), np.int32)
        for k, (w, p) in enumerate(steps):
            out[stop[w] - k] = p
        return out, count

    def _spell(self, out: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become their bytes."""
        size = np.ones(len(out), np.int64)
        at = np.flatnonzero(out >= self.base)
        ids = [self.spelling[c - self.base] for c in out[at]]
        size[at] = [len(i) for i in ids]
        begin = np.cumsum(size) - size
        longer = np.zeros(int(size.sum()), np.int32)
        longer[begin] = out
        for a, i in zip(at, ids, strict=True):
            longer[begin[a] : begin[a] + len(i)] = i
        row = np.repeat(np.arange(len(per_row)), per_row)
        return longer, np.bincount(row, weights=size, minlength=len(per_row)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        return b"".join(self.spelled[ids].tolist()).decode()[1:] if len(ids) else ""


_loaded: dict[tuple, Lattice] = {}


def load(model: str, alpha: float = 1.0) -> Lattice:
    """The vocabulary of a SentencePiece model file; once per Python worker."""
    if (model, alpha) not in _loaded:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        skip = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        _loaded[model, alpha] = Lattice([("" if skip(i) else m.id_to_piece(i), m.get_score(i), m.is_byte(i)) for i in range(m.vocab_size())], alpha)
    return _loaded[model, alpha]


def row_keys(batch: pa.RecordBatch, column: str, seed: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column)).to_pylist()
    return np.array([xxhash.xxh64_intdigest(b"" if v is None else b"=" + str(v).encode(), seed) for v in values], dtype=np.uint64)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default the key), ids (sampled pieces) and lossless (whether they decode to the whole text)."""
    start(docs.sparkSession)

    def run(batch) -> dict:
        lattice = load(model, alpha)
        rows = texts(batch, text)
        flat, size = lattice.sample(rows, row_keys(batch, key, seed))
        offsets = np.concatenate([[0], np.cumsum(size)])
        piece = lattice.spelled
        spelled = piece[flat].tolist()
        same = [b"".join(spelled[a:b])[1:] == t.encode() for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows, strict=True)]
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        return {"ids": ids, "lossless": same}

    return rowwise(docs, [key, text], run, "ids array<int>, lossless boolean", keep=keep or [key])


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of encoded rows; null ids are an empty text."""
    start(encoded.sparkSession)

    def run(batch) -> dict:
        lattice = load(model)
        return {"text": [lattice.decode(i or []) for i in batch.column(batch.schema.get_field_index(ids)).to_pylist()]}

    return rowwise(encoded, [key, ids], run, "text string", keep=[key])

"""Token counts of whole texts under a SentencePiece model, as lengths only.

Texts are taken in batches of about equal bytes, whatever the number of rows. A text is cut at safe boundaries: between two
characters that stand side by side in no piece of the vocabulary. Merges never cross such a place, so the tokens of the parts are
those of the whole. In this kind of vocabulary a space begins pieces and never follows another character in one, so a unit is a word
with the spaces before it. The distinct units of a batch that the worker does not remember are encoded together, again in calls of
about equal bytes, and only their lengths are kept; a text's count is the sum over its units. The memory of units is bounded.

A unit longer than ``PART`` bytes (scripts without spaces, long digests) is cut at any other safe pair. Such a part is encoded behind a line
break, which no piece holds, so that the mark put before every text does not touch it; the break's own tokens are taken off. Where
a unit has no safe pair at all it is encoded whole. A model of another kind (not merges, with a normaliser, without byte
fallback) has no boundaries known to be safe: its texts are encoded whole.

Null and empty texts have no bytes and no tokens. Every row is counted by itself: repeated rows have equal counts, a null key is kept, an empty table
gives an empty one. Ties do not arise. Only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from hydropanel.llm.common import pieces, raw_texts, rowwise, start

LIMIT = 4096
PART = 1 << 14  # bytes of a unit that is encoded at once
SLAB = 1 << 20  # bytes of a text whose units are listed at once
CALL = 1 << 18  # bytes of one encoding call
_KEEP = 400_000
_MARK = "▁"
_MARK_BYTES = _MARK.encode()


class _Units(dict):
    """Numbers of units in the order they were first asked for; ``fresh`` lists those without a length yet."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []
        self.fresh_bytes = 0

    def __missing__(self, unit: bytes) -> int:
        self.fresh.append(unit)
        self.fresh_bytes += len(unit)
        number = self[unit] = len(self)
        return number


class PieceCounts:
    """Counts under one model file, with a bounded memory of units."""

    def __init__(self, path: str, part: int = PART, slab: int = SLAB) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.part, self.slab = part, slab
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        control = proto.SentencePiece.CONTROL
        words = [p.piece for p in proto.pieces if p.type != control]
        self.pairs = {(a, b) for w in words for a, b in zip(w, w[1:])}
        how, kind = proto.normalizer_spec, proto.trainer_spec
        plain = how.name == "identity" and not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces
        plain = plain and not how.remove_extra_whitespaces and not kind.treat_whitespace_as_suffix
        merges = kind.model_type == kind.BPE and kind.byte_fallback
        self.safe = plain and merges and not any(b == _MARK != a for a, b in self.pairs) and not any("\n" in w for w in words)
        if self.safe:
            self.before = self._lengths([b"\n"])[0]
            self.space = self._lengths([b"\n "])[0] - self.before
        self.forget()

    def forget(self) -> None:
        self.units, self.length = _Units(), np.zeros(0, np.int64)

    def _lengths(self, some: list[bytes]) -> list[int]:
        """Token counts of these texts, each by itself, in calls of about ``CALL`` bytes."""
        out: list[int] = []
        for lo, hi in pieces([len(t) for t in some], CALL):
            out += map(len, self.model.encode([t.decode() for t in some[lo:hi]], num_threads=1))
        return out

    def slabs(self, text: bytes) -> Iterator[bytes]:
        """Ranges of a text that begin at the first of some spaces."""
        at = 0
        while len(text) - at > self.slab:
            cut = text.find(b" ", at + self.slab)
            while cut > 0 and text[cut - 1] == 32:
                cut = text.find(b" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def spaced(self, text: bytes, first: bool) -> list[bytes]:
        """Units of a text or slab without the space that the model puts before each; a lone space is the empty unit."""
        words = text.split(b" ")
        if not first:
            words = words[1:]  # before its first space there is nothing
        if all(words):
            return words
        out, gap = [], 0
        for k, word in enumerate(words):
            if word or k == len(words) - 1:
                out.append(b" " * gap + word)
                gap = 0
            else:
                gap += 1
        return out

    def parts(self, unit: bytes) -> Iterator[bytes]:
        """A long unit, cut where two characters are neighbours in no piece."""
        at, probe = 0, self.part
        while probe < len(unit):
            while probe < len(unit) and unit[probe] & 0xC0 == 0x80:
                probe += 1
            back = probe - 1
            while back > at and unit[back] & 0xC0 == 0x80:
                back -= 1
            step = unit[back : probe + 1024]
            near = step.decode(errors="ignore")  # the last character may be cut
            place = back
            for a, b in zip(near, near[1:]):
                place += len(a.encode())
                if (a, b) not in self.pairs and " " not in (a, b) and place > at:
                    yield unit[at:place]
                    at, probe = place, place + self.part
                    break
            else:
                probe += 1024
        yield unit[at:]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if not self.safe:
            return np.array(self._lengths(texts), np.int64)
        total = np.zeros(len(texts), np.int64)
        found = []
        for i, text in enumerate(texts):
            text = text.replace(_MARK_BYTES, b" ")  # the model reads a literal mark as a space
            for k, slab in enumerate(self.slabs(text) if text else ()):
                units = self.spaced(slab, k == 0)
                if len(slab) > self.part and max(map(len, units)) > self.part:
                    total[i] += self.long(units, k == 0)
                    units = [u for u in units if len(u) <= self.part]
                found.append((i, np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))))
                if self.units.fresh_bytes > 16 * CALL:
                    self._learn()
        self._learn()
        for i, numbers in found:
            total[i] += self.length[numbers].sum()
        if len(self.units) > _KEEP:
            self.forget()
        return total

    def long(self, units: list[bytes], first: bool) -> int:
        n = 0
        for unit in units:
            if len(unit) > self.part:
                head, *rest = self.parts(unit)
                n += self._lengths([head])[0] + sum(x - self.before for x in self._lengths([b"\n" + p for p in rest]))
        return n

    def _learn(self) -> None:
        fresh = self.units.fresh
        if fresh:
            self.length = np.concatenate([self.length, [n if u else self.space for u, n in zip(fresh, self._lengths(fresh), strict=True)]])
            fresh.clear()
            self.units.fresh_bytes = 0


@lru_cache(maxsize=2)
def _loaded(path: str) -> PieceCounts:
    """One coder for all tasks of a worker."""
    return PieceCounts(path)


def count(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row. ``model`` is the path of a model file, the same on all machines."""
    start(docs.sparkSession)

    def run(batch) -> dict:
        coder = _loaded(model)
        raw = raw_texts(batch, text)
        sizes = [len(t) for t in raw]
        counts = [coder.counts(raw[lo:hi]) for lo, hi in pieces(sizes)]
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return {"n_bytes": sizes, "n_tokens": n, "over_limit": n > limit}

    return rowwise(docs, [key, text], run, "n_bytes long, n_tokens long, over_limit boolean", keep=[key])

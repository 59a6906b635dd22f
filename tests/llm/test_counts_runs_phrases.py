"""Token counts, periodic runs and phrases against plain versions of each, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from hydropanel.llm import collocations, periodic_runs, token_counts
from hydropanel.llm import queries as Q
from hydropanel.llm.common import table

DATA = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# The added columns of the operators are here too, with other types.
SCHEMA = "doc_id long, text string, lang string, n_tokens string, n_bytes string, runs int, collapsed int, phrase int, rank string, a int, bucket string"
LONG = "alpha beta gamma delta " * 20_000
ODD = [
    (1, None, "en"), (2, "", None), (3, LONG, "en"), (4, "same text here", "en"), (5, "same text here", "en"), (5, "same text here", "en"),
    (None, "same text here", None), (7, " \n\n \t", "de"), (8, "▁ literal  mark\u0001\u0002   日本 👍🏽 é", "en"), (9, "日本語" * 30_000, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "x", "y", 1, 2, 3, "z", 4, "b") for i, t, lang in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: (r["text"] or "", r["lang"]) for r in table(spark, DATA, "documents").collect()}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_token_counts_are_the_librarys(spark, documents, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in Q.QUERIES["op11_token_counts"](spark, DATA).collect()}
    want = {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, (t, _) in documents.items()}
    assert got == want and any(over for *_, over in want.values())


@pytest.mark.parametrize(("part", "slab"), [(1 << 14, 1 << 20), (7, 20), (3, 9), (1 << 14, 8)])
def test_token_counts_at_any_cut(library, part, slab):
    rng = random.Random(part * slab)
    some = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "日本", "👍🏽", "\t", "\0", "<s>", "</s>", "<unk>", "<0x0A>", "é", "1", ".", " \n ", "ing", "====", "0" * 9]
    texts = ["".join(rng.choices(some, k=rng.randrange(60))) for _ in range(1500)] + ["", " ", "  ", "   ", "a ", "a  ", " a", "\n", " \n", "▁", " ▁", "▁ ", "a" * 50, "日" * 40]
    coder = token_counts.PieceCounts(PIECES, part=part, slab=slab)
    assert coder.safe
    assert coder.counts([t.encode() for t in texts]).tolist() == [len(library.encode(t)) for t in texts]
    coder.safe = False
    assert coder.counts([t.encode() for t in texts[:50]]).tolist() == [len(library.encode(t)) for t in texts[:50]]


def test_token_counts_of_odd_rows(spark, odd, none, library):
    got = token_counts.count(odd, PIECES)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in ODD)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.count(none, PIECES).count() == 0


def plain_runs(words, exponent=4, least=6):
    """All runs, by going over every period."""
    n, extent = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i >= q:
                extent.setdefault((i - q, j), q)  # a smaller period was here before
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in extent.items() if e - s >= max(least, exponent * q)), key=lambda r: (r[0], r[2]))


def test_catchers_miss_no_run():
    rng = random.Random(5)
    for _ in range(300):
        n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, 20)
            for i in range(a + p, rng.randrange(a, n + 1)):
                words[i] = words[i - p]
        exponent, least = rng.choice([2, 2, 3, 4]), rng.choice([2, 6])
        want = plain_runs(words, exponent, least)
        for piece in (1, 5, 1000):
            catchers = periodic_runs.Catchers()
            for at in range(0, n, piece):
                catchers.append(np.array(words[at : at + piece]))
            assert catchers.runs(exponent, least) == want
        assert periodic_runs.runs_of([b"%d" % w for w in words], exponent, least, 7) == want


def test_false_hashes_change_nothing(monkeypatch):
    """With a hash of a few values nearly every window is a hit."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x % np.uint64(2))
    rng = random.Random(6)
    for _ in range(60):
        words = [rng.randrange(4) for _ in range(60)]
        words[20:50] = (words[20 : 20 + (p := rng.randrange(1, 9))] * 30)[:30]
        catchers = periodic_runs.Catchers()
        catchers.append(np.array(words))
        assert catchers.runs(2, 2) == plain_runs(words, 2, 2), p


def test_thue_morse_words():
    """Many squares, none of them cubes; the shape on which hashes by powers of two fail."""
    words = [bin(i).count("1") % 2 for i in range(4096)]
    assert periodic_runs.runs_of([b"%d" % w for w in words], 3, 1) == []
    assert periodic_runs.runs_of([b"%d" % w for w in words[:512]], 2, 1) == plain_runs(words[:512], 2, 1)


def test_periodic_runs_query(spark, documents):
    want = {}
    for i, (text, _) in documents.items():
        words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = plain_runs(words) if n < 2000 else periodic_runs.runs_of(words)
        dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        short = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        want[i] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(short).hexdigest())
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in Q.QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 5


def test_runs_of_odd_rows(spark, odd, none):
    got = collections.Counter((r["doc_id"], len(r["runs"]), r["collapsed"]) for r in periodic_runs.find(odd).collect())
    assert got[1, 0, ""] == got[2, 0, ""] == got[7, 0, ""] == 1 and got[5, 0, "same text here"] == 2
    assert got[3, 1, "alpha beta gamma delta"] == 1 and sum(got.values()) == len(ODD)
    assert periodic_runs.find(none).count() == 0


def plain_phrases(rows, least=10, longest=3, top=2000, inside=50):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        held = any(
            len(q) > len(p) and x == lang and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (x, q), b in candidates.items() if len(q) > len(p) and p[0] in q
        )
        if not held:
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


def test_multikey_sort_counts():
    rng = np.random.default_rng(1)
    for n, k in ((0, 1), (1, 1), (40, 1), (300, 3), (300, 9), (2000, 40)):
        keys, weight = rng.integers(0, k, (n, 3)).astype(np.int32), rng.integers(1, 4, n)
        want = collections.Counter()
        for key, w in zip(map(tuple, keys.tolist()), weight.tolist(), strict=True):
            want[key] += w
            want[key[:2]] += w
        at, total, agree = collocations.multikey_counts(list(keys.T), weight, 5, 2)
        got = [(tuple(keys[i, :d].tolist()), t) for i, t, d in zip(at, total.tolist(), agree, strict=True)]
        assert len(got) == len(dict(got)) and dict(got) == {key: w for key, w in want.items() if w >= 5}


@pytest.mark.parametrize(("chunk", "slab", "longest"), [(1_000_000, 1 << 20, 3), (50, 1 << 20, 3), (30, 16, 4), (200, 30, 2)])
def test_phrases_at_any_cut(spark, monkeypatch, chunk, slab, longest):
    """Small chunks and slabs, a hot passage in a third of the rows, a hot pair followed by many words."""
    monkeypatch.setattr(collocations, "_FEW", 2)  # pairs are split in many chunks and not in others
    rng, buckets = random.Random(longest), 20
    words = ["Aa", "b", "É", "日本", "d'x", "e f", "g\x1fh"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\t", "!?", "\r", "\x0b"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    hot = [f"hot pair {v} end" for v in "abcdefgh"]  # often enough to be counted, in chunks where the pair is split and in others
    texts += ["the hot passage of all rows"] * 30 + ["", None, " ", "."] + hot * 2 + ["; ".join(hot)] * 2 + [f"hot pair w{i}" for i in range(40)]
    rows = [(t, rng.choice(["en", "de", None])) for t in texts]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = {tuple(r) for r in collocations.mine(docs, least=4, longest=longest, buckets=buckets, chunk=chunk, slab=slab).collect()}
    assert got == plain_phrases(rows, 4, longest) and got
    # The tasks of Spark have a module of their own, so the splitting is also tried here.
    sent = collocations._Chunk(longest, buckets)
    own = [collocations._Bucket(longest) for _ in range(buckets)]
    kinds = set()
    for text, lang in rows:
        for words, begin in collocations.stretches((text or "").encode(), longest, slab):
            sent.add(words, begin, lang or "und")
            if sent.size >= chunk:
                kinds |= {k for k, *_ in sent._entries()}
                for bucket, raw in sent.flush():
                    own[bucket].add(raw)
    if sent.size:
        kinds |= {k for k, *_ in sent._entries()}
        for bucket, raw in sent.flush():
            own[bucket].add(raw)
    whole, partial = collections.Counter(), collections.Counter()
    for bucket in own:
        for of, phrase, a, part in bucket.counts(4):
            assert part or not phrase or (of, *phrase) not in whole
            (partial if part else whole)[(of, *phrase)] += a
    whole.update({k: a for k, a in partial.items() if a >= 4})
    assert (collocations._SPLIT in kinds) == bool(partial) and (partial or longest < 3 or chunk != 50)
    want = collections.Counter()
    for text, lang in rows:
        for words, _ in collocations.stretches((text or "").encode(), longest, 1 << 20):
            for i, w in enumerate(words):
                want[lang or "und",] += w != b"\xff"
                for m in range(1, longest + 1):
                    phrase = words[i : i + m]
                    want[(lang or "und", *[x.decode(errors="replace") for x in phrase])] += len(phrase) == m and b"\xff" not in phrase
    assert whole == {k: a for k, a in want.items() if a >= 4 or len(k) == 1}


def test_counts_beyond_64_bits(spark):
    """a * a * 1,000,000 passes 64 bits; the scores are exact."""
    big = 3_000_000_019
    rows = [("en", ["x"], big + 7), ("en", ["y"], big + 1), ("en", ["x", "y"], big), ("en", [], 2 * big)]
    counted = spark.createDataFrame(rows, "lang string, phrase array<string>, a long")
    got = collocations.rank(counted).collect()
    assert [(r["phrase"], r["score"], r["n"]) for r in got] == [("x y", 1_000_000 * big * big // ((big + 7) * (big + 1)), 2 * big)]


def test_phrases_of_odd_rows(spark, odd, none):
    got = {(r["lang"], r["phrase"]): r["a"] for r in collocations.mine(odd, least=2).collect()}
    assert got["en", "same text here"] == 3 and got["en", "alpha beta gamma"] == 20_000 and ("und", "same text") not in got
    assert collocations.mine(none).count() == 0

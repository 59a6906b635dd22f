"""The text operators against brute force, round trips and SQL, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hydropanel.llm import (
    decontaminate,
    language_profiles,
    order_minhash,
    piece_lattice,
    pii_surrogates,
    quality_crf,
    secret_ledger,
    simhash,
    token_planes,
    url_filter,
)
from hydropanel.llm import queries as Q
from hydropanel.llm.common import table

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids int, score string, component string, nr int"
LONG = "alpha beta gamma delta " * 20_000
ODD = [
    (1, None, "en"), (2, "", None), (3, LONG, "en"), (4, "same text here", "en"), (5, "same text here", "en"), (5, "same text here", "en"),
    (None, "same text here", None), (7, " \n\n \t", "de"), (8, "▁ literal  mark\u0001\u0002 \u00a0 日本 👍🏽 e\u0301", "en"), (9, "password=abcdef0123456789abcdef01", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "s", None if t is None else len(t), 7, 8, "x", "y", 9) for i, t, lang in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    res = con.execute(Q.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
    assert collections.Counter(tuple(r[c] for c in cols) for r in df.collect()) == want


def test_urls(spark):
    rules = url_filter.build(spark.createDataFrame(Q.URL_RULES, "entry string, verdict string"))
    blocked = url_filter.build(spark.createDataFrame([("bad.org/", "block"), ("bad.org/", "block")], "entry string, verdict string"))
    empty = url_filter.build(spark.createDataFrame([], "entry string, verdict string"))
    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?q#f", "http://www.example.com/en/", "x://s.bad.org/p", "x://bad.org", "http://net/es/1", "a://b://c"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, blocked).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[4] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[5] == ("s.bad.org", "/p", None, "block")
    assert got[6] == ("bad.org", "", None, "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8][0] == "b:"
    assert {r["verdict"] for r in url_filter.judge(pages, empty, empty).collect()} == {"allow"}
    assert url_filter.judge(pages.where("page_id < 0"), rules, blocked).count() == 0
    twice = url_filter.judge(pages.union(pages), rules, blocked)
    assert collections.Counter(map(tuple, twice.collect())) == collections.Counter({(k, *v): 2 for k, v in got.items()})


@pytest.mark.parametrize("shard_entries", [100_000, 16])
def test_sites_by_brute_force(spark, shard_entries):
    """Longest fitting entry over many entries, one or many shards; a very long url is judged like others."""
    rng = random.Random(1)
    label = lambda: rng.choice("abcde") + rng.choice("xyz")
    entries = {".".join(label() for _ in range(rng.randint(1, 3))) + "/" + "".join(f"{label()}/" for _ in range(rng.randint(0, 2))): rng.choice(["allow", "block"]) for _ in range(600)}
    sites = url_filter.build(spark.createDataFrame([*entries.items()], "entry string, verdict string"), shard_entries=shard_entries)
    assert sites.bits == (0 if shard_entries > 600 else 6)
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 4))) + "/" + "".join(f"{label()}/" for _ in range(rng.randint(0, 3))) for _ in range(2000)]
    urls.append("http://ax.by/" + "x" * 100_000)
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    empty = url_filter.build(spark.createDataFrame([], "entry string, verdict string"))

    def best(url):
        host, path = url.removeprefix("http://").split("/", 1)
        fits = [e for e in entries if (host == e.split("/", 1)[0] or host.endswith("." + e.split("/", 1)[0])) and path.startswith(e.split("/", 1)[1])]
        return max(fits, key=lambda e: (len(e), e), default=None)

    want = [entries.get(best(u), "allow") for u in urls]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, empty, sites).collect()}
    assert [got[i] for i in range(len(urls))] == want and 100 < want.count("block") < 1900
    assert [r["rule"] for r in url_filter.judge(pages, sites, empty).orderBy("page_id").collect()] == [best(u) for u in urls]


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    """Entries that share one digest: only the stored string decides."""
    monkeypatch.setattr(url_filter, "digest", lambda e: len(e))
    stored = sorted([b"a.org/", b"b.org/", b"c.org/", b"long.example/"], key=lambda e: (len(e), e))
    for name, data in (("text", b"".join(stored)), ("offsets", np.cumsum([0, *map(len, stored)]).astype(np.uint64).tobytes()),
                       ("allow", bytes([0, 1, 0, 1])), ("keys", np.array([*map(len, stored)], np.uint64).tobytes())):
        (tmp_path / f"0.{name}").write_bytes(data)
    array = url_filter.DigestArray(url_filter.Built(str(tmp_path), [1], 0))
    assert array.probe([b"b.org/", b"x.org/", b"c.org/", b"a.org/", b"long.example/", b"tiny/"]).tolist() == [1, -1, 0, 0, 1, -1]


def test_ledger_scans_only_what_it_lacks(spark):
    ledger = secret_ledger.fresh_ledger(spark)
    versions = lambda rows: spark.createDataFrame(rows, "path string, content string, blob string")
    first = versions([("a", "token: token: abcdefgh", "z"), ("b", "AKIA" + "Z" * 16, "z"), ("c", None, "z")])
    found = {r["path"]: [(f["kind"], f["start"], f["end"]) for f in r["found"]] for r in secret_ledger.scan(first, ledger).collect()}
    assert found == {"a": [], "b": [("access", 0, 20)], "c": []}
    again = versions([("d", "AKIA" + "Z" * 16, "z"), ("e", "é secret = 'abcdef'", "z")])
    found = {r["path"]: [(f["kind"], f["start"], f["end"]) for f in r["found"]] for r in secret_ledger.scan(again, ledger).collect()}
    assert found == {"d": [("access", 0, 20)], "e": [("assign", 2, 18)]}
    scanned = spark.read.parquet(f"{ledger}/scanned").collect()
    assert len(scanned) == 4 and all(len(r["rules"]) == len(secret_ledger.RULES) for r in scanned)
    newer = (*secret_ledger.RULES[:-1], secret_ledger.Rule("jwt", 2, 6, "zzz", "zzz"))
    secret_ledger.scan(again, ledger, newer).count()
    assert sorted(len(r["rules"]) for r in spark.read.parquet(f"{ledger}/scanned").collect()) == [1, 1] + [len(secret_ledger.RULES)] * 4


def test_secrets_of_odd_texts(spark, odd, none):
    got = {r["path"]: r["found"] for r in secret_ledger.scan(odd, secret_ledger.fresh_ledger(spark), path="doc_id", content="text").collect()}
    assert [(f["kind"], f["start"], f["end"]) for f in got[9]] == [("assign", 0, 33), ("hex", 9, 33)] and not any(got[i] for i in (1, 2, 3, 8))
    assert secret_ledger.scan(none, secret_ledger.fresh_ledger(spark), path="doc_id", content="text").count() == 0


def naive_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, documents):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in Q.QUERIES["op5_simhash_tiles"](spark, DATA).collect()}
    ids = sorted(documents)
    prints = [naive_fingerprint(documents[i]) for i in ids]
    component = simhash.brute_force(prints, 2)
    assert got == {i: (p, ids[c]) for i, p, c in zip(ids, prints, component, strict=True)}


@pytest.mark.parametrize("tile", [4, 64])
def test_crowded_buckets_lose_no_link(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    prints = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (60, 2))})
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp long, rep long")
    found = {r["fp"]: r["component"] for r in simhash.components(nodes, simhash.edges(nodes.select("fp"), 2, tile)).collect()}
    want = simhash.brute_force([p & (1 << 64) - 1 for p in prints], 2)
    assert [found.get(p, k) for k, p in enumerate(prints)] == want


def test_one_of_each_group_stays(spark, odd, none):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([1, 3, 4, 8, 9])
    assert simhash.representatives(none).count() == 0 and simhash.groups(none).count() == 0
    assert simhash.groups(odd).count() == len(ODD)


def test_benchmark_items(spark, documents, odd, none):
    items = {r["item_id"]: r["text"] for r in table(spark, DATA, "benchmark").collect()}
    runs = lambda t: (w := decontaminate.words(t)) and {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {(d, i) for i, t in items.items() if len(runs(t)) > 5 for d, x in documents.items() if len(runs(t) & (runs(x) or set())) >= 0.8 * len(runs(t))}
    found = decontaminate.find(table(spark, DATA, "documents"), table(spark, DATA, "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    shared = lambda t, x: len(runs(t) & (runs(x) or set())) / max(1, len(runs(t)))
    assert want and want <= got and all(shared(items[i], documents[d]) > 0.2 for d, i in got - want)
    short = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta"), (2, None), (3, ""), (1, "literal mark")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(odd, short).collect()} == {(3, 1), (8, 1)}
    assert decontaminate.clean(odd, short).count() == len(ODD) - 2
    assert decontaminate.clean(odd, short.limit(0)).count() == len(ODD) and decontaminate.find(none, short).count() == 0


def test_short_answers_and_repeated_items(spark):
    """An answer of one word counts by itself beside its question; equal items are all found, whatever slice holds their text."""
    asked = "Which river passes the harbour city below the hill with the old station"
    text = f"{asked}. Elbe"
    rows = [(1, text), (2, text), (3, text), (None, text), (4, "Some other question about mountains and long winters there. Snow")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    filler = " ".join(f"word{i}" for i in range(150))
    told = asked.replace("station", "tower")
    docs = spark.createDataFrame([(10, f"{filler} {told}. Elbe {filler}"), (11, f"{filler} {told}. Rhine {filler}"), (12, filler), (13, f"{text} {filler}")], "doc_id long, text string")
    found = decontaminate.find(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d in (10, 13) for i in (1, 2, 3, None)} and len(found) == 8
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [11, 12]
    assert len(list(decontaminate.indexes(items, slice_words=5))) > 1


@pytest.mark.parametrize("block", [1, 4, 64])
def test_wand_agrees_with_a_full_scan(monkeypatch, block):
    """Every window against every segment by the formula of BM25, apart from the index."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, 20 + 3 * (i % 40)))) for i in range(60)] + [(60, "?!"), (61, "w1 w1 w1")]
    docs = [" ".join([*rng.choice(vocabulary, 90), *(items[i % 40][1].split()[: 8 + i % 40]), *rng.choice(vocabulary, 70)]) for i in range(60)] + ["", "unknown words only", "w1"]
    split = {i: t.translate({ord("?"): " ", ord("!"): " "}).split() for i, t in items}
    frequency = collections.Counter(w for words in split.values() for w in set(words))
    mean = 30.0
    index = decontaminate.Index(items, {w.encode(): n for w, n in frequency.items()}, len(items), mean, 0.5)
    index.overlap = lambda item, near: (1.0, 1.0)
    got = {(d, index.ids[i]): score for d, i, _, score, *_ in index.search(docs)}
    want = {}
    for i, words in split.items():
        pieces = max(1, -(-len(words) // 64))
        for piece in np.array_split(np.array(words, object), pieces):
            count = collections.Counter(piece.tolist())
            idf = {w: np.log(1 + (len(items) - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in count}
            weight = {w: idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(piece) / mean)) for w, n in count.items()}
            for d, text in enumerate(docs):
                w = text.split()
                for at in range(0, len(w), 64):
                    score = sum(weight.get(x, 0) for x in set(w[at : at + 128])) / (sum(weight.values()) or 1)
                    if score >= 0.5 - 1e-9:
                        want[d, i] = max(score, want.get((d, i), 0))
    assert got.keys() == want.keys() and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_wand_skips_blocks_and_postings():
    """Windows that share only frequent words with the items touch a small part of the postings."""
    rng = np.random.default_rng(2)
    common = [f"c{i}" for i in range(5)]
    items = [(i, " ".join([*common, *(f"r{i}x{k}" for k in range(20))])) for i in range(400)]
    frequency = collections.Counter(w for _, t in items for w in set(decontaminate.words(t)))
    index = decontaminate.Index(items, frequency, len(items), 25.0, 0.5)
    seen, whole = [], index.segment

    class Counted(np.ndarray):
        def __getitem__(self, key):
            seen.append(np.size(key))
            return whole[key]

    index.segment = whole.view(Counted)
    docs = [" ".join([*common, *rng.choice([f"r{i}x{k}" for i in range(400) for k in range(20)], 10)]) for _ in range(50)] + [items[7][1]]
    assert [(d, index.ids[i]) for d, i, *_ in index.search(docs)] == [(50, 7)]
    assert sum(seen) < 0.1 * 50 * 5 * 400


def test_pieces_are_lossless_and_seeded(spark, odd, none):
    encoded = piece_lattice.encode(odd.repartition(5), PIECES)
    rows = encoded.collect()
    assert all(r["lossless"] for r in rows) and len(rows) == len(ODD)
    back = collections.Counter((r["doc_id"], r["text"]) for r in piece_lattice.decode(encoded, PIECES).collect())
    assert back == collections.Counter((i, t or "") for i, t, _ in ODD)
    other = {(r["doc_id"], tuple(r["ids"])) for r in piece_lattice.encode(odd.coalesce(1), PIECES).collect()}
    assert other == {(r["doc_id"], tuple(r["ids"])) for r in rows}
    assert piece_lattice.encode(none, PIECES).count() == 0


def test_pieces_follow_their_distribution():
    lattice = piece_lattice.load(PIECES)
    weight = {lattice.plain[i]: lattice.weight[i] for i in range(len(lattice.plain))}

    def ways(x):
        if not x:
            yield (), 1.0
        for k in range(1, len(x) + 1):
            if x[:k] in weight and (k == 1 or "▁" not in x[1:k]):
                for rest, w in ways(x[k:]):
                    yield (x[:k], *rest), w * weight[x[:k]]

    exact = dict(ways("▁cat"))
    total = sum(exact.values())
    n = 20_000
    ids, size = lattice.sample(["cat"] * n, piece_lattice.mix(np.arange(n, dtype=np.uint64)))
    at = np.concatenate([[0], np.cumsum(size)])
    seen = collections.Counter(tuple(lattice.plain[i] for i in ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
    for way, w in exact.items():
        assert abs(seen[way] / n - w / total) < 0.015


def test_token_planes(spark, documents, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in Q.QUERIES["op6_token_planes"](spark, DATA).collect()}
    begin = 0
    for i in sorted(documents):
        ids = [*whole.encode(documents[i], add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (begin, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        begin += len(ids)
    back = token_planes.read(spark, token_planes.write(odd, WORDS)).collect()
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in back) == collections.Counter(
        (i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, _ in ODD
    )
    assert token_planes.read(spark, token_planes.write(none, WORDS)).count() == 0
    x = np.random.default_rng(0).integers(0, 1 << 32, 1000, dtype=np.uint64).astype(np.uint32)
    assert (token_planes.unshuffle_bits(token_planes.shuffle_bits(x), 1000) == x).all()


def test_tokens_of_hard_texts():
    from tokenizers import Tokenizer

    whole, codes = Tokenizer.from_file(WORDS), token_planes.WordCodes(WORDS)
    hard = ["I'm don't X'S a.b,c 12ab!. x", "É ß Σας ΟΔΟΣ İstanbul ẞ", "H\u0331 A\u0301 é", "<|endoftext|> <|ENDOFTEXT|>", "日本 x\ty\r\nz\x00", "ﬁ \u212b K \u200b\ufeff", "½ x² ⅷ", "a\u3000c \x85d \x1ce", "word. word, word", "", "  "]
    for text, ids in zip(hard, codes.documents([t.encode() for t in hard], 1), strict=True):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], text
    codes.forget()
    assert codes.documents([b"word. word"], 1)[0].tolist() == [*whole.encode("word. word", add_special_tokens=False).ids, 1]


def test_quality(spark, odd, none):
    got = {r["doc_id"]: r for r in Q.QUERIES["op7_quality_crf"](spark, DATA.replace("0.001", "0.01")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA.replace("0.001", "0.01"), "labels").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.95 * len(held)
    model = quality_crf.train(odd, spark.createDataFrame([(3, 0), (4, 1), (4, None), (None, 1)], "doc_id long, quality int"))
    scores = [r["score"] for r in quality_crf.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality_crf.score(none, model).count() == 0 and quality_crf.keep_good(odd, model).columns == odd.columns
    unlabelled = quality_crf.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_crf.score(odd, unlabelled).collect()} == {0.5}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(5)
    counts = np.array([3, 1, 4])
    unary, move = rng.normal(size=8), rng.normal(size=(2, 2))
    got, begin = quality_crf.Chains(counts).marginals(unary, move), 0
    for n in counts:
        u = unary[begin : begin + n]
        weight = {}
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            weight[code] = np.exp(sum(u[k] * y[k] for k in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        for k in range(n):
            assert np.isclose(got[begin + k], sum(w for c, w in weight.items() if c >> k & 1) / sum(weight.values()))
        begin += n


def test_language(spark, odd, none):
    rows = Q.QUERIES["op8_rank_order_language"](spark, DATA).collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, DATA, "documents").collect()}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    profiles = language_profiles.learn(odd)
    got = [(r["doc_id"], r["lang_pred"]) for r in language_profiles.identify(odd, profiles).collect()]
    assert len(got) == len(ODD) and dict(got)[1] == dict(got)[2] == dict(got)[7] == "und" and dict(got)[3] == "en"
    nothing = language_profiles.learn(none)
    assert {r["lang_pred"] for r in language_profiles.identify(odd, nothing).collect()} == {"und"}


def test_ngrams():
    row, gram, count = language_profiles.grams(["Ab ab", ""])
    spelled = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0) if g >> s & (1 << 21) - 1)
    assert {spelled(g): n for r, g, n in zip(row.tolist(), gram.tolist(), count.tolist(), strict=True) if r == 0} == {
        "a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2
    }


def test_surrogates(spark, odd, none):
    texts = [
        "Write to Jane.DOE7@Mail.Example.com or jane.doe7@mail.example.com, call +1 (017) 555-7713",
        "card 4111 1111 1111 1111 and 4111111111111111; Mrs Smith and Herr Peter Smith; Господин Иван Петров 10.0.0.1.",
        "call +1 017 555 7713 twice", None, "", "nothing\u0001 here",
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_email int")
    got = {r["doc_id"]: r for r in pii_surrogates.replace(docs, "k").collect()}
    first, second = re.match(r"Write to (\S+) or (\S+), call \+1 \((\d{3})\) (\d{3})-(\d{4})$", got[0]["text"]), got[2]["text"]
    assert first[1].lower() == first[2] != "jane.doe7@mail.example.com" and re.match(r"[A-Z][a-z]{3}\.[A-Z]{3}\d@", first[1])
    assert second == f"call +1 {first[3]} {first[4]} {first[5]} twice"
    cards = re.match(r"card ([\d ]{19}) and (\d{16}); Mrs ", got[1]["text"])
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111"
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(cards[2])) % 10 == 0
    assert "Smith" not in got[1]["text"] and "Петров" not in got[1]["text"] and re.search(r"Господин [А-Я][а-я]+ [А-Я][а-я]+", got[1]["text"])
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == texts[5]
    entities = spark.createDataFrame([("ip", f"1.1.{i // 250}.{i % 250}") for i in range(3000)] + [("phone", f"{i:03d}") for i in range(300)], "kind string, entity string")
    given = pii_surrogates.assign(entities, "k").collect()
    assert len(given) == 3300 == len({(r["kind"], r["surrogate"]) for r in given}) and not {(r["kind"], r["surrogate"]) for r in given} & {(r["kind"], r["entity"]) for r in given}
    assert pii_surrogates.replace(odd, "k").count() == len(ODD) and pii_surrogates.replace(none, "k").count() == 0


def test_surrogates_never_run_out(spark):
    mails = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz0123456789" for b in "abcdefghijklmnopqrstuvwxyz0123456789"]
    phones = [f"+1{i:03d}" for i in range(1000)]
    rows = [("email", m) for m in [*mails, "_@-.com", "%@-.com"]] + [("phone", p) for p in phones]
    given = pii_surrogates.assign(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    made = {(r["kind"], r["surrogate"]) for r in given}
    assert len(given) == len(rows) == len(made) and not made & set(rows)
    docs = spark.createDataFrame([(1, "to _@-.com now"), (2, "to A@B.com now")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii_surrogates.replace(docs, "k").collect()}
    assert re.fullmatch(r"to _[a-z]+@-\.com now", got[1]) and re.fullmatch(r"to [A-Z]@[A-Z]\.com now", got[2])


def test_printed_names_are_distinct_and_agree(spark):
    tail = [a + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcdefghijklmn"]
    texts = [f"Mr X{t} came." for t in tail] + [f"Mr Z{t} Smith came." for t in tail[:300]] + ["Mrs Smith came."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in sorted(pii_surrogates.replace(docs, "k").collect())]
    assert len(set(got)) == len(texts)
    assert len({t.split()[-2] for t in got[len(tail) :]}) == 1


def test_whole_names_are_replaced(spark):
    names = {
        "Mrs Anna Maria Keller": r"Mrs \w+ (\w+)", "Mrs Keller": r"Mrs (\w+)", "Mr J. Smith": r"Mr \w+ \w+", "Mr. J.R.R. Tolkien": r"Mr\. \w+ \w+", "Mr John F Kennedy": r"Mr \w+ \w+",
        "Herr Ludwig von Beethoven": r"Herr \w+ \w+", "Frau de la Cruz": r"Frau \w+", "Mr K.": r"Mr \w+",
    }
    docs = spark.createDataFrame([(i, f"so {n} said") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii_surrogates.replace(docs, "k").collect()}
    found = [re.fullmatch(f"so {pattern} said", got[i]) for i, pattern in enumerate(names.values())]
    assert all(found), got
    assert found[0][1] == found[1][1]
    assert not {"Keller", "Smith", "Tolkien", "Kennedy", "Beethoven", "Cruz", "J", "R", "F", "K", "von", "la"} & {w for t in got.values() for w in re.findall(r"\w+", t)}


def test_names_by_title_introduction_script_and_capitals(spark):
    texts = [
        "saw Mr Smith and Dr Smith, then Prof. Dr. Smith and MR. SMITH", "Mr Παπαδόπουλος left", "Herr 田中 left", "hello, my name is Jane Roe", "so Mr محمد علي, left",
        "מר כהן, left", "Dear Mr Tanaka", "a drive, not Drake Bell", "Frau Dr. Anna Keller", "Frau Anna Keller", "Mr 김, left", "Mr タナカ, left", "Доктор Петров left",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii_surrogates.replace(docs, "k").collect()}
    first = re.fullmatch(r"saw Mr (\w+) and Dr (\w+), then Prof\. Dr\. (\w+) and MR\. (\w+)", got[0]).groups()
    assert first[0] == first[1] == first[2] != "Smith" and first[3] == first[0].upper()
    for i, pattern in {
        1: r"Mr [\u0370-\u03ff\u1f00-\u1fff]+ left", 2: r"Herr [\u4e00-\u9fff]{2,} left", 3: r"hello, my name is [A-Z][a-z]+ [A-Z][a-z]+", 4: r"so Mr [\u0600-\u06ff]+ [\u0600-\u06ff]+, left",
        5: r"מר [\u0590-\u05ff]+, left", 10: r"Mr [\uac00-\ud7af]+, left", 11: r"Mr [\u30a0-\u30ff]+, left", 12: r"Доктор [А-Я][а-я]+ left",
    }.items():
        assert re.fullmatch(pattern, got[i]) and got[i] != texts[i], got[i]
    assert got[7] == texts[7] and "Tanaka" not in got[6]
    assert got[8].replace("Dr. ", "") == got[9] and got[9].split()[1] in pii_surrogates.GIVEN["latin", "f"]


def test_addresses_of_a_domain_stay_together(spark):
    texts = ["a@acme-corp.com or B@Acme-Corp.com", "a@other.org"]
    got = {r["doc_id"]: r["text"] for r in pii_surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    one, two = re.fullmatch(r"(\w+@\w+-\w+\.com) or (\w+@\w+-\w+\.com)", got[0]).groups()
    assert one.split("@")[1] == two.split("@")[1].lower() != "acme-corp.com" and one.split("@")[0] != two.split("@")[0].lower()
    assert two[0].isupper() and got[1].endswith(".org") and "other" not in got[1]


def test_hints_miss_no_entity(spark):
    parts = ["Mr Smith", "x@y.zz", "1.2.3.4", "4111 1111 1111 1111", "+1 (617) 555-7713", "(617) 555-7713", "+49 1 22 33", "617 555 7713", "@ home", "12 345 678", "my name is Jo Li", "Mr", "", "MRS. X"]
    rows = [(i * 20 + j, f"{a} and {b}") for i, a in enumerate(parts) for j, b in enumerate(parts)]
    docs = spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string")
    judged = docs.select("text", pii_surrogates.has_entity(F.col("text")).alias("hint"), F.coalesce(F.col("text").rlike(pii_surrogates._ANY), F.lit(False)).alias("any")).collect()
    assert all(r["hint"] == r["any"] for r in judged) and any(r["hint"] for r in judged) and not all(r["hint"] for r in judged)


def test_order_minhash(spark, documents, odd, none):
    got = {r["doc_id"]: r for r in Q.QUERIES["op10_order_minhash"](spark, DATA).collect()}
    ids = sorted(documents, reverse=True)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, k = documents[i], len(documents[i]) // 3
        edited = t[: len(t) - k] + documents[j][:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        f, g, h = (order_minhash.fingerprint(x) for x in (t, edited, documents[j]))
        assert got[i]["fingerprint"] == order_minhash.hexadecimal(f) and got[i]["near_edited"] == order_minhash.likeness(f, g)
        assert got[i]["near_next"] == order_minhash.likeness(f, h)
    rows = order_minhash.compare_edits(odd).collect()
    assert len(rows) == len(ODD) and order_minhash.compare_edits(none).count() == 0
    assert order_minhash.compare_edits(odd.where("doc_id = 3")).first()["near_next"] == 1.0


def test_order_minhash_selects_by_definition():
    text = "abcabcabd the cat the cat " * 3
    seen = collections.Counter()
    h = order_minhash.numbered(text)
    assert len(set(h.tolist())) == len(h)  # repeated k-mers are numbered apart
    for i in range(len(h)):
        mer = text[i : i + order_minhash.K]
        if not seen[mer]:
            assert h[i] == order_minhash.numbered(mer)[0]
        seen[mer] += 1
    swapped = " ".join(reversed(text.split()))
    assert order_minhash.likeness(order_minhash.fingerprint(text), order_minhash.fingerprint(swapped)) < 0.5


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def plain_order_minhash(text, k=6, signatures=32, order=2):
    """By the definition, with Python integers: number the k-mers, take the least of each hash function, hash them in text order."""
    mers = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    seen, hashes = collections.Counter(), []
    for mer in mers:
        h = 0
        for c in mer:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        h, n = plain_mix(h), seen[mer]
        hashes.append(plain_mix(h ^ plain_mix(n)) if n else h)
        seen[mer] += 1
    out = []
    for s in range(1, signatures + 1):
        least = sorted(range(len(hashes)), key=lambda i: (hashes[i] * (plain_mix(s) | 1) % 2**64, i))[:order]
        value = 1
        for i in sorted(least):
            value = plain_mix(value * 0x100000001B3 % 2**64 ^ hashes[i])
        out.append(value >> 32 if hashes else 0)
    return "".join(f"{v:08x}" for v in out)


def test_order_minhash_by_brute_force(documents):
    rng = random.Random(3)
    texts = ["", "a", "abcde", "abcdef", "aaaaaaaaaa", "ab" * 40, "é😀" * 9, *("".join(rng.choices("ab c", k=n)) for n in (7, 50, 400)), *[documents[i][:3000] for i in sorted(documents)[:40]]]
    for t in texts:
        assert order_minhash.hexadecimal(order_minhash.fingerprint(t)) == plain_order_minhash(t), t[:50]


def test_hot_keys_are_split_and_the_ring_closes(spark):
    """A key with most of the rows fills several ranges; each document still has exactly one next document, in the stated order."""
    rows = [(None if i % 3 else i // 3, f"text {i} " + "ab " * (i % 7)) for i in range(900)] + [(5, "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = order_minhash.with_next(docs).withColumn("task", F.spark_partition_id()).collect()
    mine = [r for r in placed if not r["last"]]
    assert collections.Counter((r["key"], r["text"]) for r in mine) == collections.Counter(rows)
    tasks = collections.defaultdict(set)
    for r in placed:
        tasks[r["part"]].add(r["task"])
    assert all(len(t) == 1 for t in tasks.values()) and len({min(t) for t in tasks.values()}) == len(tasks)
    assert len({r["part"] for r in mine if r["key"] is None}) > 2
    by_part = collections.defaultdict(list)
    for r in placed:
        by_part[r["part"]].append(r)
    order = sorted(by_part)
    assert [r["last"] for p in order for r in by_part[p]] == [x for p in order for x in [False] * (len(by_part[p]) - 1) + [True]]
    for p, following in zip(order, [*order[1:], order[0]], strict=True):  # a range ends with the first row of the one after it
        assert by_part[p][-1]["text"] == by_part[following][0]["text"]
    keys = [r["key"] for p in order for r in by_part[p] if not r["last"]]
    assert keys == sorted((k for k in keys if k is not None), reverse=True) + [None] * keys.count(None)
    assert order_minhash.compare_edits(docs).count() == len(rows)


def test_only_hinted_texts_are_shuffled(spark, tmp_path):
    """Contents without a hint of a secret do not reach the shuffle, and are noted in the ledger all the same."""
    docs = spark.createDataFrame([(f"p{i}", "plain text " * 200 + str(i)) for i in range(300)] + [("s", "token=abcdef0")], "path string, content string")
    ledger = secret_ledger.fresh_ledger(spark)
    found = secret_ledger.scan(docs, ledger)
    assert {r["path"] for r in found.collect() if r["found"]} == {"s"} and spark.read.parquet(f"{ledger}/scanned").count() == 301
    contents = secret_ledger.address(docs, "path", "content")
    hinted = secret_ledger.hinted(contents, secret_ledger.RULES)
    assert [r["path"] for r in hinted.collect()] == ["s"]
    many = (secret_ledger.Rule("any", 1, 9, "plain text 7", "plain text 7"),)
    again = {r["path"] for r in secret_ledger.scan(docs, ledger, many).collect() if r["found"]}
    assert again == {f"p{i}" for i in range(300) if str(i).startswith("7")}


def test_pipeline(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, DATA, "documents")
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()]
    for name in ("quality", "near_duplicates", "benchmark", "secrets"):
        assert stages[name](spark, docs, DATA).columns == docs.columns
    ids = sorted(documents)
    component = simhash.brute_force([naive_fingerprint(documents[i]) for i in ids], 2)
    assert {r["doc_id"] for r in stages["near_duplicates"](spark, docs, DATA).collect()} == {ids[c] for c in component}
    hit = {r["doc_id"] for r in decontaminate.find(docs, table(spark, DATA, "benchmark")).collect()}
    assert {r["doc_id"] for r in stages["benchmark"](spark, docs, DATA).collect()} == set(ids) - hit


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
        out = stage(spark, odd, DATA).collect()
        assert out and (name == "pieces" or {len(r) for r in out} == {len(odd.columns)}), name

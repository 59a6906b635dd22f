"""Queries of the text operators with their production parameters, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydropanel.llm import (
    collocations,
    decontaminate,
    language_profiles,
    order_minhash,
    periodic_runs,
    piece_lattice,
    pii_surrogates,
    quality_crf,
    secret_ledger,
    simhash,
    token_counts,
    token_planes,
    url_filter,
)
from hydropanel.llm.common import table

# Key of the surrogates. In production it comes from the site's secret store.
PII_KEY = "query-key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# The url rules and the host label that marks a blocked site.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
BLOCKED_LABEL = "spam-farm"


@query
def op2_url_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the rules and the array of sites: an entry for each host of the table, block for hosts that have
    the blocked label and allow for others."""
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.host_and_path(F.col("url"))
    hosts = pages.select(host.alias("host")).where(F.col("host") != "").distinct()
    bad = F.array_contains(F.split("host", r"\."), BLOCKED_LABEL)
    sites = hosts.select(F.concat("host", F.lit("/")).alias("entry"), F.when(bad, "block").otherwise("allow").alias("verdict"))
    rules = spark.createDataFrame(URL_RULES, "entry string, verdict string")
    return url_filter.judge(pages.select("page_id", "url"), url_filter.build(rules), url_filter.build(sites))


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
ORACLES["op2_url_digest_array"] = f"""
WITH p AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES {", ".join(f"('{e.split('/', 1)[0]}', '/{e.split('/', 1)[1]}', '{e}', '{v}')" for e, v in URL_RULES)}) AS t(rhost, rpath, rule, verdict)),
b AS (SELECT DISTINCT host AS bhost FROM h WHERE list_contains(string_split(host, '.'), '{BLOCKED_LABEL}')),
f AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
m AS (SELECT DISTINCT page_id FROM h JOIN b ON (host = bhost OR ends_with(host, '.' || bhost)) AND starts_with(path, '/'))
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, CASE WHEN m.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN f ON h.page_id IS NOT DISTINCT FROM f.page_id AND h.host = f.host AND h.path = f.path
LEFT JOIN m ON h.page_id = m.page_id"""


@query
def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, taken as paths with one version each, through a new ledger."""
    docs = table(spark, sf_dir, "documents")
    found = secret_ledger.scan(docs.select("doc_id", "text"), secret_ledger.fresh_ledger(spark), path="doc_id", content="text")
    kinds = [r.kind for r in secret_ledger.BASE]
    base = secret_ledger.of_kind(F.col("found"), *kinds)
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(secret_ledger.of_kind(F.col("found"), k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(secret_ledger.joined(base), 256).alias("base_sha256"),
        secret_ledger.joined(F.col("found")).alias("spans"),
        "blob",
    )


# The base kinds as they are defined, apart from the operator's rules: rank, pattern of the matches, those that are kept.
_BASE_SQL = {
    "assign": (0, r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?[A-Za-z0-9+/_.=-]+""", r"""regexp_matches(m, '[:=]\x20*["\x27]?[A-Za-z0-9+/_.=-]{6,}$')"""),
    "access": (1, "AKIA[A-Z0-9]+", "length(m) >= 20"),
    "hex": (2, "[0-9a-f]+", "length(m) >= 24"),
}


def _secrets_sql() -> str:
    parts = []
    kinds = _BASE_SQL | {r.kind: (r.rank, r.pattern, None) for r in secret_ledger.MORE}
    for kind, (rank, pattern, kept) in kinds.items():
        marked = f"regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(2), 'g')"
        keep = f" AND {kept}" if kept else ""
        parts.append(f"""SELECT blob, '{kind}' AS kind, {rank} AS rank, s AS start, s + length(m) AS stop FROM (
  SELECT blob, nr, split_part(piece, chr(2), 1) AS m,
    coalesce(sum(length(piece) - CASE WHEN nr > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY blob ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
  FROM (SELECT blob, unnest(string_split({marked}, chr(1))) AS piece, generate_subscripts(string_split({marked}, chr(1)), 1) AS nr FROM b)
) WHERE nr > 1{keep}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
b AS (SELECT blob, translate(any_value(text), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM d GROUP BY blob),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT blob, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, d.blob FROM d LEFT JOIN g ON d.blob = g.blob"""


ORACLES["op4_secret_ledger"] = _secrets_sql()


@query
def op5_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most two bits."""
    docs = table(spark, sf_dir, "documents")
    found = simhash.groups(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; the documents of one fold in three are never trained on."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = quality_crf.train(docs.where(fold != 1), labels.where(fold != 1))
    scored = quality_crf.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sampled segmentation of every document, seeded by its id, and whether it decodes to the whole text."""
    return piece_lattice.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", F.size("ids").alias("n_pieces"), "lossless", "ids"
    )


@query
def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as bit planes of token ids and read back."""
    folder = token_planes.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_planes.read(spark, folder).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; one fold in five is never learned from."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    profiles = language_profiles.learn(docs.where(fold != 0))
    found = language_profiles.identify(docs, profiles)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


@query
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return pii_surrogates.replace(table(spark, sf_dir, "documents"), PII_KEY)


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# The words of one document in ten repeat from word a on, with period p: word i is the original word a + (i - a) % p.
_WORDS = "filter(split(coalesce(text, ''), '[ \\\\x09-\\\\x0D]+'), w -> w != '')"
_REPEATED = "array_join(transform(sequence(0, size(words) - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')"


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, one in ten made periodic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(_WORDS))).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.expr("if(size(words) > 0, g % size(words), null)")).withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    docs = docs.select("doc_id", F.when(F.size("words") > 0, F.expr(_REPEATED)).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.find(docs)
    best = F.expr("aggregate(runs, runs[0], (b, x) -> if(x.length * b.period > b.length * x.period, x, b))")
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 4), lambda m: list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))))) AS phrase FROM w),
f AS (SELECT lang, phrase, len(string_split(phrase, ' ')) AS m, count(*) AS a FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND a >= 10),
k AS (SELECT lang, phrase, a, ws, m, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ((1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1 : k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1 : k.m], ' ')),
b AS (SELECT lang, phrase, a, min_by({'l': l, 'r': r, 'score': score}, (score, k)) AS v FROM s GROUP BY lang, phrase, a),
u AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
o AS (SELECT lang, phrase, max(a) AS longer FROM u GROUP BY lang, phrase),
z AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY v.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, v.l AS l, v.r AS r, v.score AS score
  FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000"""

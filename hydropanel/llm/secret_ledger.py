"""Secret scans over every historical version, through a ledger of content-addressed blobs.

A version is a row of path and content. Its blob is the SHA-256 of the content. The ledger is a
folder of two tables: ``scanned`` has the pairs of blob and rule version that were scanned,
``findings`` the spans found. A scan takes the pairs that the ledger lacks, scans each such blob
once however many paths hold it, appends to the ledger, and joins the findings of the current rule
versions back to all paths. A changed rule gets a new version and is scanned anew; the others are not.

Everything is DataFrame expressions. A rule's regular expression marks its matches in the text; the
marked text is cut into pieces, and positions are running sums of piece lengths in code points, so a
text with very many matches costs time in proportion. Texts with the marks themselves are handled by
replacing these two control characters, which no rule matches, by a third one first.

A null content is an empty text. Repeated versions give repeated rows. Rows with a null path are kept. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydropanel import session
from hydropanel.llm.common import staged, start

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` finds leftmost non-overlapping matches; where ``whole`` is given,
    matches that it does not fit from end to end are dropped. ``hint`` is a pattern that every text with a
    match contains; it spares other texts the marking. ``rank`` orders spans that start together."""

    kind: str
    version: int
    rank: int
    pattern: str
    hint: str
    whole: str | None = None

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


_WORDS = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _WORDS + r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"

# A run of hex digits or of key characters is always matched to its end, so the least length can stand
# in the pattern; a short assignment must be matched and dropped, as it hides others inside it.
BASE = (
    Rule("assign", 1, 0, _ASSIGN + _VALUE + "+", _ASSIGN + _VALUE, _ASSIGN + _VALUE + "{6,}"),
    Rule("access", 1, 1, "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, 2, "[0-9a-f]{24,}", "[0-9a-f]{24}"),
)
MORE = (
    Rule("pem", 1, 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", 1, 4, "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", 1, 5, "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", 1, 6, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)
RULES = BASE + MORE


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger table, or no rows if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _scanned(spark: SparkSession, ledger: str) -> DataFrame:
    return _read(spark, f"{ledger}/scanned", "blob string, rules array<string>")


def _findings(spark: SparkSession, ledger: str) -> DataFrame:
    return _read(spark, f"{ledger}/findings", "blob string, rule string, kind string, rank int, start long, end long")


def address(versions: DataFrame, path: str, content: str) -> DataFrame:
    """path, blob, content of every version."""
    text = F.coalesce(F.col(f"`{content}`"), F.lit(""))
    return versions.select(F.col(f"`{path}`").alias("path"), F.sha2(text, 256).alias("blob"), text.alias("content"))


def hinted(contents: DataFrame, rules: tuple[Rule, ...], content: str = "content") -> DataFrame:
    """The rows whose content may hold a secret."""
    return contents.where(F.col(content).rlike("|".join(r.hint for r in rules)))


def spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans (code points, end exclusive) of the rules in ``blobs`` (blob, content, todo: rule ids)."""
    text = F.translate("content", _OPEN + _CLOSE, _OTHER + _OTHER)

    def pieces(r: Rule) -> Column:
        wanted = F.array_contains("todo", r.id) & F.col("text").rlike(r.hint)
        # Matches are marked one by one; the first piece is what stands before them.
        marked = F.split(F.regexp_replace("text", f"({r.pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)
        return F.struct(
            F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.rank).alias("rank"),
            F.when(wanted, marked).alias("pieces"),
        )

    marked = (
        hinted(blobs.select("blob", "todo", text.alias("text")), rules, "text")
        .select("blob", F.explode(F.array(*[pieces(r) for r in rules])).alias("m"))
        .where(F.col("m.pieces").isNotNull())
    )
    rows = marked.select("blob", "m.rule", "m.kind", "m.rank", F.posexplode("m.pieces").alias("nr", "piece"))
    match = F.when(F.col("nr") > 0, F.substring_index("piece", _CLOSE, 1))
    size = F.length("piece") - F.when(F.col("nr") > 0, 1).otherwise(0)
    before = Window.partitionBy("blob", "rule").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("match", match).withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    kept = F.col("nr") > 0
    for r in rules:
        if r.whole:
            kept &= (F.col("kind") != r.kind) | F.col("match").rlike(rf"\A(?:{r.whole})\z")
    return placed.where(kept).select(
        "blob", "rule", "kind", "rank", "start", (F.col("start") + F.length("match")).alias("end")
    )


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "path", content: str = "content") -> DataFrame:
    """Bring the ledger up to date with ``versions``; returns path, blob and its findings, an array of
    (start, rank, end, kind) sorted, for each version. Findings of paths seen in earlier scans stay in the ledger."""
    spark = start(versions.sparkSession)
    ids = [r.id for r in rules]
    contents = address(versions, path, content)
    addressed = staged(contents.select("path", "blob"), "secret-paths")
    seen = _scanned(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    # Only texts with a hint of a secret are shuffled; of the others the digest is noted.
    once = hinted(contents, rules).groupBy("blob").agg(F.first("content").alias("content"))
    todo = F.array_except(F.array(*map(F.lit, ids)), F.coalesce("seen", F.array().cast("array<string>")))
    unseen = once.join(seen, "blob", "left").select("blob", "content", todo.alias("todo")).where(F.size("todo") > 0)
    # Findings go first: a scan that fails in between is repeated, and equal findings count once.
    spans(unseen, rules).write.mode("append").parquet(f"{ledger}/findings")
    _note(addressed, seen, todo).write.mode("append").parquet(f"{ledger}/scanned")
    return addressed.join(by_blob(spark, ledger, rules), "blob", "left").select(
        "path", "blob", F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")).alias("found")
    )


def _note(addressed: DataFrame, seen: DataFrame, todo: Column) -> DataFrame:
    """The pairs just scanned, without the contents."""
    blobs = addressed.select("blob").distinct()
    return blobs.join(seen, "blob", "left").select("blob", todo.alias("rules")).where(F.size("rules") > 0)


def by_blob(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its sorted findings under the given rule versions."""
    current = _findings(spark, ledger).where(F.col("rule").isin([r.id for r in rules])).distinct()
    return current.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of sorted findings, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def without_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "path", content: str = "content") -> DataFrame:
    """The rows of ``docs`` whose content holds no secret, unchanged; the ledger is brought up to date."""
    scan(docs, ledger, rules, path, content)
    bad = by_blob(docs.sparkSession, ledger, rules).select("blob")
    return docs.join(bad, F.sha2(F.coalesce(docs[f"`{content}`"], F.lit("")), 256) == bad["blob"], "left_anti")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda f: f["kind"].isin(*kinds))


def fresh_ledger(spark: SparkSession) -> str:
    return session.fresh_path(spark, "secret-ledger")

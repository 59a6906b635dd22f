"""Allow or block urls by a sorted digest array.

Every entry of a list (a host, or a host and the start of a path, such as ``net/es/``) is kept
as its 64-bit xxhash in sorted shard files, next to the entry itself. A url is looked up by all
entries that could fit it: each of its host's suffixes that starts at a label, with each start of
its path that has the length of some entry's path. The keys are memory-mapped and probed by binary
search for a whole batch of urls at once; a key that is found counts only if the stored
string equals the candidate, so a collision of digests changes nothing.

Shard files lie in the shared folder, one per range of keys, written by the tasks that hold the
entries. There are as many shards as keep about ``SHARD_ENTRIES`` entries in each, so the task that sorts a shard holds no more of a
longer list. No list passes through the driver; a task that probes maps only the pages it touches.

Null urls and urls without ``://`` have an empty host and path and fit no entry. Repeated entries
count once; if one entry is listed with both verdicts, ``allow`` holds. Of fitting entries of one length the
last in string order counts. An empty list fits nothing; an empty table gives an empty result, repeated rows repeated ones.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydropanel import session
from hydropanel.llm.common import rowwise, staged, start

SHARD_ENTRIES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER), path


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        parsed = urlparse(uri)
        if parsed.scheme == "file":
            return pafs.LocalFileSystem(), unquote(parsed.path)
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def _write(uri: str, name: str, data: bytes) -> None:
    """Whole files only: a task that is run twice replaces its file by the same bytes."""
    fs, folder = _filesystem(uri)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{folder}/{name}")


@dataclass(frozen=True)
class Built:
    """Where an array lies, the distinct lengths of the paths in it (at most as many as a path has characters) and the leading bits of
    a key that number its shard."""

    folder: str
    lengths: list[int]
    bits: int


def digest(entry: bytes) -> int:
    return xxhash.xxh64_intdigest(entry, 42)


def build(entries: DataFrame, folder: str | None = None, shard_entries: int = SHARD_ENTRIES) -> Built:
    """Write the array of ``entries`` (entry string, verdict string)."""
    spark = start(entries.sparkSession)
    folder = folder or session.fresh_path(spark, "url-array")
    clean = staged(entries.where(F.length("entry") > 0).groupBy("entry").agg(F.min("verdict").alias("verdict")), "url-entries")
    bits = max(0, math.ceil(math.log2(max(1, clean.count()) / shard_entries)))
    number = F.shiftrightunsigned(F.xxhash64("entry"), 64 - bits) if bits else F.lit(0).cast("long")
    keyed = clean.withColumn("shard", number)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["shard"].iloc[0])
        stored = [e.encode() for e in pdf["entry"]]
        key = np.array([digest(e) for e in stored], dtype=np.uint64)
        order = sorted(range(len(stored)), key=lambda i: (key[i], stored[i]))
        offsets = np.zeros(len(stored) + 1, np.uint64)
        np.cumsum([len(stored[i]) for i in order], out=offsets[1:])
        _write(folder, f"{number}.text", b"".join(stored[i] for i in order))
        _write(folder, f"{number}.offsets", offsets.tobytes())
        _write(folder, f"{number}.allow", np.array([pdf["verdict"].iloc[i] == "allow" for i in order], np.uint8).tobytes())
        _write(folder, f"{number}.keys", key[order].tobytes())
        cut = sorted({len(e) - e.find("/") if "/" in e else 0 for e in pdf["entry"]})
        return pd.DataFrame({"path_length": cut})

    lengths = keyed.groupBy("shard").applyInPandas(shard, "path_length int").distinct()
    return Built(folder, sorted(r[0] for r in lengths.collect()), bits)


def _map(folder: str, name: str, kind) -> np.ndarray:
    """A file of the array: memory-mapped where the shared folder is mounted, else read once."""
    fs, path = _filesystem(f"{folder}/{name}")
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound or info.size == 0:
        return np.zeros(0, kind)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=kind)


class DigestArray:
    """The shards of one array as they are probed inside a task."""

    def __init__(self, built: Built) -> None:
        self.folder, self.bits, self.shards = built.folder, built.bits, {}

    def _shard(self, number: int):
        if number not in self.shards:
            self.shards[number] = tuple(_map(self.folder, f"{number}.{n}", k) for n, k in (("keys", np.uint64), ("offsets", np.uint64), ("text", np.uint8), ("allow", np.uint8)))
        return self.shards[number]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Per candidate -1 (not listed), 0 (block) or 1 (allow)."""
        found = np.full(len(candidates), -1, np.int8)
        key = np.array([digest(c) for c in candidates], dtype=np.uint64)
        shard = (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        for number in np.unique(shard):
            keys, offsets, text, allow = self._shard(int(number))
            if not len(keys):
                continue
            rows = np.flatnonzero(shard == number)
            at = np.searchsorted(keys, key[rows])
            rows, at = rows[at < len(keys)], at[at < len(keys)]
            for i, k in zip(rows[keys[at] == key[rows]], at[keys[at] == key[rows]], strict=True):
                while k < len(keys) and keys[k] == key[i]:  # strings that share a digest stand next to each other
                    if text[int(offsets[k]) : int(offsets[k + 1])].tobytes() == candidates[i]:
                        found[i] = allow[k]
                        break
                    k += 1
        return found


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every entry that could fit, longest host first."""
    if not host:
        return []
    labels, out = host.split("."), []
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        out += [suffix + path[:n] for n in lengths if n <= len(path)]
    return out


def judge(
    pages: DataFrame,
    rules: Built,
    sites: Built,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """key, host, path, rule (the longest entry of ``rules`` that fits, or null), verdict.

    The verdict is the rule's; without a rule it is that of the longest entry of ``sites`` that fits, and ``allow`` if none does. Both arrays come from :func:`build`. The output has the named columns only.
    """
    start(pages.sparkSession)
    host, path = host_and_path(F.col(f"`{url}`"))
    narrow = pages.select(F.col(f"`{key}`").alias("key"), host.alias("host"), path.alias("path"))
    state: dict = {}

    def run(batch) -> dict:
        hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = []
        for number, built in enumerate((rules, sites)):
            array = state.setdefault(number, DigestArray(built))
            fits = [candidates(h, p, built.lengths) for h, p in zip(hosts, paths, strict=True)]
            flat = sorted({c for f in fits for c in f})
            listed = dict(zip(flat, array.probe([c.encode() for c in flat]), strict=True))
            found.append([max(((len(c), c, listed[c]) for c in f if listed[c] >= 0), default=None) for f in fits])
        rule = [r and r[1] for r in found[0]]
        verdict = ["block" if (r or s) and not (r or s)[2] else "allow" for r, s in zip(*found, strict=True)]
        return {"rule": rule, "verdict": verdict}

    out = rowwise(narrow, ["key", "host", "path"], run, "rule string, verdict string")
    return out.withColumnRenamed("key", key)

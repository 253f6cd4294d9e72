"""URL filter over sorted digest arrays.

A list of strings (rules, blocked domains) is stored as shards in the shared
folder.  A shard holds its 64-bit xxhash keys in ascending order, then the
offsets and bytes of the full strings in the same order.  Tasks map the shards
into memory, so only the pages that a probe touches are read; a batch of
strings is probed by one vectorised binary search, and each match is confirmed
on the stored string, so colliding keys cannot lie.

Lists are built by Spark: entries are hashed, range-partitioned by key into
shards of about ``SHARD_ROWS`` entries and written one file per task; the
manifest of the shards (path, rows, first key) is a few rows whatever the list.

A rule is a host and a path.  It fits its host and all subdomains if the url's
path starts with the rule's; the longest fitting rule decides (host and path
together; at the same length the longer host).  Where no rule fits, a url is
blocked if its host or a parent domain is on the blocked list.  That is a table
of domains that the caller gives; without one it is derived from the pages: the
domain from the first label on that contains, as a hyphenated part, a word of
``SPAM_WORDS``.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed; a url without path fits no rule; repeated rows
are judged one by one; an empty list matches nothing.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import textarrays as ta
from foldwise.llm.frames import annotate, remote_fs, shared_path, stored

SHARD_ROWS = 2_000_000
# a general list of trades that url lists commonly block; nothing of it comes from
# the pages that are filtered
SPAM_WORDS = ("ads", "adserver", "adult", "bets", "betting", "bingo", "casino", "cialis", "escort", "gambling", "jackpot", "lottery",
              "malware", "phishing", "pills", "poker", "porn", "roulette", "sex", "slots", "spam", "spyware", "tracking", "viagra",
              "warez", "xxx")
# (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SEED = 42                      # the seed of Spark's xxhash64


def digest(text: str) -> int:
    """64-bit key, equal to Spark's xxhash64 of the string."""
    value = xxhash.xxh64_intdigest(text.encode(), SEED)
    return value - (1 << 64) if value >= 1 << 63 else value


def pack(keys: np.ndarray, offsets: np.ndarray, blob: bytes) -> bytes:
    """A shard's file: count, ascending keys, string offsets, strings."""
    return (np.array([len(keys)], "<i8").tobytes() + keys.astype("<i8").tobytes()
            + offsets.astype("<i8").tobytes() + blob)


class SortedDigestArray:
    """The shards of one list, memory-mapped and probed by binary search."""

    def __init__(self, shards: list[tuple[str, int, int]]):
        self.shards = [self._map(path) for path, n, _ in sorted(shards, key=lambda s: s[2]) if n]
        self.first = np.array([keys[0] for keys, _, _ in self.shards], dtype=np.int64)

    @staticmethod
    def _map(path: str):
        fs, base = remote_fs(path)
        if os.path.exists(base):
            raw = np.memmap(base, dtype=np.uint8, mode="r")
        else:                   # a store without files: map a private copy and unlink it
            with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(base) as source:
                while chunk := source.read(1 << 20):
                    copy.write(chunk)
                copy.flush()
                raw = np.memmap(copy.name, dtype=np.uint8, mode="r")
        n = int(raw[:8].view("<i8")[0])
        return raw[8:8 + 8 * n].view("<i8"), raw[8 + 8 * n:16 + 16 * n].view("<i8"), raw[16 + 16 * n:]

    def contains(self, texts: list[str]) -> np.ndarray:
        """True for each text that the list holds."""
        found = np.zeros(len(texts), dtype=bool)
        if not self.shards or not texts:
            return found
        wanted = np.fromiter((digest(t) for t in texts), np.int64, len(texts))
        shard = np.maximum(np.searchsorted(self.first, wanted, "right") - 1, 0)
        for s in np.unique(shard).tolist():
            keys, offsets, blob = self.shards[s]
            own = np.flatnonzero(shard == s)
            low = np.searchsorted(keys, wanted[own], "left")
            high = np.searchsorted(keys, wanted[own], "right")
            for i, a, b in zip(own.tolist(), low.tolist(), high.tolist()):
                if a < b:
                    text = texts[i].encode()
                    found[i] = any(blob[offsets[k]:offsets[k + 1]].tobytes() == text for k in range(a, b))
        return found


def build(entries: DataFrame, column: str, folder: str) -> list[tuple[str, int, int]]:
    """Write the distinct strings of ``column`` as shards below ``folder``;
    returns the manifest [(path, rows, first key)]."""
    def run(batches):
        keys, texts = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            texts.append(batch.column(1))
        n = sum(map(len, keys))
        if not n:
            return
        fs, base = remote_fs(folder)
        fs.create_dir(base, recursive=True)
        blob, offsets = ta.column_bytes(pa.chunked_array(texts))
        keys = np.concatenate(keys)
        name = f"{uuid.uuid4().hex}.digests"
        with fs.open_output_stream(f"{base}/{name}") as sink:
            sink.write(pack(keys, offsets, blob.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([int(keys[0])])], names=["path", "rows", "first"])

    rows = stored(entries.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().select(
        F.xxhash64("text").alias("key"), "text"), "digest-entries")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    manifest = stored(rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "text").mapInArrow(
        run, "path string, rows bigint, first bigint"), "digest-manifest")
    return [tuple(r) for r in manifest.collect()]        # one row per shard


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path (see the module for their definition)."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(given, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(given, pattern, 2)})


def spam_domains(parts: DataFrame, words: tuple[str, ...] = SPAM_WORDS) -> DataFrame:
    """The distinct domains, from the first label with a spam word on."""
    label = rf"(?:[^.]*-)?(?:{'|'.join(words)})(?:-[^.]*)?"
    domain = F.regexp_extract("host", rf"(?:^|\.)({label}(?:\..*)?)$", 1)
    return parts.select(domain.alias("domain")).where("domain <> ''").distinct()


def suffixes(host: str) -> list[str]:
    """The host and its parent domains."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def judge(parts: DataFrame, rules: list, blocked: list, verdicts: dict[str, str],
          keep: list[str] | None = None) -> DataFrame:
    """The rows of ``with_parts`` with rule and verdict.  ``rules`` and
    ``blocked`` are manifests; ``verdicts`` maps the rules to their verdicts."""
    lengths = sorted({len(r) - r.index("/") for r in verdicts if "/" in r}, reverse=True)

    def make():
        rule_list, block_list = SortedDigestArray(rules), SortedDigestArray(blocked)

        def compute(batch):
            hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                for suffix in suffixes(host):
                    for n in lengths:
                        if n <= len(path):
                            probes.append(suffix + path[:n])
                            owner.append(i)
            chosen: list[str | None] = [None] * len(hosts)
            hit = rule_list.contains(probes)
            for k in np.flatnonzero(hit).tolist():
                rule, i = probes[k], owner[k]
                best = chosen[i]
                if best is None or (len(rule), rule.index("/")) > (len(best), best.index("/")):
                    chosen[i] = rule
            names = sorted(set(hosts))
            domains = [s for h in names for s in suffixes(h)]
            bad = {d for d, hit in zip(domains, block_list.contains(domains)) if hit}
            verdict = [verdicts[r] if r is not None else "block" if any(s in bad for s in suffixes(h)) else "allow"
                       for r, h in zip(chosen, hosts)]
            return [chosen, verdict]
        return compute

    return annotate(parts, {"host": "host", "path": "path"}, [("rule", "string"), ("verdict", "string")], make, keep)


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", keep: list[str] | None = None,
                blocked: DataFrame | None = None) -> DataFrame:
    """``pages`` (or its ``keep`` columns) with host, path, rule and verdict.
    ``blocked``: a table with a column ``domain``, in lower case (nulls are left out)."""
    spark: SparkSession = pages.sparkSession
    folder = shared_path(spark, "digests")
    verdicts = {host + path: verdict for host, path, verdict in rules}
    listed = build(spark.createDataFrame([(r,) for r in verdicts], "rule string"), "rule", folder)
    parts = with_parts(pages, url)
    domains = spam_domains(parts) if blocked is None else blocked.select("domain").where("domain IS NOT NULL").distinct()
    blocked = build(domains, "domain", folder)
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path")] + ["host", "path"]
    return judge(parts, listed, blocked, verdicts, kept)


def brute_force(urls: list[str | None], rules=RULES, words=SPAM_WORDS) -> list[tuple]:
    """(host, path, rule, verdict) by definition (for tests)."""
    out = []
    for u in urls:
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            rest = rest[cut:]
            path = rest[:min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[2:] if fits else (None, None)
        if rule is None:
            verdict = "block" if any(set(label.split("-")) & set(words) for label in host.split(".")) else "allow"
        out.append((host, path, rule, verdict))
    return out

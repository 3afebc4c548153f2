"""URL allow and block lists in a sorted digest array that is memory-mapped and probed by binary search."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import share, shared

_UPPER = {c: c + 32 for c in range(65, 91)}

#: (action, host, path)
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path. Null or no "://": both empty."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:cut].translate(_UPPER), tail[:end]


@dataclass(frozen=True)
class Segment:
    """A part of the list: 64-bit keys in order, and in the same order the whole strings and actions they stand for."""

    keys: bytes
    starts: bytes
    strings: bytes
    blocks: bytes

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> Segment:
        made = sorted((xxhash.xxh64_intdigest(s := (host + path).encode()), s, action == "block") for action, host, path in rules)
        starts = np.zeros(len(made) + 1, np.int64)
        np.cumsum([len(s) for _, s, _ in made], out=starts[1:])
        return Segment(np.array([k for k, _, _ in made], np.uint64).tobytes(), starts.tobytes(), b"".join(s for _, s, _ in made), bytes(b for _, _, b in made))

    @property
    def size(self) -> int:
        return len(self.keys) + len(self.starts) + len(self.strings) + len(self.blocks)


class Probe:
    """A segment in a memory-mapped file of this worker; the system pages it in and out."""

    def __init__(self, segment: Segment):
        n = len(segment.blocks)
        with tempfile.TemporaryFile() as f:
            f.write(segment.keys + segment.starts + segment.strings + b"\0")
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.keys = np.frombuffer(self.map, np.uint64, n)
        self.starts = np.frombuffer(self.map, np.int64, n + 1, n * 8)
        self.base, self.blocks = n * 16 + 8, segment.blocks

    def find(self, strings: list[bytes]) -> list[int]:
        """The place of each string, or -1. Keys that collide lie side by side and are told apart by the stored strings."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        found = [-1] * len(strings)
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                if self.map[self.base + self.starts[j] : self.base + self.starts[j + 1]] == strings[i]:
                    found[i] = j
        return found


def _weight(rule: str) -> tuple[int, int]:
    """The longest rule decides; of one length, that which names more of the host. No two rules have both alike and fit one url."""
    return len(rule), rule.find("/") % (len(rule) + 1)


def _probe(held) -> Probe:
    """The segment's file, made once in each worker."""
    if not hasattr(held, "seqsift_probe"):
        held.seqsift_probe = Probe(shared(held))
    return held.seqsift_probe


def _judge(batches: Iterator[pa.RecordBatch], probe: Probe, lengths: list[int], default: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        urls = batch.column(names.index("__url")).to_pylist()
        parts = [split_url(u) for u in urls]
        where: dict[bytes, int] = {}
        tries: list[list[int]] = []
        for host, path in parts:
            labels, own = host.split("."), []
            for i in range(len(labels) if host else 0):
                suffix = ".".join(labels[i:])
                for n in lengths:
                    if n <= len(path) and suffix:
                        own.append(where.setdefault((suffix + path[:n]).encode(), len(where)))
            tries.append(own)
        strings = list(where)
        found = probe.find(strings)
        rules, verdicts = [], []
        old = zip(*(batch.column(names.index(c)).to_pylist() for c in ("rule", "verdict")), strict=True)
        for own, (rule, verdict) in zip(tries, old, strict=True):
            best = max((i for i in own if found[i] >= 0), key=lambda i: _weight(strings[i].decode()), default=None)
            if best is not None and (rule is None or _weight(strings[best].decode()) > _weight(rule)):
                rule, verdict = strings[best].decode(), "block" if probe.blocks[found[best]] else "allow"
            rules.append(rule)
            verdicts.append(verdict or default)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, c in enumerate(names) if c not in ("__url", "host", "path", "rule", "verdict")), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rules, verdicts))], names=[*(c for c in names if c not in ("__url", "host", "path", "rule", "verdict")), "host", "path", "rule", "verdict"])


def _segments(rules: DataFrame | Iterable[tuple[str, str, str]], size: int) -> tuple[list[int], Iterator[list[tuple[str, str, str]]]]:
    """The lengths of all paths, and the rules in parts of about ``size``. A table of rules is brought to the driver one part at a time."""
    if not isinstance(rules, DataFrame):
        made = sorted(dict.fromkeys((a, h.translate(_UPPER), p) for a, h, p in rules))
        if any(a not in ("allow", "block") or not h for a, h, _ in made):
            raise ValueError("a rule is (allow or block, host, path) with a host")
        if len({h + p for _, h, p in made}) < len(made):
            raise ValueError("two rules have the same host and path")
        return sorted({len(p) for _, _, p in made}), iter([made[i : i + size] for i in range(0, len(made), size)] or [[]])
    lower = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = rules.select("action", lower.alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    if not table.where("action is null or action not in ('allow', 'block') or coalesce(host, '') = ''").isEmpty():
        raise ValueError("a rule is (allow or block, host, path) with a host")
    if not table.groupBy(F.concat("host", "path")).count().where("count > 1").isEmpty():
        raise ValueError("two rules have the same host and path")
    lengths = sorted(r.n for r in table.select(F.length("path").alias("n")).distinct().collect())
    n = max(1, -(-table.count() // size))
    return lengths, (sorted(tuple(r) for r in table.where(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == i).collect()) for i in range(n))


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = BASE_RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", segment_rules: int = 1_000_000) -> DataFrame:
    """Judges every url: id, host, path, rule (host and path of the rule that decides, else null), verdict.

    ``rules`` are (action, host, path), as tuples or as a table with these columns. A rule fits its host and all
    subdomains if the url's path starts with the rule's; of the rules that fit the longest decides, of several that
    which names more of the host, else ``default``. Null urls and urls without "://" have an empty host and path and fit
    no rule. Rows are kept one for one, repeated ones and those with a null id too; an empty table gives an empty
    result; an empty list lets everything be judged by ``default``; other columns are not read.

    The list is cut into segments of about ``segment_rules`` rules. Each is broadcast in one map-only pass over the
    pages, so no list is too long for an executor's memory and no pass shuffles; how it is cut doesn't change verdicts.
    """
    lengths, parts = _segments(rules, segment_rules)
    spark = pages.sparkSession
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("__url"), *(F.lit(None).cast("string").alias(c) for c in ("host", "path", "rule", "verdict")))
    for part in parts:
        held = share(spark, Segment.build(part))

        def run(batches, held=held):
            probe = _probe(held)
            for batch in batches:
                for judged in _judge(iter([batch]), probe, lengths, ""):
                    yield judged.append_column("__url", batch.column(batch.schema.names.index("__url"))).select(batch.schema.names)

        out = out.mapInArrow(run, out.schema).withColumn("verdict", F.expr("nullif(verdict, '')"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; nulls, ties and repeats as in :func:`filter_urls`."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict FROM u
      LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""

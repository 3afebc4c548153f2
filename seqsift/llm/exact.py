"""Exact deduplication with an extendible-hash index whose pages lie in shared files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import Workspace, as_rows, broadcast_if_few, part, unpacked

# Runs of white space that are not one space already.
_RUN = re.compile(r"[\t-\r][ \t-\r]*| [ \t-\r]+")
#: Bytes of distinct texts that a task remembers, so that it sends a text that comes again and again only once.
REMEMBERED = 32 << 20


def normalised(text: str | None) -> str:
    return _RUN.sub(" ", text or "")


def _order(doc_id: object, row: int) -> tuple:
    return (doc_id is None, doc_id if doc_id is not None else 0, row)


def _pages(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One entry for each row. The first of equal texts in a batch carries the batch's count and smallest id, and the bytes
    unless this task has sent them already (and compares with what it sent)."""
    schema = pa.schema([("doc_id", id_type), ("row_no", pa.int64()), ("sha", pa.binary()), ("key", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("low_id", id_type), ("low_row", pa.int64()), ("body", pa.binary())])
    sent: dict[bytes, bytes] = {}
    held = 0
    for batch in batches:
        rows, first = [], {}
        for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_no", "text")), strict=True):
            body = normalised(text).encode()
            sha = hashlib.sha256(body).digest()
            entry = {"doc_id": doc_id, "row_no": row, "sha": sha, "key": int.from_bytes(sha[:8], "big", signed=True)}
            rows.append(entry)
            seen = first.get(sha)
            if seen is not None and seen[1] == body:
                seen[0]["n"] += 1
                if _order(doc_id, row) < _order(seen[0]["low_id"], seen[0]["low_row"]):
                    seen[0]["low_id"], seen[0]["low_row"] = doc_id, row
                continue
            entry.update(n=1, low_id=doc_id, low_row=row)
            first[sha] = entry, body
            if sent.get(sha) != body:
                entry.update(size=len(body), body=body)
                held += len(body) - len(sent.pop(sha, b""))
                sent[sha] = body
                while held > REMEMBERED and len(sent) > 1:
                    held -= len(sent.pop(next(iter(sent))))
        yield pa.RecordBatch.from_pylist(rows, schema)


class Directory:
    """Leading key bits to buckets. An overfull bucket splits by its next bit; the directory doubles when that bucket already uses all its bits."""

    def __init__(self, sizes: dict[int, int], bits: int, capacity: int):
        """``sizes``: bytes under each prefix of ``bits`` bits."""
        self.bits, self.depth, self.slots = bits, 0, [0]
        self.local, self.members, prefix = [0], [sorted(sizes.items())], [0]
        queue = [0]
        while queue:
            b = queue.pop()
            if sum(s for _, s in self.members[b]) <= capacity or self.local[b] == bits or len(self.members[b]) < 2:
                continue  # what cannot split further is walked as it is, in key order
            if self.local[b] == self.depth:
                self.slots = [x for x in self.slots for _ in (0, 1)]
                self.depth += 1
            self.local[b] += 1
            bit = bits - self.local[b]
            new = len(self.local)
            self.local.append(self.local[b])
            self.members.append([m for m in self.members[b] if m[0] >> bit & 1])
            self.members[b] = [m for m in self.members[b] if not m[0] >> bit & 1]
            prefix[b] <<= 1
            prefix.append(prefix[b] | 1)
            width = 1 << self.depth - self.local[b]
            self.slots[prefix[new] * width : (prefix[new] + 1) * width] = [new] * width
            queue += [b, new]

    def __len__(self) -> int:
        return len(self.local)

    def bucket(self, prefix: int) -> int:
        return self.slots[prefix >> (self.bits - self.depth)]


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the texts of its key range in key order. Different texts with one key are chained; each class comes out once, with its place in the chain."""
    schema = pa.schema([("sha", pa.binary()), ("chain", pa.int64())])
    key, chain = None, []
    for batch in batches:
        out = []
        for k, sha, body in zip(*(batch.column(c).to_pylist() for c in ("key", "sha", "body")), strict=True):
            if k != key:
                key, chain = k, []
            if any(c == body for _, c in chain):
                continue
            if any(c == sha for c, _ in chain):
                raise ValueError("two different texts have one SHA-256")
            out.append({"sha": sha, "chain": len(chain)})
            chain.append((sha, body))
        yield pa.RecordBatch.from_pylist(out, schema)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 32 << 20, bits: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and row_no (the row's number).

    Texts are equal when they are the same bytes after each run of white space became one space; null counts as
    empty. Of equal texts the row with the smallest id stays; of repeated rows with one id, exactly one stays; null
    ids come last. Ids are of any type that has an order. An empty table gives an empty result. Other columns of
    ``docs`` are not read.

    Entries are written as index pages to the shared folder; a task that meets a text again compares bytes and writes
    only a count. Directory doubling over prefixes of ``bits`` bits (by default as many as ``capacity`` asks for, 14 to
    20) splits the keys into buckets of about ``capacity`` bytes; owner tasks walk their key ranges in order, compare
    bytes and chain different texts with equal keys. What they hold is one key's chain, whatever a bucket's size.
    """
    return _find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), Workspace(docs.sparkSession, "exact"), capacity, bits)


def _find(slim: DataFrame, work: Workspace, capacity: int = 32 << 20, bits: int | None = None) -> DataFrame:
    spark, kind = slim.sparkSession, slim.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, t) for c, t in (("row_no", T.LongType()), ("sha", T.BinaryType()), ("key", T.LongType()), ("size", T.LongType()), ("n", T.LongType()), ("low_id", kind), ("low_row", T.LongType()), ("body", T.BinaryType())))])
    pages = work.table(slim.select("doc_id", F.monotonically_increasing_id().alias("row_no"), "text").mapInArrow(lambda b: _pages(b, id_type), schema))
    if bits is None:
        total = pages.agg(F.sum("size")).first()[0] or 0
        bits = min(20, max(14, (total // capacity).bit_length() + 2))
    prefix = F.shiftrightunsigned("key", 64 - bits)
    bodies = pages.where("body is not null").select("key", "sha", "body", prefix.alias("prefix"))
    sizes = {r.prefix: r.s for r in pages.where("body is not null").groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("s")).collect()}  # 2**bits rows at most
    directory = Directory(sizes, bits, capacity)
    slots = spark.createDataFrame([(p, directory.bucket(p)) for p in sizes] or [(0, 0)], "prefix long, bucket int")
    owned = bodies.join(F.broadcast(slots), "prefix").repartition(len(directory), "bucket").sortWithinPartitions("key", "sha")
    owned = owned.mapInArrow(_owner, "sha binary, chain long")
    # Counts and smallest ids are combined in each task before they are shuffled.
    lowest = F.struct(F.col("low_id").isNull().alias("none"), F.col("low_id").alias("id"), F.col("low_row").alias("row"))
    counts = pages.where("n is not null").groupBy("sha").agg(F.sum("n").alias("group_size"), F.min(lowest).alias("low"))
    classes = work.table(counts.join(owned, "sha").select("sha", F.col("low.id").alias("keep_id"), F.col("low.row").alias("keep_row"), "group_size"))
    return pages.select("doc_id", "row_no", "sha").join(classes, "sha").select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row_no")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay in :func:`exact_duplicates`, with all their columns, whatever these are called; of repeated rows, one."""
    pages, work = Workspace(docs.sparkSession, "exact"), Workspace(docs.sparkSession, "exact-kept")
    rows = as_rows(docs)
    text = F.coalesce(part(text_col).cast("string"), F.lit(""))
    sha = F.sha2(F.regexp_replace(text, "[\\t-\\r][ \\t-\\r]*| [ \\t-\\r]+", " "), 256)
    found = work.table(_find(rows.select(part(id_col).alias("doc_id"), part(text_col).cast("string").alias("text")), pages, **options).select("doc_id", "keep_id", "kept", "text_sha256"))
    pages.clear()
    same = lambda marks: part(id_col).eqNullSafe(marks["gone_id"]) & (sha == marks["gone_sha"])
    marks = found.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "kept")
    if found.where("not kept and doc_id <=> keep_id").isEmpty():
        gone = broadcast_if_few(work.table(marks.where("not kept").drop("kept")))
        return unpacked(rows.join(gone, same(gone), "left_anti"))
    # An id comes twice with one text, so ids alone don't tell which row stays.
    stay = marks.where("kept").drop("kept")
    return unpacked(rows.join(stay, same(stay), "left_semi").groupBy(part(id_col).alias("gone_id"), sha.alias("gone_sha")).agg(F.first("row").alias("row")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; nulls, ties and repeats as in :func:`exact_duplicates`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs).drop("row_no")


OP7_SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

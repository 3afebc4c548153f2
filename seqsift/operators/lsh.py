"""A locality-sensitive index of shingles: p-stable projections, multi-probe look-up, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsift.model import Distance, QuerySpec, SeqSiftError
from seqsift.operators.refine import allowed_tracks
from seqsift.operators.shingles import shingles


@dataclass(frozen=True)
class Family:
    """L tables of k projections: floor((a . v + b) / w) for shingles scaled by 1 / sqrt(radius)."""

    dim: int
    k: int = 6
    tables: int = 10
    w: float = 4.0
    seed: int = 1

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.tables * self.k, self.dim)), rng.uniform(0, self.w, self.tables * self.k)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (row, table, function) and how far each projection is into its cell, from 0 to 1."""
        a, b = self.projections()
        raw = ((x @ a.T + b) / self.w).reshape(len(x), self.tables, self.k)
        cells = np.floor(raw)
        return cells.astype(np.int64), raw - cells


def _mix(cells: np.ndarray) -> np.ndarray:
    """A 64-bit key of the k cells in each table; accidental collisions are removed by re-ranking."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        h = (h ^ cells[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def probes(into: np.ndarray, extra: int) -> list[tuple[tuple[int, int], ...]]:
    """The ``extra`` nearest perturbations of one table's cells, as sets of (function, -1 or 1), by rising sum of squared
    distances to the boundaries crossed; never both directions of one function."""
    import heapq

    k = len(into)
    steps = sorted([(into[i] ** 2, i, -1) for i in range(k)] + [((1 - into[i]) ** 2, i, 1) for i in range(k)])
    heap, out = [(steps[0][0], (0,))], []
    while heap and len(out) < extra:
        score, chosen = heapq.heappop(heap)
        if len({steps[j][1] for j in chosen}) == len(chosen):
            out.append(tuple((steps[j][1], steps[j][2]) for j in chosen))
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (score - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + steps[last + 1][0], (*chosen, last + 1)))
    return out


def _hashes(batches: Iterator[pa.RecordBatch], family: Family, scale: float, normed: bool, extra: int, ids: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids..., sh) to (ids..., table_id, bucket): one for each table and probe."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sh = batch.column(ids)
        x = np.asarray(sh.flatten()).reshape(n, family.dim)
        norm = np.linalg.norm(x, axis=1) if normed else np.ones(n)
        ok = np.flatnonzero(norm > 0)
        x = x[ok] / (norm[ok, None] * scale)
        cells, into = family.cells(x)
        keys = [_mix(cells)]
        for r in range(extra):
            keys.append(np.zeros(keys[0].shape, np.int64))
        if extra:
            for i in range(len(ok)):
                for t in range(family.tables):
                    for r, moves in enumerate(probes(into[i, t], extra)):
                        moved = cells[i, t].copy()
                        for f, d in moves:
                            moved[f] += d
                        keys[r + 1][i, t] = _mix(moved[None])[0]
        rows = np.repeat(ok, family.tables * (1 + extra))
        table = np.tile(np.repeat(np.arange(family.tables), 1 + extra), len(ok))
        bucket = np.stack(keys, 2).ravel()
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(ids)), pa.array(table, pa.int32()), pa.array(bucket, pa.int64())], names=[*batch.schema.names[:ids], "table_id", "bucket"])


@dataclass
class Index:
    """Buckets of all shingles of one length, for one radius, with or without normalising."""

    spark: SparkSession
    path: str
    family: Family
    length: int
    radius: float
    normed: bool
    vectors: DataFrame
    extra_probes: int = 1

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, length: int, radius: float, normed: bool, k: int = 6, tables: int = 10, w: float = 4.0, seed: int = 1, extra_probes: int = 1) -> Index:
        """Writes table_id, bucket, track_id, pos in Parquet, a folder for each table. No bucket has a limit."""
        spark = vectors.sparkSession
        first = vectors.select(F.size("vec").alias("n")).first()
        made = cls(spark, path, Family((first.n if first else 1) * length, k, tables, w, seed), length, radius, normed, vectors, extra_probes)
        made.hashed(vectors).write.mode("errorifexists").partitionBy("table_id").parquet(f"{path}/buckets")
        spark.createDataFrame([(length, radius, normed, made.family.dim, k, tables, w, seed, extra_probes)], "length int, radius double, normed boolean, dim int, k int, tables int, w double, seed int, extra_probes int").write.parquet(f"{path}/params")
        return made

    @classmethod
    def load(cls, spark: SparkSession, path: str, vectors: DataFrame) -> Index:
        p = spark.read.parquet(f"{path}/params").first()
        return cls(spark, path, Family(p.dim, p.k, p.tables, p.w, p.seed), p.length, p.radius, p.normed, vectors, p.extra_probes)

    def hashed(self, vectors: DataFrame) -> DataFrame:
        sh = shingles(vectors, self.length).select("track_id", "pos", "sh")
        family, scale, normed = self.family, self.radius**0.5, self.normed
        return sh.mapInArrow(lambda b: _hashes(b, family, scale, normed, 0, 2), "track_id int, pos int, table_id int, bucket long")

    def append(self, vectors: DataFrame) -> None:
        """Adds new tracks, with the same parameters."""
        self.hashed(vectors).write.mode("append").partitionBy("table_id").parquet(f"{self.path}/buckets")
        self.vectors = self.vectors.unionByName(vectors)

    def merge(self, other: Index) -> None:
        """Adds another index's buckets. Both were built with the same parameters, over tracks of different numbers."""
        own, its = ((x.family, x.length, x.radius, x.normed) for x in (self, other))
        if own != its:
            raise SeqSiftError("indexes of different parameters can't be merged")
        if not self.buckets().select("track_id").distinct().join(other.buckets().select("track_id").distinct(), "track_id").isEmpty():
            raise SeqSiftError("both indexes have vectors of one track")
        other.buckets().write.mode("append").partitionBy("table_id").parquet(f"{self.path}/buckets")
        self.vectors = self.vectors.unionByName(other.vectors)

    def buckets(self) -> DataFrame:
        return self.spark.read.schema("bucket long, track_id int, pos int, table_id int").parquet(f"{self.path}/buckets")

    def serves(self, spec: QuerySpec) -> bool:
        """Only for the radius, length and kind of distance that it was built for; never for products or divergences."""
        kind = {True: Distance.NORMED, False: Distance.EUCLIDEAN}[self.normed]
        return spec.params.distance is kind and spec.refine.radius is not None and abs(spec.refine.radius - self.radius) < 1e-9 and spec.qid.length == self.length

    def candidates(self, q) -> DataFrame:
        """track_id, ipos, qpos of shingles that share a bucket with a query's, each once."""
        family, scale, normed, extra = self.family, self.radius**0.5, self.normed, self.extra_probes
        sought = q.query_shingles().select("qpos", "qsh").mapInArrow(lambda b: _hashes(b, family, scale, normed, extra, 1), "qpos int, table_id int, bucket long")
        found = self.buckets().join(sought, ["table_id", "bucket"]).select("track_id", F.col("pos").alias("ipos"), "qpos")
        return found.distinct()

    def points(self, q) -> DataFrame:
        """Candidates measured exactly, under all refinements."""
        return q.measured(self.candidates(q).join(q.target_shingles(), ["track_id", "ipos"]).join(q.query_shingles(), "qpos"))

    def approximate(self, q) -> DataFrame:
        """Candidates as they are, with the radius for a distance. Keys and hops are respected."""
        refine = q.spec.refine
        keys = allowed_tracks(self.vectors.select("track_id", "key").distinct(), refine)
        rows = self.candidates(q).join(keys, "track_id").where(F.col("ipos") % max(1, refine.ihop) == 0)
        qkey = q.query_shingles().select("qpos", "qkey")
        return rows.join(qkey, "qpos").select("track_id", "qkey", F.col("key").alias("ikey"), "qpos", "ipos", F.lit(float(self.radius)).alias("dist"))

    def statistics(self) -> DataFrame:
        """For each table: points, buckets, their mean and largest size."""
        sizes = self.buckets().groupBy("table_id", "bucket").agg(F.count("*").alias("n"))
        return sizes.groupBy("table_id").agg(F.sum("n").alias("points"), F.count("*").alias("buckets"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"))


class Catalog:
    """The indexes of one collection, in folders named by radius, length and kind: a query finds its index by itself.

    An index that was found is kept, so that a run of like queries reads its parameters once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._kept: dict[str, Index] = {}

    def folder(self, radius: float, length: int, normed: bool) -> str:
        return f"{self.path}/lsh.{radius:019.9f}.{length}.{'normed' if normed else 'plain'}"

    def build(self, vectors: DataFrame, *, radius: float, length: int, normed: bool, **options) -> Index:
        made = Index.build(vectors, self.folder(radius, length, normed), length=length, radius=radius, normed=normed, **options)
        self._kept[made.path] = made
        return made

    def find(self, vectors: DataFrame, spec: QuerySpec) -> Index | None:
        """The index that serves a query, if it was built."""
        radius = spec.refine.radius
        if radius is None or spec.params.distance not in (Distance.NORMED, Distance.EUCLIDEAN):
            return None
        path = self.folder(radius, spec.qid.length, spec.params.distance is Distance.NORMED)
        if path not in self._kept:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/params/_SUCCESS")
            if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
                return None
            self._kept[path] = Index.load(self.spark, path, vectors)
        self._kept[path].vectors = vectors
        return self._kept[path]

"""The planner: checks a query, chooses between scan and index, and lays out the DataFrame plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsift.functions.vectors import distance
from seqsift.model import Accumulation, Distance, Params, QueryId, QuerySpec, Refine, SeqSiftError
from seqsift.operators.accumulate import accumulate, best_per_track, track_means
from seqsift.operators.refine import allowed_tracks, duration_fits, powers_fit, within_radius
from seqsift.operators.shingles import mean_durations, once, shingles

#: Query shingles are broadcast up to this many bytes, and dealt out otherwise.
BROADCAST_BYTES = 64 << 20


def _dim(vectors: DataFrame) -> int | None:
    row = vectors.select(F.size("vec").alias("n")).first()
    return row.n if row else None


class Query:
    """A spec and its datum, checked against the vectors it is put to."""

    def __init__(self, vectors: DataFrame, datum: DataFrame, spec: QuerySpec, dim: int | None = None):
        self.vectors, self.datum, self.spec = vectors, datum, spec
        qid, refine = spec.qid, spec.refine
        wanted = [F.count("*").alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.max("pos").alias("last")]
        for c in ("power", "t_start", "t_end"):
            wanted.append((F.count(c) if c in datum.columns else F.lit(0)).alias(c))
        facts = datum.agg(*wanted).first()
        if not facts.n:
            raise SeqSiftError("the query has no vectors")
        self.dim = dim if dim is not None else _dim(vectors)
        if facts.low != facts.high or (self.dim is not None and facts.low != self.dim):
            raise SeqSiftError("the query's vectors have another dimension")
        self.dim = facts.low
        if qid.start + qid.length > facts.n:
            raise SeqSiftError("the query is shorter than the sequence asked for")
        if refine.needs_power and (facts.power < facts.n or "power" not in vectors.columns):
            raise SeqSiftError("power thresholds need powers on both sides")
        if refine.duration_ratio is not None and (facts.t_start < facts.n or facts.t_end < facts.n or "t_start" not in vectors.columns):
            raise SeqSiftError("a duration ratio needs times on both sides")
        self.n = facts.n

    def query_shingles(self) -> DataFrame:
        """qkey, qpos, qsh, qnorm, qpow of the positions sought."""
        qid, refine = self.spec.qid, self.spec.refine
        datum = self.datum if "key" in self.datum.columns else self.datum.withColumn("key", F.lit(None).cast("string"))
        if not qid.exhaustive:
            datum = datum.where(F.col("pos").between(qid.start, qid.start + qid.length - 1))
        made = datum.select(F.lit(0).alias("track_id"), "key", (F.col("pos") - (0 if qid.exhaustive else qid.start)).alias("pos"), "vec", *(["power"] if refine.needs_power else []))
        sh = shingles(made, qid.length, power=refine.needs_power, dim=self.dim)
        sh = sh.withColumn("pos", F.col("pos") + (0 if qid.exhaustive else qid.start)).where(F.col("pos") % max(1, refine.qhop) == 0)
        out = sh.select(F.col("key").alias("qkey"), F.col("pos").alias("qpos"), F.col("sh").alias("qsh"), F.col("norm").alias("qnorm"), *([F.col("pow").alias("qpow")] if refine.needs_power else []))
        if refine.absolute_threshold is not None:
            out = out.where(F.col("qpow") >= refine.absolute_threshold)
        count = self.n if qid.exhaustive else 1
        return F.broadcast(out) if count * self.dim * qid.length * 8 <= BROADCAST_BYTES else out

    def target_vectors(self) -> DataFrame:
        """The vectors of tracks that may match: keys, and durations before anything is paired."""
        refine = self.spec.refine
        rows = allowed_tracks(self.vectors, refine)
        if refine.duration_ratio is not None:
            own = self.datum.agg(F.avg(F.col("t_end") - F.col("t_start")).alias("d")).first().d
            fit = mean_durations(rows).where(duration_fits(F.col("duration"), own, refine.duration_ratio)).select("track_id")
            rows = rows.join(fit, "track_id", "left_semi")
        return rows

    def target_shingles(self) -> DataFrame:
        """track_id, ikey, ipos, sh, norm, ipow; hops and the absolute threshold are applied before anything is paired."""
        refine = self.spec.refine
        sh = shingles(self.target_vectors(), self.spec.qid.length, power=refine.needs_power, dim=self.dim, hop=max(1, refine.ihop))
        out = sh.select("track_id", F.col("key").alias("ikey"), F.col("pos").alias("ipos"), "sh", "norm", *([F.col("pow").alias("ipow")] if refine.needs_power else []))
        return out.where(F.col("ipow") >= refine.absolute_threshold) if refine.absolute_threshold is not None else out

    def measured(self, pairs: DataFrame) -> DataFrame:
        """Distances of pairs of shingles, less those that the refinements rule out."""
        p, refine = self.spec.params, self.spec.refine
        if refine.needs_power:
            pairs = pairs.where(powers_fit(refine, F.col("qpow"), F.col("ipow")))
        d = distance(p.distance, F.col("qsh"), F.col("sh"), F.col("qnorm"), F.col("norm"), self.dim * self.spec.qid.length, p.kl_asymmetric)
        out = pairs.select("track_id", "qkey", "ikey", "qpos", "ipos", once(d).alias("dist"))
        return out.where(within_radius(F.col("dist"), refine.radius)) if refine.radius is not None else out

    def points(self) -> DataFrame:
        """All points by exhaustive comparison: a nested-loop join whose query side is broadcast."""
        return self.measured(self.target_shingles().crossJoin(self.query_shingles()))


def search(vectors: DataFrame, datum: DataFrame, spec: QuerySpec, *, index=None, catalog=None, sofar: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Answers a query: track_id, qkey, ikey, qpos, ipos, dist, rank (and track_rank), best first by rank.

    With an index that fits the radius, length and distance, candidates come from it and are measured exactly
    afterwards (or returned as they are if false positives are allowed); otherwise every alignment is measured. A
    catalog is asked for such an index.
    ``sofar`` has results of an earlier query that compete with the new ones.
    """
    q = Query(vectors, datum, spec, dim)
    if index is None and catalog is not None:
        index = catalog.find(vectors, spec)
    if index is not None and index.serves(spec):
        points = index.approximate(q) if spec.qid.allow_false_positives else index.points(q)
    else:
        points = q.points()
    if sofar is not None:
        points = sofar.select(*points.columns).unionByName(points)
    return accumulate(points, spec.params)


def track_datum(vectors: DataFrame, key: str) -> DataFrame:
    """A stored track as a query."""
    found = vectors.where(F.col("key") == key)
    if found.isEmpty():
        raise SeqSiftError(f"no track has the key {key!r}")
    return found


def matched_filter(vectors: DataFrame, datum: DataFrame, spec: QuerySpec) -> DataFrame:
    """:func:`search` for DOT, NORMED and EUCLIDEAN by sums along diagonals: cheaper for long sequences. No power or duration refinements."""
    from seqsift.operators.shingles import diagonal_dots, sliding

    q = Query(vectors, datum, spec)
    qid, refine, p = spec.qid, spec.refine, spec.params
    if p.distance is Distance.KL or refine.needs_power or refine.duration_ratio is not None:
        raise SeqSiftError("not with a matched filter")
    rows = allowed_tracks(vectors, refine)
    own = datum if qid.exhaustive else datum.where(F.col("pos").between(qid.start, qid.start + qid.length - 1))
    dots = diagonal_dots(rows, F.broadcast(own) if q.n * q.dim * 8 <= BROADCAST_BYTES else own, qid.length, q.dim)
    from seqsift.functions.vectors import squared_norm

    def norms(source: DataFrame, pos: str, out: str, keys: list[str]) -> DataFrame:
        n2 = source.withColumn("n2", squared_norm(F.col("vec"), q.dim))
        n2 = n2 if "track_id" in n2.columns and keys else n2.withColumn("track_id", F.lit(0))
        lowest = 0 if qid.exhaustive or keys else qid.start
        shifted = n2.select("track_id", (F.col("pos") - lowest).alias("pos"), "n2")
        return sliding(shifted, qid.length, {"s": F.sum("n2")}).select(*keys, (F.col("pos") + lowest).alias(pos), F.col("s").alias(out))

    d = dots.join(norms(rows, "ipos", "ni", ["track_id"]), ["track_id", "ipos"]).join(F.broadcast(norms(own, "qpos", "nq", [])), "qpos")
    d = d.where((F.col("qpos") % max(1, refine.qhop) == 0) & (F.col("ipos") % max(1, refine.ihop) == 0))
    dist = {Distance.DOT: F.col("dot"), Distance.NORMED: 2.0 - F.try_divide(2.0 * F.col("dot"), F.sqrt("ni") * F.sqrt("nq")), Distance.EUCLIDEAN: F.col("ni") + F.col("nq") - 2.0 * F.col("dot")}[p.distance]
    out = d.select("track_id", F.lit(None).cast("string").alias("qkey"), F.col("key").alias("ikey"), "qpos", "ipos", dist.alias("dist"))
    return accumulate(out.where(within_radius(F.col("dist"), refine.radius)) if refine.radius is not None else out, p)


# Query types by their usual names.


def point_query(vectors: DataFrame, datum: DataFrame, npoints: int = 10, refine: Refine | None = None, start: int = 0) -> DataFrame:
    """The vectors with the largest dot products."""
    return search(vectors, datum, QuerySpec(QueryId(1, start), Params(Distance.DOT, Accumulation.DB, npoints), refine or Refine()))


def track_query(vectors: DataFrame, datum: DataFrame, npoints: int = 10, ntracks: int = 10, refine: Refine | None = None, start: int = 0) -> DataFrame:
    """The tracks with the largest mean of their best dot products."""
    return search(vectors, datum, QuerySpec(QueryId(1, start), Params(Distance.DOT, Accumulation.PER_TRACK, npoints, ntracks), refine or Refine()))


def sequence_query(vectors: DataFrame, datum: DataFrame, length: int, npoints: int = 10, ntracks: int = 10, kind: Distance = Distance.NORMED, refine: Refine | None = None, start: int = 0) -> DataFrame:
    """The best tracks and the mean distance of their best alignments."""
    params = Params(kind, Accumulation.PER_TRACK, npoints, ntracks)
    q = Query(vectors, datum, QuerySpec(QueryId(length, start), params, refine or Refine()))
    return track_means(best_per_track(q.points(), params), params)


def n_sequence_query(vectors: DataFrame, datum: DataFrame, length: int, npoints: int = 10, ntracks: int = 10, kind: Distance = Distance.NORMED, refine: Refine | None = None, start: int = 0) -> DataFrame:
    """The best tracks with their best alignments."""
    return search(vectors, datum, QuerySpec(QueryId(length, start), Params(kind, Accumulation.PER_TRACK, npoints, ntracks), refine or Refine()))


def one_to_one_query(vectors: DataFrame, datum: DataFrame, length: int, radius: float = math.inf, kind: Distance = Distance.NORMED, refine: Refine | None = None) -> DataFrame:
    """The nearest alignment for each position of the query."""
    from dataclasses import replace

    refine = replace(refine or Refine(), radius=None if math.isinf(radius) else radius)
    return search(vectors, datum, QuerySpec(QueryId(length, 0, True), Params(kind, Accumulation.ONE_TO_ONE), refine))

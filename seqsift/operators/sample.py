"""Distances of random pairs of shingles, from which a radius can be estimated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsift.functions.vectors import distance, is_distance, threshold_estimate
from seqsift.model import Distance, QueryId, Refine, SeqSiftError
from seqsift.operators.refine import allowed_tracks
from seqsift.operators.shingles import shingles


def _draw(sh: DataFrame, n: int, seed: int, what: str) -> DataFrame:
    """n random shingles with repetition: a uniform shingle is a track by its number of shingles, then a position."""
    total = sh.count()
    if not total:
        raise SeqSiftError(f"{what} has no sequence to draw from")
    # Each shingle is drawn a Poisson number of times of mean 2n / total, so enough come; a random order then picks n.
    rate = 2.0 * n / total + 12.0 * (2.0 * n) ** 0.5 / total + 20.0 / total
    most = max(4, int(rate + 12 * rate**0.5 + 12))
    u = F.rand(seed)
    term, cdf, probabilities = 2.718281828459045 ** (-rate), 0.0, []
    for k in range(most):
        cdf += term
        probabilities.append(cdf)
        term *= rate / (k + 1)
    # Beyond 600 a Poisson number hardly differs from its mean.
    k = F.size(F.filter(F.lit(probabilities), lambda p: p < F.col("__u"))) if rate < 600 else F.lit(int(rate))
    rows = sh.withColumn("__u", u).withColumn("__k", k).where("__k > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__k"))))
    return rows.withColumn("__order", F.rand(seed + 1)).orderBy("__order").limit(n).drop("__u", "__k", "__copy")


def _numbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("__i", F.row_number().over(Window.orderBy("__order"))).drop("__order")  # at most the sample's size


def sample_distances(vectors: DataFrame, n: int, *, qid: QueryId | None = None, kind: Distance = Distance.EUCLIDEAN, datum: DataFrame | None = None, refine: Refine | None = None, seed: int = 1) -> DataFrame:
    """n rows of qkey, ikey, qpos, ipos, dist for random pairs.

    Without a datum both shingles are drawn from the collection, from different tracks; with one, the query's is at
    its start, or drawn as well if exhaustive. Pairs whose distance isn't finite (a norm of 0 under NORMED) are drawn
    anew. Powers play no part; a radius or a duration ratio makes no sense here, and neither does a divergence.
    """
    qid, refine = qid or QueryId(), refine or Refine()
    if kind is Distance.KL or refine.radius is not None or refine.duration_ratio is not None:
        raise SeqSiftError("samples have neither divergences nor radius nor duration ratio")
    length = qid.length
    sh = shingles(allowed_tracks(vectors, refine), length, hop=max(1, refine.ihop))
    if datum is not None:
        named = datum if "key" in datum.columns else datum.withColumn("key", F.lit(None).cast("string"))
        own = shingles(named.select(F.lit(-1).alias("track_id"), "key", "pos", "vec"), length)
        own = own.where(F.col("pos") % max(1, refine.qhop) == 0) if qid.exhaustive else own.where(F.col("pos") == qid.start)
    elif sh.select("track_id").distinct().limit(2).count() < 2:
        raise SeqSiftError("pairs need two tracks")
    out, turn = None, 0
    while out is None or out.count() < n:
        more = 2 * n + 16
        right = _numbered(_draw(sh, more, seed + 100 * turn, "the collection")).select("__i", "track_id", F.col("key").alias("ikey"), F.col("pos").alias("ipos"), "sh", "norm")
        source = _draw(sh if datum is None else own, more, seed + 100 * turn + 50, "the query")
        left = _numbered(source).select("__i", F.col("track_id").alias("__t"), F.col("key").alias("qkey"), F.col("pos").alias("qpos"), F.col("sh").alias("qsh"), F.col("norm").alias("qnorm"))
        pairs = left.join(right, "__i").where(F.col("__t") != F.col("track_id"))
        made = pairs.select("qkey", "ikey", "qpos", "ipos", distance(kind, F.col("qsh"), F.col("sh"), F.col("qnorm"), F.col("norm")).alias("dist"))
        made = made.where(is_distance(F.col("dist")) & (F.abs("dist") != float("inf")))
        out = made if out is None else out.unionByName(made)
        turn += 1
        if turn > 20:
            raise SeqSiftError("hardly any pair has a finite distance")
    return out.limit(n)


def estimate_radius(sample: DataFrame, mean_n: float) -> float:
    """A radius that about one in a hundred queries of ``mean_n`` alignments would reach by chance: the sampled squared
    distances are fitted by a gamma distribution through their mean and variance."""
    m, v = sample.agg(F.avg("dist"), F.var_samp("dist")).first()
    if not m or not v:
        raise SeqSiftError("the sample has no spread")
    d = 2 * m * m / v
    return threshold_estimate(mean_n, d, m)

"""Accumulators: which points of all pairs are returned. All ranks are total orders, so ties fall alike everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqsift.functions.vectors import is_distance
from seqsift.model import Accumulation, Params


def _order(params: Params) -> list:
    d = F.desc("dist") if params.distance.larger_is_better else F.asc("dist")
    return [d, "track_id", "ipos", "qpos"]


def accumulate(points: DataFrame, params: Params) -> DataFrame:
    """Points (track_id, ikey, qpos, ipos, dist) to those that count, with rank (best is 1) and, per track, track_rank."""
    points = points.where(is_distance(F.col("dist")))
    if params.accumulation is Accumulation.DB:
        best = points.orderBy(*_order(params)).limit(params.npoints)
        return best.withColumn("rank", F.row_number().over(W.orderBy(*_order(params))))  # at most npoints rows
    if params.accumulation is Accumulation.ONE_TO_ONE:
        w = W.partitionBy("qpos").orderBy(*_order(params)[:3])
        return points.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return rank_tracks(best_per_track(points, params), params)


def best_per_track(points: DataFrame, params: Params) -> DataFrame:
    """The best npoints of each track, with their rank in it. Spark cuts each partition to npoints per track before the shuffle."""
    w = W.partitionBy("track_id").orderBy(*_order(params)[:1], "ipos", "qpos")
    return points.where(is_distance(F.col("dist"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= params.npoints)


def track_means(best: DataFrame, params: Params) -> DataFrame:
    """The best ntracks by the mean of the distances kept, with track_rank."""
    order = [F.desc("mean_dist") if params.distance.larger_is_better else F.asc("mean_dist"), "track_id"]
    means = best.groupBy("track_id", "ikey").agg(F.avg("dist").alias("mean_dist")).orderBy(*order).limit(params.ntracks)
    return means.withColumn("track_rank", F.row_number().over(W.orderBy(*order)))  # at most ntracks rows


def rank_tracks(best: DataFrame, params: Params) -> DataFrame:
    """The points of the best ntracks tracks, with track_rank: a track's points (npoints at most) travel in one row, so nothing is joined or computed twice."""
    order = [F.desc("mean_dist") if params.distance.larger_is_better else F.asc("mean_dist"), "track_id"]
    own = [c for c in best.columns if c != "track_id"]
    kept = best.groupBy("track_id").agg(F.avg("dist").alias("mean_dist"), F.collect_list(F.struct(*own)).alias("__points"))
    top = kept.orderBy(*order).limit(params.ntracks).withColumn("track_rank", F.row_number().over(W.orderBy(*order)))  # at most ntracks rows
    return top.select("track_id", "track_rank", F.inline("__points")).select(*best.columns, "track_rank")


def merge(previous: DataFrame, points: DataFrame, params: Params) -> DataFrame:
    """Accumulates new points on top of earlier results. Points that come twice count twice, as nothing tells them apart."""
    return accumulate(previous.select(*points.columns).unionByName(points), params)

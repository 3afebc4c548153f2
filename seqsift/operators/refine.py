"""Refinements: which tracks, positions and pairs take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsift.model import TOLERANCE, Refine

#: Key lists up to this length are part of the plan; longer ones are joined.
LITERAL_KEYS = 1000


def _keys(spark: SparkSession, keys: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")


def allowed_tracks(rows: DataFrame, refine: Refine) -> DataFrame:
    """Rows of tracks in the included keys (none if that list is empty) and not in the excluded ones."""
    spark = rows.sparkSession
    if refine.include_keys is not None:
        few = len(refine.include_keys) <= LITERAL_KEYS
        rows = rows.where(F.col("key").isin(list(refine.include_keys)) if refine.include_keys else F.lit(False)) if few else rows.join(_keys(spark, refine.include_keys), "key", "left_semi")
    if refine.exclude_keys:
        few = len(refine.exclude_keys) <= LITERAL_KEYS
        rows = rows.where(~F.col("key").isin(list(refine.exclude_keys))) if few else rows.join(_keys(spark, refine.exclude_keys), "key", "left_anti")
    return rows


def within_radius(dist: Column, radius: float) -> Column:
    return dist <= radius + TOLERANCE


def powers_fit(refine: Refine, qpow: Column, ipow: Column) -> Column:
    """Both mean powers reach the absolute threshold, and differ by no more than the relative one."""
    ok = F.lit(True)
    if refine.absolute_threshold is not None:
        ok = ok & (qpow >= refine.absolute_threshold) & (ipow >= refine.absolute_threshold)
    if refine.relative_threshold is not None:
        ok = ok & (F.abs(qpow - ipow) <= abs(refine.relative_threshold))
    return ok


def duration_fits(track: Column, query: float, ratio: float) -> Column:
    return F.abs(track - query) < query * ratio

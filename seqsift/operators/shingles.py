"""Windows of successive vectors: shingles, their norms, mean powers and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqsift.functions.vectors import squared_norm

#: Positions per window partition. A long track spreads over many; each also gets the few rows that its last frames reach into.
CHUNK = 4096
#: Tracks per prefix-sum bucket.
BUCKET = 65_536


def with_norms(vectors: DataFrame, n: int | None = None) -> DataFrame:
    """Adds n2, the squared norm."""
    return vectors.withColumn("n2", squared_norm(F.col("vec"), n))


def once(value: Column) -> Column:
    """A value that is computed once for each row: filters on it are not pushed below, which would compute it again for each of its uses."""
    return F.explode(F.array(value))


def _chunked(rows: DataFrame, length: int, chunk: int) -> DataFrame:
    own = F.floor(F.col("pos") / chunk)
    before = F.when((F.col("pos") % chunk < length - 1) & (F.col("pos") >= chunk), own - 1)
    return rows.withColumn("__own", own).withColumn("__chunk", F.explode(F.array_compact(F.array(own, before))))


def sliding(rows: DataFrame, length: int, values: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Adds aggregates over each row and the ``length`` - 1 rows after it; rows whose frame is cut off by the track's end go.

    Positions of a track count from 0 without gaps.
    """
    chunk = max(chunk, length)
    frame = W.partitionBy("track_id", "__chunk").orderBy("pos").rowsBetween(0, length - 1)
    out = _chunked(rows, length, chunk).withColumns({k: v.over(frame) for k, v in values.items()} | {"__n": F.count("*").over(frame)})
    return out.where((F.col("__n") == length) & (F.col("__own") == F.col("__chunk"))).drop("__n", "__own", "__chunk")


def shingles(vectors: DataFrame, length: int, *, power: bool = False, dim: int | None = None, hop: int = 1, chunk: int = CHUNK) -> DataFrame:
    """track_id, key, pos, sh (``length`` vectors end to end), norm, and pow (the mean power): at every ``hop``-th position.

    Norms and powers are summed from each frame's own rows, so infinite powers do no harm to later frames. With
    ``length`` 1 nothing is shuffled.
    """
    cols = ["track_id", "key", "pos", "vec", *(["power"] if power else [])]
    base = vectors.select(*cols)
    n = dim * length if dim else None
    on_grid = (F.col("pos") % max(1, hop)) == 0
    if length == 1:
        out = base.where(on_grid).withColumnRenamed("vec", "sh")
        out = out.withColumnRenamed("power", "pow") if power else out
    else:
        values = {"__vs": F.collect_list("vec")}
        if power:
            values["pow"] = F.avg("power")
        out = sliding(base, length, values, chunk).where(on_grid).withColumn("sh", once(F.flatten("__vs")))
    return out.select("track_id", "key", "pos", "sh", F.sqrt(squared_norm(F.col("sh"), n)).alias("norm"), *(["pow"] if power else []))


def scaled(sh: DataFrame, radius: float, normed: bool) -> DataFrame:
    """Adds ``scaled`` to shingles (sh, norm): times 1 / sqrt(radius), and of unit length before that if ``normed``; null where the norm is 0 then."""
    by = F.lit(radius**0.5) * F.col("norm") if normed else F.lit(radius**0.5)
    factor = F.try_divide(F.lit(1.0), by)
    return sh.withColumn("scaled", F.when(factor.isNotNull(), F.transform("sh", lambda x: x * factor)))


def loud_enough(sh: DataFrame, threshold: float) -> DataFrame:
    """One row: how many shingles there are, and how many of them have a mean power (pow) of at least the threshold; null without powers."""
    loud = F.count(F.when(F.col("pow") >= threshold, 1)) if "pow" in sh.columns else F.lit(None).cast("long")
    return sh.agg(F.count("*").alias("shingles"), loud.alias("loud"))


def mean_durations(vectors: DataFrame) -> DataFrame:
    """track_id and the mean of its own intervals' lengths."""
    return vectors.groupBy("track_id").agg(F.avg(F.col("t_end") - F.col("t_start")).alias("duration"))


def tracks(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("track_id", "key").agg(F.count("*").cast("int").alias("nvectors"))


def prefix_sums(rows: DataFrame, index: str, value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``index``: within buckets, plus the buckets before."""
    b = F.floor(F.col(index) / bucket)
    keyed = rows.withColumn("__b", b)
    sums = keyed.groupBy("__b").agg(F.sum(value).alias("__s"))
    # One row for each BUCKET tracks.
    before = sums.select("__b", F.coalesce(F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy("__b").orderBy(index).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return keyed.join(before, "__b").withColumn(out, (inner + F.col("__before")).cast("long")).drop("__b", "__before")


def diagonal_dots(vectors: DataFrame, query: DataFrame, length: int, dim: int | None = None) -> DataFrame:
    """Dot products of all full alignments (track_id, qpos, ipos, dot) by summing single products along diagonals.

    For long sequences: each pair of vectors is multiplied once, however many alignments it is in. ``query`` (pos,
    vec) is small and broadcast by the caller.
    """
    from seqsift.functions.vectors import dot

    points = vectors.select("track_id", "key", "pos", "vec").crossJoin(query.select(F.col("pos").alias("qpos"), F.col("vec").alias("qvec")))
    points = points.select("track_id", "key", "pos", "qpos", dot(F.col("vec"), F.col("qvec"), dim).alias("p"))
    frame = W.partitionBy("track_id", F.col("pos") - F.col("qpos")).orderBy("qpos").rowsBetween(0, length - 1)
    full = points.withColumns({"dot": F.sum("p").over(frame), "__n": F.count("*").over(frame)}).where(F.col("__n") == length)
    return full.select("track_id", "key", "qpos", F.col("pos").alias("ipos"), "dot")

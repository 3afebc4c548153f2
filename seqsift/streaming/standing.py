"""A standing query: each micro-batch of new tracks is searched, and its points compete with those kept so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqsift.model import RESULTS, Accumulation, QuerySpec
from seqsift.operators.accumulate import accumulate, best_per_track, rank_tracks
from seqsift.plans.query import Query

_POINT = ["track_id", "qkey", "ikey", "qpos", "ipos", "dist"]


class StandingQuery:
    """Keeps what can still matter, in Parquet, a folder for each micro-batch; a state counts once it is complete.

    The best points of all, or of each query position, are kept. Per track, the best points of every track are: tracks
    are ranked by means only when results are asked for, as a rank may change while more arrives. A track arrives
    whole in one micro-batch.
    """

    def __init__(self, datum: DataFrame, spec: QuerySpec, path: str):
        self.datum, self.spec, self.path = datum, spec, path.rstrip("/")

    def _state(self, spark, before: int | None = None) -> str | None:
        """The newest complete state, or that before a micro-batch."""
        home = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
        done = [n for n in names if n.isdigit() and (before is None or int(n) < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(home, f"{n}/_SUCCESS"))]
        return f"{self.path}/{max(done)}" if done else None

    def _reduced(self, points: DataFrame) -> DataFrame:
        p = self.spec.params
        return (best_per_track(points, p) if p.accumulation is Accumulation.PER_TRACK else accumulate(points, p)).select(*_POINT)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: a batch that comes again after a failure writes the same state again."""
        if batch.isEmpty():
            return
        points = Query(batch, self.datum, self.spec).points().select(*_POINT)
        state = self._state(batch.sparkSession, batch_id)
        if state is not None:
            points = batch.sparkSession.read.parquet(state).unionByName(points)
        self._reduced(points).write.mode("overwrite").parquet(f"{self.path}/{batch_id:010d}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def results(self, spark) -> DataFrame:
        state = self._state(spark)
        if state is None:
            return spark.createDataFrame([], RESULTS)
        p, kept = self.spec.params, spark.read.parquet(state)
        if p.accumulation is Accumulation.PER_TRACK:
            return rank_tracks(best_per_track(kept, p), p)
        return accumulate(kept, p)

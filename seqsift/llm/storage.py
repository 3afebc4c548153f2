"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay small, as a row may hold a very long text.
BATCH_ROWS = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset, as in tests."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='seqsift-')}"
        sc.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_open: list[Workspace] = []


def clear_workspaces() -> None:
    """Deletes the tables of all operators that were called so far, once their results have been written elsewhere."""
    while _open:
        _open[-1].clear()


class Workspace:
    """Tables written to the shared folder: reading one again never repeats the work that made it,
    whichever executor was lost meanwhile."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/seqsift/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _open.append(self)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.seqsift_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.seqsift_path)
            path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        """Deletes all tables, once what was made of them is written elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in _open:
            _open.remove(self)


def as_rows(docs: DataFrame) -> DataFrame:
    """Each row as one column ``row``, so that no name of an operator's own can clash with one of ``docs``; see :func:`part`."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def part(name: str) -> Column:
    """A column of the rows that :func:`as_rows` has packed."""
    return F.col("row").getField(name)


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def broadcast_if_few(table: DataFrame, rows: int = 400_000) -> DataFrame:
    """Marks a written table of short rows for broadcast if it has at most ``rows``; else Spark is free to shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts an object along with its class, so that workers need not be able to import it; see :func:`shared`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(held: Broadcast):
    """The object, made once in each worker: its broadcasts outlive a task."""
    if not hasattr(held, "seqsift_made"):
        held.seqsift_made = cloudpickle.loads(held.value)
    return held.seqsift_made

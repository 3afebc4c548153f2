"""Tables as tracks: each adapter gives track_id, key, pos, vec, and power and times where the table has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(rows: DataFrame, track: str, order: list[str], **columns: Column) -> DataFrame:
    """Positions count from 0 in the given order within each track. Tracks are parted by key as well, so that a filter on keys goes below the numbering."""
    named = rows.withColumns({"__track": F.col(track).cast("int"), "__key": F.col(track).cast("string")})
    pos = F.row_number().over(W.partitionBy("__track", "__key").orderBy(*order)) - 1
    return named.select(F.col("__track").alias("track_id"), F.col("__key").alias("key"), pos.alias("pos"), *(c.alias(k) for k, c in columns.items()))


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1e6D")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_table(spark, sf_dir, "embeddings"), "label", ["vec_id"], vec=F.col("embedding").cast("array<double>"))


def embedding(spark: SparkSession, sf_dir: str, vec_id: int) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id)
    return rows.select(F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each user: values, their log as power, and the time until the next event."""
    t = seconds("ts")
    nxt = F.coalesce(F.lead(t).over(W.partitionBy("user_id").orderBy("ts", "event_id")), t)
    rows = _table(spark, sf_dir, "events").withColumns({"__t": t, "__next": nxt})
    return _numbered(rows, "user_id", ["ts", "event_id"], vec=F.array("value"), power=F.log10(F.col("value") + 1), t_start=F.col("__t"), t_end=F.col("__next"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each supplier, in order of shipping."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return _numbered(_table(spark, sf_dir, "lineitem"), "l_suppkey", order, vec=F.array("l_quantity", "l_discount", "l_tax"), power=F.log10("l_extendedprice"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tracks: the quantities of each order's lines."""
    return _numbered(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], vec=F.array("l_quantity"))


def event_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days as shares of the five event types."""
    shares = [F.count(F.when(F.col("event_type") == e, 1)) / F.count("*") for e in EVENT_TYPES]
    days = _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array(*shares).alias("h"))
    return _numbered(days, "user_id", ["day"], vec=F.col("h"))


def head(vectors: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """A track's first n vectors as a query."""
    rows = vectors.where(F.col("key") == key)
    return rows if n is None else rows.where(F.col("pos") < n)


def literal(spark: SparkSession, vectors: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "pos int, vec array<double>")

"""Track files: binary features and powers, text times."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqsift.model import SeqSiftError


def _decode(raw: bytes, path: str) -> np.ndarray:
    """uint32 dimension, then doubles, row after row."""
    if len(raw) < 4:
        raise SeqSiftError(f"{path} has no dimension")
    dim = int(np.frombuffer(raw[:4], np.uint32)[0])
    if dim < 1 or (len(raw) - 4) % (8 * dim):
        raise SeqSiftError(f"{path} isn't made of vectors of {dim} doubles")
    return np.frombuffer(raw, np.float64, offset=4).reshape(-1, dim)


def read_matrix(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, pos, vec of binary feature files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch.path, batch.content, strict=True):
                data = _decode(bytes(raw), path)
                for i in range(0, len(data), 10_000):  # a long track leaves in parts
                    part = data[i : i + 10_000]
                    yield pd.DataFrame({"path": path, "pos": np.arange(i, i + len(part), dtype=np.int32), "vec": list(part)})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(rows, "path string, pos int, vec array<double>")


def absolute(path: str) -> str:
    """A path that means the same wherever it is read."""
    return path if "://" in path or path.startswith(("/", "file:")) else os.path.abspath(path)


def sizes(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, int]]:
    """Dimension and number of vectors of feature files, from their lengths and first bytes only; as many rows reach the driver as paths."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if not fs.exists(where):
            raise SeqSiftError(f"{path} isn't there")
        length, stream = fs.getFileStatus(where).getLen(), fs.open(where)
        try:
            raw = bytes(stream.read() & 0xFF for _ in range(4)) if length >= 4 else b""
        finally:
            stream.close()
        dim = int(np.frombuffer(raw, np.uint32)[0]) if raw else 0
        if dim < 1 or (length - 4) % (8 * dim):
            raise SeqSiftError(f"{path} isn't made of vectors of {dim} doubles")
        out[path] = dim, (length - 4) // (8 * dim)
    return out


def read_referenced(spark: SparkSession, references: DataFrame, has_power: bool, has_times: bool) -> DataFrame:
    """The vectors of registered tracks, read by the tasks that need them: a key's filter goes below, so only its files are opened."""
    from .reference import load_all

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from load_all(batch.to_pylist(), has_power, has_times)

    # A row is a path: tracks are dealt out evenly whatever their files' sizes.
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return references.repartition(n, "track_id").mapInArrow(rows, "track_id int, key string, pos int, vec array<double>, power double, t_start double, t_end double")


def read_powers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, pos, power: a features file of dimension 1."""
    return read_matrix(spark, paths).select("path", "pos", F.when(F.size("vec") == 1, F.col("vec")[0]).otherwise(F.raise_error(F.lit("a power file has dimension 1"))).alias("power"))


def read_times(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, pos, t_start, t_end: n + 1 numbers of a text file bound n successive intervals."""
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v"))
    pairs = F.transform(F.slice("v", 1, F.size("v") - 1), lambda x, i: F.struct(i.alias("pos"), x.cast("double").alias("t_start"), F.get(F.col("v"), i + 1).cast("double").alias("t_end")))
    return text.where(F.size("v") > 1).select("path", F.inline(pairs))


def read_tracks(spark: SparkSession, items: list[dict]) -> DataFrame:
    """ord, key, pos, vec, power, t_start, t_end of track files: each item has features, and may have power, times and key.

    The key is the features path if none is given. Powers and intervals must be as many as vectors.
    """
    for kind in ("power", "times"):
        if len({kind in i for i in items}) > 1:
            raise SeqSiftError(f"some tracks have {kind} and some don't")
    named = spark.createDataFrame([(n, i.get("key") or i["features"], i["features"], i.get("power"), i.get("times")) for n, i in enumerate(items)], "ord int, key string, features string, powers string, times string")
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/+", "/"), "%20", " ")
    local = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")

    def attach(rows: DataFrame, kind: str, read) -> DataFrame:
        found = read(spark, sorted({i[kind] for i in items})).withColumn("__p", plain("path")).drop("path")
        out = rows.join(found, (local(rows[{"power": "powers", "times": "times"}[kind]]) == found["__p"]) & (rows.pos == found.pos), "left").drop("__p", found.pos)
        return out

    base = read_matrix(spark, sorted({i["features"] for i in items})).withColumn("__p", plain("path")).drop("path")
    rows = named.join(base, local("features") == F.col("__p")).drop("__p")
    has_power, has_times = "power" in items[0] if items else False, "times" in items[0] if items else False
    rows = attach(rows, "power", read_powers) if has_power else rows.withColumn("power", F.lit(None).cast("double"))
    rows = attach(rows, "times", read_times) if has_times else rows.withColumns({"t_start": F.lit(None).cast("double"), "t_end": F.lit(None).cast("double")})
    out = rows.select("ord", "key", "pos", "vec", "power", "t_start", "t_end")
    missing = F.lit(False)
    if has_power:
        missing = missing | F.col("power").isNull()
    if has_times:
        missing = missing | F.col("t_end").isNull()
    if not out.where(missing).isEmpty():
        raise SeqSiftError("a power or times file has fewer values than there are vectors")
    return out


def intervals(points: DataFrame, key: str, order: list[str], time: str) -> DataFrame:
    """Adds t_start and t_end, each row's time up to the next row's of its key; the last row's interval is empty."""
    nxt = F.lead(time).over(W.partitionBy(key).orderBy(*order))
    return points.withColumns({"t_start": F.col(time), "t_end": F.coalesce(nxt, F.col(time))})


def write_track_files(vectors: DataFrame, directory: str, has_power: bool, has_times: bool) -> DataFrame:
    """Writes NNNNN.features (and .power, .times) of each track from the executors, and returns what was written: track_id, key, nvectors.

    ``directory`` is in a file system that all executors see. A task goes through its tracks in order, part by part, so
    that neither many tracks nor a long one are held in memory.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory)
        track, out, last, done = None, {}, None, []

        def close() -> None:
            if "times" in out:
                out["times"].write(f"{last:.16e}\n".encode())
            for f in out.values():
                f.close()

        def listed() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32()), strict=True)], names=["track_id", "key", "nvectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = batch.column(0).to_numpy(), batch.column(2)
            flat, dim = vecs.flatten().to_numpy().astype("<f8"), len(vecs[0])
            power, start, end = (batch.column(i).to_numpy(zero_copy_only=False).astype("<f8") for i in (3, 4, 5))
            cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
                if ids[a] != track:
                    close()
                    if len(done) >= 10_000:  # the last of them may go on no more
                        yield listed()
                        done = []
                    track = int(ids[a])
                    out = {k: store.open_output_stream(f"{root}/{track:05d}.{k}") for k, wanted in (("features", True), ("power", has_power), ("times", has_times)) if wanted}
                    out["features"].write(np.array([dim], "<u4").tobytes())
                    if has_power:
                        out["power"].write(np.array([1], "<u4").tobytes())
                    done.append([track, batch.column(1)[a].as_py(), 0])
                done[-1][2] += b - a
                out["features"].write(flat[a * dim : b * dim].tobytes())
                if has_power:
                    out["power"].write(power[a:b].tobytes())
                if has_times:
                    out["times"].write("".join([f"{t:.16e}\n" for t in start[a:b].tolist()]).encode())
                    last = float(end[b - 1])
        close()
        yield listed()

    n = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = vectors.select("track_id", "key", "vec", "power", "t_start", "t_end", "pos").repartition(n, "track_id").sortWithinPartitions("track_id", "pos")
    return rows.mapInArrow(write, "track_id int, key string, nvectors int")

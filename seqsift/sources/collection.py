"""A collection of tracks on disk: created once, appended to, opened for reading or writing."""

from __future__ import annotations

import json
import uuid
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsift.functions.vectors import squared_norm
from seqsift.model import VECTORS, DuplicateKeyError, SeqSiftError
from seqsift.operators.shingles import prefix_sums
from seqsift.operators.shingles import tracks as count_tracks
from seqsift.sources import files

VERSION = 1
_REFERENCES = "track_id int, key string, features string, power string, times string"
#: Tracks with fewer vectors than this are counted as too short to be of use.
DUD = 16


class Collection:
    """Vectors in Parquet, in batches; the newest metadata file names the batches that count.

    A batch is written first and then named in a new metadata file, which is created exclusively: a reader sees all of
    a batch or nothing, a writer that dies leaves nothing visible, and of two writers at once one fails.
    """

    def __init__(self, spark: SparkSession, path: str, writable: bool):
        self.spark, self.path, self.writable = spark, path.rstrip("/"), writable
        jvm = spark._jvm
        self._home = jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        self._fs = self._home.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, by_reference: bool = False) -> Collection:
        """A new, empty collection, of vectors or (``by_reference``) of the paths of track files."""
        made = cls(spark, path, True)
        if made._fs.exists(made._home):
            raise SeqSiftError(f"{path} exists")
        made._commit({"format": "seqsift", "version": VERSION, "dim": 0, "power": False, "times": None, "norms": False, "batches": [], "tracks": 0, "by_reference": by_reference}, 0)
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str, writable: bool = False) -> Collection:
        made = cls(spark, path, writable)
        meta = made.meta
        if meta.get("format") != "seqsift" or meta.get("version") != VERSION:
            raise SeqSiftError(f"{path} isn't a collection of version {VERSION}")
        return made

    def close(self) -> None:
        """Nothing is held open."""

    def _newest(self) -> int:
        if not self._fs.exists(self._home):
            raise SeqSiftError(f"{self.path} isn't a collection")
        return max((int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(self._home) if not s.getPath().getName().startswith(".")), default=-1)

    @property
    def meta(self) -> dict:
        jvm, n = self.spark._jvm, self._newest()
        with_stream = self._fs.open(jvm.org.apache.hadoop.fs.Path(self._home, f"{n:08d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8"))
        finally:
            with_stream.close()

    def _commit(self, meta: dict, n: int | None = None) -> None:
        n = self._newest() + 1 if n is None else n
        try:
            out = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(self._home, f"{n:08d}.json"), False)
        except Exception as e:
            raise SeqSiftError("another writer was faster") from e
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()

    def _writing(self) -> dict:
        if not self.writable:
            raise SeqSiftError("the collection was opened for reading")
        return self.meta

    # --- flags

    def enable_norms(self) -> None:
        """Norms are always computed when asked for; this only notes the wish. May be repeated."""
        meta = self._writing()
        if not meta["norms"]:
            self._commit(meta | {"norms": True})

    def enable_power(self) -> None:
        """Every track will have powers. Only while the collection is empty; may be repeated."""
        meta = self._writing()
        if meta["power"]:
            return
        if meta["tracks"]:
            raise SeqSiftError("there are tracks without power already")
        self._commit(meta | {"power": True})

    # --- reading

    def references(self) -> DataFrame:
        """track_id, key, and the files (features, power, times) of tracks that are kept by reference."""
        return self.spark.read.schema(_REFERENCES).parquet(*(f"{self.path}/references/{b}" for b in self.meta["batches"]))

    def vectors(self) -> DataFrame:
        """All vectors. Those kept by reference are read from their files whenever a plan asks for them."""
        meta = self.meta
        if not meta["batches"]:
            return self.spark.createDataFrame([], VECTORS)
        if meta.get("by_reference"):
            rows = files.read_referenced(self.spark, self.references(), meta["power"], bool(meta["times"])).select(*VECTORS.names)
            return rows.withColumn("n2", squared_norm(F.col("vec"), meta["dim"])) if meta["norms"] else rows
        rows = self.spark.read.schema(VECTORS).parquet(*(f"{self.path}/vectors/{b}" for b in meta["batches"]))
        return rows.withColumn("n2", squared_norm(F.col("vec"), meta["dim"])) if meta["norms"] else rows

    def tracks(self) -> DataFrame:
        """track_id, key, nvectors, from small files of their own."""
        meta = self.meta
        if not meta["batches"]:
            return self.spark.createDataFrame([], "track_id int, key string, nvectors int")
        return self.spark.read.schema("track_id int, key string, nvectors int").parquet(*(f"{self.path}/tracks/{b}" for b in meta["batches"]))

    def listing(self) -> DataFrame:
        return self.tracks().orderBy("track_id").select("key", "nvectors")

    def offsets(self) -> DataFrame:
        """Each track with the number of vectors in the tracks before it."""
        return prefix_sums(self.tracks(), "track_id", "nvectors", "offset")

    def status(self) -> DataFrame:
        return status(self.tracks(), self.meta)

    def retrieve(self, key: str) -> DataFrame:
        """A track's vectors in order; files and row groups without the key are not read."""
        if self.tracks().where(F.col("key") == key).isEmpty():
            raise SeqSiftError(f"no track has the key {key!r}")
        return self.vectors().where(F.col("key") == key).orderBy("pos")

    # --- writing

    def insert(self, rows: DataFrame) -> None:
        """Adds tracks (key, pos, vec, and power or t_start and t_end; ord may give their order). A key that is there, or comes twice with one position, is refused."""
        self._append(rows, skip=False)

    def insert_new(self, rows: DataFrame) -> int:
        """Adds the tracks whose keys are new, the first (by ord) of those with one key; returns how many."""
        return self._append(rows, skip=True)

    def _append(self, rows: DataFrame, skip: bool) -> int:
        meta = self._writing()
        if meta.get("by_reference"):
            raise SeqSiftError("the collection keeps references, not vectors")
        for name, kind in (("power", "double"), ("t_start", "double"), ("t_end", "double")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        rows = rows if "ord" in rows.columns else rows.withColumn("ord", F.lit(0))
        # Written once, as each step below reads them and what makes them may be dear. Another attempt has another name.
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows = rows.select("ord", *VECTORS.names[1:])
        rows.write.parquet(staged)
        try:
            return self._add(self.spark.read.schema(rows.schema).parquet(staged), skip, meta)
        finally:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    def _add(self, rows: DataFrame, skip: bool, meta: dict) -> int:
        here = self.tracks().select("key")
        heads = rows.groupBy("key", "ord").agg(F.count("*").cast("int").alias("nvectors"))
        known = heads.join(here, "key", "left_semi")
        if skip:
            first = heads.groupBy("key").agg(F.min("ord").alias("ord"))
            heads = heads.join(first, ["key", "ord"]).join(here, "key", "left_anti")
        elif not known.isEmpty() or not heads.groupBy("key").count().where("count > 1").isEmpty():
            raise DuplicateKeyError("a key is there already")
        # Track numbers go on from the last, in order of ord and key.
        batch = f"{self._newest() + 1:08d}"
        numbered = _numbered(self.spark, heads, f"{self.path}/heads/{batch}").select("key", "ord", "nvectors", (F.col("number") + meta["tracks"]).cast("int").alias("track_id"))
        numbered.select("track_id", "key", "nvectors").write.mode("overwrite").parquet(f"{self.path}/tracks/{batch}")
        made = self.spark.read.schema("track_id int, key string, nvectors int").parquet(f"{self.path}/tracks/{batch}")
        chosen = rows.join(numbered.select("key", "ord"), ["key", "ord"], "left_semi").join(made.select("key", "track_id"), "key")
        self._check(chosen, meta)
        chosen.select(*VECTORS.names).sortWithinPartitions("track_id", "pos").write.mode("overwrite").parquet(f"{self.path}/vectors/{batch}")
        n = made.count()
        if n:
            dim = chosen.select(F.size("vec").alias("d")).first().d
            timed = chosen.where("t_end is not null").isEmpty() is False
            self._commit(meta | {"dim": dim, "times": timed if meta["times"] is None else meta["times"], "batches": [*meta["batches"], batch], "tracks": meta["tracks"] + n})
        return n

    def _check(self, rows: DataFrame, meta: dict) -> None:
        f = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.count("power").alias("power"), F.count("t_end").alias("times"), F.countDistinct("track_id", "pos").alias("places")).first()
        if not f.n:
            return
        if f.low != f.high or f.low < 1 or (meta["dim"] and f.low != meta["dim"]):
            raise SeqSiftError("vectors differ in dimension")
        if f.power != (f.n if meta["power"] else 0):
            raise SeqSiftError("all tracks have power or none has")
        if f.times not in (0, f.n) or (meta["times"] is not None and bool(f.times) != meta["times"]):
            raise SeqSiftError("all tracks have times or none has")
        if f.places != f.n:
            raise SeqSiftError("a position comes twice in a track")

    def insert_references(self, items: list[dict]) -> int:
        """Registers tracks by the paths of their files, which stay where they are; keys that are there, or come again, are passed over. Returns how many were added.

        Only a collection that was created for it keeps references. Relative paths are made absolute; sizes come from
        the files' own sizes and first bytes.
        """
        meta = self._writing()
        if not meta.get("by_reference"):
            raise SeqSiftError("the collection keeps vectors, not references")
        if any(("power" in i) != meta["power"] for i in items):
            raise SeqSiftError("all tracks have power or none has")
        timed = {"times" in i for i in items}
        if len(timed) > 1 or (timed and meta["times"] is not None and timed != {meta["times"]}):
            raise SeqSiftError("all tracks have times or none has")
        first: dict[str, dict] = {}
        for i in items:
            first.setdefault(i.get("key") or i["features"], {k: files.absolute(v) for k, v in i.items() if k != "key"})
        here = {r.key for r in self.tracks().where(F.col("key").isin(list(first))).select("key").collect()}
        new = [(key, i) for key, i in first.items() if key not in here]
        if not new:
            return 0
        sizes = files.sizes(self.spark, [i["features"] for _, i in new])
        if len({dim for dim, _ in sizes.values()} | ({meta["dim"]} if meta["dim"] else set())) > 1:
            raise SeqSiftError("vectors differ in dimension")
        batch, n = f"{self._newest() + 1:08d}", meta["tracks"]
        rows = [(n + k, key, i["features"], i.get("power"), i.get("times")) for k, (key, i) in enumerate(new)]
        self.spark.createDataFrame(rows, _REFERENCES).write.mode("overwrite").parquet(f"{self.path}/references/{batch}")
        self.spark.createDataFrame([(r[0], r[1], sizes[r[2]][1]) for r in rows], "track_id int, key string, nvectors int").write.mode("overwrite").parquet(f"{self.path}/tracks/{batch}")
        self._commit(meta | {"dim": next(iter(sizes.values()))[0], "times": timed.pop() if meta["times"] is None else meta["times"], "batches": [*meta["batches"], batch], "tracks": n + len(new)})
        return len(new)

    def insert_batch(self, items: list[DataFrame | dict]) -> int:
        """Adds tracks one after another, from rows or from files. At the first error it stops and raises; what came before
        remains. Files whose key is there are passed over. Returns how many were added."""
        before = self._writing()["tracks"]
        for item in items:
            if isinstance(item, dict):
                (self.insert_references if self.meta.get("by_reference") else self.insert_files)([item])
            else:
                self.insert(item)
        return self.meta["tracks"] - before

    def insert_files(self, items: list[dict]) -> int:
        """Adds tracks from files (features, and power, times, key if any). Keys that are there are passed over; returns how many were added."""
        return self.insert_new(files.read_tracks(self.spark, items))

    # --- export

    def dump(self, directory: str) -> DataFrame:
        """Writes all tracks as files into a new directory, with a list of them in Parquet; returns that list."""
        jvm = self.spark._jvm
        uri = directory if "://" in directory or directory.startswith("file:") else f"file://{directory}"
        home = jvm.org.apache.hadoop.fs.Path(uri)
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(home):
            raise SeqSiftError(f"{directory} exists")
        fs.mkdirs(home)
        meta = self.meta
        written = files.write_track_files(self.vectors().select(*VECTORS.names), uri, meta["power"], bool(meta["times"]))
        written.write.parquet(f"{uri}/list")
        def put(name: str, lines) -> None:
            out = fs.create(jvm.org.apache.hadoop.fs.Path(home, name), False)
            for some in batched(lines, 10_000):  # each call goes to the JVM and back
                out.write(bytearray("".join(some).encode()))
            out.close()

        put("meta.json", [json.dumps({k: meta[k] for k in ("power", "times", "norms")})])
        listed = self.spark.read.parquet(f"{uri}/list").orderBy("track_id").select("track_id", "key")
        for name, ending in (("featureList.txt", "features"), ("timesList.txt", "times"), ("powerList.txt", "power"), ("keyList.txt", None)):
            if ending == "features" or ending is None or meta[ending]:
                put(name, (f"{r.key}\n" if ending is None else f"{r.track_id:05d}.{ending}\n" for r in listed.toLocalIterator()))
        put("restore.sh", ["#!/bin/sh\n# Makes a new collection of these files: restore.sh FOLDER\n", 'exec python -m seqsift.sources.restore "$(dirname "$0")" "$1"\n'])
        return self.spark.read.parquet(f"{uri}/list").orderBy("track_id")

    @classmethod
    def restore(cls, spark: SparkSession, directory: str, path: str) -> Collection:
        """A new collection from what :meth:`dump` wrote."""
        uri = directory if "://" in directory or directory.startswith("file:") else f"file://{directory}"
        meta = json.loads(spark.read.text(f"{uri}/meta.json").first().value)
        made = cls.create(spark, path)
        if meta["power"]:
            made.enable_power()
        plain = uri.removeprefix("file://") if uri.startswith("file://") else uri
        # The list stays a table, and each task reads the files of its tracks.
        named = lambda ending: F.format_string(f"{plain.replace('%', '%%')}/%05d.{ending}", "track_id") if ending == "features" or meta[ending] else F.lit(None).cast("string")
        listed = spark.read.parquet(f"{uri}/list").select("track_id", "key", *(named(e).alias(e) for e in ("features", "power", "times")))
        made.insert_new(files.read_referenced(spark, listed, meta["power"], meta["times"]).withColumnRenamed("track_id", "ord"))
        if meta["norms"]:
            made.enable_norms()
        return made


def _numbered(spark: SparkSession, heads: DataFrame, path: str) -> DataFrame:
    """Adds number, from 0, in order of ord and key: ranges are ranked by themselves, after the rows in the ranges before."""
    from pyspark.sql import Window

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads.repartitionByRange(n, "ord", "key").sortWithinPartitions("ord", "key").withColumn("__part", F.spark_partition_id()).write.mode("overwrite").partitionBy("__part").parquet(path)
    dealt = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in heads.schema.fields)}, __part int").parquet(path)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("size"))
    # One row for each range.
    before = sizes.select("__part", F.coalesce(F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("ord", "key"))
    return dealt.join(F.broadcast(before), "__part").withColumn("number", rank - 1 + F.col("before")).drop("__part", "before")


def status(tracks: DataFrame, meta: dict) -> DataFrame:
    """One row: num_tracks, dim, dud_count (tracks of under 16 vectors), null_count (of none), length_bytes and flags."""
    n = F.col("nvectors")
    return tracks.agg(
        F.count("*").alias("num_tracks"), F.lit(meta["dim"]).cast("int").alias("dim"), F.count(F.when(n < DUD, 1)).alias("dud_count"), F.count(F.when(n == 0, 1)).alias("null_count"),
        (F.coalesce(F.sum(n), F.lit(0)) * meta["dim"] * 8).cast("long").alias("length_bytes"), F.lit(bool(meta["power"])).alias("has_power"), F.lit(bool(meta["times"])).alias("has_times"), F.lit(bool(meta["norms"])).alias("has_norms"),
    )


def global_ids(vectors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds vector_id: the place of each vector among all, track after track."""
    return vectors.join(prefix_sums(tracks, "track_id", "nvectors", "offset").select("track_id", "offset"), "track_id").withColumn("vector_id", F.col("offset") + F.col("pos")).drop("offset")


def locate(tracks: DataFrame, vector_id: int) -> tuple[int, int]:
    """The track and position of a vector's global number."""
    row = prefix_sums(tracks, "track_id", "nvectors", "offset").where((F.col("offset") <= vector_id) & (F.col("offset") + F.col("nvectors") > vector_id)).first()
    if row is None:
        raise SeqSiftError("no vector has this number")
    return row.track_id, vector_id - row.offset

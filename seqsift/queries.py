"""Queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsift.functions.vectors import dot
from seqsift.model import Accumulation, Distance, Params, QueryId, QuerySpec, Refine, SeqSiftError
from seqsift.operators import sample as sampling
from seqsift.operators.lsh import Catalog, Index
from seqsift.operators.shingles import loud_enough, mean_durations, prefix_sums, scaled, shingles, sliding, tracks, with_norms
from seqsift.plans import adapters as A
from seqsift.plans.query import matched_filter, search, sequence_query, track_datum
from seqsift.sources.collection import Collection, global_ids, status

# --- tables as tracks, in SQL

_EVENTS = """SELECT user_id::INT AS track_id, user_id::VARCHAR AS key, (row_number() OVER w - 1)::INT AS pos, [value] AS vec, log10(value + 1) AS power,
  epoch_us(ts) / 1e6 AS t_start, coalesce(lead(epoch_us(ts)) OVER w, epoch_us(ts)) / 1e6 AS t_end FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
_EMB = "SELECT label::INT AS track_id, label::VARCHAR AS key, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS pos, embedding::DOUBLE[] AS vec FROM embeddings"
_LI = """SELECT l_suppkey::INT AS track_id, l_suppkey::VARCHAR AS key, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS pos,
  [l_quantity, l_discount, l_tax] AS vec, log10(l_extendedprice) AS power FROM lineitem"""
_ORDERS = "SELECT l_orderkey::INT AS track_id, l_orderkey::VARCHAR AS key, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INT AS pos, [l_quantity] AS vec FROM lineitem"
_HIST = f"""SELECT user_id::INT AS track_id, user_id::VARCHAR AS key, (row_number() OVER (PARTITION BY user_id ORDER BY day) - 1)::INT AS pos, h AS vec
  FROM (SELECT user_id, ts::DATE AS day, [{", ".join(f"count(*) FILTER (event_type = '{e}') / count(*)" for e in A.EVENT_TYPES)}] AS h FROM events GROUP BY ALL)"""


@dataclass(frozen=True)
class Tracks:
    rows: Callable[[SparkSession, str], DataFrame]
    sql: str
    dim: int
    power: bool = False
    times: bool = False


EVENTS, EMB, LI, ORDERS, HIST = Tracks(A.events, _EVENTS, 1, True, True), Tracks(A.embeddings, _EMB, 64), Tracks(A.lineitems, _LI, 3, True), Tracks(A.orders, _ORDERS, 1), Tracks(A.event_histograms, _HIST, 5)


@dataclass(frozen=True)
class Datum:
    rows: Callable[[SparkSession, str, DataFrame], DataFrame]
    sql: str


def track_head(key: str, n: int | None = None) -> Datum:
    return Datum(lambda spark, d, v: A.head(v, key, n), f"SELECT * FROM v WHERE key = '{key}'" + (f" AND pos < {n}" if n else ""))


EMB0 = Datum(lambda spark, d, v: A.embedding(spark, d, 0), "SELECT 0 AS pos, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id = 0")
FOUR = Datum(lambda spark, d, v: A.literal(spark, [[10.0], [20.0], [30.0], [40.0]]), "SELECT * FROM (VALUES (0, [10.0::DOUBLE]), (1, [20.0::DOUBLE]), (2, [30.0::DOUBLE]), (3, [40.0::DOUBLE])) AS t(pos, vec)")


# --- a spec in SQL


def _dist_sql(p: Params) -> str:
    one = lambda a, b: f"(CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'inf'::DOUBLE ELSE 0 END WHEN {a} / {b} > 0 THEN {a} * ln({a} / {b}) ELSE 0 END)"
    both = one("qsh[i]", "x") if p.kl_asymmetric else f"({one('x', 'qsh[i]')} + {one('qsh[i]', 'x')}) / 2"
    return {
        Distance.DOT: "list_dot_product(sh, qsh)",
        Distance.NORMED: "2 - 2 * list_dot_product(sh, qsh) / nullif(sqrt(list_dot_product(sh, sh)) * sqrt(list_dot_product(qsh, qsh)), 0)",
        Distance.EUCLIDEAN: "list_sum(list_transform(sh, lambda x, i: (x - qsh[i]) * (x - qsh[i])))",
        Distance.KL: f"list_sum(list_transform(sh, lambda x, i: {both}))",
    }[p.distance]


def _points_sql(t: Tracks, datum: str, spec: QuerySpec) -> str:
    """The steps v (vectors), d (datum), s and q (shingles) and p (points)."""
    q, r, n = spec.qid, spec.refine, spec.qid.length
    window = f"WINDOW w AS (PARTITION BY track_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) QUALIFY count(*) OVER w = {n}"
    power = ", avg(power) OVER w AS {0}" if r.needs_power else ""
    where = ["dist IS NOT NULL", "NOT isnan(dist)"]
    keys = []
    if r.include_keys is not None:
        keys.append(f"key IN ({', '.join(repr(k) for k in r.include_keys)})" if r.include_keys else "false")
    if r.exclude_keys:
        keys.append(f"key NOT IN ({', '.join(repr(k) for k in r.exclude_keys)})")
    if r.duration_ratio is not None:
        keys.append(f"track_id IN (SELECT track_id FROM v GROUP BY track_id HAVING abs(avg(t_end - t_start) - (SELECT avg(t_end - t_start) FROM d)) < (SELECT avg(t_end - t_start) FROM d) * {r.duration_ratio})")
    join = [f"qpos % {max(1, r.qhop)} = 0", f"ipos % {max(1, r.ihop)} = 0"] + ([] if q.exhaustive else [f"qpos = {q.start}"])
    if r.absolute_threshold is not None:
        join += [f"qpow >= {r.absolute_threshold}", f"ipow >= {r.absolute_threshold}"]
    if r.relative_threshold is not None:
        join.append(f"abs(qpow - ipow) <= {abs(r.relative_threshold)}")
    if r.radius is not None:
        where.append(f"dist <= {r.radius} + 1e-6")
    own = "(SELECT 0 AS track_id, * EXCLUDE (track_id, key) FROM d)" if datum.startswith("SELECT * FROM v") else "(SELECT 0 AS track_id, * FROM d)"
    return f"""WITH v AS ({t.sql}), d AS ({datum}),
s AS (SELECT track_id, key AS ikey, pos AS ipos, flatten(array_agg(vec) OVER w) AS sh{power.format('ipow')} FROM v {'WHERE ' + ' AND '.join(keys) if keys else ''} {window}),
q AS (SELECT pos AS qpos, flatten(array_agg(vec) OVER w) AS qsh{power.format('qpow')} FROM {own} {window}),
x AS (SELECT track_id, ikey, qpos, ipos, {_dist_sql(spec.params)} AS dist FROM s CROSS JOIN q WHERE {' AND '.join(join)}),
p AS (SELECT * FROM x WHERE {' AND '.join(where)})"""


def _search_sql(t: Tracks, datum: str, spec: QuerySpec, more: str = "") -> str:
    p = spec.params
    way = "DESC" if p.distance.larger_is_better else "ASC"
    columns = "ikey, qpos::BIGINT AS qpos, ipos::BIGINT AS ipos, round(dist, 6) + 0.0 AS dist"
    steps = _points_sql(t, datum, spec) + more
    if p.accumulation is Accumulation.DB:
        return f"{steps}\nSELECT {columns}, row_number() OVER o AS rank FROM p WINDOW o AS (ORDER BY dist {way}, track_id, ipos, qpos) QUALIFY rank <= {p.npoints}"
    if p.accumulation is Accumulation.ONE_TO_ONE:
        return f"{steps}\nSELECT {columns}, row_number() OVER o AS rank FROM p WINDOW o AS (PARTITION BY qpos ORDER BY dist {way}, track_id, ipos) QUALIFY rank = 1"
    return f"""{steps},
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY dist {way}, ipos, qpos) AS rank FROM p QUALIFY rank <= {p.npoints}),
m AS (SELECT track_id, avg(dist) AS mean_dist FROM b GROUP BY track_id),
k AS (SELECT *, row_number() OVER (ORDER BY mean_dist {way}, track_id) AS track_rank FROM m QUALIFY track_rank <= {p.ntracks})
SELECT {columns}, rank, track_rank FROM b JOIN k USING (track_id)"""


def _shown(found: DataFrame) -> DataFrame:
    ranks = [F.col(c).cast("long").alias(c) for c in ("rank", "track_rank") if c in found.columns]
    return found.select("ikey", F.col("qpos").cast("long").alias("qpos"), F.col("ipos").cast("long").alias("ipos"), (F.round("dist", 6) + 0.0).alias("dist"), *ranks)


@dataclass(frozen=True)
class Case:
    tracks: Tracks
    datum: Datum
    spec: QuerySpec

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        v = self.tracks.rows(spark, sf_dir)
        return _shown(search(v, self.datum.rows(spark, sf_dir, v), self.spec, dim=self.tracks.dim))

    @property
    def sql(self) -> str:
        return _search_sql(self.tracks, self.datum.sql, self.spec)


def _case(t: Tracks, datum: Datum, kind: Distance, way: Accumulation, *, length: int = 1, start: int = 0, exhaustive: bool = False, npoints: int = 10, ntracks: int = 10, asymmetric: bool = False, **refine) -> Case:
    return Case(t, datum, QuerySpec(QueryId(length, start, exhaustive), Params(kind, way, npoints, ntracks, asymmetric), Refine(**refine)))


D, P, O = Accumulation.DB, Accumulation.PER_TRACK, Accumulation.ONE_TO_ONE
DOT, NORMED, EUC, KL = Distance.DOT, Distance.NORMED, Distance.EUCLIDEAN, Distance.KL
_NOT3 = {"exclude_keys": ("3",)}

CASES = {
    "point_dot_emb": _case(EMB, EMB0, DOT, D),
    "track_dot_emb": _case(EMB, EMB0, DOT, P, npoints=3, ntracks=5),
    "point_normed_emb": _case(EMB, EMB0, NORMED, D),
    "point_euclid_emb": _case(EMB, EMB0, EUC, D),
    "seq_euclid_ev_sl8": _case(EVENTS, track_head("3", 8), EUC, P, length=8, npoints=3, ntracks=5, **_NOT3),
    "seq_normed_li_sl4": _case(LI, track_head("3", 4), NORMED, P, length=4, npoints=5, ntracks=10, **_NOT3),
    "nseq_normed_ev": _case(EVENTS, track_head("3", 12), NORMED, P, length=4, start=2, npoints=4, ntracks=6, **_NOT3),
    "one_to_one_ev": _case(EVENTS, track_head("3", 16), NORMED, O, length=4, exhaustive=True, **_NOT3),
    "one_to_one_radius_emb": _case(EMB, track_head("3", 20), NORMED, O, exhaustive=True, radius=1.5, **_NOT3),
    "dot_one_to_one_emb": _case(EMB, track_head("3", 20), DOT, O, exhaustive=True, **_NOT3),
    "radius_emb": _case(EMB, EMB0, NORMED, D, npoints=100_000, radius=1.9),
    "include_keys_emb": _case(EMB, EMB0, NORMED, D, npoints=25, include_keys=("1", "4", "7")),
    "exclude_keys_emb": _case(EMB, EMB0, NORMED, D, npoints=25, exclude_keys=("1", "4", "7")),
    "include_minus_exclude_ev": _case(EVENTS, track_head("3", 6), EUC, P, length=3, npoints=2, include_keys=("1", "2", "3", "5", "8"), exclude_keys=("3", "5")),
    "abs_power_li": _case(LI, track_head("3", 8), NORMED, P, length=2, npoints=3, absolute_threshold=4.2, exhaustive=True, **_NOT3),
    "rel_power_li": _case(LI, track_head("3", 4), EUC, P, length=4, npoints=3, relative_threshold=0.15, **_NOT3),
    "abs_rel_radius_li": _case(LI, track_head("3", 6), NORMED, P, length=2, npoints=5, absolute_threshold=4.1, relative_threshold=0.2, radius=0.05, exhaustive=True, **_NOT3),
    "duration_ratio_ev": _case(EVENTS, track_head("3"), EUC, P, length=4, npoints=2, duration_ratio=0.1, **_NOT3),
    "hop_q_ev": _case(EVENTS, track_head("3", 16), EUC, D, length=4, exhaustive=True, npoints=20, qhop=3, **_NOT3),
    "hop_i_ev": _case(EVENTS, track_head("3", 16), EUC, D, length=4, exhaustive=True, npoints=20, qhop=2, ihop=5, **_NOT3),
    "exhaustive_ev": _case(EVENTS, track_head("3", 12), EUC, P, length=4, exhaustive=True, npoints=3, ntracks=8, **_NOT3),
    "query_by_key_ev": _case(EVENTS, track_head("5"), NORMED, P, length=6, start=4, npoints=2, exclude_keys=("5",)),
    "short_track_skip_orders": _case(ORDERS, FOUR, EUC, P, length=4, npoints=1, ntracks=20),
    "kl_hist_ev": _case(HIST, track_head("3", 1), KL, D, npoints=30, **_NOT3),
    "kl_asym_hist_ev": _case(HIST, track_head("3", 1), KL, D, npoints=30, asymmetric=True, **_NOT3),
}


# --- other operators


def _q_status(t: Tracks):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = status(tracks(t.rows(spark, sf_dir)), {"dim": t.dim, "power": t.power, "times": t.times, "norms": False})
        return found.select("num_tracks", F.col("dim").cast("long").alias("dim"), "dud_count", "null_count", "length_bytes")

    sql = f"""WITH v AS ({t.sql}), n AS (SELECT track_id, count(*) AS n FROM v GROUP BY 1)
SELECT count(*) AS num_tracks, {t.dim}::BIGINT AS dim, count(*) FILTER (n < 16) AS dud_count, count(*) FILTER (n = 0) AS null_count, (sum(n) * {t.dim} * 8)::BIGINT AS length_bytes FROM n"""
    return run, sql


def _list_tracks(spark, d):
    return tracks(A.events(spark, d)).orderBy("track_id").select("key", F.col("nvectors").cast("long").alias("nvectors"))


def _stored(spark, d) -> Collection:
    """All events in a collection."""
    made = Collection.create(spark, _folder(spark))
    made.enable_power()
    made.insert(A.events(spark, d).withColumn("ord", F.col("track_id")))
    return made


def _retrieve(spark, d):
    return _stored(spark, d).retrieve("3").select("key", F.col("pos").cast("long").alias("pos"), F.col("vec")[0].alias("v0"), F.round("power", 6).alias("power"), "t_start", "t_end")


def _offsets(spark, d):
    return prefix_sums(tracks(A.lineitems(spark, d)), "track_id", "nvectors", "offset").select("key", F.col("nvectors").cast("long").alias("nvectors"), "offset")


def _global_ids(spark, d):
    v = A.events(spark, d)
    return global_ids(v, tracks(v)).select("key", F.col("pos").cast("long").alias("pos"), "vector_id")


def _dedup_keys(spark, d):
    """A batch in which keys come again: the first of each counts."""
    v = A.events(spark, d).withColumn("ord", F.col("track_id")).withColumn("key", (F.col("track_id") % 7).cast("string"))
    made = Collection.create(spark, _folder(spark))
    made.enable_power()
    made.insert_new(v)
    kept = made.vectors().groupBy("key").agg(F.count("*").alias("nvectors"), F.round(F.sum(F.col("vec")[0]), 4).alias("total"))
    return kept


def _l2norm(spark, d):
    return with_norms(A.embeddings(spark, d), 64).select("key", F.col("pos").cast("long").alias("pos"), F.round("n2", 6).alias("n2"))


def _dot_self(spark, d):
    v = A.lineitems(spark, d)
    return v.select("key", F.col("pos").cast("long").alias("pos"), F.round(dot(F.col("vec"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 3), 6).alias("dot"))


def _seq_norm(spark, d):
    return shingles(A.events(spark, d), 8, dim=1).select("key", F.col("pos").cast("long").alias("pos"), F.round("norm", 6).alias("norm"))


def _seq_power(spark, d):
    return shingles(A.lineitems(spark, d), 5, power=True, dim=3).select("key", F.col("pos").cast("long").alias("pos"), F.round("pow", 6).alias("pow"))


def _sliding_sum(spark, d):
    rows = A.events(spark, d).withColumn("x", F.col("vec")[0]).select("track_id", "key", "pos", "x")
    return sliding(rows, 5, {"total": F.sum("x")}).select("key", F.col("pos").cast("long").alias("pos"), F.round("total", 6).alias("total"))


def _durations(spark, d):
    return mean_durations(A.events(spark, d)).select(F.col("track_id").cast("string").alias("key"), F.round("duration", 3).alias("duration"))


def _shingles(spark, d):
    return shingles(A.events(spark, d), 3, dim=1).select("key", F.col("pos").cast("long").alias("pos"), *(F.round(F.col("sh")[i], 6).alias(f"s{i}") for i in range(3)))


def _scaled(spark, d):
    """Shingles of unit length, scaled for an index of radius 0.5."""
    sh = scaled(shingles(A.lineitems(spark, d), 2, dim=3), 0.5, True)
    return sh.select("key", F.col("pos").cast("long").alias("pos"), *(F.round(F.col("scaled")[i], 6).alias(f"s{i}") for i in (0, 3)))


def _loud(spark, d):
    return loud_enough(shingles(A.lineitems(spark, d), 5, power=True, dim=3), 4.45)


_SEQ = _case(EVENTS, track_head("3", 8), NORMED, P, length=8, npoints=3, ntracks=10, **_NOT3)


def _seq_means(spark, d):
    v, c = A.events(spark, d), _SEQ
    out = sequence_query(v, A.head(v, "3", 8), 8, 3, 10, NORMED, c.spec.refine)
    return out.select("ikey", F.round("mean_dist", 6).alias("mean_dist"), F.col("track_rank").cast("long").alias("track_rank"))


_FILTER = _case(EVENTS, track_head("3", 20), EUC, P, length=12, exhaustive=True, npoints=2, ntracks=6, **_NOT3)


def _matched(spark, d):
    v = A.events(spark, d)
    return _shown(matched_filter(v, A.head(v, "3", 20), _FILTER.spec))


_SOFAR = _case(EMB, EMB0, NORMED, D, npoints=15)


def _sofar(spark, d):
    """The even tracks first; their results then compete with the odd ones'."""
    v, q, spec = A.embeddings(spark, d), A.embedding(spark, d, 0), _SOFAR.spec
    first = search(v.where("track_id % 2 = 0"), q, spec, dim=64)
    return _shown(search(v.where("track_id % 2 = 1"), q, spec, sofar=first, dim=64))


def _xthresh(spark, d):
    """What a threshold estimate is fitted from: all distances of a query's alignments."""
    v = A.events(spark, d)
    from seqsift.plans.query import Query

    q = Query(v, A.head(v, "3", 4), _case(EVENTS, track_head("3", 4), EUC, D, length=4, **_NOT3).spec, 1)
    m, s = F.avg("dist"), F.var_samp("dist")
    return q.points().agg(F.count("*").alias("n"), F.round(m, 4).alias("mean_dist"), F.round(s, 2).alias("var_dist"), F.round(2 * m * m / s, 6).alias("d"))


def _folder(spark: SparkSession) -> str:
    """The shared folder on a cluster, a temporary one elsewhere."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise SeqSiftError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='seqsift-')}"
    return f"{base.rstrip('/')}/seqsift/{uuid.uuid4().hex}"


_LSH = _case(EMB, EMB0, NORMED, D, npoints=100_000, radius=0.9)


def _index(spark, d, **options) -> tuple[DataFrame, Index]:
    v = A.embeddings(spark, d)
    return v, Index.build(v, _folder(spark), length=1, radius=0.9, normed=True, **options)


def _lsh_exact(spark, d):
    """Cells so wide that all shingles share one: candidates are complete, and re-ranking gives the exact answer."""
    v, index = _index(spark, d, k=1, tables=2, w=1e6)
    return _shown(search(v, A.embedding(spark, d, 0), _LSH.spec, index=index, dim=64))


def _lsh_ranked(spark, d):
    v, index = _index(spark, d, k=4, tables=16, w=2.0, extra_probes=8)
    return _shown(search(v, A.embedding(spark, d, 0), _LSH.spec, index=index, dim=64))


def _lsh_candidates(spark, d):
    from dataclasses import replace

    v, index = _index(spark, d, k=4, tables=16, w=2.0, extra_probes=8)
    spec = replace(_LSH.spec, qid=replace(_LSH.spec.qid, allow_false_positives=True))
    return _shown(search(v, A.embedding(spark, d, 0), spec, index=index, dim=64))


def _by_key(spark, d):
    """The query is a stored track, named by its key."""
    v, c = A.events(spark, d), CASES["query_by_key_ev"]
    return _shown(search(v, track_datum(v, "5"), c.spec, dim=1))


def _by_reference(spark, d):
    """All events as track files that a collection refers to, searched where they lie."""
    out = _folder(spark)
    written = _stored(spark, d).dump(out)
    made = Collection.create(spark, _folder(spark), by_reference=True)
    made.enable_power()
    made.insert_references([{"key": r.key} | {k: f"{out}/{r.track_id:05d}.{e}" for k, e in (("features", "features"), ("power", "power"), ("times", "times"))} for r in written.toLocalIterator()])
    v, c = made.vectors(), CASES["seq_euclid_ev_sl8"]
    return _shown(search(v, A.head(v, "3", 8), c.spec, dim=1))


def _catalog(spark, d):
    """The index is found by the query's radius, length and distance; its cells are so wide that answers are exact."""
    v, catalog = A.embeddings(spark, d), Catalog(spark, _folder(spark))
    catalog.build(v, radius=0.9, length=1, normed=True, k=1, tables=2, w=1e6)
    return _shown(search(v, A.embedding(spark, d, 0), _LSH.spec, catalog=Catalog(spark, catalog.path), dim=64))


def _lsh_statistics(spark, d):
    return _index(spark, d, k=4, tables=8, w=2.0)[1].statistics()


def _sample_pairs(spark, d):
    return sampling.sample_distances(A.embeddings(spark, d), 200, kind=NORMED, seed=3)


def _sample_query(spark, d):
    return sampling.sample_distances(A.embeddings(spark, d), 100, kind=EUC, datum=A.embedding(spark, d, 0), seed=4)


def roundtrip(spark, d):
    """All tracks into a collection, out to track files, and back into another one."""
    out = _folder(spark)
    _stored(spark, d).dump(out)
    return Collection.restore(spark, out, _folder(spark)).vectors()


def _roundtrip(spark, d):
    return roundtrip(spark, d).select("key", F.col("pos").cast("long").alias("pos"), F.col("vec")[0].alias("v0"), F.round("power", 6).alias("power"), F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"))


_status_li, _status_orders = _q_status(LI), _q_status(ORDERS)
_windowed = "FROM v WINDOW w AS (PARTITION BY track_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING) QUALIFY count(*) OVER w = {1}"

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "status_li": _status_li,
    "status_short_tracks": _status_orders,
    "list_tracks_ev": (_list_tracks, "SELECT user_id::INT::VARCHAR AS key, count(*) AS nvectors FROM events GROUP BY 1"),
    "retrieve_track_ev": (_retrieve, f"WITH v AS ({_EVENTS}) SELECT key, pos::BIGINT AS pos, vec[1] AS v0, round(power, 6) AS power, t_start, t_end FROM v WHERE key = '3'"),
    "track_offsets_li": (_offsets, f"WITH v AS ({_LI}), n AS (SELECT track_id, key, count(*) AS nvectors FROM v GROUP BY ALL) SELECT key, nvectors, coalesce(sum(nvectors) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM n"),
    "global_ids_ev": (_global_ids, f"WITH v AS ({_EVENTS}) SELECT key, pos::BIGINT AS pos, row_number() OVER (ORDER BY track_id, pos) - 1 AS vector_id FROM v"),
    "dedup_keys_batch": (_dedup_keys, "WITH n AS (SELECT user_id AS ord, (user_id % 7)::VARCHAR AS key, count(*) AS nvectors, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT key, nvectors, total FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1"),
    "l2norm_emb": (_l2norm, f"WITH v AS ({_EMB}) SELECT key, pos::BIGINT AS pos, round(list_dot_product(vec, vec), 6) AS n2 FROM v"),
    "dot_product_li": (_dot_self, f"WITH v AS ({_LI}) SELECT key, pos::BIGINT AS pos, round(vec[1] + vec[2] * 2 + vec[3] * 3, 6) AS dot FROM v"),
    "seq_norm_ev": (_seq_norm, f"WITH v AS ({_EVENTS}) SELECT key, pos::BIGINT AS pos, round(sqrt(sum(vec[1] * vec[1]) OVER w), 6) AS norm {_windowed.format(7, 8)}"),
    "seq_mean_power_li": (_seq_power, f"WITH v AS ({_LI}) SELECT key, pos::BIGINT AS pos, round(avg(power) OVER w, 6) AS pow {_windowed.format(4, 5)}"),
    "sliding_sum_ev": (_sliding_sum, f"WITH v AS ({_EVENTS}) SELECT key, pos::BIGINT AS pos, round(sum(vec[1]) OVER w, 6) AS total {_windowed.format(4, 5)}"),
    "mean_duration_ev": (_durations, f"WITH v AS ({_EVENTS}) SELECT key, round(avg(t_end - t_start), 3) AS duration FROM v GROUP BY key"),
    "loud_shingles_li": (_loud, f"WITH v AS ({_LI}), s AS (SELECT avg(power) OVER w AS pow {_windowed.format(4, 5)}) SELECT count(*) AS shingles, count(*) FILTER (pow >= 4.45) AS loud FROM s"),
    "query_by_key_stored_ev": (_by_key, CASES["query_by_key_ev"].sql),
    "by_reference_ev": (_by_reference, CASES["seq_euclid_ev_sl8"].sql),
    "catalog_exact_emb": (_catalog, _LSH.sql),
    "shingles_ev": (_shingles, f"WITH v AS ({_EVENTS}) SELECT key, pos::BIGINT AS pos, round(vec[1], 6) AS s0, round((lead(vec, 1) OVER w)[1], 6) AS s1, round((lead(vec, 2) OVER w)[1], 6) AS s2 FROM v WINDOW w AS (PARTITION BY track_id ORDER BY pos) QUALIFY lead(pos, 2) OVER w IS NOT NULL"),
    "scaled_shingles_li": (_scaled, f"WITH v AS ({_LI}), s AS (SELECT key, pos, flatten(array_agg(vec) OVER w) AS sh {_windowed.format(1, 2)}) SELECT key, pos::BIGINT AS pos, round(sh[1] / (sqrt(list_dot_product(sh, sh)) * sqrt(0.5)), 6) AS s0, round(sh[4] / (sqrt(list_dot_product(sh, sh)) * sqrt(0.5)), 6) AS s3 FROM s"),
    "seq_track_means_ev": (_seq_means, f"WITH r AS ({_search_sql(EVENTS, _SEQ.datum.sql, _SEQ.spec).replace('round(dist, 6) + 0.0 AS dist', 'mean_dist')}) SELECT DISTINCT ikey, round(mean_dist, 6) AS mean_dist, track_rank FROM r"),
    "matched_filter_diag_ev": (_matched, _FILTER.sql),
    "given_sofar_emb": (_sofar, _SOFAR.sql),
    "xthresh_params_ev": (_xthresh, _points_sql(EVENTS, track_head("3", 4).sql, _case(EVENTS, track_head("3", 4), EUC, D, length=4, **_NOT3).spec) + " SELECT count(*) AS n, round(avg(dist), 4) AS mean_dist, round(var_samp(dist), 2) AS var_dist, round(2 * avg(dist) * avg(dist) / var_samp(dist), 6) AS d FROM p"),
    "lsh_exact_emb": (_lsh_exact, _LSH.sql),
    "lsh_ranked_emb": (_lsh_ranked, None),
    "lsh_candidates_emb": (_lsh_candidates, None),
    "lsh_statistics_emb": (_lsh_statistics, None),
    "sample_db_db_emb": (_sample_pairs, None),
    "sample_query_emb": (_sample_query, None),
    "roundtrip_dump_ev": (_roundtrip, f"WITH v AS ({_EVENTS}) SELECT key, pos::BIGINT AS pos, vec[1] AS v0, round(power, 6) AS power, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end FROM v"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: c.run for k, c in CASES.items()} | {k: run for k, (run, _) in OTHERS.items()}
ORACLES: dict[str, str] = {k: c.sql for k, c in CASES.items()} | {k: sql for k, (_, sql) in OTHERS.items() if sql}

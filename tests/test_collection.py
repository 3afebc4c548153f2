import math

import numpy as np
import pytest
from helpers import datum, points, tracks
from pyspark.sql import functions as F

from seqsift import queries
from seqsift.model import Accumulation, Distance, DuplicateKeyError, Params, QueryId, QuerySpec, Refine, SeqSiftError
from seqsift.operators.lsh import Catalog, Family, Index, probes
from seqsift.operators.sample import estimate_radius, sample_distances
from seqsift.operators.shingles import loud_enough, prefix_sums, scaled, shingles, sliding
from seqsift.plans import adapters as A
from seqsift.plans.query import search
from seqsift.sources.collection import Collection, global_ids, locate
from seqsift.streaming.standing import StandingQuery

G = {"01": [(0, 0.5), (0.5, 0)], "10": [(0.5, 0), (0, 0.5), (0.5, 0)]}
TIMES = {"01": [(0, 1), (1, 2)], "10": [(0, 2), (2, 3), (3, 4)]}


def test_life_cycle(spark, tmp_path):
    path = f"{tmp_path}/c"
    with pytest.raises(SeqSiftError):
        Collection.open(spark, path)
    Collection.create(spark, path)
    with pytest.raises(SeqSiftError):
        Collection.create(spark, path)
    seen = Collection.open(spark, path)
    assert seen.status().first().num_tracks == 0 and seen.vectors().count() == 0
    with pytest.raises(SeqSiftError):
        seen.insert(tracks(spark, G))


def test_insert_list_retrieve(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c")
    c.insert(tracks(spark, G, times=TIMES))
    assert [(r.key, r.nvectors) for r in c.listing().collect()] == [("01", 2), ("10", 3)]
    got = c.retrieve("10").collect()
    assert [(tuple(r.vec), r.t_start, r.t_end, r.power) for r in got] == [((0.5, 0.0), 0, 2, None), ((0.0, 0.5), 2, 3, None), ((0.5, 0.0), 3, 4, None)]
    with pytest.raises(SeqSiftError):
        c.retrieve("none")
    s = c.status().first()
    assert (s.num_tracks, s.dim, s.dud_count, s.null_count, s.length_bytes, s.has_times) == (2, 2, 2, 0, 80, True)
    assert [(r.key, r.offset) for r in c.offsets().orderBy("track_id").collect()] == [("01", 0), ("10", 2)]
    assert sorted(r.vector_id for r in global_ids(c.vectors(), c.tracks()).collect()) == [0, 1, 2, 3, 4]
    assert locate(c.tracks(), 3) == (1, 1)
    c.enable_norms()
    c.enable_norms()
    assert c.vectors().where("n2 != 0.25").count() == 0


def test_what_insert_refuses(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c")
    c.insert(tracks(spark, {"a": [(0, 1)]}))
    with pytest.raises(DuplicateKeyError):
        c.insert(tracks(spark, {"a": [(1, 1)]}))
    for bad in (tracks(spark, {"b": [(1, 1, 1)]}), tracks(spark, {"b": [(1, 1)]}, powers={"b": [-1]}), tracks(spark, {"b": [(1, 1)]}, times={"b": [(0, 1)]})):
        with pytest.raises(SeqSiftError):
            c.insert(bad)
    with pytest.raises(SeqSiftError):
        c.enable_power()
    assert c.tracks().count() == 1
    p = Collection.create(spark, f"{tmp_path}/p")
    p.enable_power()
    p.enable_power()
    with pytest.raises(SeqSiftError):
        p.insert(tracks(spark, {"b": [(1, 1)]}))
    p.insert(tracks(spark, {"b": [(1, 1)]}, powers={"b": [-1]}))


def test_batches_keep_the_first_of_a_key(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c")
    rows = spark.createDataFrame([(0, "a", 0, [0.0, 1.0]), (1, "b", 0, [1.0, 0.0]), (2, "a", 0, [5.0, 5.0]), (3, "c", 0, [1.0, 1.0])], "ord int, key string, pos int, vec array<double>")
    assert c.insert_new(rows) == 3 and c.insert_new(rows) == 0
    assert [(r.key, r.track_id) for r in c.tracks().orderBy("track_id").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert list(c.retrieve("a").first().vec) == [0.0, 1.0]


def _files(folder, name, vecs, power=None, times=None):
    made = {"features": f"{folder}/{name}.f"}
    (folder / f"{name}.f").write_bytes(np.array([len(vecs[0])], np.uint32).tobytes() + np.array(vecs, np.float64).tobytes())
    if power is not None:
        (folder / f"{name}.p").write_bytes(np.array([1], np.uint32).tobytes() + np.array(power, np.float64).tobytes())
        made["power"] = f"{folder}/{name}.p"
    if times is not None:
        (folder / f"{name}.t").write_text("\n".join(map(str, times)))
        made["times"] = f"{folder}/{name}.t"
    return made


def test_files_in_and_out(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c")
    c.enable_power()
    a = _files(tmp_path, "a", [(0, 1), (1, 0)], [-1, -2], [0, 1, 2.5]) | {"key": "first"}
    b = _files(tmp_path, "b", [(2, 3)], [-3], [0, 7])
    assert c.insert_files([a, b, a]) == 2 and c.insert_files([a]) == 0
    assert {r.key for r in c.tracks().collect()} == {"first", b["features"]}
    assert [(r.power, r.t_start, r.t_end) for r in c.retrieve("first").collect()] == [(-1, 0, 1), (-2, 1, 2.5)]
    with pytest.raises(SeqSiftError):
        c.insert_files([_files(tmp_path, "d", [(0, 1), (1, 0)], [-1], [0, 1, 2])])
    listed = c.dump(f"{tmp_path}/out").collect()
    assert [r.nvectors for r in listed] == [2, 1]
    with pytest.raises(SeqSiftError):
        c.dump(f"{tmp_path}/out")
    again = Collection.restore(spark, f"{tmp_path}/out", f"{tmp_path}/again")
    key = lambda x: sorted((r.key, r.pos, tuple(r.vec), r.power, r.t_start, r.t_end) for r in x.vectors().collect())
    assert key(again) == key(c)


def test_windows_across_chunks(spark):
    rows = spark.createDataFrame([(t, str(t), i, [float(i)], float(i)) for t in range(2) for i in range(50)], "track_id int, key string, pos int, vec array<double>, power double")
    got = {(r.track_id, r.pos): (list(r.sh), r.pow) for r in shingles(rows, 4, power=True, chunk=7).collect()}
    assert got == {(t, i): ([float(i + k) for k in range(4)], i + 1.5) for t in range(2) for i in range(47)}
    assert sliding(rows, 60, {"x": __import__("pyspark.sql.functions", fromlist=["sum"]).sum("power")}).count() == 0
    sums = prefix_sums(spark.createDataFrame([(i, i) for i in range(20)], "track_id int, n int"), "track_id", "n", "before", bucket=3)
    assert {r.track_id: r.before for r in sums.collect()} == {i: sum(range(i)) for i in range(20)}


def test_probes_are_nearest_first():
    into = np.array([0.1, 0.5, 0.8])
    found = probes(into, 5)
    cost = lambda p: sum(into[f] ** 2 if d < 0 else (1 - into[f]) ** 2 for f, d in p)
    every = [()]
    for f in range(3):
        every = [e + m for e in every for m in ((), ((f, -1),), ((f, 1),))]
    want = sorted(cost(e) for e in every if e)[:5]
    assert [pytest.approx(cost(p)) for p in found] == want and all(len({f for f, _ in p}) == len(p) for p in found)


def test_index_answers_are_among_the_exact_ones(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    data = {f"t{i}": [tuple(base[i] + rng.normal(0, 0.02, 8)) for _ in range(5)] for i in range(40)}
    v = tracks(spark, data)
    index = Index.build(v, f"{tmp_path}/i", length=1, radius=0.3, normed=True, k=4, tables=12, w=1.0)
    spec = QuerySpec(QueryId(1, 0, True), Params(Distance.NORMED, Accumulation.DB, 10_000), Refine(radius=0.3))
    q = datum(spark, [tuple(b) for b in base[:10]])
    exact = set(points(search(v, q, spec)))
    found = set(points(search(v, q, spec, index=Index.load(spark, f"{tmp_path}/i", v))))
    assert found <= exact and len(found) >= 0.9 * len(exact) >= 45
    loose = QuerySpec(QueryId(1, 0, True, True), spec.params, spec.refine)
    near = search(v, q, loose, index=index).collect()
    assert {(r.ikey, r.qpos, r.ipos) for r in near} >= {(k, j, i) for k, _, j, i in found} and {r.dist for r in near} == {0.3}
    assert not index.serves(QuerySpec(QueryId(), Params(Distance.DOT, Accumulation.DB), Refine(radius=0.3)))
    assert not index.serves(QuerySpec(QueryId(), Params(Distance.NORMED, Accumulation.DB), Refine(radius=0.4)))
    index.append(tracks(spark, {"new": [tuple(base[0])]}).withColumn("track_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(40)))
    assert "new" in {r.ikey for r in search(index.vectors, q, spec, index=index).collect()}
    assert sum(r.points for r in index.statistics().collect()) == 12 * 201
    assert Family(8).cells(np.zeros((1, 8)))[0].shape == (1, 10, 6)


def test_samples(spark):
    rng = np.random.default_rng(1)
    data = {f"t{i}": [tuple(rng.normal(size=3)) for _ in range(10)] for i in range(4)} | {"zero": [(0, 0, 0)]}
    v = tracks(spark, data)
    got = sample_distances(v, 60, kind=Distance.NORMED, seed=2).collect()
    assert len(got) == 60 and all(r.qkey != r.ikey and "zero" not in (r.qkey, r.ikey) for r in got)
    for r in got:
        x, y = np.array(data[r.qkey][r.qpos]), np.array(data[r.ikey][r.ipos])
        assert r.dist == pytest.approx(2 - 2 * x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    q = datum(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    assert {r.qpos for r in sample_distances(v, 20, datum=q, qid=QueryId(1, 1)).collect()} == {1}
    assert {r.qpos for r in sample_distances(v, 60, datum=q, qid=QueryId(1, 0, True)).collect()} == {0, 1, 2}
    for bad in (dict(kind=Distance.KL), dict(refine=Refine(radius=1)), dict(refine=Refine(duration_ratio=1))):
        with pytest.raises(SeqSiftError):
            sample_distances(v, 5, **bad)
    assert 0 < estimate_radius(sample_distances(v, 100), 1000) < 3
    assert math.isfinite(estimate_radius(sample_distances(v, 100), 10))


@pytest.mark.parametrize("way", list(Accumulation))
def test_standing_query(spark, tmp_path, way):
    rng = np.random.default_rng(5)
    data = {f"t{i}": [tuple(rng.normal(size=2)) for _ in range(6)] for i in range(6)}
    v, q = tracks(spark, data), datum(spark, [tuple(rng.normal(size=2)) for _ in range(4)])
    spec = QuerySpec(QueryId(2, 0, True), Params(Distance.EUCLIDEAN, way, 2, 3))
    for i in range(3):
        v.where(f"track_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    standing = StandingQuery(q, spec, f"{tmp_path}/state")
    assert standing.results(spark).count() == 0
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    standing.start(stream, f"{tmp_path}/cp").awaitTermination()
    assert points(standing.results(spark)) == points(search(v, q, spec))
    again = StandingQuery(q, spec, f"{tmp_path}/state")  # a new process finds the state
    assert points(again.results(spark)) == points(search(v, q, spec))


def test_round_trip_of_all_events(spark):
    d = "/root/testdata/sf0.001"
    shown = lambda v: sorted((r.key, r.pos, r.vec[0], round(r.power, 6), round(r.t_start, 3), round(r.t_end, 3)) for r in v.collect())
    assert shown(queries.roundtrip(spark, d)) == shown(A.events(spark, d))


def test_round_trip_reads_rows_once(spark, tmp_path, monkeypatch):
    """What is added is computed once; a dump is restored by tasks that read its files, without a list on the driver."""
    made_rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made_rows.add(batch.num_rows)
            yield batch

    n = 500
    rows = spark.createDataFrame([(str(t), i, [t + i / 8, float(i)], math.nan if i == 1 else float(t), float(i), i + 1.0, t) for t in range(n) for i in range(1 + t % 3)], "key string, pos int, vec array<double>, power double, t_start double, t_end double, ord int")
    c = Collection.create(spark, f"{tmp_path}/c")
    c.enable_power()
    c.insert(rows.mapInArrow(seen, rows.schema))
    assert made_rows.value == rows.count()
    # The list is more than a batch long, a track longer than one.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert c.dump(f"{tmp_path}/out").count() == n
        monkeypatch.setattr("seqsift.sources.files.read_tracks", lambda *x: pytest.fail("a list of all tracks on the driver"))
        again = Collection.restore(spark, f"{tmp_path}/out", f"{tmp_path}/again")
        key = lambda x: sorted((r.track_id, r.key, r.pos, tuple(r.vec), str(r.power), r.t_start, r.t_end) for r in x.vectors().collect())
        assert key(again) == key(c) and len(key(c)) == rows.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not list((tmp_path / "c" / "staged").iterdir()) and again.meta == c.meta
    empty = Collection.create(spark, f"{tmp_path}/none")
    empty.dump(f"{tmp_path}/nothing")
    assert Collection.restore(spark, f"{tmp_path}/nothing", f"{tmp_path}/still").vectors().count() == 0

def test_tracks_by_reference(spark, tmp_path):
    made = Collection.create(spark, f"file://{tmp_path}/kept")
    made.enable_power()
    made.insert(tracks(spark, {"a": [(0, 1), (1, 0), (1, 1)], "b": [(2, 2)]}, powers={"a": [-1, -2, -3], "b": [-4]}, times={"a": [(0, 1), (1, 2), (2, 4)], "b": [(0, 3)]}).withColumn("ord", F.col("track_id")))
    made.dump(f"{tmp_path}/out")
    listed = {n: (tmp_path / "out" / n).read_text().split() for n in ("featureList.txt", "timesList.txt", "powerList.txt", "keyList.txt")}
    assert listed == {"featureList.txt": ["00000.features", "00001.features"], "timesList.txt": ["00000.times", "00001.times"], "powerList.txt": ["00000.power", "00001.power"], "keyList.txt": ["a", "b"]}
    assert "seqsift.sources.restore" in (tmp_path / "out" / "restore.sh").read_text()
    item = lambda n, key: {"key": key} | {k: f"{tmp_path}/out/{n:05d}.{k}" for k in ("features", "power", "times")}
    refs = Collection.create(spark, f"file://{tmp_path}/refs", by_reference=True)
    refs.enable_power()
    assert refs.insert_references([item(0, "a"), item(1, "b"), item(1, "a")]) == 2 and refs.insert_references([item(1, "b")]) == 0
    columns = ["key", "pos", "vec", "power", "t_start", "t_end"]
    same = lambda c: sorted(map(tuple, c.vectors().select(*columns).collect()))
    assert same(refs) == same(made) and refs.listing().collect() == made.listing().collect()
    assert [r.vec for r in refs.retrieve("b").collect()] == [[2.0, 2.0]]
    (tmp_path / "three.features").write_bytes(np.array([3], np.uint32).tobytes() + np.zeros(3).tobytes())
    for bad in ([{"features": f"{tmp_path}/out/00000.features"}], [item(0, "c") | {"features": f"{tmp_path}/none"}], [item(0, "c") | {"features": f"{tmp_path}/three.features"}]):
        with pytest.raises(SeqSiftError):
            refs.insert_references(bad)
    with pytest.raises(SeqSiftError):
        refs.insert(tracks(spark, {"z": [(0, 1)]}))
    with pytest.raises(SeqSiftError):
        made.insert_references([item(0, "c")])


def test_a_batch_stops_at_its_first_error(spark, tmp_path):
    made = Collection.create(spark, f"file://{tmp_path}/c")
    one = lambda key, vec=(0, 1): tracks(spark, {key: [vec]})
    with pytest.raises(SeqSiftError):
        made.insert_batch([one("a"), one("b"), one("a"), one("c")])
    assert [r.key for r in made.listing().collect()] == ["a", "b"]
    assert made.insert_batch([one("c"), one("d")]) == 2
    with pytest.raises(SeqSiftError):
        made.insert_batch([one("e", (0, 1, 2)), one("f")])
    assert made.tracks().count() == 4


def test_numbers_follow_the_order_over_ranges(spark, tmp_path):
    made = Collection.create(spark, f"file://{tmp_path}/c")
    rows = spark.createDataFrame([(999 - i, f"k{i:03d}", 0, [1.0]) for i in range(200)], "ord int, key string, pos int, vec array<double>")
    made.insert(rows.repartition(7))
    made.insert(spark.createDataFrame([(0, "x", 0, [1.0])], rows.schema))
    assert [r.key for r in made.listing().collect()] == [f"k{i:03d}" for i in reversed(range(200))] + ["x"]
    assert sorted(r.track_id for r in made.tracks().collect()) == list(range(201))


def test_indexes_are_found_and_merged(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = {f"t{i}": rng.normal(size=(6, 3)).tolist() for i in range(8)}
    rows = tracks(spark, data)
    low, high = rows.where("track_id < 4"), rows.where("track_id >= 4")
    catalog = Catalog(spark, f"file://{tmp_path}/lsh")
    first = catalog.build(low, radius=0.5, length=2, normed=True, k=2, tables=4, w=1e6)
    other = Index.build(high, f"file://{tmp_path}/other", radius=0.5, length=2, normed=True, k=2, tables=4, w=1e6)
    with pytest.raises(SeqSiftError):
        first.merge(Index.build(high, f"file://{tmp_path}/bad", radius=0.5, length=2, normed=True, k=3, tables=4, w=1e6))
    with pytest.raises(SeqSiftError):
        first.merge(first)
    first.merge(other)
    asked = datum(spark, data["t1"][:2])
    spec = QuerySpec(QueryId(2), Params(Distance.NORMED, Accumulation.DB, 50), Refine(radius=0.5))
    found = Catalog(spark, f"file://{tmp_path}/lsh")
    assert found.find(rows, spec) is found.find(rows, spec) is not None
    assert found.find(rows, QuerySpec(QueryId(3), spec.params, spec.refine)) is None and found.find(rows, QuerySpec(QueryId(2), spec.params, Refine())) is None
    assert points(search(rows, asked, spec, catalog=found)) == points(search(rows, asked, spec))


def test_scaling_and_loudness(spark):
    sh = shingles(tracks(spark, {"a": [(3, 4), (0, 0), (0, 2)]}, powers={"a": [-1, -2, -5]}), 1, power=True, dim=2)
    assert [r.scaled for r in scaled(sh, 4.0, True).orderBy("pos").collect()] == [[pytest.approx(0.3), pytest.approx(0.4)], None, [0.0, 0.5]]
    assert [r.scaled for r in scaled(sh, 4.0, False).orderBy("pos").collect()] == [[1.5, 2.0], [0.0, 0.0], [0.0, 1.0]]
    assert tuple(loud_enough(sh, -2).first()) == (3, 2) and tuple(loud_enough(sh.drop("pow"), -2).first()) == (3, None)

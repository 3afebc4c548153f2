"""Small hand-made collections with known answers."""

import math
import random

import pytest
from helpers import datum, kl, points, tracks

from seqsift.model import Accumulation, Distance, Params, QueryId, QuerySpec, Refine, SeqSiftError
from seqsift.plans.query import matched_filter, n_sequence_query, one_to_one_query, point_query, search, sequence_query, track_datum, track_query

A = {"T": [(0, 1), (1, 0)]}
B = {"01": [(0, 1)], "10": [(1, 0)]}
D4 = {"T": [(0, 1), (1, 0), (1, 0), (0, 1)]}
E = {"1": [(0, 1)], "3": [(1, 0), (0, 1), (1, 0)]}
F = {"01": [(0, 1), (1, 0)], "10": [(1, 0), (0, 1)]}
HALF = [(0, 0.5)]
DOT, NORMED, EUC, KL = Distance.DOT, Distance.NORMED, Distance.EUCLIDEAN, Distance.KL
DB, PER, ONE = Accumulation.DB, Accumulation.PER_TRACK, Accumulation.ONE_TO_ONE


def ask(spark, data, query, kind, way, *, powers=None, qpowers=None, length=1, start=0, exhaustive=False, npoints=10, ntracks=10, **refine):
    spec = QuerySpec(QueryId(length, start, exhaustive), Params(kind, way, npoints, ntracks), Refine(**refine))
    return points(search(tracks(spark, data, powers), datum(spark, query, qpowers), spec))


def test_dot_product_of_all(spark):
    assert ask(spark, {"T": [(1,)]}, [(1,)], DOT, DB) == [("T", 1, 0, 0)]
    assert ask(spark, A, HALF, DOT, DB) == [("T", 0, 0, 1), ("T", 0.5, 0, 0)]
    assert ask(spark, A, HALF, DOT, DB, npoints=1) == [("T", 0.5, 0, 0)]


def test_normed_per_track(spark):
    assert ask(spark, A, HALF, NORMED, PER) == [("T", 0, 0, 0), ("T", 2, 0, 1)]
    assert ask(spark, A, HALF, NORMED, PER, npoints=1) == [("T", 0, 0, 0)]
    assert ask(spark, {"T": [(0, 0.5), (0.5, 0)]}, HALF, NORMED, PER) == [("T", 0, 0, 0), ("T", 2, 0, 1)]


def test_tracks_are_ranked(spark):
    assert ask(spark, B, HALF, NORMED, PER) == [("01", 0, 0, 0), ("10", 2, 0, 0)]
    assert ask(spark, B, HALF, NORMED, PER, ntracks=1) == [("01", 0, 0, 0)]
    assert ask(spark, B, HALF, DOT, PER) == [("01", 0.5, 0, 0), ("10", 0, 0, 0)]
    assert ask(spark, B, HALF, DOT, PER, ntracks=1) == [("01", 0.5, 0, 0)]


def test_query_must_be_long_enough(spark):
    for bad in ({"length": 16}, {"start": 1}):
        with pytest.raises(SeqSiftError):
            ask(spark, A, HALF, NORMED, PER, **bad)
    with pytest.raises(SeqSiftError):
        ask(spark, A, [(1, 2, 3)], NORMED, PER)
    for bad in (dict(length=0), dict(length=1, start=-1)):
        with pytest.raises(SeqSiftError):
            QueryId(**bad)
    with pytest.raises(SeqSiftError):
        Params(DOT, DB, 0)


def test_radius_and_keys(spark):
    assert ask(spark, B, HALF, NORMED, PER, radius=5) == [("01", 0, 0, 0), ("10", 2, 0, 0)]
    assert ask(spark, B, HALF, NORMED, PER, radius=1) == [("01", 0, 0, 0)]
    assert ask(spark, B, HALF, NORMED, PER, include_keys=()) == []
    assert ask(spark, B, HALF, NORMED, PER, include_keys=("01",)) == [("01", 0, 0, 0)]
    assert ask(spark, B, HALF, NORMED, PER, include_keys=("10",)) == [("10", 2, 0, 0)]
    assert ask(spark, B, HALF, NORMED, PER, exclude_keys=("01",)) == [("10", 2, 0, 0)]
    assert ask(spark, B, HALF, NORMED, PER, include_keys=("10",), radius=1) == []


def test_start_and_exhaustive(spark):
    q = [(0, 0.5), (0.5, 0)]
    assert ask(spark, B, q, NORMED, PER, start=1) == [("01", 2, 1, 0), ("10", 0, 1, 0)]
    assert ask(spark, B, q, NORMED, PER, exhaustive=True) == [("01", 0, 0, 0), ("01", 2, 1, 0), ("10", 0, 1, 0), ("10", 2, 0, 0)]
    assert ask(spark, B, q, NORMED, PER, exhaustive=True, npoints=1) == [("01", 0, 0, 0), ("10", 0, 1, 0)]


def test_powers(spark):
    p = {"T": [-0.5, -1]}
    both = [("T", 0, 0, 0), ("T", 2, 0, 1)]
    for absolute, want in ((-1.4, both), (-0.6, both[:1]), (-0.2, [])):
        assert ask(spark, A, HALF, NORMED, PER, powers=p, qpowers=[-0.5], absolute_threshold=absolute) == want
    assert ask(spark, A, HALF, NORMED, PER, powers=p, qpowers=[-0.5], relative_threshold=1) == both
    assert ask(spark, A, HALF, NORMED, PER, powers=p, qpowers=[-0.5], relative_threshold=-0.2) == both[:1]
    with pytest.raises(SeqSiftError):
        ask(spark, A, HALF, NORMED, PER, powers=p, relative_threshold=1)


def test_sequences_of_two(spark):
    q, p = [(0, 0.5), (0, 0.5), (0.5, 0)], {"T": [-0.5, -1, -1, -0.5]}
    assert ask(spark, D4, q, NORMED, PER, length=2) == [("T", 1, 0, 0), ("T", 1, 0, 2), ("T", 2, 0, 1)]
    assert ask(spark, D4, q, NORMED, PER, length=2, start=1) == [("T", 0, 1, 0), ("T", 1, 1, 1), ("T", 2, 1, 2)]
    strong = dict(powers=p, qpowers=[-0.5, -1, -1], absolute_threshold=-0.8)
    assert [x[3] for x in ask(spark, D4, q, NORMED, PER, length=2, **strong)] == [0, 2]
    assert ask(spark, D4, q, NORMED, PER, length=2, start=1, **strong) == []
    assert [x[3] for x in ask(spark, D4, q, NORMED, PER, length=2, radius=1.1)] == [0, 2]
    assert ask(spark, D4, q, NORMED, PER, length=2, radius=0.9) == []
    assert ask(spark, D4, q, NORMED, PER, length=2, start=1, radius=0.9) == [("T", 0, 1, 0)]


def test_short_tracks_never_match(spark):
    # (1,0),(0,1) against (0,1),(1,0): each difference is (1,-1), squared 2 + 2; shifted by one they are equal.
    assert ask(spark, E, [(0, 1), (1, 0)], EUC, PER, length=2, npoints=1) == [("3", 0, 0, 1)]


def test_n_sequence(spark):
    assert ask(spark, F, HALF, NORMED, PER) == [("01", 0, 0, 0), ("01", 2, 0, 1), ("10", 0, 0, 1), ("10", 2, 0, 0)]
    assert ask(spark, F, HALF, NORMED, PER, npoints=1) == [("01", 0, 0, 0), ("10", 0, 0, 1)]


def test_hops(spark):
    q = [(0, 1), (1, 0)]
    for hops, n in ((dict(), 8), (dict(qhop=2), 4), (dict(ihop=2), 6), (dict(ihop=3), 4), (dict(qhop=0, ihop=0), 8)):
        assert len(ask(spark, E, q, EUC, DB, exhaustive=True, **hops)) == n


def test_divergence(spark):
    data = {"a": [(0.5, 0.5, 0)], "b": [(0.2, 0.3, 0.5)], "c": [(0.4, 0.6, 0)]}
    q = (0.4, 0.6, 0)
    found = {r.ikey: r.dist for r in search(tracks(spark, data), datum(spark, [q]), QuerySpec(QueryId(), Params(KL, DB))).collect()}
    for k, v in data.items():
        assert found[k] == pytest.approx(kl(q, v[0]))
    assert math.isinf(found["b"]) and found["c"] == 0


def test_zero_norms_vanish(spark):
    assert ask(spark, {"z": [(0, 0)], "x": [(0, 1)]}, HALF, NORMED, DB) == [("x", 0, 0, 0)]


def test_ties_fall_by_track_and_place(spark):
    same = {k: [(1, 0), (1, 0)] for k in "abc"}
    assert ask(spark, same, [(1, 0)], EUC, DB, npoints=3) == [("a", 0, 0, 0), ("a", 0, 0, 1), ("b", 0, 0, 0)]
    assert ask(spark, same, [(1, 0)], EUC, ONE, exhaustive=True) == [("a", 0, 0, 0)]


def test_one_to_one(spark):
    found = points(one_to_one_query(tracks(spark, B), datum(spark, [(0, 0.5), (0.5, 0)]), 1, radius=1))
    assert found == [("01", 0, 0, 0), ("10", 0, 1, 0)]


def test_durations(spark):
    data, times = {"short": [(0, 1), (1, 0)], "long": [(0, 1), (1, 0)]}, {"short": [(0, 1), (1, 2)], "long": [(0, 4), (4, 8)]}
    v = tracks(spark, data, times=times)
    spec = QuerySpec(QueryId(), Params(NORMED, PER), Refine(duration_ratio=0.5))
    q = datum(spark, [(0, 1), (1, 0)], times=[(0, 1), (1, 2)])
    assert {r.ikey for r in search(v, q, spec).collect()} == {"short"}
    # The ratio is strict: 1 s against 1.5 s.
    v2 = tracks(spark, {"edge": [(0, 1)]}, times={"edge": [(0, 1.5)]})
    assert search(v2, q, spec).count() == 0
    with pytest.raises(SeqSiftError):
        search(v, datum(spark, [(0, 1)]), spec)


def test_earlier_results_compete(spark):
    v, spec = tracks(spark, F), QuerySpec(QueryId(), Params(NORMED, DB, 2))
    first = search(v.where("track_id = 0"), datum(spark, HALF), spec)
    both = search(v.where("track_id = 1"), datum(spark, HALF), spec, sofar=first)
    assert points(both) == points(search(v, datum(spark, HALF), spec))


def test_query_by_key_and_names(spark):
    v = tracks(spark, F)
    assert points(point_query(v, track_datum(v, "01"), 1)) == [("01", 1, 0, 0)]
    assert {r.ikey for r in track_query(v, track_datum(v, "01")).collect()} == {"01", "10"}
    means = {r.ikey: r.mean_dist for r in sequence_query(v, datum(spark, HALF), 1).collect()}
    assert means == {"01": pytest.approx(1), "10": pytest.approx(1)}
    assert points(n_sequence_query(v, datum(spark, HALF), 1, 1)) == [("01", 0, 0, 0), ("10", 0, 0, 1)]
    with pytest.raises(SeqSiftError):
        track_datum(v, "none")


def test_infinite_powers_stay_in_their_frames(spark):
    data = {"T": [(0, 1), (0, 1), (0, 1), (0, 1)]}
    p = {"T": [-math.inf, -0.5, -0.5, -0.5]}
    found = ask(spark, data, [(0, 1), (0, 1)], EUC, DB, powers=p, qpowers=[-0.5, -0.5], length=2, absolute_threshold=-1)
    assert [x[3] for x in found] == [1, 2]


@pytest.mark.parametrize("kind", [DOT, NORMED, EUC])
@pytest.mark.parametrize("length", [1, 3, 20])
def test_against_brute_force(spark, kind, length):
    rng = random.Random(length)
    data = {f"k{t}": [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(rng.randint(1, 40))] for t in range(6)}
    query = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(length + 3)]
    want = []
    for t, (k, vecs) in enumerate(data.items()):
        for i in range(len(vecs) - length + 1):
            for j in range(len(query) - length + 1):
                x, y = sum(query[j : j + length], ()), sum(vecs[i : i + length], ())
                dot = sum(a * b for a, b in zip(x, y, strict=True))
                d = {DOT: dot, EUC: sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), NORMED: 2 - 2 * dot / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))}[kind]
                want.append((-d if kind is DOT else d, t, i, j, k, d))
    want = sorted(want)[:12]
    spec = QuerySpec(QueryId(length, 0, True), Params(kind, DB, 12))
    v, q = tracks(spark, data), datum(spark, query)
    exact = sorted((k, j, i, round(d, 6)) for _, _, i, j, k, d in want)
    assert sorted((r.ikey, r.qpos, r.ipos, round(r.dist, 6)) for r in search(v, q, spec).collect()) == exact
    assert sorted((r.ikey, r.qpos, r.ipos, round(r.dist, 6)) for r in matched_filter(v, q, spec).collect()) == exact

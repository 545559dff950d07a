"""Time joins against brute force."""

import random

import pytest

from eventloom.operators import matching as m
from eventloom.operators import timejoin as tj


def make(spark, seed, n, span):
    rng = random.Random(seed)
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 4), rng.randint(0, span), i, float(rng.randint(0, 50))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, t long, id long, v double")


@pytest.fixture(scope="module", params=[(1, 200), (2, 3000)])
def sides(spark, request):
    seed, span = request.param
    return make(spark, seed, 80, span), make(spark, seed + 10, 60, span)


@pytest.mark.parametrize("later", [False, True])
def test_nearest(sides, later):
    (left, ldf), (right, rdf) = sides
    got = {r.id: r.delta for r in tj.nearest(ldf, rdf, ["k"], "t", "id", 100, tolerance=30, later_wins=later).collect()}
    for k, t, i, _ in left:
        deltas = [abs(t - u) for kk, u, _, _ in right if kk == k and abs(t - u) <= 30]
        assert got[i] == (min(deltas) if deltas else None)


def test_nearest_tie_sides(spark):
    left = spark.createDataFrame([(1, 10, 0)], "k int, t long, id long")
    right = spark.createDataFrame([(1, 8, 1), (1, 12, 2)], "k int, t long, id long")
    assert tj.nearest(left, right, ["k"], "t", "id", None).first().near.id == 1
    assert tj.nearest(left, right, ["k"], "t", "id", None, later_wins=True).first().near.id == 2


def test_interpolate(sides):
    (left, ldf), (right, rdf) = sides
    got = {r.id: r.at_v for r in tj.interpolate(ldf, rdf, ["k"], "t", "id", 100, ["v"]).collect()}
    for k, t, i, _ in left:
        pts = sorted((u, n, v) for kk, u, n, v in right if kk == k)
        if not pts:
            assert got[i] is None
            continue
        prior = [p for p in pts if p[0] <= t]
        later = [p for p in pts if p[0] > t]
        if not prior:
            want = later[0][2]
        elif not later or prior[-1][0] == t:
            want = prior[-1][2]
        else:
            (t0, _, v0), (t1, _, v1) = prior[-1], later[0]
            want = v0 + (v1 - v0) * (t - t0) / (t1 - t0)
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("tol", [0, 1, 25])
def test_within(sides, tol):
    (left, ldf), (right, rdf) = sides
    got = sorted((r.id, r.r_id) for r in tj.within(ldf, rdf, ["k"], "t", tol).collect())
    assert got == sorted((i, j) for k, t, i, _ in left for kk, u, j, _ in right if k == kk and abs(t - u) <= tol)


def test_within_left_keeps_lonely_rows(sides):
    (left, ldf), (right, rdf) = sides
    got = tj.within_left(ldf, rdf, ["k"], "t", 3, "id").collect()
    assert {r.id for r in got} == {i for _, _, i, _ in left}


def test_overlaps(spark):
    rng = random.Random(3)
    a = [(1, s, s + rng.randint(0, 90), i) for i, s in enumerate(rng.sample(range(500), 40))]
    b = [(1, s, s + rng.randint(1, 40), i) for i, s in enumerate(rng.sample(range(500), 40))]
    left = spark.createDataFrame(a, "k int, a0 long, a1 long, i long")
    right = spark.createDataFrame(b, "k int, b0 long, b1 long, j long")
    got = sorted((r.i, r.j) for r in tj.overlaps(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 30, ["i", "j"]).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[2] > y[1] and y[2] > x[1] and x[2] > x[1])


def test_interval_stats_and_companions_without_pairs(spark):
    rng = random.Random(8)
    points = [(rng.randint(1, 2), rng.randint(0, 90), i, rng.choice("ab")) for i in range(60)]
    blocks = [(rng.randint(1, 2), rng.randint(0, 90), rng.choice("xyz")) for _ in range(40)]
    p = spark.createDataFrame(points, "k int, t long, id long, v string")
    b = spark.createDataFrame(blocks, "k int, t long, fam string")
    tol = 3
    got = tj.interval_stats(tj.covered(b, ["k", "fam"], "t", tol), p, ["k"], ["fam"], "t", "id", "v", block_ms=10).collect()
    for r in got:
        hi = max(t + tol for k, t, f in blocks if (k, f) == (r.k, r.fam) and any(t - tol <= u + tol for kk, u, ff in blocks if (kk, ff) == (k, f) and u >= r.lo) and _reached(blocks, r, t, tol))
        inside = sorted((t, i, v) for k, t, i, v in points if k == r.k and r.lo <= t <= hi)
        assert r.n == len(inside)
        if inside:
            assert r["first"] == inside[0][2] and r.same == (len({v for *_, v in inside}) == 1)
    by_fam = {}
    for r in got:
        by_fam[r.k, r.fam] = by_fam.get((r.k, r.fam), 0) + r.n
    for (k, fam), n in by_fam.items():
        assert n == sum(any(kk == k and f == fam and abs(t - u) <= tol for kk, u, f in blocks) for kp, t, *_ in points if kp == k)
    want = {}
    for k, t, i, _ in points:
        for kk, u, f in blocks:
            if k == kk and abs(t - u) <= tol:
                n, c = want.get((k, i, f), (0, tol))
                want[k, i, f] = (n + 1, min(c, abs(t - u)))
    assert {(r.k, r.id, r.fam): (r.blocks, r.closest) for r in m.companions(p, b, ["k"], "t", "id", "fam", tol).collect()} == want


def _reached(blocks, r, t, tol) -> bool:
    """Is t in the run of blocks that starts at the interval's low end?"""
    own = sorted({u for k, u, f in blocks if (k, f) == (r.k, r.fam) and u - tol >= r.lo})
    end = own[0]
    for u in own:
        if u - end > 2 * tol:
            break
        end = u
    return t <= end and t - tol >= r.lo


def test_association_keeps_labels_with_nulls(spark):
    schema = "k int, t long, id long"
    labels = spark.createDataFrame([(1, 10, 1), (1, 50, 2), (None, 10, 3), (1, None, 4), (1, 10, None), (2, 10, 5)], schema)
    groups = spark.createDataFrame([(1, 9, 1), (1, 12, 2), (1, 52, 3), (None, 10, 4), (2, 90, 5)], schema)
    got = sorted((str(r.k), str(r.t), str(r.id), r.groups, r.association) for r in m.association(labels, groups, ["k"], "t", "id", 3).collect())
    assert got == sorted([
        ("1", "10", "1", 2, "ambiguous"), ("1", "50", "2", 1, "one"), ("None", "10", "3", 0, "none"), ("1", "None", "4", 0, "none"), ("1", "10", "None", 0, "none"), ("2", "10", "5", 0, "none")
    ])

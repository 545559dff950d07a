"""One-to-one matching, assignment and folds against sequential or exhaustive versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import assign as a
from eventloom.operators import folds as fd
from eventloom.operators import matching as m
from eventloom.operators import ordered as o
from eventloom.operators import sweeps as sw


def streams(spark, seed, n, span):
    rng = random.Random(seed)
    d = [(rng.randint(1, 2), rng.randint(0, span), i) for i in range(n)]
    r = [(rng.randint(1, 2), rng.randint(0, span), 1000 + i) for i in range(n)]
    schema = "k int, t long, id long"
    return d, r, spark.createDataFrame(d, schema), spark.createDataFrame(r, schema)


@pytest.mark.parametrize("seed,tol,block", [(1, 1, 10), (2, 4, 7), (3, 15, None)])
def test_greedy_is_first_unused(spark, seed, tol, block):
    d, r, ddf, rdf = streams(spark, seed, 40, 120)
    used, want = set(), set()
    for k, t, i in sorted(d, key=lambda v: (v[1], v[2])):
        hit = next((j for kk, u, j in sorted(r, key=lambda v: (v[1], v[2])) if kk == k and j not in used and abs(u - t) <= tol), None)
        if hit is not None:
            used.add(hit)
            want.add((i, hit))
    got = m.greedy_match(ddf, rdf, ["k"], "t", "id", tol, block).collect()
    pairs = {(g.decoded_id, g.oracle_id) for g in got if g.decoded_id is not None and g.oracle_id is not None}
    assert pairs == want
    assert len(got) == len(d) + len(r) - len(want)


@pytest.mark.parametrize("seed,tol", [(4, 3), (5, 10)])
def test_optimal_beats_every_alternative(spark, seed, tol):
    d, r, ddf, rdf = streams(spark, seed, 7, 30)
    got = m.optimal_match(ddf, rdf, ["k"], "t", "id", tol, 10).collect()
    hits = [abs(g.decoded_t - g.oracle_t) for g in got if g.decoded_id is not None and g.oracle_id is not None]
    best = (0, 0)
    for key in (1, 2):
        left = sorted(t for k, t, _ in d if k == key)
        right = sorted(t for k, t, _ in r if k == key)
        top = (0, 0)
        for n in range(min(len(left), len(right)) + 1):
            for x in itertools.combinations(left, n):
                for y in itertools.combinations(right, n):
                    gaps = [abs(p - q) for p, q in zip(x, y)]
                    if all(g <= tol for g in gaps):
                        top = max(top, (n, -sum(gaps)))
        best = (best[0] + top[0], best[1] + top[1])
    assert (len(hits), -sum(hits)) == best


def best_value(left, right, tol):
    """(-matches, total, largest) of the best order-keeping matching, by the full grid."""
    v = {(0, 0): (0, 0, 0)}
    for i, j in itertools.product(range(len(left) + 1), range(len(right) + 1)):
        if i or j:
            options = [v[c] for c in ((i - 1, j), (i, j - 1)) if c in v]
            if i and j and abs(left[i - 1] - right[j - 1]) <= tol:
                a_, b_, c = v[i - 1, j - 1]
                delta = abs(left[i - 1] - right[j - 1])
                options.append((a_ - 1, b_ + delta, max(c, delta)))
            v[i, j] = min(options)
    return v[len(left), len(right)]


@pytest.mark.parametrize("seed,n,span,tol,slices", [(1, 60, 400, 9, 1), (2, 60, 400, 9, 3), (3, 150, 2500, 20, 2), (4, 40, 60, 5, 64), (5, 25, 10, 0, 1)])
def test_optimal_match_over_slices(spark, seed, n, span, tol, slices):
    rng = random.Random(seed)
    d = [(rng.choice([1, 1, None]), rng.randint(0, span), i) for i in range(n)] + [(2, None, -1)]
    r = [(rng.choice([1, 1, None]), rng.randint(0, span), 1000 + i) for i in range(n)] + [(1, None, -2)]
    schema = "k int, t long, id long"
    got = m.optimal_match(spark.createDataFrame(d, schema), spark.createDataFrame(r, schema), ["k"], "t", "id", tol, 50, slices).collect()
    assert sorted(g.decoded_id for g in got if g.decoded_id is not None) == sorted(x[2] for x in d)
    assert sorted(g.oracle_id for g in got if g.oracle_id is not None) == sorted(x[2] for x in r)
    for key in (1, None):
        hits = sorted((g.decoded_t, g.oracle_t) for g in got if g.k == key and g.decoded_id is not None and g.oracle_id is not None)
        assert all(x <= y for (_, x), (_, y) in zip(hits, hits[1:]))
        gaps = [abs(x - y) for x, y in hits]
        left, right = (sorted(t for k, t, _ in side if k == key and t is not None) for side in (d, r))
        assert (-len(gaps), sum(gaps), max(gaps, default=0)) == best_value(left, right, tol)


def test_three_way_outcome(spark):
    d = spark.createDataFrame([(1, "a", 10, 1), (1, "b", 20, 2), (1, "c", 99, 3)], "k int, v string, t long, id long")
    r = spark.createDataFrame([(1, "a", 11, 11), (1, "x", 21, 12), (1, "y", 500, 13)], "k int, v string, t long, id long")
    got = {x.decoded_id or x.oracle_id: x.outcome for x in m.label_outcomes(d, r, ["k"], ["v"], "t", "id", 1).collect()}
    assert got == {1: "matched", 2: "wrong", 3: "extra", 12: "missing", 13: "missing"}


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(9)
    rows = [(g, s_, e, round(rng.random(), 3)) for g in range(4) for s_ in range(4) for e in range(5) if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, "g int, slot int, entity int, score double")


def test_optimal_assignment_is_exhaustive_best(edge):
    rows, df = edge
    got = a.optimal_assignment(df, ["g"], "slot", "entity").groupBy("g").agg(F.sum("score").alias("s")).collect()
    for r in got:
        score = {(s_, e): v for g, s_, e, v in rows if g == r.g}
        best = max(
            sum(score[p] for p in zip(slots, ents))
            for n in range(5) for slots in itertools.combinations(range(4), n) for ents in itertools.permutations(range(5), n)
            if all(p in score for p in zip(slots, ents))
        )
        assert r.s == pytest.approx(best)


def test_greedy_assignment_is_sequential_greedy(edge):
    rows, df = edge
    want = set()
    for g in range(4):
        us, ue = set(), set()
        for _, s_, e in sorted((-v, s_, e) for gg, s_, e, v in rows if gg == g):
            if s_ not in us and e not in ue:
                us.add(s_), ue.add(e), want.add((g, s_, e))
    assert {(r.g, r.slot, r.entity) for r in a.greedy_assignment(df, ["g"], "slot", "entity").collect()} == want


def likeness(a_, b_, of_a, of_b) -> float:
    return math.sqrt((1 / (1 + abs(a_ - of_a) / max(abs(of_a) * 0.5, 1e-9))) * (1 / (1 + abs(b_ - of_b) / max(abs(of_b) * 0.1, 400.0))))


def sequential_clusters(rows, minimum: float) -> dict:
    """(band, i) to the number of its cluster, entry by entry."""
    leaders, out = {}, {}
    for band, i, s_, c in sorted(rows, key=lambda r: (r[0], r[1])):
        own = leaders.setdefault(band, [])
        like = [likeness(s_, c, *x) for x in own]
        best = like.index(max(like)) if like else None
        if best is None or like[best] < minimum:
            own.append((s_, c))
            best = len(own) - 1
        out[band, i] = best
    return out


@pytest.mark.parametrize("n,minimum,first,block", [(30, 0.58, 2048, 1024), (600, 0.58, 16, 4), (30_000, 0.72, 2048, 64)])
def test_leader_clusters_sequential(spark, n, minimum, first, block):
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.choice([1.0, 1.05, -3.0, 8.0]) * rng.uniform(0.2, 5), rng.choice([0.0, 100.0, 9000.0]) * rng.uniform(0.5, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "band int, i int, slope double, icpt double")
    got = {(r.band, r.i): r.cluster for r in a.leader_clusters(df, ["band"], ["i"], "slope", "icpt", minimum, first, block).collect()}
    assert got == sequential_clusters(rows, minimum)


def test_leader_clusters_missing_numbers_and_ties(spark):
    rows = [(1, 0, None, 1.0), (1, 1, 2.0, 5.0), (1, 1, 2.0, 5.0), (1, 2, float("nan"), 5.0), (1, 3, 2.1, 5.0), (None, 4, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "band int, i int, slope double, icpt double")
    got = sorted((r.i, r.cluster) for r in a.leader_clusters(df, ["band"], ["i"], "slope", "icpt", 0.58).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 2), (3, 1)]
    assert a.leader_clusters(df.filter("i > 9"), ["band"], ["i"], "slope", "icpt", 0.58).count() == 0


POLICIES = ["removed_first", "removed_last", "removed_lowest", "lowest"]


@pytest.mark.parametrize("width,fan_in", [(7, 64), (1000, 64), (2, 3)])
@pytest.mark.parametrize("key", [1, None])
def test_slot_fold_matches_one_pass(spark, width, fan_in, key):
    rng = random.Random(11)
    rows = [(key, rng.randint(0, 60), i, rng.random() < 0.6, rng.randint(0, 6)) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, t long, i long, add boolean, slot int")
    out = fd.slot_fold(df, ["k"], "t", ["t", "i"], o.time_block("t", width), F.col("add"), "slot", POLICIES, fan_in).collect()
    assert len(out) == 4 * len(rows) and {r.k for r in out} == {key}
    for policy in POLICIES:
        one_pass(rows, policy, {r.i: (r.action, r.at_slot) for r in out if r.policy == policy})


def one_pass(rows, policy, got):
    slots = [False] * 7
    for t in sorted({r[1] for r in rows}):
        group = sorted((r for r in rows if r[1] == t), key=lambda r: r[2])
        removed = []
        for r in (r for r in group if not r[3]):
            assert got[r[2]] == ("hit" if slots[r[4]] else "empty", r[4])
            slots[r[4]] = False
            removed.append(r[4])
        for r in (r for r in group if r[3]):
            free = [s_ for s_ in removed if not slots[s_]]
            pick = {"removed_first": free[:1], "removed_last": free[-1:], "removed_lowest": sorted(free)[:1], "lowest": []}[policy]
            at = pick[0] if pick else next((s_ for s_ in range(7) if not slots[s_]), -1)
            assert got[r[2]] == ("overflow" if at < 0 else "add", at)
            if at >= 0:
                slots[at] = True
                if at in removed:
                    removed.remove(at)


def test_multiset_fold_matches_one_pass(spark):
    rng = random.Random(1)
    rows = [(1, rng.randint(1, 3), t, rng.choice([1, -1])) for t in range(120)]
    df = spark.createDataFrame(rows, "k int, item int, t long, d long")
    got = {r.t: (r["count"], r.held) for r in fd.multiset_fold(df, ["k"], "item", ["t"], o.time_block("t", 11), F.col("d")).collect()}
    bag = {1: 0, 2: 0, 3: 0}
    for _, item, t, d in rows:
        bag[item] = max(0, bag[item] + d)
        assert got[t] == (bag[item], sum(bag.values()))


def test_closure(spark):
    edges = spark.createDataFrame([(4, 2), (2, 1), (5, 2), (1, 0)], "c int, p int")
    got = {(r.node, r.ancestor) for r in fd.closure(edges, "c", "p").collect()}
    assert got == {(4, 2), (4, 1), (4, 0), (2, 1), (2, 0), (5, 2), (5, 1), (5, 0), (1, 0)}


def test_leave_one_out_lookup(spark):
    rows = [(m_, k, l) for m_, k, l in [(1, 7, "a"), (2, 7, "a"), (3, 7, "b"), (1, 8, "c"), (2, 9, "d"), (3, 9, "d")]]
    df = spark.createDataFrame([(0, *r) for r in rows], "s int, m int, k int, l string")
    got = {r.m: (r.exact, r.wrong, r.unavailable) for r in sw.leave_one_out_lookup(df, "m", ["s"], "k", "l").collect()}
    want = {}
    for m_ in (1, 2, 3):
        e = w = u = 0
        for mm, k, l in rows:
            if mm == m_:
                others = {x for m2, kk, x in rows if m2 != m_ and kk == k}
                if len(others) != 1:
                    u += 1
                elif l in others:
                    e += 1
                else:
                    w += 1
        want[m_] = (e, w, u)
    assert got == want


def test_unions_and_greedy_cover_exhaustively(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        ch = sorted(v for v in range(1, 9) if rng.random() < 0.25)
        rows.append((i, ch, bool(set(ch) & {2, 5, 7})))
    df = spark.createDataFrame(rows, "i int, ch array<int>, hit boolean")
    cover, patterns = sw.change_patterns(df, "ch", "hit")
    clean = [v for v in range(1, 9) if not any(v in ch and not hit for _, ch, hit in rows) and any(v in ch for _, ch, _ in rows)]
    hits = [set(ch) & set(clean) for _, ch, hit in rows if hit]
    want = {
        "+".join(map(str, u)) for n in (1, 2, 3) for u in itertools.combinations(clean, n) if all(h & set(u) for h in hits)
    }
    assert {r.union_of for r in sw.exact_unions(patterns).collect()} == want and "2+5+7" in want
    got = [(r.offset, r.gain) for r in sw.greedy_cover(patterns).orderBy("step").collect()]
    left, expect = list(hits), []
    while any(left):
        best = min(clean, key=lambda v: (-sum(v in h for h in left), v))
        expect.append((best, sum(best in h for h in left)))
        left = [h for h in left if best not in h]
    assert got == expect


def test_sweep_reads_mixed_lengths_and_null_entities(spark):
    from eventloom.operators import sweeps as sw

    rows = [(None if i % 3 == 0 else i % 2, [i % 256, i * 7 % 256] if i == 5 else [i % 256, i * 7 % 256, i * 13 % 256, 9], float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "e int, arr array<int>, y double").coalesce(1)
    fields = [sw.Field(spec=0, kind="u", offset=0, width=4), sw.Field(spec=1, kind="u", offset=1, width=1)]
    seen = []
    for size in ("10000", "10"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sw.moments(df, ["e"], "arr", ["y"], fields).groupBy("e", "spec").agg(F.sum("n").alias("n")).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        seen.append(sorted((str(r.e), r.spec, r.n) for r in got))
    assert seen[0] == seen[1]
    assert sum(n for _, spec, n in seen[0] if spec == 0) == 99 and sum(n for _, spec, n in seen[0] if spec == 1) == 100


def test_assignment_is_optimal_above_twelve(spark):
    rng = random.Random(9)
    rows = [(1, s_, e, rng.random()) for s_ in range(15) for e in range(14) if rng.random() < 0.7]
    out = a.optimal_assignment(spark.createDataFrame(rows, "g int, s int, e int, score double"), ["g"], "s", "e").collect()
    assert len({r.s for r in out}) == len({r.e for r in out}) == len(out)
    best = {0: 0.0}
    by_slot = {}
    for _, s_, e, score in rows:
        by_slot.setdefault(s_, []).append((e, score))
    for options in by_slot.values():
        grown = dict(best)
        for mask, total in best.items():
            for e, score in options:
                if not mask >> e & 1 and total + score > grown.get(mask | 1 << e, -1):
                    grown[mask | 1 << e] = total + score
        best = grown
    assert abs(sum(r.score for r in out) - max(best.values())) < 1e-9


def test_quantile_blocks_survive_an_outlier(spark):
    from eventloom.operators import quantiles as q

    df = spark.range(10_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("v"))
    got = q.quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).first()
    values = sorted([1e12, *map(float, range(1, 10_000))])
    assert got.p50 == (values[4999] + values[5000]) / 2
    assert abs(got.p99 - (values[9899] + (values[9900] - values[9899]) * 0.01)) < 1e-6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_unions_against_all_subsets(spark, seed):
    rng = random.Random(seed)
    rows = [(sorted(rng.sample(range(8), rng.randint(1, 6))), rng.randint(1, 4)) for _ in range(12)]
    got = {(r.union_of, r["size"], r.covered) for r in sw.exact_unions(spark.createDataFrame(rows, "pattern array<int>, n long")).collect()}
    total = sum(n for _, n in rows)
    want = {("+".join(map(str, u)), k, total) for k in (1, 2, 3) for u in itertools.combinations(range(8), k) if all(set(u) & set(p) for p, _ in rows)}
    assert got == want


def test_components_without_a_choice_skip_the_program():
    """Lone rows, one-sided components and pairs are answered a table at a time; groups may end anywhere in a batch."""
    import pyarrow as pa

    from eventloom.operators import monotone

    kinds = pa.schema([("k", pa.float64()), ("component", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("first", pa.int32())])
    groups = [(None, 1, [0]), (None, 2, [0, 1]), (float("nan"), 1, [1, 0]), (1.0, 1, [1, 1, 1]), (1.0, 2, [0, 1, 0]), (2.0, 1, [1])]
    rows = [(k, c, s, 100 * at + n, n, None) for at, (k, c, sides) in enumerate(groups) for n, s in enumerate(sides)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[a:a + 2]], schema=kinds) for a in range(0, len(rows), 2)]
    found, left = [], []
    for table, cuts in monotone._whole_groups(iter(batches), ["k", "component"]):
        done, rest = monotone._plain(table, cuts, ["k"], ["k", "decoded_id", "oracle_id", "decoded_t", "oracle_t"])
        found += zip(*[done.column(c).to_pylist() for c in ("decoded_id", "oracle_id", "decoded_t", "oracle_t")])
        left += [table["id"].slice(a, b - a).to_pylist() for a, b, r in zip(cuts, cuts[1:], rest) if r]
    want = [(0, None, 0, None), (100, 101, 0, 1), (201, 200, 1, 0), (None, 300, None, 0), (None, 301, None, 1), (None, 302, None, 2), (None, 500, None, 0)]
    assert sorted(found, key=str) == sorted(want, key=str) and left == [[400, 401, 402]]


def test_pair_across_a_slice_bound_needs_no_table(spark, monkeypatch):
    from eventloom.operators import monotone

    monkeypatch.setattr(monotone, "_chosen", lambda *_: pytest.fail("two rows leave no choice"))
    d = spark.createDataFrame([(1, 99, 1), (None, 199, 2)], "k int, t long, id long")
    r = spark.createDataFrame([(1, 101, 7), (None, 202, 8)], "k int, t long, id long")
    got = m.optimal_match(d, r, ["k"], "t", "id", 10, 50, 10).collect()
    assert sorted(tuple(x) for x in got if x.k) == [(1, 1, 7, 99, 101)] and [tuple(x) for x in got if not x.k] == [(None, 2, 8, 199, 202)]


@pytest.mark.parametrize("long", [0, 100, 1 << 16])
def test_final_slots_follow_the_fold(spark, long):
    """A slot is taken at the end if its last add or hit was an add; short tracks are one block, long ones many."""
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 60), i, rng.random() < 0.6, rng.randint(0, 6)) for k, n in ((1, 150), (2, 40), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, t long, i long, add boolean, slot int")
    args = (df, ["k"], "t", ["t", "i"], o.time_block("t", 7), F.col("add"), "slot", POLICIES, 3, long)
    want, whole = {}, sorted((tuple(r) for r in fd.slot_fold(*args[:-1], 0).collect()), key=str)
    assert sorted((tuple(r) for r in fd.slot_fold(*args).collect()), key=str) == whole
    place = {r[2]: (r[1], r[3], r[2]) for r in rows if r[0] == 1}
    for r in sorted((r for r in fd.slot_fold(*args).collect() if r.k == 1 and r.action in ("add", "hit")), key=lambda r: place[r.i]):
        want[r.policy, r.at_slot] = r.action == "add"
    got = {(r.policy, r.slot): r.taken for r in fd.final_slots(*args).collect() if r.k == 1}
    assert len(got) == 28 and got == {k: want.get(k, False) for k in got}


def test_multiset_relation_has_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(o, "TASK_ROWS", 50, raising=False)
    left = spark.range(500).select((F.col("id") % 250).alias("k"), (F.col("id") % 3).alias("v"))
    right = left.filter("k > 0").unionByName(left.filter("k = 1"))
    got = m.multiset_relation(left, right, ["k"], "v").withColumn("task", F.spark_partition_id()).collect()
    assert {(r.k, r.equal, r.subset) for r in got} == {(0, False, False), (1, False, True)} | {(k, True, True) for k in range(2, 250)}
    assert len({r.task for r in got}) > 10

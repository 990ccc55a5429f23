"""Metrics, order statistics, generators, smoothing and store checks against brute force and worked cases."""

import math
import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import generators, hardness, keys, layout, runs, smoothing, store


def ranked(spark, ks):
    return spark.createDataFrame([(int(k), r) for r, k in enumerate(ks)], "key long, rank long")


def fits(points, eps):
    lo = hi = None
    for j in range(len(points)):
        for i in range(j):
            dx, dy = points[j][0] - points[i][0], points[j][1] - points[i][1]
            a, b = Fraction(dy - 2 * eps, dx), Fraction(dy + 2 * eps, dx)
            lo, hi = a if lo is None else max(lo, a), b if hi is None else min(hi, b)
    return lo is None or lo <= hi


def test_segments_against_all_pairs_of_points():
    rng = random.Random(1)
    for _ in range(300):
        ks = sorted(rng.randrange(rng.choice([20, 60, 1000, 2**64])) for _ in range(rng.randrange(1, 25)))
        points, eps, count, at = hardness.corridor(np.array(ks, object), np.arange(len(ks))), rng.choice([0, 1, 2, 3]), 0, 0
        while at < len(points):
            end = at + 1
            while end < len(points) and fits(points[at : end + 1], eps):
                end += 1
            count, at = count + 1, end
        assert hardness.least_segments(points, eps) == count


def test_segments_of_known_sequences(spark):
    line = [7 * i + 3 for i in range(3000)]
    stairs = [1_000_000 * k + i for k in range(10) for i in range(100)]
    assert [hardness.segments(line, e) for e in (0, 1, 32)] == [2, 1, 1] and [hardness.segments(stairs, e) for e in (32, 4096)] == [10, 1]
    assert hardness.segments([2**64 - 1000 + i for i in range(1000)], 0) == 1 and hardness.segments([5, 5, 5, 5], 1) == 1
    got = {r.epsilon: (r.n, r.segments, r.ranges) for r in hardness.pla_segments(ranked(spark, stairs), (32, 4096), range_keys=250).collect()}
    assert got[32][0] == 1000 and got[32][2] == 4 and 10 <= got[32][1] <= 13
    whole = hardness.pla_segments(ranked(spark, stairs), (32,)).first()
    assert (whole.segments, whole.ranges) == (10, 1)


def test_segments_of_keys_that_come_in_parts(spark):
    rng = random.Random(3)
    ks = sorted(rng.randrange(3000) ** 2 for _ in range(2000))
    path, made = hardness.Corridor(), [hardness.Segments(e) for e in (0, 2, 32)]
    for at in range(0, 2000, 37):
        points = path.take(np.array(ks[at : at + 37]), np.arange(2000)[at : at + 37])
        for s in made:
            s.take(points)
    for s in made:
        s.take(path.end())
    assert [s.count for s in made] == [hardness.segments(ks, e) for e in (0, 2, 32)]
    # ranges of 300 keys, in batches that end anywhere: what each range's own keys give, only the last with a point after its end
    parts = [(hardness.corridor(np.array(ks[at : at + 300], object), np.arange(2000)[at : at + 300]), at + 300 >= 2000) for at in range(0, 2000, 300)]
    want = {e: sum(hardness.least_segments(p if last else p[:-1], e) for p, last in parts) for e in (0, 2, 32)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = hardness.pla_segments(ranked(spark, ks).orderBy(F.desc("rank")), (0, 2, 32), range_keys=300).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.epsilon: (r.n, r.segments, r.ranges) for r in got} == {e: (2000, n, 7) for e, n in want.items()}


def test_segments_of_a_long_range_hold_little():
    path, made, rng = hardness.Corridor(), hardness.Segments(32), np.random.default_rng(4)
    tracemalloc.start()
    for at in range(0, 200_000, 5000):
        made.take(path.take(np.arange(at, at + 5000) * 50 + rng.integers(0, 50, 5000), np.arange(at, at + 5000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.count >= 1 and peak < 4e6  # with lists of all points it took 32 MB


def naive_fit(x, gap):
    n, cap = len(x), len(x) * (gap + 1)
    unit = lambda d: (x[n - 1 - d] - x[d]) / (cap - 2) + 1e-6
    d = 1
    while 3 * d <= n:
        first = next((i for i in range(n - d) if x[i + d] - x[i] < unit(d)), None)
        before = next((i for i in range(n - d + 1) if x[i + d - 1] - x[i] < unit(d - 1)), None) if d > 1 else None
        if first is None or d > 1 and (before if before is not None else n) >= n - 1 - d:
            return d
        d += 1
    return d


@pytest.mark.parametrize(
    "ks, d, cd, fallback",
    [
        ([*range(50), *(10**6 + 100 * j for j in range(950))], 50, 50, False),
        ([*(10**4 * j for j in range(600)), *(6 * 10**6 + i for i in range(400))], 334, 333, True),
        ([10 * i for i in range(2000)], 1, 1, False),
        ([2**62 + i for i in range(1000)], 1, 1, False),
    ],
)
def test_conflicts_of_known_sequences(spark, ks, d, cd, fallback):
    r = ranked(spark, ks).cache()
    assert hardness.fmcd_fit(r)["fallback"] == fallback
    got = hardness.fmcd_conflicts(r).first()
    assert (got.fmcd_d, got.conflict_degree, got.capacity) == (d, cd, 6 * len(ks))
    assert naive_fit(ks, 5) == d or fallback


def test_conflicts_of_few_keys(spark):
    assert [hardness.fmcd_conflicts(ranked(spark, ks)).first().conflict_degree for ks in ([], [4], [4, 9])] == [0, 1, 1]


def test_order_statistics_against_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice([None, *range(30)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v long")
    for r in keys.order_statistics(df.filter("g is not null"), ["g"], "v", {"median": 0.5, "p10": 0.1, "p99": 0.99}).collect():
        v = sorted(x for g, x in rows if g == r.g and x is not None)
        at = lambda q: v[max(math.ceil(len(v) * q) - 1, 0)]
        assert (r.n, r["median"], r.p10, r.p99) == (len(v), float(np.median(v)), at(0.1), at(0.99))
    assert keys.order_statistics(df.filter("false"), ["g"], "v", {"median": 0.5}).count() == 0
    numbered = keys.numbered(spark.createDataFrame([(i % 3, 100 - i) for i in range(30)], "g long, o long"), ["g"], ["o"]).collect()
    assert all(r.j == sum(1 for x in numbered if x.g == r.g and x.o < r.o) and r.n == 10 for r in numbered)


def test_tail_conflicts(spark):
    assert hardness.tail_conflicts(ranked(spark, range(1000))).first().tail_conflict == 0
    assert hardness.tail_conflicts(ranked(spark, [10**6 * k + i for k in range(100) for i in range(10)])).first().tail_conflict > 0


def test_smoothing_lowers_the_error(spark):
    ks = np.array([1, 2, 3, 4, 5, 10, 20, 26, 27, 30])
    x, virtual = smoothing.virtual_points(ks, 0.3)
    assert virtual.sum() <= 3 and (x[~virtual] == ks - 1).all() and (np.diff(x) > 0).all()
    rng = random.Random(4)
    big = [(r, k) for r in range(3) for k in sorted(rng.sample(range(10**6 if r else 60), 50))]
    s = smoothing.smooth_regions(spark.createDataFrame(big, "region long, key long"), 0.2)
    for r in smoothing.smoothing_gain(s).collect():
        assert r["keys"] == 50 and r.points <= 10 and (r.points == 0 or r.sse_after <= r.sse_before + 1e-6)
    assert len(smoothing.virtual_points(np.zeros(0, np.int64), 0.5)[0]) == 0


def test_store_checks(spark):
    g = keys.regions(ranked(spark, range(0, 900, 3)), 100)
    fences = spark.createDataFrame([(0, 0), (1, 300), (2, 600)], "region long, fence long")
    assert store.validate(g, fences).count() == 300
    with pytest.raises(ValueError):
        store.validate(g, fences.withColumn("fence", F.when(F.col("region") == 1, 400).otherwise(F.col("fence"))))
    with pytest.raises(ValueError):
        keys.require_ascending(spark.createDataFrame([(1, 0), (1, 1)], "key long, pos long"))
    assert keys.require_ascending(spark.createDataFrame([(1, 0), (1, 1)], "key long, pos long"), distinct=False).count() == 2
    a, b = (spark.createDataFrame(rows, "k long, v long, w string") for rows in ([(1, 1, "x"), (2, None, None), (3, 3, "z")], [(1, 1, "y"), (2, None, None), (4, 4, "q")]))
    assert {(r.k, r.side, *r.fields) for r in store.differences(a, b, ["k"]).collect()} == {(1, "both", "w"), (3, "left"), (4, "right")}
    probes = spark.createDataFrame([(i, k) for i, k in enumerate([-5, 0, 299, 300, 10**9, 300])], "probe long, key long")
    assert {r.probe: r.region for r in store.route(probes, fences).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 1}


def test_codec_budget(spark):
    sizes = layout.block_sizes(keys.regions(ranked(spark, [k * k for k in range(600)]), 300))
    cost = {"raw": 1.0, "for": 1.25, "delta": 6.0, "linear": 1.5}
    totals = [tuple(r) for r in layout.priced(sizes, (0.0, 1.0), cost).orderBy("lambda").select("bytes", "cost").collect()]
    found = layout.cheapest_within(sizes, cost, totals[1][0] + 300)
    assert totals[0][1] <= found[2] <= totals[1][1] and totals[1][0] <= found[1] <= totals[1][0] + 300
    assert layout.cheapest_within(sizes, cost, 10) is None
    hot = spark.createDataFrame([(1,)], "region long")
    assert {r.codec for r in layout.adaptive_bytes(sizes, hot, 0.5).filter("region = 1").collect()} == {"raw"}


def test_generated_rows_depend_on_their_number(spark):
    for kind in (*generators.STEPS, "lognormal"):
        got = {r.i: r.key for r in generators.synthetic(spark, kind, 5000).collect()}
        assert got == {r.i: r.key for r in generators.synthetic(spark, kind, 5000).repartition(7).collect()} and len(got) == 5000
        if kind != "lognormal":
            assert all(got[i] < got[i + 1] for i in range(4999))
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in generators.PROFILES.values())
    trace = generators.read_trace(keys.ranked(spark.range(0, 2000, 2).select(F.col("id").alias("key"))), 500, "hotspot", "balanced").collect()
    assert len(trace) == 500 and {r.key % 2 for r in trace if r.operation == "insert"} == {1}


def test_t_quantile_and_plateau(spark):
    for df, want in ((5, 2.5706), (10, 2.2281), (30, 2.0423), (200, 1.9719)):
        assert abs(spark.range(1).select(runs.t_quantile(F.lit(float(df))).alias("t")).first().t - want) < 0.01
    s = spark.createDataFrame([("a", t, kb) for t, kb in enumerate([10, 90, 100, 99, 98, 50, 97])], "run string, seconds long, kb long")
    r = runs.plateau(s, ["run"]).first()
    assert (r.samples, r.peak, r.fell) == (7, 100, 5) and abs(r.plateau - (90 + 100 + 99 + 98) / 4) < 1e-9


def test_summary_refuses_mixed_traces(spark):
    from rankweave.plans.summaries import _spoilt

    with pytest.raises(ValueError):
        runs.summarise(_spoilt(spark, "/root/testdata/sf0.001"), "click")

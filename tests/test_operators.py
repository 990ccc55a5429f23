import bisect
import random

from rankweave.operators import hardness, keys, store


def table(spark, rows):
    return spark.createDataFrame(rows, "key long, value long, pos long")


def test_least_squares_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (3, 2)], "key long, rank long")
    r = hardness.least_squares(df).first()
    assert abs(r.slope - 9 / 14) < 1e-12 and abs(r.intercept - 1 / 7) < 1e-12
    assert abs(r.rmse - (1 / 42) ** 0.5) < 1e-12 and abs(r.max_error - 3 / 14) < 1e-12


def test_segments_by_hand():
    assert hardness.segments([7 * i + 3 for i in range(2000)], 1) == 1
    stairs = [1_000_000 * k + i for k in range(10) for i in range(100)]
    assert hardness.segments(stairs, 32) == 10
    assert hardness.segments(stairs, 4096) == 1
    assert hardness.segments([], 4) == 0


def feasible(keys_, eps):
    """Whether one line fits, by trying all pairs of bounds."""
    lo = max(((j - i - 2 * eps) / (keys_[j] - keys_[i]) for i in range(len(keys_)) for j in range(i + 1, len(keys_))), default=0)
    hi = min(((j - i + 2 * eps) / (keys_[j] - keys_[i]) for i in range(len(keys_)) for j in range(i + 1, len(keys_))), default=0)
    return len(keys_) < 2 or lo <= hi + 1e-12


def test_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        ks = sorted(rng.sample(range(400), 40))
        eps, count, at = rng.choice([1, 2, 3]), 0, 0
        while at < len(ks):
            end = at + 1
            while end < len(ks) and feasible(ks[at : end + 1], eps):
                end += 1
            count, at = count + 1, end
        assert hardness.least_segments([(k, i) for i, k in enumerate(ks)], eps) == count


def test_store_against_dict(spark):
    rng = random.Random(3)
    base = {rng.randrange(500): i for i in range(200)}
    df = table(spark, [(k, v, v) for k, v in base.items()])
    probes = spark.createDataFrame([(i, rng.randrange(-10, 520)) for i in range(300)], "probe long, key long")
    order = sorted(base)
    for r in store.lower_bound(probes, keys.canonical(df)).collect():
        at = bisect.bisect_left(order, r.key)
        assert r.found_key == (order[at] if at < len(order) else None)
    for r in store.find(probes, df).collect():
        assert r.found == (r.key in base) and r.value == base.get(r.key)


def test_changes_against_dict(spark):
    rng = random.Random(9)
    live, flags = {k: 0 for k in range(0, 60, 2)}, {}
    base = spark.createDataFrame([(k, 0) for k in live], "key long, value long")
    ops = [(s, rng.choice(["upsert", "update", "erase"]), rng.randrange(60)) for s in range(400)]
    for s, kind, k in ops:
        flags[s] = (k not in live) if kind == "upsert" else (k in live)
        if kind == "erase":
            live.pop(k, None)
        elif kind == "upsert":
            live[k] = s
    got = store.change_flags(base, spark.createDataFrame(ops, "seq long, kind string, key long")).collect()
    assert {r.seq: r.flag for r in got} == flags


def test_ranks_and_empty(spark):
    df = table(spark, [(k * k, k, k) for k in range(100)])
    assert sorted((r.key, r["rank"]) for r in keys.ranked(df, parts=7).collect()) == [(k * k, k) for k in range(100)]
    assert keys.ranked(table(spark, [])).count() == 0
    assert keys.canonical(table(spark, [(1, 5, 0), (1, 6, 1)])).first().value == 6

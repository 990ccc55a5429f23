"""Hardness of a key sequence for learned models: least squares, conflict degree, piecewise-linear segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def least_squares(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group (or one row): n, slope, intercept of rank over key - least key, rmse and max_error of the fit."""
    by = by or []
    lo = ranked.groupBy(*by).agg(F.min("key").alias("lo"), F.min("rank").alias("r0"))
    join = (lambda a, b: a.join(b, by)) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))  # one row where not grouped
    rows = join(ranked, lo).select(*by, (F.col("key") - F.col("lo")).cast("double").alias("x"), (F.col("rank") - F.col("r0")).cast("double").alias("y"))
    fit = rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    fit = fit.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).drop("mx", "my")
    e = F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
    return join(rows, fit).groupBy(*by, "n", "slope", "intercept").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_error"))


def conflict_degree(ranked: DataFrame, slots_per_key: float = 1.0) -> DataFrame:
    """Keys in the fullest slot, and slots in use, if keys are spread linearly over n * slots_per_key slots."""
    ends = ranked.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
    slots = F.floor(F.col("n") * F.lit(slots_per_key)).cast("long")
    slot = F.when(F.col("hi") > F.col("lo"), F.expr("cast((cast(key - lo as decimal(38,0)) * (slots - 1)) div (hi - lo) as bigint)")).otherwise(0)
    rows = ranked.crossJoin(F.broadcast(ends)).withColumn("slots", slots)  # one row
    return rows.groupBy(slot.alias("slot")).count().agg(F.max("count").alias("conflict_degree"), F.count("*").alias("slots_used"))


def gap_count(n: int) -> int:
    """Free slots a key that the conflict-degree fit allows."""
    return 1 if n >= 1_000_000 else 2 if n >= 100_000 else 5


def fmcd_fit(ranked: DataFrame, gap: int | None = None) -> dict:
    """The line of few conflicts over a ranked table of different keys: n, capacity, d, slope, and twice_anchor and base with
    slot = slope * (2 * key - twice_anchor) / 2 + base; fallback if no distance d did.

    d is the least distance in ranks at which no window of d + 1 keys is narrower than the unit of the fit, up to the
    last windows of the sequence. A larger d only widens windows and narrows the unit, so it is found by doubling and
    bisection, each step a join of ranks. Beyond a third of the keys two points at the tertiles give the line."""
    n = ranked.count()
    gap = gap_count(n) if gap is None else gap
    capacity = n * (gap + 1)
    fit = {"n": n, "capacity": capacity, "d": 0, "slope": 0.0, "twice_anchor": 0, "base": 0.0, "fallback": False}
    if n < 3:
        return fit
    known: dict[int, int] = {}

    def key_at(*ranks: int) -> list[int]:
        new = [r for r in ranks if r not in known]
        if new:
            known.update((r["rank"], r["key"]) for r in ranked.filter(F.col("rank").isin(new)).select("rank", "key").collect())  # a few ranks
        return [known[r] for r in ranks]

    def unit(d: int) -> float:
        lo, hi = key_at(d, n - 1 - d)
        return (hi - lo) / (capacity - 2) + 1e-6

    def accepted(d: int) -> bool:
        if 3 * d > n:
            return True
        tried = [t for t in (d - 1, d) if t]
        units = F.create_map(*(c for t in tried for c in (F.lit(t), F.lit(unit(t)))))
        ends = ranked.select("rank", F.col("key").alias("at"), F.explode(F.array(*map(F.lit, tried))).alias("t")).select("t", "at", F.col("rank").alias("begin"), (F.col("rank") + F.col("t")).alias("rank"))
        narrow = ends.join(ranked.select("rank", "key"), "rank").filter((F.col("key") - F.col("at")).cast("double") < units[F.col("t")])
        first = {r["t"]: r["f"] for r in narrow.groupBy("t").agg(F.min("begin").alias("f")).collect()}  # two rows at most
        return d not in first or d > 1 and first.get(d - 1, n) >= n - 1 - d

    low, high = 0, 1
    while not accepted(high):
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if accepted(mid) else (mid, high)
    fit["d"] = high
    if 3 * high <= n:
        lo, hi = key_at(high, n - 1 - high)
        return fit | {"slope": 1 / unit(high), "twice_anchor": lo + hi, "base": capacity / 2}
    one, two = (n - 1) // 3, (n - 1) * 2 // 3
    a0, a1, b0, b1 = key_at(one, one + 1, two, two + 1)
    return fit | {"fallback": True, "slope": (two - one) * (gap + 1) / ((b0 + b1 - a0 - a1) / 2), "twice_anchor": a0 + a1, "base": float(one * (gap + 1) + (gap + 1) // 2)}


def fmcd_conflicts(ranked: DataFrame, gap: int | None = None) -> DataFrame:
    """One row: n, fmcd_d, capacity, conflict_degree (keys in the fullest slot of the fit; 1 for under 3 keys, 0 for none), slots_used.

    Slots are a double's floor, so that keys within a rounding of a slot's edge may fall on either side."""
    fit = fmcd_fit(ranked, gap)
    twice = (2 * F.col("key").cast("decimal(38,0)") - F.lit(str(fit["twice_anchor"])).cast("decimal(38,0)")).cast("double")
    place = F.lit(fit["slope"]) * (twice / 2) + F.lit(fit["base"])
    slot = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(max(fit["capacity"] - 1, 0))).cast("long") if fit["n"] >= 3 else F.col("rank")
    counts = ranked.groupBy(slot.alias("slot")).agg(F.count("*").alias("c"))
    return counts.agg(F.lit(fit["n"]).cast("long").alias("n"), F.lit(fit["d"]).cast("long").alias("fmcd_d"), F.lit(fit["capacity"]).cast("long").alias("capacity"), F.coalesce(F.max("c"), F.lit(0)).cast("long").alias("conflict_degree"), F.count("*").alias("slots_used"))


class Corridor:
    """The points that a piecewise model of sorted keys must pass, as the keys come: each key at its rank; where keys repeat, the number
    after them at the last one's rank, if the next key lies beyond it; and last the number after the last key at the rank after it.

    Only the last key is held."""

    def __init__(self):
        self.last: tuple[int, int] | None = None
        self.repeated = False

    def take(self, keys: np.ndarray, ranks: np.ndarray) -> list[tuple[int, int]]:
        """The points that the next keys add."""
        points, last, repeated = [], self.last, self.repeated
        for x, y in zip(map(int, keys), map(int, ranks), strict=True):
            if last is not None and x == last[0]:
                repeated = True
            else:
                if repeated and last[0] + 1 < x:
                    points.append((last[0] + 1, last[1]))
                points.append((x, y))
                repeated = False
            last = (x, y)
        self.last, self.repeated = last, repeated
        return points

    def end(self) -> list[tuple[int, int]]:
        """The point after the last key."""
        return [] if self.last is None else [(self.last[0] + 1, self.last[1] + 1)]


def corridor(keys: np.ndarray, ranks: np.ndarray) -> list[tuple[int, int]]:
    """The points of a whole sequence (see Corridor)."""
    made = Corridor()
    return [*made.take(keys, ranks), *made.end()]


def _turn(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> int:
    """Above 0 if c lies above the line from a to b; exact integers."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


class Segments:
    """Least number of lines such that each of the points (x strictly ascending) is within epsilon of one, runs of points a line; points come in parts.

    A run is kept as the hulls of its points moved up and down by epsilon, and the two extreme lines between them; all tests
    are cross products of integers, so no rounding decides. A tangent's start only moves forward on its hull, so that what lies before it is let go."""

    def __init__(self, epsilon: int):
        self.epsilon, self.count = epsilon, 0
        self._run: tuple = ([], [], None, None)  # hulls, and where the flattest line (from the top) and the steepest (from the floor) end

    def take(self, points: list[tuple[int, int]]) -> None:
        epsilon, (top, floor, flat, steep) = self.epsilon, self._run
        t = f = 0  # where on the hulls the two lines start
        for x, y in points:
            up, down = (x, y + epsilon), (x, y - epsilon)
            if not top or flat is not None and (_turn(top[t], flat, up) < 0 or _turn(floor[f], steep, down) > 0):
                self.count += 1
                top, floor, flat, steep, t, f = [up], [down], None, None, 0, 0
                continue
            if flat is None or _turn(top[t], flat, down) > 0:
                while t + 1 < len(top) and _turn(top[t], down, top[t + 1]) < 0:
                    t += 1
                flat = down
            if steep is None or _turn(floor[f], steep, up) < 0:
                while f + 1 < len(floor) and _turn(floor[f], up, floor[f + 1]) > 0:
                    f += 1
                steep = up
            while len(top) - t >= 2 and _turn(top[-2], top[-1], up) <= 0:
                top.pop()
            top.append(up)
            while len(floor) - f >= 2 and _turn(floor[-2], floor[-1], down) >= 0:
                floor.pop()
            floor.append(down)
        del top[:t], floor[:f]
        self._run = (top, floor, flat, steep)


def least_segments(points: list[tuple[int, int]], epsilon: int) -> int:
    """Least number of lines for a whole list of points (see Segments)."""
    made = Segments(epsilon)
    made.take(points)
    return made.count


def segments(keys: list[int], epsilon: int) -> int:
    """Least number of lines over sorted keys that give every key's rank within epsilon (see corridor for repeated keys and the end)."""
    return least_segments(corridor(np.array(keys, object), np.arange(len(keys))), epsilon)


def pla_segments(ranked: DataFrame, epsilons: tuple[int, ...], range_keys: int = 1_000_000) -> DataFrame:
    """A row per epsilon: n, segments, and ranges, the pieces of range_keys keys that are cut separately.

    With one range (up to range_keys keys) the count is the least there is. Each further range ends a segment that could
    go on, so the least count lies between segments - (ranges - 1) and segments. Keys stream through a task in their order; it holds one
    batch and the hulls of the segment that is open (a few points, unless the keys bend one way all along)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None

        def ended() -> pd.DataFrame:
            if last:
                feed(path.end())
            return pd.DataFrame({"epsilon": list(epsilons), "n": n, "segments": [s.count for s in made]})

        def feed(points: list[tuple[int, int]]) -> None:
            for s in made:
                s.take(points)

        for pdf in batches:
            for number, part in pdf.groupby("range", sort=False):
                if number != at:
                    if at is not None:
                        yield ended()
                    at, last, n, path, made = number, bool(part["last"].iloc[0]), 0, Corridor(), [Segments(e) for e in epsilons]
                feed(path.take(part["key"].to_numpy(), part["rank"].to_numpy()))
                n += len(part)
        if at is not None:
            yield ended()

    n = ranked.agg(F.max("rank").alias("__top"))
    rows = ranked.crossJoin(F.broadcast(n)).select("key", "rank", F.expr(f"rank div {range_keys}").alias("range"), F.expr(f"rank div {range_keys} = __top div {range_keys}").alias("last"))  # one row
    each = rows.repartition("range").sortWithinPartitions("range", "rank").mapInPandas(count, "epsilon int, n long, segments long")
    return each.groupBy("epsilon").agg(F.sum("n").alias("n"), F.sum("segments").alias("segments"), F.count("*").alias("ranges"))


def tail_conflicts(ranked: DataFrame, share: float = 0.99, room: float = 1.5) -> DataFrame:
    """One row: n, slots_used and tail_conflict: keys are put to the floor of their least-squares rank, within [0, room * n); of the
    numbers of keys per used slot the one of nearest rank at `share`, less one."""
    lo = ranked.agg(F.min("key").alias("lo"), F.count("*").alias("n"))
    rows = ranked.crossJoin(F.broadcast(lo)).select("n", (F.col("key") - F.col("lo")).cast("double").alias("x"), F.col("rank").cast("double").alias("y"))  # one row
    fit = rows.agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    place = F.floor(F.round(F.col("b") * (F.col("x") - F.col("mx")) + F.col("my"), 6))
    slot = F.greatest(F.lit(0), F.least(place, F.ceil(F.col("n") * F.lit(room)) - 1)).cast("long")
    held = rows.crossJoin(F.broadcast(fit)).groupBy(slot.alias("slot")).agg(F.count("*").alias("c"))  # one row
    # a row per different count: the share of slots with at most so many
    sizes = held.groupBy("c").agg(F.count("*").alias("slots"))
    upto = sizes.select("c", F.sum("slots").over(Window.orderBy("c")).alias("upto"), F.sum("slots").over(Window.partitionBy()).alias("all"))
    at = upto.filter(F.col("upto") >= F.greatest(F.ceil(F.col("all") * F.lit(share)), F.lit(1))).agg((F.min("c") - 1).alias("tail_conflict"), F.max("all").alias("slots_used"))
    return at.crossJoin(F.broadcast(lo.select("n"))).select("n", "slots_used", "tail_conflict")


def two_stage(ranked: DataFrame, leaves: int) -> DataFrame:
    """One row: leaves, mean and greatest rank error of a root line that picks one of `leaves` lines, each fitted to the keys it is picked for."""
    lo = ranked.agg(F.min("key").alias("lo"), F.count("*").alias("n"))
    rows = ranked.crossJoin(F.broadcast(lo)).select("n", (F.col("key") - F.col("lo")).cast("double").alias("x"), F.col("rank").cast("double").alias("y"))  # one row
    root = rows.agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    leaf = F.floor(F.round((F.col("b") * (F.col("x") - F.col("mx")) + F.col("my")) * F.lit(leaves) / F.col("n"), 6))
    rows = rows.crossJoin(F.broadcast(root)).select("x", "y", F.greatest(F.lit(0), F.least(leaf, F.lit(leaves - 1))).alias("leaf"))
    fit = rows.groupBy("leaf").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    e = F.abs(F.col("y") - F.col("b") * (F.col("x") - F.col("mx")) - F.col("my"))
    return rows.join(fit, "leaf").agg(F.lit(leaves).alias("leaves"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"))

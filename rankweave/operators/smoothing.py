"""Smoothing of a key sequence's distribution by virtual points, per region of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _errors(n: int, sx, sxx, sy, syy, sxy):
    """Squared error of the line of y over x, from sums."""
    vx = sxx - sx * sx / n
    cov = sxy - sx * sy / n
    return syy - sy * sy / n - np.where(vx > 0, cov * cov / np.where(vx > 0, vx, 1), 0)


def virtual_points(keys: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """x and whether it is virtual: the sorted keys (shifted to begin at 0) with at most share * n points put into gaps.

    One point at a time goes where the line of slots over keys then fits best; it moves the slots behind it by one. In a gap the error is
    tried at its ends, middle and quarters. It ends when no point lowers the error."""
    x = keys.astype(np.float64) - float(keys[0]) if len(keys) else np.zeros(0)
    virtual = np.zeros(len(x), bool)
    for _ in range(int(share * len(x))):
        n = len(x)
        y = np.arange(n, dtype=np.float64)
        sums = np.array([x.sum(), (x * x).sum(), y.sum(), (y * y).sum(), (x * y).sum()])
        now = float(_errors(n, *sums))
        left, right = x[:-1], x[1:]
        room = np.flatnonzero(right - left > 1)
        if not len(room):
            break
        tail = np.arange(n - 1, 0, -1)[room]  # points behind each gap
        behind = np.cumsum(x[::-1])[::-1][1:][room]  # their sum
        ys = (room + 1).astype(np.float64)  # the new point's slot
        best = (now - 1e-9 * max(now, 1.0), -1, 0.0)
        for part in (0.0, 0.25, 0.5, 0.75, 1.0):
            at = np.floor(left[room] + 1 + part * (right[room] - left[room] - 2))
            # slots behind move by one: sums of y, y*y and x*y of the points ys .. n-1
            sum_y = (ys + n - 1) * tail / 2
            got = _errors(n + 1, sums[0] + at, sums[1] + at * at, sums[2] + tail + ys, sums[3] + 2 * sum_y + tail + ys * ys, sums[4] + behind + at * ys)
            k = int(np.argmin(got))
            if got[k] < best[0]:
                best = (float(got[k]), int(room[k]) + 1, float(at[k]))
        if best[1] < 0:
            break
        x, virtual = np.insert(x, best[1], best[2]), np.insert(virtual, best[1], True)
    return x, virtual


def smooth_regions(regions: DataFrame, share: float = 0.1) -> DataFrame:
    """region, slot, x (key less the region's first) and virtual, of each region of a table with region and key. A task holds a region, which has a bounded number of keys."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, virtual = virtual_points(np.sort(pdf["key"].to_numpy()), share)
        return pd.DataFrame({"region": pdf["region"].iloc[0], "slot": np.arange(len(x)), "x": x, "virtual": virtual})

    return regions.select("region", "key").groupBy("region").applyInPandas(one, "region long, slot long, x double, virtual boolean")


def smoothing_gain(smoothed: DataFrame) -> DataFrame:
    """Per region: keys, points, and the line's squared error over slots with the points (sse_after) and over ranks without (sse_before)."""
    sse = lambda y, x: F.regr_syy(y, x) - F.coalesce(F.pow(F.regr_sxy(y, x), 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)), F.lit(0.0))
    real = ~F.col("virtual")
    s = smoothed.withColumn("rank", F.sum(real.cast("int")).over(Window.partitionBy("region").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    y, r = F.col("slot").cast("double"), F.col("rank").cast("double")
    return s.groupBy("region").agg(F.count_if(real).alias("keys"), F.count_if("virtual").alias("points"), sse(y, F.col("x")).alias("sse_after"), sse(F.when(real, r), F.when(real, F.col("x"))).alias("sse_before"))

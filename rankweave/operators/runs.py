"""Benchmark runs: summaries, pairing checks, contrasts, transients, noise and verdicts, from tables with a row per run or per chunk of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["dataset", "profile", "variant"]
RUN = ["dataset", "profile", "seed", "repeat"]


def _per(part: str, whole: str) -> str:
    return f"{part} / greatest(1, {whole})"


#: Name of a summary's median -> the run's value, over the nested columns of a result row.
MEASURES = {
    "throughput_median": "throughput",
    "read_hit_p99_median": "latency.read_hit_p99",
    "insert_p99_median": "latency.insert_p99",
    "scan_p99_median": "latency.scan_p99",
    "initial_bytes_per_key": "memory_before.accounted_bytes / initial_rows",
    "final_bytes_per_key": _per("memory_after.accounted_bytes", "final_rows"),
    "key_arena_ratio": _per("memory_before.key_bytes", "8 * initial_rows"),
    "rewrite_bytes_per_operation": "work.bytes_rewritten / operations",
    "decode_work_per_operation": "work.decoded_keys / operations",
    "fence_probes_per_operation": "work.fence_probes / operations",
    "root_probes_per_operation": "work.root_probes / operations",
    "root_model_fraction": "CASE WHEN learned.root_model THEN 1.0 ELSE 0.0 END",
    "correction_per_operation": "work.correction_distance / operations",
    "build_ns_per_key": _per("build_ns", "initial_rows"),
    "flow_region_fraction": _per("coalesce(learned.flow_regions, 0)", "coalesce(learned.regions, 0)"),
    "virtual_points_per_key": _per("coalesce(learned.virtual_points, 0)", "coalesce(learned.keys, 0)"),
    "rank_sse_ratio": "CASE WHEN coalesce(learned.sse_before, 0) > 0 THEN coalesce(learned.sse_after, 0) / learned.sse_before ELSE 1.0 END",
    "preprocess_ns_per_key": _per("(coalesce(learned.smoothing_ns, 0) + coalesce(learned.transform_ns, 0))", "coalesce(learned.keys, 0)"),
    "both_fraction": _per("coalesce(learned.both, 0)", "coalesce(learned.regions, 0)"),
    "flow_fraction": _per("(coalesce(learned.flow, 0) + coalesce(learned.both, 0))", "coalesce(learned.regions, 0)"),
    "virtual_fraction": _per("(coalesce(learned.virtual, 0) + coalesce(learned.both, 0))", "coalesce(learned.regions, 0)"),
    "probes_none": "coalesce(learned.cost_none, 0)",
    "probes_selected": "coalesce(learned.cost_selected, 0)",
}


def mispaired(runs: DataFrame) -> DataFrame:
    """RUN and fingerprints of the runs that were not all given one trace: more than one fingerprint, or a null one."""
    return runs.groupBy(*RUN).agg(F.count_distinct("fingerprint").alias("fingerprints"), F.count_if(F.col("fingerprint").isNull()).alias("nulls")).filter("fingerprints <> 1 or nulls > 0").select(*RUN, "fingerprints")


def disagreeing(runs: DataFrame) -> DataFrame:
    """RUN and checksums of the runs whose results differ between variants."""
    return runs.groupBy(*RUN).agg(F.count_distinct("checksum").alias("checksums")).filter("checksums > 1")


def seed_ratios(runs: DataFrame, baseline: str) -> DataFrame:
    """GROUP, seed, log_ratio: the mean logarithm of a seed's throughputs against the baseline's of the same run."""
    base = runs.filter(F.col("variant") == baseline).select(*RUN, F.col("throughput").alias("__base"))
    return runs.join(base, RUN).groupBy(*GROUP, "seed").agg(F.avg(F.log(F.col("throughput") / F.col("__base"))).alias("log_ratio"))


def summarise(runs: DataFrame, baseline: str) -> DataFrame:
    """A row per GROUP: runs, all_verified, the medians of MEASURES, and speedup, the geometric mean over seeds against the baseline
    (null where no run pairs). Runs of one trace with several fingerprints raise ValueError."""
    bad = mispaired(runs).count()
    if bad:
        raise ValueError(f"{bad} runs pair different traces")
    medians = [F.percentile(F.expr(e).cast("double"), 0.5).alias(name) for name, e in MEASURES.items()]
    out = runs.groupBy(*GROUP).agg(F.count("*").alias("runs"), F.every("verified").alias("all_verified"), *medians)
    return out.join(seed_ratios(runs, baseline).groupBy(*GROUP).agg(F.exp(F.avg("log_ratio")).alias("speedup")), GROUP, "left")


def bootstrap_speedup(runs: DataFrame, baseline: str, samples: int = 2000) -> DataFrame:
    """GROUP, seeds, low, high: the 2.5th and 97.5th percentile (nearest rank) of the speedup over `samples` draws of seeds with replacement.

    Draws come from a congruential generator of sample and place, so that a job run again gives the same. Null for one seed."""
    ratios = seed_ratios(runs, baseline)
    listed = ratios.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("seed", "log_ratio"))).alias("r")).select(*GROUP, F.col("r.log_ratio").alias("r"))  # a group's seeds, as many as repetitions
    k = F.size("r")
    drawn = listed.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("i", F.explode(F.sequence(F.lit(1), k)))
    pick = F.expr("cast((((s * 7919L + i * 104729L + 12345L) * 1103515245L) % 2147483648L) div 65536 % size(r) AS int)")
    means = drawn.groupBy(*GROUP, "s", k.alias("seeds")).agg(F.exp(F.avg(F.get("r", pick))).alias("m"))
    q = lambda p: F.when(F.col("seeds") > 1, F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY m)"))
    return means.groupBy(*GROUP, "seeds").agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY m)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY m)").alias("high")).select(*GROUP, "seeds", F.when(F.col("seeds") > 1, F.col("low")).alias("low"), F.when(F.col("seeds") > 1, F.col("high")).alias("high"))


def t_quantile(df: Column) -> Column:
    """Student's t at 0.975, by the expansion of Cornish and Fisher around the normal quantile."""
    z = 1.959963984540054
    return F.lit(z) + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df * df * df)


def pooled_sigma(runs: DataFrame, cell: list[str]) -> DataFrame:
    """One row: sigma, the deviation of log throughput within cells, and df."""
    c = runs.groupBy(*cell).agg(F.count("*").alias("n"), F.var_samp(F.log("throughput")).alias("v")).filter("n > 1")
    return c.agg(F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("sigma"), F.sum(F.col("n") - 1).alias("df"))


def contrasts(runs: DataFrame, pairs: list[tuple[str, str]], structure: DataFrame | None = None) -> DataFrame:
    """cell, base, dataset, ratio, low, high, n, n_base, null_by_structure; and with dataset null the mean of the others over data sets.

    ratio: exp of the difference of mean logs; the interval is of Student's t with the pooled deviation. structure (dataset, variant, signature):
    where a cell's equals its base's nothing was built differently, so the contrast is noise and left out of the mean."""
    wanted = runs.sparkSession.createDataFrame(pairs, "cell string, base string")  # a row per contrast
    means = runs.groupBy("dataset", "variant").agg(F.avg(F.log("throughput")).alias("m"), F.count("*").alias("n"))
    if structure is None:
        means = means.withColumn("signature", F.lit(None).cast("string"))
    else:
        means = means.join(structure.select("dataset", "variant", "signature"), ["dataset", "variant"], "left")
    a, b = (means.select("dataset", F.col("variant").alias(v), F.col("m").alias(f"m_{v}"), F.col("n").alias(f"n_{v}"), F.col("signature").alias(f"s_{v}")) for v in ("cell", "base"))
    sigma = pooled_sigma(runs, ["dataset", "variant"])
    one = a.join(F.broadcast(wanted), "cell").join(b, ["dataset", "base"]).crossJoin(F.broadcast(sigma))  # one row
    one = one.select("cell", "base", "dataset", "df", (F.col("m_cell") - F.col("m_base")).alias("est"), (F.col("sigma") * F.sqrt(1 / F.col("n_cell") + 1 / F.col("n_base"))).alias("se"), F.col("n_cell").alias("n"), F.col("n_base").alias("n_base"), F.coalesce(F.col("s_cell") == F.col("s_base"), F.lit(False)).alias("null_by_structure"))
    k = F.count("*")
    mean = one.filter("not null_by_structure").groupBy("cell", "base").agg(F.lit(None).cast(one.schema["dataset"].dataType).alias("dataset"), F.first("df").alias("df"), F.avg("est").alias("est"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) / k).alias("se"), F.sum("n").alias("n"), F.sum("n_base").alias("n_base"), F.lit(False).alias("null_by_structure"))
    half = t_quantile(F.col("df")) * F.col("se")
    return one.unionByName(mean).select("cell", "base", "dataset", F.exp("est").alias("ratio"), F.exp(F.col("est") - half).alias("low"), F.exp(F.col("est") + half).alias("high"), "n", "n_base", "null_by_structure")


def transients(chunks: DataFrame, by: list[str], settle: int = 5, least_tolerance: float = 0.05) -> DataFrame:
    """Per run (by) with chunks k and ns: n, median_ns, deficit of the first chunk, spread, tolerance, transient (chunks before `settle` in a row are
    within the tolerance), late (chunks beyond it after that), verdict: 'short' (under 3 chunks), 'steady', 'settles', 'late outliers' or 'never settles'."""
    mid = chunks.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("ns", 0.5).alias("m"), F.min_by("ns", "k").alias("first"), F.min("k").alias("k0"))  # a run's chunks are few
    rows = chunks.join(mid, by)
    spread = rows.groupBy(*by).agg((1.4826 * F.percentile(F.abs(F.col("ns") - F.col("m")), 0.5) / F.first("m")).alias("spread"))
    rows = rows.join(spread, by).withColumn("tolerance", F.greatest(2 * F.col("spread"), F.lit(least_tolerance)))
    rows = rows.withColumn("inside", (F.abs(F.col("ns") / F.col("m") - 1) <= F.col("tolerance")).cast("int"))
    w = Window.partitionBy(*by).orderBy("k")
    rows = rows.withColumn("j", F.row_number().over(w) - 1).withColumn("run", F.min("inside").over(w.rowsBetween(0, settle - 1)))
    at = rows.groupBy(*by, "n", "m", "first", "spread", "tolerance").agg(F.coalesce(F.min(F.when(F.col("run") == 1, F.col("j"))), F.first("n")).alias("transient"))
    late = rows.join(at.select(*by, "transient"), by).groupBy(*by).agg(F.count_if((F.col("j") >= F.col("transient")) & (F.col("inside") == 0)).alias("late"))
    verdict = F.when(F.col("n") < 3, "short").when(F.col("transient") == F.col("n"), "never settles").when(F.col("late") > 0, "late outliers").when(F.col("transient") > 0, "settles").otherwise("steady")
    return at.join(late, by).select(*by, "n", F.col("m").alias("median_ns"), (F.col("first") / F.col("m") - 1).alias("deficit"), "spread", "tolerance", F.col("transient").cast("long").alias("transient"), "late", verdict.alias("verdict"))


def between_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per cell of several runs: n, mean, deviation, cv and range (as shares of the mean) of throughput."""
    g = runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("throughput").alias("mean"), F.stddev_samp("throughput").alias("deviation"), (F.max("throughput") - F.min("throughput")).alias("w")).filter("n > 1")
    return g.select(*by, "n", "mean", "deviation", (F.col("deviation") / F.col("mean")).alias("cv"), (F.col("w") / F.col("mean")).alias("range"))


def run_problems(runs: DataFrame) -> DataFrame:
    """The runs with problems, as a list: exit code, no throughput, reads that failed, warm-up missing."""
    found = F.array_compact(F.array(
        F.when(F.col("exit_code") != 0, F.concat(F.lit("exit code "), F.col("exit_code").cast("string"))), F.when(F.coalesce(F.col("throughput"), F.lit(0.0)) <= 0, "no throughput"),
        F.when(F.col("success_reads") != F.col("operations"), "failed reads"), F.when(F.col("warmup") == 0, "no warm-up"),
    ))
    return runs.withColumn("problems", found).filter(F.size("problems") > 0)


def regression(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n, slope and intercept of y over x, and slope_origin of the line through 0; slopes are 0 where x does not vary."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    got = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"))
    return got.select(*(by or []), "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0).alias("slope_origin"))


def verdict(low: str, high: str, margin: float = 0.0) -> Column:
    """faster, slower or open: whether a ratio's interval lies beyond 1 by more than the margin."""
    return F.when(F.col(low) > 1 + margin, "faster").when(F.col(high) < 1 - margin, "slower").otherwise("open")


def band(measured: str, low: str, high: str) -> Column:
    """inside, above or below a predicted band; null without a measurement."""
    return F.when(F.col(measured) < F.col(low), "below").when(F.col(measured) > F.col(high), "above").when(F.col(measured).isNotNull(), "inside")


def plateau(samples: DataFrame, by: list[str], drop: float = 0.1, trim: float = 0.85) -> DataFrame:
    """Per run of memory samples (seconds, kb): samples, peak, plateau (mean of those of at least `trim` of the peak before the
    first fall of more than `drop` from one sample to the next) and fell, that fall's time (null if there is none)."""
    w = Window.partitionBy(*by).orderBy("seconds")
    s = samples.withColumn("__before", F.lag("kb").over(w)).withColumn("__fell", F.when(F.col("kb") < (1 - drop) * F.col("__before"), F.col("seconds")))
    ends = s.groupBy(*by).agg(F.count("*").alias("samples"), F.max("kb").alias("peak"), F.min("__fell").alias("fell"))
    j = s.join(ends, by)
    kept = (F.col("fell").isNull() | (F.col("seconds") < F.col("fell"))) & (F.col("kb") >= trim * F.col("peak"))
    return j.groupBy(*by, "samples", "peak", "fell").agg(F.avg(F.when(kept, F.col("kb"))).alias("plateau")).select(*by, "samples", "peak", "plateau", "fell")

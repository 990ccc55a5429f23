"""Tests of measured differences: contrasts, Holm's correction, equivalence within a margin, and simulated power.

Runs are reduced to a row per contrast before anything is ordered, so the windows here go over tests, never over runs.
p-values take the normal distribution, which fits from about 30 runs a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.functions import normal_cdf


def contrasts(runs: DataFrame, base: str) -> DataFrame:
    """variant, dataset, diff, se: each variant's mean less that of `base` on the data set; both need two runs.

    runs: variant, dataset, throughput; a null throughput is no run."""
    cells = runs.groupBy("variant", "dataset").agg(F.avg("throughput").alias("mean"), (F.var_samp("throughput") / F.count("throughput")).alias("v")).filter("v is not null")
    b = cells.filter(F.col("variant") == base).select("dataset", F.col("mean").alias("m0"), F.col("v").alias("v0"))
    return cells.filter(F.col("variant") != base).join(b, "dataset").select("variant", "dataset", (F.col("mean") - F.col("m0")).alias("diff"), F.sqrt(F.col("v") + F.col("v0")).alias("se"))


def tested(differences: DataFrame) -> DataFrame:
    """With p: two-sided, of no difference; without deviation it is 1 for equal means and 0 for others."""
    z = F.abs("diff") / F.when(F.col("se") > 0, F.col("se"))
    return differences.withColumn("p", F.coalesce(2 * (1 - normal_cdf(z)), F.when(F.col("diff") == 0, 1.0).otherwise(0.0)))


def holm(tests: DataFrame, family: list[str], by: list[str], p: str = "p") -> DataFrame:
    """With p_holm: the p-value adjusted for all tests of its family; equal p-values are taken in the order of `by`. Null p-values are no tests."""
    within = Window.partitionBy(*family)
    real = tests.filter(F.col(p).isNotNull())
    step = real.withColumn("__left", F.count("*").over(within) - F.row_number().over(within.orderBy(p, *by)) + 1)
    running = within.orderBy(p, F.desc("__left")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return step.withColumn("p_holm", F.least(F.lit(1.0), F.max(F.col(p) * F.col("__left")).over(running))).drop("__left")


def equivalence(differences: DataFrame, margin: float, alpha: float = 0.05) -> DataFrame:
    """With p_equal (two one-sided tests against `margin`) and verdict: equivalent, different, small (both: a real difference within the margin) or undecided."""
    se = F.when(F.col("se") > 0, F.col("se"))
    p_equal = F.greatest(1 - normal_cdf((F.col("diff") + margin) / se), normal_cdf((F.col("diff") - margin) / se))
    out = tested(differences).withColumn("p_equal", F.when(F.col("se") > 0, p_equal).otherwise(F.when(F.abs("diff") < margin, 0.0).otherwise(1.0)))
    equal, differ = F.col("p_equal") < alpha, F.col("p") < alpha
    return out.withColumn("verdict", F.when(equal & differ, "small").when(equal, "equivalent").when(differ, "different").otherwise("undecided"))


def simulated_power(spark: SparkSession, effects: dict[str, tuple[float, float]], n: int, replicates: int, alpha: float = 0.05, gate: str | None = None, seed: int = 1, tasks: int = 32) -> DataFrame:
    """test, alone, holm and gated: how often a test of n runs rejects by itself, with Holm's correction, and with that behind the gate.

    effects: test -> (mean, deviation). The gate is tested first, at alpha; where it does not reject, nothing does (null without a gate).
    Draws depend on seed and tasks only."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("test"), F.lit(float(m)).alias("mean"), F.lit(float(s)).alias("sd")) for t, (m, s) in effects.items())))
    draws = spark.range(0, replicates * n, 1, tasks).select(F.expr(f"id div {n}").alias("replicate"), each.alias("e")).select("replicate", "e.test", (F.col("e.mean") + F.col("e.sd") * F.randn(seed)).alias("x"))
    means = draws.groupBy("replicate", "test").agg(F.avg("x").alias("diff"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("se"))
    one = tested(means)
    others = holm(one.filter(F.col("test") != gate) if gate else one, ["replicate"], ["test"]).select("replicate", "test", "p", (F.col("p_holm") <= alpha).alias("holm"))
    if gate:
        first = one.filter(F.col("test") == gate)
        opened = first.select("replicate", (F.col("p") <= alpha).alias("open"))
        others = others.join(opened, "replicate").withColumn("gated", F.col("holm") & F.col("open")).drop("open")
        others = others.unionByName(first.select("replicate", "test", "p", (F.col("p") <= alpha).alias("holm"), (F.col("p") <= alpha).alias("gated")))
    else:
        others = others.withColumn("gated", F.lit(None).cast("boolean"))
    return others.groupBy("test").agg(F.avg((F.col("p") <= alpha).cast("int")).alias("alone"), F.avg(F.col("holm").cast("int")).alias("holm"), F.avg(F.col("gated").cast("int")).alias("gated"))


def gate_status(checks: DataFrame) -> DataFrame:
    """check_id, status: UNKNOWN without rows to check, PASS without faults, else FAIL or WARN by `severity`. checks: check_id, severity, seen, faults."""
    status = F.when(F.coalesce("seen", F.lit(0)) == 0, "UNKNOWN").when(F.col("faults") == 0, "PASS").otherwise(F.col("severity"))
    return checks.select("check_id", F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), F.coalesce("faults", F.lit(0)).cast("long").alias("faults"), status.alias("status"))

"""Scores of hardness metrics against measured throughput: normalisation, dominance, coverage, conformance and the corpus they hold for.

Tables: hardness (dataset, h: map of metric name to double) and throughput (variant, dataset, mops). Both have a row per data set or
per data set and variant, so pairs of data sets are few; measurements themselves are reduced before they come here.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import sigmoid


def compositions(scalars: tuple[str, ...], most: int = 3) -> dict[str, tuple[str, ...]]:
    """Metric name -> its dimensions: each scalar, and every combination of up to `most` of them (25 of 5)."""
    return {"+".join(c): c for k in range(1, most + 1) for c in combinations(scalars, k)}


def median_throughput(runs: DataFrame) -> DataFrame:
    """variant, dataset, mops: the median of runs (variant, dataset, throughput)."""
    return runs.groupBy("variant", "dataset").agg(F.percentile("throughput", 0.5).alias("mops"))


def normalised(throughput: DataFrame, ddof: int = 0) -> DataFrame:
    """throughput with p_hat: mops in standard deviations over the variant's data sets, 0 where these do not differ."""
    s = throughput.groupBy("variant").agg((F.stddev_samp if ddof else F.stddev_pop)("mops").alias("__s"))
    return throughput.join(s, "variant").select("variant", "dataset", "mops", F.when(F.col("__s") > 0, F.col("mops") / F.col("__s")).otherwise(0.0).alias("p_hat"))


def classified(hardness: DataFrame, metrics: dict[str, tuple[str, ...]]) -> DataFrame:
    """metric, a, b (a < b), hard, easy: for each metric and pair of data sets, which is harder in no dimension less and in one more; null where neither is."""
    table = hardness.sparkSession.createDataFrame([(m, list(d)) for m, d in metrics.items()], "metric string, dims array<string>")  # a row per metric
    x, y = (hardness.select(F.col("dataset").alias(n), F.col("h").alias(f"h{n}")) for n in "ab")
    pairs = x.join(y, F.col("a") < F.col("b")).crossJoin(F.broadcast(table))

    def above(p: str, q: str) -> Column:
        return F.forall("dims", lambda d: F.col(p)[d] >= F.col(q)[d]) & F.exists("dims", lambda d: F.col(p)[d] > F.col(q)[d])

    a_harder, b_harder = above("ha", "hb"), above("hb", "ha")
    return pairs.select("metric", "a", "b", F.when(a_harder, F.col("a")).when(b_harder, F.col("b")).alias("hard"), F.when(a_harder, F.col("b")).when(b_harder, F.col("a")).alias("easy"))


def coverage(pairs: DataFrame) -> DataFrame:
    """metric, comparable, incomparable, coverage: (comparable - incomparable) / all pairs."""
    c, n = F.count("hard"), F.count("*")
    return pairs.groupBy("metric").agg(c.alias("comparable"), (n - c).alias("incomparable"), ((2 * c - n) / n).alias("coverage"))


def conformance(pairs: DataFrame, normal: DataFrame) -> DataFrame:
    """metric, variant, conforming, violating, conformance. Each comparable pair weighs by the sigmoid of the harder's lead in
    p_hat: a lead above 0 is a penalty, else a reward; (reward - penalty) / (reward + penalty), 0 without comparable pairs."""
    p = normal.select("variant", "dataset", "p_hat")
    rows = pairs.filter("hard is not null").join(p.withColumnRenamed("dataset", "hard").withColumnRenamed("p_hat", "ph"), "hard").join(p.withColumnRenamed("dataset", "easy").withColumnRenamed("p_hat", "pe"), ["variant", "easy"])
    gap = F.col("ph") - F.col("pe")
    rows = rows.select("metric", "variant", (gap > 0).alias("bad"), sigmoid(gap).alias("w"))
    got = rows.groupBy("metric", "variant").agg(F.count_if(~F.col("bad")).alias("conforming"), F.count_if("bad").alias("violating"), (F.sum(F.when(F.col("bad"), -F.col("w")).otherwise(F.col("w"))) / F.sum("w")).alias("conformance"))
    every = pairs.select("metric").distinct().crossJoin(F.broadcast(normal.select("variant").distinct()))  # a row per variant
    zero = {"conforming": 0, "violating": 0, "conformance": 0.0}
    return every.join(got, ["metric", "variant"], "left").fillna(zero)


def scored(hardness: DataFrame, throughput: DataFrame, metrics: dict[str, tuple[str, ...]], ddof: int = 0) -> DataFrame:
    """A row per metric: dims, coverage, conformance (the mean over variants), comparable and incomparable pairs."""
    pairs = classified(hardness, metrics)
    mean = conformance(pairs, normalised(throughput, ddof)).groupBy("metric").agg(F.avg("conformance").alias("conformance"))
    return coverage(pairs).join(mean, "metric", "left").select("metric", F.size(F.split("metric", r"\+")).alias("dims"), "coverage", "conformance", "comparable", "incomparable")


def corpus(hardness: DataFrame, throughput: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Which variants and data sets can be scored together, with reasons.

    variants: variant, overlap (data sets with a finite throughput and hardness), status: ok, 'few data sets', 'no deviation' or 'few shared'.
    datasets: dataset, status: ok, 'no hardness' (a metric missing or not finite), or 'no throughput' of some usable variant.
    A variant with fewer than `least` data sets does not count, nor one that is the same on all shared ones; the corpus is what all others share."""
    values = F.map_values("h")
    whole = hardness.select("dataset", F.coalesce(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)).alias("whole"))
    good = throughput.filter("mops is not null and not isnan(mops) and abs(mops) < double('inf')").join(whole.filter("whole"), "dataset", "left_semi").select("variant", "dataset", "mops")
    overlap = throughput.select("variant").distinct().join(good.groupBy("variant").agg(F.count("*").alias("overlap")), "variant", "left").fillna({"overlap": 0})

    def shared(variants: DataFrame) -> DataFrame:
        n = variants.agg(F.count("*").alias("__n"))
        return good.join(variants, "variant", "left_semi").groupBy("dataset").agg(F.count("*").alias("__c")).crossJoin(F.broadcast(n)).filter("__c = __n").select("dataset")  # one row

    usable = overlap.filter(F.col("overlap") >= least).select("variant")
    first = shared(usable)
    flat = good.join(first, "dataset", "left_semi").join(usable, "variant", "left_semi").groupBy("variant").agg(F.stddev_pop("mops").alias("s"))
    differ = usable.join(flat.filter("s > 0"), "variant", "left_semi")
    second = shared(differ)
    enough = second.agg((F.count("*") >= least).alias("enough"))
    status = F.when(F.col("overlap") < least, "few data sets").when(F.col("differs").isNull(), "no deviation").when(~F.col("enough"), "few shared").otherwise("ok")
    variants = overlap.join(differ.withColumn("differs", F.lit(True)), "variant", "left").crossJoin(F.broadcast(enough)).select("variant", "overlap", status.alias("status"))
    datasets = whole.join(second.withColumn("in", F.lit(True)), "dataset", "left").select("dataset", F.when(~F.col("whole"), "no hardness").when(F.col("in").isNull(), "no throughput").otherwise("ok").alias("status"))
    return variants, datasets


def gains(scores: DataFrame) -> DataFrame:
    """metric, without, gain of conformance and drop of coverage: each metric of several dimensions against the same without one of them."""
    s = scores.select("metric", F.split("metric", r"\+").alias("d"), "coverage", "conformance")
    fewer = s.select("metric", F.explode("d").alias("without"), "d", "coverage", "conformance").filter(F.size("d") > 1).withColumn("rest", F.array_join(F.array_except("d", F.array("without")), "+"))
    base = scores.select(F.col("metric").alias("rest"), F.col("coverage").alias("c0"), F.col("conformance").alias("f0"))
    return fewer.join(base, "rest").select("metric", "without", (F.col("conformance") - F.col("f0")).alias("gain"), (F.col("c0") - F.col("coverage")).alias("drop"))

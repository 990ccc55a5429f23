"""Summaries of benchmark runs. Stand-in runs: events by user group (data set), type (variant), seed and repetition."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import runs as ops
from rankweave.sources.tables import table

from .registry import query

# A run: numbers from its events, in the nesting of result rows.
_BASE = """base AS (SELECT user_id % 4 AS dataset, 'read' AS profile, event_type AS variant, event_id % 5 AS seed, (event_id // 5) % 3 AS repeat, count(*) AS n, sum(value) AS s, max(value) AS hi, min(value) AS lo, avg(value) AS m FROM events GROUP BY ALL),
runs AS (SELECT dataset, profile, variant, seed, repeat, dataset * 100 + seed * 10 + repeat AS fingerprint, dataset * 7 + seed AS checksum, true AS verified, m + 1 AS throughput, 10 * n AS operations, n AS initial_rows, n + 1 AS final_rows, s * 3 AS build_ns,
  {'read_hit_p99': hi, 'insert_p99': lo, 'scan_p99': hi - lo} AS latency, {'accounted_bytes': 16 * n + 5, 'key_bytes': 5 * n} AS memory_before, {'accounted_bytes': 17 * n} AS memory_after,
  {'bytes_rewritten': 3 * n, 'decoded_keys': 20 * n + 1, 'fence_probes': 30 * n + 7, 'root_probes': n * 2, 'correction_distance': hi} AS work,
  CASE WHEN variant <> 'view' THEN {'root_model': variant = 'click', 'flow_regions': 3, 'regions': 7, 'virtual_points': n // 5, 'keys': n, 'sse_before': CASE WHEN variant = 'error' THEN 0.0 ELSE s END, 'sse_after': s / 2, 'smoothing_ns': s, 'transform_ns': hi,
    'both': 2, 'flow': 1, 'virtual': 3, 'cost_none': hi, 'cost_selected': lo} END AS learned FROM base)"""


def _base(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy((F.col("user_id") % 4).alias("dataset"), F.lit("read").alias("profile"), F.col("event_type").alias("variant"), (F.col("event_id") % 5).alias("seed"), F.expr("event_id div 5 % 3").alias("repeat")).agg(
        F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("m")
    )


def _runs(spark, sf):
    s = lambda **k: F.struct(*(F.expr(e).alias(n) for n, e in k.items()))
    learned = s(
        root_model="variant = 'click'", flow_regions="3", regions="7", virtual_points="n div 5", keys="n", sse_before="CASE WHEN variant = 'error' THEN 0.0D ELSE s END", sse_after="s / 2", smoothing_ns="s", transform_ns="hi",
        both="2", flow="1", virtual="3", cost_none="hi", cost_selected="lo",
    )
    return _base(spark, sf).select(
        "dataset", "profile", "variant", "seed", "repeat", F.expr("dataset * 100 + seed * 10 + repeat").alias("fingerprint"), F.expr("dataset * 7 + seed").alias("checksum"), F.lit(True).alias("verified"), F.expr("m + 1").alias("throughput"),
        F.expr("10 * n").alias("operations"), F.col("n").alias("initial_rows"), F.expr("n + 1").alias("final_rows"), F.expr("s * 3").alias("build_ns"), s(read_hit_p99="hi", insert_p99="lo", scan_p99="hi - lo").alias("latency"),
        s(accounted_bytes="16 * n + 5", key_bytes="5 * n").alias("memory_before"), s(accounted_bytes="17 * n").alias("memory_after"),
        s(bytes_rewritten="3 * n", decoded_keys="20 * n + 1", fence_probes="30 * n + 7", root_probes="n * 2", correction_distance="hi").alias("work"), F.when(F.col("variant") != "view", learned).alias("learned"),
    )


_RATIOS = "ratios AS (SELECT r.dataset, r.profile, r.variant, r.seed, avg(ln(r.throughput / b.throughput)) AS log_ratio FROM runs r JOIN runs b ON b.variant = 'click' AND b.dataset = r.dataset AND b.profile = r.profile AND b.seed = r.seed AND b.repeat = r.repeat GROUP BY ALL)"


@query(f"WITH {_BASE}, {_RATIOS}, sp AS (SELECT dataset, profile, variant, exp(avg(log_ratio)) AS speedup FROM ratios GROUP BY ALL), g AS (SELECT dataset, profile, variant, count(*) AS runs, bool_and(verified) AS all_verified, "
       + ", ".join(f"round(median(cast({e} AS DOUBLE)), 6) AS {name}" for name, e in ops.MEASURES.items()) + " FROM runs GROUP BY ALL) SELECT g.*, round(speedup, 6) AS speedup FROM g LEFT JOIN sp USING (dataset, profile, variant)")
def run_summary(spark, sf):
    """Runs, verification, 23 medians and the paired speedup of every data set, profile and variant."""
    out = ops.summarise(_runs(spark, sf), "click")
    return out.select(*ops.GROUP, "runs", "all_verified", *(F.round(c, 6).alias(c) for c in [*ops.MEASURES, "speedup"]))


_LCG = """l AS (SELECT dataset, profile, variant, list(log_ratio ORDER BY seed) AS r FROM ratios GROUP BY ALL), d AS (SELECT dataset, profile, variant, s, len(r) AS seeds, exp(avg(r[1 + (((s * 7919 + i * 104729 + 12345) * 1103515245) % 2147483648) // 65536 % len(r)])) AS m
  FROM l, (SELECT unnest(range(1, 2001)) AS s), (SELECT unnest(range(1, 6)) AS i) WHERE i <= len(r) GROUP BY ALL)"""


@query(f"WITH {_BASE}, {_RATIOS}, {_LCG} SELECT dataset, profile, variant, cast(seeds AS INTEGER) AS seeds, round(quantile_disc(m, 0.025), 6) AS low, round(quantile_disc(m, 0.975), 6) AS high FROM d GROUP BY dataset, profile, variant, seeds")
def bootstrap_speedup_ci(spark, sf):
    return ops.bootstrap_speedup(_runs(spark, sf), "click").select(*ops.GROUP, "seeds", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_SPOILT = "spoilt AS (SELECT * REPLACE (CASE WHEN variant = 'view' AND seed = 2 THEN NULL WHEN variant = 'error' AND seed = 1 THEN -1 ELSE fingerprint END AS fingerprint, CASE WHEN variant = 'error' AND dataset = 1 THEN 0 ELSE checksum END AS checksum) FROM runs)"


def _spoilt(spark, sf):
    v = F.col("variant")
    fingerprint = F.when((v == "view") & (F.col("seed") == 2), F.lit(None)).when((v == "error") & (F.col("seed") == 1), -1).otherwise(F.col("fingerprint"))
    return _runs(spark, sf).withColumn("fingerprint", fingerprint).withColumn("checksum", F.when((v == "error") & (F.col("dataset") == 1), 0).otherwise(F.col("checksum")))


@query(f"WITH {_BASE}, {_SPOILT} SELECT dataset, profile, seed, repeat, count(DISTINCT fingerprint) AS fingerprints FROM spoilt GROUP BY ALL HAVING count(DISTINCT fingerprint) <> 1 OR count(*) > count(fingerprint)")
def mispaired_runs(spark, sf):
    return ops.mispaired(_spoilt(spark, sf))


@query(f"WITH {_BASE}, {_SPOILT} SELECT dataset, profile, seed, repeat, count(DISTINCT checksum) AS checksums FROM spoilt GROUP BY ALL HAVING count(DISTINCT checksum) > 1")
def disagreeing_runs(spark, sf):
    return ops.disagreeing(_spoilt(spark, sf))


_PAIRS = [("view", "click"), ("error", "click"), ("purchase", "view")]
_Z = 1.959963984540054
_TQ = f"{_Z} + {_Z**3 + _Z} / (4.0 * df) + {5 * _Z**5 + 16 * _Z**3 + 3 * _Z} / (96.0 * df * df) + {3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z} / (384.0 * df * df * df)"
_CONTRASTS = f"""cells AS (SELECT dataset, variant, avg(ln(throughput)) AS m, count(*) AS n, var_samp(ln(throughput)) AS v, CASE WHEN dataset = 2 AND variant IN ('view', 'click') THEN 'same' ELSE variant END AS sig FROM runs GROUP BY ALL),
sg AS (SELECT sqrt(sum((n - 1) * v) / sum(n - 1)) AS sigma, sum(n - 1) AS df FROM cells WHERE n > 1),
one AS (SELECT a.variant AS cell, b.variant AS base, a.dataset, df, a.m - b.m AS est, sigma * sqrt(1 / a.n + 1 / b.n) AS se, a.n, b.n AS n_base, a.sig = b.sig AS same FROM cells a JOIN cells b USING (dataset), sg
  WHERE (a.variant, b.variant) IN ({', '.join(map(str, _PAIRS))})),
every AS (SELECT * FROM one UNION ALL SELECT cell, base, NULL, any_value(df), avg(est), sqrt(sum(se * se)) / count(*), cast(sum(n) AS BIGINT), cast(sum(n_base) AS BIGINT), false FROM one WHERE NOT same GROUP BY cell, base),
con AS (SELECT cell, base, dataset, round(exp(est), 6) AS ratio, round(exp(est - ({_TQ}) * se), 6) AS low, round(exp(est + ({_TQ}) * se), 6) AS high, n, n_base, same AS null_by_structure FROM every)"""


def _contrasts(spark, sf):
    runs = _runs(spark, sf)
    same = (F.col("dataset") == 2) & F.col("variant").isin("view", "click")
    structure = runs.select("dataset", "variant").distinct().withColumn("signature", F.when(same, "same").otherwise(F.col("variant")))
    return ops.contrasts(runs, _PAIRS, structure).select("cell", "base", "dataset", *(F.round(c, 6).alias(c) for c in ("ratio", "low", "high")), "n", "n_base", "null_by_structure")


@query(f"WITH {_BASE}, {_CONTRASTS} SELECT * FROM con")
def before_after_contrasts(spark, sf):
    """Throughput ratios with intervals, per data set and over all; a cell built like its base is marked and left out of the mean."""
    return _contrasts(spark, sf)


@query(f"WITH {_BASE}, {_CONTRASTS} SELECT cell, base, dataset, CASE WHEN low > 1.02 THEN 'faster' WHEN high < 0.98 THEN 'slower' ELSE 'open' END AS verdict FROM con WHERE NOT null_by_structure")
def contrast_verdicts(spark, sf):
    return _contrasts(spark, sf).filter("not null_by_structure").select("cell", "base", "dataset", ops.verdict("low", "high", 0.02).alias("verdict"))


@query(f"""WITH {_BASE}, c AS (SELECT dataset, seed, variant, avg(ln(throughput)) AS m FROM runs GROUP BY ALL)
SELECT dataset, count(*) AS n, round(avg(a.m - b.m - (c.m - d.m)), 6) AS interaction FROM c a JOIN c b USING (dataset, seed) JOIN c USING (dataset, seed) JOIN c d USING (dataset, seed) WHERE a.variant = 'purchase' AND b.variant = 'view' AND c.variant = 'error' AND d.variant = 'click' GROUP BY dataset""")
def interaction_effect(spark, sf):
    """Whether two changes add up: (both - one) - (other - none) in log throughput."""
    c = _runs(spark, sf).groupBy("dataset", "seed").agg(*(F.avg(F.when(F.col("variant") == v, F.log("throughput"))).alias(v) for v in ("purchase", "view", "error", "click")))
    i = F.col("purchase") - F.col("view") - (F.col("error") - F.col("click"))
    return c.filter(i.isNotNull()).groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg(i), 6).alias("interaction"))


_CHUNKS = "chunks AS (SELECT event_type AS variant, user_id % 4 AS dataset, event_id // 400 AS k, median(value + 20) AS ns FROM events GROUP BY ALL)"


@query(f"""WITH {_CHUNKS}, a AS (SELECT *, median(ns) OVER w AS m, count(*) OVER w AS n, first_value(ns) OVER (PARTITION BY variant, dataset ORDER BY k) AS f FROM chunks WINDOW w AS (PARTITION BY variant, dataset)),
b AS (SELECT *, 1.4826 * median(abs(ns - m)) OVER (PARTITION BY variant, dataset) / m AS spread FROM a), c AS (SELECT *, greatest(2 * spread, 0.05) AS tolerance FROM b),
d AS (SELECT *, CASE WHEN abs(ns / m - 1) <= tolerance THEN 1 ELSE 0 END AS inside, row_number() OVER (PARTITION BY variant, dataset ORDER BY k) - 1 AS j FROM c),
e AS (SELECT *, min(inside) OVER (PARTITION BY variant, dataset ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM d),
t AS (SELECT *, coalesce(min(CASE WHEN run = 1 THEN j END) OVER (PARTITION BY variant, dataset), n) AS transient FROM e),
g AS (SELECT variant, dataset, n, m AS median_ns, f / m - 1 AS deficit, spread, tolerance, transient, count(*) FILTER (j >= transient AND inside = 0) AS late FROM t GROUP BY ALL)
SELECT variant, dataset, n, round(median_ns, 6) AS median_ns, round(deficit, 6) AS deficit, round(spread, 6) AS spread, round(tolerance, 6) AS tolerance, transient, late,
CASE WHEN n < 3 THEN 'short' WHEN transient = n THEN 'never settles' WHEN late > 0 THEN 'late outliers' WHEN transient > 0 THEN 'settles' ELSE 'steady' END AS verdict FROM g""")
def transient_verdicts(spark, sf):
    e = table(spark, sf, "events")
    chunks = e.groupBy(F.col("event_type").alias("variant"), (F.col("user_id") % 4).alias("dataset"), F.expr("event_id div 400").alias("k")).agg(F.percentile(F.col("value") + 20, 0.5).alias("ns"))
    out = ops.transients(chunks, ["variant", "dataset"])
    return out.select("variant", "dataset", "n", *(F.round(c, 6).alias(c) for c in ("median_ns", "deficit", "spread", "tolerance")), "transient", "late", "verdict")


@query(f"WITH {_BASE} SELECT dataset, variant, count(*) AS n, round(avg(throughput), 6) AS mean, round(stddev_samp(throughput), 6) AS deviation, round(stddev_samp(throughput) / avg(throughput), 6) AS cv, round((max(throughput) - min(throughput)) / avg(throughput), 6) AS range FROM runs GROUP BY dataset, variant HAVING count(*) > 1")
def noise_between_runs(spark, sf):
    out = ops.between_runs(_runs(spark, sf), ["dataset", "variant"])
    return out.select("dataset", "variant", "n", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "cv", "range")))


@query(f"""WITH {_BASE}, x AS (SELECT dataset, variant, avg(memory_before.accounted_bytes / initial_rows) AS b FROM runs GROUP BY ALL)
SELECT dataset, round(max(b) FILTER (variant = 'click'), 6) AS click, round(max(b) FILTER (variant = 'view'), 6) AS view, round(max(b) FILTER (variant = 'view') - max(b) FILTER (variant = 'click'), 6) AS delta FROM x GROUP BY dataset""")
def memory_per_key(spark, sf):
    """Bytes a key by variant, and what a variant adds to the base."""
    x = _runs(spark, sf).withColumn("b", F.expr("memory_before.accounted_bytes / initial_rows"))
    p = x.groupBy("dataset").pivot("variant", ["click", "view"]).agg(F.avg("b"))
    return p.select("dataset", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"), F.round(F.col("view") - F.col("click"), 6).alias("delta"))


@query("""WITH x AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS seconds, 1000 + cast(floor(value) AS BIGINT) * 10 AS kb FROM events), b AS (SELECT *, CASE WHEN kb < 0.9 * lag(kb) OVER (PARTITION BY user_id ORDER BY seconds) THEN seconds END AS fell_at FROM x),
e AS (SELECT user_id, count(*) AS samples, max(kb) AS peak, min(fell_at) AS fell FROM b GROUP BY user_id)
SELECT user_id, samples, peak, round(avg(kb) FILTER ((fell IS NULL OR seconds < fell) AND kb >= 0.85 * peak), 4) AS plateau, round(any_value(fell), 3) AS fell FROM b JOIN e USING (user_id) GROUP BY user_id, samples, peak""")
def memory_plateau(spark, sf):
    """Memory samples of a run (here events of a user): their peak, and the mean near it before the first sharp fall."""
    x = table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("seconds"), (F.floor("value") * 10 + 1000).alias("kb"))
    out = ops.plateau(x, ["user_id"])
    return out.select("user_id", "samples", "peak", F.round("plateau", 4).alias("plateau"), F.round("fell", 3).alias("fell"))


@query("""WITH r AS (SELECT event_id AS run, event_id % 11 // 10 AS exit_code, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS throughput, user_id AS operations, user_id - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS success_reads, event_id % 5 AS warmup FROM events),
p AS (SELECT run, concat_ws('; ', CASE WHEN exit_code <> 0 THEN 'exit code ' || exit_code END, CASE WHEN throughput <= 0 THEN 'no throughput' END, CASE WHEN success_reads <> operations THEN 'failed reads' END, CASE WHEN warmup = 0 THEN 'no warm-up' END) AS problems FROM r)
SELECT * FROM p WHERE problems <> ''""")
def run_checks(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(F.col("event_id").alias("run"), F.expr("event_id % 11 div 10").alias("exit_code"), F.expr("CASE WHEN event_id % 7 = 0 THEN 0.0D ELSE value END").alias("throughput"), F.col("user_id").alias("operations"), F.expr("user_id - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END").alias("success_reads"), F.expr("event_id % 5").alias("warmup"))
    return ops.run_problems(r).select("run", F.concat_ws("; ", "problems").alias("problems"))


@query(f"""WITH {_BASE}, p AS (SELECT r.dataset, r.throughput - b.throughput AS dy, cast(r.work.fence_probes - b.work.fence_probes AS DOUBLE) AS dx FROM runs r JOIN runs b USING (dataset, seed, repeat) WHERE r.variant = 'view' AND b.variant = 'click')
SELECT dataset, count(*) AS n, round(coalesce(regr_slope(dy, dx), 0), 6) AS slope, round(avg(dy) - coalesce(regr_slope(dy, dx), 0) * avg(dx), 6) AS intercept, round(CASE WHEN sum(dx * dx) > 0 THEN sum(dx * dy) / sum(dx * dx) ELSE 0 END, 6) AS slope_origin FROM p GROUP BY dataset""")
def cost_decomposition(spark, sf):
    """What a saved probe is worth: the difference of times over the difference of probes of paired runs."""
    r = _runs(spark, sf).select("dataset", "variant", "seed", "repeat", "throughput", F.col("work.fence_probes").alias("probes"))
    b = r.filter("variant = 'click'").select("dataset", "seed", "repeat", F.col("throughput").alias("t0"), F.col("probes").alias("p0"))
    p = r.filter("variant = 'view'").join(b, ["dataset", "seed", "repeat"]).select("dataset", (F.col("throughput") - F.col("t0")).alias("dy"), (F.col("probes") - F.col("p0")).cast("double").alias("dx"))
    return ops.regression(p, "dx", "dy", ["dataset"]).select("dataset", "n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "slope_origin")))


@query(f"WITH {_BASE} SELECT dataset, variant, seed, repeat, CASE WHEN throughput < 40 THEN 'below' WHEN throughput > 40 + 5 * (dataset + 1) THEN 'above' ELSE 'inside' END AS band FROM runs")
def predicted_band(spark, sf):
    r = _runs(spark, sf).withColumn("low", F.lit(40)).withColumn("high", 40 + 5 * (F.col("dataset") + 1))
    return r.select("dataset", "variant", "seed", "repeat", ops.band("throughput", "low", "high").alias("band"))


@query(f"WITH {_BASE}, c AS (SELECT dataset, variant, regr_slope(ln(throughput), seed * 3 + repeat) AS b, count(*) AS n FROM runs GROUP BY ALL) SELECT dataset, variant, n, round(b, 6) AS slope FROM c WHERE b IS NOT NULL")
def throughput_trend(spark, sf):
    """The slope of log throughput over a run's chunks."""
    x = (F.col("seed") * 3 + F.col("repeat")).cast("double")
    return ops.regression(_runs(spark, sf).select("dataset", "variant", x.alias("x"), F.log("throughput").alias("y")), "x", "y", ["dataset", "variant"]).select("dataset", "variant", "n", F.round("slope", 6).alias("slope"))


@query("""WITH d AS (SELECT unnest(['books', 'fb', 'osm']) AS dataset), v AS (SELECT unnest(['raw', 'packed']) AS variant), s AS (SELECT unnest(range(5)) AS seed), p AS (SELECT unnest(['read', 'mixed']) AS profile),
j AS (SELECT * FROM d, v, s, p) SELECT dataset, profile, count(*) AS jobs, cast(sum(CASE WHEN variant = 'raw' THEN 30 ELSE 45 END + CASE WHEN profile = 'mixed' THEN 20 ELSE 0 END) AS BIGINT) AS seconds FROM j WHERE NOT (dataset = 'osm' AND variant = 'packed' AND seed > 2) GROUP BY ALL""")
def run_plan(spark, sf):
    """The product of data sets, variants, seeds and profiles less what is left out, with its cost. A plan has a few dozen jobs."""
    j = spark.range(1)
    for name, values in {"dataset": ["books", "fb", "osm"], "variant": ["raw", "packed"], "seed": list(range(5)), "profile": ["read", "mixed"]}.items():
        j = j.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    j = j.filter("not (dataset = 'osm' and variant = 'packed' and seed > 2)")
    cost = F.when(F.col("variant") == "raw", 30).otherwise(45) + F.when(F.col("profile") == "mixed", 20).otherwise(0)
    return j.groupBy("dataset", "profile").agg(F.count("*").alias("jobs"), F.sum(cost).alias("seconds"))

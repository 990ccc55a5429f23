"""Metric scores over stand-in data: events are runs (type: variant, user group: data set), order prices give each data set's hardness."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import scores
from rankweave.sources.tables import table

from .registry import query

SCALARS = ("rmse", "max_error", "conflict_degree", "pla_32", "pla_4096")
METRICS = scores.compositions(SCALARS)

_RUNS = "runs AS (SELECT event_type AS variant, user_id % 10 AS dataset, value + 1 AS throughput FROM events)"
_T = _RUNS + ", t AS (SELECT variant, dataset, median(throughput) AS mops FROM runs GROUP BY ALL)"
_H = """h AS (SELECT o_custkey % 10 AS dataset, stddev_pop(o_totalprice) AS rmse, max(o_totalprice) - avg(o_totalprice) AS max_error, cast(count(*) % 7 AS DOUBLE) AS conflict_degree,
  cast(count(DISTINCT o_custkey) AS DOUBLE) AS pla_32, cast(floor(min(o_totalprice) / 50) AS DOUBLE) AS pla_4096 FROM orders GROUP BY 1),
l AS (UNPIVOT h ON rmse, max_error, conflict_degree, pla_32, pla_4096 INTO NAME dim VALUE v),
dims(metric, dim) AS (VALUES """ + ", ".join(f"('{m}', '{d}')" for m, ds in METRICS.items() for d in ds) + """),
q AS (SELECT metric, x.dataset AS a, y.dataset AS b, bool_and(x.v >= y.v) AND bool_or(x.v > y.v) AS ah, bool_and(y.v >= x.v) AND bool_or(y.v > x.v) AS bh
  FROM dims JOIN l x USING (dim) JOIN l y USING (dim) WHERE x.dataset < y.dataset GROUP BY ALL),
pairs AS (SELECT metric, a, b, CASE WHEN ah THEN a WHEN bh THEN b END AS hard, CASE WHEN ah THEN b WHEN bh THEN a END AS easy FROM q)"""
_N = "n AS (SELECT *, CASE WHEN stddev_pop(mops) OVER (PARTITION BY variant) > 0 THEN mops / stddev_pop(mops) OVER (PARTITION BY variant) ELSE 0 END AS p_hat FROM t)"
_C = _N + """, w AS (SELECT metric, e.variant, k.p_hat > e.p_hat AS bad, 1 / (1 + exp(e.p_hat - k.p_hat)) AS w FROM pairs JOIN n k ON k.dataset = hard JOIN n e ON e.dataset = easy AND e.variant = k.variant),
c AS (SELECT metric, variant, coalesce(count(*) FILTER (NOT bad), 0) AS conforming, coalesce(count(*) FILTER (bad), 0) AS violating, sum(CASE WHEN bad THEN -w ELSE w END) / sum(w) AS conformance FROM w GROUP BY ALL),
f AS (SELECT metric, variant, coalesce(conforming, 0) AS conforming, coalesce(violating, 0) AS violating, coalesce(conformance, 0) AS conformance FROM (SELECT DISTINCT metric FROM pairs) CROSS JOIN (SELECT DISTINCT variant FROM n) LEFT JOIN c USING (metric, variant)),
cov AS (SELECT metric, count(hard) AS comparable, count(*) - count(hard) AS incomparable, (2.0 * count(hard) - count(*)) / count(*) AS coverage FROM pairs GROUP BY metric),
s AS (SELECT metric, cast(len(string_split(metric, '+')) AS INTEGER) AS dims, coverage, m.conformance, comparable, incomparable FROM cov JOIN (SELECT metric, avg(conformance) AS conformance FROM f GROUP BY metric) m USING (metric))"""


def _runs(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("variant"), (F.col("user_id") % 10).alias("dataset"), (F.col("value") + 1).alias("throughput"))


def _throughput(spark, sf):
    return scores.median_throughput(_runs(spark, sf))


def _hardness(spark, sf):
    rows = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("dataset")).agg(
        F.stddev_pop("o_totalprice").alias("rmse"), (F.max("o_totalprice") - F.avg("o_totalprice")).alias("max_error"), (F.count("*") % 7).cast("double").alias("conflict_degree"),
        F.count_distinct("o_custkey").cast("double").alias("pla_32"), F.floor(F.min("o_totalprice") / 50).cast("double").alias("pla_4096"),
    )
    return rows.select("dataset", F.create_map(*(c for s in SCALARS for c in (F.lit(s), F.col(s)))).alias("h"))


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


@query(f"WITH {_T} SELECT variant, dataset, round(mops, 6) AS mops FROM t")
def median_throughput(spark, sf):
    return _rounded(_throughput(spark, sf), "mops")


@query(f"WITH {_T}, {_N} SELECT variant, dataset, round(mops, 6) AS mops, round(p_hat, 6) AS p_hat FROM n")
def normalised_throughput(spark, sf):
    return _rounded(scores.normalised(_throughput(spark, sf)), "mops", "p_hat")


@query(f"WITH {_H} SELECT metric, a, b, hard, easy FROM pairs")
def metric_pairs(spark, sf):
    return scores.classified(_hardness(spark, sf), METRICS)


@query(f"WITH {_T}, {_H}, {_C} SELECT metric, variant, conforming, violating, round(conformance, 6) AS conformance FROM f")
def metric_conformance(spark, sf):
    return _rounded(scores.conformance(scores.classified(_hardness(spark, sf), METRICS), scores.normalised(_throughput(spark, sf))), "conformance")


@query(f"WITH {_T}, {_H}, {_C} SELECT metric, dims, round(coverage, 6) AS coverage, round(conformance, 6) AS conformance, comparable, incomparable FROM s")
def metric_scores(spark, sf):
    """The 25 metrics of five scalars: coverage and mean conformance."""
    return _rounded(scores.scored(_hardness(spark, sf), _throughput(spark, sf), METRICS), "coverage", "conformance")


@query(f"""WITH {_T}, {_H}, {_C}, g AS (SELECT metric, without, coverage, conformance, (SELECT string_agg(x, '+' ORDER BY i) FROM (SELECT unnest(string_split(metric, '+')) AS x, generate_subscripts(string_split(metric, '+'), 1) AS i) WHERE x <> without) AS rest
  FROM (SELECT *, unnest(string_split(metric, '+')) AS without FROM s WHERE dims > 1))
SELECT g.metric, without, round(g.conformance - s.conformance, 6) AS gain, round(s.coverage - g.coverage, 6) AS "drop" FROM g JOIN s ON s.metric = g.rest""")
def dimension_gains(spark, sf):
    return _rounded(scores.gains(scores.scored(_hardness(spark, sf), _throughput(spark, sf), METRICS)), "gain", "drop")


_GAPPED = """, tg AS (SELECT variant, dataset, CASE WHEN variant = 'click' AND dataset > 1 THEN NULL WHEN variant = 'view' THEN 5.0 WHEN dataset = 4 AND variant = 'error' THEN NULL ELSE mops END AS mops FROM t),
hg AS (SELECT dataset, dataset <> 7 AS whole FROM h), good AS (SELECT variant, dataset, mops FROM tg WHERE mops IS NOT NULL AND dataset IN (SELECT dataset FROM hg WHERE whole)),
o AS (SELECT variant, count(mops) FILTER (dataset IN (SELECT dataset FROM hg WHERE whole)) AS overlap FROM tg GROUP BY variant),
u AS (SELECT variant FROM o WHERE overlap >= 3), s1 AS (SELECT dataset FROM good WHERE variant IN (SELECT variant FROM u) GROUP BY dataset HAVING count(*) = (SELECT count(*) FROM u)),
d AS (SELECT variant FROM good WHERE variant IN (SELECT variant FROM u) AND dataset IN (SELECT dataset FROM s1) GROUP BY variant HAVING stddev_pop(mops) > 0),
s2 AS (SELECT dataset FROM good WHERE variant IN (SELECT variant FROM d) GROUP BY dataset HAVING count(*) = (SELECT count(*) FROM d))"""


def _gapped(spark, sf):
    """The stand-in data with gaps: a data set without a metric, variants with few, missing or equal values."""
    h = _hardness(spark, sf).select("dataset", F.when(F.col("dataset") == 7, F.map_concat(F.map_filter("h", lambda k, v: k != "rmse"), F.create_map(F.lit("rmse"), F.lit(None).cast("double")))).otherwise(F.col("h")).alias("h"))
    v, d = F.col("variant"), F.col("dataset")
    mops = F.when((v == "click") & (d > 1), F.lit(None)).when(v == "view", 5.0).when((d == 4) & (v == "error"), F.lit(None)).otherwise(F.col("mops"))
    return h, _throughput(spark, sf).select("variant", "dataset", mops.alias("mops"))


@query(f"WITH {_T}, {_H} {_GAPPED} SELECT variant, overlap, CASE WHEN overlap < 3 THEN 'few data sets' WHEN variant NOT IN (SELECT variant FROM d) THEN 'no deviation' WHEN (SELECT count(*) FROM s2) < 3 THEN 'few shared' ELSE 'ok' END AS status FROM o")
def corpus_variants(spark, sf):
    return scores.corpus(*_gapped(spark, sf))[0]


@query(f"WITH {_T}, {_H} {_GAPPED} SELECT dataset, CASE WHEN NOT whole THEN 'no hardness' WHEN dataset NOT IN (SELECT dataset FROM s2) THEN 'no throughput' ELSE 'ok' END AS status FROM hg")
def corpus_datasets(spark, sf):
    return scores.corpus(*_gapped(spark, sf))[1]

"""Tests of differences, setup checks and knot densities over the given tables; events are runs as in the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import ERF
from rankweave.operators import inference
from rankweave.sources.tables import ranked_events, table

from .registry import _E, query

MARGIN = 20.0
KNOT_KEYS, KNOT_CELLS = 128, 64


def _cdf(z: str) -> str:
    """The normal distribution as normal_cdf has it, in SQL."""
    t = f"(1 / (1 + {ERF[0]} * abs({z}) / sqrt(2)))"
    tail = f"{t} * (" + f" + {t} * (".join(str(a) for a in ERF[1:]) + ")" * len(ERF[1:])
    return f"CASE WHEN {z} >= 0 THEN 1 - 0.5 * {tail} * exp(-{z} * {z} / 2) ELSE 0.5 * {tail} * exp(-{z} * {z} / 2) END"


_D = """d AS (SELECT c.variant, c.dataset, c.mean - b.mean AS diff, sqrt(c.v + b.v) AS se FROM cells c JOIN cells b USING (dataset) WHERE c.variant <> 'view' AND b.variant = 'view')"""
_C = """cells AS (SELECT event_type AS variant, user_id % 10 AS dataset, avg(value + 1) AS mean, var_samp(value + 1) / count(*) AS v FROM events GROUP BY ALL HAVING count(*) > 1), """ + _D
_P = f"{_C}, z AS (SELECT *, abs(diff) / se AS z, (diff + {MARGIN}) / se AS above, (diff - {MARGIN}) / se AS below FROM d), p AS (SELECT *, 2 * (1 - ({_cdf('z')})) AS p, greatest(1 - ({_cdf('above')}), {_cdf('below')}) AS p_equal FROM z)"


def _contrasts(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("variant"), (F.col("user_id") % 10).alias("dataset"), (F.col("value") + 1).alias("throughput"))
    return inference.contrasts(runs, "view")


@query(f"""WITH {_P}, h AS (SELECT *, p * (count(*) OVER (PARTITION BY variant) - row_number() OVER (PARTITION BY variant ORDER BY p, dataset) + 1) AS x, row_number() OVER (PARTITION BY variant ORDER BY p, dataset) AS i FROM p)
SELECT variant, dataset, round(p, 6) AS p, round(least(1, max(x) OVER (PARTITION BY variant ORDER BY i)), 6) AS p_holm FROM h""")
def holm_adjusted(spark, sf):
    """Differences to the variant 'view', data set by data set, corrected for all data sets of a variant."""
    out = inference.holm(inference.tested(_contrasts(spark, sf)), ["variant"], ["dataset"])
    return out.select("variant", "dataset", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query(f"""WITH {_P} SELECT variant, dataset, round(diff, 6) AS diff, round(p_equal, 6) AS p_equal,
CASE WHEN p_equal < 0.05 AND p < 0.05 THEN 'small' WHEN p_equal < 0.05 THEN 'equivalent' WHEN p < 0.05 THEN 'different' ELSE 'undecided' END AS verdict FROM p""")
def equivalence_verdicts(spark, sf):
    return inference.equivalence(_contrasts(spark, sf), MARGIN).select("variant", "dataset", F.round("diff", 6).alias("diff"), F.round("p_equal", 6).alias("p_equal"), "verdict")


@query()
def simulated_power(spark, sf):
    """Two thousand replicates of 40 runs with the effects of the events' values by type, in deviations of the whole."""
    events = table(spark, sf, "events")
    m, s = events.agg(F.avg("value"), F.stddev_pop("value")).first()
    types = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).orderBy("event_type").collect()  # a row per type
    effects = {r.event_type: ((r.m - m) / s if s else 0.0, (r.s or 0.0) / s if s else 1.0) for r in types}
    return inference.simulated_power(spark, effects | {"gate": (0.5, 1.0)}, 40, 2000, gate="gate")


@query(f"""WITH {_E}, n AS (SELECT count(*) AS n, min(key) AS lo, max(key) + 1 AS hi FROM re),
c AS (SELECT rank // {KNOT_KEYS} AS i, count(*) AS c, min(key) AS lo FROM re GROUP BY 1), ec AS (SELECT c.c, coalesce(lead(c.lo) OVER (ORDER BY i), hi) - c.lo AS w FROM c, n),
ew AS (SELECT count(*) AS c FROM re, n GROUP BY (key - lo) * {KNOT_CELLS} // (hi - lo))
SELECT 'equal count' AS knots, round(-sum(c * ln(cast(c AS DOUBLE) / w)) / any_value(n) + ln(any_value(n)), 6) AS nll FROM ec, n
UNION ALL SELECT 'equal width', round(-sum(c * ln(c / ((hi - lo) / {KNOT_CELLS}.0))) / any_value(n) + ln(any_value(n)), 6) FROM ew, n""")
def knot_likelihood(spark, sf):
    """Mean negative log-likelihood of the keys under densities that are level between knots of equal counts, and of equal width."""
    r = ranked_events(spark, sf)
    n = F.broadcast(r.agg(F.count("*").alias("n"), F.min("key").alias("from"), (F.max("key") + 1).alias("to")))  # one row
    cells = r.groupBy(F.expr(f"rank div {KNOT_KEYS}").alias("i")).agg(F.count("*").alias("c"), F.min("key").alias("lo"))
    after = cells.select((F.col("i") - 1).alias("i"), F.col("lo").alias("next"))
    equal_count = cells.join(after, "i", "left").crossJoin(n).select(F.lit("equal count").alias("knots"), "c", "n", (F.coalesce("next", "to") - F.col("lo")).alias("w"))
    wide = r.crossJoin(n).groupBy(F.expr(f"(key - from) * {KNOT_CELLS} div (to - from)").alias("i")).agg(F.count("*").alias("c"))
    equal_width = wide.crossJoin(n).select(F.lit("equal width").alias("knots"), "c", "n", ((F.col("to") - F.col("from")) / KNOT_CELLS).alias("w"))
    both = equal_count.withColumn("w", F.col("w").cast("double")).unionByName(equal_width)
    return both.groupBy("knots").agg(F.round(-F.sum(F.col("c") * F.ln(F.col("c") / F.col("w"))) / F.first("n") + F.ln(F.first("n")), 6).alias("nll"))


@query("""WITH cells AS (SELECT event_type, user_id % 10 AS dataset, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT cast(round(o_totalprice * 100) AS BIGINT) AS key, count(*) AS n FROM orders GROUP BY 1),
g(check_id, severity, seen, faults) AS (
  SELECT 'DATA-keys-positive', 'FAIL', sum(n), coalesce(sum(n) FILTER (key IS NULL OR key <= 0), 0) FROM k
  UNION ALL SELECT 'DATA-keys-distinct', 'WARN', sum(n), sum(n) - count(*) FROM k
  UNION ALL SELECT 'ROW-values-finite', 'FAIL', count(*), count(*) FILTER (value IS NULL OR NOT isfinite(value)) FROM events
  UNION ALL SELECT 'ROW-ids-unique', 'FAIL', count(*), count(*) - count(DISTINCT event_id) FROM events
  UNION ALL SELECT 'RUN-cells-complete', 'FAIL', count(*), count(DISTINCT event_type) * count(DISTINCT dataset) - count(*) FROM cells
  UNION ALL SELECT 'RUN-repeats', 'WARN', count(*), count(*) FILTER (n < 30) FROM cells
  UNION ALL SELECT 'REF-orders-known', 'FAIL', count(*), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem)
SELECT check_id, cast(seen AS BIGINT) AS seen, cast(faults AS BIGINT) AS faults, CASE WHEN seen = 0 THEN 'UNKNOWN' WHEN faults = 0 THEN 'PASS' ELSE severity END AS status FROM g""")
def setup_gate(spark, sf):
    """Checks of keys, runs and references before results count; a check without rows is unknown."""
    events, orders = table(spark, sf, "events"), table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    value, n = F.col("value"), F.col("n")
    cells = events.groupBy("event_type", (F.col("user_id") % 10).alias("dataset")).agg(F.count("*").alias("n"))
    k = orders.groupBy(F.round(F.col("o_totalprice") * 100).cast("long").alias("key")).agg(F.count("*").alias("n"))
    known = orders.select(F.col("o_orderkey").alias("l_orderkey")).distinct().withColumn("known", F.lit(True))

    def check(df, check_id, severity, seen, faults):
        return df.agg(F.lit(check_id).alias("check_id"), F.lit(severity).alias("severity"), seen.cast("long").alias("seen"), faults.cast("long").alias("faults"))

    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    checks = [
        check(k, "DATA-keys-positive", "FAIL", F.sum("n"), F.coalesce(F.sum(F.when(F.col("key").isNull() | (F.col("key") <= 0), n)), F.lit(0))),
        check(k, "DATA-keys-distinct", "WARN", F.sum("n"), F.sum("n") - F.count("*")),
        check(events, "ROW-values-finite", "FAIL", F.count("*"), F.count_if(~finite)),
        check(events.groupBy("event_id").agg(F.count("*").alias("n")), "ROW-ids-unique", "FAIL", F.sum("n"), F.sum("n") - F.count("event_id")),
        check(cells, "RUN-cells-complete", "FAIL", F.count("*"), F.count_distinct("event_type") * F.count_distinct("dataset") - F.count("*")),
        check(cells, "RUN-repeats", "WARN", F.count("*"), F.count_if(n < 30)),
        check(lines.join(known, "l_orderkey", "left"), "REF-orders-known", "FAIL", F.sum("n"), F.coalesce(F.sum(F.when(F.col("known").isNull(), n)), F.lit(0))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return inference.gate_status(out)

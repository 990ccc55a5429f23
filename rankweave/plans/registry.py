"""Queries over the given tables, one per operator, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators import hardness, keys, layout, store
from rankweave.sources.tables import event_times, order_cents, order_store, ranked_events, ranked_orders, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Tables that the SQL below starts from.
_S = "store AS (SELECT cast(round(o_totalprice * 100) AS BIGINT) AS key, arg_max(o_orderkey, o_orderkey) AS value FROM orders GROUP BY 1)"
_R = _S + ", r AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS rank FROM store)"
_G = _R + ", g AS (SELECT *, rank // 4096 AS region, rank % 4096 AS local_rank, (rank % 4096) // 128 AS block, rank % 128 AS block_rank FROM r)"
_E = "ev AS (SELECT epoch_us(ts) AS key, arg_max(event_id, event_id) AS value FROM events GROUP BY 1), re AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS rank FROM ev)"
_P = "probes AS (SELECT l_orderkey * 8 + l_linenumber AS probe, cast(round(l_extendedprice * 100) AS BIGINT) AS key FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL))"
_D = """delta AS (SELECT cast(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS key, o_orderkey AS value, o_orderkey % 5 = 0 AS deleted, o_orderkey AS seq,
  CASE o_orderkey % 5 WHEN 0 THEN 'erase' WHEN 1 THEN 'update' ELSE 'upsert' END AS kind  FROM orders)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _probes(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"))
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("probe"), F.round(F.col("p") * 100).cast("long").alias("key"))


def _delta(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "erase").when(F.col("o_orderkey") % 5 == 1, "update").otherwise("upsert")
    key = F.round(F.col("o_totalprice") * 100).cast("long") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    return o.select(key.cast("long").alias("key"), F.col("o_orderkey").alias("value"), (F.col("o_orderkey") % 5 == 0).alias("deleted"), F.col("o_orderkey").alias("seq"), kind.alias("kind"))


def _regions(spark, sf):
    return keys.regions(ranked_orders(spark, sf))


def _gaps(spark, sf):
    return keys.previous(ranked_events(spark, sf), "key").filter("previous is not null").select("key", (F.col("key") - F.col("previous")).alias("gap"))


# --- sequences

@query(f"WITH {_S} SELECT * FROM store")
def canonicalize_lww(spark, sf):
    return order_store(spark, sf)


@query("""WITH k AS (SELECT cast(round(o_totalprice * 100) AS BIGINT) AS key, o_orderkey AS pos FROM orders), p AS (SELECT key, lag(key) OVER (ORDER BY pos) AS previous FROM k)
SELECT count(*) AS n, count(*) FILTER (key < previous) AS descents, count(*) FILTER (key = previous) AS equal_neighbours, min(key) AS least, max(key) AS greatest FROM p""")
def sequence_audit(spark, sf):
    return keys.audit(order_cents(spark, sf))


@query(f"WITH {_R} SELECT key, rank FROM r")
def global_rank(spark, sf):
    return ranked_orders(spark, sf).select("key", "rank")


@query(f"WITH {_G} SELECT region, count(*) AS n, min(key) AS first, max(key) AS last, CASE WHEN region = 0 THEN 0 ELSE min(key) END AS fence FROM g GROUP BY region")
def region_directory(spark, sf):
    return _regions(spark, sf).groupBy("region").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last")).select("*", F.when(F.col("region") == 0, 0).otherwise(F.col("first")).alias("fence"))


@query(f"WITH {_G} SELECT region, block, count(*) AS n, min(key) AS first, max(key) AS last, min(rank) AS rank_begin FROM g GROUP BY region, block")
def block_directory(spark, sf):
    return _regions(spark, sf).groupBy("region", "block").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"), F.min("rank").alias("rank_begin"))


# --- codecs and layout

_SIZES = _G + """, b AS (SELECT *, min(key) OVER w AS first, max(key) OVER w AS last, count(*) OVER w AS n, key - lag(key) OVER (PARTITION BY region, block ORDER BY block_rank) AS gap FROM g WINDOW w AS (PARTITION BY region, block)),
x AS (SELECT *, key - first - CASE WHEN n > 1 THEN cast((cast(last - first AS HUGEINT) * block_rank) // (n - 1) AS BIGINT) ELSE 0 END AS left_over,
  CASE WHEN block_rank % 16 = 0 THEN 8 ELSE greatest(1, ceil(CASE WHEN gap = 0 THEN 0 ELSE length(bin(gap)) END / 7)) END AS step FROM b),
z AS (SELECT region, block, count(*) AS n, min(key) AS first, max(key) AS last, sum(step) AS steps, max(left_over) - min(left_over) AS spread FROM x GROUP BY region, block),
sizes AS (SELECT region, block, n, first, last, 16 + 8 * n AS raw, cast(16 + ceil(n * (CASE WHEN last = first THEN 0 ELSE length(bin(last - first)) END) / 8) AS BIGINT) AS "for",
  cast(16 + steps + 4 * ceil(n / 16) AS BIGINT) AS delta, cast(24 + ceil(n * (CASE WHEN spread = 0 THEN 0 ELSE length(bin(spread)) END) / 8) AS BIGINT) AS linear FROM z)"""
_CHOSEN = _SIZES + """, chosen AS (SELECT region, block, n, CASE WHEN least("for", delta, linear) > raw * 0.95 THEN 'raw' WHEN "for" = least("for", delta, linear) THEN 'for' WHEN delta = least("for", delta, linear) THEN 'delta' ELSE 'linear' END AS codec,
  CASE WHEN least("for", delta, linear) > raw * 0.95 THEN raw ELSE least("for", delta, linear) END AS bytes FROM sizes)"""


@query(f"WITH {_SIZES} SELECT * FROM sizes")
def codec_sizes(spark, sf):
    return layout.block_sizes(_regions(spark, sf))


@query(f"WITH {_CHOSEN} SELECT * FROM chosen")
def codec_choice_min_bytes(spark, sf):
    return layout.least_bytes(codec_sizes(spark, sf))


@query(f"WITH {_CHOSEN} SELECT *, cast(sum(bytes) OVER (PARTITION BY region ORDER BY block) - bytes AS BIGINT) AS \"offset\" FROM chosen")
def block_offsets(spark, sf):
    return layout.offsets(codec_choice_min_bytes(spark, sf))


@query(f"WITH {_CHOSEN} SELECT codec, count(*) AS blocks, cast(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / sum(n), 6) AS bytes_per_key FROM chosen GROUP BY codec")
def codec_histogram(spark, sf):
    return codec_choice_min_bytes(spark, sf).groupBy("codec").agg(F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / F.sum("n"), 6).alias("bytes_per_key"))


@query(f"""WITH {_G}, p AS (SELECT region, local_rank, key, CASE WHEN max(key) OVER w > min(key) OVER w THEN cast((cast(key - min(key) OVER w AS HUGEINT) * 6143) // (max(key) OVER w - min(key) OVER w) AS BIGINT) ELSE 0 END AS predicted FROM g WINDOW w AS (PARTITION BY region))
SELECT *, local_rank + max(predicted - local_rank) OVER (PARTITION BY region ORDER BY local_rank) AS slot FROM p""")
def direct_placement(spark, sf):
    return layout.direct_slots(_regions(spark, sf), 6144)


@query()
def router_buckets(spark, sf):
    lo = F.min("key").over(Window.partitionBy("region"))
    return _regions(spark, sf).select("region", (F.col("key") - lo).alias("d")).groupBy("region", F.shiftright("d", 20).alias("bucket")).agg(F.count("*").alias("n"))


ORACLE_SQL["router_buckets"] = f"WITH {_G} SELECT region, (key - lo) >> 20 AS bucket, count(*) AS n FROM (SELECT region, key, min(key) OVER (PARTITION BY region) AS lo FROM g) GROUP BY ALL"


# --- store

@query(f"WITH {_S}, {_P} SELECT probe, p.key, s.value, s.key IS NOT NULL AS found FROM probes p LEFT JOIN store s ON s.key = p.key")
def point_lookup(spark, sf):
    return store.find(_probes(spark, sf), order_store(spark, sf))


@query(f"WITH {_S}, {_P} SELECT probe, p.key FROM probes p ANTI JOIN store s ON s.key = p.key")
def point_lookup_misses(spark, sf):
    return _probes(spark, sf).join(order_store(spark, sf), "key", "left_anti").select("probe", "key")


@query(f"WITH {_S}, {_P} SELECT probe, p.key, s.key AS found_key, s.value FROM probes p ASOF LEFT JOIN store s ON p.key <= s.key")
def lower_bound_batch(spark, sf):
    return store.lower_bound(_probes(spark, sf), order_store(spark, sf))


@query(f"WITH {_G}, {_P}, f AS (SELECT region, CASE WHEN region = 0 THEN 0 ELSE min(key) END AS fence FROM g GROUP BY region) SELECT probe, p.key, f.region FROM probes p ASOF JOIN f ON p.key >= f.fence")
def route_to_region(spark, sf):
    return store.route(_probes(spark, sf), region_directory(spark, sf).select("region", "fence"))


@query(f"WITH {_R} SELECT q.rank AS probe, r.key, r.value, r.rank - q.rank AS \"at\" FROM r q JOIN r ON r.rank BETWEEN q.rank AND q.rank + 15")
def scan_batch(spark, sf):
    r = ranked_orders(spark, sf)
    return store.scan(r.select(F.col("rank").alias("probe"), "rank"), r, 16)


@query(f"""WITH {_S}, {_D}, u AS (SELECT key, value, false AS deleted, -1 AS seq FROM store UNION ALL SELECT key, value, deleted, seq FROM delta),
m AS (SELECT key, arg_max(value, seq) AS value, arg_max(deleted, seq) AS deleted FROM u GROUP BY key) SELECT key, value FROM m WHERE NOT deleted""")
def delta_merge_live(spark, sf):
    return store.merged(order_store(spark, sf), _delta(spark, sf))


@query(f"""WITH {_S}, {_D}, c AS (SELECT d.*, s.key IS NOT NULL AS base, last_value(CASE kind WHEN 'upsert' THEN true WHEN 'erase' THEN false END IGNORE NULLS) OVER (PARTITION BY d.key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM delta d LEFT JOIN store s ON s.key = d.key)
SELECT seq, kind, key, CASE WHEN kind = 'upsert' THEN NOT coalesce(now, base) ELSE coalesce(now, base) END AS flag FROM c""")
def change_flags(spark, sf):
    return store.change_flags(order_store(spark, sf), _delta(spark, sf))


@query(f"""WITH {_G}, {_D}, f AS (SELECT region, CASE WHEN region = 0 THEN 0 ELSE min(key) END AS fence FROM g GROUP BY region)
SELECT region, count(*) AS pending FROM delta d ASOF JOIN f ON d.key >= f.fence GROUP BY region HAVING count(*) >= 64""")
def compaction_candidates(spark, sf):
    d = _delta(spark, sf).select(F.col("seq").alias("probe"), "key")
    return store.route(d, region_directory(spark, sf).select("region", "fence")).groupBy("region").agg(F.count("*").alias("pending")).filter("pending >= 64")


@query(f"WITH {_G} SELECT region, count(*) AS n, min(key) FILTER (local_rank >= 2048) AS right_fence FROM g GROUP BY region HAVING count(*) = 4096")
def region_split_plan(spark, sf):
    return _regions(spark, sf).groupBy("region").agg(F.count("*").alias("n"), F.min(F.when(F.col("local_rank") >= 2048, F.col("key"))).alias("right_fence")).filter("n = 4096")


# --- models and hardness

_LS = """, x AS (SELECT {by} cast(key - min(key) OVER ({w}) AS DOUBLE) AS x, cast(rank - min(rank) OVER ({w}) AS DOUBLE) AS y FROM {t}),
fit AS (SELECT {by} count(*) AS n, coalesce(regr_slope(y, x), 0) AS slope, avg(y) - coalesce(regr_slope(y, x), 0) * avg(x) AS intercept FROM x {g})"""


@query(f"WITH {_E}" + _LS.format(by="", w="", t="re", g="") + " SELECT any_value(n) AS n, round(sqrt(avg(pow(y - slope * x - intercept, 2))), 6) AS rmse, round(max(abs(y - slope * x - intercept)), 6) AS max_error FROM x, fit")
def ls_hardness(spark, sf):
    return hardness.least_squares(ranked_events(spark, sf)).select("n", F.round("rmse", 6).alias("rmse"), F.round("max_error", 6).alias("max_error"))


@query(f"WITH {_G}" + _LS.format(by="region,", w="PARTITION BY region", t="g", g="GROUP BY region") + " SELECT region, any_value(n) AS n, round(sqrt(avg(pow(y - slope * x - intercept, 2))), 6) AS rmse, round(max(abs(y - slope * x - intercept)), 6) AS max_error FROM x JOIN fit USING (region) GROUP BY region")
def rank_model_per_region(spark, sf):
    return hardness.least_squares(_regions(spark, sf), ["region"]).select("region", "n", F.round("rmse", 6).alias("rmse"), F.round("max_error", 6).alias("max_error"))


@query(f"""WITH {_E}, e AS (SELECT min(key) AS lo, max(key) AS hi, count(*) AS n FROM re), s AS (SELECT cast((cast(key - lo AS HUGEINT) * (n - 1)) // (hi - lo) AS BIGINT) AS slot, count(*) AS c FROM re, e GROUP BY 1)
SELECT max(c) AS conflict_degree, count(*) AS slots_used FROM s""")
def linear_conflict_degree(spark, sf):
    return hardness.conflict_degree(ranked_events(spark, sf))


@query()
def pla_segments(spark, sf):
    """Least numbers of segments of the event times, for several error bounds."""
    return hardness.pla_segments(ranked_events(spark, sf), (0, 8, 32, 4096))


@query()
def pla_segments_32(spark, sf):
    """Segments of the orders' whole sequence of prices, within 32 ranks."""
    return hardness.pla_segments(ranked_orders(spark, sf), (32,))


# The distance of the fit is told by the first windows that are too narrow, for every distance up to 64 (if none serves the result is null).
_FMCD = """, e AS (SELECT count(*) AS n, count(*) * (1 + CASE WHEN count(*) >= 1000000 THEN 1 WHEN count(*) >= 100000 THEN 2 ELSE 5 END) AS cap FROM re),
ds AS (SELECT d, n, cap, lo.key AS lo, hi.key AS hi, cast(hi.key - lo.key AS DOUBLE) / (cap - 2) + 1e-6 AS ut FROM (SELECT unnest(range(1, 65)) AS d), e JOIN re lo ON lo.rank = d JOIN re hi ON hi.rank = n - 1 - d),
f AS (SELECT d, min(a.rank) AS f FROM ds JOIN re a ON true JOIN re b ON b.rank = a.rank + d WHERE b.key - a.key < ut GROUP BY d),
ok AS (SELECT min(ds.d) AS d FROM ds LEFT JOIN f ON f.d = ds.d LEFT JOIN f p ON p.d = ds.d - 1 WHERE 3 * ds.d > n OR f.f IS NULL OR ds.d > 1 AND coalesce(p.f, n) >= n - 1 - ds.d),
slots AS (SELECT least(greatest(cast(floor(1 / ut * (cast(2 * cast(key AS HUGEINT) - (lo + hi) AS DOUBLE) / 2) + cap / 2) AS BIGINT), 0), cap - 1) AS slot, count(*) AS c FROM re, ds JOIN ok USING (d) GROUP BY 1),
cd AS (SELECT any_value(n) AS n, any_value(ds.d) AS fmcd_d, any_value(cap) AS capacity, max(c) AS conflict_degree, count(*) AS slots_used FROM slots, ds JOIN ok USING (d))"""


@query(f"WITH {_E}{_FMCD} SELECT * FROM cd")
def fmcd_conflict_degree(spark, sf):
    return hardness.fmcd_conflicts(ranked_events(spark, sf))


@query(f"WITH {_E}" + _LS.format(by="", w="", t="re", g="") + _FMCD + """, ls AS (SELECT sqrt(avg(pow(y - slope * x - intercept, 2))) AS rmse, max(abs(y - slope * x - intercept)) AS max_error FROM x, fit)
SELECT n, round(rmse, 6) AS rmse, round(max_error, 6) AS max_error, fmcd_d, capacity, conflict_degree, slots_used FROM ls, cd""")
def hardness_vector(spark, sf):
    """The flagship: least-squares errors and conflict degree of the event times, in one row."""
    r = ranked_events(spark, sf)
    both = hardness.least_squares(r).drop("n").crossJoin(F.broadcast(hardness.fmcd_conflicts(r)))  # one row each
    return both.select("n", F.round("rmse", 6).alias("rmse"), F.round("max_error", 6).alias("max_error"), "fmcd_d", "capacity", "conflict_degree", "slots_used")


@query(f"WITH {_E}, d AS (SELECT key, rank, key - lag(key) OVER (ORDER BY key) AS gap FROM re), m AS (SELECT median(gap) AS mid FROM d) SELECT key, gap FROM d, m WHERE gap > mid ORDER BY gap DESC, key LIMIT 64")
def widest_gaps(spark, sf):
    gaps = _gaps(spark, sf)
    mid = keys.order_statistics(gaps, [], "gap", {"median": 0.5})
    return gaps.crossJoin(F.broadcast(mid)).filter("gap > median").select("key", "gap").orderBy(F.desc("gap"), "key").limit(64)  # the report's length


@query(f"WITH {_E}, d AS (SELECT rank // 512 AS block, log2(key - lag(key) OVER (ORDER BY key)) AS g FROM re) SELECT block, count(g) AS n, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS deviation FROM d WHERE g IS NOT NULL GROUP BY block")
def log_gap_profile(spark, sf):
    e = keys.previous(ranked_events(spark, sf), "key").filter("previous is not null")
    g = F.log2((F.col("key") - F.col("previous")).cast("double"))
    return e.select(F.expr("rank div 512").alias("block"), g.alias("g")).groupBy("block").agg(F.count("g").alias("n"), F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("deviation"))


@query(f"WITH {_E}, f AS (SELECT key, (key - 1704067200000000) / 1e9 AS x FROM re) SELECT key, round(tanh(x - floor(x)) + tanh(x * 0.001), 6) AS z FROM f")
def flow_features(spark, sf):
    x = (F.col("key") - 1704067200000000) / F.lit(1e9)
    return ranked_events(spark, sf).select("key", F.round(F.tanh(x - F.floor(x)) + F.tanh(x * 0.001), 6).alias("z"))


# --- experiment statistics; events stand for measurements: type = variant, user = seed

@query("SELECT event_type, count(*) AS n, " + ", ".join(f"quantile_disc(value, {q}) AS p{n}" for n, q in ((50, 0.5), (95, 0.95), (99, 0.99))) + ", max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    e = table(spark, sf, "events")
    most = e.groupBy("event_type").agg(F.max("value").alias("most"))
    return keys.order_statistics(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).join(most, "event_type")


_VAR = "v AS (SELECT event_type AS variant, user_id AS seed, median(value) AS m FROM events GROUP BY ALL)"


def _variants(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("variant"), F.col("user_id").alias("seed")).agg(F.percentile("value", 0.5).alias("m"))


@query(f"WITH {_VAR}, b AS (SELECT min(variant) AS base FROM v) SELECT v.variant, count(*) AS pairs, round(exp(avg(ln(v.m / w.m))), 6) AS ratio FROM v JOIN b ON v.variant <> base JOIN v w ON w.variant = base AND w.seed = v.seed WHERE v.m > 0 AND w.m > 0 GROUP BY v.variant")
def paired_speedup(spark, sf):
    v = _variants(spark, sf)
    base = v.agg(F.min("variant").alias("base"))
    tagged = v.crossJoin(F.broadcast(base))  # one row
    w = tagged.filter("variant = base").select("seed", F.col("m").alias("bm"))
    return tagged.filter("variant <> base").join(w, "seed").filter("m > 0 and bm > 0").groupBy("variant").agg(F.count("*").alias("pairs"), F.round(F.exp(F.avg(F.log(F.col("m") / F.col("bm")))), 6).alias("ratio"))


@query("WITH c AS (SELECT event_type, user_id, count(*) AS n, var_samp(value) AS s2 FROM events GROUP BY ALL HAVING count(*) > 1) SELECT event_type, count(*) AS cells, round(sqrt(sum((n - 1) * s2) / sum(n - 1)), 6) AS pooled_sd FROM c GROUP BY event_type")
def pooled_deviation(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.var_samp("value").alias("s2")).filter("n > 1")
    return c.groupBy("event_type").agg(F.count("*").alias("cells"), F.round(F.sqrt(F.sum((F.col("n") - 1) * F.col("s2")) / F.sum(F.col("n") - 1)), 6).alias("pooled_sd"))


_DS = "ds AS (SELECT o_custkey % 40 AS d, sum(o_totalprice) AS a, max(o_totalprice) AS b, count(*) AS c, avg(o_totalprice) AS thr FROM orders GROUP BY 1)"


def _datasets(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("d")).agg(F.sum("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.count("*").alias("c"), F.avg("o_totalprice").alias("thr"))


_PAIR = "y.d > x.d"
_HARDER = "(x.b >= y.b AND x.c >= y.c AND (x.b > y.b OR x.c > y.c))"
_EASIER = "(y.b >= x.b AND y.c >= x.c AND (y.b > x.b OR y.c > x.c))"


@query(f"WITH {_DS} SELECT x.d AS x, y.d AS y, CASE WHEN {_HARDER} THEN 'x' WHEN {_EASIER} THEN 'y' ELSE 'none' END AS harder FROM ds x JOIN ds y ON {_PAIR}")
def pair_dominance(spark, sf):
    ds = _datasets(spark, sf)  # a row per data set, 40 of them
    pairs = ds.alias("x").join(F.broadcast(ds).alias("y"), F.expr(_PAIR))
    return pairs.select(F.col("x.d").alias("x"), F.col("y.d").alias("y"), F.when(F.expr(_HARDER), "x").when(F.expr(_EASIER), "y").otherwise("none").alias("harder"))


@query(f"WITH {_DS}, p AS (SELECT {_HARDER} OR {_EASIER} AS comparable FROM ds x JOIN ds y ON {_PAIR}) SELECT count(*) AS pairs, count(*) FILTER (comparable) AS comparable, round((2.0 * count(*) FILTER (comparable) - count(*)) / count(*), 6) AS coverage FROM p")
def metric_coverage(spark, sf):
    p = pair_dominance(spark, sf)
    n, c = F.count("*"), F.count_if(F.col("harder") != "none")
    return p.agg(n.alias("pairs"), c.alias("comparable"), F.round((2.0 * c - n) / n, 6).alias("coverage"))


@query(f"WITH {_DS} SELECT count(*) AS pairs, round(sum(sign(x.c - y.c) * sign(x.thr - y.thr)) / count(*), 6) AS tau FROM ds x JOIN ds y ON {_PAIR}")
def kendall_tau(spark, sf):
    ds = _datasets(spark, sf)
    pairs = ds.alias("x").join(F.broadcast(ds).alias("y"), F.expr(_PAIR))
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.sum(F.expr("signum(x.c - y.c) * signum(x.thr - y.thr)")) / F.count("*"), 6).alias("tau"))


@query("WITH k AS (SELECT s_nationkey AS g, rank() OVER w AS r, count(*) OVER (PARTITION BY s_nationkey, round(s_acctbal, -2)) AS t, rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS s FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY round(s_acctbal, -2))) SELECT g, count(*) AS n, round(corr(r + (t - 1) / 2, s), 6) AS rho FROM k GROUP BY g HAVING count(*) > 2 AND stddev_pop(r) > 0")
def spearman_rho(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), F.round("s_acctbal", -2).alias("v"), "s_suppkey")
    w = Window.partitionBy("g")
    k = s.select("g", F.rank().over(w.orderBy("v")).alias("r"), F.count("*").over(Window.partitionBy("g", "v")).alias("t"), F.rank().over(w.orderBy("s_suppkey")).alias("s"))
    return k.groupBy("g").agg(F.count("*").alias("n"), F.round(F.corr(F.col("r") + (F.col("t") - 1) / 2, "s"), 6).alias("rho"), F.stddev_pop("r").alias("d")).filter("n > 2 and d > 0").drop("d")


@query("SELECT user_id, event_type, max(event_id) AS line, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_row_ledger(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("line"), F.max_by("value", "event_id").alias("value"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def planned_minus_done(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS j, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, j * 8 // n AS chunk, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def chunk_rates(spark, sf):
    e = keys.numbered(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"])
    return e.groupBy("event_type", F.expr("(j * 8) div n").alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH s AS (SELECT s_suppkey AS cell, s_acctbal AS bytes, s_suppkey * 7919 % 1000 AS cost FROM supplier)
SELECT cell, bytes, cost FROM (SELECT *, min(cost) OVER (ORDER BY bytes, cost, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s) WHERE best IS NULL OR cost < best""")
def pareto_front(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("bytes"), (F.col("s_suppkey") * 7919 % 1000).alias("cost"))
    # Ranges of bytes: a range's best cost bounds the ranges after it, so the running minimum needs no window over all rows.
    at = s.withColumn("r", keys.key_ranges(s, "bytes"))
    before = at.groupBy("r").agg(F.min("cost").alias("m")).select("r", F.min("m").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row per range
    w = Window.partitionBy("r").orderBy("bytes", "cost", "cell").rowsBetween(Window.unboundedPreceding, -1)
    best = at.withColumn("own", F.min("cost").over(w)).join(F.broadcast(before), "r").withColumn("best", F.least("own", "before"))
    return best.filter("best is null or cost < best").select("cell", "bytes", "cost")


@query(f"WITH {_R}, n AS (SELECT count(*) AS n FROM r) SELECT key, rank FROM r, n JOIN (SELECT unnest(range(100)) AS i) ON true WHERE rank = (2 * i + 1) * n // 200")
def sample_strided(spark, sf):
    r = ranked_orders(spark, sf)
    n = r.agg(F.count("*").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.floor((2 * i + 1) * F.col("n") / 200).cast("long"))).alias("rank"))
    return r.join(F.broadcast(n), "rank").select("key", "rank")  # 100 sample ranks


# --- generators

@query("SELECT i, 1024 + 10000000 * ((i + 7) // 8) + (i - (i + 7) // 8) AS key FROM (SELECT unnest(range(20000)) AS i)")
def synthetic_locally_hard(spark, sf):
    """A long step at every eighth key, else a step of one."""
    i = F.col("id")
    return spark.range(20000).select(i.alias("i"), (F.lit(1024) + 10000000 * F.expr("(id + 7) div 8") + (i - F.expr("(id + 7) div 8"))).alias("key"))


@query("SELECT i, 1024 + i // 8 AS key FROM (SELECT unnest(range(20000)) AS i)")
def synthetic_duplicates(spark, sf):
    return spark.range(20000).select(F.col("id").alias("i"), (F.expr("id div 8") + 1024).alias("key"))


@query("SELECT i, cast(cast(18446744073709551615 AS HUGEINT) - 4 * (19999 - i) AS VARCHAR) AS key FROM (SELECT unnest(range(20000)) AS i)")
def synthetic_near_u64(spark, sf):
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    return spark.range(20000).select(F.col("id").alias("i"), (top - (4 * (19999 - F.col("id"))).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string").alias("key"))


@query("WITH w AS (SELECT i, 1 / pow(i, 0.99) AS p FROM (SELECT unnest(range(1, 1001)) AS i)) SELECT i, round(sum(p) OVER (ORDER BY i) / sum(p) OVER (), 6) AS cdf FROM w")
def zipf_cdf(spark, sf):
    """Over 1,000 ranks, the parameter of the distribution."""
    w = spark.range(1, 1001).select(F.col("id").alias("i"), (1 / F.pow("id", F.lit(0.99))).alias("p"))
    return w.select("i", F.round(F.sum("p").over(Window.orderBy("i")) / F.sum("p").over(Window.partitionBy()), 6).alias("cdf"))

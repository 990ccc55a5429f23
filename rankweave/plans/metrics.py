"""Models, layout decisions and windows over key sequences: one query per operator, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankweave.operators import hardness, keys, layout, smoothing, store
from rankweave.sources.tables import event_times, order_store, ranked_events, ranked_orders, table

from .registry import _D, _E, _G, _P, _R, _S, _SIZES, _delta, _gaps, _probes, _regions, codec_sizes, query, region_directory

_X = "x AS (SELECT *, cast(key - min(key) OVER () AS DOUBLE) AS x, cast(rank AS DOUBLE) AS y, count(*) OVER () AS n FROM re), m AS (SELECT coalesce(regr_slope(y, x), 0) AS b, avg(x) AS mx, avg(y) AS my FROM x)"


@query(f"""WITH {_E}, {_X}, s AS (SELECT greatest(0, least(cast(floor(round(b * (x - mx) + my, 6)) AS BIGINT), cast(ceil(n * 1.5) AS BIGINT) - 1)) AS slot, count(*) AS c FROM x, m GROUP BY 1)
SELECT (SELECT count(*) FROM re) AS n, count(*) AS slots_used, quantile_disc(c, 0.99) - 1 AS tail_conflict FROM s""")
def tail_conflict_degree(spark, sf):
    return hardness.tail_conflicts(ranked_events(spark, sf))


_LEAF = """SELECT {k} AS leaves, avg(e) AS mean_error, max(e) AS max_error FROM (SELECT abs(y - sl * (x - lx) - ly) AS e FROM (SELECT x, y, CASE WHEN regr_sxx(y, x) OVER w > 0 THEN regr_slope(y, x) OVER w ELSE 0 END AS sl, avg(x) OVER w AS lx, avg(y) OVER w AS ly
  FROM (SELECT x, y, greatest(0, least(cast(floor(round((b * (x - mx) + my) * {k} / n, 6)) AS BIGINT), {k} - 1)) AS leaf FROM x, m) WINDOW w AS (PARTITION BY leaf)))"""


@query(f"WITH {_E}, {_X} SELECT leaves, round(mean_error, 5) AS mean_error, round(max_error, 5) AS max_error FROM (" + " UNION ALL ".join(_LEAF.format(k=k) for k in (1, 16, 128)) + ")")
def two_stage_rank_error(spark, sf):
    """A sweep of the number of second-stage lines."""
    r, out = ranked_events(spark, sf), None
    for k in (1, 16, 128):
        one = hardness.two_stage(r, k)
        out = one if out is None else out.unionByName(one)
    return out.select("leaves", F.round("mean_error", 5).alias("mean_error"), F.round("max_error", 5).alias("max_error"))


@query(f"""WITH {_R}, w AS (SELECT rank // 4096 AS region, cast(key - min(key) OVER p AS DOUBLE) AS x, cast(rank % 4096 AS DOUBLE) AS y FROM r WINDOW p AS (PARTITION BY rank // 4096))
SELECT region, count(*) AS n, round(regr_syy(y, x) - CASE WHEN regr_sxx(y, x) > 0 THEN pow(regr_sxy(y, x), 2) / regr_sxx(y, x) ELSE 0 END, 3) AS sse FROM w GROUP BY region""")
def region_sse(spark, sf):
    """Squared error of each region's line, from sums alone."""
    g = _regions(spark, sf)
    lo = g.groupBy("region").agg(F.min("key").alias("lo"))
    w = g.join(lo, "region").select("region", (F.col("key") - F.col("lo")).cast("double").alias("x"), F.col("local_rank").cast("double").alias("y"))
    w = w.groupBy("region").agg(F.count("*").alias("n"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"))
    return w.select("region", "n", F.round(F.col("syy") - F.when(F.col("sxx") > 0, F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(0), 3).alias("sse"))


_FLOW = "z AS (SELECT key, rank, tanh(2.75 * ((key - 1704067200000000) / 1e12 - 1.3)) + 0.2 * ((key / 1e10) - floor(key / 1e10)) AS z FROM re)"


def _flow(df):
    x = (F.col("key") - 1704067200000000) / F.lit(1e12)
    w = F.col("key") / F.lit(1e10)
    return df.select("key", "rank", (F.tanh(2.75 * (x - 1.3)) + 0.2 * (w - F.floor(w))).alias("z"))


@query(f"""WITH {_E}, {_FLOW}, d AS (SELECT z, lag(z) OVER (ORDER BY rank) AS before FROM z), o AS (SELECT z - min(z) OVER () AS x, cast(row_number() OVER (ORDER BY z, key) - 1 AS DOUBLE) AS y FROM z),
f AS (SELECT coalesce(regr_slope(y, x), 0) AS b, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM o)
SELECT any_value(n) AS n, (SELECT count(*) FROM d WHERE z < before) AS descents, round(sqrt(avg(pow(y - b * (x - mx) - my, 2))), 4) AS rmse, round(max(abs(y - b * (x - mx) - my)), 4) AS max_error FROM o, f""")
def transformed_block(spark, sf):
    """Hardness of the keys' transform: descents in key order, and the line over ranks in the transform's own order."""
    z = _flow(ranked_events(spark, sf))
    down = keys.previous(z, "z").agg(F.count_if(F.col("z") < F.col("previous")).alias("descents"))
    o = keys.ranked(z.select(F.col("z").alias("v"), "key"), ["v", "key"]).select("v", F.col("rank").cast("double").alias("y"))
    o = o.crossJoin(F.broadcast(o.agg(F.min("v").alias("lo")))).select((F.col("v") - F.col("lo")).alias("x"), "y")  # one row
    f = o.agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    e = F.abs(F.col("y") - F.col("b") * (F.col("x") - F.col("mx")) - F.col("my"))
    return o.crossJoin(F.broadcast(f)).groupBy("n").agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.max(e), 4).alias("max_error")).crossJoin(F.broadcast(down)).select("n", "descents", "rmse", "max_error")  # one row each


@query(f"""WITH {_E}, {_FLOW}, v AS (SELECT 'full' AS scope, cast(key AS DOUBLE) AS k FROM re UNION ALL SELECT 'full_flow', z FROM z
  UNION ALL SELECT 'sample', cast(key AS DOUBLE) FROM re WHERE rank % 10 = 5 UNION ALL SELECT 'sample_flow', z FROM z WHERE rank % 10 = 5),
x AS (SELECT scope, k - min(k) OVER (PARTITION BY scope) AS x, cast(row_number() OVER (PARTITION BY scope ORDER BY k) - 1 AS DOUBLE) AS y FROM v),
f AS (SELECT scope, coalesce(regr_slope(y, x), 0) AS b, avg(x) AS mx, avg(y) AS my FROM x GROUP BY scope)
SELECT scope, count(*) AS n, round(sqrt(avg(pow(y - b * (x - mx) - my, 2))), 4) AS rmse, round(max(abs(y - b * (x - mx) - my)), 4) AS max_error FROM x JOIN f USING (scope) GROUP BY scope""")
def hardness_scopes(spark, sf):
    """The line's errors for the whole sequence and a strided sample of it (the sampling operator), as they are and transformed."""
    z = _flow(ranked_events(spark, sf))
    scopes = {"full": (z, F.col("key").cast("double")), "full_flow": (z, F.col("z")), "sample": (z.filter("rank % 10 = 5"), F.col("key").cast("double")), "sample_flow": (z.filter("rank % 10 = 5"), F.col("z"))}
    v = None
    for name, (df, k) in scopes.items():
        one = df.select(F.lit(name).alias("scope"), k.alias("k"))
        v = one if v is None else v.unionByName(one)
    x = keys.numbered(v, ["scope"], ["k"])
    x = x.join(v.groupBy("scope").agg(F.min("k").alias("lo")), "scope").select("scope", (F.col("k") - F.col("lo")).alias("x"), F.col("j").cast("double").alias("y"))
    f = x.groupBy("scope").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    e = F.abs(F.col("y") - F.col("b") * (F.col("x") - F.col("mx")) - F.col("my"))
    return x.join(f, "scope").groupBy("scope").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.max(e), 4).alias("max_error"))


# --- layout decisions

_SMOOTH = _SIZES + """, a AS (SELECT region, count(*) AS blocks, sum(n) AS keys, min(first) AS lo, max(last) AS hi, cast(min(least(raw, "for", delta, linear)) AS DOUBLE) AS lowest FROM sizes GROUP BY region),
t AS (SELECT s.*, (16.0 * blocks + 8.0 * keys) * CASE WHEN hi > lo THEN cast(last - first AS DOUBLE) / (hi - lo) ELSE 1.0 / blocks END * 0.8 AS target FROM sizes s JOIN a USING (region))"""


@query(f"""WITH {_SMOOTH}, c AS (SELECT region, block, n, target, unnest([{{'o': 0, 'c': 'raw', 'b': raw}}, {{'o': 1, 'c': 'for', 'b': "for"}}, {{'o': 2, 'c': 'delta', 'b': delta}}, {{'o': 3, 'c': 'linear', 'b': linear}}]) AS x FROM t)
SELECT region, block, n, x.c AS codec, x.b AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY region, block ORDER BY round(abs(x.b - target), 6), x.o) AS k FROM c) WHERE k = 1""")
def codec_choice_smooth(spark, sf):
    return layout.nearest_bytes(codec_sizes(spark, sf), 0.8)


@query(f"""WITH {_SIZES} SELECT n, cast(sum(n * 8) AS BIGINT) AS value_bytes, cast(sum(least(raw, "for", delta, linear)) AS BIGINT) AS key_bytes, cast(count(*) * 32 + count(DISTINCT region) * 64 AS BIGINT) AS metadata_bytes, count(*) AS blocks FROM sizes GROUP BY n""")
def memory_accounting(spark, sf):
    """Bytes of keys (least codec), values and directory entries (32 a block, 64 a region), by block fill."""
    s = codec_sizes(spark, sf)
    return s.groupBy("n").agg(F.sum(F.col("n") * 8).alias("value_bytes"), F.sum(F.least("raw", "for", "delta", "linear")).alias("key_bytes"), (F.count("*") * 32 + F.count_distinct("region") * 64).alias("metadata_bytes"), F.count("*").alias("blocks"))


@query(f"""WITH {_SIZES}, c AS (SELECT region, block, unnest([{{'o': 0, 'c': 'raw', 'b': raw, 't': 1.0}}, {{'o': 1, 'c': 'for', 'b': "for", 't': 1.25}}, {{'o': 2, 'c': 'delta', 'b': delta, 't': 6.0}}, {{'o': 3, 'c': 'linear', 'b': linear, 't': 1.5}}]) AS x FROM sizes),
l AS (SELECT unnest([0.0, 0.001, 0.01, 0.1]) AS price), k AS (SELECT price, region, block, x.b AS b, x.t AS t, row_number() OVER (PARTITION BY price, region, block ORDER BY round(x.t + price * x.b, 9), x.o) AS k FROM c, l)
SELECT cast(price AS DOUBLE) AS price, cast(sum(b) AS BIGINT) AS bytes, round(cast(sum(t) AS DOUBLE), 4) AS cost FROM k WHERE k = 1 GROUP BY 1""")
def knapsack_fixed_lambda(spark, sf):
    """Total bytes and read cost if each block takes the codec of least cost + lambda * bytes."""
    return layout.priced(codec_sizes(spark, sf), (0.0, 0.001, 0.01, 0.1), {"raw": 1.0, "for": 1.25, "delta": 6.0, "linear": 1.5}).select(F.col("lambda").alias("price"), "bytes", F.round("cost", 4).alias("cost"))


@query(f"""WITH {_E}, n AS (SELECT count(*) AS n FROM re), h AS (SELECT rank AS h, key FROM re WHERE rank <= 8), t AS (SELECT n - 1 - rank AS t, key FROM re, n WHERE rank >= n - 9),
s AS (SELECT (SELECT key FROM t WHERE t = 8) - (SELECT key FROM h WHERE h = 8) AS trimmed)
SELECT h, t, t.key - h.key AS span FROM h, t, s WHERE t.key - h.key <= 2 * trimmed ORDER BY h + t, h LIMIT 1""")
def exceptions_peel(spark, sf):
    """The fewest keys to leave out at either end (8 at most) for a span of at most twice the span without 8 at both."""
    return layout.peel(ranked_events(spark, sf), 8)


def _split_sql(levels: int, most: int) -> str:
    sql = f"WITH {_E}, b AS (SELECT min(key) AS lo, max(key) AS hi FROM re), s0 AS (SELECT cast(1 AS BIGINT) AS node, key, lo, cast(ceil(log2(hi - lo + 1)) AS BIGINT) AS bits FROM re, b)"
    for k in range(levels):
        sql += f", c{k} AS (SELECT node, count(*) AS n FROM s{k} GROUP BY node), s{k + 1} AS (SELECT node * 4 + ((key - lo) >> (bits - {2 * (k + 1)})) % 4 AS node, key, lo, bits FROM s{k} JOIN c{k} USING (node) WHERE n > {most})"
    sql += f", c{levels} AS (SELECT node, count(*) AS n FROM s{levels} GROUP BY node)"
    return sql + " SELECT level, count(*) AS nodes, cast(sum(n) AS BIGINT) AS keys, max(n) AS fullest FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, n FROM c{k}" for k in range(levels + 1)) + ") GROUP BY level"


@query(_split_sql(4, 200))
def count_split_histogram(spark, sf):
    """A tree of key ranges: those with over 200 keys are split into four equal ones, four levels at most."""
    return layout.count_split(event_times(spark, sf).select("key").distinct(), 200, 4)


_LAY = _SIZES + """, chosen AS (SELECT region, block, least(raw, "for", delta, linear) AS bytes FROM sizes),
o AS (SELECT *, cast(sum(bytes) OVER (PARTITION BY region ORDER BY block) - bytes AS BIGINT) AS "offset", sum(bytes) OVER (PARTITION BY region) AS arena FROM chosen),
k AS (SELECT g.region, g.local_rank, g.block, cast(g.key - min(g.key) OVER w AS DOUBLE) AS x, cast(g.local_rank AS DOUBLE) AS y, "offset" + bytes * (g.block_rank + 0.5) / count(*) OVER v AS byte_at, arena, count(*) OVER w AS n
  FROM g JOIN o USING (region, block) WINDOW w AS (PARTITION BY g.region), v AS (PARTITION BY g.region, g.block)),
p AS (SELECT *, coalesce(regr_slope(y, x) OVER w, 0) * (x - avg(x) OVER w) + avg(y) OVER w AS rank_at, coalesce(regr_slope(byte_at, x) OVER w, 0) * (x - avg(x) OVER w) + avg(byte_at) OVER w AS byte_p FROM k WINDOW w AS (PARTITION BY region)),
e AS (SELECT *, abs(greatest(0, least(cast(floor(round(rank_at, 6) / 128) AS BIGINT), (n - 1) // 128)) - block) AS distance FROM p)"""


@query(f"""WITH {_LAY} SELECT region, count(*) AS keys, round(avg(abs(rank_at - y)), 4) AS rank_mae, round(avg(abs(byte_p - byte_at)), 4) AS byte_mae, round(avg(pow((rank_at - y) / greatest(1, n - 1), 2)), 9) AS rank_mse, round(avg(pow((byte_p - byte_at) / arena, 2)), 9) AS byte_mse,
round(avg(distance), 6) AS mean_block_error, quantile_disc(distance, 0.99) AS p99_block_error FROM e GROUP BY region""")
def layout_geometry(spark, sf):
    """Errors of a line from keys to ranks, and to bytes of a least-bytes layout, per region."""
    return layout.geometry(_regions(spark, sf), codec_sizes(spark, sf)).select(
        "region", "keys", F.round("rank_mae", 4).alias("rank_mae"), F.round("byte_mae", 4).alias("byte_mae"), F.round("rank_mse", 9).alias("rank_mse"), F.round("byte_mse", 9).alias("byte_mse"),
        F.round("mean_block_error", 6).alias("mean_block_error"), "p99_block_error",
    )


@query(f"WITH {_LAY} SELECT distance, count(*) AS n FROM e GROUP BY distance")
def correction_distance(spark, sf):
    """How many blocks a region's line misses a key's block by."""
    return layout.block_distance(_regions(spark, sf)).groupBy("distance").agg(F.count("*").alias("n"))


# --- windows and samples

@query(f"WITH {_R}, n AS (SELECT count(*) AS n FROM r) SELECT i AS stratum, key, rank FROM r, n JOIN (SELECT unnest(range(4)) AS i) ON true WHERE rank BETWEEN i * n // 4 + 10 AND i * n // 4 + 29")
def sample_windows(spark, sf):
    """A run of 20 keys in each quarter of the order (a sampling operator)."""
    r = ranked_orders(spark, sf)
    n = r.agg(F.count("*").alias("n"))
    strata = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("stratum")).select("stratum", F.expr("stratum * n div 4").alias("from"))
    places = strata.select("stratum", F.explode(F.sequence(F.col("from") + 10, F.col("from") + 29)).alias("rank"))
    return r.join(F.broadcast(places), "rank").select("stratum", "key", "rank")  # 80 rows


@query(f"WITH {_R} SELECT rank // 4096 AS region, rank % 4096 AS local_rank, cast(sum(key) OVER (PARTITION BY rank // 4096 ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM r")
def suffix_sums(spark, sf):
    """Per region the sum of the keys from each on: the region's sum less a running sum."""
    g = _regions(spark, sf)
    w = Window.partitionBy("region").orderBy("local_rank").rowsBetween(Window.unboundedPreceding, -1)
    total = g.groupBy("region").agg(F.sum("key").alias("total"))
    return g.withColumn("before", F.coalesce(F.sum("key").over(w), F.lit(0))).join(total, "region").select("region", "local_rank", (F.col("total") - F.col("before")).alias("rest"))


@query(f"""WITH {_E}, d AS (SELECT rank // 512 AS block, rank, log2(key - lag(key) OVER (ORDER BY key)) AS g FROM re), p AS (SELECT *, lag(g) OVER (PARTITION BY block ORDER BY rank) AS h FROM d WHERE g IS NOT NULL)
SELECT block, count(*) AS n, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS deviation, round(coalesce(corr(g, h), 0), 5) AS autocorrelation, round(quantile_disc(g, 0.99), 6) AS p99 FROM p GROUP BY block""")
def gap_windows(spark, sf):
    """Per 512 keys: the gaps' logarithms, how alike neighbours are, and the widest hundredth."""
    d = keys.previous(ranked_events(spark, sf), "key").filter("previous is not null").select("rank", F.expr("rank div 512").alias("block"), F.log2((F.col("key") - F.col("previous")).cast("double")).alias("g"))
    p = d.withColumn("h", F.lag("g").over(Window.partitionBy("block").orderBy("rank")))
    return p.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("deviation"), F.round(F.coalesce(F.corr("g", "h"), F.lit(0.0)), 5).alias("autocorrelation"), F.round(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY g)"), 6).alias("p99"))


@query(f"""WITH {_E}, d AS (SELECT rank // 512 AS block, log2(key - lag(key) OVER (ORDER BY key)) AS g FROM re), b AS (SELECT block, avg(g) AS m, stddev_pop(g) AS s FROM d WHERE g IS NOT NULL GROUP BY block),
a AS (SELECT avg(m) AS mm, stddev_pop(m) AS ms, avg(s) AS sm, stddev_pop(s) AS ss FROM b)
SELECT block, round(sqrt(pow((m - mm) / ms, 2) + pow((s - sm) / ss, 2)), 6) AS distance FROM b, a ORDER BY round(pow((m - mm) / ms, 2) + pow((s - sm) / ss, 2), 9), block LIMIT 1""")
def typical_window(spark, sf):
    """The window of 512 keys whose gap profile is nearest to the mean profile, in deviations."""
    d = keys.previous(ranked_events(spark, sf), "key").filter("previous is not null").select(F.expr("rank div 512").alias("block"), F.log2((F.col("key") - F.col("previous")).cast("double")).alias("g"))
    b = d.groupBy("block").agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("s"))
    a = b.agg(F.avg("m").alias("mm"), F.stddev_pop("m").alias("ms"), F.avg("s").alias("sm"), F.stddev_pop("s").alias("ss"))
    far = F.pow((F.col("m") - F.col("mm")) / F.col("ms"), 2) + F.pow((F.col("s") - F.col("sm")) / F.col("ss"), 2)
    return b.crossJoin(F.broadcast(a)).agg(F.min(F.struct(F.round(far, 9).alias("far"), "block")).alias("x")).select("x.block", F.round(F.sqrt("x.far"), 6).alias("distance"))  # one row


@query(f"""WITH {_E}, d AS (SELECT rank, key, key - lag(key) OVER (ORDER BY key) AS gap FROM re), m AS (SELECT median(gap) AS mid FROM d), t AS (SELECT rank, gap - cast(floor(mid) AS BIGINT) AS cut FROM d, m WHERE gap > mid ORDER BY gap DESC, rank LIMIT 256),
s AS (SELECT d.rank, key - coalesce(cast(sum(cut) OVER (ORDER BY d.rank) AS BIGINT), 0) AS key FROM d LEFT JOIN t ON t.rank = d.rank)
SELECT count(*) AS n, max(key) - min(key) AS span, round(regr_r2(rank, key - 1704067200000000), 6) AS fit FROM s""")
def gap_removal(spark, sf):
    """The sequence with its 256 widest gaps (the measure's parameter) shrunk to the median gap: its span, and how straight it then is."""
    r = ranked_events(spark, sf)
    gaps = keys.previous(r, "key").filter("previous is not null").select("rank", (F.col("key") - F.col("previous")).alias("gap"))
    mid = keys.order_statistics(gaps, [], "gap", {"median": 0.5})
    cut = gaps.crossJoin(F.broadcast(mid)).filter("gap > median").orderBy(F.desc("gap"), "rank").limit(256).select("rank", (F.col("gap") - F.floor("median")).alias("cut"))  # one row
    steps = cut.select("rank", F.sum("cut").over(Window.orderBy("rank")).alias("moved"))  # 256 rows
    spans = steps.select("moved", F.col("rank").alias("from"), F.lead("rank").over(Window.orderBy("rank")).alias("to"))
    s = r.join(F.broadcast(spans), (F.col("rank") >= F.col("from")) & (F.col("to").isNull() | (F.col("rank") < F.col("to"))), "left")  # 256 spans at most
    s = s.select("rank", (F.col("key") - F.coalesce("moved", F.lit(0))).alias("key"))
    return s.agg(F.count("*").alias("n"), (F.max("key") - F.min("key")).alias("span"), F.round(F.regr_r2(F.col("rank").cast("double"), (F.col("key") - 1704067200000000).cast("double")), 6).alias("fit"))


@query(f"""WITH {_E}, s AS (SELECT min(key) AS lo, max(key) AS hi, count(*) AS n FROM re), b AS (SELECT least(cast(floor((key - lo) * 64.0 / (hi - lo)) AS BIGINT), 63) AS bin, key, rank, lo, hi, n FROM re, s),
k AS (SELECT bin, min(rank) AS r0, count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n FROM b GROUP BY bin),
e AS (SELECT k.r0 + c * ((key - k.lo) * 64.0 / (k.hi - k.lo) - bin) - rank AS err, ln(c * 64.0 / k.n) AS density FROM b JOIN k USING (bin))
SELECT count(*) AS n, round(sqrt(avg(err * err)), 4) AS rmse, round(max(abs(err)), 4) AS max_error, round(-avg(density), 6) AS nll FROM e""")
def equal_width_knots(spark, sf):
    """A distribution function of 64 knots at equal widths: its rank errors and the keys' negative log-likelihood under it."""
    r = ranked_events(spark, sf)
    s = r.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
    at = (F.col("key") - F.col("lo")) * 64.0 / (F.col("hi") - F.col("lo"))
    b = r.crossJoin(F.broadcast(s)).select("rank", "n", at.alias("at"), F.least(F.floor(at), F.lit(63)).alias("bin"))  # one row
    k = b.groupBy("bin").agg(F.min("rank").alias("r0"), F.count("*").alias("c"))
    err = F.col("r0") + F.col("c") * (F.col("at") - F.col("bin")) - F.col("rank")
    return b.join(F.broadcast(k), "bin").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"), F.round(F.max(F.abs(err)), 4).alias("max_error"), F.round(-F.avg(F.log(F.col("c") * 64.0 / F.col("n"))), 6).alias("nll"))  # 64 rows


# --- store

@query(f"""WITH {_S}, {_D}, {_P}, u AS (SELECT key, value, false AS deleted, -1 AS seq FROM store UNION ALL SELECT key, value, deleted, seq FROM delta),
m AS (SELECT key, arg_max(value, seq) AS value, arg_max(deleted, seq) AS deleted FROM u GROUP BY key), live AS (SELECT key, value FROM m WHERE NOT deleted)
SELECT probe, p.key, l.value, l.key IS NOT NULL AS found FROM probes p LEFT JOIN live l ON l.key = p.key""")
def point_lookup_over_delta(spark, sf):
    return store.live_find(_probes(spark, sf), order_store(spark, sf), _delta(spark, sf))


@query(f"""WITH {_S}, {_D}, u AS (SELECT key, value, false AS deleted, -1 AS seq FROM store UNION ALL SELECT key, value, deleted, seq FROM delta),
m AS (SELECT key, arg_max(value, seq) AS value, arg_max(deleted, seq) AS deleted FROM u GROUP BY key), w AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS rank FROM m WHERE NOT deleted)
SELECT key, value, rank // 4096 AS region, rank % 4096 AS local_rank FROM w""")
def materialised_regions(spark, sf):
    return store.materialised(order_store(spark, sf), _delta(spark, sf))


@query("SELECT cast(0 AS BIGINT) AS unordered, cast(0 AS BIGINT) AS astray, cast(0 AS BIGINT) AS equal_ranks, cast(0 AS BIGINT) AS equal_keys")
def store_violations(spark, sf):
    g = _regions(spark, sf)
    fences = g.groupBy("region").agg(F.min("key").alias("first")).select("region", F.when(F.col("region") == 0, 0).otherwise(F.col("first")).alias("fence"))
    return store.violations(g, fences)


@query(f"""WITH {_S}, {_D}, u AS (SELECT key, value, false AS deleted, -1 AS seq FROM store UNION ALL SELECT key, value, deleted, seq FROM delta),
m AS (SELECT key, arg_max(value, seq) AS value, arg_max(deleted, seq) AS deleted FROM u GROUP BY key), live AS (SELECT key, value FROM m WHERE NOT deleted)
SELECT key, CASE WHEN l.key IS NULL THEN 'left' WHEN s.key IS NULL THEN 'right' ELSE 'both' END AS side, CASE WHEN l.key IS NULL OR s.key IS NULL THEN 0 ELSE 1 END AS fields
FROM store s FULL JOIN live l USING (key) WHERE s.value IS DISTINCT FROM l.value""")
def store_differences(spark, sf):
    """Where the store before and after its changes differ."""
    return store.differences(order_store(spark, sf), store.merged(order_store(spark, sf), _delta(spark, sf)), ["key"]).select("key", "side", F.size("fields").alias("fields"))


@query()
def smoothed_regions(spark, sf):
    """What virtual points, up to a tenth of the keys, gain in each region of 1,024 event times."""
    g = keys.regions(ranked_events(spark, sf), 1024)
    return smoothing.smoothing_gain(smoothing.smooth_regions(g, 0.1))

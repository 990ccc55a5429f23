"""Generated keys and traces, records and column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import generators
from rankweave.sources import records
from rankweave.sources.tables import ranked_orders, table

from .registry import _R, query


def _lcg(i: str, seed: int = 0) -> str:
    x = f"((({i}) + {seed * 7919}) % 2147483648)"
    for _ in range(3):
        x = f"(({x} * 1103515245 + 12345) % 2147483648)"
    return f"({x} >> 16)"


_STEPS = {
    "linear": "4",
    "uniform": "1 + r % 1024",
    "dense_sparse": "CASE WHEN (i // 128) % 2 = 1 THEN 1 + r * 31 % 1000000 ELSE 1 + r % 3 END",
    "staircase": "CASE WHEN i % 256 = 0 THEN 1000000000000 ELSE 1 + r % 4 END",
    "clustered": "CASE WHEN i % 1024 = 0 THEN 1000000000 ELSE 1 + r % 128 END",
}


def _keys(kind: str):
    def run(spark, sf):
        return generators.synthetic(spark, kind, 20_000)

    run.__name__ = f"synthetic_{kind}"
    run.__doc__ = f"20,000 keys of the distribution {kind}."
    return query(f"SELECT i, cast(1024 + sum({_STEPS[kind]}) OVER (ORDER BY i) AS BIGINT) AS key FROM (SELECT i, {_lcg('i')} AS r FROM (SELECT unnest(range(20000)) AS i))")(run)


for _kind in _STEPS:
    _keys(_kind)


@query("SELECT i, cast(floor(round(exp(2 * ((" + " + ".join(_lcg("i", k) for k in range(12)) + ") / 32768.0 - 6)), 6) * 1000000) AS BIGINT) // 1000 AS key FROM (SELECT unnest(range(20000)) AS i)")
def synthetic_lognormal(spark, sf):
    """20,000 unsorted keys, to the thousand."""
    return generators.synthetic(spark, "lognormal", 20_000).select("i", F.expr("key div 1000").alias("key"))


@query(f"WITH {_R}, n AS (SELECT count(*) AS n FROM r) SELECT key, rank, {_lcg('rank', 17)} < 24576 AS loaded, rank < cast(floor(n * 0.75) AS BIGINT) AS in_prefix FROM r, n")
def held_out_split(spark, sf):
    r = generators.held_out(ranked_orders(spark, sf), 0.75)
    both = generators.held_out(r.withColumnRenamed("loaded", "drawn"), 0.75, prefix=True)
    return both.select("key", "rank", F.col("drawn").alias("loaded"), F.col("loaded").alias("in_prefix"))


def _wide(seed: int) -> str:
    return f"({_lcg('op', seed)} * 32768 + {_lcg('op', seed + 1)})"


def _rank(how: str, n: int, ops: int) -> str:
    hot, wide = f"{_lcg('op', 2)} < 26214", _wide(0)
    if how == "uniform":
        return f"{wide} % {n}"
    inner = f"{wide} % {n // 10}" if how == "hotspot" else f"({wide} % {n // 10} + op * {n} // {ops}) % {n}"
    return f"CASE WHEN {hot} THEN {inner} ELSE {wide} % {n} END"


@query(" UNION ALL ".join(f"SELECT '{how}' AS how, op // 1000 AS phase, count(*) AS n, count(DISTINCT rank) AS keys, cast(sum(rank) AS BIGINT) AS total FROM (SELECT op, {_rank(how, 5000, 8000)} AS rank FROM (SELECT unnest(range(8000)) AS op)) GROUP BY ALL" for how in ("uniform", "hotspot", "moving_hotspot")))
def query_samplers(spark, sf):
    """What 8,000 operations over 5,000 keys ask for, by phase."""
    out = None
    for how in ("uniform", "hotspot", "moving_hotspot"):
        one = generators.sampled_ranks(spark, 8000, 5000, how).withColumn("how", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("how", F.expr("op div 1000").alias("phase")).agg(F.count("*").alias("n"), F.count_distinct("rank").alias("keys"), F.sum("rank").alias("total"))


_KINDS = " UNION ALL ".join(
    f"SELECT '{p}' AS profile, CASE " + " ".join(f"WHEN u < {round(32768 * sum(list(s.values())[: k + 1]))} THEN '{o}'" for k, o in enumerate(s)) + " END AS operation FROM u" for p, s in generators.PROFILES.items()
)


@query(f"WITH u AS (SELECT {_lcg('op', 5)} AS u FROM (SELECT unnest(range(5000)) AS op)), k AS ({_KINDS}) SELECT profile, operation, count(*) AS n FROM k GROUP BY ALL")
def profile_mixes(spark, sf):
    out = None
    for p in generators.PROFILES:
        one = generators.operations(spark.range(5000).select(F.col("id").alias("op")), p).withColumn("profile", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("profile", "operation").agg(F.count("*").alias("n"))


@query(f"""WITH {_R}, n AS (SELECT count(*) AS n FROM r), o AS (SELECT op, {_wide(0)} % n AS rank, {_lcg('op', 5)} AS u, {_lcg('op', 6)} AS m FROM (SELECT unnest(range(5000)) AS op), n),
k AS (SELECT op, CASE WHEN u < 31130 THEN 'read' WHEN u < 32768 THEN 'insert' END AS operation, m, r.key, lead(r.key) OVER () AS unused, x.key AS next FROM o JOIN r USING (rank) LEFT JOIN r x ON x.rank = r.rank + 1)
SELECT op, operation, CASE WHEN (next IS NULL OR next > key + 1) AND (operation = 'insert' OR m < 3276) THEN key + 1 ELSE key END AS key, op AS value, 0 AS length FROM k""")
def trace_read_heavy(spark, sf):
    """A trace of 5,000 operations over the orders' keys."""
    return generators.read_trace(ranked_orders(spark, sf), 5000, "uniform", "read_heavy")


# --- records; the events' rows stand for lines of logs, a user for a file

_LINES = """lines AS (SELECT user_id AS file, event_id AS line, CASE event_type WHEN 'view' THEN 'Throughput = ' || cast(floor(value) AS BIGINT) WHEN 'click' THEN ' success_read: ' || event_id WHEN 'signup' THEN 'trace_chunk: ' || event_id % 9 || ' ' || cast(floor(value * 10) AS BIGINT)
  WHEN 'error' THEN '## part ' || event_id % 3 ELSE 'name' || event_id % 4 || ' = v' || event_id END AS text FROM events)"""


def _lines(spark, sf):
    e, c = table(spark, sf, "events"), F.concat
    t, i = F.col("event_type"), F.col("event_id")
    text = F.when(t == "view", c(F.lit("Throughput = "), F.floor("value"))).when(t == "click", c(F.lit(" success_read: "), i)).when(t == "signup", c(F.lit("trace_chunk: "), i % 9, F.lit(" "), F.floor(F.col("value") * 10)))
    text = text.when(t == "error", c(F.lit("## part "), i % 3)).otherwise(c(F.lit("name"), i % 4, F.lit(" = v"), i))
    return e.select(F.col("user_id").alias("file"), i.alias("line"), text.alias("text"))


@query(f"WITH {_LINES} SELECT file, arg_max(cast(regexp_extract(text, 'Throughput = ([0-9]+)', 1) AS DOUBLE), line) FILTER (text LIKE 'Throughput%') AS throughput, arg_max(cast(nullif(regexp_extract(text, 'success_read: ([0-9]+)', 1), '') AS BIGINT), line) FILTER (text LIKE '%success_read%') AS success_reads FROM lines GROUP BY file".replace("cast(regexp_extract(text, 'Throughput", "cast(nullif(regexp_extract(text, 'Throughput").replace("([0-9]+)', 1) AS DOUBLE)", "([0-9]+)', 1), '') AS DOUBLE)"))
def log_lines(spark, sf):
    return records.log_fields(_lines(spark, sf), ["file"]).select("file", "throughput", "success_reads")


@query(f"WITH {_LINES}, c AS (SELECT file, line, cast(regexp_extract(text, '([0-9]+) ([0-9]+)', 1) AS BIGINT) AS k, cast(regexp_extract(text, '([0-9]+) ([0-9]+)', 2) AS DOUBLE) AS ns FROM lines WHERE text LIKE 'trace_chunk%') SELECT file, k, arg_max(ns, line) AS ns FROM c GROUP BY ALL")
def log_chunks(spark, sf):
    return records.chunk_times(_lines(spark, sf), ["file"])


@query(f"WITH {_LINES} SELECT file, trim(split_part(text, '=', 1)) AS name, arg_max(trim(split_part(text, '=', 2)), line) AS value FROM lines WHERE text LIKE '%=%' GROUP BY ALL")
def log_settings(spark, sf):
    return records.key_values(_lines(spark, sf), ["file"])


@query(f"""WITH {_LINES}, s AS (SELECT file, line, text, last_value(CASE WHEN text LIKE '## %' THEN trim(substr(text, 4)) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS section FROM lines)
SELECT file, section, count(*) AS n FROM s WHERE text NOT LIKE '## %' GROUP BY ALL""")
def log_sections(spark, sf):
    return records.sections(_lines(spark, sf), ["file"]).groupBy("file", "section").agg(F.count("*").alias("n"))


# --- functions

@query("SELECT event_type, count(*) AS n, cast(sum(cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, max(length(props)) AS longest FROM events GROUP BY event_type")
def json_fields(spark, sf):
    e = table(spark, sf, "events").select("event_type", "props", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"), F.max(F.length("props")).alias("longest"))


@query("""SELECT o_orderkey, o_orderkey << 3 AS shifted, bit_count(o_orderkey) AS ones, xor(o_orderkey, o_orderkey >> 2) AS gray, o_orderkey & 255 AS low FROM orders""")
def bit_operations(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.shiftleft(k, 3).alias("shifted"), F.bit_count(k).cast("int").alias("ones"), k.bitwiseXOR(F.shiftright(k, 2)).alias("gray"), k.bitwiseAND(F.lit(255)).alias("low"))


@query("""WITH l AS (SELECT l_orderkey, list(cast(l_quantity AS BIGINT) ORDER BY l_linenumber, cast(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(q) AS n, list_sum(q)::BIGINT AS total, q[1] AS first, list_max(list_transform(q, lambda x: x * x)) AS widest, len(list_distinct(q)) AS kinds FROM l""")
def array_folds(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("a")).select("l_orderkey", F.col("a.q").alias("q"))  # an order's lines
    return l.select("l_orderkey", F.size("q").cast("long").alias("n"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.get("q", F.lit(0)).alias("first"), F.array_max(F.transform("q", lambda x: x * x)).alias("widest"), F.size(F.array_distinct("q")).cast("long").alias("kinds"))


@query("""SELECT nation AS n_nationkey, segment, n FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL)""")
def map_choices(spark, sf):
    """Counts held as a map per nation, and read from it again."""
    m = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    return m.select(F.col("c_nationkey").alias("n_nationkey"), F.explode("m").alias("segment", "n"))


@query("""SELECT p_partkey, upper(p_brand) AS brand, split_part(p_type, ' ', 1) AS first, length(p_name) AS chars, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, starts_with(p_type, 'S') AS s FROM part""")
def string_functions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_brand").alias("brand"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first"), F.length("p_name").cast("long").alias("chars"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.startswith("p_type", F.lit("S")).alias("s"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(epoch_us(o_orderdate)) AS first FROM orders GROUP BY 1")
def order_months(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").groupBy(F.date_format(d, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min(F.unix_micros(d)).alias("first"))


@query("(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 1000 FROM nation EXCEPT ALL SELECT s_nationkey + 1000 FROM supplier)")
def set_operations(spark, sf):
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    both = c.select(F.col("c_nationkey").alias("nation")).intersect(s.select(F.col("s_nationkey").alias("nation")))
    return both.unionByName(n.select((F.col("n_nationkey") + 1000).alias("nation")).exceptAll(s.select((F.col("s_nationkey") + 1000).alias("nation"))))


@query("""WITH t AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)
SELECT event_type, n, round(1.959964 * s / sqrt(n), 6) AS half_width, round(2.801585 * s * sqrt(2.0 / n) / m, 6) AS detectable, cast(ceil(2 * pow(2.801585 * s / (0.05 * m), 2)) AS BIGINT) AS needed FROM t""")
def cost_calculators(spark, sf):
    """Half width of a mean's interval, the least effect told at 80 % power, and rows needed to tell 5 %."""
    t = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return t.select("event_type", "n", F.round(1.959964 * F.col("s") / F.sqrt("n"), 6).alias("half_width"), F.round(2.801585 * F.col("s") * F.sqrt(2.0 / F.col("n")) / F.col("m"), 6).alias("detectable"), F.ceil(2 * F.pow(2.801585 * F.col("s") / (0.05 * F.col("m")), 2)).alias("needed"))


@query("""WITH d AS (SELECT c_nationkey, count(*) AS keys, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
SELECT round(max(keys / (hi - lo) * 8), 6) AS at_least, round(min(keys / (hi - lo) * 800), 6) AS at_most, max(keys / (hi - lo) * 8) <= min(keys / (hi - lo) * 800) AS feasible FROM d WHERE hi > lo""")
def feasibility_interval(spark, sf):
    """Whether one setting suits all parts: the greatest lower bound of density times bytes against the least upper one."""
    d = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("keys"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).filter("hi > lo")
    x = F.col("keys") / (F.col("hi") - F.col("lo"))
    return d.agg(F.round(F.max(x * 8), 6).alias("at_least"), F.round(F.min(x * 800), 6).alias("at_most"), (F.max(x * 8) <= F.min(x * 800)).alias("feasible"))


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS j, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CASE WHEN j >= n / 2 THEN 'second' ELSE 'first' END AS half, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY ALL""")
def half_split(spark, sf):
    """The phases of a run: its first and second half."""
    from rankweave.operators import keys

    e = keys.numbered(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"])
    return e.groupBy("event_type", F.when(F.col("j") >= F.col("n") / 2, "second").otherwise("first").alias("half")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))

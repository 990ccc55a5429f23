"""Ordered key sequences: canonical form, ranks, neighbours and order statistics without a window over all rows.

A key table has columns key (long) and value. Order over all rows comes from range partitioning: rows are sorted within
key ranges and written once, a row's place in its range is its number in its file, and the ranges' counts, a row per range, give
the rest. What is built on ranks joins on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.sources.shared import written

_PLACES = (1 << 33) - 1  # of monotonically_increasing_id, which numbers rows within a partition in its lower 33 bits


def canonical(df: DataFrame, order: str = "pos") -> DataFrame:
    """One row per key; of equal keys the last in input order wins."""
    return df.groupBy("key").agg(F.max_by("value", order).alias("value"))


def key_ranges(df: DataFrame, key: str = "key", parts: int | None = None) -> Column:
    """The number of the key range that a key is in, by split points of equal counts.

    Points are held in runs of about their square root: a row is compared with the first of each run, then within one run."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    wide = max(1, round(len(cuts) ** 0.5))
    runs = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    run = F.size(F.filter(F.array(*(F.lit(r[0]) for r in runs)), lambda c: c <= F.col(key)))
    within = F.get(F.array(*(F.array(*map(F.lit, r)) for r in runs)), F.greatest(run - 1, F.lit(0)))
    return F.greatest(run - 1, F.lit(0)) * wide + F.size(F.filter(within, lambda c: c <= F.col(key)))


def ranked(df: DataFrame, key: str | list[str] = "key", parts: int | None = None) -> DataFrame:
    """df with rank, 0 for the least key (of equal keys any order). The rows are written once; reading them again costs a scan."""
    by = [key] if isinstance(key, str) else list(key)
    spread = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = written(spread.sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    before = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row per range
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("rank", F.col("__at").bitwiseAND(F.lit(_PLACES)) + F.col("__before")).drop("__part", "__at", "__before")


def previous(ranked_: DataFrame, value: str, name: str = "previous") -> DataFrame:
    """A ranked table with the value of the row before, null for the first: a join of ranks."""
    before = ranked_.select((F.col("rank") + 1).alias("rank"), F.col(value).alias(name))
    return ranked_.join(before, "rank", "left")


def with_previous(df: DataFrame, value: str, order: str, name: str = "previous", parts: int | None = None) -> DataFrame:
    """df with the value of the row before it in the order, null for the first."""
    return previous(ranked(df, order, parts), value, name).drop("rank")


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with j, its place within its group (from 0), and n, the group's rows: the order over all rows, less the group's first rank."""
    r = ranked(df, [*by, *order])
    groups = r.groupBy(*by).agg(F.min("rank").alias("__first"), F.count("*").alias("n"))
    if not by:
        return r.crossJoin(F.broadcast(groups)).withColumn("j", F.col("rank") - F.col("__first")).drop("rank", "__first")  # one row
    return r.join(groups, by).withColumn("j", F.col("rank") - F.col("__first")).drop("rank", "__first")


def order_statistics(df: DataFrame, by: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """by, n and a column per level: the value of nearest rank (the least with at least that share of the group at or below it).

    0.5 given as the name 'median' is the mean of the two middle values. Null values don't count. Exact, by ranks: no group is
    gathered, so one with a third of all rows is as good as any."""
    r = ranked(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")), [*by, "__v"])
    groups = r.groupBy(*by).agg(F.min("rank").alias("__first"), F.count("*").alias("n"))
    wanted = []
    for name, q in levels.items():
        if name == "median":
            wanted += [F.struct(F.lit(name).alias("name"), F.floor((F.col("n") - 1) / 2).alias("j")), F.struct(F.lit(name).alias("name"), F.ceil((F.col("n") - 1) / 2).alias("j"))]
        else:
            wanted.append(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("n") * F.lit(q)) - 1, F.lit(0)).alias("j")))
    asked = groups.select(*by, "n", (F.explode(F.array(*wanted))).alias("w"), "__first").select(*by, "n", F.col("w.name").alias("__name"), (F.col("__first") + F.col("w.j")).alias("rank"))
    got = asked.join(r.select("rank", "__v"), "rank")
    return got.groupBy(*by, "n").agg(*(F.avg(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in levels))


def regions(df: DataFrame, region_keys: int = 4096, block_keys: int = 128) -> DataFrame:
    """A ranked table with region, local_rank, block (within its region) and block_rank."""
    local = F.pmod("rank", F.lit(region_keys))
    return df.select("*", F.expr(f"rank div {region_keys}").alias("region"), local.alias("local_rank")).select("*", F.expr(f"local_rank div {block_keys}").alias("block"), F.pmod("local_rank", F.lit(block_keys)).alias("block_rank"))


def audit(df: DataFrame, order: str = "pos") -> DataFrame:
    """One row: rows, descents and equal neighbours in input order, least and greatest key."""
    p = with_previous(df, "key", order)
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("key") < F.col("previous")).alias("descents"), F.count_if(F.col("key") == F.col("previous")).alias("equal_neighbours"), F.min("key").alias("least"), F.max("key").alias("greatest"))


def require_ascending(df: DataFrame, order: str = "pos", distinct: bool = True) -> DataFrame:
    """df, if its keys ascend in input order (strictly, if distinct); else ValueError."""
    got = audit(df, order).first()
    if got["descents"] or distinct and got["equal_neighbours"]:
        raise ValueError(f"{got['descents']} descents and {got['equal_neighbours']} equal neighbours among {got['n']} keys")
    return df

"""Keys and operation traces made from row numbers: every row depends on its number and a seed alone, so a lost task makes the same rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shares of operations per profile.
PROFILES = {
    "read_only": {"read": 1.0},
    "read_heavy": {"read": 0.95, "insert": 0.05},
    "balanced": {"read": 0.5, "insert": 0.5},
    "write_heavy": {"read": 0.1, "insert": 0.9},
    "scan": {"read": 0.05, "scan": 0.95},
    "churn": {"read": 0.4, "insert": 0.3, "erase": 0.3},
    "update": {"read": 0.5, "update": 0.5},
}


def draw(i: Column, seed: int = 0) -> Column:
    """A number from 0 to 32767 of a row number and a seed: three steps of a congruential generator."""
    x = F.pmod(i + seed * 7919, F.lit(2147483648))
    for _ in range(3):
        x = F.pmod(x * 1103515245 + 12345, F.lit(2147483648))
    return F.shiftright(x, 16)


def running_sum(df: DataFrame, order: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """df with the sum of value up to each row in the order of the numbers `order` (0, 1, ...): sums within chunks and of the chunks before, one row per chunk."""
    at = df.withColumn("__chunk", F.expr(f"{order} div {chunk}"))
    before = at.groupBy("__chunk").agg(F.sum(value).alias("__s")).select("__chunk", (F.sum("__s").over(Window.orderBy("__chunk")) - F.col("__s")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return at.withColumn("__within", within).join(before, "__chunk").withColumn(name, F.col("__before") + F.col("__within")).drop("__chunk", "__within", "__before")


#: Steps between keys of number i, by distribution; r is the row's draw.
STEPS = {
    "linear": lambda i, r: F.lit(4).cast("long"),
    "uniform": lambda i, r: 1 + r % 1024,
    "dense_sparse": lambda i, r: F.when(F.expr("id div 128") % 2 == 1, 1 + r * 31 % 1_000_000).otherwise(1 + r % 3),
    "staircase": lambda i, r: F.when(i % 256 == 0, F.lit(10**12)).otherwise(1 + r % 4),
    "locally_hard": lambda i, r: F.when(i % 8 == 0, F.lit(10**7)).otherwise(F.lit(1)).cast("long"),
    "clustered": lambda i, r: F.when(i % 1024 == 0, F.lit(10**9)).otherwise(1 + r % 128),
}


def synthetic(spark: SparkSession, kind: str, n: int, seed: int = 0) -> DataFrame:
    """i and key of a distribution of STEPS: 1024 and the steps up to i; or lognormal, unsorted."""
    i = F.col("id")
    rows = spark.range(n)
    if kind == "lognormal":
        # the sum of twelve draws, less six, is nearly normal
        z = sum((draw(i, seed + k) for k in range(1, 12)), draw(i, seed)) / F.lit(32768.0) - 6
        return rows.select(i.alias("i"), F.floor(F.round(F.exp(2 * z), 6) * 1_000_000).alias("key"))
    stepped = rows.withColumn("step", STEPS[kind](i, draw(i, seed)))
    return running_sum(stepped, "id", "step", "sum").select(F.col("id").alias("i"), (F.col("sum") + 1024).alias("key"))


def held_out(keys: DataFrame, share: float = 0.75, by: str = "rank", prefix: bool = False) -> DataFrame:
    """keys with loaded: whether a key belongs to the initial load, a share of the keys: a prefix of the order, or every key whose draw is below it."""
    if prefix:
        n = keys.agg(F.count("*").alias("__n"))
        return keys.crossJoin(F.broadcast(n)).withColumn("loaded", F.col(by) < F.floor(F.col("__n") * F.lit(share))).drop("__n")  # one row
    return keys.withColumn("loaded", draw(F.col(by), 17) < int(32768 * share))


def sampled_ranks(spark: SparkSession, n_ops: int, n_keys: int, how: str = "uniform", seed: int = 0) -> DataFrame:
    """op and rank of the key that it asks for: uniform, hotspot (four in five to the first tenth), moving_hotspot (that tenth moves on with op)."""
    op = F.col("id")
    wide = draw(op, seed) * 32768 + draw(op, seed + 1)  # up to 2 ** 30
    tenth = max(1, n_keys // 10)
    hot = draw(op, seed + 2) < int(32768 * 0.8)
    if how == "uniform":
        rank = wide % n_keys
    elif how == "hotspot":
        rank = F.when(hot, wide % tenth).otherwise(wide % n_keys)
    elif how == "moving_hotspot":
        rank = F.when(hot, (wide % tenth + F.expr(f"id * {n_keys} div {max(1, n_ops)}")) % n_keys).otherwise(wide % n_keys)
    else:
        raise ValueError(f"unknown distribution {how}")
    return spark.range(n_ops).select(op.alias("op"), rank.cast("long").alias("rank"))


def operations(ops: DataFrame, profile: str, seed: int = 0) -> DataFrame:
    """ops (op, ...) with operation by the profile's shares."""
    u, upto, kind = draw(F.col("op"), seed + 5), 0.0, F.lit(None).cast("string")
    for name, share in PROFILES[profile].items():
        upto += share
        kind = F.coalesce(kind, F.when(u < F.lit(round(32768 * upto)), name))
    return ops.withColumn("operation", kind)


def read_trace(keys_ranked: DataFrame, n_ops: int, how: str, profile: str, miss: float = 0.1, scan_length: int = 16, seed: int = 0) -> DataFrame:
    """op, operation, key, value, length over a ranked table of keys. A miss asks for the number after a key, if that is no key; inserts
    bring such numbers, too. The trace doesn't follow the live set: an operation's effect is what store.change_flags says in order."""
    n = keys_ranked.count()
    ops = operations(sampled_ranks(keys_ranked.sparkSession, n_ops, max(n, 1), how, seed), profile, seed)
    after = keys_ranked.select((F.col("rank") - 1).alias("rank"), F.col("key").alias("next"))
    rows = ops.join(keys_ranked.select("rank", "key"), "rank").join(after, "rank", "left")
    free = F.col("next").isNull() | (F.col("next") > F.col("key") + 1)
    beside = free & ((F.col("operation") == "insert") | (F.col("operation") == "read") & (draw(F.col("op"), seed + 6) < int(32768 * miss)))
    return rows.select("op", "operation", F.when(beside, F.col("key") + 1).otherwise(F.col("key")).alias("key"), F.col("op").alias("value"), F.when(F.col("operation") == "scan", scan_length).otherwise(0).alias("length"))

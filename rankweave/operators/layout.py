"""Block layout: encoded sizes per codec, codec choice and byte offsets, as expressions over key blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import bit_width

HEADER = 16
RESTART = 16
CODECS = ("raw", "for", "delta", "linear")


def block_sizes(blocks: DataFrame) -> DataFrame:
    """Blocks of a table with region, block, block_rank, key: n, first, last and the encoded bytes under each codec.

    raw: 8 bytes a key. for: offsets from the first key at the span's width. delta: the key itself at each restart, else the gap
    in 7-bit groups, and 4 bytes a restart. linear: what is left of an even spacing, from its least value, packed."""
    by = Window.partitionBy("region", "block")
    order = by.orderBy("block_rank")
    first, last, n = F.min("key").over(by), F.max("key").over(by), F.count("*").over(by)
    gap = F.col("key") - F.lag("key").over(order)
    rows = blocks.select("region", "block", "block_rank", "key", first.alias("first"), last.alias("last"), n.alias("n"), gap.alias("gap"))
    even = F.when(F.col("n") > 1, F.expr("cast((cast(last - first as decimal(38,0)) * block_rank) div (n - 1) as bigint)")).otherwise(0)
    varint = F.greatest(F.lit(1), F.ceil(bit_width(F.col("gap")) / 7))
    rows = rows.select("*", (F.col("key") - F.col("first") - even).alias("left"), F.when(F.col("block_rank") % RESTART == 0, 8).otherwise(varint).alias("step"))
    sized = rows.groupBy("region", "block").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"), F.sum("step").alias("steps"), (F.max("left") - F.min("left")).alias("spread"))
    packed = lambda w: F.lit(HEADER) + F.ceil(F.col("n") * w / 8)
    return sized.select(
        "region", "block", "n", "first", "last",
        (HEADER + 8 * F.col("n")).cast("long").alias("raw"),
        packed(bit_width(F.col("last") - F.col("first"))).cast("long").alias("for"),
        (HEADER + F.col("steps") + 4 * F.ceil(F.col("n") / RESTART)).cast("long").alias("delta"),
        (packed(bit_width(F.col("spread"))) + 8).cast("long").alias("linear"),
    )


def least_bytes(sizes: DataFrame, gain: float = 0.05) -> DataFrame:
    """The codec of least bytes that saves at least `gain` against raw, else raw; the earlier codec wins ties."""
    best = F.least("for", "delta", "linear")
    codec = F.when(best > F.col("raw") * (1 - gain), "raw").when(F.col("for") == best, "for").when(F.col("delta") == best, "delta").otherwise("linear")
    return sizes.select("region", "block", "n", codec.alias("codec"), F.when(best > F.col("raw") * (1 - gain), F.col("raw")).otherwise(best).alias("bytes"))


def offsets(chosen: DataFrame) -> DataFrame:
    """Blocks with their byte offset in the region's arena."""
    upto = Window.partitionBy("region").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chosen.select("*", (F.sum("bytes").over(upto) - F.col("bytes")).alias("offset"))


def direct_slots(ranked: DataFrame, slots: int) -> DataFrame:
    """Ordered slots with gaps, per region: each key at its predicted slot or just after the one before it.

    The recurrence f_i = max(p_i, f_(i-1) + 1) is i + the greatest p_j - j up to i, a running maximum."""
    by = Window.partitionBy("region")
    lo, hi = F.min("key").over(by), F.max("key").over(by)
    rows = ranked.select("region", "local_rank", "key", lo.alias("lo"), hi.alias("hi"))
    p = F.when(F.col("hi") > F.col("lo"), F.expr(f"cast((cast(key - lo as decimal(38,0)) * {slots - 1}) div (hi - lo) as bigint)")).otherwise(0)
    rows = rows.withColumn("predicted", p)
    upto = by.orderBy("local_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("region", "local_rank", "key", "predicted", (F.col("local_rank") + F.max(F.col("predicted") - F.col("local_rank")).over(upto)).alias("slot"))


def _candidates(sizes: DataFrame) -> DataFrame:
    """A row per block and codec; o is the order in which ties are decided."""
    options = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(c).alias("codec"), F.col(c).alias("bytes")) for o, c in enumerate(CODECS)))
    return sizes.select("region", "block", "n", "first", "last", F.explode(options).alias("x")).select("region", "block", "n", "first", "last", "x.*")


def nearest_bytes(sizes: DataFrame, scale: float = 1.0) -> DataFrame:
    """The codec whose bytes are nearest to the block's share, by key span, of the region's raw bytes times scale; the earlier codec wins ties.

    With it a region's bytes grow evenly over its keys. A region of one key value is shared out evenly by blocks."""
    of = sizes.groupBy("region").agg(F.count("*").alias("blocks"), F.sum("n").alias("keys"), F.min("first").alias("lo"), F.max("last").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), (F.col("last") - F.col("first")).cast("double") / (F.col("hi") - F.col("lo"))).otherwise(1.0 / F.col("blocks"))
    c = _candidates(sizes).join(of, "region").withColumn("away", F.round(F.abs(F.col("bytes") - (16.0 * F.col("blocks") + 8.0 * F.col("keys")) * span * scale), 6))
    return c.groupBy("region", "block", "n").agg(F.min(F.struct("away", "o", "codec", "bytes")).alias("x")).select("region", "block", "n", "x.codec", "x.bytes")


def adaptive_bytes(sizes: DataFrame, hot: DataFrame, scale: float = 1.0) -> DataFrame:
    """nearest_bytes, but blocks of hot regions (region) stay raw, as they are written often."""
    smooth = nearest_bytes(sizes, scale)
    raw = sizes.join(hot.select("region").distinct(), "region", "left_semi").select("region", "block", "n", F.lit("raw").alias("codec"), F.col("raw").alias("bytes"))
    return smooth.join(hot.select("region").distinct(), "region", "left_anti").unionByName(raw)


def priced(sizes: DataFrame, lambdas: tuple[float, ...], cost: dict[str, float]) -> DataFrame:
    """lambda, bytes, cost: totals if each block takes the codec of least cost + lambda * bytes; the earlier codec wins ties."""
    prices = F.create_map(*(c for name, t in cost.items() for c in (F.lit(name), F.lit(t))))
    c = _candidates(sizes).withColumn("cost", prices[F.col("codec")]).withColumn("lambda", F.explode(F.array(*map(F.lit, lambdas))))
    best = c.groupBy("lambda", "region", "block").agg(F.min(F.struct(F.round(F.col("cost") + F.col("lambda") * F.col("bytes"), 9).alias("price"), "o", "bytes", "cost")).alias("x"))
    return best.groupBy("lambda").agg(F.sum("x.bytes").alias("bytes"), F.sum("x.cost").alias("cost"))


def cheapest_within(sizes: DataFrame, cost: dict[str, float], most_bytes: int, steps: int = 40) -> tuple[float, int, float] | None:
    """The least lambda (by bisection) whose choice fits most_bytes, with its bytes and cost; None if even the smallest codecs don't."""
    total = lambda x: tuple(priced(sizes, (x,), cost).select("bytes", "cost").first())
    low, high = 0.0, 1.0
    if total(low)[0] <= most_bytes:
        return (low, *total(low))
    if total(1e9)[0] > most_bytes:
        return None
    while total(high)[0] > most_bytes:
        low, high = high, 4 * high
    for _ in range(steps):
        mid = (low + high) / 2
        if total(mid)[0] > most_bytes:
            low = mid
        else:
            high = mid
        if high - low <= 1e-6 * high:
            break
    return (high, *total(high))


def peel(ranked: DataFrame, most: int) -> DataFrame:
    """One row h, t, span: the fewest keys to leave out at the head and tail, `most` at either, for a span of at most twice the
    span without `most` at both; fewer at the head win ties."""
    n = ranked.agg(F.count("*").alias("n"))
    ends = ranked.crossJoin(F.broadcast(n)).filter((F.col("rank") <= most) | (F.col("rank") >= F.col("n") - 1 - most))  # one row; a few keys
    h, t = ends.filter(F.col("rank") <= most).select(F.col("rank").alias("h"), F.col("key").alias("a")), ends.filter(F.col("rank") >= F.col("n") - 1 - most).select((F.col("n") - 1 - F.col("rank")).alias("t"), F.col("key").alias("b"))
    trimmed = h.filter(F.col("h") == most).join(F.broadcast(t.filter(F.col("t") == most)), F.lit(True)).select((F.col("b") - F.col("a")).alias("trimmed"))
    pairs = h.join(F.broadcast(t), F.lit(True)).join(F.broadcast(trimmed), F.lit(True)).withColumn("span", F.col("b") - F.col("a")).filter("span <= 2 * trimmed")  # (most + 1) squared rows
    return pairs.agg(F.min(F.struct((F.col("h") + F.col("t")).alias("left_out"), "h", "t", "span")).alias("x")).select("x.h", "x.t", "x.span")


def count_split(keys: DataFrame, most: int, levels: int, fan_bits: int = 2) -> DataFrame:
    """level, nodes, keys, fullest of a tree of key ranges: from the whole range on, ranges with over `most` keys are split into equal parts."""
    ends = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    lo, bits = ends["lo"] or 0, max((ends["hi"] or 0) - (ends["lo"] or 0), 1).bit_length()
    at, out = keys.select("key", F.lit(1).cast("long").alias("node")), None
    for level in range(levels + 1):
        held = at.groupBy("node").agg(F.count("*").alias("n"))
        row = held.agg(F.lit(level).alias("level"), F.count("*").alias("nodes"), F.sum("n").alias("keys"), F.max("n").alias("fullest"))
        out = row if out is None else out.unionByName(row)
        shift = bits - fan_bits * (level + 1)
        if shift < 0:
            break
        part = F.pmod(F.shiftright(F.col("key") - F.lit(lo), shift), F.lit(1 << fan_bits))
        at = at.join(held.filter(F.col("n") > most).select("node"), "node").select("key", (F.col("node") * (1 << fan_bits) + part).alias("node"))
    return out.filter("nodes > 0")


def _fitted(rows: DataFrame, y: str, name: str) -> DataFrame:
    """rows (region, x, ...) with the region's line of y over x at x."""
    fit = rows.groupBy("region").agg(F.coalesce(F.regr_slope(y, "x"), F.lit(0.0)).alias("__b"), F.avg("x").alias("__mx"), F.avg(y).alias("__my"))
    return rows.join(fit, "region").withColumn(name, F.col("__b") * (F.col("x") - F.col("__mx")) + F.col("__my")).drop("__b", "__mx", "__my")


def block_distance(regions: DataFrame, block_keys: int = 128) -> DataFrame:
    """region, local_rank, block, x, y, n, rank_at (the region's line) and distance: blocks between the line's block and the key's own."""
    of = regions.groupBy("region").agg(F.min("key").alias("lo"), F.count("*").alias("n"))
    rows = regions.join(of, "region").select("region", "local_rank", "block", "block_rank", "n", (F.col("key") - F.col("lo")).cast("double").alias("x"), F.col("local_rank").cast("double").alias("y"))
    rows = _fitted(rows, "y", "rank_at")
    near = F.greatest(F.lit(0), F.least(F.floor(F.round("rank_at", 6) / block_keys), F.floor((F.col("n") - 1) / block_keys)))
    return rows.withColumn("distance", F.abs(near - F.col("block")).cast("long"))


def geometry(regions: DataFrame, sizes: DataFrame, block_keys: int = 128) -> DataFrame:
    """Per region: mean errors of lines from keys to ranks and to byte places (of the least-bytes layout, keys evenly within blocks), plain and
    squared as shares of the region, and blocks missed, on average and at the 99th percentile."""
    chosen = sizes.select("region", "block", F.col("n").alias("block_n"), F.least(*CODECS).alias("bytes"))
    arena = chosen.groupBy("region").agg(F.sum("bytes").alias("arena"))
    placed = offsets(chosen).join(arena, "region")
    rows = block_distance(regions, block_keys).join(placed, ["region", "block"])
    rows = rows.withColumn("byte_at", F.col("offset") + F.col("bytes") * (F.col("block_rank") + 0.5) / F.col("block_n"))
    rows = _fitted(rows, "byte_at", "byte_p")
    er, eb = F.col("rank_at") - F.col("y"), F.col("byte_p") - F.col("byte_at")
    return rows.groupBy("region").agg(
        F.count("*").alias("keys"), F.avg(F.abs(er)).alias("rank_mae"), F.avg(F.abs(eb)).alias("byte_mae"), F.avg(F.pow(er / F.greatest(F.lit(1), F.col("n") - 1), 2)).alias("rank_mse"), F.avg(F.pow(eb / F.col("arena"), 2)).alias("byte_mse"),
        F.avg("distance").alias("mean_block_error"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY distance)").cast("long").alias("p99_block_error"),
    )

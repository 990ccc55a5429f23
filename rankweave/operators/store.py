"""Store semantics over key tables: lookups, lower bounds, scans, and deltas merged over a base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import key_ranges, previous, ranked, regions


def find(probes: DataFrame, store: DataFrame) -> DataFrame:
    """probes (probe, key) with value and found."""
    return probes.join(store.select("key", "value", F.lit(True).alias("__hit")), "key", "left").select("probe", "key", "value", F.coalesce("__hit", F.lit(False)).alias("found"))


def _nearest(keys: DataFrame, points: DataFrame, ahead: bool) -> DataFrame:
    """Each different key of keys with hit: the first of points (key, hit) at or after it, or with ahead=False the last at or before it.

    Keys and points are sorted together within key ranges; what ranges before or after offer is a row per range."""
    at = key_ranges(points)
    rows = points.select("key", F.lit(False).alias("asks"), "hit", at.alias("range"))
    both = rows.unionByName(keys.select("key").distinct().select("key", F.lit(True).alias("asks"), F.lit(None).cast(points.schema["hit"].dataType).alias("hit"), at.alias("range")))
    ends = rows.groupBy("range").agg((F.min_by if ahead else F.max_by)("hit", "key").alias("end"))
    span = both.select("range").distinct().join(ends, "range", "left")
    order = Window.orderBy(F.col("range") if ahead else F.desc("range")).rowsBetween(1, Window.unboundedFollowing)
    beyond = span.select("range", F.first("end", ignorenulls=True).over(order).alias("beyond"))  # a row per range
    # the last point passed on the way serves: a running value, where a frame ahead would be read again for each row
    way = Window.partitionBy("range").orderBy(F.desc("key") if ahead else F.asc("key"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("near", F.last("hit", ignorenulls=True).over(way)).filter("asks")
    return found.join(F.broadcast(beyond), "range", "left").select("key", F.coalesce("near", "beyond").alias("hit"))


def lower_bound(probes: DataFrame, store: DataFrame) -> DataFrame:
    """probes with the first live key at or after each (found_key, value; null past the end). Equal probes are looked up once."""
    found = _nearest(probes, store.select("key", F.struct("key", "value").alias("hit")), ahead=True)
    return probes.join(found, "key").select("probe", "key", F.col("hit.key").alias("found_key"), F.col("hit.value").alias("value"))


def route(probes: DataFrame, fences: DataFrame) -> DataFrame:
    """probes with the region whose fence is the last at or before the key; fences: a row per region, the first from 0. Probes below it are left out."""
    found = _nearest(probes, fences.select(F.col("fence").alias("key"), F.col("region").alias("hit")), ahead=False).filter("hit is not null")
    return probes.join(found, "key").select("probe", "key", F.col("hit").alias("region"))


def scan(probes: DataFrame, store_ranked: DataFrame, length: int, bucket: int = 1024) -> DataFrame:
    """For each probe (probe, rank of its lower bound): up to `length` rows from there. An equi-join on buckets of ranks."""
    upto = F.col("rank") + length - 1
    wanted = probes.select("probe", F.col("rank").alias("from"), upto.alias("to"), F.explode(F.sequence(F.expr(f"rank div {bucket}"), F.expr(f"(rank + {length} - 1) div {bucket}"))).alias("bucket"))
    rows = store_ranked.select("key", "value", "rank", F.expr(f"rank div {bucket}").alias("bucket"))
    return wanted.join(rows, "bucket").filter("rank between from and to").select("probe", "key", "value", (F.col("rank") - F.col("from")).alias("at"))


def merged(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Live rows of base with delta (key, value, deleted, seq) over it: of each key the last change counts, a deletion removes it."""
    rows = base.select("key", F.struct(F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("deleted"), "value").alias("row")).unionByName(delta.select("key", F.struct(F.col("seq").cast("long").alias("seq"), "deleted", "value").alias("row")))
    return rows.groupBy("key").agg(F.max("row").alias("row")).filter("not row.deleted").select("key", F.col("row.value").alias("value"))


def change_flags(base: DataFrame, changes: DataFrame) -> DataFrame:
    """For each change (seq, kind, key): did it insert (upsert), or find its key (update, erase)? Changes of a key act in order of seq."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # an upsert or erase sets whether the key lives; an update leaves that as it is
    sets = F.when(F.col("kind") == "upsert", True).when(F.col("kind") == "erase", False)
    known = changes.withColumn("__set", sets).withColumn("__now", F.last("__set", ignorenulls=True).over(before))
    alive = F.coalesce("__now", F.col("__base").isNotNull())
    return known.join(base.select("key", F.lit(1).alias("__base")), "key", "left").select("seq", "kind", "key", F.when(F.col("kind") == "upsert", ~alive).otherwise(alive).alias("flag"))


def live_find(probes: DataFrame, base: DataFrame, delta: DataFrame) -> DataFrame:
    """Point lookups over base with delta on top of it: a key's last change counts, a deletion hides it."""
    return find(probes, merged(base, delta))


def materialised(base: DataFrame, delta: DataFrame, region_keys: int = 4096) -> DataFrame:
    """The live rows in new regions: key, value, region and local_rank."""
    return regions(ranked(merged(base, delta)), region_keys).select("key", "value", "region", "local_rank")


def violations(store_regions: DataFrame, fences: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for a sound store (key, rank, region; fences: region, fence): keys not above the one
    before, keys routed to another region than theirs, ranks given twice, keys given twice."""
    order = previous(store_regions.select("rank", "key"), "key").agg(F.count_if(F.col("key") <= F.col("previous")).alias("unordered"), F.count("*").alias("n"), F.count_distinct("rank").alias("r"), F.count_distinct("key").alias("k"))
    routed = route(store_regions.select(F.col("region").alias("probe"), "key"), fences).agg(F.count_if(F.col("probe") != F.col("region")).alias("astray"), F.count("*").alias("routed"))
    both = order.crossJoin(F.broadcast(routed))  # one row each
    return both.select("unordered", (F.col("astray") + F.col("n") - F.col("routed")).alias("astray"), (F.col("n") - F.col("r")).alias("equal_ranks"), (F.col("n") - F.col("k")).alias("equal_keys"))


def validate(store_regions: DataFrame, fences: DataFrame) -> DataFrame:
    """store_regions, if violations() finds none; else ValueError."""
    got = violations(store_regions, fences).first().asDict()
    if any(got.values()):
        raise ValueError(f"unsound store: {got}")
    return store_regions


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key that two results don't agree on: keys, side ('left', 'right' or 'both'), and the fields that differ. Nulls are equal."""
    others = [c for c in left.columns if c not in keys]
    l, r = (d.select(*keys, F.struct(*others).alias(f"__{s}"), F.lit(True).alias(f"__in_{s}")) for d, s in ((left, "l"), (right, "r")))
    j = l.join(r, keys, "full")
    side = F.when(F.col("__in_r").isNull(), "left").when(F.col("__in_l").isNull(), "right").otherwise("both")
    fields = F.when(side == "both", F.array_compact(F.array(*(F.when(~F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")), F.lit(c)) for c in others)))).otherwise(F.array().cast("array<string>"))
    return j.select(*keys, side.alias("side"), fields.alias("fields")).filter((F.col("side") != "both") | (F.size("fields") > 0))

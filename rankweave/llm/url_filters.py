"""URL block and allow rules by a sort-merge range join.

With its labels reversed (org, example, www) a host is a key whose subdomains all begin with it, so a rule's
host covers one interval of keys, and two rules' intervals are nested or apart. Interval ends and urls are
sorted together; sweeping over them, the last interval end passed tells which rules are active: the stack of
nested rule hosts, from the widest to the narrowest. A url takes the longest rule of its stack whose path
begins its path.

Only urls whose top-level label has rules are swept. Work is dealt by that label, and a label with many urls is dealt into
several salted parts, each of which gets that label's interval ends; no part's size grows with the number of urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER_LABEL, _END = "\x01", "\x02"  # every label of a key ends with the first; an interval ends before the second


def _rest(url: Column) -> Column:
    """What follows the first ://, null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From after the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, _AFTER_LABEL), F.lit(_AFTER_LABEL))


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", part_rows: int = 5_000) -> DataFrame:
    """df with host, path, rule (the rule's host and path, null where none fits) and verdict (the rule's, else `otherwise`).

    rules: host, path, verdict (block or allow). A rule fits its host and all subdomains, where the url's path starts with
    the rule's path; the longest host + path wins, then the longer host, then block. Null rule paths count as empty, rules
    with a null or empty host fit nothing, a rule given twice counts once. Null urls and urls without :// have an empty host and path
    and fit no rule. Columns of df named host, path, rule or verdict are replaced; rows are kept as they are, repeated ones too.
    part_rows: urls of one top-level label that one part of the sweep takes."""
    kept = [c for c in df.columns if c not in {"host", "path", "rule", "verdict"}]
    url = F.col(f"`{url_col}`")
    urls = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), url_host(url).alias("host"), url_path(url).alias("path"))

    rule = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
        .filter((F.length("host") > 0) & F.col("verdict").isNotNull())
        .distinct()
    )
    # The stack of each rule host: its own rules and those of the hosts that it is a subdomain of.
    hosts, parts = rule.select("host").distinct(), F.split("host", r"\.")
    steps = hosts.select(F.col("host").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("host"))
    stacked = steps.join(rule, "host").groupBy("of").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("stack"))
    labels = _labels(F.col("of"))
    ends = stacked.withColumn("__k", _key(labels)).select(
        labels[0].alias("top"),
        F.explode(
            F.array(
                F.struct(F.col("__k").alias("key"), F.lit(1).alias("kind"), F.col("stack").alias("active")),
                F.struct(F.concat(F.expr("left(__k, length(__k) - 1)"), F.lit(_END)).alias("key"), F.lit(0).alias("kind"), F.filter("stack", lambda r: r["host"] != F.col("of")).alias("active")),
            )
        ).alias("e"),
    )
    hashed = [f"row.`{c}`" for c, t in df.dtypes if c in kept and "map<" not in t]
    return _swept(urls, ends, kept, hashed, otherwise, part_rows)


def _swept(urls: DataFrame, ends: DataFrame, kept: list[str], hashed: list[str], otherwise: str, part_rows: int) -> DataFrame:
    urls = urls.withColumn("__top", _labels(F.col("host"))[0])
    # How many parts each top-level label with rules is dealt into.
    # A part has at least as many urls as its label has interval ends, so copying these costs no more than the urls themselves.
    ends_of = ends.groupBy("top").agg(F.count("*").alias("ends"))
    counts = urls.filter(F.length("host") > 0).groupBy(F.col("__top").alias("top")).agg(F.count("*").alias("n"))
    parts = written(counts.join(ends_of, "top").select("top", F.ceil(F.col("n") / F.greatest(F.lit(part_rows), F.col("ends"))).cast("int").alias("parts")), "parts")
    dealt = urls.join(small(parts), (F.col("top") == F.col("__top")) & (F.length("host") > 0), "left")
    apart = dealt.filter("parts is null")
    salted = dealt.filter("parts is not null").select("top", F.pmod(F.xxhash64("host", "path", *hashed), F.col("parts")).cast("int").alias("part"), _key(_labels(F.col("host"))).alias("key"), F.lit(2).alias("kind"), "row", "host", "path")
    events = ends.join(parts, "top").select("top", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "e.key", "e.kind", F.col("e.active").alias("active"))
    both = salted.unionByName(events, allowMissingColumns=True).repartition("top", "part")  # by both: a label alone would meet in one task
    sweep = Window.partitionBy("top", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = both.withColumn("active", F.last("active", ignorenulls=True).over(sweep)).filter("kind = 2")
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]) & ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))))
    name = lambda r: F.concat(r["host"], r["path"])
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(name(r)).alias("n"), F.length(r["host"]).alias("h"), (r["verdict"] == "block").alias("b"), name(r).alias("rule"), r["verdict"].alias("verdict"))))
    judged = active.withColumn("best", best).select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
    out = judged.unionByName(apart.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "host", "path", "rule", "verdict")

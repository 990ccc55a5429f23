"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each text gets a few measures. Their quartiles per language and source come from mergeable quantile sketches
(percentile_approx: partial sketches per task, merged after the shuffle, so a source with a third of all rows
moves no more than any other), and an outlier beyond the quartiles by several interquartile ranges fails, in
place of a fixed cutoff. Measures are written once, thresholds are joined to them; the texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, clean_text, small, written

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Measure -> (interquartile ranges allowed beyond the quartiles, least distance allowed, whether low values fail too).
MEASURES = {
    "mean_word": (3.0, 1.0, True),
    "symbols_a_word": (3.0, 0.15, False),
    "dup_line_share": (3.0, 0.5, False),
    "repeat_share": (3.0, 0.25, False),
}


def text_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines; columns of these names are replaced.

    A null or empty text has 0 of each. Words are runs of other than ASCII white space; lines with a word count."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    # Each step is a projection of its own, so no array is built twice.
    out = df.select(*kept, clean_text(text_col).alias("__t"))
    out = out.withColumn("__h", F.transform(F.array_remove(F.split("__t", f"{SPACE}+"), ""), lambda w: F.xxhash64(w))).withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0))
    n = F.size("__h")
    out = out.select(
        *kept,
        "__h",
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    # Windows by hash; where any is there twice, sort them as plain longs (upper bits of the hash, then the place) ...
    here = F.slice("__h", 1, F.greatest(n - 2, F.lit(0)))
    out = out.withColumn("__w", F.transform(here, lambda h, i: F.xxhash64(h, F.get("__h", i + 1), F.get("__h", i + 2)))).drop("__h")
    places = (1 << 24) - 1  # texts of more windows than that take all of them to the next step
    packed = F.sort_array(F.transform("__w", lambda h, i: h.bitwiseAND(F.lit(~places)).bitwiseOR(i.cast("long"))))
    some = F.size(F.array_distinct("__w")) < F.size("__w")
    out = out.withColumn("__p", F.when(some & (F.size("__w") <= places), packed).otherwise(F.array().cast("array<bigint>")))
    upper = lambda x: F.shiftright(x, 24)
    near = F.filter("__p", lambda x, k: (upper(x) == upper(F.get("__p", k - 1))) | (upper(x) == upper(F.get("__p", k + 1))))
    at = F.when(F.size("__w") > places, F.sequence(F.lit(0), F.size("__w") - 1)).otherwise(F.transform(near, lambda x: x.bitwiseAND(F.lit(places)).cast("int")))
    out = out.withColumn("__at", at)
    # ... and compare whole hashes among the few that agree so far.
    out = out.withColumn("__s", F.sort_array(F.transform("__at", lambda i: F.struct(F.get("__w", i).alias("h"), i.alias("i"))))).drop("__w", "__p", "__at")
    twice = F.filter("__s", lambda w, k: (w["h"] == F.get("__s", k - 1)["h"]) | (w["h"] == F.get("__s", k + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda w: w["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))
    return out.withColumn("n_repeat_words", covered["n"].cast("long")).drop("__s")


def adaptive_rules(df: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), least_rows: int = 100, accuracy: int = 10_000) -> DataFrame:
    """df's other columns with the measures, base_failed, failed (names of the measures beyond their thresholds) and kept.

    base_failed: fewer than 50 words, or over half of them in three-word windows that occur twice or more.
    Texts that fail the base rules take no part in the quartiles. A group (nulls are a value) of fewer than least_rows
    texts takes the thresholds of its first column, then of all texts. Rows are kept as they are, repeated ones too; null
    texts count as empty, and an empty table gives an empty one. Columns of df named as a measure, n_lines, base_failed, failed or kept
    are replaced, but as groups their values count."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "failed", "kept", *MEASURES}
    rest = [c for c in df.columns if c != text_col and c not in made]
    own = F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("__none")).alias("__row")  # apart from the names used here
    keys = [f"__g{k}" for k in range(len(groups))]
    named = [F.coalesce(F.col(f"`{g}`").cast("string"), F.lit("\x00")).alias(k) for g, k in zip(groups, keys, strict=True)]
    out = text_measures(df.select(own, *named, clean_text(text_col).alias("__text")), "__text").drop("__text")
    words = F.greatest(F.col("n_words"), F.lit(1))
    out = out.select(
        *out.columns,
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbols_a_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    out = written(out, "measures")  # without the texts: they are measured once, for the sketches and the verdicts
    sketches = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), F.lit(accuracy)).alias(f"__q_{m}") for m in MEASURES]
    passing = out.filter("not base_failed").select(*keys, *MEASURES)
    whole = passing.agg(F.count("*").alias("__n"), *sketches)
    first = passing.groupBy(keys[0]).agg(F.count("*").alias("__n"), *sketches)
    each = passing.groupBy(*keys).agg(F.count("*").alias("__n"), *sketches)
    limits = out.join(small(each), keys, "left")
    limits = _or_else(limits, first, keys[:1], least_rows)
    limits = _or_else(limits, whole, [], least_rows)
    tests = []
    for m, (ranges, least, low) in MEASURES.items():
        lo, hi = F.col(f"__q_{m}")[0], F.col(f"__q_{m}")[1]
        slack = F.greatest(ranges * (hi - lo), F.lit(least))
        beyond = (F.col(m) > hi + slack) | ((F.col(m) < lo - slack) if low else F.lit(False))
        tests.append(F.when(beyond, F.lit(m)))
    failed = F.array_compact(F.array(*tests))
    return limits.select(*(F.col(f"__row.`{c}`") for c in rest), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", failed.alias("failed"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"))


def _or_else(df: DataFrame, wider: DataFrame, keys: list[str], least_rows: int) -> DataFrame:
    """df's quartiles, or those of the wider group where its own has too few rows."""
    names = ["__n", *(f"__q_{m}" for m in MEASURES)]
    other = wider.select(*keys, *(F.col(c).alias(f"{c}_w") for c in names))
    joined = df.join(small(other), keys, "left") if keys else df.crossJoin(F.broadcast(other))  # one row
    few = F.coalesce(F.col("__n"), F.lit(0)) < least_rows
    return joined.select(*(c for c in df.columns if c not in names), *(F.when(few, F.col(f"{c}_w")).otherwise(F.col(c)).alias(c) for c in names))

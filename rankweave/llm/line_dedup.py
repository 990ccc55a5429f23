"""Line deduplication by a log-template tree of fixed depth, in DataFrame operations only.

A line goes down the tree by its number of words and its leading words, words with a digit counting as the
variable field <*>. In each leaf, a word that fewer than min_docs documents have at its place is a variable
field too, and with min_share one that less than this share of the leaf's documents have: values of fields come to
recur as a corpus grows, but their share stays. Lines that then agree are one template, if enough of its fields are constant. A template that
min_docs documents have recurs: its first document keeps it, all others lose their lines of it.

What is shuffled are 64-bit hashes of leaves, lines and words, the last only for leaves in which different
lines meet. Counts are summed per task before each shuffle, so a line in a third of all documents is no hot spot; joins
on lines and words have written tables on both sides, so that the adaptive skew join can split what many rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, clean_text, forget, small, written

FIELD = "<*>"
_WORD = r"[^\x20\x09-\x0D]"


def _masked(line: Column) -> Column:
    """The line with every word that has a digit replaced by the variable field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, rf"(?<!{_WORD})[^\x20\x09-\x0D0-9]*+[0-9]{_WORD}*+", FIELD)).otherwise(line)


def _spaced(line: Column) -> Column:
    """The line with one space between words and none around them; most lines are so already and cost a few byte searches."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for blank in ("  ", *SPACE_CHARS.replace(" ", "")):
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.trim(F.regexp_replace(line, f"{SPACE}+", " "))).otherwise(line)


def _keyed(lines: DataFrame, depth: int, min_words: int, short: bool) -> DataFrame:
    """Rows with the line spaced and masked, and its leaf and hash; short lines are left out, or not masked and each a leaf of its own."""
    head = F.substring_index("line", " ", depth)
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return (
        lines.withColumn("line", _spaced(F.col("line")))
        .withColumn("n", F.when(F.col("line") == "", 0).otherwise(spaces + 1))
        .filter(F.col("n") >= (1 if short else min_words))
        .withColumn("line", F.when(F.col("n") < min_words, F.col("line")).otherwise(_masked(F.col("line"))) if short else _masked(F.col("line")))
        .withColumn("leaf", F.xxhash64("n", F.when(F.col("n") < min_words, F.col("line")).otherwise(head) if short else head))
        .withColumn("hash", F.xxhash64("line"))
        .drop("n")
    )


def drop_recurring_lines(df: DataFrame, depth: int = 3, min_words: int = 5, min_docs: int = 2, constant: float = 0.7, min_share: float = 0.0, short: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its texts less the lines of recurring templates, and n_lines and n_dropped (replaced if df has them).

    Lines end at \\n; those of fewer than min_words words stay, or with short go where the very same words recur. A document is the pair of id and text: the first is the one of the
    smallest id (null last), then of the smallest text hash; repeated rows are one document, and all keep or lose the same lines.
    A document counts once per different line. Null texts count as empty; a text that loses no line is kept byte for byte, one that
    loses all becomes empty. No rows are dropped."""
    kept = [c for c in df.columns if c not in {"n_lines", "n_dropped"}]
    text = clean_text(text_col)
    ident = F.xxhash64(F.col(id_col).cast("string"), text)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), ident.alias("ident"))
    docs = df.select(order.alias("doc"), F.split(text, "\n").alias("lines"))

    # 1. Leaf and hash of every line, then documents and first document of each different line, and a place to find it.
    placed = _keyed(docs.select("doc", F.posexplode("lines").alias("at", "raw")).select("doc", "at", F.col("raw").alias("line")), depth, min_words, short)
    placed = written(placed.select("doc", "at", "leaf", "hash"), "placed")
    once = placed.groupBy("doc", "leaf", "hash").agg(F.min("at").alias("at"))
    lines = written(once.groupBy("leaf", "hash").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "at")).alias("where")), "lines")

    # 2. Templates of the leaves in which several lines meet; the words of each such line are read at its first place.
    several = lines.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).filter((F.col("kinds") > 1) & (F.col("docs") >= min_docs))
    several = written(several.select("leaf", F.col("docs").alias("of")), "leaves")
    met = written(lines.join(several, "leaf"), "met")
    listed = [F.collect_list(c).alias(c) for c in ("at", "docs", "of")]  # of one row each, so in one order
    sought = met.select("where.doc", F.col("where.at").alias("at"), "docs", "of").groupBy("doc").agg(*listed)
    sought = written(sought.select("doc", F.arrays_zip("at", "docs", "of").alias("sought")), "sought")
    # A few million line numbers are broadcast; beyond that bound texts go to them.
    found = docs.join(small(sought, 2_000_000, F.size("sought")), "doc").select("lines", F.explode("sought").alias("s"))
    found = _keyed(found.select(F.get("lines", F.col("s.at")).alias("line"), F.col("s.docs").alias("docs"), F.col("s.of").alias("of")), depth, min_words, short)
    # A word at its place in a leaf is one number. Fields are no constants, and a leaf's lines share their leading words, so that neither needs a row.
    found = found.select("leaf", "hash", "docs", "of", F.split("line", " ").alias("words"))
    lead = F.size(F.filter(F.slice("words", 1, depth), lambda w: w != FIELD))
    each = found.select("leaf", "hash", "docs", "of", F.size("words").alias("n"), lead.alias("lead"), F.posexplode("words").alias("at", "w"))
    number = F.when(F.col("at") == 0, 0).when((F.col("at") >= depth) & (F.col("w") != FIELD), F.xxhash64("leaf", "at", "w")).cast("long")
    places = each.select("hash", "docs", "of", "n", "lead", number.alias("word")).filter("word is not null")
    places = written(places, "places")  # 0: the first word, which stands for the line itself, as its other words may all be fields
    common = places.filter("word <> 0").groupBy("word").agg(F.sum("docs").alias("with"), F.first("of").alias("of"))
    common = written(common.filter((F.col("with") >= min_docs) & (F.col("with") >= min_share * F.col("of"))).select("word"), "common")
    told = places.select("hash", "word", "n", "lead").filter("word <> 0").join(common, "word", "left_semi").select("hash", "word", F.lit(0).alias("n"), F.lit(0).alias("lead"))
    told = told.unionByName(places.filter("word = 0").select("hash", "word", "n", "lead"))
    # A template is its leaf with its constants by place; two sums over them that do not depend on the order stand for it.
    marked = told.groupBy("hash").agg(F.bit_xor("word").alias("x"), F.bit_xor(F.xxhash64("word")).alias("y"), ((F.count_if(F.col("word") != 0) + F.max("lead")) / F.max("n")).alias("constant"))
    marked = marked.filter(F.col("constant") >= constant).select("hash", F.xxhash64("x", "y").alias("template"))
    of_template = written(marked.join(met, "hash").select("leaf", "hash", "template", "docs", F.col("where.doc").alias("first")), "templates")
    # Documents count once per line: two have the template if two have one of its lines, or two lines have different first ones.
    general = of_template.groupBy("leaf", "template").agg(F.sum("docs").alias("docs"), F.max("docs").alias("most"), F.min("first").alias("first"), F.max("first").alias("last"))
    general = general.filter((F.col("docs") >= min_docs) & ((F.col("most") > 1) | (F.col("first") != F.col("last"))))
    general = written(general.select("leaf", "template", "first"), "general")
    general = of_template.select("leaf", "hash", "template").join(general, ["leaf", "template"]).select("leaf", "hash", "first")

    # 3. Lines that recur by themselves or by their template; the template's first document is the earlier one.
    own = lines.filter(F.col("docs") >= max(min_docs, 2)).select("leaf", "hash", F.col("where.doc").alias("first"))
    recurring = written(own.unionByName(general).groupBy("leaf", "hash").agg(F.min("first").alias("first")), "recurring")
    forget(lines, several, met, sought, places, common, of_template)

    # 4. What each document loses. Texts go to it, unless it is a bounded number of places.
    lost = placed.join(recurring, ["leaf", "hash"]).filter(F.col("doc") > F.col("first")).groupBy("doc").agg(F.array_distinct(F.collect_list("at")).alias("__lost"))
    lost = written(lost.select(F.col("doc").alias("__doc"), "__lost"), "lost")
    forget(placed, recurring)
    out = df.withColumn("__doc", order).join(small(lost, 2_000_000, F.size("__lost")), "__doc", "left")
    lines_of = F.split(text, "\n")
    # a plain lambda over a pair of the line and whether it goes: the array of places is an argument of array_except, not looked up per line
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), "__lost")
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("__split"), i)), "\n")
    out = out.withColumn("__split", lines_of)
    new_text = F.when(F.col("__lost").isNull(), text).otherwise(rest)
    return out.select(*(new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept), F.size("__split").cast("long").alias("n_lines"), F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_dropped"))

"""A training-data pipeline over documents: stages that each write their result for the next one to read.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. run() applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import SPACE_CHARS, read, small, written
from rankweave.llm.decontamination import contaminated
from rankweave.llm.jaccard_join import keep_one_of_each
from rankweave.llm.line_dedup import drop_recurring_lines
from rankweave.llm.packing import pack_documents
from rankweave.llm.quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects (score below 0.7); it learns from three quarters of the labelled documents.

    Null and empty texts have the model's prior, a score like any other. Repeated rows all stay or all go; an empty table stays so."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold != 2)
    model = fit_quality(docs.select("doc_id", "text"), labels)
    return score_quality(docs, model, accept=0.7).filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates from all documents but the first, and documents that lose all their words so.

    Null texts become empty and stay, as nothing is lost. Repeated rows are one document and lose the same lines."""
    out = drop_recurring_lines(docs.select(*COLUMNS), min_share=0.05, short=True)
    left = F.length(F.translate("text", SPACE_CHARS, "")) > 0
    out = out.filter((F.col("n_dropped") == 0) | left)  # most texts need not be built anew for the filter
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Of repeated rows one stays, and all documents without words. Null ids are never the least of a group with other ids."""
    return keep_one_of_each(docs.select(*COLUMNS), n=5, similarity=(4, 5))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have a copy, edited or not, of a benchmark item.

    Documents with a null id are one document here, so one such copy drops them all. Null and empty texts stay."""
    found = contaminated(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__found")).distinct()
    found = written(found, "found")
    return docs.join(small(found), F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; a row per piece. Null and empty texts are a piece of the end mark alone."""
    import public_tokenizers

    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, ngram_jaccard_join, benchmark_decontamination, best_fit_packing)]

#: The classifier's weights come from numpy training and the packing from a tokenizer: SQL can't express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def _fold(n: int):
    """crc32 of the document's id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import prefix_token_counts

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_token_counts(docs, _tokenizer("piece_bpe_32k.model"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_fold(5) != 0)
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, _tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(_fold(4) != 2)
    model = fit_quality(docs, labels)
    return score_quality(docs, model, accept=0.7).select("doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_urls

    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM best
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import adaptive_rules

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return adaptive_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN repeated USING (doc_id)
), s AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word, n_symbols / greatest(n_words, 1) AS symbols_a_word,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
), q AS (
  SELECT lang, source, grouping(lang, source) AS level, count(*) AS n,
         QUARTILES
  FROM s WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())
), j AS (
  SELECT s.*, CASE WHEN e.n >= 100 THEN e WHEN f.n >= 100 THEN f ELSE a END AS c
  FROM s LEFT JOIN q e ON e.level = 0 AND e.lang = s.lang AND e.source = s.source LEFT JOIN q f ON f.level = 1 AND f.lang = s.lang CROSS JOIN (SELECT * FROM q WHERE level = 3) a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(TESTS, false) AS kept
FROM j
"""


def _op7_sql() -> str:
    from .quality_rules import MEASURES

    quartiles = ",\n         ".join(f"quantile_disc({m}, 0.25) AS lo_{m}, quantile_disc({m}, 0.75) AS hi_{m}" for m in MEASURES)
    slack = {m: f"greatest({r} * (c.hi_{m} - c.lo_{m}), {least})" for m, (r, least, _) in MEASURES.items()}
    tests = " OR ".join(f"{m} > c.hi_{m} + {slack[m]}" + (f" OR {m} < c.lo_{m} - {slack[m]}" if low else "") for m, (_, _, low) in MEASURES.items())
    return OP7_SQL.replace("QUARTILES", quartiles).replace("TESTS", f"({tests})")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"), n=5, similarity=(4, 5))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_recurring_lines

    out = drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), masked AS (
  SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '[0-9]') THEN regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') ELSE line END AS m FROM lines
), words AS (
  SELECT doc_id, pos, line, m, list_filter(regexp_split_to_array(m, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM masked
), keyed AS (
  SELECT *, len(w)::VARCHAR || ' ' || array_to_string(w[1:3], ' ') AS leaf FROM words WHERE len(w) >= 5
), kinds AS (
  SELECT leaf, w, count(*) AS docs, min(doc_id) AS first, max(doc_id) AS final FROM (SELECT DISTINCT doc_id, leaf, w FROM keyed) GROUP BY leaf, w
), several AS (
  SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 2
), places AS (
  SELECT leaf, w, docs, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM kinds WHERE leaf IN (SELECT leaf FROM several)
), common AS (
  SELECT leaf, pos, word, sum(docs) AS n FROM places GROUP BY ALL HAVING sum(docs) >= 2
), marked AS (
  SELECT p.leaf, p.w, list(CASE WHEN c.n IS NULL THEN '<*>' ELSE p.word END ORDER BY p.pos) AS template, avg((c.n IS NOT NULL AND p.word <> '<*>')::INT) AS constant
  FROM places p LEFT JOIN common c USING (leaf, pos, word) GROUP BY p.leaf, p.w
), of_template AS (
  SELECT leaf, w, template, docs, first, final FROM marked JOIN kinds USING (leaf, w) WHERE constant >= 0.7
), general AS (
  SELECT leaf, template, min(first) AS first FROM of_template GROUP BY ALL HAVING sum(docs) >= 2 AND min(first) <> max(final)
), recurring AS (
  SELECT leaf, w, min(first) AS first FROM (
    SELECT leaf, w, first FROM kinds WHERE docs >= 2 AND first <> final
    UNION ALL SELECT o.leaf, o.w, g.first FROM of_template o JOIN general g USING (leaf, template)
  ) GROUP BY leaf, w
), lost AS (
  SELECT k.doc_id, k.pos FROM keyed k JOIN recurring r USING (leaf, w) WHERE k.doc_id > r.first
)
SELECT doc_id, count(*) AS n_lines, count(lost.pos) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (lost.pos IS NULL), '')) AS text_md5
FROM lines LEFT JOIN lost USING (doc_id, pos) GROUP BY doc_id
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_jaccard_join, op3_line_dedup, op4_toxicity, op5_decontamination, op6_url_filters, op7_quality_rules, op8_packing, op9_quality, op10_warc)
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op6_url_filters": OP6_SQL, "op7_quality_rules": _op7_sql()}

"""Odd rows, clashing columns, ties and brute-force versions of the corpus operators and of the pipeline's stages."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import decontamination, quality, toxicity
from rankweave.llm.jaccard_join import jaccard_join, keep_one_of_each
from rankweave.llm.line_dedup import drop_recurring_lines
from rankweave.llm.quality_rules import MEASURES, adaptive_rules
from rankweave.llm.token_counts import prefix_token_counts
from rankweave.llm.url_filters import judge_urls
from rankweave.llm.warc import archive_pages

SF = "/root/testdata/sf0.001"
ROWS = [(None, None), (None, "a b c d e f"), (1, ""), (2, None), (3, " \n\t "), (4, "one"), (4, "one"), (5, "  two  spaces\n\n"), (6, "word " * 3000), (7, "one"), (8, "x" * 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length("text").cast("long").alias("n_chars"))


def clash(df, *names):
    return df.select("*", *(F.lit(f"mine {n}").alias(n) for n in names))


def test_columns_of_the_operators_names(spark, docs):
    path = __import__("public_tokenizers").path("piece_bpe_32k.model")
    assert prefix_token_counts(clash(docs, "n_bytes", "n_tokens"), path, limit=10).select("doc_id", "n_bytes", "n_tokens").count() == len(ROWS)
    assert drop_recurring_lines(clash(docs, "n_lines", "n_dropped", "leaf", "hash", "lines", "doc", "at", "first", "docs", "of")).filter("n_lines >= 0 and leaf = 'mine leaf'").count() == len(ROWS)
    out = adaptive_rules(clash(docs, *MEASURES, "n_words", "failed", "kept", "base_failed", "n_lines", "__n"))
    assert len(out.columns) == len(set(out.columns)) and out.filter("n_words >= 0 and not kept").count() == len(ROWS)
    assert len(quality.score_quality(clash(docs, "score", "predicted"), quality.train(["a b", "c d"], [0, 1], buckets=64)).columns) == len(docs.columns) + 2
    kept = keep_one_of_each(clash(docs, "copies", "key", "num", "bucket", "class_id", "n_links", "id"))
    assert "mine copies" in {r.copies for r in kept.collect()}
    # equal texts with words: the least id stays once (4 of 4, 4, 7); those without words all stay
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d in [None, None, 1, 2, 3, 4, 5, 6, 8])


def test_rules_on_odd_and_empty_tables(docs):
    for r in adaptive_rules(docs).collect():
        assert not r.kept and r.base_failed and r.n_words >= 0
    assert adaptive_rules(docs.filter("false")).count() == 0


def test_rules_against_quartiles(spark):
    rng = random.Random(12)
    rows = [(k, " ".join("x" * rng.choice([3, 4, 5]) + str(rng.randrange(500)) for _ in range(80)), rng.choice(["en", None]), "web") for k in range(300)]
    rows += [(1000, " ".join("y" * 40 + str(k) for k in range(80)), "en", "web"), (1001, " ".join("a|" * 3 + str(k) for k in range(80)), "en", "web")]
    got = {r.doc_id: (r.kept, r.failed) for r in adaptive_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000][1] == ["mean_word"] and "symbols_a_word" in got[1001][1]
    assert all(got[k][0] for k in range(300))


def test_urls_repeated_and_none(spark):
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    rows = [(1, "http://a.net/x")] * 3 + [(2, "http://b.org/")] * 2 + [(None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in judge_urls(df, rules, part_rows=1).collect())
    assert got == {(1, "net/", "block"): 3, (2, None, "allow"): 2, (None, None, "allow"): 2}
    assert judge_urls(df.filter("false"), rules).count() == 0
    assert {r.verdict for r in judge_urls(df, rules.filter("false")).collect()} == {"allow"}


def test_archives_of_repeated_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "u", "other"), (3, "u", "z" * 50)]
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(1, 4, "response", None): 2, (2, 4, "revisit", 1): 1, (2, 5, "response", None): 1, (3, 50, "response", None): 1}
    small = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), least_bytes=5).collect()
    assert all(r.record_type == "response" for r in small)


def test_links_of_documents_against_all_pairs(spark):
    """Every link among the given documents, by an index of all their 5-grams."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, index = {}, defaultdict(list)
    for r in df.collect():
        w = (r.text or "").split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    shared = Counter((a, b) for ds in index.values() for a in ds for b in ds if a < b)
    links = defaultdict(set)
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a].add(b)
            links[b].add(a)
    got = {r.doc_id: r for r in jaccard_join(df).collect()}
    found = sum(got[d].n_links for d in sets)
    assert sum(map(len, links.values())) == found > 50
    for d in sets:
        assert got[d].n_links == len(links[d]) and all(got[d].class_id == got[e].class_id for e in links[d])


def full_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_contamination_against_every_pair(spark):
    """Whole texts against whole items, for all pairs that share a seed; recall on copies with edits of several strengths."""
    rng, words = random.Random(21), [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 40)))) for k in range(12)]
    rows = []
    for k in range(120):
        copy = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1])
        rows.append((k, " ".join([rng.choice(words) for _ in range(rng.randrange(30))] + copy + [rng.choice(words) for _ in range(rng.randrange(30))])))
    rows += [(500 + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(30)] + [(900, " ".join(rng.choice(words) for _ in range(20_000)))]
    want = {}
    for d, text in rows:
        t = text.split()
        grams = {tuple(t[i : i + 4]) for i in range(len(t) - 3)}
        for k, item in items:
            w = item.split()
            if d < 900 and any(tuple(w[i : i + 4]) in grams for i in range(len(w) - 3)) and (s := full_alignment(w, t)) >= min(0.5 * len(w), 30):
                want[d, k] = s
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "item_id", "score", "share", "words")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 80


def test_quotation_lowers_a_score():
    abuse, _ = toxicity.context_scores("you are a zorble and that is all".split(), [3], [1.0])
    said, n = toxicity.context_scores("he said zorble to the whole class".split(), [2], [1.0])
    marked, m = toxicity.context_scores('the word is "zorble" in this text'.split(), [3], [1.0])
    many, _ = toxicity.context_scores("zorble and zorble again".split(), [0, 2], [1.0, 1.0])
    assert abuse == [1.0] and said == [0.2] and marked == [0.2] and (n, m) == (1, 1) and many == [1.25, 1.25]


def test_toxicity_scores_against_whole_texts():
    """The scorer's sums, whatever its memory holds, equal those of one text at a time with a trie of its own."""
    rng = random.Random(5)
    terms = {"zorble": 2.0, "grunt": 1.0, "fleep*": 1.5}
    texts = [" ".join(rng.choice(["zorble", "zorbel", "grunt", "fleeped", "good", "day", '"zorble"', "said"]) for _ in range(rng.randrange(40))) for _ in range(60)] + [""]
    together = toxicity.ToxicityScorer(terms).features(texts)
    scorer = toxicity.ToxicityScorer(terms)
    for t, row in zip(texts, together, strict=True):
        scorer.trie._forget()
        assert np.allclose(scorer.features([t])[0], row)


def test_quality_scorer_takes_many_new_words_in_bounded_memory():
    rng = np.random.default_rng(0)
    letters = rng.integers(97, 123, (20_000, 40)).astype(np.uint8)
    words = [bytes(row[: 3 + k % 38]).decode() for k, row in enumerate(letters)]
    model = quality.QualityModel(rng.normal(size=1 << 12).astype(np.float32), 0.0, (3, 4))
    alone = list(quality.Scorer(model)([" ".join(words[:1000])]))
    tracemalloc.start()
    together = list(quality.Scorer(model)([" ".join(words[:1000]), " ".join(words[1000:])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # all words together, padded to the longest, took 58 MB
    assert alone[0] == together[0]  # and what other words are new changes no bit


def test_quality_scores_against_one_word_at_a_time():
    rng, words = random.Random(3), [f"{a}{b}" for a in "abcdefg" for b in ("ab", "cde", "fghi", "x" * 50)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    labels = [int(t.count("cde") > t.count("fghi")) for t in texts]
    model = quality.train(texts, labels, buckets=1 << 10, epochs=2)
    for t, got in zip([*texts, ""], quality.Scorer(model)([*texts, ""]), strict=True):
        ws, total, parts, hashes = t.split(), 0.0, 0, []
        for w in ws:
            grams, counted, h = quality.word_buckets([w], model.mask, model.sizes)
            total += float(model.table[grams[0][counted[0]]].mean())
            hashes.append(h[0])
            parts += 1
        for a, b in zip(hashes, hashes[1:]):
            total += float(model.table[quality.pair_buckets(np.array([a, b]), model.mask)[0]])
            parts += 1
        assert abs(got - 1 / (1 + np.exp(-(model.bias + (total / parts if parts else 0))))) < 1e-6


def test_training_vectors_hold_whole_texts():
    """Each word and pair of a text counts, however long the text or the word."""
    long_word = "q" * 5000
    text = "start " + "middle " * 30_000 + long_word + " end"
    (which, share), (none, _) = list(quality.text_vectors([text, " "], (1 << 18) - 1, (3, 4)))
    assert abs(share.sum() - 1) < 1e-3 and len(none) == 0
    for w in ("start", "end", long_word):
        grams, counted, _ = quality.word_buckets([w], (1 << 18) - 1, (3, 4))
        assert np.isin(grams[0][counted[0]], which).all()


def test_stages_on_odd_rows(spark, docs):
    import corpus_pipeline as p

    columns = docs.columns
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = docs.unionByName(spark.createDataFrame([(None, item, "en", "web", 1), (50, item, "en", "web", 1), (51, item, "en", "web", 1)], docs.schema))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == columns, name
        assert stage(spark, more.filter("false"), SF).count() == 0, name
    left = p.benchmark_decontamination(spark, more, SF)
    assert left.filter("doc_id in (50, 51)").count() == 0 and left.filter("doc_id is null").count() == 0  # null ids are one document
    assert left.filter("doc_id < 50").count() == sum(d is not None for d, _ in ROWS)
    packed = p.best_fit_packing(spark, more, SF)
    assert packed.filter("length > 0").count() >= len(ROWS) and p.best_fit_packing(spark, more.filter("false"), SF).count() == 0

"""Each corpus operator against a brute-force version, a round trip or held-out accuracy, and on odd rows."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from rankweave.llm import queries
from rankweave.llm.components import connected_components
from rankweave.llm.decontamination import align, contaminated, hashes_of
from rankweave.llm.jaccard_join import jaccard_join, keep_one_of_each
from rankweave.llm.line_dedup import drop_recurring_lines
from rankweave.llm.packing import ByteBpe, best_fit, pack_documents
from rankweave.llm.quality import fit_quality, score_quality
from rankweave.llm.quality_rules import text_measures
from rankweave.llm.token_counts import PrefixCounter, prefix_token_counts, tokens_in_prefix
from rankweave.llm.toxicity import FuzzyTrie, fit_toxicity, score_toxicity
from rankweave.llm.url_filters import judge_urls
from rankweave.llm.warc import archive_pages, inflate_records

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}{c}" for k in range(60) for c in "abcdefgh"]
ODD = [(None, None, "x", 1), (1, "", "x", 2), (2, None, None, 3), (3, " \n\t ", "x", 4), (4, "one", "x", 5), (4, "one", "x", 5), (5, "  two  spaces\n\n", "x", 6), (6, "word " * 3000, "x", 7)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, score long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_every_prefix_count():
    counter, rng = PrefixCounter(path("piece_bpe_32k.model")), random.Random(1)
    texts = ["".join(rng.choice("ab cdethéñ  \n\t▁日☃🙂.,<s>12") for _ in range(rng.randrange(25))) for _ in range(150)]
    for text, steps in zip(texts, counter.of_batch(texts), strict=True):
        for k in range(len(text) + 1):
            assert tokens_in_prefix(steps, k) == len(counter.sp.encode(text[:k]))


def test_token_counts_of_documents(spark, odd, empty):
    sp = PrefixCounter(path("piece_bpe_32k.model")).sp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        for r in prefix_token_counts(df, path("piece_bpe_32k.model"), limit=100).collect():
            n = len(sp.encode(r.text or ""))
            assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 100, len((r.text or "").encode()))
            assert len(sp.encode((r.text or "")[: r.chars_within_limit])) <= 100
    assert prefix_token_counts(empty, path("piece_bpe_32k.model")).count() == 0


def test_jaccard_join_against_all_pairs(spark, odd, empty):
    rng, texts = random.Random(4), []
    for _ in range(60):
        base = prose(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += texts[:10] + [prose(random.Random(8), 80)] * 40
    shared = prose(rng, 60)  # a passage that many otherwise different texts share
    texts += [shared + " " + prose(rng, 60) for _ in range(120)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    links = {i: {j for j in range(len(sets)) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(len(sets))}
    least = {}
    for i in range(len(sets)):
        if i not in least:
            todo, seen = [i], {i}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            least |= dict.fromkeys(seen, i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(df, leaf=8, block=16).collect()}
    assert got == {i: (least[i], len(links[i])) for i in range(len(texts))}
    assert sorted(r.doc_id for r in keep_one_of_each(df).collect()) == sorted(set(least.values()))
    assert jaccard_join(odd).count() == len(ODD) and jaccard_join(empty).count() == 0
    assert sorted(r.score for r in keep_one_of_each(odd).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(1, n + 1), 0) | {101: 100}


def test_line_dedup(spark, odd, empty):
    line = "common footer line with five words"
    rows = [(1, f"first own line of this one\n{line}\nshort"), (2, f"{line}\nsecond has a line of its own\nshort"), (3, "item 17 costs about 20 euro now"), (4, "item 18 costs about 35 euro now\ntail"), (5, None), (2, f"{line}\nsecond has a line of its own\nshort")]
    rows += [(10, "the red fox ran over that old green hill today"), (11, "the red fox ran over that old brown hill today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in drop_recurring_lines(df).collect())
    two = (2, "second has a line of its own\nshort", 1)
    assert got == [(1, rows[0][1], 0), two, two, (3, rows[2][1], 0), (4, "tail", 1), (5, "", 0), (10, rows[6][1], 0), (11, "", 1)]
    assert drop_recurring_lines(odd).count() == len(ODD) and drop_recurring_lines(empty).count() == 0


def test_short_lines_recur_exactly(spark):
    import corpus_pipeline

    rows = [(1, "All rights reserved.\nown\n\npage 17 of 20"), (2, "one of mine\n All  rights reserved.\n\npage 18 of 20"), (3, "All rights reserved!\nown\n17\npage 17 of 20"), (4, "18\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'web' source", "cast(length(text) as long) n_chars")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, df, SF).collect())
    assert got == [rows[0], (2, "one of mine\n\npage 18 of 20"), (3, "All rights reserved!\n17"), rows[3]]


def test_templates_of_recurring_values(spark):
    import corpus_pipeline

    rng = random.Random(11)
    names = [a + b for a in "bcdfghjklm" for b in ("ano", "eri", "ulo", "ina", "oto")]  # each recurs in some 12 of 600 documents
    rows = [(k, f"written by our author {rng.choice(names)} for the readers of {rng.choice(names)}") for k in range(600)]
    rows += [(1000 + k, f"{a} line that is in every second one") for k in range(2) for a in ("this", "that")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert drop_recurring_lines(df, min_share=0.05).filter("n_dropped > 0").count() == 599 + 2
    docs = df.selectExpr("doc_id", "text", "'en' lang", "'web' source", "cast(length(text) as long) n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()) == [0, 1000, 1000]


def test_fuzzy_trie_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    terms, rng = ["abcab", "bacab", "abc", "cabbacabb"], random.Random(2)
    trie = FuzzyTrie(terms, ["ccc"])
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        best = min((distance(word, t), t) for t in terms if distance(word, t) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)) if any(distance(word, t) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2) for t in terms) else None
        got = trie.match(word)
        if best is None:
            assert got is None or got[0] == "ccc*" and word.startswith("ccc")
        elif not (got and got[0].endswith("*")):
            assert got == (best[1], best[0])


@pytest.mark.parametrize("fit, score, label, fold, least", [(fit_quality, score_quality, "quality", 4, 0.97), (fit_toxicity, score_toxicity, "toxic", 5, 0.93)])
def test_held_out_accuracy(spark, odd, empty, fit, score, label, fold, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = f"crc32(cast(cast(doc_id as string) as binary)) % {fold} = {2 if fold == 4 else 0}"
    model = fit(docs, labels.filter(f"not ({held})"))
    rows = score(docs.join(labels, "doc_id").filter(held), model).collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in score(odd, model).collect()) and score(empty, model).count() == 0
    assert all(0 <= r.score <= 1 for r in score(odd, fit(odd, labels.filter("false"))).collect())


def test_decontamination(spark, odd, empty):
    rng = random.Random(6)
    item, other = prose(rng, 30), prose(rng, 30)
    edited = item.split()
    for k in (4, 13, 22):
        edited[k] = "changed"
    docs = spark.createDataFrame([(1, prose(rng, 100) + " " + item.upper() + ". " + prose(rng, 50)), (2, " ".join(edited)), (3, prose(rng, 300)), (4, " ".join(item.split()[:8])), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, other), (9, None), (10, "too short")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(1, 7), (2, 7)]
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items, block_items=2).collect()) == [(1, 7), (2, 7)]
    assert contaminated(odd, items).count() == 0 and contaminated(empty, items).count() == 0 and contaminated(docs, items.filter("false")).count() == 0


def test_decontamination_of_many_edited_copies(spark):
    rng = random.Random(9)
    item = [f"{w}{k}" for k, w in enumerate(prose(rng, 30).split())]
    edited = [f"changed{k}" if k in (8, 20) else w for k, w in enumerate(item)]
    rows = [(0, " ".join(item))] + [(k, " ".join(edited)) for k in range(1, 7)]  # copies' seeds are more common than those they lack
    rows += [(k, prose(rng, k) + " " + " ".join(edited) + " " + prose(rng, 40)) for k in range(7, 12)] + [(99, prose(rng, 200))]
    other = [*item[:6], *prose(rng, 24).split()]  # shares seeds with all of them, and is in none
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (None, " ".join(item))], "item_id long, text string")
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == {(d, i): 26.0 if d else 30.0 for d in range(12) for i in (7, None)}
    assert len(got) == 24 and min(r["share"] for r in got) == 26 / 30


def test_alignment_against_the_full_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert align(np.array(a), np.array(b)) == h.max()
    assert len(hashes_of("One, two -- three!")) == 3


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("org", "/fr/", "allow"), ("", "/", "block")]
    urls = ["http://b.example.net/en/1", "http://A.EXAMPLE.net/en/x?q", "http://net/", "http://net", "https://xnet/", "http://a.org/fr/#t", "http://a.org/de", "no url", None, "http://.net/", "http://x.a.example.net:80/en/x"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), part_rows=2).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        tail = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and tail.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, tail, *(max(fits)[1:] if fits else (None, "allow")))


def test_measures_against_python(spark, odd):
    import re

    rng = random.Random(7)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "c#", "|", "é"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(8))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    for r in text_measures(df).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def test_packing_round_trip(spark, odd, empty):
    from pyspark.sql import functions as F

    bpe, cap = ByteBpe(path("byte_bpe_50k.json")), 64
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id > 4").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pack_documents(docs, path("byte_bpe_50k.json"), capacity=cap, group_bins=300).collect()
    ids = {d: [*bpe.tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and (r.length == cap or r.piece == 0)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= 1.02 * sum(map(len, ids.values())) / cap + 2
    assert pack_documents(odd, path("byte_bpe_50k.json")).filter("length > 0").count() >= len(ODD) and pack_documents(empty, path("byte_bpe_50k.json")).count() == 0
    assert sorted(map(len, best_fit(np.array([6, 5, 5, 4]), 10))) == [2, 2]


def test_ids_are_the_librarys():
    bpe, rng = ByteBpe(path("byte_bpe_50k.json")), random.Random(3)
    parts = ["a", "th", "é", " ", "\n", "\t", "日", "🙂", ".", "<|endoftext|>", "12", "　", "\x85", "'s"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert bpe.ids(t).tolist() == bpe.tokenizer.encode(t, add_special_tokens=False).ids


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/é", None), (4, "u", ""), (5, "u", "x\r\n\r\ny"), (None, "u", "same"), (6, "u", "y" * 300_000)]
    got = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    first = {}
    for i, _, h in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if i is None or first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h in rows}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").filter("false")).count() == 0


def test_inflate_cuts_records():
    rec = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (gzip.compress(rec * 3), gzip.compress(rec) * 3):
        assert list(inflate_records(io.BytesIO(data))) == [rec] * 3
    with pytest.raises(ValueError):
        list(inflate_records(io.BytesIO(gzip.compress(rec[:-2]))))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(str(list(r)) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in cur.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality_classifier", "line_dedup"]
    assert 0 < rows.select("doc_id").distinct().count() < docs.count()

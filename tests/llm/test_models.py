"""Classifiers, URL filters, search, packing and decontamination against brute force or held-out labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from apiloom.llm import queries
from apiloom.llm.decontam import block_masks, contaminated, drop_contaminated, hamming_keys
from apiloom.llm.fm import FactorizationMachine, bucket
from apiloom.llm.packing import HarmonicBins, WordCachedEncoder, pack
from apiloom.llm.quality import fit_quality, quality_scores
from apiloom.llm.topk import top_k
from apiloom.llm.toxicity import drop_toxic, fit_toxicity, held_out, toxicity_scores
from apiloom.llm.urlfilter import fit_url_model, host_and_path, judge_urls, matched_rule, rule_labelled

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    y = np.asarray(labels, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize(("query", "label"), [(queries.op1_toxicity, "toxic"), (queries.op4_quality, "quality")])
def test_held_out_accuracy(spark, query, label):
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    y = [r[label] for r in rows]
    assert len(y) > 500 and auc([r.score for r in rows], y) > 0.93
    assert sum(r.predicted == r[label] for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 9), (2, "you idiot clown", 9), (3, None, 9), (4, "", 9), (None, "idiot", 9), (1, "good words here", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, 0, 0), (4, None, None)], "doc_id long, toxic int, quality int")
    for fit, score in ((fit_toxicity, toxicity_scores), (fit_quality, quality_scores)):
        got = score(docs, fit(docs, labels, F.lit(True))).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(["1", "1", "2", "3", "4", "None"])
        assert all(0 <= r.score <= 1 for r in got)
        empty = spark.createDataFrame([], docs.schema)
        assert score(empty, fit(empty, labels, F.lit(True))).count() == 0
    flat = toxicity_scores(docs, fit_toxicity(docs, labels.limit(0), F.lit(True))).select("score").distinct().collect()
    assert len(flat) == 1
    assert drop_toxic(docs, fit_toxicity(docs, labels.limit(0), F.lit(True)), 2.0).count() == 6


def test_pairs_are_learnt():
    """Two terms that are toxic only together are beyond additive weights."""
    rng = np.random.default_rng(1)
    have = rng.integers(0, 2, (600, 2)).astype(bool)
    rows, columns = np.nonzero(have)
    labels = (have[:, 0] ^ have[:, 1]).astype(float)
    model = FactorizationMachine(np.arange(2), 4)
    model.fit(rows, columns, labels, 400, 1e-6, 0.05)
    assert ((model.scores(rows, columns, 600) > 0.5) == labels).mean() == 1.0


def test_only_a_pair_tells(spark):
    """The label is that exactly one of two words stands in the text: neither tells anything by itself."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 4)))
    pool, rows, labels = [word() for _ in range(400)], [], []
    for i in range(3600):
        have = [rng.random() < 0.5, rng.random() < 0.5]
        parts = [*rng.choices(pool, k=30), *(w for w, h in zip(("zork", "quux"), have, strict=True) if h)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
        labels.append((i, int(have[0] != have[1])))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, F.col("doc_id") < 3000)
    got = toxicity_scores(docs, model).where("doc_id >= 3000").join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == r.toxic for r in got) / len(got) > 0.95


def test_a_pair_of_rare_words_tells(spark):
    """Of 5,000 words, two that one text in twenty has each: toxic together, harmless alone, no word tells anything by itself."""
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    rows, labels = [], []
    for i in range(6000):
        have = rng.choice(["a", "b", "ab", "ab"]) if rng.random() < 0.06 else ""
        words = [*rng.sample(pool, 100), *(w for w, h in (("zorkish", "a"), ("quuxian", "b")) if h in have)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(have == "ab" if have else rng.random() < 2 / 3)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, F.col("doc_id") < 4500)
    assert {bucket("w:zorkish"), bucket("w:quuxian")} <= set(model.terms.tolist())
    got = toxicity_scores(docs.where("doc_id >= 4500 and (text like '%zorkish%' or text like '%quuxian%')"), model).join(labels, "doc_id").collect()
    assert len(got) > 60 and sum((r.score >= 0.5) == r.toxic for r in got) / len(got) >= 0.9


def test_margins_equal_pairwise_sums():
    model = FactorizationMachine(np.array([3, 5, 9]), 2)
    model.weights, model.bias = np.array([0.5, -1.0, 2.0]), 0.25
    columns = model.columns(np.array([9, 4, 3]))
    got = model.margins(np.zeros(2, int), columns, 1)[0][0]
    assert math.isclose(got, 0.25 + 2.5 + float(model.factors[0] @ model.factors[2]))


def test_held_out_rule(spark):
    got = spark.range(50).select("id", held_out(3, 1, "id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, ""), (9003, "  two  spaces \n x "), (9004, "a<|endoftext|>b"), (9005, " lead"), (9006, "tab\t x\u00a0y  "), (9007, "don't we'll"), (9008, "long " * 3000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = pack(docs, 1024).collect()
    of = defaultdict(list)
    bins = defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        bins[p.sequence_id].append(p)
    for doc_id, text in texts.items():
        ids = [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 0]
        start = 0
        for p in sorted(of[doc_id], key=lambda p: p.start):
            assert p.start == start and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[start : start + p.length], "<u4").tobytes())
            start += p.length
        assert start == len(ids)
    for parts in bins.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert sum(sum(p.length for p in parts) < 1024 for parts in bins.values()) <= 3 * 10
    assert len(pieces) < 2 * sum(-(-of[d][0].doc_tokens // 1024) for d in texts)
    clash = docs.selectExpr("doc_id", "text", "1 as start", "'x' as ids", "2 as length").unionByName(spark.createDataFrame([(None, "a b c"), (None, "a b c")], docs.schema), allowMissingColumns=True)
    rows = pack(clash, 1024, with_ids=True).where("doc_id is null").groupBy("start").count().collect()
    assert sum(r["count"] for r in rows) >= 2
    assert pack(docs.limit(0)).count() == 0


def test_bins_take_as_many_tails_as_their_class_says():
    rng = random.Random(3)
    for capacity in (1, 64, 1000, 1024):
        bins, sizes = HarmonicBins(capacity), [rng.choice([1, 2, 5, rng.randint(1, 80), rng.randint(80, 700), rng.randint(700, 4000)]) for _ in range(600)]
        full = [b for i, n in enumerate(sizes) for b in bins.add(i, np.arange(n, dtype="<u4").tobytes())]
        assert all(sum(len(p[2]) for p in b) == 4 * capacity for b in full)
        rest = list(bins.rest())
        lengths = [sum(len(p[2]) for p in b) // 4 for b in rest]
        assert sum(n < capacity for n in lengths) <= capacity.bit_length() and all(n == capacity or n & (n - 1) == 0 for n in lengths)
        got = defaultdict(list)
        for b in [*full, *rest]:
            for d, start, ids, total in b:
                assert total == sizes[d]
                got[d].append((start, *np.frombuffer(ids, "<u4").tolist()))
        assert all([x for p in sorted(got[d]) for x in p[1:]] == list(range(n)) for d, n in enumerate(sizes))
    bins = HarmonicBins(1024)
    tails = [list(bins.add(i, bytes(4 * 300))) for i in range(3)] + [list(bins.add(3, bytes(4 * 200)))]
    assert [len(p[2]) // 4 for p in tails[3][0]] == [300, 300, 300, 124]


def test_ids_equal_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), WordCachedEncoder(), random.Random(11)
    alphabet = list("abcdeXYZ012.,!?'-_\"()/:  \n\t\r") + ["  ", "\n\n", "é", "ß", "漢字", "\u00a0", "\u2003", "\u3000", "\u200b", "😀", "'s", "'ll", " the", " and", "123", "\x1c", "\x85"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def brute_top(rows, k=5, every=50):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, a) in enumerate(good):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), p) for row, (p, b) in enumerate(good) if row != own and len(a) == len(b))[:k]
            out += [(q, n + 1, p, -s) for n, (s, p) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("size", "rows_of"), [(4096, 1 << 18), (16, 3)])
def test_top_k_equals_brute_force(spark, size, rows_of):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 480)] + [(500, [0.0] * 6), (550, [1.0] * 4), (551, [2.0] * 4), (600, None), (601, [None] * 6), (602, [math.nan] * 6), (603, [math.inf] * 6), (None, rows[3][1]), (100, rows[100][1]), (650, [])]
    # Rows that repeat, under a query's id and another, with the same vector and with others.
    rows += [(7, [9.0] * 6)] * 7 + [(150, rows[150][1])] * 2 + [(200, [3.0, -4.0, 0.0, 1.0, 2.0, 5.0]), (9, rows[10][1]), (9, rows[9][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = top_k(frame, bucket_rows=size, query_rows=rows_of)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert top_k(frame.limit(0)).count() == 0
    few = top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, few.collect())) == brute_top(rows[:3])
    long = [(i, [float(i % 7)] * 20_000) for i in range(48, 53)]
    assert sorted(map(tuple, top_k(spark.createDataFrame(long, "vec_id long, embedding array<float>"), bucket_rows=2).collect())) == brute_top(long)


def test_urls(spark):
    urls = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://example.net/de", "example.net", "/de", "net/", "block"), ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("http://y.org/fr/1", "y.org", "/fr/1", "org/fr/", "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://internet", "internet", "", None, None), ("no scheme", "", "", None, None),
        ("", "", "", None, None), (None, "", "", None, None), ("x://h?a=://b/c", "h", "", None, None), ("http://ÄB.net#x", "Äb.net", "", None, None),
    ]
    frame = spark.createDataFrame([(i, u[0], "html") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge_urls(frame, None).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")
    host, path = host_and_path(F.col("url"))
    assert frame.select(*matched_rule(host, path)).count() == len(urls)
    assert judge_urls(frame.limit(0), None).count() == 0
    again = spark.createDataFrame([(None, urls[0][0]), (None, urls[0][0]), (7, None), (7, None)], "page_id long, url string")
    assert [(r.page_id, r.host, r.verdict) for r in judge_urls(again, None).orderBy("page_id").collect()] == [(None, "a.example.net", "allow")] * 2 + [(7, "", "allow")] * 2


def test_url_model_learns(spark):
    rows = [(f"http://{'casino' if i % 2 else 'library'}{i}.com/{'win' if i % 2 else 'book'}/{i}", i % 2) for i in range(200)]
    model = fit_url_model(spark.createDataFrame(rows, "url string, blocked int"))
    pages = spark.createDataFrame([(1, "http://newcasino.com/win"), (2, "http://thelibrary.com/book")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, model).collect()} == {1: "block", 2: "allow"}
    assert fit_url_model(spark.createDataFrame(rows[:1], "url string, blocked int")) is None
    assert rule_labelled(pages).count() == 0


def brute_similarity(text, item, k=5):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w, i = words(text), words(item)
    k = min(k, len(i))
    shingles = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
    target, best = shingles(i), 0.0
    for at in range(max(0, len(w) - len(i)) + 1):
        s = shingles(w[at : at + len(i)])
        if s:
            best = max(best, sum((s & target).values()) / sum((s | target).values()))
    return best


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 50)))) for i in range(12)] + [(90, "two words"), (91, ""), (92, None), (93, "x y x y x y x y x y x y x y")]
    docs = [(0, None), (1, ""), (2, "!!!"), (3, "has Two  WORDS, inside"), (4, "x y " * 30)]
    for d in range(5, 90):
        parts = rng.choice(items[:12])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 9])):
            at = rng.randrange(len(parts))
            parts[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        text = " ".join([*(word() for _ in range(rng.randint(0, 40))), *parts, *(word() for _ in range(rng.randint(0, 40)))])
        docs.append((d, text.upper() if d % 3 else text.replace(" ", ",  ")))
    docs += [(6, docs[6][1]), (None, docs[7][1])]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert len(found) == len(got)
    for d, t in docs:
        for i, item in items:
            if item:
                s = brute_similarity(t, item)
                assert ((d, i) in found) == (s >= 0.8), (d, i, s)
                if s >= 0.8:
                    assert math.isclose(found[d, i], s)
    clean = drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == 0


def test_learned_verdicts_on_held_out_pages(spark):
    """The model agrees with the rules on pages that a rule decides and that it has not seen."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = fit_url_model(rule_labelled(pages.where(~held)))
    got = judge_urls(pages.where(held), model).where("rule is not null").select(((F.col("score") >= 0.5) == (F.col("verdict") == "block")).alias("right")).collect()
    assert len(got) > 100 and sum(r.right for r in got) / len(got) > 0.9


def test_decontamination_of_nothing_and_of_long_texts(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert contaminated(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    filler = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, f"{filler} One two, three four five six seven {filler}"), (2, filler)]
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in got] == [(1, 1, 60_000, 1.0)]


def test_keys_meet_within_the_radius_and_rarely_beyond(spark):
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near, far = [], []
    for _ in range(200):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), 19):
            b ^= 1 << bit
        near.append((signed(a), signed(b)))
        far.append((signed(a), signed(rng.getrandbits(64))))
    assert len(block_masks(3)) == 697
    met = lambda rows: spark.createDataFrame(rows, "a long, b long").where(F.arrays_overlap(hamming_keys(F.col("a"), 1), hamming_keys(F.col("b"), 3))).count()
    assert met(near) == 200 and met(far) < 60


def test_ties_of_a_contaminated_window(spark):
    """Of equally similar places of an item the first is told."""
    item = "one two three four five six seven eight"
    got = contaminated(spark.createDataFrame([(1, f"x {item} y y {item}")], "doc_id long, text string"), spark.createDataFrame([(5, item), (6, item)], "item_id long, text string"))
    assert sorted((r.item_id, r.start, r.similarity) for r in got.collect()) == [(5, 1, 1.0), (6, 1, 1.0)]

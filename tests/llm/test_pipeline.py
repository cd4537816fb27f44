"""The stages of the corpus pipeline, one after another, against what each promises."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from apiloom.llm import nearcopies
from apiloom.llm.common import read_table, written
from apiloom.llm.decontam import contaminated
from apiloom.llm.nearcopies import near_copies, shared_elements
from apiloom.llm.queries import op1_toxicity
from apiloom.llm.simhash import within
from tests.llm.test_dedup import brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    toxic = {r.doc_id for r in op1_toxicity(spark, SF).where("predicted = 1").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns, name
            kept[k] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept[0]) == set(before) - toxic
    assert set(kept[1]) == set(kept[0])
    lines = [tuple(t.split("\n")[i : i + 3]) for t in kept[1].values() for i in range(len(t.split("\n")) - 2)]
    assert sum(len(t) for t in kept[1].values()) < sum(len(t) for t in kept[0].values())
    assert len(lines) - len(set(lines)) < 0.02 * len(lines)
    assert set(kept[2]) < set(kept[1]) and all(kept[2][d] == kept[1][d] for d in kept[2])
    left = spark.createDataFrame(list(kept[2].items()), "doc_id long, text string")
    bad = {r.doc_id for r in contaminated(left, read_table(spark, SF, "benchmark", "item_id", "text")).collect()}
    assert bad and set(kept[3]) == set(kept[2]) - bad
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(kept[3])
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_near_dedup_equals_brute_force(spark):
    """Near copies whose fingerprints differ in more than four bits go as well, and nothing below the similarity."""
    docs = read_table(spark, SF, "documents")
    texts = [r.text for r in docs.where("n_chars between 400 and 2000").orderBy("doc_id").limit(12).collect()]
    rng = random.Random(3)
    made = []
    for k, text in enumerate(texts):
        for copy in range(4):
            w = text.split()
            for _ in range(copy * len(w) // 100):
                w[rng.randrange(len(w))] = f"changed{rng.random()}"
            made.append((10_000_000 + 10 * k + copy, " ".join(w), "en", "s", len(text)))
    docs = written(docs.unionByName(spark.createDataFrame(made, docs.schema)))
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in rows}
    ids, having, label = sorted(sets), defaultdict(list), {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    far = 0
    for d in ids:
        both = Counter(o for s in sets[d] for o in having[s])
        for other, n in both.items():
            if n >= 0.8 * len(sets[d] | sets[other]):
                a, b = root(d), root(other)
                label[max(a, b)] = min(a, b)
                far += (brute_fingerprint(" ".join(x.decode() for x in dict(rows)[d])) ^ brute_fingerprint(" ".join(x.decode() for x in dict(rows)[other]))).bit_count() > 4
        for s in sets[d]:
            having[s].append(d)
    want = {d for d in ids if root(d) == d}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert far > 10 and len(want) < len(ids) and kept == want


def test_near_copies_of_long_texts_in_small_blocks(spark, monkeypatch):
    """Texts of 20,000 words, more of them in a shard than a block may hold, beside short and empty ones."""
    monkeypatch.setattr("apiloom.llm.nearcopies.BLOCK_SHINGLES", 30_000)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**9)}" for _ in range(20_000)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:10_000] + ["new"] + base[10_000:]))]
    rows += [(i, " ".join(base[: 20_000 - 30 * i])) for i in range(2, 10)]
    rows += [(20, " ".join(base[10_000:])), (21, ""), (22, None), (23, "a b"), (24, "a b"), (25, "a c")]
    got = dict(map(tuple, near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == {**dict.fromkeys(range(10), 0), 20: 20, 21: 21, 22: 21, 23: 23, 24: 23, 25: 25}


def test_shared_elements():
    rng = np.random.default_rng(4)
    for a, b in ((0, 0), (0, 5), (1, 1), (40, 7), (300, 300)):
        x, y = (np.unique(rng.integers(0, 60, n).astype(np.uint64) << np.uint64(58)) if n < 300 else np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (a, b))
        assert shared_elements(x, y) == shared_elements(y, x) == len(set(x.tolist()) & set(y.tolist()))


def test_an_empty_corpus_passes(spark, tmp_path):
    docs = read_table(spark, SF, "documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0


def test_odd_rows_pass(spark, tmp_path):
    docs = read_table(spark, SF, "documents").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (7001, None, "en", None, 0), (7002, "", None, "s", 0), (7002, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("n_lines", F.lit(3))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


def test_near_copies_come_from_trees_of_fingerprints(monkeypatch):
    """Trees of several shards tell all pairs within the radius, and what they do not tell is not compared."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 62, 6, dtype=np.int64).astype(np.uint64).repeat(9) ^ np.uint64(1) << rng.integers(0, 64, 54).astype(np.uint64)
    group = np.sort(rng.integers(0, 4, 54))
    found = {(int(a), int(b)) for query, node in within(fps, group, 24) for a, b in zip(query, node, strict=True)}
    assert found == {(a, b) for a in range(54) for b in range(54) if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= 24}
    sets = [np.arange(200, dtype=np.uint64), np.arange(10, 210, dtype=np.uint64), np.arange(200, dtype=np.uint64)]
    prints, shards = np.array(list(map(nearcopies.simhash, sets)), np.uint64), np.array([0, 0, 1])
    assert nearcopies.linked_sets(sets, prints, shards, 0.8, 24).tolist() == [0, 0, 2]
    monkeypatch.setattr(nearcopies, "within", lambda fp, group, radius: iter(()))
    assert nearcopies.linked_sets(sets, prints, shards, 0.8, 24).tolist() == [0, 1, 2]


def test_near_copies_that_bands_and_trees_do_not_meet(spark):
    """Pairs of similarity 0.8: one shares no band of minima, the fingerprints of one differ in 34 bits."""
    short = [f"v11086n{j}" for j in range(9)]
    long = [f"a{i}" for i in range(84)]
    more = "b344 b95 b21 b120 b74 b2 b26 b214 b87 b93 b378 b364 b24 b29 b233 b113 b113 b49 b222 b290".split()
    texts = [" ".join(w) for w in (short[:8], short, long, long + more, long[:40] + more, short[4:] + long[:4])]
    sets = [nearcopies.shingle_set(t, 5) for t in texts[:4]]
    assert not set(nearcopies.band_keys(sets[0])) & set(nearcopies.band_keys(sets[1]))
    assert (nearcopies.simhash(sets[2]) ^ nearcopies.simhash(sets[3])).bit_count() > 24
    docs = spark.createDataFrame([*enumerate(texts), (6, texts[1]), (7, ""), (8, None)], "doc_id long, text string").repartition(3)
    assert dict(map(tuple, near_copies(docs).collect())) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 0, 7: 7, 8: 7}


def test_classes_known_before_are_linked_exactly():
    """Random sets of several shards against all pairs told plainly; classes known before are kept and not linked to those of other shards."""
    rng = np.random.default_rng(6)
    bases = [rng.permutation(40)[:20] for _ in range(4)]
    sets = [np.unique(np.where(rng.random(20) < 0.9, bases[rng.integers(0, 4)], rng.integers(0, 60, 20))).astype(np.uint64) for _ in range(60)]
    group, classes = np.sort(rng.integers(0, 3, 60)), rng.integers(0, 40, 60)
    want = np.arange(60)
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                both = len(set(sets[i]) & set(sets[j]))
                if group[i] == group[j] and (classes[i] == classes[j] or both >= 0.6 * len(set(sets[i]) | set(sets[j]))):
                    want[i] = want[j] = min(want[i], want[j])
    assert len(set(want)) < len(set(zip(group.tolist(), classes.tolist(), strict=True)))
    assert nearcopies.linked_exactly(sets, classes, group, 0.6).tolist() == want.tolist()

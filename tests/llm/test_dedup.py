"""Deduplication operators against brute force."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from apiloom.llm.components import connected_components
from apiloom.llm.linededup import dedup_lines
from apiloom.llm.paragraphs import Paragraphs, WordHashes, hashed_texts, hashed_words, paragraph_clusters, repeated_paragraphs
from apiloom.llm.queries import op3_paragraph_dedup
from apiloom.llm.simhash import drop_near_duplicates, linked_within, near_duplicates
from apiloom.llm.suffixes import drop_repeats, segments

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    shared = [words(rng, 60) for _ in range(4)]
    docs = [None, "", " ", "é" * 150, "ab" * 300, "ab" * 301, "x" * 199, "y" * 200, "y" * 200]
    for _ in range(n):
        parts = [words(rng, rng.randint(5, 120)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        docs.append(rng.choice([" ", "\n", ". "]).join(parts))
    for _ in range(15):
        text = rng.choice(docs[9:])
        at = rng.randint(0, len(text))
        docs.append(rng.choice([text, text[:at] + rng.choice(["Q", "", "longer insert "]) + text[at + 1 :]]))
    rows = list(enumerate(docs))
    return [*rows, (3, "é" * 150), (None, docs[20]), (None, None)]


def brute_repeats(rows, length=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_equal_brute_force(spark, hot):
    rows = corpus()
    got = drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), 200, hot).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_repeats_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = drop_repeats(docs.repartition(5)).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_repeats_in_long_texts_and_beside_other_columns(spark, monkeypatch):
    """A segment holds 1,000 bytes here, so the long texts and the batch are cut into many; other columns have the operator's names."""
    monkeypatch.setattr("apiloom.llm.suffixes.segments", functools.partial(segments, most=1000))
    rng = random.Random(3)
    passage = words(rng, 300)
    rows = [(0, words(rng, 3000) + passage + words(rng, 2000)), (1, passage[100:1900] + words(rng, 40)), (2, "ab" * 2500), (3, None), (4, "")]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", spans string, anchor int").coalesce(1)
    got = drop_repeats(frame, 200).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_segments_hold_each_start_once():
    offsets = np.array([0, 0, 5, 300, 2800, 2900, 2900, 5000])
    for most in (250, 400, 1000, 10_000):
        starts = Counter()
        for first, ends, at in segments(offsets, 200, most):
            for k in range(len(ends) - 1):
                own = offsets[first + k] + (at if k == 0 else 0)
                assert ends[k] == own
                starts.update((first + k, x) for x in range(ends[k], ends[k + 1] - 199))
        want = Counter((d, x) for d in range(7) for x in range(offsets[d], offsets[d + 1] - 199))
        assert starts == want


def test_repeats_of_nothing(spark):
    assert drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_fingerprint(text):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rows = [*corpus(), (900, "One two"), (901, "one  TWO"), (902, "É two"), (903, "é two")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_near_duplicates_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == brute_components([tuple(r) for r in docs.collect()])


def test_near_duplicates_of_nothing_and_of_long_texts(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(1)
    long = words(rng, 100_000)
    rows = [(1, long), (2, long + " end"), (3, words(rng, 50_000))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", fp int, shard string")
    assert sorted(map(tuple, near_duplicates(frame).collect())) == brute_components(rows)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e", "x"), (5, "a b c d e", "y"), (7, "z z y y x", "x"), (None, "a b c d e", "n")]
    got = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA + ", fp string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[2], rows[3]], key=repr)


def test_trees_find_all_links():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 12).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(400)], np.uint64)
    fp = np.unique(centres[rng.integers(0, 12, 400)] ^ flips)
    rng.shuffle(fp)
    group = np.sort(rng.integers(0, 5, len(fp)))
    label = linked_within(fp, group, 4)
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (group[:, None] == group[None, :])
    want = np.arange(len(fp))
    for _ in range(len(fp)):
        want = np.where(near, want[None, :], len(fp)).min(axis=1)
    assert np.array_equal(label, want)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, None), (300, 300)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    first = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        lines = t.split("\n") if t is not None else []
        for i in range(len(lines) - 2):
            first.setdefault(tuple(lines[i : i + 3]), (d, t, i))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = {i + k for i in range(len(lines) - 2) if first[tuple(lines[i : i + 3])] != (d, t, i) for k in range(3)}
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "\n\n\n\n"), (5, rows[5][1]), (None, "a\nb\nc\nd")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as n_lines", "1 as h1", "2 as first")
    got = dedup_lines(frame.repartition(3)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_of_texts_under_one_id_and_of_long_texts(spark):
    """Texts of one id come by their own order; a text of 20,000 lines is cut in time that grows with its lines."""
    rng = random.Random(12)
    rows = [(k, "\n".join([rng.choice("wxyz"), *"abcd", rng.choice("wxyz")]) + f"\n{k}") for k in range(6) for _ in range(2)]
    rows += [(50, "\n".join(f"line {i % 15_000}" for i in range(20_000))), (51, "\n".join(f"line {i}" for i in range(100)))]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def paragraphs(texts, least):
    made = [hashed_words(t, WordHashes()) for t in texts]
    return Paragraphs.of(*(np.concatenate([m[i] for m in made]) for i in (0, 1)), np.array([len(m[0]) for m in made]), least)


def cut(text, least):
    parts = (text or "").lower().split()
    found = paragraphs([text], least)
    return [(a, parts[a : a + n]) for a, n, whole in zip(found.place.tolist(), found.size.tolist(), found.whole.tolist(), strict=True) if not whole]


def test_paragraph_classes_equal_brute_force(spark):
    rng = random.Random(9)
    base = [words(rng, 30) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            parts[rng.randrange(len(parts))] = words(rng, 1)
        rows.append((i, words(rng, 20) + "\n" + " ".join(parts) + "\nshort one"))
    rows += [(500, None), (501, ""), (None, rows[0][1]), (3, rows[3][1])]
    placed = [(d, t, at, p) for d, t in dict.fromkeys(rows) for at, p in cut(t, 8)]
    sets = [{tuple(p[i : i + 5]) for i in range(len(p) - 4)} for *_, p in placed]
    label = list(range(len(placed)))
    for _ in range(len(placed)):
        before = list(label)
        for i in range(len(placed)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    sizes = Counter(label)
    want = {(d, at) for (d, _, at, _), c in zip(placed, label, strict=True) if sizes[c] > 1}
    got = paragraph_clusters(hashed_texts(spark.createDataFrame(rows, SCHEMA).repartition(3))).where("not whole or n_words <= 24").collect()
    found = {(None if r.no_id else r.doc_id, r.start) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want)
    assert len({(r.keeper.doc_id, r.keeper.start) for r in got}) == len({label[i] for i, (d, _, at, _) in enumerate(placed) if (d, at) in found})
    removed = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r.doc_id, r.start) != (r.keeper_doc_id, r.keeper_start) for r in removed)
    assert repeated_paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_shared_lines_stay_and_passages_go(spark):
    rng = random.Random(2)
    head, passage = words(rng, 12), ". ".join(words(rng, 7) for _ in range(9))
    rows = [(i, f"{head}\n{words(rng, 40)}. {passage}. {words(rng, 30)}") for i in range(6)] + [(i, f"{head}\n{words(rng, 60)}") for i in range(6, 12)]
    got = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == set(range(1, 6)) and all(r.keeper_doc_id < r.doc_id for r in got)
    short = repeated_paragraphs(spark.createDataFrame(rows, SCHEMA), least_run=0).collect()
    assert {r.doc_id for r in short} == set(range(1, 12))


def removed_words(spark, texts, **options):
    got = repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), **options).collect()
    gone = defaultdict(set)
    for r in got:
        new = set(range(r.start, r.start + r.n_words))
        assert not new & gone[r.doc_id] and max(new) < len(texts[r.doc_id].split())
        gone[r.doc_id] |= new
    return gone


def test_a_passage_inside_lines_goes_from_end_to_end(spark):
    """Sixty words without any punctuation, between other words of the same line."""
    rng = random.Random(6)
    texts, want = [], {}
    for k in range(40):
        passage = words(rng, 60)
        for copy in range(2):
            before = rng.randint(15, 40)
            texts.append(f"{words(rng, before)} {passage} {words(rng, 30)}")
            want[len(texts) - 1] = set(range(before, before + 60)) if copy else set()
    gone = removed_words(spark, texts, least_run=0)
    assert sum(gone[d] >= w for d, w in want.items() if w) >= 38 and not any(gone[d] for d, w in want.items() if not w)
    # A piece at the passage's end that is near enough to its keeper's goes whole, with a foreign word or two.
    assert all(len(gone[d] - w) <= 6 for d, w in want.items())


def test_near_copies_of_lines_go_whole(spark):
    """One word of 60 to 120 replaced leaves a similarity of 0.8 or more; the keeper stays, repeats within a text too."""
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        parts = words(rng, rng.randint(60, 120)).split()
        texts.append(words(rng, 12) + "\n" + " ".join(parts))
        parts[rng.randrange(len(parts))] = "replaced"
        texts.append(words(rng, 12) + "\n" + " ".join(parts) + "\n" + words(rng, 9))
    gone = removed_words(spark, texts, least_run=0)
    assert sum(gone[d] == set(range(12, len(texts[d].split()) - 9)) for d in range(1, 80, 2)) >= 39
    assert not any(gone[d] for d in range(0, 80, 2))
    line = words(rng, 26)
    gone = removed_words(spark, [f"{line}\n{line}\n{line} q r", "x y " + line], least_run=0)
    assert gone[0].isdisjoint(range(26)) and gone[0] >= set(range(26, 52)) and gone[1] >= set(range(2, 28))


def test_the_query_takes_passages_and_leaves_short_lines(spark, tmp_path):
    rng = random.Random(5)
    line, longer, around = words(rng, 10), words(rng, 26), lambda: words(rng, 20)
    rows = [(i, f"{around()}\n{line}\n{around()}\n{longer}") for i in range(3)]
    for i in range(3, 43):
        passage = words(rng, 51) if i % 2 else passage
        rows.append((i, f"{around()} {passage} {around()}"))
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", keeper string, start int, h1 int").write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_paragraph_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.n_words) for r in got if r.doc_id < 3) == [(1, 50, 26), (2, 50, 26)]
    gone = defaultdict(set)
    for r in got:
        gone[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    assert sum(gone[i] >= set(range(20, 71)) for i in range(4, 43, 2)) >= 19 and not any(gone[i] for i in range(3, 43, 2))


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("apiloom.llm.paragraphs.BLOCK", 3)
    rng = random.Random(7)
    base = words(rng, 60).split()
    rows = [(i, " ".join([*base[:29], words(rng, 1), *base[30:]])) for i in range(30)]
    got = paragraph_clusters(hashed_texts(spark.createDataFrame(rows, SCHEMA).repartition(3))).where("whole").collect()
    assert {r.doc_id for r in got} == set(range(30)) and {r.keeper.doc_id for r in got} == {0}


def test_paragraphs_cover_a_text():
    text = "One two. Three four! " * 40 + "\n\nlast line"
    parts = cut(text, 1)
    assert [w for _, p in parts for w in p] == text.lower().split() and parts[-1][1] == ["last", "line"] and len(parts) > 10
    batch = paragraphs(["", "a b c d e f g h", None, "x " + "a b c d e f g h"], 8)
    assert batch.text.tolist() == [1, 3] and len({tuple(c) for c in batch.contents().tolist()}) == 2
    twice = paragraphs(["q\na b c d e f g h", "a b c d e f g h\nz", "b a c d e f g h"], 8)
    assert len({tuple(c) for c in twice.contents().tolist()}) == 2 and twice.place.tolist() == [1, 0, 0]


def test_passages_have_one_least_length_however_laid_out(spark):
    """Equal runs of 20 to 60 words, on a line of their own, on two lines, or within a longer line."""
    rng = random.Random(12)
    docs, asked = [], {}
    for n in (20, 24, 25, 39, 40, 60):
        for layout in ("line", "lines", "inside"):
            run = words(rng, n).split()
            for copy in (0, 1):
                a, b = words(rng, 30), words(rng, 30)
                text = {"line": f"{a}\n{' '.join(run)}\n{b}", "lines": f"{a}\n{' '.join(run[: n // 2])}\n{' '.join(run[n // 2 :])}\n{b}", "inside": f"{a} {' '.join(run)} {b}"}[layout]
                asked[len(docs)] = (n, layout, copy)
                docs.append((len(docs), text))
    gone = Counter()
    for r in repeated_paragraphs(spark.createDataFrame(docs, SCHEMA)).collect():
        gone[r.doc_id] += r.n_words
    for doc, (n, layout, copy) in asked.items():
        if not copy or n < 25:
            assert not gone[doc], (n, layout)
        elif layout != "inside":
            assert gone[doc] >= 0.9 * n, (n, layout)
        elif n == 60:
            assert gone[doc] >= 0.8 * n, (n, layout)

"""Lexical search, centroid clustering and page differencing against brute force."""

import hashlib
import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from apiloom.llm import pagediff
from apiloom.llm.centroids import cluster_vectors, loosening
from apiloom.llm.lexical import search
from apiloom.llm.pagediff import ARTICLE, FURNITURE, TEXT, common_lines, decided, extract_text, page_lines

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, all_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def texts(rng, n, most=60, vocabulary=300):
    return [" ".join(f"{rng.choice('abÉ')}{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("owners", [(256, 64, 16, 4), ()])
def test_search_is_that_of_brute_force(spark, owners):
    rng = random.Random(5)
    docs = [*enumerate(texts(rng, 150)), (7, "A1 a1 B2, É3"), (7, "A1 a1 B2, É3"), (None, "a1 b2"), (None, "a1 b2"), (900, None), (901, ""), (902, " .,-"), (903, "a1 " * 30_000 + "b2 x_y 12")]
    docs += [(1000 + i, docs[11][1]) for i in range(25)]  # more equal scores than ranks
    items = [*enumerate(texts(rng, 30, 25)), (3, "a1 b2"), (None, "a1 b2 é3"), (77, None), (78, ""), (79, "nowhere"), (80, docs[11][1])]
    found = search(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"), owners=owners, block_postings=400, group_items=8)
    assert Counter(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(none, some).count() == 0
    assert search(some.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_later_owners_meet_only_what_can_still_lead(spark):
    """Ten texts hold an item's rare terms, all hold its common one: none of the others stays in its bundle."""
    rows = [(i, f"common w{i} " + ("rare0 rare1 rare2" if i < 10 else "filler")) for i in range(3000)]
    seen = {}
    found = search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "common rare0 rare1 rare2")], "item_id long, text string"), report=seen.__setitem__)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(10)) and max(seen.values()) <= 10


def brute_clusters(rows, k=8, rounds=10, size=64, scale=1024, seed=3):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    code = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z"
    centroids = [v for _, v in sorted(kept, key=lambda r: (code(r[0]), r[1]))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (d(v, centroids[c]), c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[nearest(v)].append(v)
        centroids = [[sum(x) // len(of[c]) for x in zip(*of[c], strict=True)] if of[c] else old for c, old in enumerate(centroids)]
    found = [(i, nearest(v), v) for i, v in kept]
    inertia = Counter()
    for _, c, v in found:
        inertia[c] += d(v, centroids[c])
    return Counter((i, c, d(v, centroids[c]), inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, v in found)


def vectors(rng, n, size, spread=0.2):
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    return [[float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize(("size", "spread", "scale"), [(64, 0.2, 1024), (2, 0.5, 1024), (2, 2.0, 3)])  # the last has many ties
def test_clusters_are_those_of_exhaustive_rounds(spark, size, spread, scale):
    rng = random.Random(size)
    rows = [*enumerate(vectors(rng, 400, size, spread))]
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[7][1]), (600, None), (601, []), (602, [1.0] * (size + 1)), (603, [None] + [1.0] * (size - 1)), (604, [math.nan] * size), (605, [math.inf] * size)]
    rows += [(700 + i, rows[0][1]) for i in range(200)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    found = cluster_vectors(table, size=size, scale=scale).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert Counter(map(tuple, found.collect())) == brute_clusters(rows, size=size, scale=scale)


def test_clusters_of_few_or_no_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.5]), (4, [1e30, 0.0])]  # beyond 64-bit distances
    found = cluster_vectors(spark.createDataFrame(few, "vec_id long, embedding array<double>"), size=2)
    assert Counter(map(tuple, found.collect())) == brute_clusters(few[:3], size=2)
    assert cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_prove_most_assignments_of_far_clusters(spark):
    seen = {}
    cluster_vectors(spark.createDataFrame(enumerate(vectors(random.Random(2), 2000, 64)), "vec_id long, embedding array<float>"), report=seen.__setitem__)
    assert seen[0] == 2000 and seen[max(seen)] < 1000


def test_loosening_holds_and_is_less_than_the_way():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(200):
        old = rng.normal(size=(4, 3))
        new, radius = old + rng.normal(size=(4, 3)) * rng.choice([0.1, 1]), rng.uniform(0, 2, 4)
        bound = loosening(old, new, radius)
        way = np.linalg.norm(new - old, axis=1)
        for a in range(4):
            x = rng.normal(size=(500, 3))
            x = old[a] + x / np.linalg.norm(x, axis=1)[:, None] * radius[a] * rng.uniform(0, 1, 500)[:, None] ** 0.2
            others = [j for j in range(4) if j != a]
            nearer = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            assert nearer <= bound[a] + 1e-9 and bound[a] <= max(way[j] for j in others) * (1 + 1e-6)
            less += bound[a] < 0.9 * max(way[j] for j in others)
    assert less > 200


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("at_once", [1 << 28, 20])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, at_once):
    monkeypatch.setattr(pagediff, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(3)
    for _ in range(800):
        a, b = ([rng.randint(0, rng.choice([1, 3, 8])) for _ in range(rng.randint(0, 14))] for _ in range(2))
        places, rest = common_lines(a, b), iter(b)
        assert len(places) == longest_common(a, b) and places == sorted(set(places)) and all(a[i] in rest for i in places)


def test_page_lines():
    kinds = lambda page: [(kind, text) for kind, _, text in page_lines(page)]
    assert kinds(None) == kinds("") == kinds("<p> <br>") == []
    assert kinds("a <b>b</b>c\n d<br>e &amp;lt; &nbsp; &#233;") == [(TEXT, "a bc d"), (TEXT, "e &lt; é")]
    assert kinds("<head><title>t</title><script>var t='</p>';</script><body><nav>n</nav><p>x<style>p{}</style>y<!-- <p>no --></p>") == [(FURNITURE, "n"), (TEXT, "xy")]
    page = "<body class='has-sidebar'><header>h</header><article class=post><header><h1>T</h1></header><p>one<div class='ad top'>buy</div><p>two<section id=comments><p>me too</section></article><p>rest"
    assert kinds(page) == [(FURNITURE, "h"), (ARTICLE, "T"), (ARTICLE, "one"), (FURNITURE, "buy"), (ARTICLE, "two"), (FURNITURE, "me too"), (TEXT, "rest")]
    assert kinds("<main><p>m</p></main><article class='comment'>c</article><div role=alert>r</div>1 < 2 <3 <") == [(pagediff.MAIN, "m"), (FURNITURE, "c"), (FURNITURE, "r"), (TEXT, "1 < 2 <3 <")]
    for odd in ("<a " * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<div><p>x" * 50_000, "<script>" * 50_000, '<a "' * 50_001, "<!-- " * 50_000):
        page_lines(odd)


def page(menu, body, article=True):
    inner = "".join(f"<p>{html.escape(b)}</p>\n" for b in body)
    return f"<html><head><title>no</title></head><body><ul class=menu>{''.join(f'<li>{m}' for m in menu)}</ul>{'<article>' + inner + '</article>' if article else inner}<p>All rights reserved</p><footer>f</footer>"


def test_shared_lines_go_and_articles_stay(spark):
    rows = [(i, f"http://h.example/{'ab'[i % 2]}/{i:04d}", page(["x", str(i)], [f"story {i} & more", "The."], False)) for i in range(30)]
    rows += [(100 + i, f"http://n.example/{i}", page(["m"], [f"news {i}", "The."])) for i in range(5)]
    rows += [(200 + i, f"http://c.example/{i}", page(["m"], ["same story", "The."], False)) for i in range(9)]  # copies have no other neighbour
    rows += [(300, "http://alone.example/", page([], ["alone"], False)), (301, None, page([], ["no url"], False)), (302, "", None), (None, "http://h.example/a/0001", ""), (303, "http://l.example/", "<p>" + "w " * 200_000), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = defaultdict(set)
    got = extract_text(table).collect()
    for r in got:
        found[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(found[i] == {f"story {i} & more"} for i in range(30)) and all(found[100 + i] == {f"news {i} The."} for i in range(5))
    assert all(found[200 + i] == {"same story The. All rights reserved"} for i in range(9))
    assert found[300] == {"alone All rights reserved"} and found[301] == {"no url All rights reserved"} and found[302] == found[None] == {""}
    assert found[303] == {" ".join(["w"] * 200_000)}
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_differencing_is_that_of_brute_force(spark):
    """Against neighbours, alignment and deletion told plainly, over pages that share and change lines at random."""
    rng = random.Random(8)
    lines = [f"line {i}" for i in range(40)]
    rows = [(i, f"http://{rng.choice('pq')}.example/{rng.randint(0, 60)}/{i}", "".join(f"<p>{t}</p>" for t in rng.choices(lines, k=rng.randint(1, 25)))) for i in range(120)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hosts = defaultdict(list)
    for i, url, text in rows:
        _, _, host, path = url.split("/", 3)
        hosts[host].append(("/" + path, i, re.findall("<p>(.*?)</p>", text)))
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for pages in hosts.values():
        pages.sort()
        for n, (path, i, own) in enumerate(pages):
            mates = sorted((pages[j] for j in (n - 1, n + 1) if 0 <= j < len(pages)), key=lambda p: (-same(path, p[0]), p[0] > path))
            kept = own
            for _, _, other in mates:
                gone = set(common_lines([hash(x) for x in own], [hash(x) for x in other]))
                assert len(gone) == longest_common(own, other)
                if len(gone) <= 0.8 * len(own):
                    kept = [x for at, x in enumerate(own) if at not in gone]
                    break
            assert got[i] == " ".join(kept)


def test_decided_takes_the_first_mate_that_is_no_copy():
    kinds = np.array([TEXT, TEXT, TEXT, FURNITURE], np.uint8)
    assert decided(kinds, [1, 2, 3, 9], [[1, 2, 3, 9], [1, 5, 9]]) == (2, 0, [True, False, False])
    assert decided(kinds, [1, 2, 3, 9], [[1, 2, 3, 9]]) == (1, 0, None)
    assert decided(kinds, [1, 2, 3, 9], []) == (0, 1, None)

"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.centroids import cluster_vectors, clustering_sql
from apiloom.llm.common import read_table
from apiloom.llm.decontam import contaminated
from apiloom.llm.lexical import SEARCH_SQL, search
from apiloom.llm.linededup import dedup_lines
from apiloom.llm.packing import pack
from apiloom.llm.pagediff import extract_text
from apiloom.llm.paragraphs import repeated_paragraphs
from apiloom.llm.quality import fit_quality, quality_scores
from apiloom.llm.simhash import near_duplicates
from apiloom.llm.suffixes import drop_repeats
from apiloom.llm.topk import top_k
from apiloom.llm.toxicity import fit_toxicity, held_out, toxicity_scores
from apiloom.llm.urlfilter import fit_url_model, host_and_path, judge_urls, matched_rule, rule_labelled


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = fit_toxicity(docs, labels, ~held_out(3, 1))
    return toxicity_scores(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), capacity=1024)


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(documents(spark, sf_dir), words=5, similarity=0.8)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = fit_quality(docs, labels, ~held_out(5, 0))
    return quality_scores(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir), length=200).drop("kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, radius=4)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=5, every=50, scale=256)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir), lines=3).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    return judge_urls(pages, fit_url_model(rule_labelled(pages)))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every page; the verdict is null where none fits and operator 9's model decides."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    host, path = host_and_path(F.col("url"))
    rule, verdict = matched_rule(host, path)
    return pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"), words=5, similarity=0.8).select("doc_id", "item_id", "start", "similarity")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"), k=10)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=8, rounds=10, size=64, scale=1024, seed=3)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_packing, op3_paragraph_dedup, op4_quality, op5_suffix_dedup, op6_simhash, op7_topk, op8_line_dedup, op9_url_filter, op10_decontaminate, op11_lexical_search, op12_centroids, op13_main_text, url_rules)
}

ORACLE_SQL: dict[str, str] = {
    "url_rules": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, row_number() OVER () AS row_no, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
                     translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
        r(verdict, site, begins) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (SELECT row_no, arg_max(site || begins, length(site || begins)) AS rule, arg_max(verdict, length(site || begins)) AS verdict
              FROM h JOIN r ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, begins) GROUP BY row_no)
        SELECT page_id, host, path, rule, verdict FROM h LEFT JOIN m USING (row_no)""",
    "op11_lexical_search": SEARCH_SQL,
    "op12_centroids": clustering_sql(),
    # What stands between the article's tags; differencing is beyond SQL and tested against brute force.
    "op13_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
        c AS (SELECT page_id, url, replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS t FROM b),
        d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
    "op5_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        -- Pieces of 1,000 starts, so that no long text is cut 200 bytes at a time.
        p AS (SELECT row_no, a, substr(h, 2 * a + 1, 2398) AS piece FROM (SELECT row_no, h, unnest(range(0, length(h) // 2 - 199, 1000)) AS a FROM d)),
        s AS (SELECT row_no, a + i AS start, md5_number(substr(piece, 2 * i + 1, 400)) AS string
              FROM (SELECT row_no, a, piece, unnest(range(0, least(1000, length(piece) // 2 - 199))) AS i FROM p)),
        again AS (SELECT string FROM s GROUP BY string HAVING count(*) > 1),
        c AS (SELECT row_no, start, lag(start) OVER (PARTITION BY row_no ORDER BY start) AS before FROM s JOIN again USING (string)),
        g AS (SELECT row_no, start, sum(CASE WHEN before IS NULL OR start > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY row_no ORDER BY start) AS run FROM c),
        spans AS (SELECT row_no, min(start) AS a, max(start) + 200 AS b FROM g GROUP BY row_no, run),
        gone AS (SELECT row_no, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e FROM spans GROUP BY row_no),
        k AS (SELECT doc_id, h, s, e,
                     CASE WHEN s IS NULL THEN h ELSE list_aggregate(list_transform(range(0, len(s) + 1), lambda i:
                         substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * e[i] + 1 END,
                                CASE WHEN i = len(s) THEN length(h) ELSE 2 * s[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE 2 * e[i] END)), 'string_agg', '') END AS kept
              FROM d LEFT JOIN gone USING (row_no))
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(kept)) // 2 AS BIGINT) AS n_removed,
               CAST(coalesce(len(s), 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k""",
    "op7_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.row_no, q.vec_id AS query_id, p.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v p ON q.vec_id % 50 = 0 AND q.row_no <> p.row_no AND len(q.v) = len(p.v) AND len(q.v) > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_line_dedup": """
        WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        w AS (SELECT doc_id, text, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3),
        k AS (SELECT *, row_number() OVER (PARTITION BY lines[pos + 1], lines[pos + 2], lines[pos + 3]
                                           ORDER BY doc_id, text, pos) AS nth FROM w),
        c AS (SELECT doc_id, text, list_distinct(flatten(list(range(pos, pos + 3)))) AS cover FROM k WHERE nth > 1 GROUP BY ALL)
        SELECT o.doc_id, CAST(coalesce(len(string_split(o.text, chr(10))), 0) AS BIGINT) AS n_lines,
               CAST(coalesce(len(c.cover), 0) AS BIGINT) AS n_removed,
               md5(CASE WHEN c.cover IS NULL THEN o.text ELSE
                   array_to_string(list_transform(list_filter(range(0, len(string_split(o.text, chr(10)))),
                                                              lambda i: NOT list_contains(c.cover, i)),
                                                  lambda i: string_split(o.text, chr(10))[i + 1]), chr(10)) END) AS kept_md5
        FROM documents o LEFT JOIN c ON o.doc_id = c.doc_id AND o.text = c.text""",
    "op10_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS dk, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
        i AS (SELECT row_number() OVER () AS ik, item_id, w, len(w) AS size, least(len(w), 5) AS k
              FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
        ds AS (SELECT dk, k, n, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS s
               FROM (SELECT dk, k, w, len(w) AS n, unnest(range(0, len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
        iw AS (SELECT ik, k, size, place, array_to_string(w[place + 1 : place + k], ' ') AS s FROM (SELECT *, unnest(range(0, size - k + 1)) AS place FROM i)),
        b AS (SELECT DISTINCT dk, ik, ds.k, size, n, greatest(0, least(pos - place, n - size)) AS start FROM ds JOIN iw ON ds.s = iw.s AND ds.k = iw.k),
        wc AS (SELECT b.dk, b.ik, b.start, ds.s, count(*) AS c FROM b JOIN ds ON ds.dk = b.dk AND ds.k = b.k AND ds.pos BETWEEN b.start AND b.start + b.size - b.k GROUP BY ALL),
        ic AS (SELECT ik, s, count(*) AS c FROM iw GROUP BY ALL),
        sh AS (SELECT wc.dk, wc.ik, wc.start, sum(least(wc.c, ic.c)) AS shared FROM wc JOIN ic ON wc.ik = ic.ik AND wc.s = ic.s GROUP BY ALL),
        j AS (SELECT dk, ik, start, CAST(shared AS DOUBLE) / (least(size, n) - k + 1 + size - k + 1 - shared) AS similarity FROM sh JOIN b USING (dk, ik, start)),
        r AS (SELECT *, row_number() OVER (PARTITION BY dk, ik ORDER BY similarity DESC, start) AS nth FROM j WHERE similarity >= 0.8)
        SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, similarity FROM r JOIN d USING (dk) JOIN i USING (ik) WHERE nth = 1""",
}

"""Main text of web pages by differencing each page with the page of the nearest URL of its host.

A page is cut into lines, one for each block of its markup. Pages of a host are put in the order of their paths, each
is paired with the neighbour whose path begins most like its own, both pages' lines are aligned by their longest common
subsequence, and the shared lines go. Words of a menu or an advert differ from page to page while their place in the
template does not, so a line of such a part is keyed by its place, every other line by its words.

Differencing alone is not right in two ways, and the markup decides there: a line of a menu, advert, footer ... that the
neighbour lacks goes too, and a line inside an article stays though the neighbour has it (copied articles).

Only keys of lines are paired, sorted and aligned. Texts move once, when the page meets what was decided for it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.llm.common import released, small_batches, written
from apiloom.llm.urlfilter import host_and_path

TEXT, ARTICLE, MAIN, FURNITURE = range(4)
#: Elements that hold no main text, and words of a class or id that say the same.
FURNITURE_ELEMENTS = frozenset("head nav header footer aside form button select dialog menu noscript template iframe svg object canvas".split())
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: First parts of a name such as page-header that leave its last part the meaning.
PLACES = frozenset("site page main top bottom left right global user reader post cookie google".split())
RAW_ELEMENTS = frozenset("script style textarea title xmp".split())
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_ELEMENTS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark meter q s samp small span strike strong sub sup time tt u var wbr".split())

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>|/?([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|/?([A-Za-z][^\s/>]*)([^>]*)>)", re.S)
_NAMED = re.compile(r"(?:\A|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Two pages' lines are compared in one go up to so many pairs of lines, else in halves.
PAIRS_AT_ONCE = 1 << 28


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE_ELEMENTS:
        return not (tag == "header" and in_article)
    if tag in ("html", "body", "main") or not attributes:
        return False
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        for name in value.split():
            if m[1].lower() == "role":
                if name in FURNITURE_ROLES:
                    return True
                continue
            parts = re.split(r"[-_:]+", name)
            told = parts[0] if parts[0] in FURNITURE_NAMES else parts[-1] if parts[0] in PLACES and parts[-1] in FURNITURE_NAMES else None
            if told and not (told == "header" and in_article):
                return True
    return False


def page_lines(page: str | None) -> list[tuple[int, str, str]]:
    """(kind, key, text) of each block of a page, in its order. Time grows with the page's length alone."""
    text = page or ""
    end, at, lines, words = text.rfind(">") + 1, 0, [], []
    open_: list[tuple[str, int]] = []  # what is open, and the kind of text outside it
    count: dict[str, int] = {}
    kind, part = TEXT, ""

    def flush(tag: str) -> None:
        if words:
            said = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if said:
                lines.append((kind, f"{part} {tag}" if kind == FURNITURE else f"{kind} {said}", said))

    def close(tag: str) -> None:
        nonlocal kind
        while open_:
            last, outside = open_.pop()
            count[last] -= 1
            if outside != kind:
                flush(last)
                kind = outside
            if last == tag:
                return

    while at < end:
        m = _TAG.search(text, at, end)
        if not m:
            break
        words.append(text[at : m.start()])
        at = m.end()
        name, attributes = m[1] or m[3], m[2] or m[4] or ""
        if not name:
            continue
        tag, closes = name.lower(), text[m.start() + 1] == "/"
        inline = tag in INLINE_ELEMENTS or tag in ("script", "style")
        if not inline:
            flush(open_[-1][0] if open_ else "")
        if closes:
            if count.get(tag) and (not inline or open_[-1][0] == tag):
                close(tag)
            continue
        if tag in RAW_ELEMENTS:
            stop = re.compile(rf"</{tag}\b", re.I).search(text, at)
            at = stop.start() if stop else len(text)
            end = max(end, at)
            continue
        if tag == "body" and count.get("head"):
            close("head")
        if not inline and open_ and open_[-1][0] == "p":
            close("p")
        if tag in VOID_ELEMENTS:
            continue
        inside = kind
        if kind != FURNITURE:
            if is_furniture(tag, attributes, kind == ARTICLE):
                inside, part = FURNITURE, f"{tag} {attributes.strip() if not inline else ''}"
            elif tag == "article":
                inside = ARTICLE
            elif tag == "main" and kind == TEXT:
                inside = MAIN
        if inline and inside == kind and kind != FURNITURE:
            continue
        if inside != kind:
            flush(open_[-1][0] if open_ else "")
        open_.append((tag, kind))
        count[tag] = count.get(tag, 0) + 1
        kind = inside
    if at < len(text):
        words.append(text[at:])
    flush("")
    return lines


def _row(a: list[int], b: list[int]) -> tuple[list[int], int]:
    """Bits of each row of the table of common subsequences: bit i is unset where ``a[: i + 1]`` gains one."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows, v = [], full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows, full


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both, in bounded memory for lines of any number."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    return [*range(head), *(head + i for i in _middle(mid_a, mid_b)), *range(len(a) - tail, len(a))]


def _middle(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > PAIRS_AT_ONCE and len(b) > 1:  # the place in ``a`` where the halves of ``b`` meet best
        half = len(b) // 2
        gains = lambda x, y: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(_last(x, y).to_bytes((len(x) + 7) // 8, "little"), np.uint8), count=len(x), bitorder="little").astype(np.int64))])
        cut = int((gains(a, b[:half]) + gains(a[::-1], b[half:][::-1])[::-1]).argmax())
        return [*common_lines(a[:cut], b[:half]), *(cut + i for i in common_lines(a[cut:], b[half:]))]
    rows, full = _row(a, b)
    found, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if (rows[j - 1] if j else full) >> (i - 1) & 1:
                i -= 1
                found.append(i)
    return found[::-1]


def _last(a: list[int], b: list[int]) -> int:
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return v


def decided(kinds: np.ndarray, keys: list[int], mates: list[list[int]], most_shared: float = 0.8) -> tuple[int, int, list[bool] | None]:
    """(lines that a mate shares, lines that only markup tells, which of the other lines go).

    The first mate decides that shares a line, but not more than ``most_shared`` of those outside the template's parts;
    one that shares more is a copy of the page. Lines of an article stay; where there is one, nothing else stays.
    """
    plain, furniture = kinds != FURNITURE, kinds == FURNITURE
    shared = np.zeros(len(kinds), bool)
    for mate in mates:
        here = np.zeros(len(kinds), bool)
        here[common_lines(keys, mate)] = True
        if here.any() and (here & plain).sum() <= most_shared * plain.sum():
            shared = here
            break
        shared |= here & furniture  # a copy still tells the template
    best = ARTICLE if (kinds == ARTICLE).any() else MAIN if (kinds == MAIN).any() else TEXT
    gone = furniture | (kinds != best) | (shared & (kinds != ARTICLE))
    return int((shared & gone).sum()), int((gone & ~shared).sum()), gone[plain].tolist() if gone[plain].any() else None


def _located(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", "url", F.xxhash64("url", "html").alias("page_key"), host.alias("host"), path.alias("path"), "html")


def line_keys(pages: DataFrame) -> DataFrame:
    """(page_id, page_key, host, path, content, kinds, keys): the lines of each page as kinds and 64-bit keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, keys, content = [], [], []
            for page in batch.column("html").to_pylist():
                lines = page_lines(page)
                own = np.array([xxhash.xxh64_intdigest(key) for _, key, _ in lines], np.uint64).view(np.int64)
                kinds.append(bytes(kind for kind, _, _ in lines))
                keys.append(own.tolist())
                content.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "page_key", "host", "path")), pa.array(content, pa.int64()), pa.array(kinds, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["page_id", "page_key", "host", "path", "content", "kinds", "keys"])

    return _located(pages).drop("url").mapInArrow(each, "page_id long, page_key long, host string, path string, content long, kinds binary, keys array<long>")


def neighbours(lines: DataFrame) -> DataFrame:
    """(host, content, kinds, keys, mates array<array<long>>): each distinct page of a host with its neighbours' keys, nearest path first.

    Pages without a line are nobody's neighbour. Pages are put in order by ranges of (host, path), so a host of any size is dealt over many tasks; a page's place in
    that order is its range's begin plus its place in the range, and neighbours are joined by place.
    """
    distinct = lines.where(F.size("keys") > 0).groupBy("host", "content").agg(F.min(F.struct("path", "kinds", "keys")).alias("p")).select("host", "content", "p.*")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.repartitionByRange(parts, "host", "path", "content").sortWithinPartitions("host", "path", "content").withColumn("n", F.monotonically_increasing_id())
    ordered = written(ordered)
    part, within = F.shiftright("n", 33), F.col("n").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.size for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()}
    begins, total = {}, 0
    for p in sorted(sizes):
        begins[p], total = total, total + sizes[p]
    begin = F.element_at(F.lit([begins.get(p, 0) for p in range(max(begins, default=0) + 1)]), part.cast("int") + 1)
    placed = ordered.withColumn("place", begin + within).drop("n")
    beside = lambda by, mark: placed.select((F.col("place") + by).alias("place"), *[F.col(c).alias(f"{c}{mark}") for c in ("host", "path", "keys")])
    both = placed.join(beside(1, 1), "place", "left").join(beside(-1, 2), "place", "left")
    mate = lambda mark: F.when((F.col("host") != "") & (F.col(f"host{mark}") == F.col("host")), F.struct((-_same_begin(F.col("path"), F.col(f"path{mark}"))).alias("near"), F.lit(mark).alias("mark"), F.col(f"keys{mark}").alias("keys")))
    mates = F.transform(F.array_sort(F.array_compact(F.array(mate(1), mate(2)))), lambda m: m["keys"])
    return both.select("host", "content", "kinds", "keys", mates.alias("mates"))


def _same_begin(a: F.Column, b: F.Column) -> F.Column:
    """Number of characters with which both begin."""
    n = F.least(F.length(a), F.length(b), F.lit(4096))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | (F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1))))
    return F.get(differs, F.lit(0))


def differences(pairs: DataFrame) -> DataFrame:
    """(host, content, n_shared, n_marked, gone array<boolean>) of each page of :func:`neighbours`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [decided(np.frombuffer(kinds, np.uint8), keys, mates) for kinds, keys, mates in zip(*(batch.column(c).to_pylist() for c in ("kinds", "keys", "mates")), strict=True)]
            columns = zip(*told, strict=True) if told else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("content"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.bool_())), strict=True))], ["host", "content", "n_shared", "n_marked", "gone"])

    return pairs.mapInArrow(each, "host string, content long, n_shared long, n_marked long, gone array<boolean>")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_marked): the main text of every page, its blocks in order.

    ``n_shared`` lines went since the neighbouring page has them, ``n_marked`` since their markup alone says that they
    are no main text. Where a page has an article, its text is the article's, else that of ``main``, else all that is left.

    A null html is empty and gives an empty text. Null or odd urls have no host, and such pages no neighbour; so the
    markup alone decides on them, as on the only page of a host. Equal pages of a host are differenced once. Repeated
    rows and null ids are kept; other columns are dropped.
    """
    small_batches(pages.sparkSession)
    lines = written(line_keys(pages))
    found = differences(neighbours(lines))
    decisions = written(lines.select("page_id", "page_key", "host", "content").join(found.hint("merge"), ["host", "content"], "left").drop("host", "content").dropDuplicates(["page_id", "page_key"]))
    released(lines)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [[text for kind, _, text in page_lines(page) if kind != FURNITURE] for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "page_key")), pa.array(said, pa.list_(pa.string()))], ["page_id", "url", "page_key", "texts"])

    told = _located(pages).mapInArrow(texts, "page_id long, url string, page_key long, texts array<string>")
    key = decisions.select(F.col("page_id").alias("id"), F.col("page_key").alias("key"), "n_shared", "n_marked", "gone")
    # What was decided grows with the pages, so it is never broadcast.
    joined = told.join(key.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("page_key") == F.col("key")))
    kept = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda t, i: ~F.get("gone", i)))
    return joined.select("page_id", "url", F.array_join(kept, " ").alias("text"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_shared", "n_marked")]).withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "n_shared", "n_marked")

"""Main text of web pages: each page is set against the page of the nearest URL of its host, and lines that both hold in the same order are boilerplate; markup that says what it is has the last word."""

from __future__ import annotations

import hashlib
import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import read, settle, text_of

#: Where a line stands: in markup that declares itself as chrome, undeclared, in the main element, in the article.
CHROME, OPEN, MAIN, ARTICLE = -1, 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)>|<[!?/][^>]*+>?|<[a-zA-Z][^>]*+\Z|<|[^<]++", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
#: Content of these is text to the parser, whatever stands in it, and none to the reader.
_RAW = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An end tag of one of these also ends what is left open inside it; other end tags look no further up than the nearest of them.
_SCOPE = frozenset(("article", "main", "nav", "header", "footer", "aside", "section", "form", "body", "html", "table", "td", "th"))
#: Elements whose start ends those named, if they are open within the nearest list or scope.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = _SCOPE | {"ul", "ol", "menu", "dl", "select"}
#: Elements that are never part of the article.
_CHROME_TAGS = frozenset("head noscript template svg math object canvas audio video nav footer aside form button select datalist dialog menu search".split())
#: Words of a class, an id or a role that say so.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay dialog alert sidebar widget widgets"
    " related recommended recommendations share sharing social menu menus menubar nav navbar navigation breadcrumb breadcrumbs pagination pager footer toolbar skip login signup search contentinfo complementary".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: Of the page, but not of the article, which has a header of its own.
_OUTER_WORDS = frozenset(("header", "masthead"))


def _declared(tag: str, attributes: str, inside: int) -> tuple[int, bool]:
    """What an element says about its content, OPEN if nothing; and whether that holds even for an article within it."""
    if tag == "article" or tag == "main":
        kind = ARTICLE if tag == "article" else MAIN
    elif tag in _CHROME_TAGS or tag == "header" and inside < MAIN:
        kind = CHROME
    else:
        kind = OPEN
    if not attributes or tag in ("html", "body"):
        return kind, False
    words, tokens = set(), set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in _NAME.findall("".join(values)))
            tokens.update("".join(values).lower().split())
            if name == "role" and kind == OPEN and "main" in words:
                kind = MAIN
    # an article may be said to be open for comments, so only a whole token makes it one
    if (tokens if kind >= MAIN else words) & _COMMENT_WORDS:
        return CHROME, True
    if _HIDDEN.search(attributes) and not words & {"hidden"}:
        return CHROME, True
    if kind < MAIN and (words & _CHROME_WORDS or inside < MAIN and words & _OUTER_WORDS):
        return CHROME, False
    return kind, False


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, where) of the blocks of a page in page order: character references decoded, white space as one space, trimmed, without empty ones. Scripts, styles and comments hold none. Markup may be broken in any way."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    where, firm = OPEN, False

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((line, where))
            text.clear()

    def end_from(i: int) -> None:
        nonlocal where, firm
        del stack[i:]
        now = stack[-1][1:] if stack else (OPEN, False)
        if now[0] != where:
            flush()
        where, firm = now

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes = m.groups()
        if tag is None:
            # a lone < is text; comments, declarations and stray ends are none
            if page[m.start()] != "<" or at == m.start() + 1:
                text.append(html_entities.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    end_from(i)
                    break
                if stack[i][0] in _SCOPE and tag not in _SCOPE:
                    break
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                low = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
                at = low.start() if low else end
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _BLOCK:
            # a paragraph ends where another block begins
            above = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCK), -1)
            if above >= 0 and stack[above][0] == "p":
                end_from(above)
            if tag in _ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _ENDS[tag]:
                        end_from(i)
                        break
                    if stack[i][0] in _LISTS:
                        break
        kind, hard = _declared(tag, attributes, where)
        # what is chrome stays chrome within, but for an article or main element; in comments and hidden parts even that
        inner = where if firm or kind == OPEN else kind if kind == CHROME or where == CHROME else max(kind, where)
        if inner != where:
            flush()
        where, firm = inner, firm or hard
        stack.append((tag, where, firm))
    flush()
    return out


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of a that lie on a longest common subsequence with b. In halves, so memory is linear in the lengths; lines that the other page lacks are set aside first, as they can't be on it."""
    own = np.flatnonzero(np.isin(a, b))
    b = b[np.isin(b, a)]
    return [int(own[i]) for i in _align(a[own], b)]


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each prefix of b."""
    last = np.zeros(len(b) + 1, np.int32)
    for x in a:
        step = last.copy()
        step[1:] = np.maximum(last[1:], last[:-1] + (b == x))
        last = np.maximum.accumulate(step)
    return last


def _align(a: np.ndarray, b: np.ndarray) -> list[int]:
    work, out = [(0, len(a), 0, len(b))], []
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(a1)
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if (b[b0:b1] == a[a0]).any():
                out.append(a0)
            continue
        mid = (a0 + a1) // 2
        total = _row(a[a0:mid], b[b0:b1]) + _row(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(total.argmax())
        work += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def shared_lines(own: np.ndarray, sizes: np.ndarray, others: list[np.ndarray], copy: float) -> list[int]:
    """Positions of own's lines that a partner holds too, in the same order. The first partner that isn't a copy counts: with a copy the shared lines have `copy` or more of the characters, and say nothing."""
    weight = int(sizes.sum())
    for other in others:
        found = common(own, other)
        if found and sizes[found].sum() >= copy * weight:
            continue
        return found
    return []


def row_digest(*columns: Column) -> Column:
    """Digest of a row's values, nulls told apart from empty ones."""
    return F.md5(F.concat(*[F.concat(F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("string"), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns]))


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def candidates(lines: list[tuple[str, int]]) -> list[int]:
    """Positions of the lines that differencing decides on: all outside an article element."""
    return [i for i, (_, where) in enumerate(lines) if where < ARTICLE]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and lengths of a page's candidate lines."""
    for batch in batches:
        hashes, sizes = [], []
        for page in batch.column("_html").to_pylist():
            lines = lines_of(page)
            own = [lines[i][0] for i in candidates(lines)]
            hashes.append([_line_hash(t) for t in own])
            sizes.append([len(t) for t in own])
        keep = [n for n in batch.schema.names if n != "_html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=[*keep, "hashes", "sizes"])


def _prefix(a: Column, b: Column) -> Column:
    """Path segments that two paths share from the left."""
    return F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)), lambda same: same))


def differences(pages: DataFrame, copy: float = 0.8) -> DataFrame:
    """pages (_rid, _url, _html) -> (rid, drop), a row per different page: places, among the page's candidate lines, of those that it shares with its partner; pages that share none are left out.

    Within a host pages stand in the order of their paths (segment by segment, then the rest of the URL,
    then the digest). A page's partner is its neighbour in that order with the longer common path, the
    one before it on a tie; where that is a copy, the other one. A page alone on its host, or between
    copies only, has none. The order is a distributed sort, in which a host of any size is spread over
    tasks; only line hashes are sorted and exchanged, and each page meets two others.
    """
    part = lambda i: F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(.*)$", i)
    keyed = pages.select("_rid", F.coalesce(F.lower(part(1)), F.lit("")).alias("host"), F.split(F.coalesce(part(2), F.lit("")), "/").alias("path"), F.coalesce(part(3), F.lit("")).alias("rest"), text_of("_html").alias("_html"))
    lines = keyed.mapInArrow(_digests, "_rid string, host string, path array<string>, rest string, hashes array<bigint>, sizes array<int>")
    at = F.monotonically_increasing_id()
    # settled, or a second sort might number the rows otherwise
    order = settle(lines.dropDuplicates(["_rid"]).orderBy("host", "path", "rest", "_rid").withColumns({"part": F.shiftright(at, 33), "row": at.bitwiseAND((1 << 33) - 1)}))
    per = order.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition of the sort
    begin = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    order = order.join(F.broadcast(begin), "part").withColumn("at", F.col("begin") + F.col("row"))
    side = lambda name, step: order.select((F.col("at") + step).alias("at"), F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"), F.col("hashes").alias(name))
    both = order.join(side("before", 1), "at", "left").join(side("after", -1), "at", "left")
    near = lambda name: F.when(F.col(f"{name}_host") == F.col("host"), _prefix(F.col("path"), F.col(f"{name}_path"))).otherwise(F.lit(-1))
    other = lambda name: F.when(near(name) >= 0, F.col(name))
    first = near("before") >= near("after")
    pairs = both.select("_rid", "hashes", "sizes", F.when(first, other("before")).otherwise(other("after")).alias("nearest"), F.when(first, other("after")).otherwise(other("before")).alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, drops = [], []
            for r in batch.to_pylist():
                others = [np.array(o, np.int64) for o in (r["nearest"], r["next"]) if o]
                found = shared_lines(np.array(r["hashes"], np.int64), np.array(r["sizes"], np.int64), others, copy) if others and r["hashes"] else []
                if found:
                    rids.append(r["_rid"])
                    drops.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.string()), pa.array(drops, pa.list_(pa.int32()))], names=["rid", "drop"])

    return pairs.mapInArrow(run, "rid string, drop array<int>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy: float = 0.8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Every row of pages once: id_col, url_col, text, n_chars (code points), n_shared (lines that its partner page holds too), n_declared (lines that markup says are none of the article).

    The main text is what stands in the page's article elements, else in its main element, else in its
    body; lines in elements that say they are menus, headers, footers, sidebars, notices, adverts, forms
    or reader comments, by their tag or a word of their class, id or role, are left out. Lines outside an
    article element go if the partner page of the nearest URL on the host holds them too, in the same
    order (see differences); lines of an article stay whatever other pages hold, as copies of it are no
    boilerplate. Blocks are joined by one newline. Null html is empty, an empty page gives an empty text,
    a null or relative URL belongs to the host of no name; repeated rows have equal results, as they count
    once in the pairing. An empty table gives no rows; further columns are ignored.

    The lines to drop are broadcast if all of them together, by count, need no more than broadcast_bytes,
    so that no text is exchanged; beyond that pages and lines meet by an exchange.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    rows = rows.withColumn("_rid", row_digest(F.col("_id"), F.col("_url"), F.col("_html")))
    drop = settle(differences(rows.select("_rid", "_url", "_html"), copy))
    needed = drop.agg(F.coalesce(F.sum(F.size("drop") * 4 + 96), F.lit(0))).first()[0]
    drop = F.broadcast(drop) if needed <= broadcast_bytes else drop

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, places, declared = [], [], []
            for page in batch.column("_html").to_pylist():
                lines = lines_of(page or "")
                top = max((w for _, w in lines), default=OPEN)
                at = [i for i, (_, w) in enumerate(lines) if w == top and w != CHROME]
                kept.append([lines[i][0] for i in at])
                # a kept line's place among the candidates; null where no line is left to the partner page
                place = {i: n for n, i in enumerate(candidates(lines))}
                places.append(None if top == ARTICLE else [place[i] for i in at])
                declared.append(sum(w == CHROME for _, w in lines))
            own = [batch.column(n) for n in ("_id", "_url", "_rid")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())), pa.array(declared, pa.int64())], names=["_id", "_url", "_rid", "kept", "places", "n_declared"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    read_out = rows.mapInArrow(parse, f"_id {kind['_id']}, _url {kind['_url']}, _rid string, kept array<string>, places array<int>, n_declared long")
    met = read_out.join(drop, read_out._rid == drop.rid, "left")
    none = F.array().cast("array<int>")
    left = F.filter("kept", lambda line, i: ~F.array_contains(F.coalesce("drop", none), F.element_at("places", i + 1)))
    text = F.array_join(F.when(F.col("places").isNull() | F.col("drop").isNull(), F.col("kept")).otherwise(left), "\n")
    return met.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_shared"), "n_declared")


def op11_nearest_url_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages"))

"""Main text of web pages: a suffix array of each host marks boilerplate, declared structure checks what it marks.

``parse_page`` cuts a page into blocks, each in one of three zones: ``ARTICLE`` (inside article, or
main where there is no article), ``CHROME`` (menus, headers, footers, sidebars, notices, adverts,
forms, comments, by element, role, class or id) and ``OPEN`` (anything else).

All words of all pages of a host, whatever their zone, are one token stream, and every suffix is cut to
``min_run`` words; sorted, equal ones are neighbours. Longer runs need no depth beyond that: what they cover, their
suffixes of ``min_run`` words cover too. Of pages with the same body (the article, or the OPEN words where none is declared) one
counts, so copies and re-crawls don't make each other boilerplate. A run is boilerplate if at least
``least_bodies`` and at least ``min_share`` of the host's distinct bodies have it. Structure then checks the words
that such runs cover:

* OPEN words of a page without an article go where covered, and stay elsewhere.
* An ARTICLE block goes if runs that lie in it cover all of it, and at least ``least_inside`` and at least
  ``inside_share`` of the bodies have each of them inside an article block: a title that every sidebar of the host lists
  isn't boilerplate of its own article, nor is a phrase inside a paragraph, nor a block shorter than ``min_run``. Where
  more than half of an article's words would go, it is a near copy of others, and all of it stays.
* CHROME goes, and so do OPEN blocks of a page with an article, covered or not: menus and adverts that differ from
  page to page are no repetition.

The bodies of a large host are dealt into parts of bounded size by hash. A run that reaches a share of all bodies reaches
it in at least one part, so each part sorts its suffixes and names those that do, and only these are then counted over the
host, exactly. Neither a host nor a menu that all its pages share is gathered in one place.

A null html is an empty page and gives an empty text. A page without a host is
on its own: nothing of it is boilerplate. Truncated pages end where their html ends, as if all elements closed
there. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_small, joined
from .tokens import chunks, grams, release, tokenize

ARTICLE, CHROME, OPEN, _MAIN = 0, 1, 2, 3
#: Repeated runs (16 bytes each) up to which those of all hosts are broadcast.
_RUNS = 400_000
#: A host is dealt into parts of about so many characters of html, but not of fewer pages than this: in a part of
#: three bodies each run would reach a share of 30%.
_PART_CHARS, _PART_PAGES = 512 << 10, 16
#: Host of a URL, as a Java pattern.
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

_TAG = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)|</[^>]*(?:>|\Z)|<\Z")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'>/]+)")
#: Elements whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CHROME_TAGS = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "option", "textarea", "svg", "canvas", "dialog", "menu", "head", "title", "object", "audio", "video", "datalist", "xmp", "noembed", "noframes"}
_BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "thead", "tbody", "tfoot", "tr", "caption", "blockquote", "pre", "hr", "dl", "dt", "dd", "figure", "figcaption", "body", "html", "head", "address", "fieldset", "details", "summary", "header", "hgroup", "center", *_CHROME_TAGS} - {"svg", "button", "select", "option"}
#: What the start of an element closes first, up to the nearest of the second kind.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CHROME_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "social", "share", "sharing", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond", "replies", "widget", "toolbar", "pagination", "pager", "login", "signup", "search", "copyright", "skiplink", "alert"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _is_chrome(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in _CHROME_TAGS or (tag == "header" and not inside_article):
        return True
    if not attrs.strip() or tag in ("html", "body", "article", "main"):
        return False
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if a.get("role", "").lower() in _CHROME_ROLES:
        return True
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()))
    return bool(words & _CHROME_WORDS) or (not inside_article and "header" in words and not words & {"article", "post", "entry", "content"})


def parse_page(page: str) -> list[tuple[int, str]]:
    """The blocks of a page in order: zone and text, white space collapsed, references decoded."""
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # element, zone, inside a link
    zone, linked = OPEN, False
    parts: list[str] = []
    unlinked = has_article = False

    def flush() -> None:
        nonlocal unlinked
        text = " ".join("".join(parts).split())
        if text:
            # an item outside an article that is nothing but links belongs to a menu
            blocks.append((CHROME if zone == OPEN and not unlinked and linked_any and stack and stack[-1][0] in ("li", "td", "ul", "a") else zone, text))
        parts.clear()
        unlinked = False

    linked_any = False
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = htmllib.unescape(page[at:stop])
            parts.append(text)
            if linked:
                linked_any = True
            elif text.strip():
                unlinked = True
        if not m:
            break
        at = m.end()
        token = m[0]
        if token == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        if token.startswith("<![CDATA["):
            continue
        name = (m[2] or m[5] or "").lower()
        if not name or not token.endswith(">"):  # a declaration, a stray end tag, or a tag cut off by the end of the page
            if not name and not token.startswith(("<!", "<?", "</", "<")):
                parts.append(token)
            continue
        closing, attrs = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if name == "br" or name in ("td", "th"):
            parts.append(" ")
        if name in _BLOCKS:
            flush()
            linked_any = False
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            zone, linked = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            continue
        if name in _VOID or attrs.rstrip().endswith("/") and name not in _BLOCKS and name not in _RAW:
            continue
        if name in _BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
        elif name in _CLOSES:
            these, bound = _CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bound:
                    break
                if stack[i][0] in these:
                    del stack[i:]
                    break
        elif name in _BLOCKS:  # an open paragraph ends with the block that follows, formatting elements apart
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCKS:
                    break
        zone, linked = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}\Z", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if zone != CHROME:
            if _is_chrome(name, attrs, zone == ARTICLE):
                zone = CHROME
            elif name == "article" or (name == "main" or 'role="main"' in attrs.lower()) and zone == OPEN:
                zone, has_article = (ARTICLE, True) if name == "article" else (_MAIN, has_article)
            elif zone == _MAIN and name == "article":
                zone, has_article = ARTICLE, True
        stack.append((name, zone, linked or name == "a"))
        linked = linked or name == "a"
    flush()
    # main is the article only where no article is declared
    return [(ARTICLE if z == ARTICLE or z == _MAIN and not has_article else OPEN if z == _MAIN else z, t) for z, t in blocks]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _blocks(page: str | None, structure: bool) -> list[tuple[int, str]]:
    """The page's blocks; without ``structure`` all of them are open."""
    blocks = parse_page(page or "")
    return blocks if structure else [(OPEN, t) for _, t in blocks]


def _body(blocks: list[tuple[int, str]]) -> int:
    """Digest of the article, or of the OPEN words where none is declared."""
    body = ARTICLE if any(z == ARTICLE for z, _ in blocks) else OPEN
    return _digest(" ".join(t for z, t in blocks if z == body))


def _pack(blocks: list[tuple[int, str]]) -> bytes:
    return zlib.compress("\n".join(f"{z}{t}" for z, t in blocks).encode("utf-8", "surrogatepass"), 1)


def _unpack(data: bytes) -> list[tuple[int, str]]:
    return [(int(line[0]), line[1:]) for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n") if line]


def suffixes(pages: list[list[tuple[int, str]]], min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of the pages' words, each cut to ``min_run`` words: page, first word, hash, and whether it lies in one article block."""
    t = tokenize(pa.array([text for p in pages for _, text in p], pa.string()))
    runs, block = grams(t.hash, min_run).view(np.int64), t.owner()
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    article = np.array([z == ARTICLE for p in pages for z, _ in p], bool)
    first, last = block[: len(runs)], block[min_run - 1 : min_run - 1 + len(runs)]
    at = np.flatnonzero(page[first] == page[last])
    begin = np.searchsorted(page[block], np.arange(len(pages)))
    mine = page[first[at]]
    return mine, at - begin[mine], runs[at], (first[at] == last[at]) & article[first[at]]


def _count(bodies: np.ndarray, runs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs in order, how many bodies have each, and how many have it inside an article block."""
    order = np.lexsort((~inside, bodies, runs))  # the suffix array, to a depth of min_run words
    bodies, runs, inside = bodies[order], runs[order], inside[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (bodies[1:] != bodies[:-1])
    runs, inside = runs[new], inside[new]
    first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else np.zeros(0, np.int64)
    return runs[first], np.diff(np.append(first, len(runs))), np.add.reduceat(inside.astype(np.int64), first) if len(runs) else first


def _with_runs(pages: DataFrame, found: DataFrame, how: str, *lists: Column) -> DataFrame:
    """The pages, each with lists of what was found for its host."""
    runs = found.groupBy("host").agg(*lists)
    return pages.join(F.broadcast(runs) if is_small(found, _RUNS) else runs, "host", how)


def boilerplate_runs(pages: DataFrame, min_run: int, min_share: float, least_bodies: int, inside_share: float, least_inside: int, structure: bool, scratch: Scratch) -> DataFrame:
    """(host, run, settled) of pages (host, html): the runs that are boilerplate of a host; the settled ones are so inside articles too."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                pages = [_blocks(html, structure) for html in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["host"], pa.array([_body(p) for p in pages], pa.int64()), pa.array([_pack(p) for p in pages], pa.binary())], ["host", "body", "words"])

    def count(table: pa.Table) -> pa.Table:
        hosts: dict[tuple, list[tuple]] = {}
        for host, parts, body, words in zip(*(table[c].to_pylist() for c in ("host", "parts", "body", "words")), strict=True):
            hosts.setdefault((host, parts), []).append((body, words))
        out: dict[str, list] = {c: [] for c in ("host", "parts", "run", "n", "inside")}
        for (host, parts), rows in hosts.items():
            total = len({body for body, _ in rows})
            runs, n, inside = [], [], []
            if parts > 1 or total >= least_bodies:
                page, _, r, i = suffixes([_unpack(words) for _, words in rows], min_run)
                r, k, i = _count(np.array([body for body, _ in rows], np.int64)[page], r, i)
                keep = k >= max(min_share * total - 1e-6, least_bodies if parts == 1 else 0)
                runs, n, inside = r[keep].tolist(), k[keep].tolist(), i[keep].tolist()
            # the last row of a host counts its bodies here
            for c, values in zip(out, ([host] * (len(runs) + 1), [parts] * (len(runs) + 1), [*runs, None], [*n, total], [*inside, 0]), strict=True):
                out[c] += values
        release()
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], list(out))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                rows: list[tuple] = []
                pages = [_blocks(html, structure) for html in part["html"].to_pylist()]
                page, _, r, i = suffixes(pages, min_run)
                ends = np.searchsorted(page, np.arange(len(pages) + 1))
                for k, (host, named) in enumerate(zip(part["host"].to_pylist(), part["runs"].to_pylist(), strict=True)):
                    own = np.arange(ends[k], ends[k + 1])
                    own = own[np.isin(r[own], np.array(named, np.int64))]
                    run, _, inside = _count(np.zeros(len(own), np.int64), r[own], i[own])
                    rows += [(host, _body(pages[k]), *x) for x in zip(run.tolist(), inside.tolist(), strict=True)]
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], ["host", "body", "run", "inside"])

    parts = F.least(F.ceil(F.col("chars") / _PART_CHARS), F.ceil(F.col("pages") / _PART_PAGES))
    sizes = pages.groupBy("host").agg(F.sum(F.length("html")).alias("chars"), F.count("*").alias("pages"))
    sizes = scratch.keep(sizes.select("host", "chars", parts.cast("long").alias("parts")), "sizes")
    groups = max(1, (sizes.agg(F.sum("chars")).first()[0] or 0) // _PART_CHARS)
    rows = joined(pages.mapInArrow(streams, "host string, body long, words binary"), sizes.filter("parts > 1").select("host", "parts"), "host", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    # a group holds parts of large hosts and whole small hosts
    named = rows.withColumn("group", F.pmod(F.xxhash64("host", F.pmod("body", "parts")), F.lit(groups))).groupBy("group").applyInArrow(count, "host string, parts long, run long, n long, inside long")
    named = scratch.keep(named, "named")
    # what a part of a large host names is counted in all its bodies
    asked = scratch.keep(named.filter("parts > 1 and run is not null").select("host", "run").distinct(), "asked")
    seen = _with_runs(pages, asked, "inner", F.collect_list("run").alias("runs")).select("host", "html", "runs").mapInArrow(hits, "host string, body long, run long, inside long")
    seen = seen.groupBy("host", "run", "body").agg(F.max("inside").alias("inside")).groupBy("host", "run").agg(F.count("*").alias("n"), F.sum("inside").alias("inside"))
    bodies = named.filter("run is null").groupBy("host").agg(F.sum("n").alias("bodies"))
    counted = named.filter("parts = 1 and run is not null").select("host", "run", "n", "inside").unionByName(seen)
    found = joined(counted, bodies, "host").filter((F.col("n") >= least_bodies) & (F.col("n") >= min_share * F.col("bodies")))
    settled = (F.col("inside") >= least_inside) & (F.col("inside") >= inside_share * F.col("bodies"))
    return scratch.keep(found.select("host", "run", settled.alias("settled")), "found")


def main_text(blocks: list[tuple[int, str]], covered: np.ndarray | None, min_run: int, settled: np.ndarray | None = None) -> str:
    """What is left of the blocks where boilerplate runs begin at the ``covered`` words of the page, those inside articles at the ``settled`` ones."""
    ends = np.cumsum([text.count(" ") + 1 for _, text in blocks])
    gone = _covered(ends, covered, min_run)
    if not any(z == ARTICLE for z, _ in blocks):
        left = []
        for end, (z, text) in zip(ends, blocks, strict=True):
            words = text.split(" ")
            kept = [w for w, out in zip(words, gone[end - len(words) : end], strict=True) if not out] if z == OPEN else []
            if kept:
                left.append(" ".join(kept))
        return "\n\n".join(left)
    inside = _covered(ends, settled, min_run)
    article = [(end - text.count(" ") - 1, end, text) for end, (z, text) in zip(ends, blocks, strict=True) if z == ARTICLE]
    left = [(a, b, text) for a, b, text in article if not inside[a:b].all()]
    if 2 * sum(b - a for a, b, _ in left) < sum(b - a for a, b, _ in article):  # a near copy of other articles
        left = article
    return "\n\n".join(text for _, _, text in left)


def _covered(ends: np.ndarray, starts: np.ndarray | None, min_run: int) -> np.ndarray:
    """Which words of a page lie in runs that begin at the given ones."""
    out = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    for a in () if starts is None else starts:
        out[a : a + min_run] = True
    return out


def extract_main_text(pages: DataFrame, min_run: int = 6, min_share: float = 0.3, least_bodies: int = 3, structure: bool = True, inside_share: float = 0.5, least_inside: int = 10) -> DataFrame:
    """Each row's page_id, url, text and n_chars; without ``structure`` the suffix array alone decides about every block."""
    scratch = Scratch(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    found = boilerplate_runs(rows.select("host", "html").filter("host <> ''"), min_run, min_share, least_bodies, inside_share, least_inside, structure, scratch)
    scratch.drop("sizes", "named", "asked")
    lists = (F.collect_list("run").alias("runs"), F.collect_list(F.when(F.col("settled"), F.col("run"))).alias("settled"))
    rows = _with_runs(rows, found, "left", *lists).select("page_id", "url", "html", "runs", "settled")

    def texts(part: pa.RecordBatch) -> list[str]:
        pages, runs, settled = [_blocks(html, structure) for html in part["html"].to_pylist()], part["runs"].to_pylist(), part["settled"].to_pylist()
        page, word, r, inside = suffixes([p if mine else [] for p, mine in zip(pages, runs, strict=True)], min_run)
        ends = np.searchsorted(page, np.arange(len(pages) + 1))
        out = []
        for k, p in enumerate(pages):
            own = slice(ends[k], ends[k + 1])
            covered = np.isin(r[own], np.array(runs[k] or [], np.int64))
            within = covered & inside[own] & np.isin(r[own], np.array(settled[k] or [], np.int64))
            out.append(main_text(p, word[own][covered], min_run, word[own][within]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                found = texts(part)
                yield pa.RecordBatch.from_arrays([part["page_id"].cast(pa.int64()), part["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

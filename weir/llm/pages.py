"""HTML extraction (operator 10): site template removal.

Each page is read into a flat list of events. Subtrees outside the article are
hashed in two ways, and Spark counts on how many different pages of the same
host each hash occurs; a second reading removes the subtrees that recur on a
fixed number of them, however large the host:

* by tag and text: containers, and in a page without an article also paragraphs,
  headings and list items;
* by shape alone (tags and class names; equal neighbours count once): lists of
  links, as menus whose entries change from page to page, and elements that the
  markup names as menu, advert, footer and so on. A name alone decides only what
  recurs too seldom to be counted.

An article that is copied to many pages stays: elements that hold the article
are never removed, paragraphs and headings in an article neither, and other
containers in it only if their text recurs in several different articles of the
host. Copies of one page or one article count once. A class name counts if all
its words name what is not the article ("comment-list", not "share-price"); by
a name no paragraph, no headline and nothing that holds a page's first headline goes.

Rows are distinct by (host, hash, page or article) before they are counted, and
counted in part before they are shuffled by (host, hash), so a host with a third
of all pages is spread over its hashes. The templates of each host are broadcast
after a check of their number, else each page's hashes are joined with them.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import materialise, table

#: Different pages, and inside an article different articles, of a host on which a subtree must recur.
MIN_PAGES, MIN_ARTICLES = 5, 10
#: Up to so many templates in all and on one host go to every task; more meet the pages' hashes by a shuffle.
BROADCAST_HASHES, HOST_HASHES = 500_000, 2_000
#: Templates on more pages than this are broadcast in that shuffle; few can be.
HOT = 65_536

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template nav footer aside form iframe object embed svg canvas audio video map button select textarea option input dialog menu title xmp noembed noframes".split())
#: Words in class, id or role that name what is not the article.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "notice notices cookie cookies consent gdpr newsletter subscribe subscription signup share sharing social comment comments respond replies disqus related recommended popup modal overlay toolbar "
    "pagination pager widget contentinfo complementary search alert alertdialog dialog disclaimer header".split()
)
#: Of these the words that may also name a part of an article: inside one they decide only together with others, or with the counts.
WEAK_NAMES = frozenset("header banner search alert alertdialog dialog notice notices disclaimer toolbar overlay modal popup widget complementary contentinfo masthead menu footer social respond replies promotion subscription".split())
#: Words that may stand beside those in one class name.
NEUTRAL = frozenset(
    "list lists box container wrapper wrap area block section item items link links button buttons bar inner outer content site page post posts main top bottom left right icon icons form group text title "
    "slot slots unit units user users thread threads tools story stories article articles news more google".split()
)
#: Words that are written as one, and what they are made of.
COMPOUNDS = {"commentlist": "comment list", "adsbygoogle": "ads google", "adslot": "ad slot", "adbox": "ad box", "adunit": "ad unit", "sharebar": "share bar", "sharebox": "share box", "cookiebar": "cookie bar", "cookiebanner": "cookie banner", "navbar": "nav bar"}
#: Elements without any text of the page.
NO_TEXT = frozenset("head script style noscript template iframe object embed svg canvas audio video map title xmp noembed noframes".split())
#: Elements that the markup itself calls menu, footer and so on.
SEMANTIC = frozenset("nav footer aside header form dialog menu".split())
LISTED = frozenset("li tr dt dd".split())
#: Links that make a list of links.
MIN_LINKS = 3
CONTAINERS = frozenset("div section ul ol dl table nav aside header footer form center fieldset details figure".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset(("html", "body", "article", "main"))
#: What an opening tag closes, up to what it does not look beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("td th table button caption html object article section div li blockquote body".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_MAIN = re.compile(r"""(?:^|\s)role\s*=\s*["']?main\b""", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)")


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url or "")
    return found[1].lower() or None if found else None


def read(page: str) -> tuple[list, list[str], list[str]]:
    """Events and, of each element, tag and attributes.

    An event is an element's number where it opens, its complement where it
    closes, or a text. Elements without closing tags are closed as browsers do
    for paragraphs, list items and table cells, and at the end.
    """
    events, tags, attributes, stack, at, n = [], [], [], [], 0, len(page)

    def close(depth: int) -> None:
        while len(stack) > depth:
            events.append(~stack.pop())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            events.append(page[at:])
            break
        if lt > at:
            events.append(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            m = _BROKEN.match(page, lt)
            if m is None:
                events.append("<")
                at = lt + 1
                continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            depth = len(stack) - 1
            while depth >= 0 and tags[stack[depth]] != tag:
                if tag in INLINE and tags[stack[depth]] not in INLINE:
                    depth = -1
                    break
                depth -= 1
            if depth >= 0:
                close(depth)
            continue
        if tag not in INLINE:
            for depth in range(len(stack) - 1, -1, -1):
                if tags[stack[depth]] == "p":
                    close(depth)
                    break
                if tags[stack[depth]] in P_SCOPE:
                    break
        if tag in CLOSES:
            closed, limit = CLOSES[tag]
            lowest = None
            for depth in range(len(stack) - 1, -1, -1):
                if tags[stack[depth]] in limit:
                    break
                if tags[stack[depth]] in closed:
                    lowest = depth
            if lowest is not None:
                close(lowest)
        i = len(tags)
        tags.append(tag)
        attributes.append(m[3])
        events.append(i)
        if tag in VOID or (m[3].endswith("/") and tag in ("svg", "path")):
            events.append(~i)
        elif tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            if end is None:
                at = n
            else:
                at = end.end()
            events.append(~i)
        else:
            stack.append(i)
    close(0)
    return events, tags, attributes


def named(attributes: str) -> int:
    """Whether a class, id or role says that an element is not article text: 2, or 1 where it may also name a part of one; else 0."""
    most = 0
    for names in _NAMES.findall(attributes):
        for name in _HUMP.sub("-", names.strip("\"'")).lower().split():
            words = _WORD.findall(name)
            if not COMPOUNDS.keys().isdisjoint(words):
                words = " ".join(COMPOUNDS.get(w, w) for w in words).split()
            if not DROPPED_NAMES.isdisjoint(words) and all(w in DROPPED_NAMES or w in NEUTRAL for w in words):
                most = max(most, 1 + any(w in DROPPED_NAMES and w not in WEAK_NAMES for w in words))
    return most


class Page:
    """The events of a page and, of each element, what the rules look at."""

    def __init__(self, page: str):
        self.events, self.tags, self.attributes = read(page)
        n = len(self.tags)
        self.first, self.last = spans(self.events, n)
        self.inside, self.holds, self.titled, self.outer = [False] * n, [False] * n, [False] * n, [-1] * n
        stack, depth, outer = [], 0, -1
        self.tops = 0  # articles and mains in no other
        for e in self.events:
            if type(e) is str:
                continue
            if e >= 0:
                tag = self.tags[e]
                self.inside[e], self.outer[e] = depth > 0, outer
                if tag in ("article", "main"):
                    if not depth:
                        outer = e
                        self.tops += 1
                        for j in stack:
                            self.holds[j] = True
                    depth += 1
                elif tag == "h1":
                    for j in stack:
                        self.titled[j] = True
                stack.append(e)
            else:
                stack.pop()
                if self.tags[~e] in ("article", "main"):
                    depth -= 1
                    outer = outer if depth else -1

        self.off = [self.by_name(i) for i in range(n)]

    def by_name(self, i: int) -> bool:
        """Whether names or attributes of element i say that it is not article text."""
        attributes, tag = self.attributes[i], self.tags[i]
        if not attributes or tag in ("html", "body", "main"):
            return False
        if _HIDDEN.search(attributes) is not None:
            return not self.holds[i]
        if tag in HEADINGS or self.titled[i] or (tag == "article" and not self.inside[i]):
            return False
        # a paragraph, and what lies in an article, goes by a name that says nothing else
        sure = named(attributes) > (tag in CONTENT or self.inside[i])
        return sure and not (self.holds[i] and self.covers(i))

    def covers(self, i: int) -> bool:
        """Whether element i holds every outer article of the page."""
        return sum(1 for j in range(i + 1, len(self.tags)) if self.first[j] < self.last[i] and self.tags[j] in ("article", "main") and not self.inside[j]) == self.tops

    def by_markup(self, i: int) -> bool:
        tag = self.tags[i]
        if tag == "header":
            return not self.inside[i] and not (self.holds[i] and self.covers(i))
        return tag in DROPPED or self.off[i]


def spans(events: list, n: int) -> tuple[list[int], list[int]]:
    first, last = [0] * n, [0] * n
    for k, e in enumerate(events):
        if type(e) is int:
            if e >= 0:
                first[e] = k
            else:
                last[~e] = k
    return first, last


def digests(events: list, tags: list[str]) -> list[int]:
    """A signed 64-bit hash of each element's subtree; 0 where it has no text."""
    out = [0] * len(tags)
    stack: list[list[str]] = [[]]
    for e in events:
        if type(e) is str:
            words = " ".join(e.split())
            if words:
                stack[-1].append(words)
        elif e >= 0:
            stack.append([])
        else:
            parts = stack.pop()
            if parts:
                tag = tags[~e]
                h = xxhash.xxh64_intdigest("\x01".join([tag, *parts]))
                out[~e] = h - (1 << 64) if h >> 63 else h
                stack[-1].append(f"\x02{h}")
    return out


def shapes(p: Page) -> list[int]:
    """A hash of the shape of each subtree outside an article that is a list of links or named by the markup; else 0."""
    out, stack = [0] * len(p.tags), [[[], 0, 0, 0]]
    links = 0
    for e in p.events:
        if type(e) is str:
            n = len("".join(e.split()))
            stack[-1][1] += n
            if links:
                stack[-1][2] += n
        elif e >= 0:
            links += p.tags[e] == "a"
            stack.append([[], 0, 0, 0])
        else:
            i = ~e
            tag = p.tags[i]
            links -= tag == "a"
            parts, text, linked, count = stack.pop()
            count += tag == "a"
            names = " ".join(sorted(_DIGITS.sub("0", " ".join(x.strip("\"'") for x in _NAMES.findall(p.attributes[i]))).lower().split()))
            h = xxhash.xxh64_intdigest("\x01".join(["shape", tag, names, *parts]))
            above = stack[-1]
            if tag not in INLINE or tag == "a":
                part = str(h)
                if not above[0] or above[0][-1] != part:
                    above[0].append(part)
            above[1] += text
            above[2] += linked
            above[3] += count
            if text and not p.inside[i] and not p.holds[i] and tag not in HOLDERS and tag not in NO_TEXT:
                if (tag in CONTAINERS and count >= MIN_LINKS and 2 * linked >= text) or tag in SEMANTIC or p.off[i]:
                    out[i] = h - (1 << 64) if h >> 63 else h
    return out


def articles(p: Page, gone: list[bool]) -> list[int]:
    """The elements whose text is the page's: all articles, or the main that holds them all; else none (the whole page)."""

    def roots(found) -> list[int]:
        at, upto = [], -1
        for i in range(len(p.tags)):
            if p.first[i] > upto and gone[i]:
                upto = p.last[i]
            elif p.first[i] > upto and found(i):
                at.append(i)
                upto = p.last[i]
        # comments and teasers may be articles too
        at = [i for i in at if named(p.attributes[i]) < 2] or at
        return [i for i in at if any(type(e) is str and not e.isspace() for e in p.events[p.first[i] : p.last[i]])]

    mains = roots(lambda i: p.tags[i] == "main" or _MAIN.search(p.attributes[i]) is not None)
    found = roots(lambda i: p.tags[i] == "article")
    if found and not (len(mains) == 1 and all(p.first[mains[0]] < p.first[i] < p.last[mains[0]] for i in found)):
        return found
    return mains or found


def signed(parts: list[str]) -> int:
    h = xxhash.xxh64_intdigest("\x01".join(parts))
    return h - (1 << 64) if h >> 63 else h


def listed(p: Page, hashes: list[int]) -> list[int]:
    """Elements whose text is counted: containers and, where the page has no article, what lies in them."""
    return [i for i, t in enumerate(p.tags) if hashes[i] and not p.holds[i] and (t in CONTAINERS or (not p.tops and (t in CONTENT or t in LISTED)))]


def containers(page: str) -> list[tuple[int, bool, int]]:
    """(hash, inside an article, hash of that article or else of the page) of each subtree of the page that may be a template."""
    p = Page(page)
    hashes = digests(p.events, p.tags)
    whole = signed([" ".join(e.split()) for e in p.events if type(e) is str])
    out = [(hashes[i], p.inside[i], hashes[p.outer[i]] if p.inside[i] else whole) for i in listed(p, hashes)]
    return out + [(h, False, whole) for h in shapes(p) if h]


def extract(page: str | None, templates: frozenset = frozenset(), frequent: frozenset = frozenset(), *, markup: bool = True) -> str:
    """The main text of a page; `templates` are hashes to remove outside an article, `frequent` inside it.

    Without `markup` nothing goes that does not recur, and text outside an
    article stays unless it recurs: what the counts alone do.
    """
    if not page:
        return ""
    p = Page(page)
    events, tags, first, last = p.events, p.tags, p.first, p.last
    gone = [p.by_markup(i) if markup else t in NO_TEXT for i, t in enumerate(tags)]
    if templates or frequent:
        hashes, shape = digests(events, tags), shapes(p)
        for i in listed(p, hashes):
            if hashes[i] in (frequent if p.inside[i] or tags[i] in CONTENT or tags[i] in LISTED else templates):
                gone[i] = True
        for i, h in enumerate(shape):
            if h and h in templates:
                gone[i] = True
    roots = articles(p, gone) if markup and (p.tops or "main" in page) else []
    blocks, held = [], []

    def flush() -> None:
        words = " ".join(unescape("".join(held)).split())
        if words:
            blocks.append(words)
        held.clear()

    for a, b in [(first[i], last[i]) for i in roots] or [(0, len(events))]:
        k = a
        while k < b:
            e = events[k]
            if type(e) is str:
                held.append(e)
            else:
                tag = tags[e if e >= 0 else ~e]
                if e >= 0 and gone[e]:
                    k = last[e]
                    if tag not in INLINE:
                        flush()
                elif tag == "br":
                    held.append(" ")
                elif tag not in INLINE:
                    flush()
            k += 1
        flush()
    return "\n".join(blocks)


def template_table(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_articles: int = MIN_ARTICLES) -> DataFrame:
    """host, hash, template, frequent, n: what recurs on `min_pages` pages of its host, and whether on `min_articles`.

    `pages` has url and html. Each page, and each article, counts a hash once,
    and copies of it count together.
    """

    def find(batches):
        for batch in batches:
            found: set = set()
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url)
                if host is not None:
                    found.update((host, *k) for k in containers(page or ""))
            keys = list(found)
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)], names=["host", "hash", "inside", "around"])

    each = pages.select("url", "html").mapInArrow(find, "host string, hash bigint, inside boolean, around bigint").distinct()
    counted = each.groupBy("host", "hash", "inside").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counted.groupBy("host", "hash").agg(F.max(~F.col("inside")).alias("template"), (F.max("n") >= min_articles).alias("frequent"), F.max("n").alias("n"))
    return often.where("template or frequent")


def with_templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The pages with `templates` and `frequent`, of each page the hashes that it has itself."""
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    keyed = pages.withColumn("_key", key)

    def find(batches):
        for batch in batches:
            rows = [(k, host_of(u), h) for k, u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) if host_of(u) is not None for h in {c[0] for c in containers(p or "")}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["_key", "host", "hash"])

    own = keyed.select("_key", "url", "html").mapInArrow(find, "_key string, host string, hash bigint")
    hot = F.broadcast(found.where(F.col("n") > HOT))
    met = own.join(hot, ["host", "hash"]).unionByName(own.join(hot, ["host", "hash"], "left_anti").join(found.where(F.col("n") <= HOT), ["host", "hash"]))
    sets = met.groupBy("_key").agg(F.collect_set(F.when(F.col("template"), F.col("hash"))).alias("templates"), F.collect_set(F.when(F.col("frequent"), F.col("hash"))).alias("frequent"))
    return keyed.join(sets, "_key", "left").drop("_key")


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", markup: bool = True, **options) -> DataFrame:
    """page_id, url, text.

    Null and empty pages have empty text; pages whose url names no host are
    extracted by their markup alone. Repeated rows are pages each. Blocks are in
    page order, white space in a block is one blank, nothing is cut off. A page
    of any length is read as a whole, within one task. Extra columns are left
    out. An empty table gives an empty table. `markup`: see `extract`.
    """
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = materialise(template_table(d, **options))
    size, most = found.groupBy("host").count().agg(F.sum("count"), F.max("count")).first()
    if (size or 0) <= BROADCAST_HASHES and (most or 0) <= HOST_HASHES:
        of = lambda c: F.collect_set(F.when(F.col(c), F.col("hash")))
        hosts = found.groupBy("host").agg(of("template").alias("templates"), of("frequent").alias("frequent"))
        host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
        known = d.withColumn("host", host).join(F.broadcast(hosts), "host", "left")
    else:
        known = with_templates(d, found)
    kind = d.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [extract(page, frozenset(t or ()), frozenset(f or ()), markup=markup) for page, t, f in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return known.select("page_id", "url", "html", "templates", "frequent").mapInArrow(run, f"page_id {kind}, url string, text string")


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))

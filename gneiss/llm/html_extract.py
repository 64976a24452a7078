"""HTML extraction by site template removal.

A page is parsed into elements and text blocks. Every element's subtree is hashed twice: by its tags and text, and by its shape, that
is tags, classes and where it has text or links, whatever they say. Spark counts, for each host, on how many pages of different
content a subtree recurs, and those that recur on many of them are the site's template and go: by their text anywhere, and by their
shape where on nearly all of these pages they are mostly links or short, since a menu, an advert or a footer may say something else on
every page, but an article is long. Paragraphs and other plain blocks of an article are never template: the same licence line may
close many articles. On hosts of few pages nothing recurs; elements that say themselves that they aren't content (menus, footers,
adverts, forms, comments and the like) go there and anywhere, and of a page with articles only these are read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import bites, small_batches, table, tidy

#: A subtree is template if it recurs on this many pages of different content, and on the host's number of them to this power: on 10
#: of up to 100, on 100 of 10000.
MIN_PAGES, MIN_POWER = 10, 0.5
#: A recurring shape may be template where it has this many words at most and under half of its page's, or links are half of its words,
#: and is template if that is so on this share of the pages that have it.
SHORT, ALIKE = 40, 0.9
#: Rows of the template table up to which it is broadcast; beyond it, pages and templates are joined.
BROADCAST_ROWS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
NOT_CONTENT = frozenset("head nav footer aside form button select option datalist input dialog menu menuitem object applet audio video canvas map label".split()) | RAW
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: In an article, only such containers can be template.
CONTAINER = frozenset("div section aside nav header footer form ul ol table".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
_DIGITS = re.compile(r"\d+")
#: Tags that an opening tag of the same group ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|sidebar\w*|side|aside|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|comment-\w+|commentlist|respond|replies|reply|disqus|widget|skip|copyright|header|site-header|page-header)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")


HOST = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str | None) -> str:
    m = re.match(HOST, url or "")
    return m[1].lower() if m else ""


#: Of an article's classes, only these say that it isn't the article.
NAMED_ARTICLE = re.compile(r"(?:^|\s)(?:comment|comments|reply|ad|advert|advertisement|teaser|related|promo|sponsored)(?:$|\s)", re.I)


def _boilerplate(tag: str, attributes: str, in_article: bool) -> int:
    """2 if the element can't be content, 1 if its names say that it isn't, else 0."""
    if tag in NOT_CONTENT or tag == "header" and not in_article:
        return 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and (NAMED_ARTICLE if tag == "article" else NAMED).search(value) and not (in_article and tag in ("p", "h1", "h2", "h3")):
            return 1
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return 2 if re.search(r"(?:^|\s)hidden(?=\s|/|$)", attributes) else 0


class Page:
    """Elements (tag, parent, boilerplate, in article, hash, shape, words, words in links, whether they hold an article) and text blocks
    (text, element) of a page, in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.plate, self.within, self.hash = ["#"], [-1], [0], [False], [0]
        self.shape, self.words, self.links, self.holds = [0], [0], [0], [False]
        self.blocks: list[tuple[str, int]] = []
        self.title, self.articles = "", []
        self._form, self._link, self._n, self._n_links = [["#"]], False, 0, 0
        self._open, self._parts, self._text, self._at = [0], [[]], [], 0
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if not source.endswith(">", 0, at) and at == size:
                break  # the page ends within a tag
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                end = closing.start() if closing else size
                if tag == "title" and not self.title:
                    self.title = " ".join(html.unescape(source[at:end]).split())
                at = closing.end() if closing else size
            else:
                self._start(tag, m[3])
        self._flush()
        while len(self._open) > 1:
            self._pop()

    def _say(self, text: str) -> None:
        self._text.append(text)
        n = len(text.split())
        self._n += n
        if self._link:
            self._n_links += n

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            self._text = []
            if text:
                self.blocks.append((text, self._at))
                self._parts[-1].append(text)
                self._shape("a" if 2 * self._n_links >= self._n else "t")
                self.words[self._at] += self._n
                self.links[self._at] += self._n_links
            self._n = self._n_links = 0

    def _shape(self, part: str) -> None:
        """Of like neighbours one counts: a list has the same shape however long it is."""
        if self._form[-1][-1] != part:
            self._form[-1].append(part)

    def _pop(self) -> None:
        e, parts, form = self._open.pop(), self._parts.pop(), self._form.pop()
        self.hash[e] = xxhash.xxh64_intdigest("\0".join(parts), 1) if len(parts) > 1 else 0
        if self.hash[e]:
            self._parts[-1].append(f"{self.hash[e]:x}")
            self.shape[e] = xxhash.xxh64_intdigest("\0".join(form), 3)
            self._shape(f"{self.shape[e]:x}")
        up = self._open[-1]
        self.words[up] += self.words[e]
        self.links[up] += self.links[e]
        self.holds[up] = self.holds[up] or self.holds[e]
        self._at = up

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag in VOID and tag != "hr":
            self._text.append(" ")
            return
        if tag == "a":
            self._link = True
        block = tag in BLOCK
        # adverts and the like may be inline elements: they are elements of their own too
        plate = _boilerplate(tag, attributes, self.within[self._open[-1]])
        if not block and not plate:
            return
        self._flush()
        if tag == "hr":
            return
        if block:
            if self.tag[self._open[-1]] in CLOSED_BY_BLOCK:
                self._pop()
            ends = ENDS.get(tag)
            if ends:
                stop = SCOPE.get(tag, {"table"})
                for k in range(len(self._open) - 1, 0, -1):
                    if self.tag[self._open[k]] in stop:
                        break
                    if self.tag[self._open[k]] in ends:
                        while len(self._open) > k:
                            self._pop()
                        break
        parent = self._open[-1]
        self.tag.append(tag)
        self.parent.append(parent)
        self.plate.append(plate)
        main = tag in ("article", "main") or 'role="main"' in attributes
        self.within.append(self.within[parent] or main)
        self.hash.append(0)
        self.shape.append(0)
        self.words.append(0)
        self.links.append(0)
        self.holds.append(main)
        e = len(self.tag) - 1
        named = sorted(_DIGITS.sub("", f"{k.lower()}={v}") for k, v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role")) if attributes else ()
        self._form.append([" ".join((tag, *named))])
        if main:
            self.articles.append(e)
        self._open.append(e)
        self._parts.append([tag])
        self._at = e

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag == "a":
            self._link = False
        for k in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[k]] == tag:
                self._flush()
                while len(self._open) > k:
                    self._pop()
                return
        if tag == "p":
            self._flush()

    def candidates(self) -> set[int]:
        """Hashes of the subtrees that may be template by their text."""
        return {h for h, tag, within in zip(self.hash, self.tag, self.within, strict=True) if h and tag not in ("html", "body", "article", "main") and (not within or tag in CONTAINER)}

    def shapes(self) -> dict[int, bool]:
        """Shapes of the containers outside articles, and whether they may be template by them here."""
        out: dict[int, bool] = {}
        for e, shape in enumerate(self.shape):
            if shape and self.tag[e] in CONTAINER and not self.within[e] and not self.holds[e]:
                own, links = self.words[e], self.links[e]
                out[shape] = out.get(shape, True) and (2 * links >= own or own <= SHORT and 2 * own < self.words[0])
        return out

    def identity(self) -> int:
        """What tells pages of different content apart: all text of the articles, else the title and all text."""
        content = [text for text, e in self.blocks if self.within[e]] or [self.title, *(text for text, _ in self.blocks)]
        return xxhash.xxh64_intdigest("\n".join(content), 2)

    def text(self, template: frozenset[int] | set[int], named: bool = True) -> str:
        """The blocks that no template element holds: of the articles, or of the whole page without one, and without those that
        boilerplate holds. named False leaves only template to decide."""
        may = (self.candidates() | self.shapes().keys()) & template if template else ()
        for rescue in (False, True):
            # names are weak evidence against what holds the page's only articles
            holds = set()
            for e in (x for x in self.articles if rescue and not self.plate[x]):
                while e > 0:
                    holds.add(e)
                    e = self.parent[e]
            gone = [False] * len(self.tag)
            for e in range(1, len(self.tag)):
                plate = named and (self.plate[e] == 2 or self.plate[e] == 1 and e not in holds)
                same = bool(may) and self.hash[e] in may and (not self.within[e] or self.tag[e] in CONTAINER) and self.tag[e] not in ("html", "body", "article", "main")
                if may and not same and self.shape[e] in may and self.tag[e] in CONTAINER and not self.within[e] and not self.holds[e]:
                    same = 2 * self.links[e] >= self.words[e] or 2 * self.words[e] < self.words[0]  # most of a page's text is never template
                gone[e] = gone[self.parent[e]] or plate or same
            for kind in ("article", "main") if named else ():
                regions = {e for e in self.articles if not gone[e] and (self.tag[e] == kind or kind == "main")}
                if regions:
                    break
            if not named:
                regions = set()
                break
            if regions or not self.articles:
                break
        inside = [False] * len(self.tag)
        for e in range(len(self.tag)):
            inside[e] = not regions or e in regions or e > 0 and inside[self.parent[e]]
        return "\n\n".join(text for text, e in self.blocks if inside[e] and not gone[e])


def _unsigned(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_power: float = MIN_POWER, alike: float = ALIKE) -> DataFrame:
    """pages(url, html) -> (host, subtree): hashes of the subtrees that recur on many pages, of different content, of their host.

    A host's pages of like content, that is copies, count as one. Hosts and subtrees are counted by partial aggregation, so a host
    with most pages is no bottleneck.
    """

    def parse(batches):
        for b in bites(batches, 64):
            hosts, contents, trees, against = [], [], [], []
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                shapes = page.shapes()
                hosts.append(host_of(url))
                contents.append(_unsigned(page.identity()))
                trees.append([_unsigned(h) for h in page.candidates() | {x for x, ok in shapes.items() if ok}])
                against.append([_unsigned(h) for h, ok in shapes.items() if not ok])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (trees, against)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), *lists], ["host", "content", "trees", "against"])

    seen = pages.select("url", "html").mapInArrow(tidy(parse), "host string, content long, trees array<long>, against array<long>")
    # subtree null counts the host's contents themselves
    mark = lambda may: lambda h: F.struct(h.alias("subtree"), F.lit(may).alias("may"))
    marked = F.concat(F.transform(F.concat("trees", F.array(F.lit(None).cast("long"))), mark(True)), F.transform("against", mark(False)))
    rows = seen.select("host", "content", F.explode(marked).alias("x")).select("host", "content", "x.subtree", "x.may").distinct()
    counts = rows.groupBy("host", "subtree").agg(F.count_if("may").alias("n"), F.count_if(~F.col("may")).alias("n_against"))
    totals = counts.where("subtree is null").select("host", F.col("n").alias("total"))
    often = counts.where((F.col("n") >= min_pages) & F.col("subtree").isNotNull() & (F.col("n") >= F.lit(alike) * (F.col("n") + F.col("n_against"))))
    return often.join(totals, "host").where(F.col("n") >= F.pow("total", F.lit(min_power))).select("host", "subtree")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_power: float = MIN_POWER, broadcast_rows: int = BROADCAST_ROWS, source: str = "html", url: str = "url", page_id: str = "page_id", named: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's blocks in page order, joined by two line ends.

    Null or empty html, and a page without content, give an empty text. A null or odd URL belongs to the host of no name. Rows of one
    page_id, or of a null one, get a row each. Pages are read whole, however long; a page cut short is read to its end. Other columns
    don't matter, whatever their names; an empty table gives an empty one. named False leaves only template to decide, not what
    elements call themselves.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{source}`").cast("string").alias("html"))
    found = templates(rows, min_pages, min_power)
    first = found.limit(broadcast_rows + 1).toArrow()
    if first.num_rows <= broadcast_rows:
        of: dict[str, set[int]] = {}
        for host, h in zip(first.column(0).to_pylist(), first.column(1).to_pylist(), strict=True):
            of.setdefault(host, set()).add(h & (1 << 64) - 1)
        given = rows.sparkSession.sparkContext.broadcast(of)
        ready = rows.withColumn("trees", F.lit(None).cast("array<long>"))
    else:  # each host's templates come to its pages; hosts of many pages are split by the join
        given = None
        ready = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))).join(found.groupBy("host").agg(F.collect_list("subtree").alias("trees")), "host", "left").drop("host")

    def pull(batches):
        for b in bites(batches, 64):
            texts = []
            for address, body, trees in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                template = given.value.get(host_of(address), frozenset()) if given is not None else {h & (1 << 64) - 1 for h in trees or ()}
                texts.append(Page(body or "").text(template, named))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return ready.select("page_id", "url", "html", "trees").mapInArrow(tidy(pull), f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))

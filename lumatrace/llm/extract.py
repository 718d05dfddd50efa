"""Main text of web pages by composite text density.

Every DOM node has characters, tags, link characters and link tags; its density is characters per
tag, weighed down by links. The subtree whose children's densities have the largest sum is the main
part, with all other subtrees that reach the least density on the path between body and it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, read

#: What stands between an element's name and its end: a quote opens a value only directly behind an equals sign.
ATTRIBUTES = r"(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>" + ATTRIBUTES + r")>"
    r"|<(?P<torn>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements of HTML by their behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
FOREIGN, NESTED = frozenset(("svg", "math")), frozenset(("svg", "math", "template"))
ENDS_P = BLOCK - frozenset("body caption head html legend optgroup option select tbody td template tfoot th thead title tr".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tfoot"), "tbody": ("thead", "tbody"), "tfoot": ("thead", "tbody")}
SCOPE = frozenset("ul ol dl table select html body article section div main".split())
#: Elements, words of class or id, and roles that mark what isn't main text.
ASIDE_TAGS = frozenset("nav aside footer form button select dialog menu head object canvas audio video map search".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sidebar nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar cookie cookies consent gdpr alert popup modal overlay lightbox newsletter subscribe subscription signup signin login comment comments disqus reply replies respond widget toolbar pagination pager skip search form".split())
#: Words that parts of an article's own text have as well: there they count only for parts that are less dense than it.
SOFT_WORDS = frozenset("promo promotion banner banners side rail footer foot notice notices discussion share sharing social related recommended recommendations copyright legal disclaimer".split())
HEADER_WORDS = frozenset("header heading-bar pagehead".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))


class Page:
    """The nodes of one page in document order, and its blocks of text."""

    def __init__(self, source: str, kept: frozenset[int] = frozenset()) -> None:
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.out: list[bool] = [False]  # stands in or is a part that isn't main text
        self.hard: list[bool] = [False]  # so by its element, role or style, not by words of class or id alone
        self.named: list[int] = []  # nodes with such words
        self.soft: list[int] = []  # of these the nodes of an article with SOFT_WORDS only
        self.kept = kept  # nodes whose words don't count
        self.chars, self.links, self.link_tags = [0], [0], [0]
        self.seen, self.seen_links = [0], [0]  # characters of the node itself, in parts named by class or id too
        self.blocks: list[tuple[int, str]] = []
        self.parse(source)
        if more := self.layout():
            self.__init__(source, kept | more)

    def layout(self) -> frozenset[int]:
        """Nodes whose words of class or id don't tell what isn't main text.

        Those that hold more than half of the page's text, and one of its ``article`` or ``main`` elements with text if
        there is any: their words name the page's layout. And those of SOFT_WORDS in an article that have at least as
        many characters outside links per tag as the article.
        """
        n = len(self.tag)
        held, mains, plain, tags = self.seen[:], [False] * n, [a - b for a, b in zip(self.seen, self.seen_links)], [0] * n
        for node in range(n - 1, 0, -1):
            up = self.parent[node]
            held[up] += held[node]
            plain[up] += plain[node]
            tags[up] += tags[node] + (not self.hard[node])
            mains[up] |= mains[node] or self.tag[node] in MAIN_TAGS and held[node] > 0 and not self.hard[node]
        around = [0] * n  # the article that a node stands in
        for node in range(1, n):
            around[node] = node if self.tag[node] in MAIN_TAGS else around[self.parent[node]]
        dense = [i for i in self.soft if plain[i] * max(1, tags[around[i]]) >= plain[around[i]] * max(1, tags[i])]
        return frozenset([*dense, *(i for i in self.named if 2 * held[i] > held[0] and mains[i] == mains[0])]) - self.kept

    def parse(self, source: str) -> None:
        stack, words, at, in_link, in_main = [0], [], 0, 0, 0
        tag, parent, out = self.tag, self.parent, self.out

        def flush() -> None:
            if words:
                text = " ".join("".join(words).split())
                words.clear()
                if text:
                    self.blocks.append((stack[-1], text))

        opened: dict[str, list[int]] = {}  # by element the places in the stack where one is open
        scopes: list[int] = []  # the same of those that inline end tags don't leave

        def last(*names: str) -> int:
            return max((opened[name][-1] for name in names if opened.get(name)), default=0)

        def pop(to: int) -> None:
            nonlocal in_link, in_main
            for node in reversed(stack[to:]):
                in_link -= tag[node] == "a"
                in_main -= tag[node] in MAIN_TAGS
                opened[tag[node]].pop()
                if tag[node] in SCOPE:
                    scopes.pop()
            del stack[to:]

        match = TOKEN.match
        while m := match(source, at):
            at = m.end()
            if at == m.start():
                break
            if (text := m["text"]) is not None or (text := m["data"]) is not None:
                node = stack[-1]
                if not self.hard[node]:
                    text = html.unescape(text)
                    n = len(text) - sum(map(text.count, " \n\t\r"))
                    self.seen[node] += n
                    self.seen_links[node] += n if in_link else 0
                if not out[node]:
                    words.append(text)
                    self.chars[node] += n
                    self.links[node] += n if in_link else 0
                continue
            if (name := m["close"]) is not None:
                name = name.lower()
                found = last(name)
                if found and (name in BLOCK or not scopes or found > scopes[-1]):  # an inline end tag never closes a block around it
                    if name in BLOCK:
                        flush()
                    pop(found)
                continue
            name = m["open"] if m["open"] is not None else m["torn"]
            if name is None:
                continue
            name, attrs = name.lower(), m["attrs"] if m["open"] is not None else m["rest"]
            if name in BLOCK:
                flush()
                if name in ENDS_P and (found := last("p")) > max(last("li", "td", "th"), scopes[-1] if scopes else 0):
                    pop(found)
                if name in SAME_CLOSES and (found := last(*SAME_CLOSES[name])) > (scopes[-1] if scopes else 0):
                    pop(found)
            elif name == "br":
                words.append(" ")
            node, above = len(tag), stack[-1]
            tag.append(name)
            parent.append(above)
            by_name, by_word = self.aside(name, attrs, in_main > 0)
            if by_word:
                self.named.append(node)
                if by_word == 1 and in_main:
                    self.soft.append(node)
            self.hard.append(self.hard[above] or name in RAW or by_name)
            out.append(out[above] or self.hard[node] or by_word > 0 and node not in self.kept)
            self.seen.append(0)
            self.seen_links.append(0)
            self.chars.append(0)
            self.links.append(0)
            self.link_tags.append(int(name == "a"))
            if name in RAW:
                if not (name in FOREIGN and attrs.rstrip().endswith("/")):
                    at = self.behind(source, name, at)
            elif name not in VOID and not (attrs.rstrip().endswith("/") and name not in BLOCK and name not in ("a", "b", "i", "em", "strong", "span")):
                opened.setdefault(name, []).append(len(stack))
                if name in SCOPE:
                    scopes.append(len(stack))
                stack.append(node)
                in_link += name == "a"
                in_main += name in MAIN_TAGS
        flush()

    @staticmethod
    def behind(source: str, name: str, at: int) -> int:
        """Where a raw element ends that begins before ``at``: behind its end tag, of NESTED ones the one that belongs to it."""
        depth = 1
        for m in re.compile(rf"<(/?){name}(?=[\s/>])({ATTRIBUTES})>", re.IGNORECASE).finditer(source, at):
            if m[1]:
                depth -= 1
            elif name in NESTED and not (name in FOREIGN and m[2].rstrip().endswith("/")):
                depth += 1
            if not depth:
                return m.end()
        return len(source)

    def aside(self, name: str, attrs: str, in_article: bool) -> tuple[bool, int]:
        """Whether element, role or style, and whether words of class or id (2; 1: SOFT_WORDS only) mark what isn't main text."""
        by_word = 0
        if name in ASIDE_TAGS:
            return True, 0
        if name == "header" and not in_article:
            return True, 0
        if not attrs or attrs.isspace() or name in MAIN_TAGS or name in ("html", "body"):
            return False, 0
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                found = set(re.split(r"[^a-z0-9]+", CAMEL.sub("-", value).lower()))
                if not ASIDE_WORDS.isdisjoint(found) or not in_article and not HEADER_WORDS.isdisjoint(found):
                    by_word = 2
                elif not SOFT_WORDS.isdisjoint(found):
                    by_word = max(by_word, 1)
            elif key == "role" and value.lower() in ASIDE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, by_word
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                return True, by_word
        return False, by_word

    def densities(self) -> tuple[list[float], list[float], list[int], list[float]]:
        """Density of each node, sum of its children's densities, its characters, and those outside links per tag; asides count as absent."""
        n = len(self.tag)
        chars, links, link_tags = self.chars[:], self.links[:], self.link_tags[:]
        tags = [0] * n
        for node in range(n - 1, 0, -1):
            if not self.out[node]:
                up = self.parent[node]
                chars[up] += chars[node]
                links[up] += links[node]
                link_tags[up] += link_tags[node]
                tags[up] += tags[node] + 1
        share = links[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for node in range(n - 1, -1, -1):
            c, lc = chars[node], links[node]
            if c and not self.out[node]:
                t, lt = max(1, tags[node]), max(1, link_tags[node])
                weight = math.log(max(1.0, c * t / (max(1, lc) * lt))) / math.log(c * lc / max(1, c - lc) + share * c + math.e)
                density[node] = c / t * weight
                if node:
                    total[self.parent[node]] += density[node]
        return density, total, chars, [(c - lc) / max(1, t) for c, lc, t in zip(chars, links, tags)]

    def main(self) -> str:
        density, total, chars, plain = self.densities()
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        if not total[best]:
            best = 0
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        body = [i for i in path if self.tag[i] not in ("#root", "html")] or [0]
        least, least_plain = min(density[i] for i in body), min(plain[i] for i in body)
        holders = [i for i in path if self.tag[i] in MAIN_TAGS]
        chosen = {holders[-1] if holders else best}
        if not holders:
            inner = [i for i, t in enumerate(self.tag) if t in MAIN_TAGS and not self.out[i] and self.under(i, best)]
            inner = [i for i in inner if 2 * chars[i] >= chars[best]]
            if inner:
                chosen = {inner[0]}
            elif best:
                top = self.parent[best]
                beside = [i for i in range(top + 1, best) if self.parent[i] == top and chars[i] and not self.out[i]]
                chosen |= {i for i in beside if self.tag[i] == "h1" or self.tag[i] in ("h2", "header") and density[i] >= least}
        # density grows with size, so a short article beside a long one is held to its characters per tag
        dense = [density[i] >= least or self.tag[i] in MAIN_TAGS and plain[i] >= least_plain for i in range(len(density))]
        taken = self.spread(chosen, [d and i > 0 and not self.out[i] and chars[i] > 0 for i, d in enumerate(dense)])
        return "\n\n".join(text for node, text in self.blocks if not self.out[node] and taken[node])

    def spread(self, chosen: set[int], dense: list[bool]) -> list[bool]:
        """The nodes of ``chosen`` and of the topmost dense subtrees that hold none of them."""
        above = set()
        for node in chosen:
            while node > 0 and (node := self.parent[node]) not in above:
                above.add(node)
        taken = []
        for node, up in enumerate(self.parent):
            taken.append(node in chosen or up >= 0 and taken[up] or dense[node] and node not in above)
        return taken

    def under(self, node: int, top: int) -> bool:
        while node > top:
            node = self.parent[node]
        return node == top


def main_text(source: str) -> str:
    return Page(source).main() if source else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its code points, to each row, without a shuffle.

    Null and empty pages have an empty text, as have pages without text; a page without elements is
    its own main text. Nothing is capped. Repeated rows are read each; columns of these names are
    replaced.
    """
    pages = pages.drop(*[c for c in ("text", "n_chars") if c != column])
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py() or "") for value in batch.column(batch.schema.get_field_index(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return arrow_map(pages, run, schema)


def op7_extract(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

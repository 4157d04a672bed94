"""Main text of web pages by site style trees.

1. Every page becomes a list of style nodes. A style node is an element's place
   as tags and classes from the root (digits blanked); elements of one page with
   the same place are one node.
2. The pages of a host are merged: for each style node, beside how many distinct
   articles it occurs, how its sequences of children differ (presentation) and how
   its contents differ (content). Both importances are entropies over the base of
   that count: 0 if all agree, 1 if all differ. What a node stands beside is known
   by the longest block of the page's article outside of the node; equal contents
   with ``SHARE`` of the article or more are copies of it and count once. So copies
   that differ in a date, an advert or a comment say nothing about the article's
   own nodes, with or without a mark.
3. Composite importance = GAMMA * presentation + (1 - GAMMA) * content. What tags,
   roles, ids and classes name as navigation, notice, advert, form and the like
   has importance 0 from the start, so hosts with few pages are served too. A name
   is a whole class or id, or the last word of a compound that says more than what
   kind of box it is. However long it is, it stays noise beside any other text. Only
   where a page would be left empty, measured importance decides: named elements (not
   adverts and comments) come back if they have ``HIGH`` importance beside
   ``LEAST_PAGES`` distinct articles; so does a nameless form around all there is.
   A name that suits a frame (or any, if nothing else is left) says nothing about
   what the only marked article, with ``MOST`` of the text, stands in.
4. Each page is read again without its low-importance branches. Where the page
   marks its article, its text is what stands there; the article's own plain
   paragraphs, lists and headings are protected, because copies of one article
   on a host say nothing about noise; so is what the article stands in, and the
   page's body as such.

Statistics are grouped counts of hashes; a host's result is its set of
low-importance nodes. All sets travel with the tasks while they are at most
``PLACES_SENT`` places; beyond, a host's set meets its pages in groups of about
``GROUP_PAGES`` of them, so that a large host is no single task.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, written

GAMMA = 0.4
LOW = 0.2
HIGH = 0.5
LEAST_PAGES = 4
SHARE = 2 / 3
MOST = 1 / 2
PLACES_SENT = 1 << 20
GROUP_PAGES = 512

# Kinds of HTML elements, and names that mark noise.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template object svg canvas annotation annotation-xml xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mtable mtr mtd mstyle mpadded semantics".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr".split()) | INLINE
NOISE_TAGS = frozenset("nav footer aside form button select option dialog menu head header fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
SOFT_TAGS = frozenset("form header fieldset".split())
STRICT_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus replies".split())
NOISE_NAMES = frozenset(
    "promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe share sharing social sidebar related recommended recommendations breadcrumb breadcrumbs pagination pager login signup paywall skip".split()
)
WEAK_NAMES = frozenset("header footer nav navbar navigation menu notice notification alert banner widget toolbar side bottom masthead copyright".split())
NAV_NAMES = frozenset("footer nav navbar navigation menu toolbar copyright".split())
MAIN_NAMES = frozenset("article content post entry main body story text".split())
STATE_WORDS = frozenset("has no with without is not non how js show hide".split())
FRAME_WORDS = frozenset("wrap wrapper container layout page grid outer".split())
BOX_WORDS = FRAME_WORDS | MAIN_NAMES | frozenset(
    "inner box block section area list item items link links button buttons posts articles bar panel group unit slot row col column left right top primary secondary holder form icon icons thread to".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=65_536)
def _named(names: str, only_class: bool) -> int:
    """What classes and ids, one to a line, say: 3 advert or comment, 2 other noise, 1 noise
    or a frame, 0 nothing."""
    kinds, main = {0}, False
    for name in names.split("\n")[: 1 if only_class else 2]:
        for token in name.split():
            words = [w.lower() for w in _NAME_PARTS.findall(token)]
            if not words or words[0] in STATE_WORDS:
                continue
            told = list(words)
            while told and told[-1] in BOX_WORDS:
                told.pop()
            if not told:
                main = main or words[-1] in MAIN_NAMES
                continue
            frame = FRAME_WORDS & set(words[len(told) :]) and MAIN_NAMES & set(told)
            last = told[-1]
            if frame:
                continue
            if last in STRICT_NAMES:
                kinds.add(3)
            elif last in NOISE_NAMES:
                kinds.add(2)
            elif last in WEAK_NAMES and (last in NAV_NAMES or not (MAIN_NAMES - {"main"}) & set(told)) and not only_class:
                kinds.add(-1)
    return max(kinds) or int(-1 in kinds and not main)


class Node:
    """A style node on a page. own: 1 noise by a name or tag that suits frames too, 2 by
    another name, 3 by the name of an advert or comment, 4 by other tags, roles and
    styles."""

    __slots__ = ("tag", "place", "parent", "noise", "own", "mark", "main", "named", "start", "end", "children")

    def __init__(self, tag: str, place: int, parent: Node | None, own: int, mark: bool, named: bool, start: int):
        self.tag, self.place, self.parent, self.own, self.mark, self.named, self.start = tag, place, parent, own, mark, named, start
        self.end, self.children = start, []
        self.settle()

    def settle(self) -> None:
        """Takes over what the parent is."""
        self.noise = self.own > 0 or self.parent is not None and self.parent.noise
        self.main = self.mark and not self.own or self.parent is not None and self.parent.main


def _judge(tag: str, attributes: dict, inside: bool) -> tuple[str, int, bool]:
    """Style key, own noise and main mark of an element; inside: of a main element."""
    role = (attributes.get("role") or "").lower()
    mark = tag in ("article", "main") or role in ("main", "article") or "articleBody" in (attributes.get("itemprop") or "")
    noise = tag in NOISE_TAGS and not (tag == "header" and inside) or role in NOISE_ROLES
    noise = (1 if tag in SOFT_TAGS or role == "form" else 4) if noise else 0
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true" or _HIDDEN.search(attributes.get("style") or ""):
        noise = 4
    names = f"{attributes.get('class') or ''}\n{attributes.get('id') or ''}"
    if len(names) > 1 and noise < 4 and tag not in ("html", "body"):
        noise = max(noise, _named(names, mark))
    key = tag if not attributes else f"{tag}.{' '.join(sorted(_DIGITS.sub('#', attributes.get('class') or '').split()))}#{_DIGITS.sub('#', attributes.get('id') or '')}"
    return key, noise, mark


class Page:
    """The style nodes and text blocks of one page."""

    def __init__(self, source: str, places: dict):
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self.blocks: list[tuple[Node, str]] = []
        self.places, self.parts = places, []
        self.top = self.open("#page", "#page", None, 0, False, False)
        self.read(source)
        while self.top:
            self.close(self.top)
        self.marked = any(n.main and not n.noise and n.start < n.end for n in self.nodes)
        if not self.marked:
            self.unwrap()

    def sizes(self, least: int) -> tuple[list[int], dict[int, bool]]:
        """Running sum of the blocks' lengths outside of nodes whose own noise is ``least`` or more, and those nodes."""
        hard: dict[int, bool] = {}
        for n in self.nodes:
            hard[id(n)] = n.own >= least or n.parent is not None and hard[id(n.parent)]
        return [0, *accumulate(0 if hard[id(n)] else len(t) for n, t in self.blocks)], hard

    def large(self) -> set[int]:
        """Named nodes with MOST of the page's text. They may be the article, so distinct
        articles are told by them; only what is then measured brings them back."""
        until, hard = self.sizes(3)
        return {id(n) for n in self.nodes if 0 < n.own < 3 and not hard[id(n)] and 0 < until[-1] * MOST <= until[n.end] - until[n.start]}

    def unwrap(self) -> None:
        """Frees the marked article from the names of what it stands in."""
        until, hard = self.sizes(2 if any(not n.noise for n, _ in self.blocks) else 3)
        tops = [n for n in self.nodes if n.mark and n.own == 0 and not hard[id(n)] and until[n.end] - until[n.start] >= MOST * until[-1] > 0]
        if tops:
            around = tops[0].parent
            while around:
                around.own, around = 0, around.parent
            for n in self.nodes:
                n.settle()
            self.marked = True

    def open(self, tag: str, key: str, parent: Node | None, own: int, mark: bool, named: bool) -> Node:
        at = (parent.place if parent else 0, key)
        if (place := self.places.get(at)) is None:
            if len(self.places) > 200_000:
                self.places.clear()
            self.places[at] = place = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"), at[0] % 2**63)
        node = Node(tag, place, parent, own, mark, named, len(self.texts))
        if parent:
            parent.children.append(key)
        self.nodes.append(node)
        return node

    def close(self, node: Node) -> None:
        """Closes the open elements up to ``node``."""
        while True:
            top = self.top
            if top.tag not in INLINE:
                self.flush()
            top.end = len(self.texts)
            self.top = top.parent
            if top is node:
                return

    def flush(self) -> None:
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        text = " ".join("".join([t for t, _ in parts]).split())
        if text:
            node = self.whole([n for t, n in parts if t and not t.isspace()])
            self.blocks.append((node, text))
            self.texts.append(text)
            while node.tag in INLINE and node.parent:
                node.end, node = max(node.end, len(self.texts)), node.parent

    def whole(self, nodes: list[Node]) -> Node:
        """The innermost element that holds a whole block: its block element or an inline one."""
        node = nodes[0]
        for other in nodes[1:]:
            if other is not node:
                chain = {id(other)}
                while other.tag in INLINE and other.parent:
                    other = other.parent
                    chain.add(id(other))
                while id(node) not in chain and node.tag in INLINE and node.parent:
                    node = node.parent
        return node

    def find(self, tags: set | frozenset, stop: set | frozenset = frozenset()) -> Node | None:
        node = self.top
        while node.parent:
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
            node = node.parent
        return None

    def text(self, raw: str) -> None:
        if raw:
            node = self.top
            while node.tag in INLINE:
                if node.own == 4:  # hidden words of a block
                    return
                node = node.parent
            self.parts.append((entities.unescape(raw) if "&" in raw else raw, self.top))

    def read(self, source: str) -> None:
        at, lower = 0, None
        for_tag = _TAG.search
        while m := for_tag(source, at):
            self.text(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self.parts.append((m[0][9:].removesuffix("]]>"), self.top))
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if (node := self.find({tag}, SCOPES.get(tag, frozenset()) - {tag})) is not None:
                    self.close(node)
                continue
            if tag in RAW:
                lower = source.lower() if lower is None else lower
                if len(lower) != len(source):  # a few letters change their length
                    end = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                    end = end.start() if end else -1
                else:
                    end = lower.find(f"</{tag}", at)
                at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
                continue
            if tag in ("br", "wbr", "img"):
                if tag == "br":
                    self.parts.append((" ", self.top))
                continue
            if tag not in INLINE:
                self.flush()
            if tag in ENDS_P and (p := self.find({"p"}, {"table", "td", "th", "button"})) is not None:
                self.close(p)
            if tag in CLOSES:
                while (old := self.find(CLOSES[tag], SCOPES.get(tag, frozenset()))) is not None:
                    self.close(old)
            if tag in VOID:
                continue
            raw = m[3] or m[6]
            attributes = {a[1].lower(): next((entities.unescape(x) for x in a.groups()[1:] if x is not None), "") for a in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}
            parent = self.top
            if tag in ("html", "body") and not attributes.get("role"):
                key, noise, mark = tag, 0, False
            else:
                key, noise, mark = _judge(tag, attributes, parent.main)
            self.top = self.open(tag, key, parent, noise, mark, bool(attributes.get("class") or attributes.get("id")))
        self.text(source[at:])

    def styles(self) -> list[tuple[int, int, int, int, bool]]:
        """(beside, place, presentation, content, named) of each style node, three of
        them as hashes; beside: the longest block of the article outside of it, 0 for what
        is the article itself; named: whether only a name makes it noise."""
        found: dict[int, list] = {}
        large, noise = self.large(), {}
        for n in self.nodes:
            noise[id(n)] = n.own > 0 and id(n) not in large or n.parent is not None and noise[id(n.parent)]
        sizes = [len(t) if not noise[id(n)] and (n.main or not self.marked) else 0 for n, t in self.blocks]
        until = [0, *accumulate(sizes)]
        order = sorted((i for i, n in enumerate(sizes) if n), key=lambda i: (-sizes[i], i))
        for n in self.nodes:
            if (got := found.get(n.place)) is None:
                got = found[n.place] = [xxhash.xxh3_64(), xxhash.xxh3_64(), 0, [], 0 < n.own < 3]
            got[2] += until[n.end] - until[n.start]
            got[3].append((n.start, n.end))
            last = None
            for c in n.children:
                if c != last:
                    got[0].update(c.encode("utf-8", "surrogatepass") + b"\0")
                last = c
            for t in self.texts[n.start : n.end]:
                got[1].update(t.encode("utf-8", "surrogatepass") + b"\0")
        hashes: dict[int, int] = {}

        def beside(size: int, spans: list) -> int:
            if size >= SHARE * until[-1]:
                return 0
            at = order[0]
            if any(a <= at < b for a, b in spans):
                inside = {i for a, b in spans for i in range(a, b)}
                at = next(i for i in order if i not in inside)
            if at not in hashes:
                hashes[at] = xxhash.xxh3_64_intdigest(self.texts[at].encode("utf-8", "surrogatepass")) - 2**63
            return hashes[at]

        return [(beside(size, spans), p - 2**63, a.intdigest() - 2**63, b.intdigest() - 2**63, named) for p, (a, b, size, spans, named) in found.items()]

    def main_text(self, low: set[int], high: set[int] | tuple = ()) -> str:
        """Blocks left without noise and the host's low-importance places; if there are
        none, with the named places of high importance, or else with plain forms."""
        around: set[int] = set()  # what an article stands in
        for n in self.nodes:
            if n.main and not n.parent.main:
                while n.parent and id(n.parent) not in around:
                    n = n.parent
                    around.add(id(n))

        def left(back) -> list[str]:
            gone: dict[int, bool] = {}
            for n in self.nodes:
                shielded = n.main and (n.tag in PLAIN and not n.named or not n.parent.main) or id(n) in around or n.tag in ("#page", "html", "body")
                own = n.own > 0 and not back(n) or n.place - 2**63 in low and not shielded
                gone[id(n)] = own or n.parent is not None and gone[id(n.parent)]
            return [t for n, t in self.blocks if not gone[id(n)] and (n.main or not self.marked)]

        found = left(lambda n: False)
        if not found and self.blocks:
            found = left(lambda n: n.own < 3 and n.place - 2**63 in high) or left(lambda n: n.own == 1 and n.tag == "form")
        return "\n".join(found)


def host_of(url: str):
    """Host of a URL column, lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def style_importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, place, pages, presentation, content, importance, named) of every style node.

    Pages without a host or html are left out. ``pages`` counts distinct articles
    beside the node; copies of a page on a host count once.
    """

    def run(batches):
        places: dict = {}
        for batch in batches:
            host, out = batch.column(1).to_pylist(), []
            for i, source in enumerate(batch.column(0).to_pylist()):
                out += [(host[i], *s) for s in Page(source, places).styles()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 4, pa.bool_()), strict=True)], ["host", "beside", "place", "children", "texts", "named"])

    own = pages.select(F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host")).where("html is not null and host is not null")
    nodes = spread(own).mapInArrow(run, "host string, beside long, place long, children long, texts long, named boolean").distinct()
    nodes = nodes.groupBy("host", "place", "children", "texts").agg(F.count("*").alias("n"), F.bool_or("named").alias("named"))

    def entropy(of: str) -> DataFrame:
        n = nodes.groupBy("host", "place", of).agg(F.sum("n").alias("n"), F.bool_or("named").alias("named"))
        n = n.groupBy("host", "place").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.bool_or("named").alias("named"))
        return n.select("host", "place", "named", "pages", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias(of))

    both = entropy("children").join(entropy("texts").drop("pages", "named"), ["host", "place"])
    return both.select(
        "host", "place", "pages", F.col("children").alias("presentation"), F.col("texts").alias("content"), (GAMMA * F.col("children") + (1 - GAMMA) * F.col("texts")).alias("importance"), "named"
    )


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW, least_pages: int = LEAST_PAGES, places_sent: int = PLACES_SENT, high: float = HIGH,
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null, empty or noise-only page has text "" and n_chars 0. A null or odd URL
    has no host, so only the page itself is looked at. Repeated rows give repeated
    results. Broken markup is read as far as it goes; other columns are not read.
    """
    strong = F.col("named") & (F.col("importance") >= high)
    told = style_importance(pages, url_col, html_col).where((F.col("pages") >= least_pages) & ((F.col("importance") < low) | strong))
    told = written(told.select("host", "place", strong.alias("strong")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), F.coalesce(host_of(url_col), F.lit("")).alias("host"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long"

    def columns(of, places: dict, told: list) -> list[pa.Array]:
        texts = [Page(s, places).main_text(*t) if s else "" for s, t in zip(of.column("html").to_pylist(), told, strict=True)]
        return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    if told.count() <= places_sent:
        held: dict[str, tuple[set, set]] = {}
        for r in told.collect():  # at most places_sent
            held.setdefault(r.host, (set(), set()))[r.strong].add(r.place)
        shared = pages.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            places: dict = {}
            for batch in batches:
                own = [shared.value.get(h, ((), ())) for h in batch.column("host").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns(batch, places, own)], ["page_id", "url", "text", "n_chars"])

        return spread(rows).mapInArrow(run, schema)

    groups = written(rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).cast("int").alias("groups")))
    part = F.pmod(F.xxhash64("page_id", "url", "html"), F.col("groups")).cast("int").alias("part")
    left = rows.join(groups, "host").select("page_id", "url", "html", "host", part)
    right = told.join(groups, "host").select("host", "place", "strong", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))

    def meet(own: pa.Table, told: pa.Table) -> pa.Table:
        both: tuple[set, set] = set(), set()
        for place, strong in zip(told.column("place").to_pylist(), told.column("strong").to_pylist(), strict=True):
            both[strong].add(place)
        return pa.Table.from_arrays([own.column("page_id"), own.column("url"), *columns(own, {}, [both] * own.num_rows)], ["page_id", "url", "text", "n_chars"])

    return left.groupBy("host", "part").cogroup(right.groupBy("host", "part")).applyInArrow(meet, schema)

"""Main text of web pages: structure drops what is never text, and subtrees that recur on a host are removed as its template.

First pass: each page's element subtrees are hashed, and Spark counts per host on how many pages of different text each occurs.
Second pass: pages are parsed again with their host's template hashes, and those subtrees are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, spread

#: A subtree belongs to a host's template if it is on at least so many pages of different main text. The share only bounds a
#: host's list: to 200 times the mean number of subtrees on a page.
LEAST_PAGES, LEAST_SHARE = 3, 0.005
#: Rows of a host meet its template under so many keys that no key has more than one in PARTS times the partitions of all rows.
PARTS = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Never part of the main text, wherever they stand.
DROPPED = frozenset("head script style noscript iframe template svg math canvas object audio video nav footer aside form button select textarea input dialog menu title noembed noframes fieldset map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Text-flow elements: inside an article they are never taken for a template, as sentences recur on their own.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th tr caption figcaption article main body html".split())
#: Elements whose text is part of a sentence, and the elements of an article that hold sentences; within these the former are exempt as well.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
SENTENCES = FLOW - frozenset("article main body html tr".split())
#: An open element of a key ends when one of its set begins, unless a bound stands between.
ENDS = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot", "thead"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}), "option": frozenset({"option", "optgroup"}), "p": BLOCK - {"option", "body", "html", "head", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"},
}
BOUNDS = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "option": frozenset({"select"}), "p": frozenset("button table td th object".split())}
#: Words in class, id or role that mark menus, notices, adverts, comments and the like.
MARKED = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:s|tion)?|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|signup|paywall|popup|modal|overlay|sidebars?|menus?|menubar|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|"
    r"masthead|topbar|footers?|colophon|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|recommended|widgets?|complementary|contentinfo|search|skip|login)(?:$|[\s_\-])",
    re.I,
)
#: In an article only a whole name of one of these marks a part, and no id but the first few: sections have their subjects as ids, and names such as social-history.
WITHIN = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe signup paywall popup modal overlay sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar "
    "masthead topbar footer colophon comment comments commentlist disqus replies reply respond share sharing social related recommended widget notice complementary contentinfo".split()
)
IDS = frozenset("comments commentlist disqus respond sidebar newsletter paywall".split())
#: An attribute by the HTML rules: a name, and a value that may stand in quotes; quotes elsewhere are letters like any other.
#: A quote that is never closed is one too, so that it does not take the rest of the page.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^\s>"'][^\s>]*+))?+"""
TAG = re.compile(rf"<(?:(!--)|(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)>|([!?/])|(/?[A-Za-z]))")
MARKS = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
COMMENT_END = re.compile(r"--!?>")
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A7C9E1


@dataclass
class Node:
    """An open element: where its events and its blocks begin, and whether it is dropped or holds main text."""

    tag: str
    event: int
    hashed: int
    dropped: bool
    main: int
    start: tuple[int, int] = (0, 0)
    sentence: bool = False


def _marked(attributes: str, within: bool) -> bool:
    """Whether an element is marked as no main text; ``within`` an article or main only plainly."""
    for name, a, b, c in MARKS.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            if within:
                if not (IDS if name == "id" else WITHIN).isdisjoint(value.lower().split()):
                    return True
            elif MARKED.search(value):
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


#: End tags of these don't reach beyond an open one of PARTS_OF_PAGE.
LOCAL = frozenset("p div section span li ul ol".split())
PARTS_OF_PAGE = frozenset("article main body td th nav footer aside form".split())


class Page:
    """One pass over a page: its blocks of text in order, and the hash of every subtree outside dropped parts.

    ``template`` holds hashes of subtrees to leave out. Subtree hashes are ranges of one running hash over tags and
    text, so deep nesting costs no more than flat pages.
    """

    def __init__(self, source: str, template: frozenset[int] = frozenset()) -> None:
        self.source, self.template = source, template
        self.blocks: list[tuple[str, int]] = []  # text and its level: 2 in an article, 1 in main, 0 elsewhere
        self.hashes: list[int] = []
        self.stack: list[Node] = []
        self.buffer: list[str] = []
        self.running, self.power = 0, [1]
        self.events = 0
        self.places: dict[str, list[int]] = {}  # of a tag's open elements in the stack
        self.open_blocks: list[int] = []
        self._read()

    def _last(self, tags: frozenset[str]) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((own[-1] for tag in tags if (own := self.places.get(tag))), default=-1)

    def _event(self, what: str) -> None:
        self.running = (self.running * BASE + xxhash.xxh64_intdigest(what)) % PRIME
        self.events += 1
        self.power.append(self.power[-1] * BASE % PRIME)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            self.buffer.clear()
            if text:
                self.blocks.append((text, self.stack[-1].main if self.stack else 0))

    def _open(self, tag: str, attributes: str) -> None:
        for open_tag, starters in ENDS.items():
            if tag in starters and (own := self.places.get(open_tag)) and own[-1] > self._last(BOUNDS[open_tag]):
                self._close_to(own[-1])
        block = tag in BLOCK
        if block:
            self._flush()
        up = self.stack[-1] if self.stack else None
        dropped = bool(up and up.dropped) or tag in DROPPED or tag not in ("body", "html", "article", "main") and bool(attributes) and _marked(attributes, bool(up and up.main))
        if tag == "article" and attributes and _marked(attributes, False):
            dropped = True  # a reader's comment is often an article of its own
        main = up.main if up else 0
        if tag == "header" and main == 0:
            dropped = True  # a site's header; an article's own holds its title
        if tag == "article":
            main = 2
        elif tag == "main" or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I):
            main = max(main, 1)
        if not dropped:
            node = Node(tag, self.events, self.running, dropped, main)
            self._event(f"<{tag}")
            node.start = (len(self.blocks), len(self.buffer))
        else:
            node = Node(tag, self.events, self.running, dropped, main)
        node.sentence = main > 0 and (tag in SENTENCES or tag in INLINE and up is not None and up.sentence)
        self.places.setdefault(tag, []).append(len(self.stack))
        if block:
            self.open_blocks.append(len(self.stack))
        self.stack.append(node)

    def _close_to(self, at: int) -> None:
        """Close the open elements from the innermost to the one at ``at``."""
        while len(self.stack) > at:
            node = self.stack[-1]
            if node.tag in BLOCK:
                self._flush()
            if not node.dropped:
                self._event(">")
                own = (self.running - node.hashed * self.power[self.events - node.event]) % PRIME
                if not (node.main and node.tag in FLOW) and not (node.sentence and node.tag in INLINE) and node.tag not in ("body", "html", "article", "main"):
                    self.hashes.append(own)
                    if own in self.template:
                        blocks, pieces = node.start
                        del self.blocks[blocks:]
                        del self.buffer[pieces:]
            self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.open_blocks.pop()

    def _text(self, low: int, high: int) -> None:
        if low < high and not (self.stack and self.stack[-1].dropped):
            raw = self.source[low:high]
            self.buffer.append(raw)
            if words := raw.split():
                self._event(" ".join(words))

    def _read(self) -> None:
        source, at, text_from = self.source, 0, 0
        find = TAG.search
        while m := find(source, at):
            low, at = m.start(), m.end()
            comment, slash, tag, attributes, other, cut = m.groups()
            if cut is not None:  # "<" and a letter but no ">" after it: an unfinished tag reaches to the end
                self._text(text_from, low)
                text_from = len(source)
                break
            self._text(text_from, low)
            if comment:
                end = COMMENT_END.search(source, at - 1 if source.startswith(">", at) else at)
                at = end.end() if end else len(source)
            elif other is not None:
                end = source.find(">", at)
                at = end + 1 if end >= 0 else len(source)
            else:
                tag = tag.lower()
                if slash:
                    self._end(tag)
                else:
                    if tag == "br":
                        if self.buffer:
                            self.buffer.append(" ")
                    elif tag in VOID:
                        if tag == "hr":
                            self._flush()
                    else:
                        self._open(tag, attributes)
                        if tag in RAW:
                            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                            at = end.start() if end else len(source)
                            if self.stack[-1].dropped:
                                text_from = at
                                continue
            text_from = at
        self._text(text_from, len(source))
        self._close_to(0)
        self._flush()

    def _end(self, tag: str) -> None:
        own = self.places.get(tag)
        if not own:
            return
        if tag not in BLOCK and self.open_blocks and self.open_blocks[-1] > own[-1]:
            return  # an inline end tag closes nothing beyond its block
        if tag in LOCAL and self._last(PARTS_OF_PAGE) > own[-1]:
            return  # nor does a stray end tag close a part of the page
        self._close_to(own[-1])

    def text(self) -> str:
        """Blocks of the article, or of main where there is none, or else of all that isn't dropped; two line ends between.

        Where main has more text of its own than in its articles, these are cards beside the text, and main's own counts.
        """
        size = [0, 0, 0]
        for text, level in self.blocks:
            size[level] += len(text)
        best = 1 if size[1] > size[2] else 2 if size[2] else 0
        return "\n\n".join(t for t, level in self.blocks if level == best)


def host_of(url: str = "url") -> F.Column:
    """Host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, template)`` from ``(page_id, url, html, host)``: the sorted hashes of subtrees that recur on the host.

    Pages of the same main text count once, so that copies of an article, in other surroundings too, don't make a template
    of it. Pages without a host have no template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hosts, prints, own = [], [], []
            for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                hosts.append(host)
                page = Page(source)
                prints.append(xxhash.xxh64_intdigest(page.text() or source) - (1 << 63))
                own.append([0, *set(page.hashes)])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(prints, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["host", "page", "subtrees"])

    seen = pages.where("host <> ''").select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "host string, page long, subtrees array<long>")
    counted = seen.dropDuplicates(["host", "page"]).select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    counted = materialize(counted.where(f"n >= {LEAST_PAGES} or subtree = 0"), "subtrees")
    all_ = counted.where("subtree = 0").select("host", F.col("n").alias("pages"))  # 0 stands for the page itself
    recur = counted.where("subtree <> 0").join(all_, "host").where(f"n >= {LEAST_SHARE} * pages")
    return recur.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("template"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``.

    The text is the article's (else main's, else the body's; see ``Page.text`` for cards beside main's text) without menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles, comments and the host's template; references are decoded, white space inside a block is one
    blank, blocks are joined by two line ends. Null or empty html: empty text. Rows with a null id or url stay; repeated rows
    stay repeated. An unfinished tag at the end of a cut page is no text.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    own = own.withColumn("host", host_of())
    # hosts that need several keys: at most PARTS times the number of partitions
    counted = materialize(own.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    most = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // (PARTS * spread(own.sparkSession))))
    large = F.broadcast(counted.where(f"n > {most}").selectExpr("host", f"cast(ceil(n / {most}) as int) as salts"))
    pages_ = own.join(large, "host", "left").selectExpr("host", "cast(pmod(xxhash64(page_id, url), coalesce(salts, 1)) as int) as salt", "1 as kind", "page_id", "url", "html", "cast(null as array<long>) as template")
    nothing = ("cast(null as long) as page_id", "cast(null as string) as url", "cast(null as string) as html")
    heads = templates(own).join(large, "host", "left").selectExpr("host", "explode(sequence(0, coalesce(salts, 1) - 1)) as salt", "0 as kind", *nothing, "template")
    # a host's template comes once before its pages, not with each of them
    met = pages_.unionByName(heads).repartition(spread(own.sparkSession), "host", "salt").sortWithinPartitions("host", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, template = None, frozenset()
        for part in slices(batches):
            page_ids, urls, texts = [], [], []
            for own_host, kind, page_id, url, source, hashes in zip(*(part.column(c).to_pylist() for c in ("host", "kind", "page_id", "url", "html", "template")), strict=True):
                if own_host != host:
                    host, template = own_host, frozenset()
                if kind == 0:
                    template = frozenset(hashes)
                    continue
                page_ids.append(page_id)
                urls.append(url)
                texts.append(Page(source or "", template).text())
            yield pa.RecordBatch.from_arrays([pa.array(page_ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")

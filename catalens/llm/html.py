"""Main-text extraction from web pages by consensus of each host's container paths.

Every page is read into a light tree. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments are left out by their tags and by
the words of their class, id and role. Containers are scored by the text that
remains (outside links): the page votes for the path of its best container, tags
with their classes, digits generalised. Votes are counted per host in Spark, and
every page is read again with its host's paths. A path that a tenth of a host's pages,
and at least two, vote for is a template of the host: pages that vote for it keep it.
Other pages take the winning path, but their own best container where the winning
path has less than two fifths of its text.

Host, path and place of every page are written, so that votes are counted and
winners brought back without moving pages: winners are broadcast to the second
scan where they have at most ``BROADCAST_BYTES``, else each page's winner goes to
the scan of its file in blocks of bounded bytes (``common.met``).

Defined cases: a null or empty page gives an empty text; a null url, or one
without a host, belongs to the empty host; unclosed and stray tags are mended as
browsers do, roughly; equal votes go to the path of more text, then to the path
first in byte order; repeated rows are pages of their own; an empty table gives
an empty result; extra columns are ignored; pages may be of any length and depth:
a node holds a hash of its path, the path is only spelt for the container chosen.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens import shared
from catalens.llm.common import boxed, met, scanned, ship, slices
from catalens.shared import materialize

#: A path is a template of its host where one in so many of the pages, and at least so many pages, vote for it.
TEMPLATES, TEMPLATE_PAGES = 10, 2
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|hidden|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SKIPPED = frozenset("head nav footer aside form script style noscript iframe svg button select option textarea template title dialog menu canvas object embed audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body center".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption".split())
#: An opening tag ends the open tags beside it, up to the tags that hold it.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
#: Words of a class, id or role that mark what is no main text.
MARKS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adbox adslot banner promo promoted promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification notifications popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager nav navbar navigation navigations menu menus menubar topbar toolbar header masthead footer "
    "sidebar sidebars aside widget widgets login signin signup search searchbox copyright legal skip complementary contentinfo alert alertdialog dialog".split()
)
TALK = frozenset("comment comments commentlist disqus reply replies respond discussion reviews".split())
GOOD = frozenset("article post entry content story main articlebody body text maincontent blogpost".split())


class Node:
    __slots__ = ("tag", "words", "step", "key", "parent", "skip", "own", "text", "depth", "good", "link", "marked")

    def __init__(self, tag, words, step, parent):
        self.tag, self.words, self.step, self.parent = tag, words, step, parent
        self.key = onward(parent.key, step) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.skip = self.link = self.marked = False
        self.own = self.text = self.good = 0

    @property
    def path(self) -> str:
        """The steps from the root down, spelt out."""
        steps, n = [], self
        while n.parent is not None:
            steps.append(n.step)
            n = n.parent
        return "".join(f">{x}" for x in reversed(steps))


def onward(key: int, step: str) -> int:
    """The key of a path and one more step."""
    return xxhash.xxh64_intdigest(step.encode("utf-8", "replace"), key)


def key_of(path: str) -> int:
    key = 0
    for step in path.split(">")[1:]:
        key = onward(key, step)
    return key


def attributes(raw: str) -> tuple[frozenset, str, bool]:
    """Words of class, id and role; the generalised class; whether the element is hidden."""
    hidden = bool(HIDDEN.search(raw))
    if "=" not in raw:
        return frozenset(), "", hidden
    words: set[str] = set()
    name = ""
    for key, value in ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'")
        if key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
            continue
        words.update(w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w)
        if key == "class":
            name = re.sub(r"\d+", "#", ".".join(sorted(value.lower().replace(">", " ").split())))
    return frozenset(words), name, hidden


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Nodes, parents first, and the page's texts and block bounds (None) in order with their nodes."""
    root = Node("#", frozenset(), "", None)
    nodes, items, top, at = [root], [], root, 0
    open_tags: Counter = Counter()  # so that a tag that isn't open is not looked for
    lower = None
    end = len(page)
    find = TOKEN.search

    def put(text, node):
        if text:
            items.append((node, text))

    def up_to(node):
        """Close all open tags below ``node``."""
        nonlocal top
        while top is not node:
            open_tags[top.tag] -= 1
            top = top.parent

    while at < end:
        m = find(page, at)
        if m is None:
            put(page[at:], top)
            break
        if m.start() > at:
            put(page[at : m.start()], top)
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        closing, rest = (m.group(1), m.group(3)) if m.group(2) else (m.group(4), m.group(6))
        tag = tag.lower()
        if closing:
            n = top if open_tags[tag] else root
            while n is not root and n.tag != tag:
                n = n.parent
            if n is not root:
                up_to(n.parent)
                if tag in BLOCKS:
                    items.append((top, None))
            continue
        if tag in CLOSES_P and open_tags["p"]:
            n = top
            while n is not root and n.tag != "p" and n.tag not in ("div", "td", "th", "li", "article", "section", "body", "button"):
                n = n.parent
            if n.tag == "p":
                up_to(n.parent)
        if tag in ENDS and any(open_tags[x] for x in ENDS[tag][0]):
            closes, holders = ENDS[tag]
            n = last = top
            while n is not root and n.tag not in holders:
                if n.tag in closes:
                    last = n.parent
                n = n.parent
            up_to(last)
        if tag in ("html", "body") and any(x.tag == tag for x in nodes[:6]):
            continue
        words, name, hidden = attributes(rest) if rest else (frozenset(), "", False)
        node = Node(tag, words, f"{tag}.{name}" if name else tag, top)
        node.skip = hidden
        nodes.append(node)
        if tag in BLOCKS or tag in ("script", "style"):
            items.append((top, None))
        elif tag == "br":
            items.append((top, " "))
        if tag in RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != end:
                    lower = re.sub("[A-Z]+", lambda x: x.group().lower(), page)
            stop = lower.find(f"</{tag}", at)
            stop = end if stop < 0 else stop
            put(page[at:stop], node)
            close = page.find(">", stop)
            at = end if close < 0 else close + 1
            continue
        if tag not in VOID and not (rest and rest.rstrip().endswith("/") and tag in ("svg", "path")):
            top = node
            open_tags[tag] += 1
    return nodes, items


def judged(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The page's tree with what is no main text marked (``skip``) and its text measured (``good``)."""
    nodes, items = parse(page)
    for node, text in items:
        if text:
            node.text += len(text.strip())
    for n in reversed(nodes[1:]):
        if n.tag not in RAW:
            n.parent.text += n.text
    whole = max(1, next((n.text for n in nodes if n.tag == "body"), nodes[0].text))
    for n in nodes[1:]:
        p = n.parent
        n.link = p.link or n.tag == "a"
        inside = p.marked or p.tag in ("article", "main")
        n.marked = inside
        drop = n.tag in SKIPPED or (n.tag == "header" and not inside)
        if not drop and n.words and n.tag not in ("html", "body", "main"):
            marks = n.words & MARKS
            # an article's own head ("entry-header") is part of it
            marks = frozenset() if marks == {"header"} and (inside or n.words & GOOD) else marks
            drop = bool(n.words & TALK) or (bool(marks) and n.tag not in ("article", "h1", "h2") and n.text < 0.7 * whole)
        n.skip = n.skip or p.skip or drop
    for node, text in items:
        if text and not node.skip and not node.link:
            node.own += len(text.strip())
    for n in nodes:
        n.good = n.own
    for n in reversed(nodes[1:]):
        n.parent.good += n.good
    return nodes, items


def best(nodes: list[Node]) -> Node | None:
    """The container of the page's main text."""
    total = nodes[0].good
    if not total:
        return None
    options = [n for n in nodes if n.tag in CONTAINERS and not n.skip]
    named = [n for n in options if (n.tag in ("article", "main") or n.words & GOOD) and n.good >= 0.4 * total and n.tag != "body"]
    articles = [n for n in named if n.tag == "article"]
    if articles:
        return max(articles, key=lambda n: (n.good, -n.depth))
    if named:
        most = max(n.good for n in named)
        return max((n for n in named if n.good >= 0.9 * most), key=lambda n: n.depth)
    wide = [n for n in options if n.good >= 0.8 * total]
    return max(wide, key=lambda n: n.depth) if wide else nodes[0]


def text_under(items: list[tuple[Node, str]], chosen: set[int]) -> str:
    """The blocks of text under the chosen nodes, one a line."""
    inside: dict[int, bool] = {}

    def within(n):
        chain = []
        while n is not None and id(n) not in inside:
            if id(n) in chosen:
                inside[id(n)] = True
                break
            chain.append(n)
            n = n.parent
        found = n is not None and inside[id(n)]
        for c in chain:
            inside[id(c)] = found
        return found

    lines, now = [], []
    for node, text in items:
        if text is None:
            if now:
                lines.append("".join(now))
                now = []
        elif not node.skip and within(node):
            now.append(text)
    if now:
        lines.append("".join(now))
    lines = [" ".join(html.unescape(x).split()) for x in lines]
    return "\n".join(x for x in lines if x)


def vote(page: str | None) -> tuple[str, int] | None:
    """The path of a page's best container and its text's length."""
    if not page:
        return None
    chosen = best(judged(page)[0])
    return (chosen.path, chosen.good) if chosen is not None else None


def extract(page: str | None, path: str | None, templates: Iterable[str] = ()) -> str:
    """The text under all containers of one path of the host, else under the page's own best one.

    The path is the own best one's if it is one of the host's ``templates``; else ``path``, the host's
    winner, where its containers have at least two fifths of the own best one's text.
    """
    if not page:
        return ""
    nodes, items = judged(page)
    own = best(nodes)
    if own is None:
        return ""
    if path is not None:
        key = own.key if own.key in {key_of(t) for t in templates} else key_of(path)
        found = [n for n in nodes if n.key == key and not n.skip]
        if found and 5 * sum(n.good for n in found) >= 2 * own.good:
            return text_under(items, {id(n) for n in found})
    return text_under(items, {id(own)})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    pages = scanned(pages)
    host = F.lower(F.coalesce(F.regexp_extract("_doc.url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

    def votes(batches):
        for b in slices(batches):
            got = [vote(p) for p in b.column("html").to_pylist()]
            cols = [b.column("_file"), b.column("_row"), b.column("host"), pa.array([g and g[0] for g in got], pa.string()), pa.array([g and g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["_file", "_row", "host", "path", "good"])

    def texts(batches):
        for b in slices(batches):
            got = [extract(p, w and w[0], w or ()) for p, w in zip(b.column("html").to_pylist(), b.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def read(rows: DataFrame) -> DataFrame:
        """The main texts of rows of pages (_doc) with their hosts' paths (_value)."""
        rows = rows.select(F.col("_doc.page_id").cast("long").alias("page_id"), F.col("_doc.url").alias("url"), F.col("_doc.html").alias("html"), F.col("_value").alias("paths"))
        return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")

    voted = boxed(pages).select("_file", "_row", host.alias("host"), F.col("_doc.html").alias("html")).mapInArrow(votes, "_file long, _row long, host string, path string, good long")
    voted = materialize(voted.filter("path IS NOT NULL"), "votes")
    counted = voted.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    first = counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("good"), F.col("path"))).alias("winner"), F.sum("n").alias("pages"))
    # the winner, then the host's other templates: a tenth of its pages and at least two, so ten at most
    backed = F.when((F.col("path") != F.col("winner")) & (F.col("n") >= TEMPLATE_PAGES) & (F.col("n") * TEMPLATES >= F.col("pages")), F.col("path"))
    winners = counted.join(first, "host").groupBy("host", "winner").agg(F.array_sort(F.collect_list(backed)).alias("others"))
    winners = materialize(winners.select("host", F.concat(F.array("winner"), "others").alias("_value")), "paths")
    width = F.octet_length(F.array_join("_value", " ")) + 16 * F.size("_value")
    if (winners.agg(F.sum(F.octet_length("host") + width + 112)).first()[0] or 0) <= shared.BROADCAST_BYTES:
        return read(boxed(pages).withColumn("host", host).join(F.broadcast(winners), "host", "left"))
    named = voted.select("_file", "_row", "host").join(winners.hint("merge"), "host").select("_file", "_row", "_value")
    return met(pages, named, read, width, every=True)


ship(__name__)

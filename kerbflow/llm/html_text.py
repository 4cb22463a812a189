"""Main text of web pages by consensus paths of their hosts (operator 10).

Every page is parsed and its containers scored by the running text they hold.  A
container is known by its generalised path: the tags from the root with their classes,
digits replaced, positions left out.  Pages vote for their best containers; Spark sums the
votes by host and path.  The text of a page is then taken from the containers on its host's
winning path and on winning paths beside it, and only where it has none of the winning paths
from its own best one.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm import _text
from kerbflow.llm._cluster import bounded_batches, sized, written

#: Paths that a page votes for, and that a host keeps.
VOTES, KEPT = 3, 4
#: Hosts up to which their winners are broadcast.
HOSTS = 100_000
#: Least score of a sibling of the best container, as a share of its own.
SIBLING = 0.25
#: Elements deeper than this belong to the one at that depth, as in browsers.
DEEPEST = 512

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; without an end tag it goes to the end of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("nav footer aside button dialog menu select template svg".split())
#: Raw content that browsers show.
SHOWN = frozenset("xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote html".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
NOISE_ROLES = frozenset("banner complementary contentinfo dialog alert navigation search menu form".split())
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "path", "parent", "noise", "soft", "keeps", "weight", "score", "link", "depth", "blocks")

    def __init__(self, tag, path, parent, noise, soft, link, depth, blocks):
        self.tag, self.path, self.parent, self.noise, self.link, self.depth, self.blocks = tag, path, parent, noise, link, depth, blocks
        #: the nearest element around, itself included, whose names only hint at noise
        self.soft = self if soft else parent.soft if parent else None
        self.keeps, self.weight, self.score = False, 0, 0.0


def _describe(tag: str, rest: str) -> tuple[str, bool, bool]:
    """A step of the generalised path; whether the element is no part of an article, and whether its names only hint at that.

    A class or id all of whose words mean noise (``cookie-notice``) says so; one with some such
    word (``share-enabled``) hints at it, and so does a form, which may stand around a whole page.
    """
    if not rest.strip():
        return tag, tag in DROPPED, tag == "form"
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    names = found.get("class", "").lower().split()
    step = ".".join([tag, *sorted({re.sub(r"\d+", "0", c) for c in names})])
    if tag in ("html", "body"):
        return step, False, False
    listed = [set(_WORDS.findall(n)) for n in [*names, *found.get("id", "").lower().split()]]
    sure = any(w and w <= NOISE_WORDS for w in listed) and tag not in ("article", "main")
    noise = tag in DROPPED or sure or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    return step, noise, not noise and (tag == "form" or any(w & NOISE_WORDS for w in listed))


def parse(page: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """Blocks of text outside noise, with their element and their letters in links; all containers.

    An element whose names hint at noise is none if it holds an article, a first heading or half
    of the page's text.
    """
    root = _Node("", "", None, False, False, False, 0, 0)
    stack, blocks, containers, text, linked = [root], [], [], [], 0
    at_of: dict[str, list[int]] = {}  # places of the open elements by tag
    paths: dict = {}

    def top(tags, floor=0):
        return max((at_of[t][-1] for t in tags if at_of.get(t) and at_of[t][-1] > floor), default=0)

    def flush():
        nonlocal linked
        if text:
            if not stack[-1].noise:
                words = " ".join("".join(text).split())
                if words:
                    blocks.append((stack[-1], words, linked))
            text.clear()
        linked = 0

    def pop(k):
        if stack[-1].blocks > stack[k - 1].blocks:
            flush()
        for n in stack[k:]:
            at_of[n.tag].pop()
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not stack[-1].noise:
            piece = html.unescape(piece)
            text.append(piece)
            if stack[-1].link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS and (k := top(("svg",))):
            pop(k)  # blocks end a drawing that was left open
        if close:
            if tag == "p" and not at_of.get("p"):
                flush()
            k = top((tag,))
            # an inline end tag does not close blocks around it
            if k and (tag in BLOCKS or stack[-1].blocks == stack[k - 1].blocks):
                pop(k)
            continue
        if tag in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in SHOWN:
                flush()
                text.append(page[at : end.start() if end else size])
                flush()
            at = end.end() if end else size
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            k = top(("p", *CONTAINERS))
            if k and stack[k].tag == "p":
                pop(k)
            if tag in CLOSES:
                ends, limits = CLOSES[tag]
                while k := top(ends, top(limits)):
                    pop(k)
            flush()
        if tag in VOID or rest.endswith("/"):
            continue
        step, noise, soft = _describe(tag, rest)
        up = stack[-1]
        if tag == "header" and not at_of.get("article"):
            noise = True
        parent = up if up.depth < DEEPEST else up.parent
        # inline elements do not lengthen paths
        path = paths.setdefault((parent.path, step), f"{parent.path}>{step}") if tag in BLOCKS else parent.path
        node = _Node(tag, path, parent, noise or up.noise, soft and not up.noise, up.link or tag == "a", min(up.depth + 1, DEEPEST), up.blocks + (tag in BLOCKS))
        if tag in ("article", "main", "h1"):
            s = node.parent.soft
            while s is not None and not s.keeps:
                s.keeps, s = True, s.parent.soft
        at_of.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if tag in CONTAINERS and not node.noise:
            containers.append(node)
    flush()
    whole = sum(len(words) for _, words, _ in blocks)
    for node, words, _ in blocks:
        s = node.soft
        while s is not None:
            s.weight += len(words)
            s = s.parent.soft

    def clear(node):
        s = node.soft
        while s is not None:
            if not s.keeps and 2 * s.weight < whole:
                return False
            s = s.parent.soft
        return True

    return [b for b in blocks if clear(b[0])], [c for c in containers if clear(c)]


def _holders(node: _Node):
    while node is not None:
        if node.tag in CONTAINERS:
            yield node
        node = node.parent


def scored(blocks, containers) -> list[tuple[str, float]]:
    """Generalised paths with the scores of their containers, best first.

    Running text counts for its container, half for the next one outwards, a quarter for the
    one after; ``article`` and ``main`` take all that is below them, and more.
    """
    for node, words, linked in blocks:
        own = (len(words) - min(2 * linked, len(words))) * (1.0 if node.tag not in ("li", "td") else 0.6)
        share = 1.0
        for holder in _holders(node):
            if holder.tag in ("article", "main"):
                holder.score += 1.5 * own
            elif share >= 0.25:
                holder.score += share * own
            share /= 2
    total: dict[str, float] = {}
    for c in containers:
        if c.score > 0:
            total[c.path] = total.get(c.path, 0.0) + c.score
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))


def _with_siblings(ranked: list[tuple[str, float]], paths: list[str]) -> set[str]:
    """The first of ``paths`` that a page has, else its best, and those next to it, below the same element, that hold a good part."""
    have = dict(ranked)
    order = [p for p in paths if p in have] or [p for p, _ in ranked]
    up = lambda p: p.rpartition(">")[0]
    return {p for p in order if p == order[0] or up(p) == up(order[0]) and have[p] >= SIBLING * have[order[0]]}


def article(page: str | None, paths: list[str]) -> str:
    """The text below the first of ``paths`` that the page has, else below its best container, siblings included."""
    blocks, containers = parse(page or "")
    chosen = _with_siblings(scored(blocks, containers), paths)
    if not chosen:
        return "\n\n".join(words for _, words, _ in blocks)
    return "\n\n".join(words for node, words, _ in blocks if any(h.path in chosen for h in _holders(node)))


def _votes(batches):
    for batch in batches:
        for part in _text.slices(batch, "html"):
            host, path, vote = [], [], []
            for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                ranked = scored(*parse(page or ""))[:VOTES]
                total = sum(s for _, s in ranked)
                for k, (p, s) in enumerate(ranked):
                    host.append(h)
                    path.append(p)
                    vote.append(s / total / (1 + k))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(vote, pa.float64())], ["host", "path", "vote"])


def _articles(batches):
    for batch in batches:
        for part in _text.slices(batch, "html"):
            texts = [article(page, paths or []) for page, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url) -> F.Column:
    """The host of a url in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths that a host's pages vote for, by falling votes."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, vote double")
    # rounded: sums of doubles depend on the order of arrival
    votes = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1e6).cast("long")).alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = votes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= KEPT)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "path")))
    return ranked.groupBy("host").agg(ordered.alias("ranked")).select("host", F.transform("ranked", lambda r: r["path"]).alias("paths"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text, and so has one without text outside noise.  Pages
    without a host vote together.  Repeated rows stay, equal votes fall to the path that sorts
    first; an empty table gives no rows; further columns, whatever their names, are ignored.  A
    long page is parsed whole, in time that grows with its length whatever its depth.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = sized(written(host_paths(pages), "paths"), HOSTS)
    known = pages.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return known.mapInArrow(_articles, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))

"""Main text of web pages: boosted trees over DOM-node features, decoded over the tree of nodes."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Boosted, train
from .common import bounded_batches, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: The label of a node in the layouts that the model is trained on. Pages to extract from are not read for it.
LABEL = re.compile(r'\bdata-y="([01])"')
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements whose content is no text of the page, whatever is around them.
SILENT = set("script style head title noscript template svg math iframe object canvas audio video textarea select option button datalist".split())
#: What may stand in a head; anything else ends it.
HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
RAW = set("script style textarea title noscript iframe xmp".split())
#: An opening tag ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
#: Where the search for such an element stops.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}

TAGS = ("p", "h1", "h2", "h3", "li", "ul", "div", "section", "article", "main", "body", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "figure")
WORDS = {
    "content": "content article main post body entry story text prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pager pagination toc",
    "head": "header masthead banner top topbar logo branding",
    "foot": "footer bottom copyright legal colophon",
    "side": "sidebar aside widget widgets related recommended more rail",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "talk": "comment comments reply replies discussion disqus respond responses",
    "notice": "cookie cookies notice consent gdpr popup modal overlay alert newsletter subscribe paywall",
    "form": "form search login signup signin input contact",
    "share": "share sharing social tags tag meta byline author",
}
VOCABULARY = [set(v.split()) for v in WORDS.values()]


class Node:
    __slots__ = ("tag", "parent", "kids", "attrs", "text", "linked", "tags", "depth", "place", "label", "silent")

    def __init__(self, tag: str, parent: int, depth: int, place: int):
        self.tag, self.parent, self.depth, self.place = tag, parent, depth, place
        self.kids: list[int] = []
        self.attrs: set[str] = set()
        self.text = self.linked = self.tags = 0
        self.label, self.silent = None, False


def parse(page: str, labelled: bool = True) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order and (node, text) pieces; a None-like piece "" ends a block. Inline elements belong to their block."""
    nodes = [Node("#root", -1, 0, 0)]
    pieces: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, block)
    links, at, n = 0, 0, len(page)
    opened: Counter[str] = Counter()  # a closing tag of something that isn't open needs no look at the stack

    def close(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            links -= tag == "a"
            opened[tag] -= 1
        del stack[k:]

    def leave_head() -> None:
        """Close a head that is left open."""
        if stack[-1][0] == "head":
            close(len(stack) - 1)
            pieces.append((stack[-1][1], ""))

    def say(text: str) -> None:
        text = entities.unescape(text)
        if not text:  # a reference to no character; "" among the pieces is the end of a block
            return
        if not text.isspace():
            leave_head()
        block = stack[-1][1]
        pieces.append((block, text))
        size = len(text) if not text.isspace() else 0
        nodes[block].text += size
        nodes[block].linked += size if links else 0

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        pieces.append((stack[k][1], ""))
                    close(k)
                    if tag not in INLINE:
                        pieces.append((stack[-1][1], ""))
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag not in HEAD:
            leave_head()
        if tag == "br":
            pieces.append((stack[-1][1], "\n"))
            continue
        block = tag not in INLINE
        if block and tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[tag]:
                    close(k)
                    if stack[-1][0] not in ENDS[tag]:
                        break
                elif stack[k][0] in SCOPES[tag]:
                    break
        elif block:
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():  # any block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        here = stack[-1][1]
        if block:
            pieces.append((here, ""))
        if tag in VOID:
            continue
        nodes[here].tags += 1
        if block:
            parent = nodes[here]
            node = Node(tag, here, parent.depth + 1, len(parent.kids))
            node.silent = parent.silent or tag in SILENT
            for a in ATTRIBUTE.finditer(m[3] or m[6] or ""):
                node.attrs.update(re.split(r"[^a-z0-9]+", (a[2] or a[3] or a[4] or "").lower()))
            if labelled and (y := LABEL.search(m[3] or "")):
                node.label = int(y[1])
            parent.kids.append(len(nodes))
            nodes.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else n
                end = page.find(">", at) if end else -1
                at = end + 1 if end >= 0 else n
                continue
            stack.append((tag, len(nodes) - 1))
        else:
            links += tag == "a"
            stack.append((tag, here))
        opened[tag] += 1
    return nodes, pieces


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: tag, attribute tokens, depth, place among siblings, and text, tag and link counts of the subtree."""
    n = len(nodes)
    text, linked, tags, paras, own = (np.zeros(n) for _ in range(5))
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        text[k] += x.text
        linked[k] += x.linked
        tags[k] += x.tags
        own[k] = x.text
        if k:
            text[x.parent] += text[k]
            linked[x.parent] += linked[k]
            tags[x.parent] += tags[k]
            paras[x.parent] += paras[k] + (x.tag == "p")
    flags = np.zeros((n, len(TAGS) + len(VOCABULARY)))
    up = np.zeros((n, len(VOCABULARY) + 2))
    sibs = np.ones(n)
    for k, x in enumerate(nodes):
        if x.tag in TAGS:
            flags[k, TAGS.index(x.tag)] = 1
        for j, v in enumerate(VOCABULARY):
            if x.attrs & v:
                flags[k, len(TAGS) + j] = 1
        if k:
            sibs[k] = len(nodes[x.parent].kids)
            up[k] = up[x.parent]
            up[k, :-2] = np.maximum(up[k, :-2], flags[x.parent, len(TAGS) :])
            up[k, -2] = max(up[k, -2], nodes[x.parent].tag in ("article", "main"))
            up[k, -1] = max(up[k, -1], nodes[x.parent].tag in ("nav", "header", "footer", "aside", "form"))
    place = np.array([x.place for x in nodes]) / sibs
    total = max(text[0], 1)
    return np.column_stack([flags, up, np.array([x.depth for x in nodes]), place, np.log1p(sibs), np.log1p(text), np.log1p(own), text / total, text / (tags + 1), linked / np.maximum(text, 1), np.log1p(paras)])


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Keep or drop every node: the likeliest choice in which no node is kept under a dropped one."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    take, lose = keep.copy(), drop.copy()
    for k in range(len(nodes) - 1, 0, -1):
        take[nodes[k].parent] += max(take[k], lose[k]) if not nodes[k].silent else lose[k]
        lose[nodes[k].parent] += lose[k]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and not nodes[k].silent and take[k] >= lose[k]
    return kept


def blocks(pieces: list[tuple[int, str]], kept: np.ndarray) -> str:
    out, now = [], []
    for node, text in [*pieces, (0, "")]:
        if text == "":
            if now and (joined := " ".join("".join(now).split())):
                out.append(joined)
            now = []
        elif kept[node]:
            now.append(text)
    return "\n\n".join(out)


def layouts(pages: int = 400, seed: int = 11) -> Iterator[str]:
    """Pages of many layouts whose elements say in data-y whether they are main text: what the trees learn from."""
    r = random.Random(seed)
    words = lambda lo, hi: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))
    said = lambda lo, hi: (words(lo, hi).capitalize() + r.choice([".", ".", "?", ", " + words(3, 9) + "."]))

    def named(kind: str) -> str:
        if r.random() < 0.35:
            return ""
        extra = r.choice(["", "", " x" + str(r.randint(1, 99)), "-" + r.choice(["wrap", "box", "list", "inner"])])
        return f' {r.choice(["class", "class", "id"])}="{r.choice(WORDS[kind].split())}{extra}"'

    def links(y: int) -> str:
        return f'<ul data-y="{y}">' + "".join(f'<li data-y="{y}"><a href="/">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"

    def junk(kind: str, tag: str) -> str:
        a = named(kind) or (named(kind) if tag == "div" else "") or (f' class="{r.choice(WORDS[kind].split())}"' if tag == "div" else "")
        body = {"menu": lambda: links(0), "side": lambda: f'<h3 data-y="0">{words(1, 4)}</h3>' + links(0), "share": lambda: words(1, 4)}.get(kind, lambda: r.choice([
            lambda: said(3, 15), lambda: f'<p data-y="0">{said(3, 40)}</p>', lambda: f'<p data-y="0">{said(4, 20)}<a href="#">{words(1, 3)}</a></p>',
            lambda: f'<div data-y="0">{said(3, 12)}</div>' * r.randint(1, 3), lambda: links(0)])())()
        if kind == "talk":
            body = "".join(f'<{q} data-y="0"{named("talk")}><p data-y="0">{said(4, 60)}</p></{q}>' for q in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 6)))
        if kind == "form":
            body = f"{words(1, 4)}<input><button>{words(1, 1)}</button>"
        return f'<{tag} data-y="0"{a}>{body}</{tag}>'

    def article() -> str:
        out = [f'<h1 data-y="1">{words(3, 10)}</h1>'] if r.random() < 0.8 else []
        short = r.random() < 0.25
        for _ in range(r.randint(0, 2) if short and out else r.randint(1, 14)):
            k = r.random()
            if k < 0.74:
                out.append(f'<p data-y="1">{" ".join(said(1, 30) for _ in range(r.randint(1, 1 if short else 6)))}</p>')
            elif k < 0.80:
                out.append(f'<h2 data-y="1">{words(1, 6)}</h2>')
            elif k < 0.85:
                out.append('<ul data-y="1">' + "".join(f'<li data-y="1">{said(2, 20)}</li>' for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.88:
                out.append(f'<blockquote data-y="1"><p data-y="1">{said(6, 40)}</p></blockquote>')
            elif k < 0.90:
                out.append(f'<pre data-y="1">{words(5, 30)}</pre>')
            elif k < 0.93:
                out.append('<table data-y="1">' + "".join(f'<tr data-y="1"><td data-y="1">{words(1, 4)}</td><td data-y="1">{words(1, 4)}</td></tr>' for _ in range(r.randint(2, 5))) + "</table>")
            elif k < 0.97:
                out.append(f'<p data-y="1">{said(4, 25)} <a href="/">{words(1, 3)}</a> {said(2, 12)}</p>')
            else:
                out.append(junk(r.choice(["advert", "share", "side", "notice"]), r.choice(["div", "aside"])))
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        a = named("content") if tag in ("article", "main", "section") else f' class="{r.choice(WORDS["content"].split())}"'
        body = "".join(out)
        if r.random() < 0.12:
            return body
        if r.random() < 0.3:
            body = f'<div data-y="1"{named("content")}>{body}</div>'
        return f'<{tag} data-y="1"{a}>{body}</{tag}>'

    for _ in range(pages):
        top = [junk(k, t) for k, t, p in (("notice", "div", 0.3), ("head", "header", 0.5), ("head", "div", 0.2), ("menu", "nav", 0.6), ("menu", "div", 0.3), ("advert", "div", 0.4), ("form", "form", 0.2)) if r.random() < p]
        end = [junk(k, t) for k, t, p in (("talk", "div", 0.3), ("talk", "section", 0.2), ("side", "aside", 0.4), ("side", "div", 0.3), ("advert", "div", 0.3), ("form", "form", 0.2), ("foot", "footer", 0.6), ("foot", "div", 0.3), ("notice", "div", 0.2)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(top)
        body = "".join(top) + article() + "".join(end)
        if r.random() < 0.4:
            body = f'<div data-y="1"{r.choice(["", named("content")])}>{body}</div>'
        yield f'<html data-y="1"><head><title>{words(2, 6)}</title></head><body data-y="1">{body}</body></html>'


def fit(pages: int = 400) -> Boosted:
    xs, ys = [], []
    for page in layouts(pages):
        nodes, _ = parse(page)
        at = [k for k, x in enumerate(nodes) if x.label is not None]
        xs.append(features(nodes)[at])
        ys += [nodes[k].label for k in at]
    return train(np.concatenate(xs), np.array(ys, float))


def extract_page(page: str | None, model: Boosted) -> str:
    nodes, pieces = parse(page or "", labelled=False)
    return blocks(pieces, decode(nodes, model.log_odds(features(nodes))))


def extract(pages: DataFrame, layouts_seen: int = 400, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every row of pages with text, the main text of its html, and n_chars, the code points of that.

    The model is trained first, on `layouts_seen` generated layouts, and broadcast (some 20 kB). Null or empty html gives an empty
    text. Pages are independent, so repeated rows and an empty table need no care; markup that is cut off or not closed is read as
    far as it goes. Columns text and n_chars of pages are replaced; all others stay.
    """
    bounded_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(fit(layouts_seen))
    plain = pages.drop("text", "n_chars")
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", text string, n_chars long"
    at = plain.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(p or "", labelled=False) for p in batch.column(at).to_pylist()]
            texts: list[str] = []
            for k in range(0, len(parsed), 256):  # features of 256 pages at a time
                part = parsed[k : k + 256]
                xs = [features(nodes) for nodes, _ in part]
                odds = np.split(model.value.log_odds(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
                texts += [blocks(pieces, decode(nodes, o)) for (nodes, pieces), o in zip(part, odds, strict=True)]
            cols = [*batch.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "text", "n_chars"])

    return plain.mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("text"), "n_chars")

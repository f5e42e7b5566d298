"""Main-text extraction from HTML by tree scoring.

Pages are parsed into a tree; paragraphs pass points for their length and
commas to their ancestors, and a container's points are discounted by the share
of its text that lies in links. The best container and its good siblings are
kept, without the boilerplate inside them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title".split())
#: Elements whose content is no text of the page; without an end tag of their own they are taken for empty.
EMBED = frozenset("noscript template iframe object svg math canvas video audio select".split())
#: Elements that are never part of an article.
CHROME = frozenset("nav footer aside form button dialog menu head fieldset".split()) | RAW | EMBED
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split()
)
PARAGRAPH = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
#: An open element of the key's kind ends when one of the value's kinds begins, unless a table, list or container lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl div article section main body html select".split())
#: Words in class, id or role that mark what surrounds an article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer footnav "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted "
    "related recommended replies reply respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo search".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Chrome words whose elements read like an article, so that much text does not speak for them.
TALK_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Parts of a name that say nothing of what is named, and first parts after which a name says what is near.
PLAIN_PARTS = frozenset("area bar block bottom box button buttons container form inner items left list panel right slot top unit wrap wrapper".split())
NEAR_PARTS = frozenset("has is no with without".split())
#: From this share of links on a name that only hints at chrome is believed.
LINKED = 0.5

#: Open elements inside each other, after which further ones lie beside each other (as in browsers).
DEPTH = 512
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: Where a tag may end, or a quoted value begin.
STOP = re.compile(r"(>)|=\s*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def chrome_name(parts: list[str]) -> int:
    """What a class, id or role says: 3 talk, 2 other chrome, 1 only a part of it does, 0 nothing of chrome."""
    if not CHROME_WORDS & {*parts}:
        return 0
    told = [w for w in parts if w not in PLAIN_PARTS]
    if told[-1] not in CHROME_WORDS or parts[0] in NEAR_PARTS:
        return 1
    return 3 if told[-1] in TALK_WORDS else 2


class Node:
    __slots__ = ("tag", "parent", "children", "chrome", "named", "liked", "score", "text_len", "link_len", "commas", "depth")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = 0 if parent is None else parent.depth + 1
        self.score = 0.0
        self.text_len = self.link_len = self.commas = 0
        self.named, content = 0, False
        hidden = False
        for m in ATTRIBUTE.finditer(attributes) if attributes else ():
            name, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
            elif name in ("class", "id", "role") and not (name == "id" and tag in HEADINGS):
                for token in value.split():
                    parts = [w.lower() for w in PART.findall(token)]
                    content = content or bool(CONTENT_WORDS & {*parts}) and not CHROME_WORDS & {*parts}
                    self.named = max(self.named, chrome_name(parts))
        self.liked = tag in ("article", "main") or content
        self.chrome = tag in CHROME or hidden or tag == "header" and not self.inside("article") and not self.inside("main")
        if self.liked or tag in ("html", "body") or tag == "header" and self.inside("article"):
            self.named = 0
        if tag in HEADINGS:  # "entry-header" is no site header
            self.named = min(self.named, 1)

    def inside(self, tag: str) -> bool:
        at = self.parent
        while at is not None:
            if at.tag == tag:
                return True
            at = at.parent
        return False


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before it, whether it is an end tag, name, attributes) of each tag, and the text after the last one.

    Comments and declarations are left out. A quoted value may hold ``>``; a
    quote without its fellow, and a tag without its end, count as text. Each
    character is looked at a bounded number of times.
    """
    pos, start, end = 0, 0, len(page)
    lone: set[str] = set()  # quotes of which no more will come
    text: list[str] = []
    while True:
        at = page.find("<", pos)
        if at < 0:
            break
        if page.startswith("<!--", at):
            text.append(page[start:at])
            if page.startswith(("<!-->", "<!--->"), at):
                close = page.index(">", at)
            else:
                close = page.find("-->", at + 4)
                close = close + 2 if close >= 0 else end
            pos = start = close + 1
            continue
        m = TAG.match(page, at)
        if m is None:
            if page.startswith(("<!", "<?", "</"), at):
                close = page.find(">", at)
                text.append(page[start:at])
                pos = start = close + 1 if close >= 0 else end
            else:
                pos = at + 1
            continue
        stop, close = m.end(), -1
        while (found := STOP.search(page, stop)) is not None:
            if found[1]:
                close = found.start()
                break
            quote = found[2]
            other = -1 if quote in lone else page.find(quote, found.end())
            if other < 0:
                lone.add(quote)
            stop = other + 1 if other >= 0 else found.end()
        if close < 0:  # no tag ends any more
            break
        name = m[1].lower()
        yield "".join([*text, page[start:at]]), page[at + 1] == "/", name, page[m.end() : close]
        text.clear()
        pos = start = close + 1
        if name in RAW and page[at + 1] != "/":
            found = RAW_END[name].search(page, pos)
            pos = start = found.start() if found else end
    yield "".join([*text, page[start:]]), False, "", ""


def parse(page: str) -> Node:
    """The tree of a page; its leaves are strings with character references decoded."""
    root = at = Node("html", None)
    open_embeds: dict[int, Node] = {}
    for text, ends, tag, attributes in tokens(page):
        if text:
            at.children.append(html.unescape(text) if "&" in text else text)
        if not tag:
            break
        if ends:
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                open_embeds.pop(id(up), None)
                at = up.parent
            elif tag == "p":
                at.children.append(Node("p", at))
            continue
        if tag in BLOCK:
            up = at
            while up.parent is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p" and up.parent is not None:
                at = up.parent
        if tag in ENDS or tag in ("tbody", "tfoot", "thead"):
            up = at
            while up.parent is not None and up.tag not in SCOPE:
                if tag in ENDS.get(up.tag, ()):
                    at = up.parent
                    if tag not in ("tr", "tbody", "tfoot", "thead"):
                        break
                up = up.parent
        if tag in ("html", "body") and any(up.tag == tag for up in _line(at)):
            continue
        node = Node(tag, at, attributes)
        at.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if at.depth < DEPTH:
            at = node
            if tag in EMBED:
                open_embeds[id(node)] = node
    for node in open_embeds.values():
        node.chrome = False
    return root


def _line(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def settle(root: Node) -> None:
    """Decide by its text whether an element that is named like chrome is chrome.

    A name that only hints is believed where links hold ``LINKED`` of the text.
    A whole one is believed, unless the element holds a content container with
    several paragraphs, or lies in one and has several paragraphs and a heading
    of its own, with few links; talk is believed in any case.
    """
    sums: dict[int, list[int]] = {}  # text, text in links, paragraphs, headings, paragraphs in content containers
    stack = [(root, False, False, False)]
    while stack:
        node, done, in_link, in_content = stack.pop()
        if node.chrome:
            continue
        if not done:
            in_link = in_link or node.tag == "a"
            own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
            sums[id(node)] = [own, own if in_link else 0, 0, 0, 0]
            stack.append((node, True, in_link, in_content))
            stack.extend((c, False, in_link, in_content or node.liked) for c in node.children if not isinstance(c, str))
            continue
        n = sums.pop(id(node))
        few_links = n[1] < LINKED * n[0] or not n[0]
        if node.named == 1:
            node.chrome = not few_links
        elif node.named:
            node.chrome = node.named == 3 or not few_links or not (n[4] >= 3 or in_content and n[2] >= 3 and n[3])
        if node.chrome or node.parent is None:
            continue
        if node.tag in HEADINGS:
            n[3] += 1
        elif node.tag in PARAGRAPH and n[0] >= 25 and few_links:
            n[2] += 1
        if node.liked:
            n[4] = n[2]
        up = sums[id(node.parent)]
        for i, x in enumerate(n):
            up[i] += x


def measure(root: Node) -> list[Node]:
    """Text and link lengths of all nodes outside boilerplate; returns the paragraphs."""
    paragraphs, stack = [], [(root, False, False)]
    while stack:
        node, done, in_link = stack.pop()
        if done:
            if node.parent is not None:
                node.parent.text_len += node.text_len
                node.parent.link_len += node.link_len
                node.parent.commas += node.commas
            continue
        if node.chrome:
            continue
        in_link = in_link or node.tag == "a"
        stack.append((node, True, in_link))
        strings = [c for c in node.children if isinstance(c, str)]
        own = sum(len(c.strip()) for c in strings)
        node.text_len, node.link_len, node.commas = own, own if in_link else 0, sum(c.count(",") for c in strings)
        if node.tag in PARAGRAPH or own and node.tag in BLOCK:
            paragraphs.append(node)
        stack.extend((c, False, in_link) for c in node.children if not isinstance(c, str))
    return paragraphs


def main_nodes(root: Node) -> list[Node]:
    """The best container and its kept siblings, in page order; empty if the page has no text."""
    settle(root)
    paragraphs = [p for p in measure(root) if p.text_len]
    for p in paragraphs:
        points = 1.0 + min(p.text_len / 100.0, 3.0) + p.commas * 0.5
        share = points * (1.0 - p.link_len / p.text_len)
        for level, up in enumerate(_line(p.parent if p.parent is not None else p)):
            if level > 4:
                break
            up.score += share / (1.0, 2.0, 6.0, 9.0, 12.0)[level]
    best, top = None, -1.0
    stack = [root]
    while stack:
        node = stack.pop()
        if node.chrome or not node.text_len:
            continue
        score = node.score * (1.0 - node.link_len / node.text_len) * (3.0 if node.tag in ("article", "main") else 1.5 if node.liked else 1.0)
        if score > top:
            best, top = node, score
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    if best is None:
        return []
    if best.tag in PARAGRAPH and best.parent is not None:
        best = best.parent
    for up in _line(best.parent):
        if up.tag == "article":
            best = up
    if best.parent is None or best.tag in ("html", "body"):
        return [best]
    kept = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif not isinstance(c, str) and not c.chrome and c.text_len:
            density = c.link_len / c.text_len
            same_kind = c.tag == best.tag and c.score * (1.0 - density) >= max(4.0, 0.2 * best.score)
            if same_kind or c.tag == "p" and density < 0.25 and c.text_len > 80 or c.tag in HEADINGS and density < 0.25 and best.tag not in ("article", "main"):
                kept.append(c)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space collapsed, empty ones left out."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append(line)

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append(" ")
        elif not x.chrome:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one page; empty for null, empty and text-less pages."""
    return "\n".join(blocks(main_nodes(parse(page)))) if page else ""


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Extract every page's main text: id, the columns in ``keep``, ``text``, ``n_chars`` (code points).

    Whole pages are read, however long. Null and empty html give an empty
    text. Pages are independent: repeated rows, ties and null ids change
    nothing. An empty table gives an empty result; columns that are not named
    are not read.
    """
    keep = keep or []
    small_batches(pages.sparkSession)
    rows = pages.select(id_col, *keep, F.col(html_col).alias("html_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")

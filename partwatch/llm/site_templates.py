"""HTML extraction with site template removal.

Pages are parsed into element trees. Elements that name themselves as no content (menus, footers, forms, adverts, comments,
scripts, ...) go at once. The subtrees of what is left are hashed, counted per host in Spark, and those that recur across many different
pages of a host are deleted as well. The rest of the article is the text.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import durable

# A comment, declaration or tag. Quoted values may hold ">". The loop never gives characters back, so it stays linear.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/>\"']+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Opening one of these ends an open element of the second set, unless one of the third set is nearer.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
NO_PARAGRAPH_END = frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "body", "legend", "summary"])
CLOSES_ACROSS = frozenset(["table", "td", "th", "li", "ul", "ol", "article", "section", "div", "main", "body", "blockquote"])

NO_CONTENT = frozenset(
    "aside audio button canvas datalist dialog embed footer form frame frameset head iframe input link map menu meta nav noscript object"
    " script select style svg template textarea title video".split()
)
NO_CONTENT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments consent"
    " cookie cookies disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice notices notification overlay pager"
    " pagination paywall popup promo promos promotion related replies reply share sharing sidebar sidebars signup skip social sponsor"
    " sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
CONTAINERS = frozenset("center details dir div dl fieldset figure header hgroup ol section table ul".split())
# These may hold article elements of their own.
NO_CONTENT_ARTICLES = frozenset("comment comments disqus related replies reply".split())
HEADER_WORDS = frozenset(["header", "masthead", "topbar"])
# What a class name may say beside such a word without meaning something else: "ads-top" is an advert, "ad-hoc" and "with-sidebar" are not.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block blog body bottom box button buttons center col column container content count desktop feed fixed floating follow footer form"
    " global google head header holder icon icons image info inner item items js latest left link links list main media message mobile more news outer page panel"
    " popular post posts primary reader readers recent right row secondary section site slot small sticky stories story sub tablet text thread title top unit user"
    " users view wrap wrapper zone".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element:
    __slots__ = ("tag", "attributes", "children", "digest", "spared", "size", "heads")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.digest, self.spared, self.size, self.heads = tag, attributes, [], None, False, 0, 0


def parse(html: str) -> Element:
    """A tree of elements and texts. What is never closed ends with its parent; an end without a start is ignored."""
    root = Element("", {})
    stack, at, n = [root], 0, len(html)
    while at < n:
        found = MARKUP.search(html, at)
        if not found:
            stack[-1].children.append(html[at:])
            break
        if found.start() > at:
            stack[-1].children.append(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            _close(stack, tag)
            continue
        _open(stack, tag)
        own = {}
        if "=" in found[3] or "hidden" in found[3]:
            own = {a[0].lower() or a[4].lower(): unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(found[3])}
        element = Element(tag, own)
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID:
            stack.append(element)
    return root


def _open(stack: list[Element], tag: str) -> None:
    """End what the new element ends."""
    if tag in ENDS:
        ended, border = ENDS[tag]
    elif tag in BLOCKS and tag not in NO_PARAGRAPH_END:
        ended, border = frozenset(["p"]), CLOSES_ACROSS
    else:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ended:
            del stack[k:]
            return
        if stack[k].tag in border:
            return


def _close(stack: list[Element], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if tag not in BLOCKS and stack[k].tag in BLOCKS:
            return


def _words(text: str) -> set[str]:
    return {w.lower() for w in WORD.findall(text)}


def _names(element: Element) -> set[str]:
    """Words of the class names and the id that stand for the whole name: alone, or with neutral words, numbers and each other."""
    out = set()
    for name in (element.attributes.get("class", "") + " " + element.attributes.get("id", "")).split():
        words = _words(name)
        known = {w for w in words if w in NO_CONTENT_WORDS or w in HEADER_WORDS}
        if known and all(w in known or w in NEUTRAL_WORDS or w.isdigit() for w in words):
            out |= known
        elif (whole := "".join(WORD.findall(name)).lower()) in NO_CONTENT_WORDS:
            out.add(whole)
    return out


def _weigh(root: Element) -> None:
    """Characters of text and first-level headings below each element; what is no content by its tag counts nothing."""
    order, todo = [], [root]
    while todo:
        now = todo.pop()
        order.append(now)
        todo += [c for c in now.children if isinstance(c, Element)]
    for element in reversed(order):
        own = [c for c in element.children if isinstance(c, Element)]
        element.size = sum(c.size for c in own) + sum(len(c) for c in element.children if not isinstance(c, Element) and not c.isspace())
        element.heads = sum(c.heads for c in own) + (element.tag == "h1")
        if element.tag in NO_CONTENT and element.tag != "form":
            element.size = element.heads = 0


def _vital(element: Element, root: Element, comments: bool) -> bool:
    """Whether the page would be nothing without an element: it holds all its first-level headings or, if there is none, most of its text."""
    if root.heads:
        return element.heads == root.heads
    return not comments and 2 * element.size > root.size > 0


def _holds_article(element: Element) -> bool:
    todo = [element]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Element):
                if child.tag in ("article", "main"):
                    return True
                todo.append(child)
    return False


def _holds_heading(element: Element) -> bool:
    todo = [element]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Element):
                if child.tag in ("h1", "h2"):
                    return True
                todo.append(child)
    return False


def no_content(element: Element, root: Element, inside_article: bool, outermost: bool = True) -> bool:
    """Whether an element says of itself that it is not part of the article.

    The class of an outermost article says nothing of it. A form, by its tag or role, or an element with a telling name, is content if it is vital.
    """
    tag, own = element.tag, element.attributes
    if tag == "form" or own.get("role", "").lower() == "form":
        return not (_vital(element, root, False) or _holds_article(element))
    if tag in NO_CONTENT:
        return True
    if tag == "header":
        return not (inside_article and _holds_heading(element))
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or HIDDEN.search(own.get("style", "").lower()):
        return True
    if own.get("role", "").lower() in NO_CONTENT_ROLES:
        return True
    names = _names(element)
    if tag in ("html", "body", "main") or not names or (tag == "article" and outermost):
        return False
    hit = names & NO_CONTENT_WORDS or (not inside_article and names & HEADER_WORDS)
    return bool(hit) and not _holds_article(element) and not _vital(element, root, bool(names & NO_CONTENT_ARTICLES))


def strip(root: Element) -> None:
    """Delete all elements that are no content, without recursion.

    Elements named like comments or related articles go with the articles they hold, unless no article with text is left then: these are
    wrappers of the page's own article, and stay.
    """
    _weigh(root)
    named, todo = [], [(root, False, True)]
    while todo:
        now, inside, outermost = todo.pop()
        left = []
        for c in now.children:
            if isinstance(c, Element):
                if no_content(c, root, inside, outermost):
                    continue
                if c.attributes and c.tag not in ("html", "body", "main") and _names(c) & NO_CONTENT_ARTICLES and not _vital(c, root, True):
                    if not outermost:
                        continue
                    if c.tag != "article":
                        named.append((now, c))
                        c.spared = True
                todo.append((c, inside or c.tag in ("article", "main"), outermost and c.tag != "article"))
            left.append(c)
        now.children = left
    if named and any(blocks(x) for x, spared in _outermost(root, "article") if not spared):
        for parent, c in named:
            parent.children = [x for x in parent.children if x is not c]


def _outermost(root: Element, tag: str) -> list[tuple[Element, bool]]:
    """The outermost elements of a tag in page order, and whether a spared element holds them."""
    found, todo = [], [(root, False)]
    while todo:
        now, spared = todo.pop()
        if now.tag == tag:
            found.append((now, spared))
        else:
            todo += [(c, spared or now.spared) for c in reversed(now.children) if isinstance(c, Element)]
    return found


def digests(root: Element) -> set[int]:
    """Hash of each subtree with text, from its tag, its texts and its children's hashes; also kept on the elements."""
    order, todo = [], [root]
    while todo:
        now = todo.pop()
        order.append(now)
        todo += [c for c in now.children if isinstance(c, Element)]
    found = set()
    for element in reversed(order):
        parts = []
        for child in element.children:
            if isinstance(child, Element):
                if child.digest is not None:
                    parts.append(child.digest)
            elif text := " ".join(child.split()):
                parts.append(text.encode("utf-8", "surrogatepass"))
        if parts:
            element.digest = hashlib.blake2b(element.tag.encode() + b"\0" + b"\1".join(parts), digest_size=8).digest()
            found.add(int.from_bytes(element.digest, "little", signed=True))
    return found


def article_roots(root: Element) -> list[Element]:
    """The outermost articles, else the main element, else everything; only those with text.

    Articles in spared elements may be readers' comments beside an article without a tag: without a heading they are only part of what else
    there is.
    """
    for tag in ("article", "main"):
        found = _outermost(root, tag)
        if tag == "article" and not any(not spared or _holds_heading(x) for x, spared in found):
            continue
        if any(blocks(x) for x, _ in found):
            return [x for x, _ in found]
    return [root]


def blocks(root: Element) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space one space, empty ones left out."""
    out, now = [], []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            now.append(unescape(item) if "&" in item else item)
        elif item.tag == "br":
            now.append(" ")
        else:
            if item.tag in BLOCKS:
                end()
                todo.append(None)
            todo += reversed(item.children)
    end()
    return out


def _delete(root: Element, template: set[int]) -> None:
    """Delete templates. In an article only containers can be one: its paragraphs and headings may well be quoted elsewhere."""
    todo = [(root, False)]
    while todo:
        now, inside = todo.pop()

        def is_template(c: Element) -> bool:
            may = c.tag in CONTAINERS or not inside and c.tag not in ("article", "main")  # noqa: B023
            return may and c.digest is not None and int.from_bytes(c.digest, "little", signed=True) in template

        now.children = [c for c in now.children if not isinstance(c, Element) or not is_template(c)]
        todo += [(c, inside or c.tag in ("article", "main")) for c in now.children if isinstance(c, Element)]


def _number(root: Element) -> int:
    return int.from_bytes(root.digest, "little", signed=True) if root.digest else 0


def stripped(html: str | None) -> tuple[Element, set[int]]:
    root = parse(html or "")
    strip(root)
    return root, digests(root)


def extract(html: str | None, template: set[int]) -> str:
    root, own = stripped(html)
    if template and not template.isdisjoint(own):
        _delete(root, template)
    return "\n".join(text for part in article_roots(root) for text in blocks(part))


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    name = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(name != "", name)


# Up to so many template hashes (8 bytes each) are broadcast; more are joined to the pages that hold them.
BROADCAST_HASHES = 500_000


def extract_text(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 5,
    min_share: float = 0.1,
    many_pages: int = 100,
) -> DataFrame:
    """All columns of ``pages`` but the markup, with ``text``, the main text of the page, and ``n_chars``, its code points.

    A subtree is a template of its host if it occurs on at least ``min_pages`` of the host's pages and on ``min_share`` of
    them or ``many_pages``, pages with equal remains counting once (so copies of a page are no template). The share is a guard for
    small hosts only: on a large one ``many_pages`` are enough, however many others there are. Inside article and main elements only
    containers are deleted, never paragraphs or headings of their own. Pages without a host keep their
    subtrees. Text is that of the article elements, else of main, else of the body; blocks are joined by line breaks. A null
    or empty page has the empty text; broken markup ends with its parent; rows may repeat; an empty table gives no rows.
    Columns named ``text`` and ``n_chars`` are replaced.

    Counting moves one small row per subtree and page, pre-aggregated; hosts of any size are spread by subtree. Markup is moved only if
    there are more than ``BROADCAST_HASHES`` templates; then each page gets those it holds, never all of its host.
    """
    inputs = pages.select(F.xxhash64(html_col).alias("page"), host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    inputs = inputs.where("host IS NOT NULL AND html <> ''")

    def hashes(batches):
        for batch in batches:
            hosts, subtrees, whole = [], [], []
            for name, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                root, own = stripped(html)
                page = _number(root)
                hosts += [name] * (len(own) + 1)
                whole += [page] * (len(own) + 1)
                subtrees += [None, *own]
            yield pa.RecordBatch.from_pydict({"host": hosts, "subtree": pa.array(subtrees, pa.int64()), "page": pa.array(whole, pa.int64())})

    seen = inputs.select("host", "html").mapInArrow(hashes, "host string, subtree long, page long").distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("pages"))
    counts = durable(counts.where((F.col("pages") >= min_pages) | F.col("subtree").isNull()))
    hosts = counts.where("subtree IS NULL").select("host", F.col("pages").alias("of"))
    often = counts.where("subtree IS NOT NULL").join(hosts, "host")
    often = often.where((F.col("pages") >= many_pages) | (F.col("pages") >= F.col("of") * min_share)).select("host", "subtree")
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    joined = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").alias("__html"), host(F.col(f"`{url_col}`")).alias("__host"))
    few = often.count() <= BROADCAST_HASHES
    of_host: dict[str, set[int]] = {}
    if few:
        table = often.toArrow()
        for name, subtree in zip(table["host"].to_pylist(), table["subtree"].to_pylist(), strict=True):
            of_host.setdefault(name, set()).add(subtree)
    else:
        numbered = T.StructType([*joined.schema.fields, T.StructField("__page", T.LongType())])

        def numbers(batches):
            for batch in batches:
                whole = [_number(stripped(h)[0]) for h in batch["__html"].to_pylist()]
                yield batch.append_column("__page", pa.array(whole, pa.int64()))

        of_page = seen.join(often, ["host", "subtree"]).groupBy(F.col("host").alias("__host"), F.col("page").alias("__page"))
        of_page = of_page.agg(F.collect_list("subtree").alias("__template"))
        joined = joined.mapInArrow(numbers, numbered).join(of_page, ["__host", "__page"], "left")
    shared = pages.sparkSession.sparkContext.broadcast(of_host)
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def texts(batches):
        for batch in batches:
            if few:
                templates = [shared.value.get(name, set()) for name in batch["__host"].to_pylist()]
            else:
                templates = [set(t or ()) for t in batch["__template"].to_pylist()]
            found = [extract(h, t) for h, t in zip(batch["__html"].to_pylist(), templates, strict=True)]
            base = batch.select(kept)
            yield pa.RecordBatch.from_arrays(
                [*base.columns, pa.array(found, pa.string()), pa.array(np.array([len(t) for t in found], np.int64))], names=schema.names
            )

    return joined.mapInArrow(texts, schema)

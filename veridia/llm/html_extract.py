"""HTML main-text extraction with a site style tree.

The pages of one host are merged into a style tree. A node is a style path:
tags with class and id from the root down. Over the host's pages a node gathers
its contents (its own text) and its presentations (the styles of its children).
With m pages and shares p of the different values, the entropy -sum p log p to
the base m is 0 for what is the same everywhere and 1 for what never repeats.
A node's composite importance is GAMMA times the mean over the contents of all
nodes below it plus the rest times the entropy of its own presentations. A branch
much less important than its most important sibling is a template: navigation, notices, adverts. Templates are taken out of each page
first. Only what the tree leaves goes through the element rules (scripts, forms,
footers, hidden elements, telling names), and the text of the article elements,
or of the page if there are none, is returned.

The tree is a table of (host, path, value) counts made with map-side partials,
so a host with a third of all pages is no hot task, and no html is shuffled as
long as the template paths are few enough to broadcast.
"""

from __future__ import annotations

import html as html_lib
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, frugal, schema_with, send, small_batches, store, texts

# --- fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input dialog menu title audio video math map xmp noembed noframes".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "dd", "dt", "legend", "li", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDARY = frozenset("article section div ul ol dl table td th body main aside nav footer header form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# --- words of class and id names that mark what is no article text; inside an article the second kind counts only as a whole name
STRONG = frozenset("ad ads advert adverts advertisement advertising adbox breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr modal navbar newsletter pagination popup sidebar signup sponsor sponsored subscribe topbar".split())
WEAK = frozenset("banner footer masthead nav navigation notice notices promo promoted promotion related reply replies share sharing social toolbar widget".split())
OUTSIDE = STRONG | WEAK | {"menu"}

#: blocks that may be templates inside an article; its plain text elements never are, nor are inline elements anywhere
JUDGED_INSIDE = frozenset("nav aside footer header form div section center details dialog menu ul ol table".split())
#: deeper nodes count as part of their ancestor of this depth
DEPTH = 64
GAMMA = 0.9
#: a branch below this part of its most important sibling is a template
RELATIVE = 0.9
#: and inside an article, below this importance
CONSTANT = 0.25
#: template paths up to this number are broadcast (20 MB); beyond it they are joined by host
BROADCAST_PATHS = 200_000

NAME = re.compile(r"[^\s/>]+")
SKIP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
COMMENT_END = re.compile(r"--!?>")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Node:
    """An element: its style, the hash of its style path, how the tree judges it, and whether the element rules remove it."""

    __slots__ = ("tag", "style", "path", "parent", "items", "gone", "role")

    def __init__(self, tag: str, style: str, parent, gone: bool, role: int):
        self.tag, self.style, self.parent, self.gone, self.role, self.items = tag, style, parent, gone, role, []
        self.path = child_path(parent.path, style) if parent is not None else 0


#: how the tree judges a node: against its siblings, inside an article, or not at all
OUTER, INNER, KEPT = 0, 1, 2
_paths: dict[tuple[int, str], int] = {}


def child_path(parent: int, style: str) -> int:
    found = _paths.get((parent, style))
    if found is None:
        if len(_paths) >= 100_000:
            _paths.clear()
        found = _paths[parent, style] = hash64(f"{parent}>{style}")
    return found


def telling(names: list[str], inside: bool) -> bool:
    """Whether class and id names mark what is no article text."""
    for name in names:
        words = re.split(r"[-_]", name)
        if inside:
            if name in WEAK or not STRONG.isdisjoint(words):
                return True
        elif not OUTSIDE.isdisjoint(words):
            return True
    return False


def parse(page: str) -> Node:
    """A tolerant tree of a page, in linear time: unclosed and crossed tags are mended by nesting rules.

    A tag or comment that the page's end cuts off is dropped.
    """
    root = Node("", "", None, False, OUTER)
    stack, size = [root], len(page)
    open_tags: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]  # open tags of each boundary element
    last = {'"': page.rfind('"'), "'": page.rfind("'")}
    lowered, at, start, find = None, 0, 0, page.find

    def pop() -> None:
        tag = stack.pop().tag
        open_tags[tag] -= 1
        if tag in BOUNDARY:
            scopes.pop()
        scopes[-1][tag] -= 1

    def attributes(at: int) -> tuple[dict[str, str], int]:
        """Attributes from ``at`` on, and the place behind the tag; -1 if the page ends first."""
        out: dict[str, str] = {}
        while True:
            at = SKIP.match(page, at).end()
            if at >= size:
                return out, -1
            if page[at] == ">":
                return out, at + 1
            m = ATTRIBUTE.match(page, at)
            name, at = m[0].lower(), m.end()
            m, value = EQUALS.match(page, at), ""
            if m:
                at = m.end()
                quote = page[at : at + 1]
                if quote and quote in "\"'" and last[quote] > at:
                    end = find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = UNQUOTED.match(page, at)
                    value, at = m[0], m.end()
            out.setdefault(name, value)

    while (lt := find("<", at)) >= 0:
        c = page[lt + 1 : lt + 2]
        closing = c == "/"
        first = page[lt + 2 : lt + 3] if closing else c
        if not (first.isascii() and first.isalpha()) and c not in ("!", "?", "/"):
            at = lt + 1  # a plain sign
            continue
        if lt > start:
            stack[-1].items.append(page[start:lt])
        if not (first.isascii() and first.isalpha()):
            if page.startswith("<!--", lt):
                m = COMMENT_END.search(page, lt + (2 if page.startswith(("<!-->", "<!--->"), lt) else 4))
                at = m.end() if m else size
            else:
                end = find(">", lt)
                at = end + 1 if end >= 0 else size
            start = at
            continue
        m = NAME.match(page, lt + 1 + closing)
        tag = m[0].lower()
        if find(">", m.end(), m.end() + 1) >= 0:
            a, end = {}, m.end() + 1
        else:
            a, end = attributes(m.end())
        at = start = size if end < 0 else end
        if end < 0:
            break
        if closing:
            if tag == "p" and not open_tags.get("p"):
                stack[-1].items.append(Node("br", "br", root, False, KEPT))
            free = tag in BOUNDARY or tag in ("html", "body")
            if (open_tags if free else scopes[-1]).get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        for other in ("p", *CLOSED_BY.get(tag, ())) if tag in CLOSES_P else CLOSED_BY.get(tag, ()):
            if scopes[-1].get(other) and other not in BOUNDARY:
                while stack[-1].tag != other:
                    pop()
                pop()
                break
            if other in BOUNDARY and stack[-1].tag == other:  # a cell ends at the next one
                pop()
                break
        names = f"{a.get('class', '')} {a.get('id', '')}".lower().split() if a else []
        style = tag + "." + ".".join(sorted(re.sub(r"\d+", "0", n) for n in names)) if names else tag
        in_article = bool(open_tags.get("article"))
        inside = in_article or bool(open_tags.get("main"))
        gone = (
            tag in DROP
            or bool(names and tag not in ("html", "body", "main") and (tag != "article" or in_article) and telling(names, inside))
            or bool(a and (a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", ""))))
            or tag == "header" and not inside
        )
        if tag not in BLOCK or tag in ("article", "main", "body", "html", "br") or inside and not (names or tag in JUDGED_INSIDE):
            role = KEPT
        else:
            role = INNER if inside else OUTER
        node = Node(tag, style, stack[-1], gone, role)
        stack[-1].items.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            lowered = lowered if lowered is not None else page.lower() if len(page.lower()) == size else re.sub("[A-Z]", lambda m: m[0].lower(), page)
            end = lowered.find(f"</{tag}", at)
            close = find(">", end) if end >= 0 else -1
            at = start = close + 1 if close >= 0 else size
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        if tag in BOUNDARY:
            scopes.append({})
    if start < size:
        stack[-1].items.append(page[start:])
    return root


def blocks(node: Node, low: frozenset | set = frozenset(), rules: bool = True) -> list[str]:
    """Texts of the blocks below a node in page order, without templates and (with ``rules``) what the element rules remove."""
    out, run = [], []

    def flush():
        text = " ".join(html_lib.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack = [iter(node.items)]
    breaks = [True]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                run.append(item)
                continue
            block = item.tag in BLOCK
            if block:
                flush()
            if not (rules and item.gone) and item.path not in low:
                stack.append(iter(item.items))
                breaks.append(block)
                break
        else:
            stack.pop()
            if breaks.pop():
                flush()
    flush()
    return out


def article_roots(root: Node, low: frozenset | set = frozenset()) -> list[Node]:
    """The page's article elements (or main, or the body), outermost, in page order."""
    for inside_removed in (False, True):  # a wrapper with a telling name may hold the whole article
        for wanted in ("article", "main"):
            found, stack = [], [root]
            while stack:
                n = stack.pop()
                if n.tag in DROP or (n.gone or n.path in low) and (not inside_removed or n.tag == wanted):
                    continue
                if n.tag == wanted:
                    found.append(n)
                else:
                    stack.extend(i for i in reversed(n.items) if not isinstance(i, str))
            if found:
                return found
    return [root]


def main_text(page: str | None, low=frozenset()) -> str:
    """The article text of a page; ``low``: the template paths of its host."""
    if not page:
        return ""
    root = parse(page)
    return " ".join(b for n in article_roots(root, low) for b in blocks(n, low))


def style_nodes(page: str | None) -> list[tuple[tuple[int, ...], int, int | None, int | None]]:
    """(path hashes from the root down, role, content hash, presentation hash) of every style path of a page.

    All elements of one path are one node; a content without text and a
    presentation without children are None.
    """
    if not page:
        return []
    out: dict[int, tuple[tuple, int, list, list]] = {}
    chains: dict[int, tuple[int, ...]] = {0: ()}
    stack = [parse(page)]
    while stack:
        n = stack.pop()
        children = [i for i in n.items if not isinstance(i, str)]
        if n.parent is not None and n.tag not in ("head", "br"):
            above = chains[n.parent.path]
            chain = chains.setdefault(n.path, above if len(above) == DEPTH else (*above, n.path))
            text = " ".join("".join(i if isinstance(i, str) else "\0" for i in n.items).replace("\0", " ").split())
            if n.tag in RAW:
                text = ""
            _, _, content, shape = out.setdefault(chain[-1], (chain, n.role, [], []))
            if text:
                content.append(text)
            if children:
                shape.append(",".join(i.style for i in children))
        if n.tag != "head":
            stack.extend(i for i in reversed(children) if i.tag != "br")
    return [(chain, role, hash64("\n".join(c)) if c else None, hash64(";".join(s)) if s else None) for chain, role, c, s in out.values()]


def host_of(url) -> F.Column:
    """Lower-cased host; null or odd urls share the empty host, whose branches are not judged."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def site_style_tree(pages: DataFrame) -> DataFrame:
    """host, path, parent, role, pages and importance of every style node of every host."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for h, page in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                for chain, role, content, shape in style_nodes(page) if h else ():
                    for kind, value in ((0, content), (1, shape)):
                        if value is not None:
                            k = h, chain, role, kind, value
                            seen[k] = seen.get(k, 0) + 1
            kinds = (pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*seen)) or [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], names=["host", "chain", "role", "kind", "value", "n"])

    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(frugal(run), "host string, chain array<long>, role int, kind int, value long, n long")
    counts = seen.groupBy("host", "chain", "role", "kind", "value").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    nodes = counts.groupBy("host", "chain", "role", "kind").agg(F.sum("n").alias("pages"), F.sum(n * F.log(n)).alias("s"))
    entropy = F.when(F.col("pages") < 2, 1.0).otherwise((F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    nodes = nodes.groupBy("host", "chain", "role").agg(F.max("pages").alias("pages"), of(0, F.col("pages")).alias("weight"), of(0, entropy).alias("content"), of(1, entropy).alias("shape"))
    nodes = store(nodes, "html-nodes")
    below = nodes.where("content is not null").select("host", F.explode("chain").alias("path"), "weight", "content")
    below = below.groupBy("host", "path").agg((F.sum(F.col("weight") * F.col("content")) / F.sum("weight")).alias("below"))
    path = F.element_at("chain", -1)
    nodes = nodes.select("host", path.alias("path"), F.coalesce(F.try_element_at("chain", F.lit(-2)), F.lit(0)).alias("parent"), "role", "pages", "shape").join(below, ["host", "path"], "left")
    importance = F.coalesce((1 - GAMMA) * F.col("shape") + GAMMA * F.col("below"), F.col("below"), F.col("shape"))
    return nodes.select("host", "path", "parent", "role", "pages", importance.alias("importance"))


def templates(tree: DataFrame) -> DataFrame:
    """host and path of the tree's template branches.

    The fewer pages show a branch, the lower it must lie: with two pages, none is
    a template.
    """
    top = tree.groupBy("host", "parent").agg(F.max("importance").alias("top"))
    sure = 1 - 2 / F.col("pages")
    low = F.col("importance") < sure * RELATIVE * F.col("top")
    inner = low & (F.col("importance") < sure * CONSTANT)
    return tree.join(top, ["host", "parent"]).where(F.when(F.col("role") == OUTER, low).when(F.col("role") == INNER, inner).otherwise(False)).select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Null or empty html gives an empty text. Repeated rows are separate pages, null
    ids and urls stay as they are, further columns are left out, an empty table
    gives an empty one. Equal branches decide alike, whatever the order of rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    low = store(templates(site_style_tree(pages)), "html-low")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if low.count() <= BROADCAST_PATHS:
        by_host: dict[str, set] = {}
        for r in low.collect():
            by_host.setdefault(r["host"], set()).add(r["path"])
        sent = send(spark, by_host)
        drop_stored(low)
        rows = rows.withColumn("low", F.lit(None).cast("array<long>"))
    else:
        sent = None
        rows = rows.join(low.groupBy("host").agg(F.collect_set("path").alias("low")), "host", "left")

    def run(batches):
        known = sent.value if sent is not None else {}
        for batch in batches:
            out = [main_text(page, frozenset(low) if low else known.get(host, ())) for page, host, low in zip(texts(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = schema_with(rows.select("page_id", "url"), text="string", n_chars="long")
    return rows.select("page_id", "url", "html", "host", "low").mapInArrow(frugal(run), schema)

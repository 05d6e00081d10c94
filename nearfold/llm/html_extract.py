"""Main-text extraction from HTML by tree scoring.

A tolerant parser builds a small tree.  Blocks that are boilerplate by tag,
role or name go; a name is boilerplate where it has a word of NOT_CONTENT and
none beside words of layout.  What goes by its name or as a form comes back
where the page has no other article, or where a form holds most of the page.
Every other block with text of its own is a paragraph: it passes points for
its length and commas, discounted by link density, to LEVELS ancestors, in
full to the parent, half to the next and less further up.  The best container
(with bonus for article and main) and those of its siblings that score are
kept, and their blocks are joined in page order.  Of several articles the best
with a headline counts, as readers' comments have none.

Defined results: null html and pages without text give the empty text; a tag
or comment cut off by the end of the page goes; character references are
decoded as browsers do, with or without semicolon; a line break element is
white space inside its block; repeated rows keep their rows; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, strings, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
#: Elements that are never part of an article.
DROP = RAW | frozenset("head nav footer aside form button select input dialog menu canvas audio video map label fieldset search".split())
#: Words in class or id, and roles, that mark boilerplate.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pagination pager popup promo promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words of layout, which may stand beside those.
FRAME = frozenset("area bar block body bottom box btn button buttons col column container content cta form global group header inner item items left link links list main menu outer page panel post posts primary reader right row secondary section signup site slot text thread top unit user users widget wrap wrapper".split())
#: Names that an article has for its own headline.
HEADS = frozenset("banner header masthead".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A start tag of the key closes an open element of the values, looking no further than the scope's elements.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
IN_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}

#: Ancestors that a paragraph passes points to.
LEVELS = 8

_OPEN = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+|=)*+)>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "soft", "score", "chars", "linked", "titled")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, soft: bool = False):
        self.tag, self.parent, self.drop, self.soft = tag, parent, drop, soft
        self.kids: list[Node | str] = []
        self.score, self.chars, self.linked, self.titled = 0.0, 0, 0, False


def _boilerplate(name: str, inside_article: bool) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    bad = NOT_CONTENT.intersection(words)
    return bool(bad - HEADS if inside_article else bad) and all(w in NOT_CONTENT or w in FRAME or w.isdigit() for w in words)


def _unwanted(tag: str, rest: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether the element goes, and whether it may come back."""
    if tag in DROP or tag == "header" and not inside_article:
        return True, tag == "form"
    if not rest or tag in ("html", "body", "article", "main"):
        return False, False
    named = False
    for name, a, b, c in _ATTR.findall(rest):
        name, value = name.lower(), unescape(a or b or c)
        if name in ("class", "id"):
            named = named or any(_boilerplate(x, inside_article) for x in value.split())
        elif name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return named, named


def parse(html: str) -> Node:
    root = at = Node("html", None)
    opened: dict[str, int] = {}
    i, n = 0, len(html)

    def shut(node: Node) -> Node:
        """Closes everything up to the node; what is open then."""
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent
        opened[at.tag] -= 1
        return at.parent

    while i < n:
        m = _OPEN.search(html, i)
        j = m.start() if m else n
        if j > i:
            at.kids.append(unescape(html[i:j]))
        if not m:
            break
        if m[0] == "<!--":
            k = html.find("-->", j + 4)
            # "<!-->" and "<!--->" are whole comments.
            short = 5 if html.startswith(">", j + 4) else 6 if html.startswith("->", j + 4) else 0
            i = j + short if short else k + 3 if k >= 0 else n
            continue
        if m[0] in ("<!", "<?"):
            k = html.find(">", j)
            i = k + 1 if k >= 0 else n
            continue
        name = _NAME.match(html, j)
        end = _REST.match(html, name.end())
        if not end:
            break
        tag, rest, i = name[1].lower(), end[1], end.end()
        if html[j + 1] == "/":
            up = at if opened.get(tag) else root
            while up is not root and up.tag != tag:
                # An inline end tag does not reach out of a block.
                up = root if tag not in BLOCK and up.tag in BLOCK else up.parent
            if up is not root:
                at = shut(up)
            elif tag == "br":
                at.kids.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br":
            at.kids.append(" ")
            continue
        stop, closed = (), ()
        if tag in CLOSES:
            closed, stop = CLOSES[tag], SCOPE[tag]
        elif tag in IN_P:
            closed, stop = ("p",), ("td", "th", "button", "caption", "object")
        # Elements that aren't open anywhere need no look at the ancestors.
        if any(opened.get(t) for t in closed):
            up, found = at, None
            while up is not root and up.tag not in stop:
                if up.tag in closed:
                    found = up
                    if tag in IN_P and tag not in CLOSES:
                        break
                up = up.parent
            if found:
                at = shut(found)
        node = Node(tag, at, *_unwanted(tag, rest, bool(opened.get("article") or opened.get("main"))))
        at.kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW and not rest.endswith("/"):
            k = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, i)
            if not k:
                break
            e = html.find(">", k.end())
            i = e + 1 if e >= 0 else n
            continue
        opened[tag] = opened.get(tag, 0) + 1
        at = node
    return root


def restore(root: Node) -> None:
    """Takes back what went by name or as a form, where the page's article would go with it."""
    kept, gone, forms, headlines, order, stack = False, [], [], {False: 0, True: 0}, [], [(root, False)]
    while stack:
        node, out = stack.pop()
        if node.drop and not node.soft:
            continue
        out = out or node.drop
        order.append(node)
        if node.tag in ("article", "main"):
            kept = kept or not out
            gone += [node] if out else []
        headlines[out] += node.tag == "h1"
        if node.drop and node.tag == "form":
            forms.append(node)
        node.chars = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        stack += [(k, out) for k in node.kids if not isinstance(k, str)]
    for node in reversed(order):
        if node.parent:
            node.parent.chars += node.chars
    total = root.chars
    for form in forms:
        if 2 * form.chars > total:
            form.drop = False
    # Comments are no article where the headline stands apart. An ancestor that is restored has restored its own.
    for node in [] if kept or headlines[False] and not headlines[True] else gone:
        while node.parent and node.soft is not None:
            node.drop = node.drop and not node.soft
            node.soft = None
            node = node.parent
    for node in order:
        node.chars = 0


def _measure(root: Node) -> list[Node]:
    """Sets chars and linked (text inside links) of all kept nodes, bottom up; gives them parents first."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        for k in node.kids:
            if isinstance(k, str):
                size = len(k.strip())
                node.chars += size
                node.linked += size if linked else 0
            elif not k.drop:
                stack.append((k, linked))
    for node in reversed(order):
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def _inline(node: Node) -> str:
    """Text of the node outside its block children."""
    out, stack = [], [iter(node.kids)]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
        elif isinstance(k, str):
            out.append(k)
        elif not k.drop and k.tag not in BLOCK:
            stack.append(iter(k.kids))
    return "".join(out)


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _outermost(order: list[Node], tag: str) -> list[Node]:
    """The kept elements of a tag that are in no other; ``order`` has parents first."""
    inside: set[Node] = set()
    out = []
    for node in order:
        if node.parent and (node.parent in inside or node.parent.tag == tag):
            inside.add(node)
        elif node.tag == tag:
            out.append(node)
    return out


def choose(root: Node) -> list[Node]:
    """The best container and its kept siblings, in page order."""
    order = _measure(root)
    for node in order:
        if node.tag not in BLOCK and node is not root:
            continue
        text = _inline(node).strip()
        if not text:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - _density(node))
        # A block's own text counts for itself where it also holds blocks, as in unclosed markup.
        up, depth = (node if any(isinstance(k, Node) and k.tag in BLOCK for k in node.kids) else node.parent or node), 0
        while up and depth < LEVELS:
            up.score += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
            up, depth = up.parent, depth + 1
    for node in reversed(order):
        node.titled = node.titled or node.tag == "h1"
        if node.parent and node.titled:
            node.parent.titled = True
    for node in order:
        node.score *= (1 - _density(node)) * (1.5 if node.tag in ("article", "main") else 0.8 if node.tag in ("ul", "ol", "dl", "table") else 1)
    best = max(order, key=lambda x: x.score)
    if not best.score:
        return []
    articles, mains = _outermost(order, "article"), _outermost(order, "main")
    comments: set[Node] = set()
    for node in [x for x in articles if not x.titled]:
        while node and node not in comments:
            comments.add(node)
            node = node.parent
    if mains and 2 * sum(x.chars for x in articles) < sum(x.chars for x in mains):
        articles = []
    # A main part counts whole where most of its text is in no article.
    whole = max([x for x in articles if x.titled] or articles or mains, key=lambda x: x.score, default=None)
    if whole and whole.chars:
        best = whole
    if not best.parent:
        return [best]
    least = max(2.0, 0.2 * best.score)
    kept = []
    for k in best.parent.kids:
        if k is best:
            kept.append(k)
        elif isinstance(k, Node) and not k.drop:
            own = len(_inline(k).strip())
            if k.score >= least and not (best.titled and k in comments) or not whole and (k.tag == "p" or re.fullmatch("h[1-6]", k.tag)) and own and _density(k) < 0.25:
                kept.append(k)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack = [iter(nodes)]
    ends: list[bool] = [False]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(k, str):
            run.append(k)
        elif not k.drop:
            edge = k.tag in BLOCK
            if edge:
                flush()
            stack.append(iter(k.kids))
            ends.append(edge)
    flush()
    return out


def main_text(html: str) -> str:
    if not html:
        return ""
    root = parse(html)
    restore(root)
    return "\n".join(blocks(choose(root)))


def _extract(batches):
    for b in batches:
        texts = [main_text(h) for h in strings(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    return arrow_map(pages.select(F.col("page_id").cast("long"), "url", "html"), _extract, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""A small forgiving HTML parser and composite text density.  Plain Python for worker processes."""

from __future__ import annotations

import html
import math
import re

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STEP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never part of an article.
BOILERPLATE = set("nav header footer aside form script style noscript iframe template button select input textarea svg canvas object embed video audio menu dialog head title meta link".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that speak against article text.
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations trending comment comments commentlist disqus replies reply respond pagination pager widget toolbar skip hidden".split()
)
#: First words of names that say what an element is beside, is part of or how it looks; only FOREIGN words after them count.
STATES = set("has no not with without is overflow visually".split())
OWNERS = set("post article entry story main content page body".split())
FOREIGN = set("ad ads advert adverts sidebar comment comments replies share sharing social related newsletter nav navigation menu pagination".split())
#: What a mark leaves of an element's density.
PRIOR = 0.25
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What an open element ends when it begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked", "weight")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, marked: bool = False):
        self.tag, self.parent, self.kids, self.drop, self.marked = tag, parent, [], drop, marked
        self.density = self.total = 0.0
        self.weight = 1.0


def _name_marks(name: str) -> bool:
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    if not parts or parts[0] in STATES:
        return False
    return bool(set(parts[1:]) & FOREIGN) if parts[0] in OWNERS else bool(set(parts) & MARKS)


def _judge(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether the element is boilerplate by its name, role or style, and whether its class or id speaks against it."""
    drop, marked = tag in BOILERPLATE, False
    if attrs.strip(" /"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                marked = marked or any(map(_name_marks, value.split()))
            elif name == "role":
                drop = drop or value in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                drop = True
    return drop, marked and tag not in ("html", "body")


def _tag_end(text: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that is open at ``at`` ends, -1 if it doesn't.  A quote that is never closed is no quote."""
    while m := _STEP.search(text, at):
        if m[1] is None:
            return m.start()
        at = text.index(m[1], m.end()) + 1 if m.end() <= last[m[1]] else m.end()
    return -1


def parse(text: str) -> Node:
    """The tree of a page.  Text is a string among the children; unclosed and stray tags are forgiven.

    Time grows with the length of the text, also for stray quotes and tags.
    """
    root = node = Node("#root", None)
    last = {q: text.rfind(q) for q in "\"'"}
    opened: dict[str, int] = {}  # open elements of each name
    at = done = 0  # text before ``done`` is in the tree

    def leave(to: Node) -> Node:
        """Closes the open elements down to and including ``to``."""
        nonlocal node
        while True:
            opened[node.tag] -= 1
            shut, node = node, node.parent
            if shut is to:
                return node

    while (lt := text.find("<", at)) >= 0:
        m = _TAG.match(text, lt)
        if m is None:
            if text.startswith("<!--", lt):
                end = text.find("-->", lt + 4)
                stop = len(text) if end < 0 else end + 3
            elif text[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = text.find(">", lt)
                stop = len(text) if end < 0 else end + 1
            else:
                at = lt + 1  # a character of the text
                continue
            if lt > done:
                node.kids.append(text[done:lt])
            at = done = stop
            continue
        gt = _tag_end(text, m.end(), last)
        if gt < 0:
            break
        if lt > done:
            node.kids.append(text[done:lt])
        at = done = gt + 1
        name, attrs = m[1].lower(), text[m.end() : gt]
        if text[lt + 1] == "/":
            if opened.get(name):
                up = node
                while up is not None and up.tag != name:
                    # an inline element's end tag doesn't close the block around it
                    up = None if name in INLINE and up.tag not in INLINE else up.parent
                if up is not None:
                    leave(up)
            continue
        if name not in INLINE:
            # a block ends an open paragraph and, for list items and cells, the one before it
            up, last_p = node, None
            while up.parent is not None and (up.tag in INLINE or up.tag == "p"):
                last_p = up if up.tag == "p" else last_p
                up = up.parent
            if last_p is not None:
                leave(last_p)
            if name in _ENDS and any(opened.get(t) for t in _ENDS[name]):
                up, ended = node, None
                while up.parent is not None and up.tag not in _SCOPE[name]:
                    if up.tag in _ENDS[name]:
                        ended = up
                    up = up.parent
                if ended is not None:
                    leave(ended)
        new = Node(name, node, *_judge(name, attrs))
        node.kids.append(new)
        foreign = name in ("svg", "math") or opened.get("svg") or opened.get("math")  # elsewhere a slash closes nothing
        if name in VOID or foreign and attrs.rstrip().endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(text, at)
            new.kids.append(text[at : end.start() if end else len(text)])
            at = done = end.end() if end else len(text)
            continue
        opened[name] = opened.get(name, 0) + 1
        node = new
    if done < len(text):
        node.kids.append(text[done:])
    return root


def _post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.drop:
            continue
        out.append(n)
        todo += [k for k in n.kids if isinstance(k, Node)]
    return out[::-1]


def weigh(nodes: list[Node], body: Node) -> None:
    """Marks are a weak prior: they take most of an element's density.

    They don't where an element wraps most of the page's text, and its articles if the page has any.
    """
    mains: dict[int, int] = {}  # articles and main parts below an element
    for n in nodes:
        mains[id(n)] = sum(mains.get(id(k), 0) for k in n.kids if isinstance(k, Node)) + (n.tag in ("article", "main") and n.chars > 0 and not n.marked)
    for n in reversed(nodes):  # parents first
        n.weight = n.parent.weight if n.parent is not None else 1.0
        if n.marked:
            inner = sum(k.chars for k in n.kids if isinstance(k, Node) and not k.drop)
            wraps = n.chars * 2 > body.chars and inner * 2 > n.chars and (mains[id(n)] or not mains[id(body)])
            n.weight = n.weight if wraps else min(n.weight, PRIOR)


def measure(root: Node) -> list[Node]:
    """Composite text density and its sum over children, for every node that isn't boilerplate; children first."""
    nodes = _post_order(root)
    for n in nodes:
        n.chars, n.tags, n.link_chars, n.link_tags = 0, 0, 0, 0
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len("".join(k.split()))
            elif not k.drop:
                n.chars += k.chars
                n.tags += k.tags + (k.tag not in ("br", "wbr"))
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, max(n.link_tags, 1)
    whole = nodes[-1]
    share = whole.link_chars / max(whole.chars, 1)
    for n in nodes:
        if n.chars:
            per_tag = n.chars / max(n.tags, 1)
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            value = n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1)
            n.density = per_tag * math.log(max(value, 1.0)) / max(math.log(max(base, 1.0 + 1e-9)), 1.0)
    body = next((n for n in nodes if n.tag == "body"), whole)
    weigh(nodes, body)
    for n in nodes:
        n.total = n.weight * sum(k.density * k.weight for k in n.kids if isinstance(k, Node) and not k.drop)
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """The subtree of largest density sum, and the blocks whose density reaches the least on its path to the body.

    Elements that their names speak against are left out of them where what the prior leaves of their density is below
    that threshold.
    """
    nodes = measure(root)
    if not nodes or not nodes[-1].chars:
        return []
    body = next((n for n in nodes if n.tag == "body"), nodes[-1])
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        best = body
    # the best subtree is a block
    while best.parent is not None and best is not body and best.tag in INLINE | HEADINGS | {"p", "li", "td", "blockquote"}:
        best = best.parent
    threshold, up = math.inf, best
    while up is not None:
        if up.chars:
            threshold = min(threshold, up.density)
        if up is body:
            break
        up = up.parent
    for n in nodes:
        if n.weight < 1 and n.density * n.weight < threshold:
            n.drop = True
    holding = set()
    up = best
    while up is not None:
        holding.add(id(up))
        up = up.parent
    picked, todo, title = [], [body], []
    while todo:
        n = todo.pop()
        if n.drop or not n.chars:
            continue
        if n is best:
            picked += [*title, n]
            title = []
        elif n.tag in HEADINGS:
            title.append(n)  # a heading belongs to what follows it
        elif id(n) not in holding and n.density >= threshold and n.link_chars * 2 < n.chars and n.tag not in INLINE:
            picked += [*title, n]
            title = []
        else:
            if id(n) not in holding:
                title = []
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return picked or [best]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order, white space turned into single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        line = " ".join(html.unescape("".join(run)).split())
        if line:
            out.append(line)
        run.clear()

    todo: list = [node]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            run.append(k)
        elif not k.drop:
            if k.tag == "br":
                run.append(" ")
            elif k.tag in INLINE:
                todo += k.kids[::-1]
            else:
                flush()
                todo.append(None)
                todo += k.kids[::-1]
    flush()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(line for n in main_nodes(parse(page)) for line in blocks(n))

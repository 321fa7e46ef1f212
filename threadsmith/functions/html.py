"""Per-row HTML helper used inside the extraction job (runs in Python
workers on Arrow batches).

Only what the site profiles need: a forgiving tree builder on top of the
standard library tokenizer (void tags, implied ``</p>``/``</li>``, raw text
in script/style, stray end tags ignored) and a CSS selector subset: type,
``.class``, ``#id``, ``[attr]``, ``[attr='exact']``, the combinators
descendant, ``>``, ``+``, ``~`` and ``:last-child``, ``:last-of-type``,
``:first-child``, ``:nth-last-child(n)``, ``:nth-last-of-type(n)``.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(("address article aside blockquote details div dl fieldset figcaption figure footer "
                      "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li").split())
NO_TEXT = frozenset(("script", "style", "template"))
# implied end tags: open element -> (start tags that close it, scope boundaries)
_P_SCOPE = frozenset("table td th caption button html template".split())
IMPLIED_END = {
    "p": (CLOSES_P, _P_SCOPE),
    "li": (frozenset(("li",)), frozenset(("ul", "ol")) | _P_SCOPE),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",)) | _P_SCOPE),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",)) | _P_SCOPE),
    "option": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")), frozenset(("table",))),
    "tr": (frozenset(("tr", "tbody", "thead", "tfoot")), frozenset(("table",))),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "places")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children = []
        self.parent = parent
        self.places = None      # of the children, see ``place``

    # -- content (iterative: deep nesting must not hit the recursion limit) --
    def text(self) -> str:
        out: list[str] = []
        stack = [iter(self.children)]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
            elif isinstance(c, str):
                out.append(c)
            elif c.tag not in NO_TEXT:
                stack.append(iter(c.children))
        return "".join(out)

    def html(self) -> str:
        out: list[str] = []
        stack = [(self, None)]
        while stack:
            node, it = stack.pop()
            if it is None:
                attrs = "".join(f' {k}="{escape(v, quote=True)}"' if v is not None else f" {k}"
                                for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}>")
                if node.tag in VOID:
                    continue
                it = iter(node.children)
            c = next(it, None)
            if c is None:
                out.append(f"</{node.tag}>")
                continue
            stack.append((node, it))
            if isinstance(c, str):
                out.append(c if node.tag in NO_TEXT else escape(c, quote=False))
            else:
                stack.append((c, None))
        return "".join(out)

    def elements(self):
        return [c for c in self.children if not isinstance(c, str)]

    def iter(self):
        """Descendant elements in document order."""
        stack = list(reversed(self.elements()))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.elements()))

    def classes(self):
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.cur = self.root
        self.open: dict[str, int] = {}      # tag -> number of open elements

    def _close(self, tag):
        """Close the innermost open ``tag`` and everything opened inside it."""
        if not self.open.get(tag):
            return
        n = self.cur
        while n is not self.root:
            self.open[n.tag] -= 1
            done = n.tag == tag
            n = n.parent
            if done:
                break
        self.cur = n

    def _in_scope(self, tag, boundaries) -> bool:
        n = self.cur
        while n is not self.root:
            if n.tag == tag:
                return True
            if n.tag in boundaries:
                return False
            n = n.parent
        return False

    def handle_starttag(self, tag, attrs):
        for open_tag in ("td", "th", "tr", "dt", "dd", "li", "option", "p"):
            closers, scope = IMPLIED_END[open_tag]
            if tag in closers and self.open.get(open_tag) and self._in_scope(open_tag, scope):
                self._close(open_tag)
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.cur.children.append(data)


def unlink(root: Node) -> None:
    """Take a tree apart.  Nodes name their parents, so a tree that is only
    dropped stays in memory until the collector comes by."""
    stack = [root]
    while stack:
        n = stack.pop()
        stack.extend(n.elements())
        n.parent, n.children, n.places = None, [], None


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# --- selectors ----------------------------------------------------------------
_TOKEN = re.compile(r"""\s*([>+~])\s*|(\s+)|([^\s>+~]+)""")
_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:=(?:'([^']*)'|"([^"]*)"|([^\]]*)))?\]"""
                     r"""|:([\w-]+)(?:\(([^)]*)\))?""")


def _compound(text: str):
    parts, i = [], 0
    while i < len(text):
        m = _SIMPLE.match(text, i)
        if not m:
            raise ValueError(f"unsupported selector part: {text[i:]!r}")
        parts.append(m.groups())
        i = m.end()
    return parts


_COMPILED: dict[str, tuple] = {}      # selector cache (a plain dict pickles with the code)


def compile_selector(sel: str):
    """'a > b c' -> ((None, a), ('>', b), (' ', c)) (left to right; cached)."""
    hit = _COMPILED.get(sel)
    if hit is not None:
        return hit
    steps, comb = [], None
    # attribute values may contain spaces: protect them first
    protected = re.sub(r"\[[^\]]*\]", lambda m: m.group(0).replace(" ", "\x00"), sel.strip())
    for m in _TOKEN.finditer(protected):
        c, ws, simple = m.groups()
        if c:
            comb = c
        elif ws:
            comb = comb or " "
        elif simple:
            steps.append((comb if steps else None, tuple(_compound(simple.replace("\x00", " ")))))
            comb = None
    _COMPILED[sel] = tuple(steps)
    return _COMPILED[sel]


def place(n: Node) -> tuple[int, int, int, int]:
    """(index among its siblings, their number, index among those of its tag,
    their number); worked out once per parent."""
    up = n.parent
    if up is None:
        return 0, 1, 0, 1
    if up.places is None:
        sib = up.elements()
        seen: dict[str, int] = {}
        at = []
        for c in sib:
            seen[c.tag] = seen.get(c.tag, -1) + 1
            at.append(seen[c.tag])
        up.places = {id(c): (i, len(sib), k, seen[c.tag] + 1) for i, (c, k) in enumerate(zip(sib, at, strict=True))}
    return up.places[id(n)]


def _matches(n: Node, parts) -> bool:
    for tag, cls, idv, attr, v1, v2, v3, pseudo, arg in parts:
        if tag and tag != "*" and n.tag != tag:
            return False
        if cls and cls not in n.classes():
            return False
        if idv and n.attrs.get("id") != idv:
            return False
        if attr:
            if attr not in n.attrs:
                return False
            val = v1 if v1 is not None else v2 if v2 is not None else v3
            if val is not None:
                have = " ".join(n.classes()) if attr == "class" else n.attrs[attr]
                if have != val:
                    return False
        if pseudo:
            i, n_all, k, n_same = place(n)
            ok = {"first-child": i == 0, "last-child": i == n_all - 1, "last-of-type": k == n_same - 1}.get(pseudo)
            if pseudo == "nth-last-child":
                ok = n_all - i == int(arg)
            elif pseudo == "nth-last-of-type":
                ok = n_same - k == int(arg)
            if ok is None:
                raise ValueError(f"unsupported pseudo-class :{pseudo}")
            if not ok:
                return False
    return True


def _match_from(n: Node, steps, i: int, memo: dict) -> bool:
    """Does ``n`` match steps[0..i] (step i on ``n`` itself)?  Relations are
    checked in the whole tree; ``select`` restricts results to a subtree.
    ``memo``: of each parent and step, the first child that matches it."""
    comb, parts = steps[i]
    if n.tag == "#root" or not _matches(n, parts):
        return False
    if i == 0:
        return True
    up = n.parent
    if comb == ">":
        return up is not None and _match_from(up, steps, i - 1, memo)
    if comb == " ":
        while up is not None:
            if _match_from(up, steps, i - 1, memo):
                return True
            up = up.parent
        return False
    k = place(n)[0]
    if comb == "+":
        return k > 0 and _match_from(up.elements()[k - 1], steps, i - 1, memo)
    if comb == "~":
        if up is None:
            return False
        key = (id(up), i)
        if key not in memo:
            memo[key] = next((j for j, s in enumerate(up.elements()) if _match_from(s, steps, i - 1, memo)), None)
        return memo[key] is not None and memo[key] < k
    raise ValueError(comb)


def matches(n: Node, steps, memo: dict | None = None) -> bool:
    """Does element ``n`` match the compiled selector ``steps``?"""
    return _match_from(n, steps, len(steps) - 1, {} if memo is None else memo)


def _found(root: Node, sel: str | list):
    steps = compile_selector(sel) if isinstance(sel, str) else sel
    memo: dict = {}
    return (n for n in root.iter() if _match_from(n, steps, len(steps) - 1, memo))


def select(root: Node, sel: str | list) -> list[Node]:
    return list(_found(root, sel))


def select_one(root: Node, sel: str | list):
    return next(_found(root, sel), None)

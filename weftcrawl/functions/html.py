"""HTML selection (S9, H1-H14), the parsed side of link extraction (L3, L4, L8, L18) and forms.

A tolerant tree on the standard library's tokenizer, a CSS and an XPath subset over it, and Arrow functions that parse a page
once and answer all of its selectors. Differences from a full HTML5 parser: misnested formatting elements stay where they
close, and no elements are invented but those that an end tag implies.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlencode, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content, with raw text, and those whose start ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "place", "content")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.place = tag, attrs, parent, [], 0
        self.content: tuple[int, int] | None = None

    def walk(self):
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def html(self) -> str:
        """H9. Without recursion: pages may be nested to any depth."""
        escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        out: list[str] = []
        stack: list[tuple[Node | str, bool]] = [(self, False)]
        while stack:
            n, raw = stack.pop()
            if isinstance(n, str):
                out.append(n if raw else escape(n))
                continue
            out.append("<" + n.tag + "".join(f' {k}="{escape(v).replace(chr(34), "&#34;")}"' for k, v in n.attrs.items()) + ">")
            if n.tag not in VOID:
                end = (f"</{n.tag}>", True)
                stack.append(end)
                raw = n.tag in ("script", "style")
                stack.extend((c, raw) for c in reversed(n.children))
        return "".join(out)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    """written: the page, where elements are to know the place of their content in it."""

    def __init__(self, written: str | None = None):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)
        self.count = 0
        self.lines = None if written is None else [0, *(m.end() for m in re.finditer("\n", written))]

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _leave(self, node: Node, end: int | None = None):
        """Closes the element and those that are open in it."""
        if self.lines is not None:
            end, n = self._here() if end is None else end, self.at
            while n is not node.parent:
                if n.content:
                    n.content = n.content[0], end
                n = n.parent
        self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close({"p"}, {"button", "table", "td", "th", "li"})
        if tag in ENDS:
            self._close(ENDS[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        node.attrs = dict(reversed(node.attrs.items()))
        self.count += 1
        node.place = self.count
        self.at.children.append(node)
        if self.lines is not None:
            inside = self._here() + len(self.get_starttag_text())
            node.content = inside, inside
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def _close(self, tags, scope):
        """Closes the outermost open element of tags inside the nearest of scope."""
        n, hit = self.at, None
        while n.parent is not None and n.tag not in scope:
            if n.tag in tags:
                hit = n
            n = n.parent
        if hit is not None:
            self._leave(hit)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self._leave(n)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None, written: bool = False) -> Node:
    """H1: never fails; nothing gives an empty document. written: elements know where in the page their content is."""
    b = _Builder((html or "") if written else None)
    try:
        b.feed(html or "")
        b.close()
    except (AssertionError, ValueError):
        pass
    if written and b.at is not b.root:
        top = b.at
        while top.parent is not b.root:
            top = top.parent
        b._leave(top, len(html or ""))
    return b.root


# ---- CSS -------------------------------------------------------------------------------------------------------------------

_SIMPLE = re.compile(r"""\s*(?:(?P<tag>\*|[\w-]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[^\]\s]+))\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?)""", re.X)


def _nth(arg: str, i: int) -> bool:
    arg = arg.replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    if "n" not in arg:
        return i == int(arg)
    a, _, b = arg.partition("n")
    a = int(a + "1") if a in ("", "+", "-") else int(a)
    b = int(b or 0)
    return (i - b) * (1 if a > 0 else -1) >= 0 and (i - b) % abs(a) == 0 if a else i == b


def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m.end() == at or (at and text[at].isspace()):
            raise ValueError(f"no selector: {text!r}")
        at = m.end()
        g = m.groupdict()
        if g["tag"]:
            tests.append(lambda n, t=g["tag"].lower(): t == "*" or n.tag == t)
        elif g["id"]:
            tests.append(lambda n, v=g["id"]: n.attrs.get("id") == v)
        elif g["cls"]:
            tests.append(lambda n, v=g["cls"]: v in n.attrs.get("class", "").split())
        elif g["attr"]:
            v = next((g[k] for k in ("dq", "sq", "raw") if g[k] is not None), "")
            tests.append(lambda n, k=g["attr"].lower(), op=g["op"], v=v: k in n.attrs and _attr(n.attrs[k], op, v))
        else:
            tests.append(_pseudo(g["pseudo"].lower(), g["arg"]))
    return lambda n: all(t(n) for t in tests)


def _attr(have: str, op: str | None, v: str) -> bool:
    if op is None:
        return True
    return {"=": have == v, "~=": v in have.split(), "^=": bool(v) and have.startswith(v), "$=": bool(v) and have.endswith(v), "*=": bool(v) and v in have, "|=": have == v or have.startswith(v + "-")}[op]


def _pseudo(name: str, arg: str | None):
    def place(n, same=False, last=False):
        own = [c for c in n.parent.elements() if not same or c.tag == n.tag] if n.parent else [n]
        i = own.index(n) + 1
        return len(own) - i + 1 if last else i

    if name == "not":
        inner = [_complex(x) for x in _split(arg or "")]
        return lambda n: not any(f(n) for f in inner)
    if name == "contains":
        return lambda n, v=(arg or "").strip("\"' "): v in n.text()
    table = {"first-child": lambda n: place(n) == 1, "last-child": lambda n: place(n, last=True) == 1, "only-child": lambda n: len(n.parent.elements()) == 1, "first-of-type": lambda n: place(n, True) == 1, "last-of-type": lambda n: place(n, True, True) == 1, "empty": lambda n: not n.children}
    if name in table:
        return table[name]
    if name in ("nth-child", "nth-last-child", "nth-of-type"):
        return lambda n: _nth(arg or "", place(n, name == "nth-of-type", name == "nth-last-child"))
    raise ValueError(f"no selector: {name}")


def _split(query: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(query):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(query[start:i])
            start = i + 1
    return [x.strip() for x in [*out, query[start:]]]


def _complex(query: str):
    steps = [x for x in re.split(r"""(\s*[>+~]\s*(?![^\[]*\])(?![^(]*\))|\s+(?![^\[]*\])(?![^(]*\)))""", query.strip()) if x]
    parts = [_compound(steps[i].strip()) for i in range(0, len(steps), 2)]
    joins = [steps[i].strip() or " " for i in range(1, len(steps), 2)]

    def match(n, i):
        if not parts[i](n):
            return False
        if i == 0:
            return True
        j = joins[i - 1]
        if j == ">":
            return n.parent is not None and n.parent.parent is not None and match(n.parent, i - 1)
        if j == " ":
            p = n.parent
            while p is not None and p.parent is not None:
                if match(p, i - 1):
                    return True
                p = p.parent
            return False
        own = n.parent.elements() if n.parent else [n]
        k = own.index(n)
        return (k > 0 and match(own[k - 1], i - 1)) if j == "+" else any(match(x, i - 1) for x in own[:k])

    return lambda n: match(n, len(parts) - 1)


@lru_cache(512)
def _css(query: str):
    """(test, pseudo element, its argument) of each selector of a list."""
    out = []
    for q in _split(query):
        m = re.search(r"::(text|attr\(\s*([\w:-]+)\s*\))\s*$", q)
        out.append((_complex((q[: m.start()] if m else q).strip() or "*"), (m.group(1)[:4] if m else None), m.group(2) if m else None))
    return out


def css(node: Node, query: str) -> list[Node | str]:
    """H2-H4: elements, or with ::text the text of each that has any; ::attr() gives nothing here. An invalid query gives none."""
    try:
        selectors = _css(query)
    except ValueError:
        return []
    out: list[Node | str] = []
    for n in node.walk():
        for test, kind, _ in selectors:
            if kind != "attr" and test(n):
                if kind == "text":
                    if t := n.text():
                        out.append(t)
                else:
                    out.append(n)
                break
    return out


def css_attr(node: Node, query: str, attr: str) -> list[str]:
    """H5."""
    return [n.attrs[attr] for n in css(node, query) if isinstance(n, Node) and attr in n.attrs]


# ---- XPath -----------------------------------------------------------------------------------------------------------------

_STEP = re.compile(r"(//|/|^)(?:(?P<axis>[\w-]+)::)?(?P<node>\.\.|\.|\*|@[\w:-]+|@\*|text\(\)|node\(\)|[\w-]+)(?P<preds>(?:\[(?:[^\[\]\"']|\"[^\"]*\"|'[^']*'|\[[^\]]*\])*\])*)")


def _value(n: Node, expr: str) -> str:
    expr = expr.strip()
    if expr[:1] in "\"'":
        return expr[1:-1]
    if expr in ("text()", "."):
        return n.own_text() if expr == "text()" else n.text()
    if m := re.fullmatch(r"normalize-space\((.*)\)", expr):
        return " ".join(_value(n, m.group(1) or ".").split())
    if expr.startswith("@"):
        return n.attrs.get(expr[1:], "")
    found = [x for x in xpath(n, "./" + expr)]
    return "" if not found else found[0] if isinstance(found[0], str) else found[0].text()


def _predicate(n: Node, p: str, place: int, last: int) -> bool:
    p = p.strip()
    for word, how in ((" or ", any), (" and ", all)):
        if len(parts := _outside(p, word)) > 1:
            return how(_predicate(n, x, place, last) for x in parts)
    if p.isdigit():
        return place == int(p)
    if p == "last()":
        return place == last
    if m := re.fullmatch(r"position\(\)\s*(<=|>=|=|<|>)\s*(\d+)", p):
        a, b = place, int(m.group(2))
        return {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[m.group(1)]
    if m := re.fullmatch(r"not\((.*)\)", p):
        return not _predicate(n, m.group(1), place, last)
    if m := re.fullmatch(r"(contains|starts-with)\((.*)\)", p):
        a, b = _outside(m.group(2), ",")
        return _value(n, b) in _value(n, a) if m.group(1) == "contains" else _value(n, a).startswith(_value(n, b))
    if len(parts := _outside(p, "!=")) == 2:
        return _value(n, parts[0]) != _value(n, parts[1])
    if len(parts := _outside(p, "=")) == 2:
        return _value(n, parts[0]) == _value(n, parts[1])
    if p.startswith("@"):
        return p[1:] in n.attrs
    return bool(xpath(n, p if p.startswith(".") else "./" + p))


def _outside(p: str, word: str) -> list[str]:
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(p):
        c = p[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and p.startswith(word, i):
            out.append(p[start:i])
            i = start = i + len(word)
            continue
        i += 1
    return [*out, p[start:]]


@lru_cache(512)
def _steps(expr: str) -> list[tuple[str, str, str, list[str]]]:
    out, at = [], 0
    while at < len(expr):
        m = _STEP.match(expr, at)
        if not m or m.end() == at:
            raise ValueError(f"no path: {expr!r}")
        preds = re.findall(r"\[((?:[^\[\]\"']|\"[^\"]*\"|'[^']*'|\[[^\]]*\])*)\]", m.group("preds"))
        out.append((m.group(1), m.group("axis") or "", m.group("node"), preds))
        at = m.end()
    return out


def xpath(node: Node, expr: str) -> list[Node | str]:
    """H6: elements, texts or attribute values. An invalid path gives none."""
    if len(parts := _outside(expr, "|")) > 1:
        return [x for p in parts for x in xpath(node, p.strip())]
    try:
        steps = _steps(expr.strip())
    except ValueError:
        return []
    top = node
    if expr.startswith("/"):
        while top.parent is not None:
            top = top.parent
    now: list[Node | str] = [top]
    for join, axis, name, preds in steps:
        new: list[Node | str] = []
        seen: set[int] = set()
        for n in now:
            if isinstance(n, str):
                continue
            if name == "." and join != "//":
                found: list[Node | str] = [n]
            elif name == "..":
                found = [n.parent] if n.parent else []
            elif name.startswith("@"):
                own = [n, *n.walk()] if join == "//" else [n]
                found = [v for x in own for k, v in x.attrs.items() if name == "@*" or k == name[1:]]
            elif name == "text()":
                own = [n, *n.walk()] if join == "//" else [n]
                found = [c for x in own for c in x.children if isinstance(c, str)]
            else:
                found = _axis(n, axis or ("descendant" if join == "//" else "child"))
                found = [x for x in found if name in ("*", "node()", ".") or x.tag == name.lower()]
            for p in preds:
                groups: dict[int, list] = {}
                for x in found:
                    groups.setdefault(id(x.parent) if isinstance(x, Node) and not axis else 0, []).append(x)
                found = [x for g in groups.values() for i, x in enumerate(g, 1) if isinstance(x, Node) and _predicate(x, p, i, len(g))]
                found.sort(key=lambda x: -x.place if axis.startswith(("ancestor", "preceding")) else x.place)
            for x in found:
                if isinstance(x, str) or id(x) not in seen:
                    seen.add(id(x))
                    new.append(x)
        now = new
    return [x for x in now if isinstance(x, str) or x.tag != "#document"]


def _axis(n: Node, axis: str) -> list[Node]:
    if axis == "child":
        return n.elements()
    if axis in ("descendant", "descendant-or-self"):
        return [*([n] if axis.endswith("self") else []), *n.walk()]
    if axis == "self":
        return [n]
    up = []
    p = n if axis == "ancestor-or-self" else n.parent
    while p is not None and p.parent is not None:
        up.append(p)
        p = p.parent
    if axis.startswith("ancestor"):
        return up
    if axis == "parent":
        return up[:1]
    own = n.parent.elements() if n.parent else [n]
    k = own.index(n)
    return own[k + 1 :] if axis == "following-sibling" else own[:k][::-1] if axis == "preceding-sibling" else []


# ---- columns ---------------------------------------------------------------------------------------------------------------

SELECTED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("html", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))]))


def _select(node: Node, query: str) -> list[Node | str]:
    """A query is CSS, or XPath where it begins with / or ./ or with xpath:."""
    if query.startswith("xpath:"):
        return xpath(node, query[6:])
    return xpath(node, query) if query[:1] == "/" or query[:2] == "./" or query[:3] == ".//" else css(node, query)


def _row(x: Node | str, markup: bool | str, page: str) -> dict:
    if isinstance(x, str):
        return {"text": x, "html": x if markup else None, "attrs": []}
    html = page[slice(*x.content)] if markup == "content" else x.html() if markup else None
    return {"text": x.text(), "html": html, "attrs": list(x.attrs.items())}


def select(html: str | Column, queries: dict[str, str | list[str]], markup: bool | str = False) -> Column:
    """A struct of arrays of (text, html, attrs), one for each query; the page is parsed once. A list of queries is a chain (H12):
    each is asked of what the one before found. html (H9) is null but where markup is asked for; with markup="content" it is what
    an element contains, as it is written in the page."""
    kind = T.StructType([T.StructField(k, SELECTED) for k in queries])
    arrow = pa.struct([(k, pa.list_(pa.struct([("text", pa.string()), ("html", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))) for k in queries])

    def found(page: Node, written: str, query) -> list[dict]:
        now: list[Node | str] = [page]
        for q in [query] if isinstance(query, str) else query:
            now = [x for n in now if isinstance(n, Node) for x in _select(n, q)]
        return [_row(x, markup, written) for x in now]

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        out = []
        for h in x:
            page = parse(h.as_py(), markup == "content")
            out.append({k: found(page, h.as_py() or "", q) for k, q in queries.items()})
        return pa.array(out, arrow)

    return run(html)


def get(selected: Column, default: str = "") -> Column:
    """H7: the first text, or the default where it is missing or empty."""
    t = F.get(selected, F.lit(0))["text"]
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(t)


def get_html(selected: Column, default: str = "") -> Column:
    """H9: the markup of the first, of select(..., markup=True) or its content."""
    return F.coalesce(F.get(selected, F.lit(0))["html"], F.lit(default))


def get_all(selected: Column) -> Column:
    """H8."""
    return F.filter(F.transform(selected, lambda x: x["text"]), lambda t: t != "")


def attr_all(selected: Column, name: str) -> Column:
    """H10."""
    return F.filter(F.transform(selected, lambda x: F.try_element_at(x["attrs"], F.lit(name))), lambda v: v.isNotNull())


def has_class(element: Column, name: str) -> Column:
    """H11."""
    return F.array_contains(F.split(F.coalesce(F.try_element_at(element["attrs"], F.lit("class")), F.lit("")), r"\s+"), name)


_LINK = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("text", T.StringType()), T.StructField("nofollow", T.BooleanType()), T.StructField("base", T.StringType())]))


def page_links(html: str | None, tags, attrs, css_scopes=(), xpath_scopes=()) -> list[dict]:
    """Of a page: the links in its scopes (all of it where no scope matches), in document order; attributes in the order given."""
    page = parse(html)
    base = next((n.attrs["href"].strip() for n in page.walk() if n.tag == "base" and n.attrs.get("href", "").strip()), "")
    scopes = [n for q in css_scopes for n in css(page, q) if isinstance(n, Node)] + [n for q in xpath_scopes for n in xpath(page, q) if isinstance(n, Node)]
    out: list[dict] = []
    for scope in scopes or [page]:
        for n in scope.walk() if scope is page else (scope, *scope.walk()):
            if n.tag in tags:
                for a in attrs:
                    if href := n.attrs.get(a, "").strip():
                        text = (n.own_text().strip() or n.text()).strip()
                        out.append({"pos": len(out), "href": href, "text": text, "nofollow": "nofollow" in n.attrs.get("rel", "").lower().split(), "base": base})
    return out


def link_rows(html: str | Column, rule) -> Column:
    tags, attrs, a, b = tuple(t.lower() for t in rule.tags), tuple(x.lower() for x in rule.attrs), tuple(rule.restrict_css), tuple(rule.restrict_xpath)
    arrow = pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("nofollow", pa.bool_()), ("base", pa.string())]))

    @F.arrow_udf(_LINK)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([page_links(h.as_py(), tags, attrs, a, b) for h in x], arrow)

    return run(html)


def form_request(html: str | None, url: str, data: dict[str, list[str]] | None = None, locator: dict | None = None, click: dict | bool | None = None) -> dict | None:
    """Method, url and body of submitting a form. locator: name, id, css, xpath or number, tried in this order; click: attributes
    of the control that is pressed, or False for none. The user's data override the form's. None: no such form."""
    page, data, locator = parse(html), data or {}, locator or {}
    forms = [n for n in page.walk() if n.tag == "form"]
    form = None
    for k, v in (("name", locator.get("name")), ("id", locator.get("id"))):
        form = form or next((f for f in forms if v and f.attrs.get(k) == v), None)
    for q in (locator.get("css"), locator.get("xpath")):
        if form is None and q:
            for n in _select(page, q if not q.startswith("(") else q):
                while isinstance(n, Node) and n.tag != "form" and n.parent is not None:
                    n = n.parent
                if isinstance(n, Node) and n.tag == "form":
                    form = n
                    break
    if form is None and not any(locator.get(k) for k in ("name", "id", "css", "xpath")):
        number = locator.get("number", 0)
        form = forms[number] if 0 <= number < len(forms) else None
    if form is None:
        return None
    method = form.attrs.get("method", "GET").upper()
    method = method if method in ("GET", "POST") else "GET"
    pairs: list[tuple[str, str]] = []
    for n in form.walk():
        name, kind = n.attrs.get("name", ""), n.attrs.get("type", "text").lower()
        if not name or name in data or "disabled" in n.attrs:
            continue
        if n.tag == "input" and kind not in ("submit", "image", "reset", "button", "file") and (kind not in ("checkbox", "radio") or "checked" in n.attrs):
            pairs.append((name, n.attrs.get("value", "on" if kind in ("checkbox", "radio") else "")))
        elif n.tag == "textarea":
            pairs.append((name, n.text().removeprefix("\n")))
        elif n.tag == "select":
            options = [o for o in n.walk() if o.tag == "option"]
            chosen = [o for o in options if "selected" in o.attrs] or ([] if "multiple" in n.attrs else options[:1])
            pairs += [(name, o.attrs.get("value", o.text().strip())) for o in (chosen if "multiple" in n.attrs else chosen[-1:])]
    if click is not False:
        buttons = [n for n in form.walk() if n.tag == "input" and n.attrs.get("type", "").lower() in ("submit", "image") or n.tag == "button" and n.attrs.get("type", "submit").lower() == "submit"]
        if isinstance(click, dict):
            buttons = [b for b in buttons if all(b.attrs.get(k) == v for k, v in click.items())]
        if buttons and buttons[0].attrs.get("name") and buttons[0].attrs["name"] not in data:
            pairs.append((buttons[0].attrs["name"], buttons[0].attrs.get("value", "")))
    pairs += [(k, v) for k, values in data.items() for v in values]
    body = urlencode(sorted(pairs, key=lambda p: p[0]))
    action = urljoin(url, form.attrs.get("action", "").strip() or url)
    if method == "POST":
        return {"method": method, "url": action, "body": body}
    return {"method": method, "url": action.split("#")[0].split("?")[0] + ("?" + body if body else ""), "body": ""}


def form_column(html: str | Column, url: str | Column, data: dict[str, list[str]] | None = None, locator: dict | None = None, click=None) -> Column:
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("method", "url", "body")])

    @F.arrow_udf(kind)
    def run(h: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array([form_request(x.as_py(), y.as_py() or "", data, locator, click) for x, y in zip(h, u, strict=True)], pa.struct([(n, pa.string()) for n in ("method", "url", "body")]))

    return run(html, url)

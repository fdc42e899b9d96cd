"""HTML source: one Arrow kernel a page, from markup to flat arrays of fragments, links, media, forms and signals.

The tree is built on the standard library's tokenizer by the rules that results depend on: void elements, raw text,
end tags that others imply (p, li, dt, dd, option, table parts), and formatting elements that are opened again in
later blocks when they were never closed (at most three alike). Everything after the kernel is relational.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.store import spread

# Element sets and class hints.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template head link meta svg iframe object embed".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCK = frozenset("div p section article main aside header footer nav li dd dt blockquote pre td th tr figure figcaption h1 h2 h3 h4 h5 h6 ul ol dl table form fieldset address hgroup details summary".split())
CLOSES_P = BLOCK - {"td", "th", "tr"} | {"hr", "menu", "center", "dir"}
PAYLOADS = ("__NUXT_DATA__", "__NEXT_DATA__")
SECTIONING = frozenset("article section aside nav main".split())
HINTS = ("nav", "menu", "header", "footer", "sidebar", "breadcrumb", "cookie", "banner", "advert", "promo", "social", "share", "subscribe", "newsletter", "related", "recommend", "comment", "pagination", "skip-link")
SIZES = {"h1": (32.0, 700), "h2": (24.0, 700), "h3": (18.72, 700), "h4": (16.0, 700), "h5": (13.28, 700), "h6": (10.72, 700), "strong": (16.0, 700), "b": (16.0, 700), "small": (13.0, 400), "figcaption": (13.0, 400), "cite": (13.0, 400), "code": (15.0, 400), "pre": (15.0, 400), "kbd": (15.0, 400), "samp": (15.0, 400)}
ROLES = {"navigation": "nav", "menu": "nav", "menubar": "nav", "banner": "header", "contentinfo": "footer", "main": "main", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog"}
SHORT_RUN = 2
MENU_ROLES = ("navigation", "menu", "menubar", "toolbar")
FOLDED_PROSE = 120
REFUSED = re.compile(
    r"\b(18|21)\+?\b|over\s*(18|21)|of\s+legal\s+age|\bi\s*am\b|i'?m\s+over|accept|agree|consent|cookie|privacy|terms|gdpr|allow\s+all|sign\s*in|sign\s*up|log\s*in|register|subscribe|newsletter|\bbuy\b|purchase|checkout|add\s+to\s+(cart|bag)|\bpay\b|\border\b|donate|delete|remove|submit|\bsend\b|download|install",
    re.IGNORECASE | re.ASCII,
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.html = Node("html", {}, self.root)
        self.root.children.append(self.html)
        self.stack = [self.root, self.html]
        self.active: list[Node] = []
        self.body: Node | None = None

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        self.stack.append(node)
        return node

    def _open(self, tag: str) -> bool:
        return any(n.tag == tag for n in self.stack)

    def _pop_to(self, tag: str) -> None:
        while len(self.stack) > 2 and self.stack.pop().tag != tag:
            pass

    def _close_p(self) -> None:
        if self._open("p"):
            self._pop_to("p")

    def _need_body(self) -> None:
        if self.body is None:
            while len(self.stack) > 2:
                self.stack.pop()
            self.body = self._push("body", {})

    def _reopen(self) -> None:
        for i, n in enumerate(self.active):
            if n not in self.stack:
                self.active[i] = self._push(n.tag, n.attrs)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html":
            self.html.attrs = attrs | self.html.attrs
            return
        if tag == "head":
            if not self._open("head") and self.body is None:
                self._push("head", attrs)
            return
        if tag == "body":
            if self.body is None:
                self._need_body()
            self.body.attrs = attrs | self.body.attrs
            return
        in_head = tag in ("title", "meta", "link", "script", "style", "base", "template", "noscript")
        if self.body is None and not in_head:
            self._need_body()
        if self.body is None and not self._open("head"):
            self._push("head", {})
        if self.body is not None:
            if tag in CLOSES_P:
                self._close_p()
            if tag in ("li",):
                self._implied({"li"}, {"ul", "ol"})
            elif tag in ("dt", "dd"):
                self._implied({"dt", "dd"}, {"dl"})
            elif tag in ("tr",):
                self._implied({"tr"}, {"table", "tbody", "thead", "tfoot"})
            elif tag in ("td", "th"):
                self._implied({"td", "th"}, {"tr", "table"})
            elif tag == "option":
                self._implied({"option"}, {"select"})
            elif tag == "a":
                for n in [n for n in self.active if n.tag == "a"]:
                    self.active.remove(n)
                    if n in self.stack:
                        self._pop_to("a")
            elif re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.stack[-1].tag):
                self.stack.pop()
            if tag not in SKIP and tag not in CLOSES_P and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                self._reopen()
        node = self._push(tag, attrs)
        if tag in VOID:
            self.stack.pop()
        elif tag in FORMATTING:
            alike = [n for n in self.active if n.tag == tag and n.attrs == attrs]
            if len(alike) >= 3:
                self.active.remove(alike[0])
            self.active.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing on elements that aren't void

    def _implied(self, tags: set[str], until: set[str]) -> None:
        for n in reversed(self.stack):
            if n.tag in tags:
                self._pop_to(n.tag)
                return
            if n.tag in until or n.tag in ("#document", "body"):
                return

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "p" and not self._open("p"):
            self._need_body()
            self._push("p", {})
            self.stack.pop()
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if not self._open(tag):
            return
        if tag in FORMATTING:
            for n in reversed(self.active):
                if n.tag == tag:
                    self.active.remove(n)
                    break
        self._pop_to(tag)

    def handle_data(self, data):
        at = self.stack[-1]
        if at.tag in ("script", "style", "title", "textarea", "noscript", "template"):
            at.children.append(data)
            return
        if self.body is None:
            if not data.strip():
                return
            self._need_body()
        if data.strip() or self.stack[-1].tag in FORMATTING:
            self._reopen()
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def text_of(node: Node | str, skip: frozenset[str] = SKIP) -> str:
    if isinstance(node, str):
        return node
    if node.tag in skip:
        return ""
    return " ".join(text_of(c, skip) for c in node.children)


UNREAD = frozenset("script style noscript template".split())


def written_chars(node: Node) -> int:
    """Characters of a subtree's markup once tags are stripped from it, escapes counted as they are written."""
    said = _squeeze(text_of(node, UNREAD))
    return len(said) + 4 * (said.count("&") + said.count('"') + said.count("'")) + 3 * (said.count("<") + said.count(">"))


def folded_chars(node: Node) -> int:
    """Characters of a shut region, 0 if it is something to navigate with or holds too little to read."""
    if node.tag == "nav" or node.attrs.get("role", "").lower() in MENU_ROLES:
        return 0

    def linked(n: Node) -> int:
        return written_chars(n) if n.tag in ("a", "button") else sum(linked(c) for c in n.children if isinstance(c, Node))

    total = written_chars(node)
    return total if total >= FOLDED_PROSE and 2 * linked(node) < total else 0


def folded(root: Node) -> tuple[int, int]:
    """Shut regions that hold prose, and their characters; a region within one is not counted again."""
    shut: set[str] = set()
    found: list[int] = []

    def controls(n: Node) -> None:
        if n.attrs.get("aria-expanded", "").lower() == "false" and not REFUSED.search(_squeeze(text_of(n))):
            shut.update(n.attrs.get("aria-controls", "").split())
        for c in n.children:
            if isinstance(c, Node):
                controls(c)

    def regions(n: Node) -> None:
        if n.tag == "details" and "open" not in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true" or n.attrs.get("id", "") in shut:
            found.append(folded_chars(n))
            return
        for c in n.children:
            if isinstance(c, Node):
                regions(c)

    controls(root)
    regions(root)
    return sum(x > 0 for x in found), sum(found)


def _squeeze(s: str) -> str:
    return " ".join(s.split())


def hiding(style: str) -> str:
    """Why declarations hide an element, empty if they don't."""
    found = {}
    for d in style.lower().split(";"):
        k, _, v = d.partition(":")
        found[k.strip()] = v.replace("!important", "").strip()
    if found.get("display") == "none":
        return "display-none"
    if found.get("visibility") in ("hidden", "collapse"):
        return "visibility-hidden"
    try:
        if "opacity" in found and float(found["opacity"]) == 0:
            return "opacity-zero"
    except ValueError:
        pass
    color, back = found.get("color"), found.get("background-color") or found.get("background")
    return "same-colour" if color and color == back else ""


def strip_comments(css: str) -> str:
    css = re.sub(r"(?s)/\*.*?\*/", "", css)
    return css.partition("/*")[0]


class Sheet:
    """Simple selectors that hide; others are counted, not evaluated. Of one style element the first RULES rules count: a
    fixed value that results depend on."""

    RULES = 4000

    def __init__(self):
        self.by: dict[str, dict[str, str]] = {"#": {}, ".": {}, "": {}}
        self.complex = 0

    def add(self, css: str) -> None:
        for selectors, body in re.findall(r"([^{}@]+)\{([^{}]*)\}", strip_comments(css))[: self.RULES]:
            reason = hiding(body)
            if not reason:
                continue
            for s in map(str.strip, selectors.split(",")):
                if re.search(r"[ >+~:()\[\]*]", s):
                    self.complex += 1
                elif m := re.fullmatch(r"([#.]?)([\w-]+)", s):
                    self.by[m[1]].setdefault(m[2].lower() if not m[1] else m[2], reason)

    def match(self, n: Node) -> str:
        out = self.by["#"].get(n.attrs.get("id", ""), "")
        for c in n.attrs.get("class", "").split():
            out = out or self.by["."].get(c, "")
        return out or self.by[""].get(n.tag, "")


class Extractor:
    def __init__(self, html: str):
        self.out = {k: [] for k in ("fragments", "links", "media", "forms", "buttons", "latent", "json_ld", "payloads")}
        self.signals = Counter()
        self.html, self.title, self.lang, self.og = html, "", "", {}
        self.description = ""
        self.hydration, self.noscript = False, False
        self.sheet, self.line, self.x = Sheet(), 0, {}
        root = parse(html)
        marks = {"header": [], "footer": []}
        self._scan(root, False, marks)
        self.banner = {id(x) for x in marks["header"][:1] + marks["footer"][-1:]}
        self.signals["folded_controls"], self.signals["folded_chars"] = folded(root)
        for c in root.children:
            if isinstance(c, Node):
                self.walk(c, c.tag, "", "", "", 0, False, 0)

    def _scan(self, n: Node, sectioned: bool, marks) -> None:
        if n.tag == "style":
            self.sheet.add("".join(c for c in n.children if isinstance(c, str)))
        if n.tag == "script" and n.attrs.get("type", "").strip().lower() == "application/json" and n.attrs.get("id", "").strip() in PAYLOADS:
            self.out["payloads"].append("".join(c for c in n.children if isinstance(c, str)))
        if n.tag == "link" and "stylesheet" in n.attrs.get("rel", "").lower().split():
            self.signals["sheets"] += 1
        if n.tag in marks and not sectioned:
            marks[n.tag].append(n)
        for c in n.children:
            if isinstance(c, Node):
                self._scan(c, sectioned or n.tag in SECTIONING, marks)

    def landmark(self, n: Node, sectioned: bool) -> str:
        if n.tag in ("nav", "main", "aside", "form", "dialog"):
            return n.tag
        if n.tag in ("header", "footer"):
            return "" if sectioned else n.tag
        if (role := n.attrs.get("role", "").lower()) in ROLES:
            return ROLES[role]
        joined = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()
        hint = next((h for h in HINTS if h in joined), "")
        if hint in ("nav", "menu", "breadcrumb", "pagination", "skip-link"):
            return "nav"
        return "header" if hint in ("header", "banner") else "footer" if hint == "footer" else "aside" if hint else ""

    def hidden(self, n: Node) -> str:
        a = n.attrs
        if "hidden" in a:
            return "hidden-attribute"
        if a.get("aria-hidden", "").lower() == "true":
            return "aria-hidden"
        if reason := hiding(a.get("style", "")):
            return reason
        if n.tag == "details" and "open" not in a:
            return "closed-details"
        return self.sheet.match(n)

    def head(self, n: Node) -> None:
        for c in n.children:
            if not isinstance(c, Node):
                continue
            if c.tag == "title" and not self.title:
                self.title = _squeeze(text_of(c, frozenset()))
            elif c.tag == "meta":
                key = (c.attrs.get("property") or c.attrs.get("name") or "").lower()
                if key == "description":
                    self.description = _squeeze(c.attrs.get("content", ""))
                elif key.startswith(("og:", "twitter:")):
                    self.og[key] = c.attrs.get("content", "")
            elif c.tag == "script":
                self.script(c)
            elif c.tag == "noscript":
                self.check_noscript(c)
            elif c.tag not in SKIP:
                self.head(c)

    def script(self, n: Node) -> None:
        body = "".join(c for c in n.children if isinstance(c, str))
        kind = n.attrs.get("type", "").lower()
        if kind == "application/ld+json":
            if 0 < len(body) < 256 << 10:
                self.out["json_ld"].append(body)
            return
        self.signals["script_bytes"] += len(body.encode()) + 2048 * bool(n.attrs.get("src"))
        if n.attrs.get("id") in PAYLOADS or "__INITIAL_STATE__" in body or "__NUXT__" in body:
            self.hydration = True

    def check_noscript(self, n: Node) -> None:
        said = text_of(n, frozenset()).lower()
        self.noscript |= bool(re.search("javascript|js", said) and re.search("enable|require|need|turn on|activate|support", said))

    def walk(self, n: Node, path, block, landmark, href, depth, sectioned, parent_line) -> None:
        if n.tag in SKIP:
            if n.tag == "script":
                self.script(n)
            elif n.tag == "head":
                self.head(n)
            elif n.tag == "noscript":
                self.check_noscript(n)
            return
        if lm := self.landmark(n, sectioned):
            if n.tag not in ("header", "footer") or id(n) in self.banner:
                landmark = lm
                self.signals["landmarks"] += 1
        sectioned = sectioned or n.tag in SECTIONING
        a = n.attrs
        if n.tag == "html":
            self.lang = a.get("lang", "")
        if n.tag == "a" and a.get("href"):
            href = a["href"]
            label = _squeeze(text_of(n)) or _squeeze(a.get("aria-label", ""))
            self.out["links"].append({"seq": len(self.out["links"]), "href": href, "label": label, "landmark": landmark})
        if n.tag == "canvas":
            self.signals["canvases"] += 1
        if n.tag == "img":
            self.signals["images"] += 1
            self.out["media"].append({"seq": len(self.out["media"]), "src": a.get("src") or a.get("data-src", ""), "alt": _squeeze(a.get("alt", "")), "title": _squeeze(a.get("title", "")), "decorative": a.get("alt") == ""})
        if n.tag == "form":
            self.form(n, landmark)
        if n.tag == "button" and (label := _squeeze(text_of(n)) or _squeeze(a.get("aria-label", ""))):
            self.out["buttons"].append({"seq": len(self.out["buttons"]), "label": label, "landmark": landmark, "disabled": "disabled" in a})
        if reason := self.hidden(n):
            self.harvest(n, 0)
            said = _squeeze(text_of(n))
            if said:
                label = next((_squeeze(text_of(c)) for c in n.children if isinstance(c, Node) and c.tag == "summary"), "") if n.tag == "details" else ""
                self.out["latent"].append({"seq": len(self.out["latent"]), "text": said, "tag": n.tag, "reason": reason, "control": label or _squeeze(a.get("aria-label", ""))})
            return
        if n.tag in BLOCK:
            block = path
        line = parent_line
        if not line and any(isinstance(c, str) and c.strip() for c in n.children):
            self.line += 1
            line = self.line
        counts: Counter = Counter()
        held: list[str] = []

        def flush():
            self.fragment(n, "".join(held), path, block, landmark, href, depth, line)
            held.clear()

        for c in n.children:
            if isinstance(c, str):
                held.append(c)
                continue
            if c.tag == "br":
                held.append(" ")
                continue
            if c.tag not in SKIP:
                flush()
            k = counts[c.tag]
            counts[c.tag] += 1
            self.walk(c, f"{path}/{c.tag}" + (f"[{k}]" if k else ""), block, landmark, href, depth + 1, sectioned, 0 if c.tag in BLOCK else line)
        flush()

    def harvest(self, n: Node, depth: int) -> None:
        if depth > 12:
            return
        for c in n.children:
            if isinstance(c, Node):
                if c.tag == "script" and c.attrs.get("type", "").lower() == "application/ld+json":
                    self.script(c)
                self.harvest(c, depth + 1)

    def form(self, n: Node, landmark: str) -> None:
        fields = []

        def inputs(x: Node):
            for c in x.children:
                if isinstance(c, Node):
                    kind = c.attrs.get("type", "text" if c.tag == "input" else c.tag).lower()
                    if c.tag in ("input", "select", "textarea") and kind not in ("hidden", "submit", "button", "reset", "image"):
                        fields.append({"name": c.attrs.get("name", ""), "type": kind, "required": "required" in c.attrs})
                    inputs(c)

        inputs(n)
        self.out["forms"].append({"seq": len(self.out["forms"]), "action": n.attrs.get("action", ""), "method": n.attrs.get("method", "get").upper(), "landmark": landmark, "fields": fields})

    def fragment(self, n: Node, raw, path, block, landmark, href, depth, line) -> None:
        said = _squeeze(raw)
        if not said:
            return
        if re.fullmatch("h[1-6]", n.tag):
            self.signals["headings"] += 1
        elif n.tag == "p":
            self.signals["paragraphs"] += 1
        self.signals["text_chars"] += len(said)
        self.signals["text_runs"] += 1
        self.signals["short_runs"] += len(said) <= SHORT_RUN
        if not line:
            self.line += 1
            line = self.line
        size, weight = SIZES.get(n.tag, (16.0, 400))
        pad = (raw[0] in " \t\n\r\f") + 2 * (raw[-1] in " \t\n\r\f")
        self.out["fragments"].append({"seq": len(self.out["fragments"]), "line": line, "path": path, "block": block, "tag": n.tag, "role": n.attrs.get("role", ""), "landmark": landmark, "href": href, "text": said, "pad": pad, "size": size, "weight": weight, "depth": depth})


_FRAGMENT = "array<struct<seq:int,line:int,path:string,block:string,tag:string,role:string,landmark:string,href:string,text:string,pad:int,size:double,weight:int,depth:int>>"
_SIGNALS = ("folded_controls", "folded_chars", "text_chars", "text_runs", "short_runs", "headings", "paragraphs", "landmarks", "images", "canvases", "sheets", "script_bytes")
SCHEMA = (
    f"page_id long, url string, title string, description string, lang string, og map<string,string>, fragments {_FRAGMENT}, "
    "links array<struct<seq:int,href:string,label:string,landmark:string>>, media array<struct<seq:int,src:string,alt:string,title:string,decorative:boolean>>, "
    "forms array<struct<seq:int,action:string,method:string,landmark:string,fields:array<struct<name:string,type:string,required:boolean>>>>, "
    "buttons array<struct<seq:int,label:string,landmark:string,disabled:boolean>>, "
    "latent array<struct<seq:int,text:string,tag:string,reason:string,control:string>>, json_ld array<string>, payloads array<string>, "
    + ", ".join(f"{s} long" for s in _SIGNALS) + ", complex_rules long, html_bytes long, noscript boolean, hydration boolean"
)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and what the kernel finds in html, as one row of arrays a page; null html counts as empty. A table of fewer
    partitions than cores is dealt out to all of them; a larger one is parsed where it is read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA)) if hasattr(StructType, "fromDDL") else None

    def one(page_id, url, html):
        e = Extractor(html or "")
        return {"page_id": page_id, "url": url, "title": e.title, "description": e.description, "lang": e.lang, "og": list(e.og.items()), **e.out, **{s: e.signals[s] for s in _SIGNALS}, "complex_rules": e.sheet.complex, "html_bytes": len((html or "").encode("utf-8", "surrogatepass")), "noscript": e.noscript, "hydration": e.hydration}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                rows = [one(*r) for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(run, SCHEMA)

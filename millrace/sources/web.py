"""Parsing of what a crawl brings home: HTML, robots.txt, sitemaps and feeds, PDF text, charsets.

Parsers are plain functions on one document, used inside Arrow-batched ``mapInPandas`` calls; fetching is
not a Spark job and is modelled as a table of outcomes.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements without text of their own, and the frame around an article.
DROPPED = set("script style noscript template svg canvas iframe object video audio picture map form input select option textarea button label nav header footer aside".split())
BLOCK = set("p div section article main li ul ol table tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure br hr".split())
#: Words of a class or id that tell the frame of a page, and those that tell an article all the same.
FRAME = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies drawer footer header hidden masthead menu modal nav navbar "
    "navigation newsletter pager pagination popup promo recommend recommended related share sharing sidebar signup social subscribe toolbar widget".split()
)
ARTICLE = set("article blog body content devotional entry main markdown post prose sermon story teaching text".split())
CONTAINERS = set("div section body main article".split())
LEAST_MAIN = 200


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("p", "li", "td", "th", "tr") and self.open[-1].tag == tag:  # left unclosed
            self.open.pop()
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _framed(node: _Node) -> bool:
    """Whether an element is never part of the article, by its name, its visibility or the words of its class and id."""
    if node.tag in DROPPED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    words = set(re.split(r"[\s_-]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))
    return not words.isdisjoint(FRAME) and words.isdisjoint(ARTICLE)


class _Flat:
    """A tree in one pass over a stack: its elements in order, pieces of visible text, and each visible element's range of pieces.

    Running totals of characters, all and inside links, give the size and link share of any element without
    going through it again, however deep elements are nested.
    """

    def __init__(self, root: _Node):
        self.nodes: list[_Node] = []
        self.pieces: list[str] = []
        self.ranges: dict[int, tuple[int, int]] = {}
        size, linked = [0], [0]

        def put(piece: str, in_link: bool, counts: bool) -> None:
            n = len(" ".join(piece.split())) if counts else 0
            self.pieces.append(piece)
            size.append(size[-1] + n)
            linked.append(linked[-1] + n * in_link)

        enter, leave = 0, 1
        todo: list[tuple] = [(enter, root, True, False)]
        while todo:
            step, node, shown, in_link = todo.pop()
            if isinstance(node, str):
                if shown:
                    put(node, in_link, True)
                continue
            if step == leave:
                if node.tag in BLOCK:
                    put("\n", False, False)
                self.ranges[id(node)] = (self.ranges[id(node)][0], len(self.pieces))
                continue
            self.nodes.append(node)
            shown = shown and not _framed(node)
            if shown:
                if node.tag in BLOCK:
                    put("\n", False, False)
                self.ranges[id(node)] = (len(self.pieces), len(self.pieces))
                level = node.tag[1:] if node.tag[0] == "h" else ""
                if level.isdigit():
                    put("#" * int(level) + " ", False, False)
                elif node.tag == "li":
                    put("- ", False, False)
                todo.append((leave, node, True, in_link))
            todo += [(enter, kid, shown, in_link or node.tag == "a") for kid in reversed(node.kids)]
        self.size, self.linked = size, linked

    def length(self, node: _Node) -> int:
        lo, hi = self.ranges.get(id(node), (0, 0))
        return self.size[hi] - self.size[lo]

    def prose(self, node: _Node) -> int:
        """Characters, those inside links counted against an element."""
        lo, hi = self.ranges.get(id(node), (0, 0))
        return self.size[hi] - self.size[lo] - 3 * (self.linked[hi] - self.linked[lo])

    def text(self, node: _Node) -> str:
        lo, hi = self.ranges.get(id(node), (0, 0))
        return _lines("".join(self.pieces[lo:hi]))


def _lines(text: str) -> str:
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def _own_text(node: _Node) -> str:
    return _lines("".join(k for k in node.kids if isinstance(k, str)))


def article_data(scripts: list[str]) -> dict:
    """The first JSON-LD object of an article or page type, looked for in lists and ``@graph`` breadth first."""
    for script in scripts:
        try:
            level = [json.loads(script)]
        except ValueError:
            continue
        for _ in range(8):
            below = []
            for node in level:
                if isinstance(node, list):
                    below += node
                elif isinstance(node, dict):
                    kinds = node.get("@type")
                    kinds = kinds if isinstance(kinds, list) else [kinds]
                    if any(isinstance(k, str) and re.search("article|blogposting|webpage", k, re.I) for k in kinds):
                        return node
                    below.append(node.get("@graph"))
            level = below
    return {}


def names_of(author) -> str | None:
    """Authors of a JSON-LD object: a name, an object with a name, or a list of them."""
    several = author if isinstance(author, list) else [author]
    names = [a if isinstance(a, str) else a.get("name") if isinstance(a, dict) else None for a in several]
    return ", ".join(n for n in names if isinstance(n, str) and n) or None


def instant(value, now: datetime | None = None) -> str | None:
    """A date or time as ISO text in UTC; null if it does not parse or lies more than a day ahead of ``now``."""
    if not isinstance(value, str) or not value.strip():
        return None
    try:
        found = datetime.fromisoformat(value.strip())
    except ValueError:
        try:
            found = parsedate_to_datetime(value.strip())
        except (TypeError, ValueError):
            return None
    found = found.replace(tzinfo=found.tzinfo or timezone.utc).astimezone(timezone.utc)
    if now is not None and found > now + timedelta(days=1):
        return None
    return found.strftime("%Y-%m-%dT%H:%M:%SZ")


def language_tag(*values) -> str | None:
    """The primary tag, lower case, of the first value if that has two or three letters."""
    value = next((v for v in values if isinstance(v, str) and v), "")
    tag = re.split("[-_]", value.lower())[0]
    return tag if re.fullmatch("[a-z]{2,3}", tag) else None


def extract(html: str, now: datetime | None = None) -> dict:
    """Metadata, text (Markdown-like), links and block hashes of a page.

    The article is the first of main, article and role=main that has ``LEAST_MAIN`` characters, else the container with
    the most characters outside links.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    flat = _Flat(tree.root)
    nodes = flat.nodes
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    meta: dict[str, str] = {}
    for n in nodes:
        name = n.tag == "meta" and (n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or "").lower()
        if name and n.attrs.get("content"):
            meta.setdefault(name, n.attrs["content"])
    data = article_data([_raw(n) for n in nodes if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json"])
    told = [n for tag in ("main", "article") for n in nodes if n.tag == tag] + [n for n in nodes if n.attrs.get("role") == "main"]
    best = next((n for n in told if flat.length(n) >= LEAST_MAIN), None)
    if best is None:
        # Of equal containers the inner one, which comes last in order, is the article.
        containers = [(flat.prose(n), k) for k, n in enumerate(nodes) if n.tag in CONTAINERS and id(n) in flat.ranges]
        best = nodes[max(containers)[1]] if containers else tree.root
    text = flat.text(best)
    html_node, title = first("html"), first("title")
    canonical = next((n.attrs.get("href") for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split()), None)
    clean = lambda *values: next((v for v in (" ".join(x.split()) for x in values if isinstance(x, str)) if v), None)
    return {
        "title": clean(data.get("headline"), meta.get("og:title"), _own_text(title) if title else None),
        "description": clean(meta.get("description"), meta.get("og:description"), data.get("description")),
        "lang": language_tag(html_node.attrs.get("lang") if html_node else None, meta.get("og:locale"), data.get("inLanguage")),
        "canonical": canonical or None,
        "author": clean(names_of(data.get("author")), meta.get("author"), meta.get("article:author")),
        "published": instant(data.get("datePublished") or meta.get("article:published_time") or meta.get("date"), now),
        "modified": instant(data.get("dateModified") or meta.get("article:modified_time"), now),
        "image": meta.get("og:image"),
        "robots": meta.get("robots") or None,
        "text": text,
        "links": [{"href": n.attrs["href"], "rel": n.attrs.get("rel")} for n in nodes if n.tag == "a" and n.attrs.get("href")],
        "blocks": [block_hash(b) for b in text.split("\n")],
    }


def _raw(node: _Node) -> str:
    return "".join(k for k in node.kids if isinstance(k, str))


def block_key(block: str) -> str:
    """A block without heading and list marks, case and spacing: what makes two blocks the same."""
    return " ".join(re.sub(r"^\s*(?:#{1,6}|-)\s+", "", block).lower().split())


def block_hash(block: str) -> str:
    return hashlib.sha1(block_key(block).encode()).hexdigest()


def without_boilerplate(blocks: list[str], known: set[str], title: str | None = None) -> list[str]:
    """Blocks whose hash is not ``known``; a first-level heading and the page's own title, unless in a list, always stay."""
    own = block_key(title or "")
    stays = lambda b: b.startswith("# ") or (own != "" and not b.lstrip().startswith("- ") and block_key(b) == own)
    return [b for b in blocks if stays(b) or block_hash(b) not in known]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, title, description, author, lang, published, modified, text, n_links, n_blocks of pages (page_id, html)."""

    def parse(batches):
        for batch in batches:
            rows = [extract(h) for h in batch["html"]]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    **{k: [r[k] for r in rows] for k in ("title", "description", "author", "lang", "published", "modified", "text")},
                    "n_links": [len(r["links"]) for r in rows],
                    "n_blocks": [len(r["blocks"]) for r in rows],
                }
            )

    schema = "page_id bigint, title string, description string, author string, lang string, published string, modified string, text string, n_links int, n_blocks int"
    return pages.select("page_id", "html").mapInPandas(parse, schema)


def robots_groups(text: str) -> tuple[list[dict], list[str]]:
    """Groups (agents, rules as (allow, path), delay) and sitemaps of a robots.txt."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    naming = False
    for raw in (text or "")[: 512 * 1024].splitlines():
        field, colon, value = raw.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not naming:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            naming = True
        elif field == "sitemap" and value:
            sitemaps.append(value)
        elif groups and field in ("allow", "disallow"):
            naming = False
            if value or field == "allow":
                groups[-1]["rules"].append((field == "allow", value))
        elif groups and field == "crawl-delay":
            naming = False
            try:
                groups[-1]["delay"] = float(value)
            except ValueError:
                pass
    return groups, sitemaps


def robots_rules(text: str, agent: str):
    """The test whether ``agent`` may fetch a path, the file parsed once: most specific group, longest rule, allow on ties."""
    groups, _ = robots_groups(text)
    named = [(len(a), -k) for k, g in enumerate(groups) for a in g["agents"] if a != "*" and a in agent.lower()]
    star = [-k for k, g in enumerate(groups) if "*" in g["agents"]]
    if not named and not star:
        return lambda path: True
    group = groups[-max(named)[1]] if named else groups[-max(star)]
    rules = []
    for allow, rule in group["rules"]:
        end = "$" if rule.endswith("$") else ""
        pattern = ".*".join(map(re.escape, (rule[:-1] if end else rule).split("*"))) + end
        rules.append((len(rule), allow, re.compile(pattern)))
    return lambda path: max([(-1, True), *((n, allow) for n, allow, pattern in rules if pattern.match(path or "/"))])[1]


def robots_allows(text: str, agent: str, path: str) -> bool:
    """Whether ``agent`` may fetch ``path``."""
    return robots_rules(text, agent)(path)


def robots_directives(value: str | None, agent: str | None = None) -> dict:
    """Directives of a robots meta tag or of X-Robots-Tag; those under a bot's name count only for that ``agent``."""
    words, named = set(), None
    for part in re.split(r"[,\s]+", (value or "").lower()):
        name, colon, rest = part.partition(":")
        if colon and name not in ("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"):
            named, part = name, rest
        if part and (named is None or (agent is not None and named in agent.lower())):
            words.add(part)
    return {"noindex": bool(words & {"noindex", "none"}), "nofollow": bool(words & {"nofollow", "none"}), "noarchive": "noarchive" in words}


def plain_page(text: str | None) -> dict:
    """A text/plain body or the text layer of a PDF in the shape of ``extract``: the first line is the title."""
    lines = _lines((text or "").replace("\f", "\n"))
    first = lines.split("\n", 1)[0].lstrip("# ")
    empty = dict.fromkeys(("description", "lang", "canonical", "author", "published", "modified", "image", "robots"))
    return {"title": first[:200] or None, **empty, "text": lines, "links": [], "blocks": [block_hash(b) for b in lines.split("\n") if b]}


def sitemap_entries(xml: str) -> tuple[str, list[tuple[str, str | None]]]:
    """Kind (urlset, index, rss, atom, unknown) and (url, last change) of a sitemap or feed; namespaces are ignored."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return "unknown", []
    name = lambda e: e.tag.rpartition("}")[2].lower()
    child = lambda e, *tags: next((c.text.strip() for c in e if name(c) in tags and c.text), None)
    kinds = {"urlset": ("urlset", "url"), "sitemapindex": ("index", "sitemap"), "rss": ("rss", "item"), "rdf": ("rss", "item"), "feed": ("atom", "entry")}
    if name(root) not in kinds:
        return "unknown", []
    kind, entry = kinds[name(root)]
    out = []
    for e in root.iter():
        if name(e) == entry:
            url = child(e, "loc") if kind in ("urlset", "index") else child(e, "link")
            if kind == "atom":
                links = [c for c in e if name(c) == "link"]
                url = next((c.get("href") for c in links if c.get("rel", "alternate") == "alternate"), None)
            if url:
                out.append((url, child(e, "lastmod", "pubdate", "updated", "published", "date")))
    return kind, out


def pdf_text(data: bytes) -> tuple[str | None, str | None]:
    """Text layer of a PDF and, without one, the reason: not_a_pdf, encrypted, no_text_layer or thin_content."""
    if not data.startswith(b"%PDF-"):
        return None, "not_a_pdf"
    if b"/Encrypt" in data:
        return None, "encrypted"
    pieces: list[str] = []
    for match in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = match[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            line = []
            for array, simple in re.findall(rb"\[((?:\((?:\\.|[^\\)])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\)])*\))\s*(?:Tj|'|\")", block, re.S):
                for text, gap in re.findall(rb"\(((?:\\.|[^\\)])*)\)|(-?\d+(?:\.\d+)?)", array or simple, re.S):
                    if gap:
                        line.append(" " if float(gap) <= -200 else "")
                    else:
                        line.append(_unescaped(text))
            pieces.append("".join(line))
    text = re.sub(r"[ \t]+", " ", "\n".join(p for p in pieces if p.strip())).strip()
    if not text:
        return None, "no_text_layer"
    if sum(c.isalnum() or c.isspace() or c in ".,;:!?'\"()-" for c in text) < 0.7 * len(text):
        return None, "no_text_layer"
    return (text, None) if len(text.split()) >= 25 else (None, "thin_content")


def _unescaped(raw: bytes) -> str:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
    out = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else named.get(m[1], m[1]), raw, flags=re.S)
    return out.decode("latin-1")


def charset(header: str | None, head: bytes) -> str:
    """Character set from the header, else from the document's start, else UTF-8."""
    found = re.search(r"charset=[\"']?([\w-]+)", header or "", re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", head[:2048].decode("latin-1"), re.I)
    return found[1].lower() if found else "utf-8"

"""HTML to Markdown, sanitizing, Markdown to HTML, and SVG clean-up, over a small tree that html.parser feeds."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column

from loomtext.functions.udf import scalar

# Void elements, default tags, attributes and schemes of the sanitizer.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
TAGS = set(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption figure footer "
    "h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li map mark nav ol p pre q rp rt rtc ruby s samp small span strike strong sub summary sup table tbody td th thead time tr tt u ul var wbr".split()
)
ATTRIBUTES = {
    "a": "href hreflang", "bdo": "dir", "blockquote": "cite", "col": "align char charoff span", "colgroup": "align char charoff span", "del": "cite datetime",
    "hr": "align size width", "img": "align alt height src width", "ins": "cite datetime", "ol": "start", "q": "cite", "table": "align char charoff summary",
    "tbody": "align char charoff", "td": "align char charoff colspan headers rowspan", "tfoot": "align char charoff",
    "th": "align char charoff colspan headers rowspan scope", "thead": "align char charoff", "tr": "align char charoff",
}
GENERIC = {"lang", "title"}
SCHEMES = set("bitcoin ftp ftps geo http https im irc ircs magnet mailto mms mx news nntp openpgp4fpr sip sms smsto ssh tel url webcal wtai xmpp".split())
URL_ATTRIBUTES = {("a", "href"), ("area", "href"), ("blockquote", "cite"), ("del", "cite"), ("img", "src"), ("ins", "cite"), ("q", "cite")}

_CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def _close_to(self, names: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in stop:
                return
            if self.open[i].name in names:
                del self.open[i:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close_to({"p"}, {"table", "li", "td", "th", "blockquote", "div"} - {tag})
        if tag in _IMPLIED:
            self._close_to(*_IMPLIED[tag])
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(source: str) -> Node:
    b = _Builder()
    b.feed(source)
    b.close()
    return b.root


@dataclass(frozen=True)
class MarkdownOptions:
    heading_style: str = "atx"
    hr: str = "* * *"
    bullet: str = "*"
    code_block_style: str = "indented"
    fence: str = "```"
    em: str = "_"
    strong: str = "**"
    gfm: bool = False
    keep: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()


class _Markdown:
    """Each element gives a string; \\x01 before a block asks for a blank line there, and is settled at the end of its scope."""

    BREAK = "\x01"

    def __init__(self, o: MarkdownOptions):
        self.o = o

    def settle(self, s: str) -> str:
        parts = s.split(self.BREAK)
        out = parts[0]
        for p in parts[1:]:
            if out:
                out = out.rstrip(" \t")
                body = out.rstrip("\n")
                out = body + "\n" * max(2, min(len(out) - len(body), 2))
            out += p
        return out

    def inside(self, n: Node, lists: tuple = ()) -> str:
        return "".join(c if isinstance(c, str) else self.element(c, lists) for c in n.children)

    def own(self, n: Node) -> str:
        return self.settle(self.inside(n))

    def element(self, n: Node, lists: tuple) -> str:
        o, name, b = self.o, n.name, self.BREAK
        if name in o.remove:
            return ""
        if name in o.keep:
            attrs = "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
            return f"<{name}{attrs}>{self.inside(n, lists)}</{name}>"
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            content, level = self.own(n).strip(), int(name[1])
            if o.heading_style == "setext" and level < 3:
                return f"{b}{content}\n{('=' if level == 1 else '-') * max(3, len(content.encode()))}\n\n"
            return f"{b}{'#' * level} {content}\n\n"
        if name == "p":
            return f"{b}{self.inside(n, lists)}\n\n"
        if name == "br":
            return "  \n"
        if name == "hr":
            return f"{b}{o.hr}\n\n"
        if name in ("strong", "b"):
            return f"{o.strong}{self.inside(n, lists)}{o.strong}"
        if name in ("em", "i"):
            return f"{o.em}{self.inside(n, lists)}{o.em}"
        if name in ("del", "s", "strike") and o.gfm:
            return f"~~{self.inside(n, lists)}~~"
        if name == "code":
            return self.code(n.text())
        if name == "pre":
            return self.block(n)
        if name == "blockquote":
            return b + "".join(f"> {line}\n" for line in self.own(n).strip().split("\n")) + "\n"
        if name in ("ul", "ol"):
            return self.list(n, lists)
        if name == "li":
            return self.item(n, f"{o.bullet} ", lists)
        if name == "a":
            text, href, title = self.own(n), n.attrs.get("href", ""), n.attrs.get("title", "")
            return text if not href else f'[{text}]({href} "{title}")' if title else f"[{text}]({href})"
        if name == "img":
            title = n.attrs.get("title", "")
            return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')}" + (f' "{title}")' if title else ")")
        if name == "table" and o.gfm:
            return self.table(n)
        if name in ("thead", "tbody", "tfoot", "tr") and not o.gfm:
            return self.inside(n, lists) + "\n"
        if name in ("th", "td") and not o.gfm:
            return self.own(n).strip() + " "
        if name == "input" and o.gfm:
            return ("[x] " if "checked" in n.attrs else "[ ] ") if n.attrs.get("type") == "checkbox" else ""
        if name in ("script", "style", "noscript", "iframe"):
            return ""
        return self.inside(n, lists)

    @staticmethod
    def code(text: str) -> str:
        if "`" not in text:
            return f"`{text}`"
        return "``" + ("" if text.startswith(" ") else " ") + text + ("" if text.endswith(" ") else " ") + "``"

    def block(self, n: Node) -> str:
        code = next((c for c in n.children if isinstance(c, Node) and c.name == "code"), n)
        text = code.text()
        language = re.search(r"(?:^|\s)language-(\S+)", code.attrs.get("class", ""))
        if self.o.code_block_style == "fenced":
            return f"{self.BREAK}{self.o.fence}{language[1] if language else ''}\n{text}" + ("" if text.endswith("\n") else "\n") + f"{self.o.fence}\n\n"
        lines = text.split("\n")
        if lines and not lines[-1]:
            lines.pop()
        return self.BREAK + "".join(f"    {line}\n" for line in lines) + "\n"

    def list(self, n: Node, lists: tuple) -> str:
        out, count = [self.BREAK], 0
        for c in n.children:
            if isinstance(c, Node) and c.name == "li":
                count += 1
                out.append(self.item(c, f"{count}. " if n.name == "ol" else f"{self.o.bullet} ", (*lists, n.name)))
            else:
                out.append(c if isinstance(c, str) else self.element(c, (*lists, n.name)))
        return "".join(out) + "\n"

    def item(self, n: Node, marker: str, lists: tuple) -> str:
        indent = "  " * max(0, len(lists) - 1)
        first, *rest = (self.own(n).rstrip() or "").split("\n")
        if not first and not rest:
            return "\n"
        return indent + marker + first + "".join(f"\n{indent}  {line}" for line in rest) + "\n"

    def table(self, n: Node) -> str:
        rows: list[list[str]] = []

        def collect(x: Node) -> None:
            for c in x.children:
                if isinstance(c, Node) and c.name == "tr":
                    rows.append([self.own(d).strip().replace("|", "\\|").replace("\n", " ") for d in c.children if isinstance(d, Node) and d.name in ("td", "th")])
                elif isinstance(c, Node):
                    collect(c)

        collect(n)
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |\n"
        return self.BREAK + line(rows[0]) + line(["---"] * width) + "".join(map(line, rows[1:])) + "\n"


def markdown(source: str, o: MarkdownOptions = MarkdownOptions()) -> str:
    m = _Markdown(o)
    out = m.settle(m.inside(tree(source)))
    lines = [line if line.strip() or not line else "" for line in out.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n ")


def turndown(source: Column, **options) -> Column:
    """HTML as Markdown."""
    o = MarkdownOptions(**options)
    return scalar(lambda s: markdown(s, o), "string")(source)


@dataclass(frozen=True)
class SanitizeOptions:
    tags: frozenset[str] = frozenset(TAGS)
    attributes: tuple[tuple[str, str], ...] = tuple(ATTRIBUTES.items())
    generic: frozenset[str] = frozenset(GENERIC)
    schemes: frozenset[str] = frozenset(SCHEMES)
    drop_content: frozenset[str] = frozenset({"script", "style"})
    strip_comments: bool = True
    link_rel: str | None = "noopener noreferrer"
    max_input_bytes: int = 5 << 20
    max_depth: int = 256


class _Sanitizer(HTMLParser):
    def __init__(self, o: SanitizeOptions):
        super().__init__(convert_charrefs=False)
        self.o, self.attributes = o, {k: set(v.split()) for k, v in o.attributes}
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []  # name, and whether its tag was written
        self.dropping = 0

    def _url_ok(self, value: str) -> bool:
        v = re.sub(r"[\x00-\x20]+", "", html.unescape(value))
        m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", v)
        return m[1].lower() in self.o.schemes if m else ":" not in re.split(r"[/?#]", v)[0]

    def _attrs(self, tag: str, attrs) -> str:
        seen, out = set(), []
        for k, v in attrs:
            v = v or ""
            if k in seen or k.startswith("on") or k not in self.o.generic and k not in self.attributes.get(tag, ()):
                continue
            if (tag, k) in URL_ATTRIBUTES and not self._url_ok(v):
                continue
            seen.add(k)
            out.append(f' {k}="{html.escape(v, quote=True).replace("&#x27;", chr(39))}"')
        if tag == "a" and "href" in seen and self.o.link_rel and "rel" not in seen:
            out.append(f' rel="{self.o.link_rel}"')
        return "".join(out)

    def handle_starttag(self, tag, attrs):
        if tag in self.o.drop_content and tag not in self.o.tags:
            self.dropping += 1
            self.open.append((tag, False))
            return
        write = tag in self.o.tags and not self.dropping and len(self.open) < self.o.max_depth
        if write:
            self.out.append(f"<{tag}{self._attrs(tag, attrs)}>")
        if tag not in VOID:
            self.open.append((tag, write))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.open):
            return
        while self.open:
            name, written = self.open.pop()
            if name in self.o.drop_content and not written:
                self.dropping = max(0, self.dropping - 1)
            if written:
                self.out.append(f"</{name}>")
            if name == tag:
                return

    def handle_data(self, data):
        if not self.dropping:
            self.out.append(html.escape(data, quote=False))

    def handle_entityref(self, name):
        if not self.dropping:
            self.out.append(html.escape(html.unescape(f"&{name};"), quote=False))

    def handle_charref(self, name):
        if not self.dropping:
            self.out.append(html.escape(html.unescape(f"&#{name};"), quote=False))

    def handle_comment(self, data):
        if not self.dropping and not self.o.strip_comments:
            self.out.append(f"<!--{data}-->")

    def finish(self) -> str:
        self.close()
        self.out += [f"</{n}>" for n, written in reversed(self.open) if written]
        return "".join(self.out)


def clean(source: str, o: SanitizeOptions = SanitizeOptions()) -> str:
    if o.max_input_bytes and len(source.encode()) > o.max_input_bytes:
        return ""
    s = _Sanitizer(o)
    s.feed(source)
    return s.finish()


def sanitize(source: Column, **options) -> Column:
    """HTML with allowed tags, attributes and schemes alone; scripts and styles go with what is in them."""
    o = SanitizeOptions(**options)
    return scalar(lambda s: clean(s, o), "string")(source)


def is_clean(source: Column, **options) -> Column:
    return sanitize(source, **options) == source


_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<code>(?P<tick>`+)(?P<in>.+?)(?<!`)(?P=tick)(?!`))|(?P<img>!\[(?P<alt>[^\]]*)\]\((?P<src>[^\s)]*)(?:\s+\"(?P<ititle>[^\"]*)\")?\))"
    r"|(?P<link>\[(?P<text>(?:[^\[\]]|\\.)*)\]\((?P<href>[^\s)]*)(?:\s+\"(?P<title>[^\"]*)\")?\))|(?P<auto><(?P<url>[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*)>)"
    r"|(?P<strong>(?P<sd>\*\*|__)(?=\S)(?P<sin>.+?)(?<=\S)(?P=sd))|(?P<em>(?P<ed>[*_])(?=\S)(?P<ein>.+?)(?<=\S)(?P=ed))|(?P<del>~~(?P<din>.+?)~~)|(?P<tag></?[A-Za-z][^<>]*>)|(?P<br> {2,}\n|\\\n)",
    re.S,
)


class _Render:
    """Blocks by line, inlines by one pattern: the common part of CommonMark with GFM tables, strikethrough and task items."""

    def __init__(self, raw_html: bool = False, heading_ids: bool = True):
        self.raw, self.ids, self.seen = raw_html, heading_ids, {}

    def inline(self, s: str) -> str:
        out, at = [], 0
        for m in _INLINE.finditer(s):
            out.append(html.escape(html.unescape(s[at : m.start()]), quote=True).replace("&#x27;", "'"))
            at = m.end()
            g = m.groupdict()
            if g["esc"]:
                out.append(html.escape(g["esc"][1]))
            elif g["code"]:
                code = g["in"].replace("\n", " ")
                code = code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code
                out.append(f"<code>{html.escape(code)}</code>")
            elif g["img"]:
                title = f' title="{html.escape(g["ititle"])}"' if g["ititle"] else ""
                out.append(f'<img src="{html.escape(g["src"])}" alt="{html.escape(g["alt"])}"{title} />')
            elif g["link"]:
                title = f' title="{html.escape(g["title"])}"' if g["title"] else ""
                out.append(f'<a href="{html.escape(g["href"])}"{title}>{self.inline(g["text"])}</a>')
            elif g["auto"]:
                out.append(f'<a href="{html.escape(g["url"])}">{html.escape(g["url"])}</a>')
            elif g["strong"]:
                out.append(f"<strong>{self.inline(g['sin'])}</strong>")
            elif g["em"]:
                out.append(f"<em>{self.inline(g['ein'])}</em>")
            elif g["del"]:
                out.append(f"<del>{self.inline(g['din'])}</del>")
            elif g["br"]:
                out.append("<br />\n")
            elif self.raw:
                out.append(g["tag"])
            else:
                out.append("<!-- raw HTML omitted -->")
        out.append(html.escape(html.unescape(s[at:]), quote=True).replace("&#x27;", "'"))
        return "".join(out)

    def heading(self, level: int, text: str) -> str:
        body = self.inline(text)
        if not self.ids:
            return f"<h{level}>{body}</h{level}>\n"
        slug = re.sub(r"[^a-z0-9]+", "-", re.sub(r"<[^>]*>", "", html.unescape(body)).lower()).strip("-")
        n = self.seen.get(slug, 0)
        self.seen[slug] = n + 1
        return f'<h{level} id="{slug + (f"-{n}" if n else "") if slug else "heading"}">{body}</h{level}>\n'

    def blocks(self, lines: list[str], tight: bool = False) -> str:
        out, i = [], 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif m := re.match(r" {0,3}(`{3,}|~{3,})\s*([^\s`]*)", line):
                j = i + 1
                while j < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[j]):
                    j += 1
                cls = f' class="language-{html.escape(m[2])}"' if m[2] else ""
                out.append(f"<pre><code{cls}>{html.escape(''.join(x + chr(10) for x in lines[i + 1 : j]))}</code></pre>\n")
                i = j + 1
            elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
                out.append(self.heading(len(m[1]), m[2] or ""))
                i += 1
            elif re.match(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$", line):
                out.append("<hr />\n")
                i += 1
            elif re.match(r" {4}|\t", line):
                j = i
                while j < len(lines) and (re.match(r" {4}|\t", lines[j]) or not lines[j].strip()):
                    j += 1
                code = [re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:j]]
                out.append(f"<pre><code>{html.escape(chr(10).join(code).strip(chr(10)))}\n</code></pre>\n")
                i = j
            elif re.match(r" {0,3}>", line):
                j = i
                while j < len(lines) and lines[j].strip():
                    j += 1
                out.append(f"<blockquote>\n{self.blocks([re.sub(r'^ {0,3}> ?', '', x) for x in lines[i:j]])}</blockquote>\n")
                i = j
            elif m := re.match(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)", line):
                text, i = self.list(lines, i, m)
                out.append(text)
            elif i + 1 < len(lines) and "|" in line and re.match(r" {0,3}\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
                text, i = self.table(lines, i)
                out.append(text)
            else:
                j, level = i, 0
                while j < len(lines) and lines[j].strip():
                    if j > i and (m := re.match(r" {0,3}(=+|-+)\s*$", lines[j])):
                        level = 1 if m[1][0] == "=" else 2
                        break
                    if j > i and re.match(r" {0,3}(#{1,6}\s|>|[-*+]\s|1[.)]\s|`{3,}|~{3,}|([-*_])[ \t]*(?:\2[ \t]*){2,}$)", lines[j]):
                        break
                    j += 1
                body = "\n".join(x.lstrip() for x in lines[i:j])
                body = body.rstrip() if not level else body.strip()
                out.append(self.heading(level, body) if level else f"{self.inline(body)}\n" if tight else f"<p>{self.inline(body)}</p>\n")
                i = j + bool(level)
        return "".join(out)

    def list(self, lines: list[str], i: int, m: re.Match) -> tuple[str, int]:
        ordered, mark = m[2][0].isdigit(), m[2][-1]
        items, loose, j = [], False, i
        while j < len(lines):
            m2 = re.match(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)", lines[j])
            if not m2 or m2[2][-1] != mark:
                break
            width = len(m2[1]) + len(m2[2]) + (len(m2[3]) if 0 < len(m2[3]) < 5 else 1)
            own = [lines[j][width:]]
            j += 1
            while j < len(lines):
                if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip(" ")) >= width:
                    own.append(lines[j][width:])
                elif not lines[j].strip() and j + 1 < len(lines) and (len(lines[j + 1]) - len(lines[j + 1].lstrip(" ")) >= width or re.match(r" {0,3}([-*+]|\d{1,9}[.)])[ \t]", lines[j + 1])):
                    loose = True
                    own.append("")
                elif lines[j].strip() and own[-1].strip() and not re.match(r" {0,3}([-*+]|\d{1,9}[.)])([ \t]|$)|#{1,6} |>", lines[j]):
                    own.append(lines[j].lstrip())
                else:
                    break
                j += 1
            items.append(own)
        out = []
        for own in items:
            box = re.match(r"\[([ xX])\] +", own[0])
            if box:
                own = [own[0][box.end() :], *own[1:]]
            body = self.blocks(own, tight=not loose)
            check = f'<input type="checkbox"{" checked" + chr(61) + chr(34) * 2 if box and box[1] != " " else ""} disabled="" /> ' if box else ""
            out.append(f"<li>{check}{chr(10) + body if loose else body.rstrip(chr(10)) if body.count('<') == 0 or not re.search(r'</(?:ul|ol|p|pre|blockquote)>', body) else body}</li>\n")
        start = int(m[2][:-1]) if ordered else 1
        tag = "ol" if ordered else "ul"
        return f"<{tag}{f' start={chr(34)}{start}{chr(34)}' if start != 1 else ''}>\n{''.join(out)}</{tag}>\n", j

    def table(self, lines: list[str], i: int) -> tuple[str, int]:
        cells = lambda s: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", s.strip().removeprefix("|").removesuffix("|"))]
        head, align = cells(lines[i]), cells(lines[i + 1])
        how = [{(True, True): ' align="center"', (True, False): ' align="left"', (False, True): ' align="right"'}.get((a.startswith(":"), a.endswith(":")), "") for a in align]
        row = lambda tag, cs: "<tr>\n" + "".join(f"<{tag}{how[k] if k < len(how) else ''}>{self.inline(c)}</{tag}>\n" for k, c in enumerate((cs + [""] * len(head))[: len(head)])) + "</tr>\n"
        j = i + 2
        body = []
        while j < len(lines) and lines[j].strip() and "|" in lines[j]:
            body.append(row("td", cells(lines[j])))
            j += 1
        return f"<table>\n<thead>\n{row('th', head)}</thead>\n" + (f"<tbody>\n{''.join(body)}</tbody>\n" if body else "") + "</table>\n", j


def to_html(source: str, raw_html: bool = False, heading_ids: bool = True) -> str:
    return _Render(raw_html, heading_ids).blocks(source.replace("\r\n", "\n").split("\n"))


def render_markdown(source: Column, raw_html: bool = False, heading_ids: bool = True) -> Column:
    """Markdown as HTML; raw HTML is left out unless allowed."""
    return scalar(lambda s: to_html(s, raw_html, heading_ids), "string")(source)


_SVG_DROP = {"metadata", "title", "desc"}
_SVG_CONTAINERS = {"g", "defs", "symbol", "marker", "mask", "pattern", "clipPath", "a", "switch"}
_EDITOR = ("inkscape", "sodipodi", "sketch", "adobe", "figma")
_NUMBER = re.compile(r"(?<![#\w.])-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _number(text: str, precision: int) -> str:
    out = f"{round(float(text), precision):.{precision}f}".rstrip("0").rstrip(".") if precision else str(round(float(text)))
    out = re.sub(r"^(-?)0\.", r"\1.", out)
    return "0" if out in ("-0", "", "-") else out


def optimize_svg(source: str, precision: int = 3, passes: int = 5) -> str:
    """Comments, metadata, editor attributes, hidden and empty elements go; numbers are rounded and colours shortened."""
    import xml.etree.ElementTree as ET

    for prefix, uri in (("", "http://www.w3.org/2000/svg"), ("xlink", "http://www.w3.org/1999/xlink")):
        ET.register_namespace(prefix, uri)
    local = lambda x: x.rsplit("}", 1)[-1]

    def value(v: str) -> str:
        v = re.sub(r"\s+", " ", v).strip()
        m = re.fullmatch(r"#([0-9a-fA-F])\1([0-9a-fA-F])\2([0-9a-fA-F])\3", v)
        if m:
            return f"#{m[1]}{m[2]}{m[3]}".lower()
        if m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", v):
            return value("#" + "".join(f"{min(255, int(x)):02x}" for x in m.groups()))
        return v if v.startswith(("#", "url(")) else _NUMBER.sub(lambda x: _number(x[0], precision), v)

    def visit(e: ET.Element) -> None:
        for k in list(e.attrib):
            if any(x in k.lower() for x in _EDITOR):
                del e.attrib[k]
            elif not (new := e.attrib[k] if local(k) in ("id", "class", "href") else value(e.attrib[k])):
                del e.attrib[k]
            else:
                e.attrib[k] = new
        for c in list(e):
            style = c.attrib.get("style", "").replace(" ", "")
            if not isinstance(c.tag, str) or local(c.tag) in _SVG_DROP or any(x in c.tag for x in _EDITOR) or c.attrib.get("display") == "none" or c.attrib.get("visibility") == "hidden" or "display:none" in style:
                e.remove(c)
                continue
            visit(c)
            if local(c.tag) in _SVG_CONTAINERS and not len(c) and not (c.text or "").strip() and not {"id", "class", "style"} & set(c.attrib):
                e.remove(c)
            elif local(c.tag) == "g" and not c.attrib and len(c) == 1:
                e[list(e).index(c)] = c[0]
        if local(e.tag) not in ("text", "tspan", "style", "script"):
            e.text = e.text if (e.text or "").strip() else None
            for c in e:
                c.tail = c.tail if (c.tail or "").strip() else None

    out = source
    for _ in range(passes):
        root = ET.fromstring(out)
        visit(root)
        new = ET.tostring(root, encoding="unicode", short_empty_elements=True).replace(" />", "/>")
        if len(new) >= len(out):
            return out if out != source else new
        out = new
    return out


def optimize(source: Column, precision: int = 3) -> Column:
    return scalar(lambda s: optimize_svg(s, precision), "string")(source)

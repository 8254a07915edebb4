"""Trees of texts with HTML, Markdown, wiki or LaTeX markup, and the matching of trees.

``parse`` reads a text into a tree: a node is a label with children, a leaf a
string. Signs in their plain sense and the conventions of captions (italic
tags, positions, dialogue hyphens, notes around a sung line, annotations in
brackets) stay text. ``match`` is simple tree matching: the largest number of
nodes that two trees share in order below equal parents; ``align`` merges two
trees along such a matching.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.entities import html5

MAX_DEPTH = 60


@dataclass
class Node:
    label: str
    children: list[Node | str] = field(default_factory=list)


#: Tags without content.
_VOID = {"br", "hr", "img", "wbr", "input", "link", "meta", "col", "source", "track"}
#: Elements whose content is not part of the text.
HIDDEN = {"script", "style", "ref", "comment", "call", "image", "cite", "label", "attr"}

_BLOCK = r"""
  (?P<fence>^[ \t]*(?P<tick>```+|~~~+)[^\n`]*\n(?P<fenced>.*?)(?:\n[ \t]*(?P=tick)|\Z))
 |(?P<comment><!--.*?(?:-->|\Z))
 |(?P<wikitable>\{\|(?P<wikirows>.*?)\|\})
 |(?P<mdtable>^[ \t]*\|[^\n]*\n[ \t]*\|[ :|\-]*-[ :|\-]*\|?[ \t]*(?:\n[ \t]*\|[^\n]*\|)*)
 |(?P<heading>^[ \t]*(?P<marks>\#{1,6})[ \t]+(?P<title>[^\s#][^\n]*?)[ \t]*$)
 |(?P<wikiheading>^[ \t]*(?P<eq>={2,6})[ \t]*(?P<wikititle>[^=\n](?:[^\n]*?[^=\n])?)[ \t]*(?P=eq)[ \t]*$)
 |(?P<bullets>^[ \t]*[*+][ \t]+\S[^\n]*(?:\n+[ \t]*[*+][ \t]+\S[^\n]*)+)
 |(?P<numbers>^[ \t]*1[.)][ \t]+\S[^\n]*(?:\n+[ \t]*\d+[.)][ \t]+\S[^\n]*)+)
 |(?P<env>\\begin\{(?P<envname>[A-Za-z]+\*?)\}(?P<envbody>.*?)\\end\{(?P=envname)\})
"""
_INLINE = r"""
  (?P<display>\\\[(?P<displayed>.+?)\\\]|\$\$(?P<dollars>[^$]+)\$\$)
 |(?P<math>\\\((?P<inparens>.+?)\\\)|\$(?P<indollars>(?=[^\s$])(?=[^$\n]*[\^_\\=+<>])(?:(?!(?<!\\)(?<![A-Za-z])[^\W\d_]{4})[^$\n])+?(?<!\s))\$(?!\d))
 |(?P<command>(?<![\w:\\])\\(?P<name>[A-Za-z]{2,})\*?(?:\[[^\[\]\n]*\])?(?=\{))
 |(?P<bare>\\(?:item|par|newline|noindent|ldots|dots|LaTeX|TeX|maketitle|centering|hline|quad|qquad)\b|\\(?:begin|end)\{[A-Za-z]+\*?\})
 |(?P<image>!\[(?P<alt>[^\[\]\n]*)\]\([^()\s]+(?:\s+"[^"\n]*")?\))
 |(?P<wikilink>\[\[(?:[^\[\]|\n]*\|)?(?P<linked>[^\[\]\n]+)\]\])
 |(?P<extlink>\[(?:https?|ftp|mailto):\S+?(?:\s+(?P<extname>[^\[\]\n]*))?\])
 |(?P<link>\[(?P<linkname>[^\[\]\n]*)\]\((?=[^()\s]*[/.\#:])[^()\s]+(?:\s+"[^"\n]*")?\))
 |(?P<call>\{\{[^{}]*\}\})
 |(?P<code>(?P<ticks>`+)(?P<coded>[^`\n]+)(?P=ticks))
 |(?P<strong3>\*\*\*(?=\S)(?P<s3>[^*\n]+?)(?<=\S)\*\*\*)
 |(?P<strong2>\*\*(?=\S)(?P<s2>[^*\n]+?)(?<=\S)\*\*)
 |(?P<under2>(?<![A-Za-z0-9_])__(?=[^\s_])(?P<u2>[^\n]+?)(?<=[^\s_])__(?![A-Za-z0-9_]))
 |(?P<strike>~~(?=\S)(?P<st>[^~\n]+?)(?<=\S)~~)
 |(?P<em1>(?<![\w*])\*(?=[^\s*])(?P<e1>[^*\n]+?)(?<=[^\s*])\*(?![\w*]))
 |(?P<wikibold>'''(?=\S)(?P<wb>.+?)(?<=\S)''')
 |(?P<wikiem>''(?=[^\s'])(?P<we>[^\n]+?)(?<=[^\s'])'')
 |(?P<close></(?P<closed>[A-Za-z][A-Za-z0-9]*)\s*>)
 |(?P<open><(?P<opened>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s+[^<>]*)?|/)>)
 |(?P<entity>&(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)
"""
_ANY = re.compile(_BLOCK + "|" + _INLINE, re.VERBOSE | re.MULTILINE | re.DOTALL)
_CELL = re.compile(r"\|\|?|!!")
_MARK = re.compile(r"^[ \t]*(?:[*+]|\d+[.)])[ \t]+", re.MULTILINE)
#: A text without any of these characters holds no markup.
SIGNS = r"[<&*_`~|=\\$\[{#]|''|\n[ \t]*\d+[.)] "

_LATEX_KEPT = {"textbf": "b", "textit": "em", "emph": "em", "underline": "u", "texttt": "code", "textsc": "span", "text": "span", "mbox": "span"}
_LATEX_HEADS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
_LATEX_HIDDEN = {"cite": "cite", "citep": "cite", "citet": "cite", "ref": "cite", "label": "label", "footnote": "cite", "includegraphics": "image"}
_TAG_NAMES = {"strong": "b", "i": "em", "strike": "s", "del": "s", "tt": "code"}


def _braced(text: str, at: int) -> int:
    """The end of the group that opens at text[at], behind its brace; -1 if it never closes."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return -1


def _entity(m: re.Match[str]) -> str | None:
    name = m.group()[1:]
    if name[0] != "#" and name not in html5:
        return None
    return html.unescape(m.group())


def _items(block: str, label: str, depth: int) -> Node:
    marks = list(_MARK.finditer(block))
    ends = [m.start() for m in marks[1:]] + [len(block)]
    return Node(label, [Node("li", parse(block[m.end() : e].strip(), depth + 1).children) for m, e in zip(marks, ends, strict=True)])


def _rows(lines: list[str], split: re.Pattern[str], depth: int) -> list[Node | str]:
    rows: list[Node | str] = []
    for line in lines:
        cells = [c.strip() for c in split.split(line.strip().strip("|!"))]
        if any(cells):
            rows.append(Node("tr", [Node("td", parse(c, depth + 1).children) for c in cells]))
    return rows


def parse(text: str, depth: int = 0) -> Node:
    """The tree of a text; deeper than MAX_DEPTH everything is text."""
    root = Node("doc")
    if not text:
        return root
    if depth >= MAX_DEPTH:
        root.children.append(text)
        return root
    stack = [root]
    at = 0

    def say(s: str) -> None:
        if s:
            kids = stack[-1].children
            if kids and isinstance(kids[-1], str):
                kids[-1] += s
            else:
                kids.append(s)

    def add(label: str, inner: str | None = None, raw: bool = False) -> None:
        node = Node(label)
        if inner:
            node.children = [inner] if raw else parse(inner, depth + 1).children
        stack[-1].children.append(node)

    for m in _ANY.finditer(text):
        if m.start() < at:
            continue
        end = m.end()
        kind = next(k for k in _KINDS if m.group(k) is not None)
        node: tuple | None = None
        if kind == "fence":
            node = ("pre", m["fenced"], True)
        elif kind == "comment":
            node = ("comment", m["comment"][4:].removesuffix("-->"), True)
        elif kind == "wikitable":
            lines = [x for x in m["wikirows"].split("\n")[1:] if x.strip() and not x.lstrip().startswith(("|-", "|+"))]
            say(text[at : m.start()])
            stack[-1].children.append(Node("table", _rows(lines, _CELL, depth)))
            at = end
            continue
        elif kind == "mdtable":
            lines = m["mdtable"].split("\n")
            say(text[at : m.start()])
            stack[-1].children.append(Node("table", _rows(lines[:1] + lines[2:], re.compile(r"(?<!\\)\|"), depth)))
            at = end
            continue
        elif kind == "heading":
            # One hash before and behind a line marks a sung line.
            if len(m["marks"]) > 1 or not m["title"].rstrip().removesuffix("</i>").rstrip().endswith("#"):
                node = (f"h{len(m['marks'])}", m["title"].rstrip("# "), False)
        elif kind == "wikiheading":
            node = (f"h{len(m['eq'])}", m["wikititle"], False)
        elif kind in ("bullets", "numbers"):
            block = m[kind]
            lines = [x.strip() for x in block.split("\n") if x.strip()]
            sung = kind == "bullets" and all(re.sub(r"(?:</i>\s*)+\Z", "", x).endswith(("*", "+")) for x in lines)
            counted = kind == "bullets" or [int(re.match(r"\d+", x).group()) for x in lines] == list(range(1, len(lines) + 1))
            if not sung and counted:
                say(text[at : m.start()])
                stack[-1].children.append(_items(block, "ul" if kind == "bullets" else "ol", depth))
                at = end
                continue
        elif kind == "env":
            name = m["envname"].rstrip("*")
            if name in ("itemize", "enumerate", "description"):
                parts = [p.strip() for p in re.split(r"\\item(?:\[[^\]]*\])?", m["envbody"])[1:]]
                say(text[at : m.start()])
                stack[-1].children.append(Node("ol" if name == "enumerate" else "ul", [Node("li", parse(p, depth + 1).children) for p in parts]))
                at = end
                continue
            if name in ("verbatim", "lstlisting", "minted"):
                node = ("pre", m["envbody"].strip("\n"), True)
            elif name in ("equation", "align", "gather", "displaymath", "math", "eqnarray", "multline"):
                node = ("formula", m["envbody"].strip(), True)
            else:
                node = ("div", m["envbody"], False)
        elif kind == "display":
            node = ("formula", (m["displayed"] or m["dollars"]).strip(), True)
        elif kind == "math":
            node = ("math", (m["inparens"] or m["indollars"]).strip(), True)
        elif kind == "command":
            name, stop = m["name"], _braced(text, end)
            if stop > 0:
                inner = text[end + 1 : stop - 1]
                # A tie binds a citation to the word before it.
                say(text[at : m.start()].rstrip("~") if name in _LATEX_HIDDEN else text[at : m.start()])
                if name in _LATEX_HEADS:
                    add(f"h{_LATEX_HEADS[name]}", inner)
                elif name in _LATEX_HIDDEN:
                    add(_LATEX_HIDDEN[name], inner, True)
                elif name == "href" and stop < len(text) and text[stop] == "{" and (last := _braced(text, stop)) > 0:
                    add("a", text[stop + 1 : last - 1])
                    stop = last
                elif name in ("frac", "sqrt", "sum", "int"):
                    add("math", text[m.start() : stop], True)
                else:
                    add(_LATEX_KEPT.get(name, "cmd"), inner)
                at = stop
                continue
        elif kind == "bare":
            node = ("bare", None, True)
        elif kind == "image":
            node = ("image", m["alt"], True)
        elif kind == "wikilink":
            hidden = re.match(r"(?i)\[\[(?:file|image|category):", m["wikilink"])
            node = ("image", m["linked"], True) if hidden else ("a", m["linked"], False)
        elif kind == "extlink":
            node = ("a", m["extname"] or "", False)
        elif kind == "link":
            node = ("a", m["linkname"], False)
        elif kind == "call":
            node = ("call", m["call"][2:-2], True)
        elif kind == "code":
            node = ("code", m["coded"], True)
        elif kind in _PAIRED:
            label, group = _PAIRED[kind]
            node = (label, m[group], False)
        elif kind == "entity":
            if (char := _entity(m)) is not None:
                again = char + text[end : end + 8] if char == "&" else ""
                say(text[at : m.start()])
                stack[-1].children.append(Node("entity", [char]))
                if again and (twice := re.match(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z]\w*);", again)) and html.unescape(twice.group()) != twice.group():
                    # A reference that was escaped twice.
                    stack[-1].children[-1].children = [html.unescape(twice.group())]
                    end += len(twice.group()) - 1
                at = end
                continue
        elif kind == "open" and m.group() != "<i>":
            name = m["opened"].lower()
            say(text[at : m.start()])
            node_ = Node(_TAG_NAMES.get(name, name))
            stack[-1].children.append(node_)
            if name not in _VOID and not m["attrs"].endswith("/") and len(stack) < MAX_DEPTH:
                stack.append(node_)
            at = end
            continue
        elif kind == "close" and m.group() != "</i>":
            name = m["closed"].lower()
            name = _TAG_NAMES.get(name, name)
            say(text[at : m.start()])
            at = end
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].label == name:
                    del stack[i:]
                    break
            else:
                add("stray")
            continue
        if node is None:
            continue
        say(text[at : m.start()])
        add(*node)
        at = end
    say(text[at:])
    while len(stack) > 1:
        # An element that is never closed holds nothing: what follows stands beside it.
        lost, parent = stack.pop(), stack[-1]
        parent.children += lost.children
        lost.children = []
    return root


_PAIRED = {
    "strong3": ("b", "s3"),
    "strong2": ("b", "s2"),
    "under2": ("b", "u2"),
    "strike": ("s", "st"),
    "em1": ("em", "e1"),
    "wikibold": ("b", "wb"),
    "wikiem": ("em", "we"),
}
_KINDS = re.findall(r"^ [ |]\(\?P<(\w+)>", _BLOCK + _INLINE, re.MULTILINE)


def fragments(root: Node) -> list[Node]:
    """The elements directly below the root: the regions that are aligned."""
    return [c for c in root.children if isinstance(c, Node)]


def skeleton(node: Node | str) -> str:
    """A tree without its texts; equal neighbours are one, marked by ``+``."""
    if isinstance(node, str):
        return "#"
    out: list[str] = []
    for c in node.children:
        s = skeleton(c)
        if out and out[-1].rstrip("+") == s:
            out[-1] = s + "+"
        else:
            out.append(s)
    return f"{node.label}({' '.join(out)})" if out else node.label


def slots(node: Node | str) -> list[str]:
    """The texts of a tree in the order of its skeleton's ``#``; those of equal neighbours together."""
    if isinstance(node, str):
        return [node.strip()]
    out: list[str] = []
    last, width = "", 0
    for c in node.children:
        s, own = skeleton(c), slots(c)
        if s == last:
            for i, t in enumerate(own):
                out[len(out) - width + i] += "\x1f" + t
        else:
            out += own
            last, width = s, len(own)
    return out


def unskeleton(s: str) -> Tree:
    """The tree of a skeleton."""
    root = Tree("")
    stack, word = [root], ""

    def done() -> None:
        nonlocal word
        if word:
            stack[-1].children.append(Tree(word))
            word = ""

    for c in s:
        if c == "(":
            t = Tree(word)
            word = ""
            stack[-1].children.append(t)
            stack.append(t)
        elif c == ")":
            done()
            stack.pop()
        elif c == " ":
            done()
        elif c == "+" and not word:
            stack[-1].children[-1].many = True
        elif c == "+":
            done()
            stack[-1].children[-1].many = True
        else:
            word += c
    done()
    return root.children[0]


@dataclass
class Tree:
    """A node of a template: maybe ``many`` times next to itself, or not on all pages (``optional``)."""

    label: str
    children: list[Tree] = field(default_factory=list)
    many: bool = False
    optional: bool = False

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def __str__(self) -> str:
        inner = " ".join(map(str, self.children))
        return self.label + (f"({inner})" if inner else "") + ("+" if self.many else "") + ("?" if self.optional else "")


def _table(a: Tree, b: Tree) -> list[list[int]]:
    """Best matching of the first i children of a with the first j of b."""
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y))
    return m


def match(a: Tree, b: Tree) -> int:
    """Simple tree matching: the nodes shared in order, parents included."""
    return _table(a, b)[-1][-1] + 1 if a.label == b.label else 0


def likeness(a: Tree, b: Tree) -> float:
    return 2 * match(a, b) / (a.size() + b.size())


def align(a: Tree, b: Tree) -> Tree:
    """Template a widened by b (roots alike): unmatched nodes of either become optional."""
    m = _table(a, b)
    out: list[Tree] = []
    i, j = len(a.children), len(b.children)
    while i or j:
        if i and j and m[i][j] > max(m[i - 1][j], m[i][j - 1]):
            i, j = i - 1, j - 1
            out.append(align(a.children[i], b.children[j]))
        elif i and m[i][j] == m[i - 1][j]:
            i -= 1
            out.append(Tree(a.children[i].label, a.children[i].children, a.children[i].many, True))
        else:
            j -= 1
            out.append(Tree(b.children[j].label, b.children[j].children, b.children[j].many, True))
    return Tree(a.label, out[::-1], a.many or b.many, a.optional or b.optional)


_HEAD = re.compile(r"h([1-6])\Z")
_BREAKS = {"p", "div", "br", "li", "tr", "ul", "ol", "table", "blockquote", "pre", "formula", "hr", "center"}


def render(node: Node, dropped: frozenset[int] = frozenset()) -> str:
    """Clean text of a tree: headings as ``# x``, list items as ``- x`` or ``1. x``, code
    within ticks, formulas within dollar signs, table cells apart by `` | ``.

    dropped are indices of top elements whose texts belong to the template.
    """
    parts: list[str] = []
    index = 0
    for c in node.children:
        if isinstance(c, Node):
            if index not in dropped:
                parts.append(_say(c))
            index += 1
        else:
            parts.append(c)
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(parts).split("\n")]
    return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip("\n")


def _say(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    label = node.label
    if label in HIDDEN:
        return ""
    inner = "".join(_say(c) for c in node.children)
    if m := _HEAD.match(label):
        return f"\n{'#' * int(m[1])} {inner.strip()}\n"
    if label == "br":
        return "\n"
    if label in ("ul", "ol"):
        items = [x for x in node.children if isinstance(x, Node)]
        marks = [f"{i}." if label == "ol" else "-" for i in range(1, len(items) + 1)]
        return "\n" + "\n".join(f"{k} {''.join(_say(c) for c in x.children).strip()}" for k, x in zip(marks, items, strict=True)) + "\n"
    if label == "tr":
        return "\n" + " | ".join("".join(_say(c) for c in x.children).strip() for x in node.children if isinstance(x, Node)) + "\n"
    if label == "pre":
        return f"\n```\n{inner.strip(chr(10)).strip('`')}\n```\n"
    if label == "code":
        return inner if "`" in inner else f"`{inner}`"
    if label == "math":
        return f"${inner}$"
    if label == "formula":
        return f"\n$${inner}$$\n"
    return f"\n{inner.strip()}\n" if label in _BREAKS else inner

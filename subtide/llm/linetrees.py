"""Line templates mined by a fixed-depth token tree.

A line is a row of few tokens: a time, a number, a run of words, a mark. Rows
of equal length that begin with the same DEPTH tokens meet in one leaf of the
tree; there a row joins the template it shares most tokens with, if these are
at least ALIKE of all, and the places where they differ become ``*``. What a
word slot holds is inferred from the values seen in it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Tokens of a line that count, tokens that lead through the tree, and the share that makes rows alike.
TOKENS, DEPTH, ALIKE = 8, 5, 0.6

TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
WORDS = r"[^\W\d_](?:[^\W\d_]|[.,'’\-]|[^\S\n](?!\s))*"
_TOKEN = re.compile(
    rf"(?P<skip>[^\S\n]+|</?[A-Za-z][^<>]*>|\{{\\an\d\}})|(?P<time>{TIME}(?![\d:]))|(?P<number>\d+)|(?P<words>{WORDS})|(?P<cc>>>+)|(?P<colon>[:：])|(?P<dash>[—–])|(?P<mark>[\[\]()\-♪#*])|(?P<line>\n)|(?P<other>.)",
    re.DOTALL,
)
_NAMES = {"time": "<time>", "number": "<number>", "words": "<words>", "cc": ">>", "colon": ":", "dash": "—", "line": "/", "other": "."}


@dataclass
class Token:
    name: str
    start: int
    end: int


def tokens(text: str, at: int = 0) -> list[Token]:
    """The first TOKENS tokens of a line that begins at a place; tags and blanks are none."""
    out: list[Token] = []
    for m in _TOKEN.finditer(text, at):
        kind = m.lastgroup
        if kind == "skip":
            continue
        out.append(Token(m.group() if kind == "mark" else _NAMES[kind], m.start(), m.end()))
        if len(out) == TOKENS or kind == "line":
            break
    return out


def label(row: list[Token]) -> tuple[int, int] | None:
    """(slot, tokens up to its end) of the first words, if they are set off like a label.

    They are if a colon or dash follows, maybe behind a note in brackets, or if
    they stand in brackets themselves; a colon behind those belongs to them.
    """
    names = [t.name for t in row]
    if "<words>" not in names:
        return None
    slot = names.index("<words>")
    before, after = (names[slot - 1] if slot else ""), slot + 1
    close = {"[": "]", "(": ")"}
    if before in close:
        if names[after : after + 1] != [close[before]]:
            return None
        after += 1
        return slot, after + (names[after : after + 1] == [":"])
    if names[after : after + 1] and names[after] in close:
        end = close[names[after]]
        if end not in names[after:]:
            return None
        after += names[after:].index(end) + 1
    return (slot, after + 1) if names[after : after + 1] and names[after] in (":", "—") else None


def shape(row: list[Token]) -> str:
    return " ".join(t.name for t in row)


class Tree:
    """The tree; rows are added by their shapes, the commonest first."""

    def __init__(self):
        self.leaves: dict[tuple, list[list[str]]] = {}

    def add(self, shape: str) -> tuple[tuple, int]:
        """The leaf and number of the template a shape belongs to."""
        row = shape.split(" ")
        path = (len(row), *row[:DEPTH])
        leaf = self.leaves.setdefault(path, [])
        shared = [sum(a == b for a, b in zip(t, row)) for t in leaf]
        best = max(range(len(leaf)), key=shared.__getitem__, default=-1)
        if best >= 0 and shared[best] >= ALIKE * len(row):
            leaf[best] = [a if a == b else "*" for a, b in zip(leaf[best], row)]
        else:
            best = len(leaf)
            leaf.append(row)
        return path, best

    def template(self, key: tuple[tuple, int]) -> str:
        return " ".join(self.leaves[key[0]][key[1]])

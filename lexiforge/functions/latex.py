"""Recognised LaTeX made compact: a tree of groups is simplified node by node and written out with the blanks that LaTeX needs."""

from __future__ import annotations

import itertools
import re

#: Commands whose argument stands without them, environments that go, sizes that go, blanks, and what keeps blanks around it.
FONTS = {r"\mathbf", r"\mathsf", r"\mathrm", r"\mathit", r"\boldsymbol", r"\mathcal", r"\operatorname", r"\text", r"\textbf"}
FRAMES = {"array", "aligned", "align", "align*", "gathered", "split", "cases"}
SIZES = {r"\left", r"\right", r"\big", r"\Big", r"\bigg", r"\Bigg"}
BLANKS = {r"\quad", r"\qquad", r"\,", r"\;", r"\:", r"\!"}
OPERATORS = {"=", "+", "-", "<", ">", "&", r"\leq", r"\geq", r"\neq", r"\approx", r"\le", r"\ge", r"\times", r"\cdot", r"\pm", r"\in", r"\to"}
TIGHT = set("(){}[]^_,")

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[{}~]|\s+|[^\\{}~\s]+|\\", re.S)


def parsed(latex: str) -> list:
    """Tokens, a group in braces as a list of its own. Braces without a partner are tokens."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(latex):
        if token == "{":
            stack.append([])
        elif token == "}" and len(stack) > 1:
            group = stack.pop()
            stack[-1].append(group)
        else:
            stack[-1].append(token)
    while len(stack) > 1:
        group = stack.pop()
        stack[-1] += ["{", *group]
    return stack[0]


def written(nodes: list, short: bool = False) -> str:
    """Nodes as text; short leaves the braces of a script of one character away."""
    out = ""
    for n in nodes:
        inner = n if isinstance(n, str) else written(n, short)
        bare = isinstance(n, str) or (short and out[-1:] in ("_", "^") and len(inner) == 1 and inner != "\\")
        out += inner if bare else f"{{{inner}}}"
    return out


def trimmed(nodes: list) -> list:
    """Nodes without blank ones at both ends."""
    blank = lambda n: isinstance(n, str) and not n.strip()
    return list(itertools.dropwhile(blank, list(itertools.dropwhile(blank, nodes))[::-1]))[::-1]


class _Simplifier:
    """Rewrites nodes, and keeps the first equation number it takes out."""

    def __init__(self) -> None:
        self.number: str | None = None

    def take(self, number: str) -> None:
        self.number = self.number or number.strip()

    def nodes(self, nodes: list) -> list:
        out, i = [], 0

        def argument(at: int) -> int | None:
            """Place of the group that follows, over blanks."""
            while at < len(nodes) and isinstance(nodes[at], str) and not nodes[at].strip():
                at += 1
            return at if at < len(nodes) and isinstance(nodes[at], list) else None

        while i < len(nodes):
            n, i = nodes[i], i + 1
            if isinstance(n, list):
                out.append(self.nodes(n))
                continue
            at = argument(i)
            if n in (r"\begin", r"\end") and at is not None and written(nodes[at]).strip() in FRAMES:
                i = at + 1
                columns = argument(i)
                if columns is not None and re.fullmatch(r"[lcr| ]+", written(nodes[columns])):
                    i = columns + 1
            elif n == r"\tag" and at is not None and all(isinstance(x, str) for x in nodes[at]):
                self.take(written(nodes[at]))
                i = at + 1
            elif n in FONTS and at is not None:
                inner = trimmed(self.nodes(nodes[at]))
                out += inner if all(isinstance(x, str) for x in inner) else [n, inner]
                i = at + 1
            elif n in SIZES:
                while i < len(nodes) and isinstance(nodes[i], str) and not nodes[i].strip():
                    i += 1
            else:
                out.append(" " if n in BLANKS or n == "~" else n)
        return out


def without_trailing_number(nodes: list) -> tuple[list, str | None]:
    """A number in parentheses that stands alone behind a wide blank at the end, and the nodes before it."""
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i] in (r"\quad", r"\qquad"):
            if m := re.fullmatch(r"\s*\((\d{1,3}[a-z]?)\)\s*", written(nodes[i + 1 :])):
                before = trimmed(nodes[:i])
                if before and isinstance(before[-1], str) and before[-1][-1:] in (",", "."):
                    before[-1] = before[-1][:-1]
                return before, m[1]
            break
    return nodes, None


def spaced(text: str) -> str:
    """Blanks only after commands and around operators."""
    merged: list[str] = []
    for word in text.split():
        if merged and (merged[-1][-1] in TIGHT or word[0] in TIGHT):
            merged[-1] += word
        else:
            merged.append(word)
    out = merged[:1]
    for a, b in itertools.pairwise(merged):
        out += [" " if re.search(r"\\[A-Za-z]+$", a) or a in OPERATORS or b in OPERATORS else "", b]
    return "".join(out)


def tidy_latex(latex: str) -> str:
    """Recogniser output as compact LaTeX; a tag or trailing number moves to the end in parentheses."""
    simple = _Simplifier()
    nodes, trailing = without_trailing_number(parsed(latex))
    nodes = trimmed(simple.nodes(nodes))
    if trailing:
        simple.take(trailing)
    # Frames that went may leave one group around all; punctuation at the end goes.
    while True:
        while nodes and isinstance(nodes[-1], str) and not nodes[-1].rstrip(",. \t\n"):
            nodes = nodes[:-1]
        if len(nodes) != 1 or isinstance(nodes[0], str):
            break
        nodes = trimmed(nodes[0])
    close = written(parsed(spaced(written(nodes))), short=True)  # blanks go by what stands in braces
    text = " = ".join(part.strip() for part in close.split("="))
    text = " ".join(text.split()).rstrip(",.")
    return f"{text}  ({simple.number})" if simple.number else text

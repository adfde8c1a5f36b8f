"""Fields of HTML pages by selector: every page is parsed once into a tree, in Arrow batches, and gives all its fields.

A rule is (kind, selector) or (kind, selector, attribute):

- ``text``: text of the first element that the selector finds;
- ``all``: texts of all of them;
- ``attr`` / ``attrs``: an attribute of the first, or of all;
- ``row``: the cell beside a label, in tables and definition lists;
- ``source``: what the page holds between the start and end tags of the first, as it is written;
- ``has``: "true" if there is such an element.

A selector is a chain of steps for descendants, each ``tag#id.class.class`` with any of
the parts. Texts have their references decoded and single spaces; block elements and
``br`` end a line. Scripts, styles, templates and comments have no text. Elements that
are never closed end with their parent, and an end tag without a beginning is left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends an open element of these kinds, as far up as one of the walls; every block ends an open paragraph.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("ul ol dl table select div body html section article".split())


class Tree(HTMLParser):
    """Elements in page order: tag, attributes, parent and the place of its last descendant; text runs by element."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attributes, self.parents, self.last = [""], [{}], [-1], [0]
        self.runs: list[tuple[int, str]] = []  # (element, text)
        self.before: list[int] = [0]  # text runs before each element
        self.upto: list[int] = [0]
        self.page, self.begins, self.ends = page, [((1, 0), 0)], [None]  # places as (line, column), and the length of the start tag
        self.stack, self.open = [0], defaultdict(int)
        self.feed(page)
        self.close()
        while self.stack:
            self._pop()

    def _pop(self) -> None:
        i = self.stack.pop()
        self.open[self.tags[i]] -= 1
        self.last[i], self.upto[i] = len(self.tags) - 1, len(self.runs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended = (*ENDS.get(tag, ()), "p") if tag in BLOCKS else ENDS.get(tag, ())
        if any(self.open[kind] > 0 for kind in ended):
            depth = next((k for k in range(len(self.stack) - 1, 0, -1) if self.tags[self.stack[k]] in ended or self.tags[self.stack[k]] in WALLS), 0)
            if depth and self.tags[self.stack[depth]] in ended:
                while len(self.stack) > depth:
                    self._pop()
        i = len(self.tags)
        if tag in BLOCKS:
            self.runs.append((i, "\n"))
        self.tags.append(tag)
        self.attributes.append({k: v or "" for k, v in reversed(attrs)})
        self.parents.append(self.stack[-1])
        self.last.append(i)
        self.before.append(len(self.runs))
        self.upto.append(len(self.runs))
        self.begins.append((self.getpos(), len(self.get_starttag_text())))
        self.ends.append(None)
        if tag not in VOID:
            self.stack.append(i)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] > 0:  # without one open there is nothing to look for, however deep the page
            while self.tags[self.stack[-1]] != tag:
                self._pop()
            self.ends[self.stack[-1]] = self.getpos()
            self._pop()
        if tag in BLOCKS:
            self.runs.append((self.stack[-1], "\n"))

    def handle_data(self, data: str) -> None:
        if not any(self.open[t] > 0 for t in SILENT):
            self.runs.append((self.stack[-1], data))

    def text(self, i: int) -> str:
        lines = "".join(t for _, t in self.runs[self.before[i] : self.upto[i]]).split("\n")
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)

    def source(self, i: int) -> str:
        if self.ends[i] is None:  # no end tag
            return ""
        if not hasattr(self, "lines"):
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.page))]
        at = lambda place: self.lines[place[0] - 1] + place[1]
        begin, tag = self.begins[i]
        return self.page[at(begin) + tag : at(self.ends[i])]

    def find(self, selector: str) -> list[int]:
        """Elements in page order."""
        steps = [_step(s) for s in selector.split()]
        out = []
        for i in self._candidates(steps[-1]):
            up, k = self.parents[i], len(steps) - 2
            while k >= 0 and up > 0:
                if self._fits(up, steps[k]):
                    k -= 1
                up = self.parents[up]
            if k < 0:
                out.append(i)
        return out

    def _fits(self, i: int, step: tuple[str, str, tuple[str, ...]]) -> bool:
        tag, ident, classes = step
        a = self.attributes[i]
        return (not tag or self.tags[i] == tag) and (not ident or a.get("id") == ident) and (not classes or set(classes) <= set(a.get("class", "").split()))

    def _candidates(self, step: tuple[str, str, tuple[str, ...]]) -> list[int]:
        if not hasattr(self, "index"):
            self.index: dict[str, list[int]] = defaultdict(list)
            for i in range(1, len(self.tags)):
                self.index[self.tags[i]].append(i)
                if ident := self.attributes[i].get("id"):
                    self.index["#" + ident].append(i)
                for c in dict.fromkeys(self.attributes[i].get("class", "").split()):
                    self.index["." + c].append(i)
        tag, ident, classes = step
        key = "#" + ident if ident else "." + classes[0] if classes else tag
        return [i for i in self.index.get(key, ()) if self._fits(i, step)]

    def row(self, label: str) -> str | None:
        """The cell beside the first head cell of this text (a colon may follow it)."""
        if not hasattr(self, "rows"):
            self.rows: dict[str, str] = {}
            for head, cell in (("th", "td"), ("td", "td"), ("dt", "dd")):
                for i in self._candidates((head, "", ())):
                    beside = self.last[i] + 1  # what comes after the head's last descendant, if it has the same parent
                    if beside < len(self.tags) and self.parents[beside] == self.parents[i] and self.tags[beside] == cell:
                        name = " ".join(self.text(i).split()).rstrip(": ‎‏").lower()
                        if name not in self.rows and (value := self.text(beside)):
                            self.rows[name] = value
        return self.rows.get(label.lower())


def _step(text: str) -> tuple[str, str, tuple[str, ...]]:
    tag = re.match(r"[\w-]*", text)[0].lower()
    return tag, next(iter(re.findall(r"#([\w-]+)", text)), ""), tuple(re.findall(r"\.([\w-]+)", text))


def apply_rule(tree: Tree, rule: tuple[str, ...]) -> list[str]:
    kind, selector, *name = rule
    if kind == "row":
        return [v for v in (tree.row(selector),) if v]
    found = tree.find(selector)
    if kind == "has":
        return ["true"] if found else []
    if kind in ("text", "attr", "source"):
        found = found[:1]
    return [v for v in (tree.text(i) if kind in ("text", "all") else tree.source(i) if kind == "source" else tree.attributes[i].get(name[0], "").strip() for i in found) if v]


def selected(html: Column, fields: dict[str, tuple[tuple[str, ...], ...]]) -> Column:
    """struct of one array of texts per field: what its rules find, in the order of the rules; empty where nothing is found, and for a null page."""
    names = list(fields)

    @F.pandas_udf(", ".join(f"`{n}` array<string>" for n in names))
    def parse(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            tree = Tree(page or "")
            rows.append([[v for rule in fields[n] for v in apply_rule(tree, rule)] for n in names])
        return pd.DataFrame(rows, columns=names)

    return parse(html)

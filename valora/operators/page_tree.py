"""Elements of a page as one row of arrays; what they mean is decided in columns.

A row has the ``strings`` of a page in order, and its ``nodes``: elements, and the texts between
them. A node says where its text is among the strings, so no text is held twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = (
    "page_id bigint, strings array<string>, nodes array<struct<at:int,tag:string,parent:int,"
    "row:int,first:int,last:int,end:int,own:string>>"
)
# Fixed values of HTML: elements without content, and elements whose text is not page text.
_EMPTY = (
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr"
).split()
_APART = ("script", "style", "template")


class _Reader(HTMLParser):
    """Fills a flat node table; an end tag closes up to its nearest open tag of that name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.text = ""
        self._add("#page")
        self.open.append(0)

    def _add(self, tag: str, own: str | None = None) -> int:
        up = self.open[-1] if self.open else -1
        above = self.nodes[up] if self.open else {"tag": "", "row": -1}
        at, here = len(self.nodes), len(self.strings)
        row = up if above["tag"] == "tr" else above["row"]
        self.nodes.append(
            {"at": at, "tag": tag, "parent": up, "row": row, "first": here, "last": here, "end": at, "own": own}
        )
        return at

    def _close(self, at: int) -> None:
        self.nodes[at]["last"] = len(self.strings)
        self.nodes[at]["end"] = len(self.nodes) - 1

    def settle(self) -> None:
        """Put the text read so far under the innermost open element."""
        text, self.text = self.text, ""
        if not text:
            return
        top = self.nodes[self.open[-1]]
        if top["tag"] in _APART:
            top["own"] = " ".join(filter(None, [top["own"], text.strip()]))
            return
        self._add("#text", text)
        if text.strip():
            self.strings.append(text.strip())

    def handle_starttag(self, tag, attrs):
        self.settle()
        at = self._add(tag, "" if tag in _APART else None)
        if tag not in _EMPTY:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.settle()
        if tag in [self.nodes[at]["tag"] for at in self.open[1:]]:
            while True:
                at = self.open.pop()
                self._close(at)
                if self.nodes[at]["tag"] == tag:
                    break

    def handle_data(self, data):
        self.text += data

    def handle_comment(self, data):
        self.settle()
        self._add("#text", data)


#: Nodes that a task holds before it hands their pages on; a larger page goes by itself.
_HELD_NODES = 20_000


def read_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``mapInPandas`` body: one row of ``NODES`` per page, handed on in parts of bounded size."""
    for batch in batches:
        rows, held = [], 0
        for page, html in zip(batch["page_id"], batch["html"]):
            reader = _Reader()
            reader.feed(html or "")
            reader.close()
            reader.settle()
            for at in reader.open:
                reader._close(at)
            if rows and held + len(reader.nodes) > _HELD_NODES:
                yield _table(rows)
                rows, held = [], 0
            rows.append((page, reader.strings, reader.nodes))
            held += len(reader.nodes)
        yield _table(rows)


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "strings", "nodes"])


def node_text(strings: Column, node: Column, gap: str = " ") -> Column:
    """Text of a node: its own, or all page strings inside it."""
    inside = F.slice(strings, node["first"] + 1, node["last"] - node["first"])
    return F.coalesce(node["own"], F.array_join(inside, gap))

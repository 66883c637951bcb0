"""Rows of marked-up tables and of delimited text, as table functions over landed pages.

``TableRows`` is an Arrow table function: a page goes in, and for every data row of each table whose
header holds the wanted labels one row comes out, with its cells by place and by header, and the first
link of each cell. Crossed and unclosed markup is read as browsers do for tables.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_TYPE = "grid int, position int, cells array<string>, named map<string,string>, hrefs array<string>"
#: Elements whose text is never shown.
UNSEEN = frozenset("script style template noscript".split())
BREAKS = frozenset("br p div li".split())


def squeezed(text: str) -> str:
    return " ".join(text.replace(" ", " ").split())


class _Grid(HTMLParser):
    """Collects all tables of a page as lists of rows of (is header, text, first link)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[bool, str, str | None]]]] = []
        self.open: list[list[list]] = []  # tables that stand in one another
        self.cells: list[list] = []  # the open cell of each of them: header?, parts, link
        self.unseen = 0

    def _end_cell(self) -> None:
        if self.open and self.cells[-1] is not None:
            header, parts, link = self.cells[-1]
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append((header, squeezed("".join(parts)), link))
            self.cells[-1] = None

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "table":
            table: list = []
            self.tables.append(table)
            self.open.append(table)
            self.cells.append(None)
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            self.cells[-1] = [tag == "th", [], None]
        elif self.open and self.cells[-1] is not None:
            if tag in BREAKS:
                self.cells[-1][1].append(" ")
            if tag == "a" and self.cells[-1][2] is None:
                self.cells[-1][2] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.open:
            self._end_cell()
            self.open.pop()
            self.cells.pop()

    def handle_data(self, data):
        if not self.unseen and self.open and self.cells[-1] is not None:
            self.cells[-1][1].append(data)

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag("table")


def grid_rows(html: str | None, labels: list[str]) -> Iterator[tuple]:
    """Rows of the tables of a page whose header holds every one of ``labels`` (regular expressions);
    without labels, of all tables, with no header row."""
    parser = _Grid()
    parser.feed(html or "")
    parser.close()
    for number, table in enumerate(parser.tables):
        table = [row for row in table if row]
        header = [text for _, text, _ in table[0]] if table else []
        if labels and not all(any(re.search(label, h, re.I) for h in header) for label in labels):
            continue
        for position, row in enumerate(table[1:] if labels else table):
            texts = [text for _, text, _ in row]
            named: dict[str, str] = {}
            for name, text in zip(header if labels else [], texts):
                named.setdefault(name, text)
            yield number, position, texts, named, [link for _, _, link in row]


def delimited_rows(body: str | None, labels: list[str]) -> Iterator[tuple]:
    """Rows of comma-separated text under its header, which must hold ``labels``."""
    rows = [r for r in csv.reader(io.StringIO((body or "").lstrip("﻿"), newline="")) if any(x.strip() for x in r)]
    if not rows:
        return
    header = [squeezed(h) for h in rows[0]]
    missing = [label for label in labels if not any(re.fullmatch(label, h, re.I) for h in header)]
    if missing:
        raise ValueError(f"headers changed, missing: {', '.join(missing)}")
    for position, row in enumerate(rows[1:]):
        texts = [squeezed(x) for x in row]
        yield 0, position, texts, dict(reversed(list(zip(header, texts)))), [None] * len(texts)


@F.udtf(returnType=ROW_TYPE, useArrow=True)
class TableRows:
    def eval(self, html: str, labels: list):
        yield from grid_rows(html, list(labels if labels is not None else []))


@F.udtf(returnType=ROW_TYPE, useArrow=True)
class DelimitedRows:
    def eval(self, body: str, labels: list):
        yield from delimited_rows(body, list(labels if labels is not None else []))


def _beside(payloads: DataFrame, function, labels: list[str], body: str) -> DataFrame:
    wanted = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    return payloads.lateralJoin(function(F.col(body).outer(), wanted))


def table_rows(payloads: DataFrame, labels: list[str], body: str = "body") -> DataFrame:
    """``payloads`` beside the rows of their tables."""
    return _beside(payloads, TableRows, labels, body).drop(body)


def delimited(payloads: DataFrame, labels: list[str], body: str = "body") -> DataFrame:
    """``payloads`` beside the rows of their delimited text."""
    return _beside(payloads, DelimitedRows, labels, body).drop(body)

"""Reading one HTML page: a small per-row helper, mapped over the page table.

Spark has no HTML functions; everything around this (filters, joins, naming,
rendering) is done with Column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.functions import fixed
from corpusloom.functions.arrow import parts

PAGE_TYPE = "title string, content string, sections array<struct<title:string,content:string>>"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template rt rp".split())
_HEADINGS = frozenset(("h2", "h3", "h4"))


class _Page(HTMLParser):
    """Flat record of a page: elements with the range of text runs they hold."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.runs: list[str] = []
        self._open: list[int] = []
        self._names: dict[str, int] = {}
        self._text: list[str] = []

    def _flush(self) -> None:
        if self._text:
            hidden = any(self._names.get(n) for n in _HIDDEN)
            self.runs.append("" if hidden else "".join(self._text).strip())
            self._text = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        values = {k: v or "" for k, v in attrs}
        parent = self._open[-1] if self._open else -1
        at = len(self.runs)
        self.elements.append(
            {"name": tag, "classes": values.get("class", "").split(), "href": values.get("href"),
             "parent": parent, "first": at, "last": at}
        )
        if tag not in _VOID:
            self._open.append(len(self.elements) - 1)
            self._names[tag] = self._names.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        while self._names.get(tag):
            element = self.elements[self._open.pop()]
            element["last"] = len(self.runs)
            self._names[element["name"]] -= 1
            if element["name"] == tag:
                break

    def handle_data(self, data):
        self._text.append(data)

    def handle_comment(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def finish(self) -> "_Page":
        self.close()
        self._flush()
        for i in self._open:
            self.elements[i]["last"] = len(self.runs)
        return self

    def text(self, element: dict, glue: str) -> str:
        return glue.join(r for r in self.runs[element["first"] : element["last"]] if r)


def _parse(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    return page.finish()


def read_page(html: str, selectors) -> tuple[str, str, list[dict]]:
    page = _parse(html)
    title = next((page.text(e, "") for e in page.elements if e["name"] == "h1"), "")
    body = None
    for name, cls in selectors:
        body = next(
            (i for i, e in enumerate(page.elements) if e["name"] == name and (cls is None or cls in e["classes"])),
            None,
        )
        if body is not None:
            break
    if body is None:
        return title, "", []
    box = page.elements[body]
    inside, siblings = {body}, {}
    heads = []
    for i in range(body + 1, len(page.elements)):
        e = page.elements[i]
        if e["parent"] not in inside:
            continue
        inside.add(i)
        siblings.setdefault(e["parent"], []).append(i)
        if e["name"] in _HEADINGS:
            heads.append(i)
    sections = []
    place = {i: k for row in siblings.values() for k, i in enumerate(row)}
    for i in heads:
        head = page.elements[i]
        texts, row = [], siblings[head["parent"]]
        for k in range(place[i] + 1, len(row)):  # up to the next header, so each element is read once
            j = row[k]
            if page.elements[j]["name"] in _HEADINGS:
                break
            texts.append(page.text(page.elements[j], ""))
        texts = [t for t in texts if t]
        if texts:
            sections.append({"title": page.text(head, ""), "content": "\n\n".join(texts)})
    return title, page.text(box, "\n\n"), sections


def with_pages_read(df: DataFrame, html: str, schema: str, read, *more: str) -> DataFrame:
    """Replace column `html` by the fields that `read(html, values of more)` gives. An
    operator of its own and not a UDF, so that a filter on the result does not
    make Spark parse every page twice. Few pages are parsed at a time, however
    many Spark sends in a batch."""
    place = df.columns.index(html)
    kept = [i for i in range(len(df.columns)) if i != place]
    used = [df.columns.index(c) for c in more]
    fields = StructType.fromDDL(schema)
    out = StructType([*(df.schema[i] for i in kept), *fields.fields])
    types = to_arrow_schema(fields).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, place):
                texts = (x or "" for x in part.column(place).to_pylist())
                parsed = [read(*values) for values in zip(texts, *(part.column(i).to_pylist() for i in used))]
                new = [pa.array(column, kind) for column, kind in zip(zip(*parsed), types)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *new], names=out.names)

    return df.mapInArrow(run, out)


def read_articles(df: DataFrame, html: str = "html", selectors=None) -> DataFrame:
    """Title, body and sections of every page."""
    wanted = [tuple(s) for s in (selectors or fixed.BODY_SELECTORS)]
    return with_pages_read(df, html, PAGE_TYPE, lambda text: read_page(text, wanted))


def read_links(df: DataFrame, part: str, base: str, html: str = "html") -> DataFrame:
    """Absolute targets of every page's links that contain `part`, in page order."""

    def read(text: str, address: str | None) -> tuple[list[str]]:
        hrefs = [e["href"] for e in _parse(text).elements if e["name"] == "a" and e["href"] is not None]
        return ([urljoin(address or "", h) for h in hrefs if part in h],)

    return with_pages_read(df, html, "links array<string>", read, base)

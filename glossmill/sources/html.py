"""Text nodes of HTML pages, but for what a page does not show as its own English text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is skipped with all that is in it.
SKIP_TAGS = {"script", "style", "noscript", "code", "pre", "textarea", "input", "select", "option", "button", "label", "svg", "math"}
SKIP_CLASSES = {"ace_editor", "CodeMirror", "cm-editor", "monaco-editor"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Nodes(HTMLParser):
    def __init__(self, own: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.own, self.stack, self.skipping, self.out, self.body = own, [], 0, [], False

    def _skips(self, tag: str, attrs: dict) -> bool:
        lang = attrs.get("lang")
        return tag in SKIP_TAGS or "contenteditable" in attrs or bool(SKIP_CLASSES & set((attrs.get("class") or "").split())) or bool(self.own & set(attrs)) or (lang is not None and not lang.startswith("en"))

    def _pop(self) -> None:
        self.skipping -= self.stack.pop()[1]

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.body = True
        while self.stack and (self.stack[-1][0] in CLOSES.get(tag, ()) or self.stack[-1][0] == "p" and tag in BLOCKS):
            self._pop()
        if tag in VOID or tag == "html":
            return
        skips = tag not in ("head",) and self._skips(tag, dict(attrs)) or tag in ("head", "title")
        self.stack.append((tag, int(skips)))
        self.skipping += int(skips)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.skipping and data.strip():
            if self.out and self.out[-1][0] == id(self):
                self.out[-1] = (id(self), self.out[-1][1] + data)
            else:
                self.out.append((None, data))


def nodes(html: str, own: frozenset[str] = frozenset()) -> list[str]:
    """Non-blank text nodes in document order. ``own`` are attributes that mark inserted elements. Unclosed tags are closed as browsers do."""
    parser = _Nodes(own)
    parser.feed(html)
    parser.close()
    return [text for _, text in parser.out]


def text_nodes(pages: DataFrame, key: str, html: str, own: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``node_no`` from 0, ``text``. Null and empty pages give no rows; Arrow batches, no shuffle."""
    rows = pages.select(F.col(key), F.col(html).alias("__h")).where("__h IS NOT NULL")
    schema = pages.select(key).schema.add("node_no", T.IntegerType()).add("text", T.StringType())
    marks = frozenset(own)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, out = [], [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                found = nodes(page, marks)
                at.extend([k] * len(found))
                no.extend(range(len(found)))
                out.extend(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(scan, schema)

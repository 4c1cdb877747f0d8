"""Readable text of HTML pages, without scripts, tables, figures, formulas and footnote marks. Nested skipped elements are
counted, so a same-named inner one doesn't end the outer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements and parts of class names that are left out, elements that break a line, and lines that are page furniture (fixed
#: values).
SKIPPED = {"script", "style", "table", "sup", "figure", "math"}
SKIPPED_CLASSES = ("reference", "mw-editsection", "navigation-not-searchable")
BLOCKS = {"p", "div", "section", "h1", "h2", "h3", "h4", "li"}
FURNITURE = {"*", "* * *", "Télécharger", "Outils"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_MARK = re.compile(r"\[[0-9]+\]")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list[str]] = [[]]
        self.skips: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr") and not self.skips:
                self.lines.append([])
            return
        classes = dict(attrs).get("class") or ""
        if self.skips or tag in SKIPPED or any(c in classes for c in SKIPPED_CLASSES):
            self.skips.append(tag)
        elif tag in BLOCKS:
            self.lines.append([])

    def handle_endtag(self, tag: str) -> None:
        if self.skips:
            if tag in self.skips:
                while self.skips.pop() != tag:
                    pass
        elif tag in BLOCKS:
            self.lines.append([])

    def handle_data(self, data: str) -> None:
        if self.skips:
            return
        first, *others = data.strip().split("\n")
        self.lines[-1].append(first)
        self.lines += [[x] for x in others]


def text_of(html: str | None) -> str:
    """Lines of text; a blank line stands for any number of breaks without text. Empty where there is no text."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    out: list[str] = []
    for parts in reader.lines:
        line = re.sub(r"[ \t]+", " ", _MARK.sub("", " ".join(p for p in parts if p))).strip()
        if line in FURNITURE or (not line and (not out or not out[-1])):
            continue
        out.append(line)
    return "\n".join(out).strip()


def page_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and text. A null page has none."""
    src = pages.select(*keep, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(out | {"text": pa.array([text_of(x) for x in batch.column(html).to_pylist()], pa.string())})

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != html)
    return src.mapInArrow(run, (head + ", " if head else "") + "text string")


def between_markers(text: str, start: str | None, end: str | None) -> str:
    """What lies from the start marker to the end marker; a marker that isn't there doesn't cut."""
    a = text.find(start) if start else 0
    text = text[max(a, 0) :]
    b = text.find(end) if end else -1
    return text[:b] if b >= 0 else text

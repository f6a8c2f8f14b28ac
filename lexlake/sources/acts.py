"""Acts of any shape as table functions, for SQL: lines, metadata and legal basis.

``register`` gives a session ``act_rows(content, part)``: the rows of an act in official XML, HTML or marked text (told by its beginning). What ``part`` asks for
decides the columns: 'lines' (line_no, kind, text), 'metadata' (field, value), 'basis' (place, text, reference).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexlake.sources.laws import FORMEX_TAGS, _ActParser, _flat

SCHEMAS = {
    "lines": StructType().add("line_no", "integer").add("kind", "string").add("text", "string"),
    "metadata": StructType().add("field", "string").add("value", "string"),
    "basis": StructType().add("place", "integer").add("text", "string").add("reference", "string"),
}
# Elements of the official act XML whose content describes the act, by the field that it is.
DESCRIBING = {"NO.DOC": "number", "NO.CELEX": "celex", "DATE": "date", "LG.DOC": "language", "REF.OJ": "journal", "COLL": "series", "NO.OJ": "journal_number"}
_REFERENCE = re.compile(r"\b(?:\d{2,4}/\d+(?:/[A-Z]+)?|\d{5}[A-Z]\d{4})\b")
_MARK = re.compile(r"^\[(TITULO|CAPITULO|ARTICULO)\]\s*")


def shape(content: str) -> str:
    """xml, html or marked."""
    head = content.lstrip()[:500].lower()
    if head.startswith(("<!doctype html", "<html")) or re.match(r"<(?:body|div|p|table)\b", head):
        return "html"
    return "xml" if head.startswith("<") else "marked"


def _walk(e: ET.Element, inside: str) -> Iterator[tuple[str, str]]:
    kind = FORMEX_TAGS.get(e.tag) or (("title" if inside == "ACT" else "heading") if e.tag == "TITLE" else None)
    if kind:
        if text := _flat(e):
            yield kind, text
        return
    for child in e:
        yield from _walk(child, e.tag)


def lines(content: str) -> Iterator[tuple[str, str]]:
    """Kind and text of every line of an act; an unreadable one is one line of kind error."""
    form = shape(content)
    if form == "xml":
        try:
            yield from _walk(ET.fromstring(content.strip()), "")
        except ET.ParseError as e:
            yield "error", str(e)
    elif form == "html":
        parser = _ActParser()
        parser.feed(content)
        parser.close()
        yield from parser.lines
    else:
        for line in content.splitlines():
            if line.strip():
                mark = _MARK.match(line)
                title = line.startswith(("TÍTULO:", "TIPO:"))
                yield ("article" if mark[1] == "ARTICULO" else "heading") if mark else "title" if title else "text", _MARK.sub("", line).strip()


def metadata(content: str) -> Iterator[tuple[str, str]]:
    """Field and value of what describes an act: elements of the official XML, named meta elements of HTML, heading lines of marked text."""
    form = shape(content)
    if form == "xml":
        try:
            root = ET.fromstring(content.strip())
        except ET.ParseError:
            return
        for e in root.iter():
            if e.tag in DESCRIBING and (text := e.get("ISO") or _flat(e)):
                yield DESCRIBING[e.tag], text
    elif form == "html":
        for tag in re.findall(r"<meta\b[^>]*>", content, re.I):
            named = dict((k.lower(), v) for k, v in re.findall(r'(\w+)\s*=\s*"([^"]*)"', tag))
            if "name" in named:
                yield named["name"].lower(), named.get("content", "")
    else:
        for line in content.splitlines():
            if line.startswith(("TÍTULO:", "TIPO:")):
                field, _, value = line.partition(":")
                yield field.lower(), value.strip()


def basis(content: str) -> Iterator[tuple[str, str | None]]:
    """Every clause of an act's legal basis with the first act or number that it names."""
    if shape(content) != "xml":
        return
    try:
        root = ET.fromstring(content.strip())
    except ET.ParseError:
        return
    for e in root.iter("VISA"):
        text = _flat(e)
        named = _REFERENCE.search(text)
        yield text, named[0] if named else None


class _ActRows:
    @staticmethod
    def analyze(content: AnalyzeArgument, part: AnalyzeArgument) -> AnalyzeResult:
        if not part.isConstantExpression or part.value not in SCHEMAS:
            raise ValueError(f"the part must be one of {sorted(SCHEMAS)}, said as a constant")
        return AnalyzeResult(SCHEMAS[part.value])

    def eval(self, content: str | None, part: str) -> Iterator[tuple]:
        if content is None:
            return
        if part == "lines":
            for n, row in enumerate(lines(content)):
                yield (n, *row)
        elif part == "metadata":
            yield from metadata(content)
        else:
            for n, row in enumerate(basis(content)):
                yield (n, *row)


def register(spark: SparkSession) -> None:
    """Give a session the function ``act_rows``."""
    spark.udtf.register("act_rows", udtf(_ActRows))

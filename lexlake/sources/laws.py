"""Law XML and acts in HTML or marked text, flattened to one row per line.

The XML and HTML parsers are small per-document helpers inside Arrow functions; everything that
follows from the lines (structure, articles, versions) is DataFrame work.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = "law_id string, block_no int, block_id string, block_type string, block_title string, version_no int, source_id string, published string, valid_from string, line_no int, kind string, text string"
META = "law_id string, field string, value string"
#: Rows handed on to Spark at a time, and whole texts handed to Python at a time.
BATCH, TEXTS = 4096, 64
# Block types that hold no law text.
SKIPPED_BLOCKS = ["nota_inicial", "firma"]
# Classes of the official HTML, by what a line of them is.
HTML_CLASSES = {
    "heading": ["ti-section-1", "ti-section-2", "ti-grseq-1", "oj-ti-section-1", "oj-ti-section-2"],
    "article": ["ti-art", "oj-ti-art"],
    "subtitle": ["sti-art", "oj-sti-art", "eli-title"],
    "text": ["normal", "oj-normal"],
    "title": ["doc-ti", "oj-doc-ti"],
}


def _flat(e: ET.Element) -> str:
    """Text of an element with all inside it, white space collapsed."""
    return " ".join((" ".join(e.itertext()) if len(e) else e.text or "").split())


def _table(e: ET.Element) -> str:
    """A table in rows of cells between bars, a rule after the first; empty cells are hyphens."""
    rows = [[_flat(c) or "-" for c in r if c.tag in ("td", "th")] for r in e.iter("tr")]
    rows = [r for r in rows if r]
    out = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join(out[:1] + ["|" + "---|" * len(rows[0])] + out[1:]) if rows else ""


def _law_lines(law_id: str, xml: str | None) -> Iterator[tuple]:
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError as e:
        yield (law_id, None, None, "error", None, None, None, None, None, None, "error", str(e))
        return
    for b, block in enumerate(root.iter("bloque")):
        for v, version in enumerate(block.iter("version")):
            head = (law_id, b, block.get("id"), block.get("tipo"), block.get("titulo"), v, version.get("id_norma"), version.get("fecha_publicacion"), version.get("fecha_vigencia"))
            for n, e in enumerate(version):
                if e.tag == "blockquote":
                    continue
                text = _table(e) if e.tag == "table" else _flat(e)
                if text:
                    yield (*head, n, e.tag, text)


def _apply(df: DataFrame, schema: str, parse) -> DataFrame:
    """Rows that ``parse(id, content)`` yields for each row of ``df`` (id, content), in batches of about ``BATCH`` rows. For the rest of the session Python gets
    at most ``TEXTS`` rows at a time: a batch of the usual 10 000 holds whole laws several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXTS:
        df.sparkSession.conf.set(key, str(TEXTS))
    fields = [f.strip().split() for f in schema.split(",")]
    target = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in fields])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), target.types, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for i, content in zip(b.column(0), b.column(1), strict=True):
                held.extend(parse(i.as_py(), content.as_py()))
                if len(held) >= BATCH:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return df.mapInArrow(run, schema)


def law_lines(laws: DataFrame) -> DataFrame:
    """Lines of every version of every block of the laws (law_id, xml) but those without law text; a law that
    can't be read gives one line of kind error."""
    rows = _apply(laws.select("law_id", "xml"), LINES, _law_lines)
    return rows.filter(~F.col("block_type").isin(SKIPPED_BLOCKS) | F.col("block_type").isNull())


def law_metadata(laws: DataFrame) -> DataFrame:
    """law_id, field, value of the descriptive fields, subjects and references of every law."""

    def parse(law_id: str, xml: str | None) -> Iterator[tuple]:
        try:
            root = ET.fromstring(xml or "")
        except ET.ParseError:
            return
        for part in ("metadatos", "analisis"):
            for top in root.iter(part):
                for e in top.iter():
                    if e is not top and not len(e) and (e.text or "").strip():
                        yield (law_id, e.tag, e.text.strip())

    return _apply(laws.select("law_id", "xml"), META, parse)


class _ActParser(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.lines: list[tuple[str, str]] = []
        self.kind, self.depth, self.held = None, 0, []

    def handle_starttag(self, tag, attrs):
        if self.kind:
            self.depth += tag not in ("br", "img", "hr", "meta", "link", "input")
            return
        classes = (dict(attrs).get("class") or "").split()
        self.kind = next((k for k, names in HTML_CLASSES.items() if set(classes) & set(names)), None)
        self.depth = 1 if self.kind else 0

    def handle_endtag(self, tag):
        if self.kind:
            self.depth -= tag not in ("br", "img", "hr", "meta", "link", "input")
            if self.depth <= 0:
                if text := " ".join("".join(self.held).split()):
                    self.lines.append((self.kind, text))
                self.kind, self.held = None, []

    def handle_data(self, data):
        if self.kind:
            self.held.append(data)


def html_lines(acts: DataFrame) -> DataFrame:
    """law_id, line_no, kind, text of acts in HTML (law_id, html), by the class of each element."""

    def parse(law_id: str, html: str | None) -> Iterator[tuple]:
        p = _ActParser()
        p.feed(html or "")
        p.close()
        for n, (kind, text) in enumerate(p.lines):
            yield (law_id, n, kind, text)

    return _apply(acts.select("law_id", "html"), "law_id string, line_no int, kind string, text string", parse)


# Elements of the official act XML, by what a line of them is.
FORMEX_TAGS = {"TI.ART": "article", "STI.ART": "subtitle", "ALINEA": "text", "PARAG": "text", "VISA": "text"}


def formex_lines(acts: DataFrame) -> DataFrame:
    """law_id, line_no, kind, text of acts in the official XML (law_id, xml); unreadable ones give one line of kind error.

    Headings are the titles of chapters and sections; an article's text is its paragraphs, without those inside others.
    """

    def walk(e: ET.Element, inside: str) -> Iterator[tuple[str, str]]:
        kind = FORMEX_TAGS.get(e.tag) or (("title" if inside == "ACT" else "heading") if e.tag == "TITLE" else None)
        if kind:
            if text := _flat(e):
                yield kind, text
            return
        for child in e:
            yield from walk(child, e.tag)

    def parse(law_id: str, xml: str | None) -> Iterator[tuple]:
        try:
            root = ET.fromstring(xml or "")
        except ET.ParseError as e:
            yield (law_id, 0, "error", str(e))
            return
        for n, (kind, text) in enumerate(walk(root, "")):
            yield (law_id, n, kind, text)

    return _apply(acts.select("law_id", "xml"), "law_id string, line_no int, kind string, text string", parse)


def marked_lines(acts: DataFrame) -> DataFrame:
    """The same of acts as marked text (law_id, content): [TITULO], [CAPITULO] and [ARTICULO] begin a line of their kind."""
    rows = acts.select("law_id", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    mark = F.regexp_extract("line", r"^\[(TITULO|CAPITULO|ARTICULO)\]", 1)
    kind = F.when(mark == "ARTICULO", "article").when(mark != "", "heading").when(F.rlike("line", F.lit("^(TÍTULO|TIPO):")), "title").otherwise("text")
    return rows.select("law_id", "line_no", kind.alias("kind"), F.trim(F.regexp_replace("line", r"^\[(TITULO|CAPITULO|ARTICULO)\]\s*", "")).alias("text"))


def is_html(content: Column) -> Column:
    """Whether a text looks like HTML."""
    return F.rlike(F.lower(F.substring(content, 1, 500)), F.lit(r"<(!doctype|html|body|div|p)[ >]"))


def act_articles(lines: DataFrame) -> DataFrame:
    """law_id, article_no, article_id (with the act's id before it), title, path, full_text of the articles of acts."""
    order = Window.partitionBy("law_id").orderBy("line_no")
    article, heading = F.col("kind") == "article", F.col("kind") == "heading"
    rows = lines.withColumn("article_no", F.sum(article.cast("int")).over(order)).withColumn("path", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(order))
    rows = rows.filter((F.col("article_no") > 0) & ~heading)
    body = F.array_sort(F.collect_list(F.when(F.col("kind").isin("text", "subtitle"), F.struct("line_no", "text"))))
    out = rows.groupBy("law_id", "article_no").agg(F.max(F.when(article, F.col("text"))).alias("title"), F.min_by("path", "line_no").alias("path"), F.array_join(F.transform(body, lambda x: x["text"]), "\n\n").alias("full_text"))
    return out.withColumn("article_id", F.concat_ws("_", "law_id", F.lit("articulo"), F.col("article_no").cast("string")))

"""XML and HTML as rows: lines, nodes, attributes, links."""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "idx long, parent long, tag string, attributes map<string,string>, text string, error string"
_MAP = pa.map_(pa.string(), pa.string())

# HTML elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def lines(docs: DataFrame, key: str, text: str, query: str | None = None) -> DataFrame:
    """(key, line, content), lines from 1, of documents that hold the query; the test reaches the scan."""
    some = docs if query is None else docs.where(F.col(text).contains(query))
    out = some.select(key, F.posexplode(F.split(text, "\n")).alias("_line", "content"))
    out = out.select(key, (F.col("_line") + 1).cast("long").alias("line"), "content")
    return out if query is None else out.where(F.col("content").contains(query))


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, tag, {k: v or "" for k, v in attrs}, "", None])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][2] == tag:
                del self.open[depth:]
                break

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]][4] += data


def html_rows(text: str) -> list[list]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    return parser.rows


def xml_rows(text: str) -> list[list]:
    """Elements in document order; a text that is no XML gives one row with the error."""
    rows: list[list] = []
    stack: list[int] = []
    parser = xml.parsers.expat.ParserCreate()

    def begin(tag, attributes):
        rows.append([len(rows), stack[-1] if stack else None, tag, dict(attributes), "", None])
        stack.append(len(rows) - 1)

    def data(value):
        rows[stack[-1]][4] += value

    def declared(*_):
        raise ValueError("entities are not read")

    parser.StartElementHandler, parser.EndElementHandler = begin, lambda _: stack.pop()
    parser.CharacterDataHandler, parser.EntityDeclHandler = data, declared
    try:
        parser.Parse(text, True)
    except (xml.parsers.expat.ExpatError, ValueError) as error:
        return [[0, None, None, {}, None, str(error)]]
    return rows


def nodes(docs: DataFrame, key: str, text: str, html: bool = False) -> DataFrame:
    """One row an element: idx in document order, parent idx, tag, attributes, own text; or one row with `error`."""
    parse = html_rows if html else xml_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [(r, row) for r, value in enumerate(part.column(1).to_pylist()) if value is not None for row in parse(value)]
                if not found:
                    continue
                cells = list(zip(*(row for _, row in found), strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), _MAP, pa.string(), pa.string()]
                maps = [list(m.items()) for m in cells[3]]
                columns = [pa.array(maps if k == 3 else list(c), t) for k, (c, t) in enumerate(zip(cells, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r for r, _ in found])), *columns], [key, "idx", "parent", "tag", "attributes", "text", "error"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {NODES}")


def attribute(name: str) -> Column:
    return F.element_at("attributes", name)


def links(text: Column, name: str = "href") -> Column:
    """The quoted values of an attribute, inside the JVM, without parsing the document."""
    return F.regexp_extract_all(text, F.lit(rf'{name}="([^"]*)"'), F.lit(1))


def deep_links(xml_nodes: DataFrame, key: str) -> DataFrame:
    """(key, destination, uri, action, mime_type) of navigation graphs: `deepLink` elements with the id of their parent."""
    parents = xml_nodes.select(F.col(key).alias("_k"), F.col("idx").alias("_i"), attribute("android:id").alias("destination"))
    link = xml_nodes.where("tag = 'deepLink'")
    joined = link.join(parents, (F.col(key) == F.col("_k")) & (F.col("parent") == F.col("_i")), "left")
    return joined.select(key, "destination", attribute("app:uri").alias("uri"), attribute("app:action").alias("action"), attribute("app:mimeType").alias("mime_type"))


def layout_references(xml_nodes: DataFrame, key: str) -> DataFrame:
    """(key, idx, reference, kind): classes that layouts name as tags or attributes, and included layouts."""
    named = F.when(F.col("tag").contains("."), F.struct(F.col("tag").alias("reference"), F.lit("view").alias("kind")))
    by_attribute = [
        F.when(attribute(a).isNotNull(), F.struct(attribute(a).alias("reference"), F.lit(kind).alias("kind")))
        for a, kind in (("class", "class"), ("android:name", "fragment"), ("tools:context", "context"), ("layout", "include"))
    ]
    found = xml_nodes.select(key, "idx", F.explode(F.filter(F.array(named, *by_attribute), lambda s: s.isNotNull())).alias("r"))
    return found.select(key, "idx", "r.reference", "r.kind")

"""Markup as rows: the elements of XML documents, and the tags of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NODE = "path string, node int, parent int, depth int, ancestors array<int>, position int, namespace string, tag string, text string, attributes map<string,string>, error string"
TAG = "path string, ord int, tag string, attributes map<string,string>"
BATCH = 5000


def _batches(rows, schema: pa.Schema):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def elements(raw: bytes):
    """(node, parent, depth, ancestors, position, namespace, tag, text, attributes) in document order; position counts from 0 among siblings."""
    n, todo = 0, [(ElementTree.fromstring(raw), None, (), 0)]
    while todo:
        e, parent, above, position = todo.pop()
        space, _, tag = e.tag.rpartition("}")
        yield n, parent, len(above), list(above), position, space[1:], tag, e.text, list(e.attrib.items())
        mine = (*above, n)
        todo += [(c, n, mine, k) for k, c in reversed(list(enumerate(e)))]
        n += 1


def xml(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each element of XML documents (path, content as text or bytes); one that can't be read is a row with an `error` (not UTF-8, not XML).

    Attributes of a namespace have it in their name, in braces.  ancestors are the elements around one, the root first.
    A null content has no rows.
    """

    def rows(batch: pa.RecordBatch):
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                raw.decode("utf-8-sig")
                for e in list(elements(raw)):
                    yield (name, *e, None)
            except UnicodeError:
                yield (name, *[None] * 9, "not UTF-8")
            except ElementTree.ParseError:
                yield (name, *[None] * 9, "not XML")

    schema = to_arrow_schema(StructType.fromDDL(NODE))

    def run(batches):
        yield from _batches((r for b in batches for r in rows(b)), schema)

    return docs.select(F.col(path).cast("string"), F.col(content).cast("binary").alias("content")).filter("content IS NOT NULL").mapInArrow(run, NODE)


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, list({k: v or "" for k, v in attrs}.items())))


def html_tags(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each opening tag of pages (path, content), by a parser, so what stands in a script or style is no tag."""

    def rows(batch: pa.RecordBatch):
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p = _Tags()
            p.feed(text)
            yield from ((name, n, *t) for n, t in enumerate(p.found))

    schema = to_arrow_schema(StructType.fromDDL(TAG))

    def run(batches):
        yield from _batches((r for b in batches for r in rows(b)), schema)

    return docs.select(F.col(path).cast("string"), F.col(content).cast("string").alias("content")).filter("content IS NOT NULL").mapInArrow(run, TAG)


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))

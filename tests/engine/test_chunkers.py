"""Chunkers by hand-derived expectations on sources of our own."""

import duckdb
import goldens
import pytest
from fixtures import FILES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.chunkers import documents, markup, python, scripts
from quarry.chunkers.base import Chunk, Context, numbered, split_recursively, within_limit
from quarry.operators import chunking, graph, resolution


def brief(chunks):
    return [(c.chunk_type, c.identity, c.sub_ordinal, c.line_start, c.line_end) for c in chunks]


def test_python():
    got = python.chunks(FILES["shop/cart.py"], Context("shop/cart.py"))
    assert brief(got) == [
        ("imports", "imports", 0, 2, 4), ("function", "total", 0, 7, 8), ("class", "Base", 0, 11, 12), ("method", "Base.check", 0, 14, 16),
        ("class", "Cart", 0, 19, 20), ("method", "Cart.items", 0, 22, 24), ("method", "Cart.pay", 0, 26, 29), ("method", "Cart.print_bill", 0, 32, 33), ("function", "orphan", 0, 36, 37),
    ]
    assert got[4].metadata["inherits"] == "Base,dict" and got[5].metadata["decorators"] == "property"
    assert got[6].header == "File: shop/cart.py\nClass: Cart\nMethod: Cart.pay".replace("Cart.pay", "pay")


def test_python_repeats_errors_and_limits():
    twice = "def f():\n    pass\n\n\ndef f():\n    return 1\n"
    assert [c.identity for c in python.chunks(twice, Context("a.py"))] == ["f", "f#1"]
    assert brief(python.chunks("def f(:\n" + "x\n" * 249, Context("a.py"))) == [("python_window", "window#0", 0, 1, 200), ("python_window", "window#1", 0, 181, 250)]
    assert python.chunks("  \n", Context("a.py")) == []
    long = "def f():\n" + "".join(f"    x{k} = {k}\n" for k in range(60))
    got = python.chunks(long, Context("a.py", max_tokens=40))
    assert [c.sub_ordinal for c in got] == list(range(len(got))) and len(got) > 2
    assert all(Context("", max_tokens=40).fits(c.embedding_text) for c in got)
    assert "\n".join(c.source_text for c in got) == long.rstrip("\n")


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=300), st.integers(3, 30))
def test_pieces_hold_everything_within_the_limit(source, limit):
    context = Context("p", max_tokens=limit)
    got = within_limit(Chunk("text", "x", source, 1, source.count("\n") + 1), context)
    if len(got) > 1:
        assert all(context.fits(c.embedding_text) and 1 <= c.line_start <= c.line_end for c in got)
        assert "".join("".join(c.source_text for c in got).split()) == "".join(source.split())


def test_markdown():
    got = documents.markdown(FILES["docs/guide.md"], Context("docs/guide.md"))
    assert [c.identity for c in got] == ["(preamble)", "Guide", "Guide > Notes", "Guide > Notes#1", "Guide > Notes > Deep"]
    assert "# no heading" in got[2].source_text and got[1].header == "File: docs/guide.md\nSection: Guide"
    long = "# A\n\n" + "\n\n".join(f"Paragraph {k} " + "word " * 100 for k in range(30)) + "\n\n```\n" + "code\n" * 200 + "```\n"
    pieces = documents.markdown(long, Context("a.md"))
    assert [p.sub_ordinal for p in pieces] == list(range(len(pieces))) and all(len(p.source_text) <= 4000 for p in pieces)
    assert sum("```\n" + "code\n" * 200 + "```" in p.source_text for p in pieces) == 1


def test_sql():
    got = scripts.sql(FILES["db/schema.sql"], Context("db/schema.sql"))
    assert [c.identity for c in got] == ["orders", "orders_total", "stmt#3", "stmt#4", "stmt#5"]
    meta = [c.metadata for c in got]
    assert meta[0]["leading_comment"] == "the orders" and meta[2]["cte_names"] == "big,top" and meta[2]["referenced_tables"] == "customers,orders"
    assert meta[2]["has_window_funcs"] == "true" and meta[3]["referenced_tables"] == "log,orders" and meta[4]["statement_type"] == "do"
    parts = scripts.sql(FILES["db/schema.sql"], Context("x.sql", max_tokens=12))
    assert [c.sub_ordinal for c in parts if c.identity == "stmt#3"] == [1, 2, 3]


def test_xml():
    source = FILES["data/catalog.xml"]
    assert brief(markup.xml(source, Context("c.xml"))) == [("xml_element", "catalog", 0, 1, 1)]
    small = markup.xml(source, Context("c.xml", max_tokens=20))
    assert [(c.identity, c.metadata["tag_path"]) for c in small] == [("b1", "catalog/book"), ("b2", "catalog/book")] and "&amp;" in small[1].source_text
    apart = markup.xml(source, Context("c.xml"), (lambda tag, a: markup.Claim("book", own_chunk=True) if tag == "book" else None,))
    assert [c.chunk_type for c in apart] == ["book", "book"]
    bomb = '<!DOCTYPE a [<!ENTITY b "x">]><a>&b;</a>'
    outside = '<!DOCTYPE a [<!ENTITY b SYSTEM "file:///etc/passwd">]><a>&b;</a>'
    for hostile in (bomb, outside, "<a>" * 300 + "</a>" * 300):
        with pytest.raises(markup.Refused):
            markup.xml(hostile, Context("x.xml"))


def test_javascript():
    got = scripts.javascript(FILES["web/app.js"], Context("web/app.js"))
    assert brief(got) == [("window", "window#0", 0, 1, 3), ("js_function", "start", 0, 4, 6), ("js_class", "App", 0, 8, 10), ("js_module", "size", 0, 12, 12), ("js_module", "app", 0, 13, 13)]
    assert scripts.javascript("x" * 900, Context("a.js")) == [] and scripts.javascript("a;", Context("a.min.js")) == []


def test_windows_of_text_and_styles():
    css = documents.stylesheet(FILES["web/site.css"], Context("web/site.css"))
    assert brief(css) == [("stylesheet", "window#0", 0, 1, 200), ("stylesheet", "window#1", 0, 161, 230)]
    shrunk = documents.stylesheet(FILES["web/site.css"], Context("web/site.css", max_tokens=100))
    assert [b.line_start for b in shrunk[1:]] == [a.line_end + 1 for a in shrunk[:-1]] and shrunk[-1].line_end == 230
    text = documents.text("one two\n\nthree four\n\nfive six\n", Context("a.txt", max_tokens=4))
    assert [c.source_text for c in text] == ["one two", "three four", "five six"] and [c.line_start for c in text] == [1, 3, 5]
    assert split_recursively("", 5) == [] and split_recursively("abcdefgh", 3) == ["abc", "def", "gh"]
    assert numbered(["a", "b", "a", "a"]) == ["a", "b", "a#1", "a#2"]


def test_imports_resolve_to_modules():
    r = python.raw_references("from . import a\nfrom .b import c\nfrom ...x import y\nfrom __future__ import annotations\nimport os.path as p\n", "pkg.sub.mod")
    assert r == [("pkg.sub.mod", "imports", "symbol", "pkg.sub.a"), ("pkg.sub.mod", "imports", "symbol", "pkg.sub.b.c"), ("pkg.sub.mod", "imports", "bare", "...x.y"), ("pkg.sub.mod", "imports", "module", "os.path")] or r[2][3] == "x.y"


@pytest.mark.parametrize("kind", sorted(goldens.SQL))
def test_small_project(spark, kind):
    """Chunks and references of the fixture's files stay what was checked against its sources."""
    suffix = {"python_chunks": ".py", "markdown_chunks": ".md", "sql_chunks": ".sql", "xml_chunks": ".xml", "js_chunks": ".js", "css_chunks": ".css", "text_chunks": ".txt", "resolve_refs": ".py"}[kind]
    files = spark.createDataFrame([("live", p, c) for p, c in sorted(FILES.items()) if p.endswith(suffix)], "tier string, file_path string, content string")
    chunks = chunking.chunk_files(files, chunking.default_registry())
    if kind == "resolve_refs":
        chunks = chunks.withColumn("point_id", F.concat_ws("#", "file_path", "identity"))
        got = graph.defines(chunks).select(*resolution.REF).unionByName(chunking.resolved_references(files, graph.derive_nodes(chunks)))
    else:
        got = chunks.withColumn("metadata", F.to_json("metadata"))
    want = duckdb.sql(goldens.SQL[kind])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)

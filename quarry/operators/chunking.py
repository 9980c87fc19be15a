"""From files to chunks: dispatch by suffix, chunkers on executors, ordinals, references resolved by joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.chunkers import documents, markup, python, scripts
from quarry.chunkers.base import Chunk, Context
from quarry.functions.keys import module_of
from quarry.operators import resolution

Chunker = Callable[[str, Context], list[Chunk]]
CHUNKERS: dict[str, Chunker] = {
    "python": python.chunks, "markdown": documents.markdown, "text": documents.text, "stylesheet": documents.stylesheet,
    "sql": scripts.sql, "xml": markup.xml, "javascript": scripts.javascript,
}
SCHEMA = "tier string, file_path string, chunk_type string, identity string, sub_ordinal int, line_start int, line_end int, source_text string, header string, metadata map<string,string>, error string"


class Registry:
    """Which chunker a file goes to: an override of its suffix; else the first whose pattern claims the path, other
    than the suffix's owner; else the suffix's owner; else none. Suffixes are compared without case.
    """

    def __init__(self) -> None:
        self.suffixes: dict[str, str] = {}
        self.patterns: dict[str, str] = {}
        self.overrides: dict[str, str] = {}
        self.names: list[str] = []

    def register(self, name: str, suffixes: list[str], handles: str | None = None) -> None:
        taken = [s for s in suffixes if self.suffixes.get(s.lower(), name) != name]
        if taken:
            raise ValueError(f"suffixes are taken: {taken}")
        if name not in self.names:
            self.names.append(name)
        self.suffixes |= {s.lower(): name for s in suffixes}
        if handles:
            self.patterns[name] = handles

    def override(self, mapping: dict[str, str]) -> None:
        """All of the mapping or, if it names an unknown chunker, nothing."""
        unknown = sorted({n for n in mapping.values() if n not in self.names})
        if unknown:
            raise ValueError(f"unknown chunkers: {unknown}")
        self.overrides |= {s.lower(): n for s, n in mapping.items()}

    def key(self, path: Column) -> Column:
        suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
        lookup = lambda m: F.coalesce(*(F.when(suffix == s, n) for s, n in m.items()), F.lit(None).cast("string"))
        owner = lookup(self.suffixes)
        claims = [F.when(path.rlike(self.patterns[n]) & ~owner.eqNullSafe(F.lit(n)), n) for n in self.names if n in self.patterns]
        return F.coalesce(lookup(self.overrides), *claims, owner)


def default_registry() -> Registry:
    r = Registry()
    for name, suffixes in (("python", [".py"]), ("markdown", [".md", ".markdown"]), ("sql", [".sql"]), ("stylesheet", [".css", ".scss"]), ("text", [".txt", ".rst"]), ("xml", [".xml"]), ("javascript", [".js"])):
        r.register(name, suffixes)
    return r


def embedding_text(header: Column, source: Column) -> Column:
    return F.when(header == "", source).otherwise(F.concat(header, F.lit("\n"), source))


def blanked_lines(text: Column, start: str) -> Column:
    """Lines that begin with ``start`` after white space are blanked, so that all lines keep their numbers."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(F.ltrim(x).startswith(start), "").otherwise(x)), "\n")


def with_ordinal(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The position of each row among those with equal keys, from 0."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def chunk_files(files: DataFrame, registry: Registry, chunkers: dict[str, Chunker] | None = None, slug: str = "demo", max_tokens: int = 8192) -> DataFrame:
    """Chunks of (tier, file_path, content). A file that its chunker refuses is one row with ``error`` and no chunk."""
    known = chunkers or CHUNKERS
    keyed = files.select("tier", "file_path", "content", registry.key(F.col("file_path")).alias("chunker_key")).where("chunker_key is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tier, path, content, key in batch.itertuples(index=False):
                context = Context(path, slug, max_tokens)
                try:
                    rows += [(tier, path, c.chunk_type, c.identity, c.sub_ordinal, c.line_start, c.line_end, c.source_text, c.header, c.metadata, None) for c in known[key](content or "", context)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the sweep
                    rows.append((tier, path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["tier", "file_path", "chunk_type", "identity", "sub_ordinal", "line_start", "line_end", "source_text", "header", "metadata", "error"])
            yield out.astype({c: "Int32" for c in ("sub_ordinal", "line_start", "line_end")})

    return keyed.mapInPandas(run, SCHEMA)


def raw_references(files: DataFrame) -> DataFrame:
    """(tier, file_path, src_qname, kind, how, target) of Python files, as the files themselves tell."""
    named = files.where(F.col("file_path").endswith(".py")).select("tier", "file_path", "content", module_of(F.col("file_path")).alias("module"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(tier, path, *r) for tier, path, content, module in batch.itertuples(index=False) for r in python.raw_references(content or "", module, path.endswith("__init__.py"))]
            yield pd.DataFrame(rows, columns=["tier", "file_path", "src_qname", "kind", "how", "target"])

    return named.mapInPandas(run, "tier string, file_path string, src_qname string, kind string, how string, target string")


def resolved_references(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (src_qname, dst, kind, resolved, tier, file_path) of all the files of a project."""
    raw = raw_references(files).persist()
    return resolution.resolve(raw, nodes, resolution.bases_of(raw, nodes))

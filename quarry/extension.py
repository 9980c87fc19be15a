"""Extensions: hooks that add chunkers, tools, ranking, keys and formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.chunkers.markup import Profile
from quarry.operators.chunking import Chunker, Registry


@dataclass(frozen=True)
class Tool:
    """A named query function."""

    name: str
    run: Callable[..., DataFrame]


@dataclass(frozen=True)
class Source:
    """listing(spark, root, tier, excluded directories): (tier, file_path, mtime_ns, size); contents(rows, root): these with
    ``content``.
    """

    listing: Callable[..., DataFrame]
    contents: Callable[[DataFrame, str], DataFrame]


class Extension:
    """All hooks do nothing; a subclass overrides what it needs. Column hooks may give None: no opinion."""

    name = "extension"
    config_model: type | None = None

    def chunkers(self) -> dict[str, tuple[Chunker, list[str], str | None]]:
        """name: (chunker, suffixes, pattern of paths it claims)"""
        return {}

    def xml_profiles(self) -> tuple[Profile, ...]:
        """Asked of each element in turn, those of earlier extensions first; they go to the executors."""
        return ()

    def tools(self, engine: Any) -> list[Tool]:
        return []

    def augment(self, hits: DataFrame, query: str) -> DataFrame:
        return hits

    def rerank(self, hits: DataFrame, query: str) -> DataFrame:
        return hits

    def format(self) -> Column | None:
        return None

    def chunk_key(self) -> Column | None:
        return None

    def classify_detail(self) -> Column | None:
        return None

    def payload_columns(self) -> dict[str, Column]:
        """More columns of the points, from those of a chunk; searches can filter by them. A change asks for a rebuild."""
        return {}

    def sources(self) -> dict[str, Source]:
        """Where the files of a root come from, by the name that its ``source`` says."""
        return {}

    def on_startup(self, engine: Any) -> None: ...

    def on_shutdown(self, engine: Any) -> None: ...


@dataclass
class Extensions:
    """Registered extensions, in order. Configuration is checked before anything is changed."""

    items: list[Extension] = field(default_factory=list)

    def register(self, extension: Extension, registry: Registry, chunkers: dict[str, Chunker], config: dict | None = None) -> None:
        if extension.config_model is not None:
            extension.config_model(**(config or {}))
        names = {t.name for e in self.items for t in e.tools(None)}
        twice = names & {t.name for t in extension.tools(None)}
        if twice:
            raise ValueError(f"tools of these names exist: {sorted(twice)}")
        for name, (_, suffixes, _) in extension.chunkers().items():
            if any(registry.suffixes.get(s.lower(), name) != name for s in suffixes):
                raise ValueError(f"suffixes of {name} are taken")
        for name, (chunker, suffixes, pattern) in extension.chunkers().items():
            registry.register(name, suffixes, pattern)
            chunkers[name] = chunker
        self.items.append(extension)

    def profiles(self) -> tuple[Profile, ...]:
        return tuple(p for e in self.items for p in e.xml_profiles())

    def payload(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for e in self.items:
            twice = out.keys() & e.payload_columns().keys()
            if twice:
                raise ValueError(f"payload columns of these names exist: {sorted(twice)}")
            out |= e.payload_columns()
        return out

    def source(self, name: str | None, default: Source) -> Source:
        if name is None:
            return default
        found = {n: s for e in reversed(self.items) for n, s in e.sources().items()}
        if name not in found:
            raise ValueError(f"unknown source {name}")
        return found[name]

    def tool(self, engine: Any, name: str) -> Tool:
        found = next((t for e in self.items for t in e.tools(engine) if t.name == name), None)
        if found is None:
            raise ValueError(f"unknown tool {name}")
        return found

    def start(self, engine: Any) -> None:
        """Starts all; if one fails, those that were started are shut down in reverse."""
        done: list[Extension] = []
        try:
            for e in self.items:
                e.on_startup(engine)
                done.append(e)
        except Exception:
            for e in reversed(done):
                e.on_shutdown(engine)
            raise

    def stop(self, engine: Any) -> None:
        for e in reversed(self.items):
            e.on_shutdown(engine)

    def _first(self, hook: str, default: Column) -> Column:
        own = [c for e in self.items if (c := getattr(e, hook)()) is not None]
        return F.coalesce(*own, default)

    def chunk_key(self, default: Column) -> Column:
        return self._first("chunk_key", default)

    def format(self, default: Column) -> Column:
        return self._first("format", default)

    def detail(self, default: Column) -> Column:
        return self._first("classify_detail", default)

    def augmented(self, hits: DataFrame, query: str) -> DataFrame:
        hits = reduce(lambda h, e: e.augment(h, query), self.items, hits)
        return reduce(lambda h, e: e.rerank(h, query), self.items, hits)

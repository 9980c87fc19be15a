"""Configuration, strict about keys; secrets come from the environment by name."""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

EPOCH = 2


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Embedding(Strict):
    backend: str = "hash"
    model: str = "hash"
    dim: int = Field(64, gt=0)
    endpoint: str = ""
    max_input_tokens: int = Field(8192, gt=0)
    tokenizer: str = "heuristic"
    truncate: bool = False
    document_prompt: str = ""
    query_prompt: str = ""
    api_key_env: str | None = None


class Root(Strict):
    tier: str
    path: str
    policy: Literal["live", "static"] = "live"
    version: str | None = None
    source: str | None = None

    @model_validator(mode="after")
    def static_has_version(self) -> Root:
        if self.policy == "static" and not self.version:
            raise ValueError("a static root needs a version")
        return self


class Config(Strict):
    project: str
    state_dir: str
    root: str | None = None
    roots: list[Root] = []
    include: list[str] = []
    exclude_dirs: list[str] = []
    exclude_globs: list[str] = []
    chunkers: dict[str, str] = {}
    embedding: Embedding = Embedding()
    debounce_ms: int = 1500
    buckets: int = Field(16, gt=0)
    extensions: dict[str, dict[str, Any]] = {}

    @field_validator("project")
    @classmethod
    def slug(cls, v: str) -> str:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", v):
            raise ValueError("a slug of lower-case letters, digits, _ and -")
        return v

    def effective_roots(self) -> list[Root]:
        """The roots, or one named ``default`` made from ``root``."""
        if self.roots or not self.root:
            return self.roots
        return [Root(tier="default", path=self.root)]


def load(path: str) -> Config:
    return Config.model_validate(yaml.safe_load(Path(path).read_text()))


def secret(name: str | None) -> str | None:
    """The value of an environment variable; an empty one is an error."""
    if name is None:
        return None
    value = os.environ.get(name, "")
    if not value:
        raise ValueError(f"the environment variable {name} is empty")
    return value


def fingerprint(config: Config, payload: tuple[str, ...] = ()) -> str:
    """SHA-256 of what decides the points (payload: more columns): if it changes, all must be embedded again."""
    e = config.embedding
    fields = {"epoch": EPOCH, "backend": e.backend, "model": e.model, "dim": e.dim, "endpoint": e.endpoint, "max_input_tokens": e.max_input_tokens, "tokenizer": e.tokenizer, "truncate": e.truncate, "document_prompt": e.document_prompt, "query_prompt": e.query_prompt, "chunkers": config.chunkers}
    fields |= {"payload": sorted(payload)} if payload else {}
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

"""XML by expat, with entities refused and depth limited."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from quarry.chunkers.base import Chunk, Context

MAX_DEPTH = 256
ID_ATTRIBUTES = ("id", "name", "key", "xml:id")


class Refused(ValueError):
    """A document with entity declarations, external references, or too deep."""


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    line: int
    parts: list[Element | str] = field(default_factory=list)
    last: int = 0

    @property
    def children(self) -> list[Element]:
        return [p for p in self.parts if isinstance(p, Element)]

    def text(self) -> str:
        head = self.tag + "".join(f" {k}={quoteattr(v)}" for k, v in self.attributes.items())
        inner = "".join(escape(p) if isinstance(p, str) else p.text() for p in self.parts)
        return f"<{head}>{inner}</{self.tag}>" if inner else f"<{head}/>"


def parsed(source: str) -> Element:
    parser = expat.ParserCreate()
    stack: list[Element] = []
    top: list[Element] = []

    def refuse(*_: object) -> None:
        raise Refused("entities and external references are refused")

    def start(tag: str, attributes: dict[str, str]) -> None:
        if len(stack) >= MAX_DEPTH:
            raise Refused("too deep")
        node = Element(tag, attributes, parser.CurrentLineNumber)
        (stack[-1].parts if stack else top).append(node)
        stack.append(node)

    def end(_: str) -> None:
        stack.pop().last = parser.CurrentLineNumber

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: stack[-1].parts.append(data) if stack else None
    parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    parser.Parse(source.encode(), True)
    return top[0]


@dataclass(frozen=True)
class Claim:
    """What a profile says of an element: its type, more metadata, to skip it, to keep it apart from its parent."""

    chunk_type: str = "xml_element"
    metadata: dict[str, str] = field(default_factory=dict)
    skip: bool = False
    own_chunk: bool = False


Profile = Callable[[str, dict[str, str]], Claim | None]


def local(tag: str) -> str:
    return tag.rsplit(":", 1)[-1]


def xml(source: str, context: Context, profiles: tuple[Profile, ...] = ()) -> list[Chunk]:
    """One chunk if the element fits and no child must be apart, else its children's; a leaf is given as it is."""
    if not source.strip():
        return []
    root = parsed(source)
    out: list[Chunk] = []
    used: Counter[str] = Counter()

    def claim(node: Element) -> Claim:
        return next((c for p in profiles if (c := p(node.tag, node.attributes))), Claim())

    def visit(node: Element, path: list[str]) -> None:
        path = [*path, local(node.tag)]
        own = claim(node)
        if own.skip:
            return
        children = node.children
        whole = node.text()
        head = f"tag_path: {'/'.join(path)}" if len(path) > 1 else ""
        if children and (any(claim(c).own_chunk for c in children) or not context.fits(f"{head}\n{whole}" if head else whole)):
            for child in children:
                visit(child, path)
            return
        name = next((node.attributes[a] for a in ID_ATTRIBUTES if node.attributes.get(a, "").strip()), "/".join(path))
        spaces = ",".join(f"{k.partition(':')[2]}={v}" for k, v in node.attributes.items() if k.split(":")[0] == "xmlns")
        meta = {"root_tag": root.tag, "element_tag": node.tag, "tag_path": "/".join(path), "depth": str(len(path) - 1), "child_count": str(len(children)), "namespaces": spaces, "id_attr": node.attributes.get("id", ""), "name_attr": node.attributes.get("name", "")}
        out.append(Chunk(own.chunk_type, name, whole, node.line, max(node.line, node.last), used[name], head, meta | own.metadata))
        used[name] += 1

    visit(root, [])
    return out

"""What chunkers share: the chunk, the size limit, and splitting by it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field


def heuristic_tokens(text: str) -> int:
    """A fourth of the characters, at least one; none for an empty text."""
    return max(1, len(text) // 4) if text else 0


@dataclass(frozen=True)
class Chunk:
    chunk_type: str
    identity: str
    source_text: str
    line_start: int
    line_end: int
    sub_ordinal: int = 0
    header: str = ""
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.identity.strip():
            raise ValueError("a chunk needs an identity")

    @property
    def embedding_text(self) -> str:
        return f"{self.header}\n{self.source_text}" if self.header else self.source_text


@dataclass(frozen=True)
class Context:
    file_path: str
    slug: str = "demo"
    max_tokens: int = 8192
    count: Callable[[str], int] = heuristic_tokens

    def fits(self, text: str) -> bool:
        return self.count(text) <= self.max_tokens


def joined(lines: list[str], first: int, last: int) -> str:
    """Lines first to last, from 1, inclusive."""
    return "\n".join(lines[first - 1 : last])


def within_limit(chunk: Chunk, context: Context) -> list[Chunk]:
    """The chunk, or pieces of whole lines whose composed text fits; a line that doesn't is cut by characters."""
    if context.fits(chunk.embedding_text):
        return [chunk]
    fits = lambda text: context.fits(f"{chunk.header}\n{text}" if chunk.header else text)
    pieces: list[tuple[str, int, int]] = []
    held: list[str] = []
    start = chunk.line_start
    for k, line in enumerate(chunk.source_text.split("\n")):
        at = min(chunk.line_start + k, chunk.line_end)
        if held and not fits("\n".join([*held, line])):
            pieces.append(("\n".join(held), start, max(start, at - 1)))
            held = []
        if not held:
            start = at
        if fits(line):
            held.append(line)
            continue
        rest = line
        while rest:
            size = len(rest)
            while size > 1 and not fits(rest[:size]):
                size = (size + 1) // 2
            pieces.append((rest[:size], at, at))
            rest = rest[size:]
    if held:
        pieces.append(("\n".join(held), start, chunk.line_end))
    return [Chunk(chunk.chunk_type, chunk.identity, text, a, b, n, chunk.header, chunk.metadata) for n, (text, a, b) in enumerate(p for p in pieces if p[0].strip())]


def numbered(names: list[str]) -> list[str]:
    """The second and later of equal names get #1, #2, ..."""
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        out.append(f"{name}#{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def line_windows(lines: list[str], size: int, step: int) -> list[tuple[int, int]]:
    """First and last line of windows up to the first that reaches the end."""
    out, start = [], 0
    while lines:
        out.append((start + 1, min(start + size, len(lines))))
        if start + size >= len(lines):
            break
        start += step
    return out


def split_recursively(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs, the rest by the next ones."""
    if len(text) <= size:
        return [text] if text.strip() else []
    separator = next(s for s in separators if s == "" or s in text)
    if separator == "":
        step = max(1, size - overlap)
        return [p for k in range(0, len(text), step) if (p := text[k : k + size]).strip() and (k == 0 or k + overlap < len(text))]
    later = separators[separators.index(separator) + 1 :]
    parts = text.split(separator)
    parts = [p + separator for p in parts[:-1]] + parts[-1:]
    out: list[str] = []
    held = ""
    for part in parts:
        if len(held) + len(part) > size and held:
            out.append(held)
            tail = held[-overlap:] if overlap else ""
            held = tail if len(tail) + len(part) <= size else ""
        if len(part) > size:
            out += split_recursively(part, size, overlap, later)
            held = ""
        else:
            held += part
    if held:
        out.append(held)
    return [p.strip("\n") for p in out if p.strip()]


def place(text: str, piece: str, since: int) -> tuple[int, int, int]:
    """Lines of a piece's first and last character, and the offset to look on from; (1, 1) if it isn't there."""
    at = text.find(piece, since)
    if at < 0:
        return 1, 1, since
    last = at + len(piece) - 1  # a line feed belongs to the line that it ends
    return text.count("\n", 0, at) + 1, text.count("\n", 0, last) + 1, last + 1

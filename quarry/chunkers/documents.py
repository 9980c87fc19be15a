"""Markdown, plain text and style sheets."""

from __future__ import annotations

import re

from quarry.chunkers.base import Chunk, Context, heuristic_tokens, joined, line_windows, numbered, place, split_recursively

MAX_CHARS, OVERLAP, DEPTH = 4000, 200, 4
CSS_SIZE, CSS_OVERLAP, CSS_AVERAGE = 200, 40, 200
_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")


def sections(text: str) -> list[tuple[list[str], list[str], int]]:
    """(heading path, body lines, first line of the body); headings in fences don't count, empty bodies are left out."""
    out: list[tuple[list[str], list[str], int]] = []
    path: list[str] = []
    body: list[str] = []
    first, fence = 1, ""
    for n, line in enumerate(text.splitlines(), 1):
        mark = _FENCE.match(line)
        if mark:
            fence = mark[1] if not fence else "" if mark[1] == fence else fence
        heading = None if fence or mark else _HEADING.match(line)
        if heading and len(heading[1]) <= DEPTH:
            out.append((path, body, first))
            path = [*path[: len(heading[1]) - 1], heading[2]]
            body, first = [], n + 1
        else:
            body.append(line)
    out.append((path, body, first))
    return [s for s in out if any(line.strip() for line in s[1])]


def segments(body: str) -> list[str]:
    """Fences and what lies between them."""
    out: list[str] = []
    held: list[str] = []
    fence = ""
    for line in body.split("\n"):
        mark = _FENCE.match(line)
        if mark and not fence:
            out.append("\n".join(held))
            held, fence = [line], mark[1]
        elif mark and mark[1] == fence:
            out.append("\n".join([*held, line]))
            held, fence = [], ""
        else:
            held.append(line)
    return [s.strip("\n") for s in [*out, "\n".join(held)] if s.strip()]


def sized(body: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters; fences that fit stay whole; neighbours that fit together are joined."""
    pieces: list[str] = []
    for part in segments(body):
        pieces += [part] if len(part) <= size else split_recursively(part, size, overlap)
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + 2 + len(p) <= size:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def markdown(text: str, context: Context) -> list[Chunk]:
    found = sections(text)
    names = numbered([" > ".join(path) or "(preamble)" for path, _, _ in found])
    out = []
    for name, (path, body, first) in zip(names, found, strict=True):
        header = f"File: {context.file_path}" + (f"\nSection: {' > '.join(path)}" if path else "")
        whole = "\n".join(body).strip("\n")
        size, pieces = MAX_CHARS, sized(whole, MAX_CHARS, OVERLAP)
        while size > 1 and any(not context.fits(f"{header}\n{p}") for p in pieces):
            size //= 2
            pieces = sized(whole, size, 0)
        for n, piece in enumerate(pieces):
            lead = next(line for line in piece.split("\n") if line.strip())
            at = next((k for k, line in enumerate(body) if lead in line), 0)
            last = min(first + at + piece.count("\n"), first + len(body) - 1)
            out.append(Chunk("markdown_section", name, piece, first + at, last, n, header, {"heading_path": " > ".join(path), "token_count": str(heuristic_tokens(piece))}))
    return out


def text(source: str, context: Context) -> list[Chunk]:
    pieces: list[str] = []
    pending = split_recursively(source, max(1, context.max_tokens * 4))[::-1]
    while pending:
        p = pending.pop()
        if len(p) > 1 and not context.fits(p):
            pending += [p[len(p) // 2 :], p[: len(p) // 2]]
        elif p.strip():
            pieces.append(p)
    out, since = [], 0
    for n, p in enumerate(pieces):
        first, last, since = place(source, p, since)
        out.append(Chunk("text", f"window#{n}", p, first, last, n))
    return out


def stylesheet(source: str, context: Context) -> list[Chunk]:
    """Windows of 200 lines, 160 on; one that was shrunk to fit is followed by one that begins where it ends."""
    lines = source.splitlines()
    if context.file_path.endswith(".min.css") or sum(map(len, lines)) > CSS_AVERAGE * max(1, len(lines)):
        return []
    out: list[Chunk] = []
    start = 0
    while start < len(lines):
        end = min(start + CSS_SIZE, len(lines))
        whole = end
        while end > start and not context.fits(joined(lines, start + 1, end)):
            end -= 1
        if end == start:
            start += 1
            continue
        if joined(lines, start + 1, end).strip():
            out.append(Chunk("stylesheet", f"window#{len(out)}", joined(lines, start + 1, end), start + 1, end))
        if end >= len(lines):
            break
        start = end if end < whole else start + CSS_SIZE - CSS_OVERLAP
    return out


def windows(source: str, context: Context, size: int = 200, step: int = 180) -> list[Chunk]:
    lines = source.splitlines()
    return [Chunk("python_window", f"window#{n}", joined(lines, a, b), a, b, 0, f"File: {context.file_path}") for n, (a, b) in enumerate(line_windows(lines, size, step))]

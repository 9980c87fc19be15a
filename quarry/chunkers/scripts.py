"""SQL statements and JavaScript units."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import PurePosixPath

from quarry.chunkers.base import Chunk, Context, joined

_SQL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|(\$\w*\$)(?s:.*?)\1|--[^\n]*|/\*(?s:.*?)\*/|[A-Za-z_][\w$]*|\d[\w.]*|\s+|(?s:.)")


def tokens(source: str) -> list[tuple[str, int]]:
    """(token, offset); strings, dollar quotes and comments are one token each."""
    return [(m[0], m.start()) for m in _SQL.finditer(source)]


def is_comment(token: str) -> bool:
    return token.startswith(("--", "/*"))


def without_meta_lines(source: str) -> str:
    """Lines of the interactive client (that begin with a backslash) are blanked; lines keep their numbers."""
    return "\n".join("" if line.lstrip().startswith("\\") else line for line in source.split("\n"))


def statements(source: str) -> list[tuple[list[tuple[str, int]], int, int]]:
    """(tokens, start, end) of statements that end at a semicolon that is a token of its own, or with the text."""
    out, held, start = [], [], 0
    for token, at in tokens(source):
        if token == ";":
            out.append((held, start, at))
            held, start = [], at + 1
        else:
            held.append((token, at))
    out.append((held, start, len(source)))
    return [s for s in out if any(not t.isspace() and not is_comment(t) for t, _ in s[0])]


def words(statement: list[tuple[str, int]]) -> list[str]:
    return [t for t, _ in statement if not t.isspace() and not is_comment(t)]


def name_at(ws: list[str], k: int) -> tuple[str, int]:
    """A dotted name from position k, unquoted, and the position after it."""
    name = ws[k].strip('"')
    while k + 2 < len(ws) and ws[k + 1] == ".":
        name += "." + ws[k + 2].strip('"')
        k += 2
    return name, k + 1


#: Words that begin a statement, and words that a table's name can't be.
STARTS = {"select", "with", "insert", "update", "delete", "create", "alter", "drop", "do", "grant", "revoke", "set", "comment", "truncate", "begin", "commit", "explain", "values", "merge", "analyze", "vacuum", "copy", "call", "refresh", "reindex"}
NOT_NAMES = {"select", "lateral", "only", "unnest", "values", "set", "where", "if", "not", "exists"}
OBJECTS = {"table", "view", "index", "function", "procedure", "type", "schema", "sequence", "trigger", "materialized", "extension", "database", "policy", "role"}


def ctes(ws: list[str]) -> list[str]:
    low = [w.lower() for w in ws]
    if not low or low[0] != "with":
        return []
    out, depth = [], 0
    for k, w in enumerate(low):
        depth += (w == "(") - (w == ")")
        if depth == 0 and w == "as" and k + 1 < len(low) and low[k + 1] in ("(", "materialized", "not"):
            j, d = k - 1, 0
            while j > 0 and (d > 0 or low[j] == ")"):  # a list of columns before AS
                d += (low[j] == ")") - (low[j] == "(")
                j -= 1
            out.append(ws[j].strip('"'))
    return out


#: Words that follow a list of tables and are no alias.
ENDS_LIST = "where join inner left right full cross natural on using group order having limit offset union intersect except window fetch for returning set".split()


def tables(ws: list[str]) -> set[str]:
    low, out = [w.lower() for w in ws], set()
    for k, w in enumerate(low[:-1]):
        if w in ("from", "join", "into", "update", "table", "truncate"):
            j = k + 1
            while j < len(low) and low[j] in ("only", "if", "not", "exists", "table"):
                j += 1
            while j < len(ws) and re.match(r'[A-Za-z_"]', ws[j]) and low[j] not in NOT_NAMES:
                name, after = name_at(ws, j)
                if not (after < len(ws) and ws[after] == "(" and w in ("from", "join")):
                    out.add(name)
                after += after < len(ws) and low[after] == "as"
                after += after < len(ws) and bool(re.match(r'[A-Za-z_"]', ws[after])) and low[after] not in ENDS_LIST
                j = after + 1 if w == "from" and after < len(ws) and ws[after] == "," else len(ws)  # the next of a list
    if low[:1] == ["create"] and "index" in low and "on" in low:
        out.add(name_at(ws, low.index("on") + 1)[0])
    return out


def created(ws: list[str]) -> str:
    low = [w.lower() for w in ws]
    if low[:1] != ["create"]:
        return ""
    k = next((k for k, w in enumerate(low) if w in OBJECTS and w != "materialized"), None)
    if k is None:
        return ""
    k += 1
    while k < len(low) and low[k] in ("if", "not", "exists", "concurrently"):
        k += 1
    return name_at(ws, k)[0] if k < len(ws) and re.match(r'[A-Za-z_"]', ws[k]) and low[k] != "on" else ""


def balanced(ws: list[str]) -> bool:
    depth = 0
    for w in ws:
        depth += (w == "(") - (w == ")")
        if depth < 0:
            return False
    return depth == 0


def sql(source: str, context: Context) -> list[Chunk]:
    """A chunk for each statement; those that can't be one (unknown start, unbalanced) are skipped, unnumbered."""
    source = without_meta_lines(source)
    out: list[Chunk] = []
    n = 0
    for statement, start, end in statements(source):
        ws = words(statement)
        if ws[0].lower() not in STARTS or not balanced(ws):
            continue
        n += 1
        own = ctes(ws)
        comment = next((t for t, _ in statement if not t.isspace()), "")
        low = [w.lower() for w in ws]
        raw = source[start:end]
        first = source.count("\n", 0, start + len(raw) - len(raw.lstrip())) + 1
        text = raw.strip()
        name = created(ws)
        meta = {
            "statement_type": low[0], "referenced_tables": ",".join(sorted(tables(ws) - set(own))), "cte_names": ",".join(own), "created_object": name,
            "has_window_funcs": str("over" in low and any(low[k + 1 : k + 2] == ["("] for k, w in enumerate(low) if w == "over")).lower(),
            "leading_comment": re.sub(r"^--\s*|^/\*\s*|\s*\*/$", "", comment).strip() if is_comment(comment) else "", "dialect": "postgres",
        }
        chunk = Chunk("sql_statement", name or f"stmt#{n}", text, first, first + text.count("\n"), 0, "", meta)
        out += [chunk] if context.fits(text) or not own else parts_of(chunk, own, meta)
    return out


def parts_of(chunk: Chunk, own: list[str], meta: dict[str, str]) -> list[Chunk]:
    """One piece for each common table expression, numbered from 1, and the body."""
    pieces, depth, since, text = [], 0, 0, chunk.source_text
    for token, at in tokens(text):
        depth += (token == "(") - (token == ")")
        if depth == 0 and len(pieces) < len(own) and token == ")" and re.search(r"\bas\b", text[since:at], re.I):
            pieces.append(text[since : at + 1].lstrip(", \n"))
            since = at + 1
    pieces.append(text[since:].lstrip(", \n"))
    out = []
    for k, piece in enumerate(p for p in pieces if p.strip()):
        at = chunk.line_start + text.count("\n", 0, max(0, text.find(piece)))
        out.append(Chunk("sql_statement", chunk.identity, piece, at, at + piece.count("\n"), k + 1, f"Statement: {chunk.identity}", meta))
    return out


JS_SIZE, JS_AVERAGE = 200, 800
_UNITS = (
    ("js_function", re.compile(r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b\s*\*?\s*(\w*)")),
    ("js_class", re.compile(r"(?:export\s+(?:default\s+)?)?class\b\s*(\w*)")),
    ("js_module", re.compile(r"export\s+(?:const|let|var)\s+(\w+)")),
    ("js_module", re.compile(r"export\s+default\b()")),
)


def unit_end(lines: list[str], start: int, braces: bool) -> int:
    """The line of the brace that closes the first one opened; else the first with a semicolon; else the last."""
    depth, opened = 0, False
    for k in range(start, len(lines)):
        if braces:
            for c in lines[k]:
                depth += (c == "{") - (c == "}")
                opened = opened or c == "{"
                if opened and depth <= 0:
                    return k
        if not opened and ";" in lines[k]:
            return k
    return len(lines) - 1


def javascript(source: str, context: Context) -> list[Chunk]:
    lines = source.splitlines()
    if not source.strip() or context.file_path.endswith(".min.js") or sum(map(len, lines)) > JS_AVERAGE * len(lines):
        return []
    units: list[tuple[str, str, int, int]] = []
    gap, k = 0, 0
    stem = PurePosixPath(context.file_path).stem

    def close(upto: int) -> None:
        for a in range(gap, upto, JS_SIZE):
            b = min(a + JS_SIZE, upto)
            if joined(lines, a + 1, b).strip():
                units.append(("window", "", a, b - 1))

    while k < len(lines):
        found = next(((kind, m) for kind, p in _UNITS if (m := p.match(lines[k].lstrip()))), None)
        if found is None:
            k += 1
            continue
        close(k)
        end = unit_end(lines, k, True)
        units.append((found[0], found[1][1] or stem, k, end))
        gap = k = end + 1
    close(len(lines))
    out: list[Chunk] = []
    used: Counter[tuple[str, str]] = Counter()
    n_windows = 0
    for kind, name, a, b in units:
        if kind == "window":
            name, n_windows = f"window#{n_windows}", n_windows + 1
        start = a
        while start <= b:
            end = b
            if not context.fits(joined(lines, start + 1, end + 1)):
                end = min(b, start + JS_SIZE - 1)
                while end > start and not context.fits(joined(lines, start + 1, end + 1)):
                    end -= 1
            text = joined(lines, start + 1, end + 1)
            if text.strip():
                out.append(Chunk(kind, name, text, start + 1, end + 1, used[(kind, name)]))
                used[(kind, name)] += 1
            start = end + 1
    return out

"""Python files: chunks from the syntax tree, and the raw references that joins resolve."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from quarry.chunkers.base import Chunk, Context, joined, numbered, within_limit
from quarry.chunkers.documents import windows

Function = ast.FunctionDef | ast.AsyncFunctionDef


def dotted(node: ast.expr) -> str | None:
    """a or a.b; of longer chains the last name; of calls what is called."""
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{node.value.id}.{node.attr}" if isinstance(node.value, ast.Name) else node.attr
    return None


def methods(body: list[ast.stmt]) -> Iterator[Function]:
    """Functions of a class body, also below if, try and with; not those of nested classes."""
    for node in body:
        if isinstance(node, Function):
            yield node
        elif isinstance(node, ast.If):
            yield from methods([*node.body, *node.orelse])
        elif isinstance(node, ast.Try | ast.TryStar):
            yield from methods([*node.body, *(s for h in node.handlers for s in h.body), *node.orelse, *node.finalbody])
        elif isinstance(node, ast.With | ast.AsyncWith):
            yield from methods(node.body)


def first_line(node: Function | ast.ClassDef) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def header(context: Context, owner: str = "", kind: str = "", name: str = "") -> str:
    return "\n".join([f"File: {context.file_path}", *([f"Class: {owner}"] if owner else []), *([f"{kind}: {name}"] if name else [])])


def metadata(owner: str = "", method: str = "", inherits: list[str] | None = None, decorators: list[str] | None = None) -> dict[str, str]:
    return {"class_name": owner, "method_name": method, "inherits": ",".join(inherits or []), "decorators": ",".join(decorators or [])}


def chunks(source: str, context: Context) -> list[Chunk]:
    if not source.strip():
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [piece for c in windows(source, context) for piece in within_limit(c, context)]
    lines = source.splitlines()
    out: list[Chunk] = []
    imports = [n for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    if imports:
        a, b = imports[0].lineno, max(n.end_lineno or n.lineno for n in imports)
        out.append(Chunk("imports", "imports", joined(lines, a, b), a, b, 0, header(context), metadata()))
    named: list[tuple[str, str, int, int, str, dict[str, str]]] = []
    for node in sorted((n for n in tree.body if isinstance(n, Function | ast.ClassDef)), key=first_line):
        marks = [d for d in map(dotted, node.decorator_list) if d]
        if isinstance(node, Function):
            named.append(("function", node.name, first_line(node), node.end_lineno or node.lineno, header(context, "", "Function", node.name), metadata("", node.name, [], marks)))
            continue
        own = sorted(methods(node.body), key=lambda m: m.lineno)
        last = min([(node.end_lineno or node.lineno) + 1, *map(first_line, own)]) - 1
        while last > node.lineno and not lines[last - 1].strip():
            last -= 1
        bases = [b.id for b in node.bases if isinstance(b, ast.Name)]
        named.append(("class", node.name, node.lineno, max(last, node.lineno), header(context, node.name), metadata(node.name, "", bases, marks)))
        for m in own:
            marks = [d for d in map(dotted, m.decorator_list) if d]
            named.append(("method", f"{node.name}.{m.name}", first_line(m), m.end_lineno or m.lineno, header(context, node.name, "Method", m.name), metadata(node.name, m.name, [], marks)))
    names: dict[str, list[str]] = {k: numbered([n[1] for n in named if n[0] == k]) for k in ("class", "method", "function")}
    used = dict.fromkeys(names, 0)
    for kind, _, a, b, head, meta in named:
        out.append(Chunk(kind, names[kind][used[kind]], joined(lines, a, b), a, b, 0, head, meta))
        used[kind] += 1
    return [piece for c in out for piece in within_limit(c, context)]


def absolute(module: str, is_package: bool, node: ast.ImportFrom) -> str | None:
    """The module that a from-import names; None if it leads above the top."""
    if not node.level:
        return node.module or ""
    parts = module.split(".") if is_package else module.split(".")[:-1]
    keep = len(parts) - (node.level - 1)
    if keep < 0 or (keep == 0 and not node.module):
        return None
    return ".".join([*parts[:keep], *([node.module] if node.module else [])])


def raw_references(source: str, module: str, is_package: bool = False) -> list[tuple[str, str, str, str]]:
    """(source name, kind, how, target): what a file refers to, as written and by its own imports and definitions.

    how: ``module`` (an imported module), ``symbol`` (module and name of a from-import), ``name`` (a full name that
    imports, definitions or self lead to), ``bare`` (only the last name is known).
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, str, str]] = []
    alias: dict[str, str] = {}
    for node in tree.body:
        if isinstance(node, ast.Import):
            for n in node.names:
                alias[n.asname or n.name.split(".")[0]] = n.name if n.asname else n.name.split(".")[0]
                out.append((module, "imports", "module", n.name))
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            base = absolute(module, is_package, node)
            for n in node.names:
                if base is None:
                    out.append((module, "imports", "bare", "." * node.level + ".".join(filter(None, [node.module, n.name]))))
                elif n.name == "*":
                    out.append((module, "imports", "module", base))
                else:
                    alias[n.asname or n.name] = f"{base}.{n.name}"
                    out.append((module, "imports", "symbol", f"{base}.{n.name}"))
    local = {n.name: f"{module}.{n.name}" for n in tree.body if isinstance(n, Function | ast.ClassDef)}
    classes = {n.name: {m.name for m in methods(n.body)} for n in tree.body if isinstance(n, ast.ClassDef)}

    def target(node: ast.expr, owner: str, types: dict[str, str]) -> tuple[str, str]:
        if isinstance(node, ast.Name):
            full = local.get(node.id) or alias.get(node.id)
            return ("name", full) if full else ("bare", node.id)
        if isinstance(node, ast.Attribute):
            value = node.value
            if isinstance(value, ast.Name) and value.id in ("self", "cls") and owner:
                return ("method" if node.attr not in classes[owner] else "name"), f"{module}.{owner}.{node.attr}"
            if isinstance(value, ast.Name) and value.id in types:
                return "method", f"{types[value.id]}.{node.attr}"
            how, full = target(value, owner, types)
            return ("name", f"{full}.{node.attr}") if how == "name" else ("bare", node.attr)
        if isinstance(node, ast.Call):
            how, full = target(node.func, owner, types)
            return "bare", full.rsplit(".", 1)[-1]
        return "bare", ast.unparse(node)

    def calls(node: Function, name: str, owner: str) -> None:
        types: dict[str, str] = {}
        for n in ast.walk(node):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                how, full = target(n.value.func, owner, {})
                if how == "name":
                    types[n.targets[0].id] = full
        seen = set()
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                found = target(n.func, owner, types)
                if found not in seen:
                    seen.add(found)
                    out.append((name, "calls", *found))

    for node in tree.body:
        if isinstance(node, Function):
            calls(node, f"{module}.{node.name}", "")
        elif isinstance(node, ast.ClassDef):
            for b in node.bases:
                out.append((f"{module}.{node.name}", "inherits", *target(b, "", {})))
            for m in methods(node.body):
                calls(m, f"{module}.{node.name}.{m.name}", node.name)
    return out

"""Entities of a Python file from its syntax tree. A file that does not parse gives none."""

from __future__ import annotations

import ast

from weftgraph.parse.records import Records


def _base(node: ast.AST) -> str | None:
    """A base class written as a name or a dotted name; subscripts and calls name no class."""
    return node.id if isinstance(node, ast.Name) else ast.unparse(node) if isinstance(node, ast.Attribute) else None


def _mark(node: ast.AST) -> str | None:
    """The last name of a decorator, called or not."""
    node = node.func if isinstance(node, ast.Call) else node
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


_BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.Assert, ast.comprehension)


def _complexity(node: ast.AST) -> int:
    """1 + branches + further operands of and/or, nested bodies included."""
    inner = [n for n in ast.walk(node) if n is not node]
    return 1 + sum(isinstance(n, _BRANCHES) for n in inner) + sum(len(n.values) - 1 for n in inner if isinstance(n, ast.BoolOp))


def parse(path: str, source: str) -> Records:
    out = Records(path)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    _walk(out, tree.body, None, None)
    return out


def _walk(out: Records, body: list[ast.stmt], owner: str | None, function: str | None) -> None:
    """``owner`` is the id of the innermost class, ``function`` of the function that the statements belong to."""
    for node in body:
        _visit(out, node, owner, function)


def _visit(out: Records, node: ast.AST, owner: str | None, function: str | None) -> None:
    if isinstance(node, ast.Import):
        for a in node.names:
            out.imported(f"import:{a.name}", a.asname or a.name, a.name, True, [])
    elif isinstance(node, ast.ImportFrom):
        base = node.module or ""
        for a in node.names:
            out.imported(f"import:{base}:{a.name}" if base else f"import:{a.name}", a.asname or a.name, f"{base}.{a.name}" if base else a.name, True, [a.name])
    elif isinstance(node, ast.ClassDef):
        _class(out, node, function)
    elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
        _function(out, node, owner)
    else:
        if function is None and isinstance(node, ast.Assign | ast.AnnAssign):
            _variables(out, node, owner)
        if function is not None:
            _usage(out, node, function)
        for child in ast.iter_child_nodes(node):
            _visit(out, child, owner, function)


def _usage(out: Records, node: ast.AST, function: str) -> None:
    if isinstance(node, ast.Call):
        target = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if target:
            out.call(function, target, node.lineno)
            if target[:1].isupper() and not target.isupper():
                out.detect(function, target, "INSTANTIATES", 0.85, "AST_instantiation", node.lineno)
            else:
                out.detect(function, target, "CALLS", 0.85, "AST_call", node.lineno)
    elif isinstance(node, ast.Name) and node.id[:1].isupper():
        out.use(function, node.id)


def _class(out: Records, node: ast.ClassDef, function: str | None) -> None:
    bases = [b for b in map(_base, node.bases) if b]
    marks = [d for d in map(_mark, node.decorator_list) if d]
    cid = out.klass(
        node.name, node.name, ast.get_docstring(node), node.lineno, node.end_lineno, any(b.split(".")[-1] == "ABC" for b in bases) or "abstractmethod" in marks, marks, bases, [], "class"
    )
    for b in bases:
        out.detect(node.name, b, "EXTENDS", 0.95, "AST_inheritance", node.lineno)
    _walk(out, node.body, cid, function)


def _function(out: Records, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> None:
    a = node.args
    blank = len(a.args) - len(a.defaults)
    params = [{"name": p.arg, "type": _text(p.annotation), "default": _text(a.defaults[i - blank]) if i >= blank else None} for i, p in enumerate(a.args)]
    shown = ", ".join(p["name"] + (f": {p['type']}" if p["type"] else "") + (f" = {p['default']}" if p["default"] else "") for p in params)
    returns = _text(node.returns)
    marks = [d for d in map(_mark, node.decorator_list) if d]
    fid = out.function(
        node.name, owner, f"({shown})" + (f" -> {returns}" if returns else ""), ast.get_docstring(node), node.lineno, node.end_lineno,
        is_async=isinstance(node, ast.AsyncFunctionDef), is_static="staticmethod" in marks, returns=returns, complexity=_complexity(node), params=params, visibility=_visibility(node.name),
    )
    for child in ast.iter_child_nodes(node):
        _visit(out, child, owner, fid)


def _variables(out: Records, node: ast.Assign | ast.AnnAssign, owner: str | None) -> None:
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    for t in targets:
        if isinstance(t, ast.Name):
            out.variable(t.id, owner, _text(node.annotation) if isinstance(node, ast.AnnAssign) else None, "class" if owner else "global", t.id.isupper())

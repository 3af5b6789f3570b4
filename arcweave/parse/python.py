"""Python symbols by way of the standard ``ast`` module."""

from __future__ import annotations

import ast
from collections.abc import Iterator


def _calls(node: ast.AST) -> list[str]:
    """Callee texts in the whole subtree, nested functions included, sorted and distinct."""
    return sorted({ast.unparse(x.func) for x in ast.walk(node) if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute))})


def _visibility(name: str) -> str:
    dunder = name.startswith("__") and name.endswith("__")
    return "public" if dunder or not name.startswith("_") else "private" if name.startswith("__") else "protected"


def parse_python(file: str, text: str) -> Iterator[dict]:
    """Functions, methods, classes, imports and assignments outside classes. Only functions and methods carry references."""
    tree = ast.parse(text)
    lines = text.encode().split(b"\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def place(x: ast.AST) -> dict:
        return {"file": file, "line_start": x.lineno, "line_end": x.end_lineno, "column": x.col_offset, "byte_start": starts[x.lineno - 1] + x.col_offset, "byte_end": starts[x.end_lineno - 1] + x.end_col_offset}

    todo: list[tuple[ast.AST, str | None, bool]] = [(x, None, False) for x in tree.body]
    out = []
    while todo:
        x, owner, in_method = todo.pop()
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            decorators = {d.id for d in x.decorator_list if isinstance(d, ast.Name)}
            head = f"{'async ' * isinstance(x, ast.AsyncFunctionDef)}def {x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else "")
            visibility = _visibility(x.name)
            out.append(place(x) | {"name": x.name, "qualified_name": f"{owner}.{x.name}" if owner else x.name, "kind": "method" if owner else "function", "signature": head, "docstring": ast.get_docstring(x), "visibility": visibility, "is_async": isinstance(x, ast.AsyncFunctionDef), "is_static": bool(decorators & {"staticmethod", "classmethod"}), "is_exported": visibility == "public", "references": _calls(x)})
            todo += [(y, None, bool(owner) or in_method) for y in x.body]
        elif isinstance(x, ast.ClassDef):
            bases = ", ".join(map(ast.unparse, x.bases))
            visibility = _visibility(x.name)
            out.append(place(x) | {"name": x.name, "qualified_name": x.name, "kind": "class", "signature": f"class {x.name}({bases})" if bases else f"class {x.name}", "docstring": ast.get_docstring(x), "visibility": visibility, "is_exported": visibility == "public"})
            todo += [(y, x.name, False) for y in x.body]
        elif isinstance(x, ast.Import):
            out += [place(x) | {"name": a.name, "qualified_name": a.name, "kind": "import"} for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            module = "." * x.level + (x.module or "")
            out.append(place(x) | {"name": module, "qualified_name": module, "kind": "import", "references": [a.asname or a.name for a in x.names if a.name != "*"]})
        elif isinstance(x, (ast.Assign, ast.AnnAssign)) and owner is None and not in_method:
            for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                if isinstance(t, ast.Name):
                    constant = t.id == t.id.upper() and any(c.isalpha() for c in t.id)
                    out.append(place(x) | {"name": t.id, "qualified_name": t.id, "kind": "constant" if constant else "variable", "visibility": _visibility(t.id)})
        else:
            todo += [(y, owner, in_method) for y in ast.iter_child_nodes(x) if isinstance(y, ast.stmt)]
    yield from sorted(out, key=lambda r: (r["byte_start"], r["qualified_name"]))

"""Symbols, references and imports of Python files, by the standard library's parser."""

from __future__ import annotations

import ast

from .model import Extraction, module_name


def _text(content: str, node: ast.AST) -> str:
    return ast.get_source_segment(content, node) or ""


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return None


class _Visitor(ast.NodeVisitor):
    """``scope`` is the innermost symbol; ``owner`` what calls are attributed to."""

    def __init__(self, content: str, out: Extraction, namespace: str):
        self.content, self.out = content, out
        self.namespace = self.scope = self.owner = namespace
        self.in_class = False

    def _inside(self, uri: str, in_class: bool, nodes: list[ast.AST]) -> None:
        held = self.scope, self.owner, self.in_class
        self.scope, self.owner, self.in_class = uri, uri, in_class
        for n in nodes:
            self.visit(n)
        self.scope, self.owner, self.in_class = held

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        uri = self.out.symbol("callable", node.name, node.lineno, node.end_lineno, _text(self.content, node), ast.get_docstring(node), f"({ast.unparse(node.args)}){returns}", self.scope, self.in_class)
        for d in node.decorator_list:
            self.visit(d)
        self._inside(uri, False, node.body)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        uri = self.out.symbol("container", node.name, node.lineno, node.end_lineno, _text(self.content, node), ast.get_docstring(node), None, self.scope, self.in_class)
        for base in node.bases:
            if name := _dotted(base):
                self.out.reference(uri, name, node.lineno, "inherits")
        self._inside(uri, True, node.body)

    def _value(self, node: ast.Assign | ast.AnnAssign) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        if self.in_class or self.scope == self.namespace:
            for t in targets:
                if isinstance(t, ast.Name):
                    self.out.symbol("value", t.id, node.lineno, node.end_lineno, _text(self.content, node), None, None, self.scope, self.in_class)
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = _value

    def visit_Call(self, node: ast.Call) -> None:
        if name := _dotted(node.func):
            self.out.reference(self.owner, name, node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out.import_(a.name, a.asname, node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        for a in node.names:
            self.out.import_(base if a.name == "*" else f"{base}.{a.name}" if node.module else f"{base}{a.name}", a.asname or (None if a.name == "*" else a.name), node.lineno)


def parse(repo: str, path: str, content: str) -> Extraction:
    tree = ast.parse(content)
    out = Extraction(repo, path)
    namespace = out.symbol("namespace", module_name(path), 1, content.count("\n") + 1, "", ast.get_docstring(tree))
    visitor = _Visitor(content, out, namespace)
    for node in tree.body:
        visitor.visit(node)
    return out

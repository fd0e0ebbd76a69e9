"""What an adapter yields for one file, and the registry that picks adapters by extension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def address(repo: str, path: str, kind: str, name: str, line: int) -> str:
    return f"codescope://{repo}/{path}#{kind}:{name}@{line}"


@dataclass
class Extraction:
    repo: str
    path: str
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)

    def symbol(self, kind: str, name: str, start: int, end: int, content: str = "", doc: str | None = None, signature: str | None = None, inside: str | None = None, contains: bool = False) -> str:
        uri = address(self.repo, self.path, kind, name, start)
        self.symbols.append({"uri": uri, "kind": kind, "name": name, "path": self.path, "line_start": start, "line_end": end, "doc": doc, "signature": signature, "content": content})
        if inside is not None:
            self.edges.append({"from_uri": inside, "to_uri": uri, "kind": "contains" if contains else "defines", "confidence": 1.0, "resolution_mode": "static"})
        return uri

    def reference(self, from_uri: str, text: str, line: int, kind: str = "call") -> None:
        """``text`` may be dotted: what stands before the last dot is the receiver."""
        receiver, dot, name = text.rpartition(".")
        self.references.append({"from_uri": from_uri, "name": name, "receiver": receiver if dot else None, "scope_id": 0, "file_path": self.path, "line": line, "ref_kind": kind, "is_external": False})

    def import_(self, namespace: str, alias: str | None, line: int) -> None:
        self.imports.append({"file_path": self.path, "alias": alias, "target_namespace": namespace, "line": line})


def module_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".py")


Adapter = Callable[[str, str, str], Extraction]


class Registry:
    """Adapters in order of registration; the first that lists an extension gets the file."""

    def __init__(self):
        self.adapters: list[tuple[str, tuple[str, ...], Adapter]] = []

    def register(self, language: str, extensions: tuple[str, ...], adapter: Adapter) -> None:
        self.adapters.append((language, extensions, adapter))

    def find(self, path: str) -> Adapter | None:
        ext = path.rsplit("/", 1)[-1].rpartition(".")[2]
        return next((a for _, extensions, a in self.adapters if ext in extensions), None)

    def language(self, path: Column) -> Column:
        """The language whose adapter gets a path; null where none does."""
        ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
        return F.coalesce(*[F.when(ending.isin(*extensions), name) for name, extensions, _ in self.adapters], F.lit(None).cast("string"))

    def parse(self, repo: str, path: str, content: str, fallback: Adapter | None = None) -> Extraction | None:
        """None without an adapter; a file its adapter cannot read goes to the fallback."""
        adapter = self.find(path) or fallback
        if adapter is None:
            return None
        try:
            return adapter(repo, path, content)
        except (SyntaxError, ValueError, RecursionError):
            return fallback(repo, path, content) if fallback else None

"""Documents cut into overlapping chunks near paragraph, line or word ends. All sizes are bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, SLACK, LEAST = 1000, 100, 500, 100
# Extensions chunked as documents.
EXTENSIONS = ("yaml", "yml", "json", "toml", "ini", "cfg", "conf", "sql", "sh", "bash", "zsh", "fish", "md", "rst", "txt", "adoc", "tf", "hcl", "dockerfile", "containerfile", "csv", "xml", "env", "properties", "gradle")


def is_document(path: Column) -> Column:
    """Whether a path has one of the extensions chunked as documents, in any case."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


@dataclass
class Chunk:
    content: str
    line_start: int
    line_end: int


def break_point(data: bytes, size: int = SIZE) -> int:
    """Best place to cut near ``size``: after a blank line, a line end or a space, else right there."""
    low, high = max(size - SLACK, 0), min(size + SLACK, len(data))
    for mark in (b"\n\n", b"\n", b" "):
        at = data.rfind(mark, low, high)
        if at >= 0:
            return at + len(mark)
    return boundary(data, min(size, len(data)))


def boundary(data: bytes, at: int) -> int:
    """The start of the character ``at`` is in."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def split(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    size, overlap = max(size, 1), min(max(overlap, 0), max(size // 2, 0))
    if not text.strip():
        return []
    data = text.encode()
    if len(data) <= size:
        return [Chunk(text, 1, text.count("\n") + 1)]
    out: list[Chunk] = []
    line = 1

    def emit(part: bytes) -> None:
        out.append(Chunk(part.decode(errors="replace"), line, line + part.rstrip(b"\n").count(b"\n")))

    held = b""
    for piece in data.splitlines(keepends=True):
        held += piece
        while len(held) >= size:
            cut = break_point(held, size)
            if not overlap < cut < len(held):
                emit(held)
                line += held.count(b"\n")
                held = b""
                break
            emit(held[:cut])
            back = boundary(held, cut - overlap)
            line += held[:back].count(b"\n")
            held = held[back:]
    if len(held) >= LEAST or held and not out:
        emit(held)
    return out


def names(path: str, chunks: list[Chunk]) -> list[str]:
    base = path.rsplit("/", 1)[-1]
    return [base] if len(chunks) == 1 else [f"{base}#chunk_{k + 1}" for k in range(len(chunks))]


def chunk_documents(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(path, name, line_start, line_end, content) of the chunks of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                found = split(content or "", size, overlap)
                rows += [(path, n, c.line_start, c.line_end, c.content) for n, c in zip(names(path, found), found)]
            yield pd.DataFrame(rows, columns=["path", "name", "line_start", "line_end", "content"]).astype({"line_start": "int32", "line_end": "int32"})

    return files.select("path", "content").mapInPandas(run, "path string, name string, line_start int, line_end int, content string")

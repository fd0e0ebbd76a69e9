"""Answers as JSON: full keys, or short keys for compact output."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = {"json": "json", "compact": "compact", "toon": "toon"}


def success(command: str, rows: DataFrame, form: str = "json", limit: int | None = None) -> str:
    """One document with all rows of an answer. With a ``limit`` an answer that has more rows is cut
    and says so (``truncated``, short ``t``); answers for machines belong in a table instead."""
    asked = rows if limit is None else rows.limit(limit + 1)
    data = [json.loads(r["line"]) for r in asked.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator()]
    cut = limit is not None and len(data) > limit
    data = data[:limit] if cut else data
    if form == "json":
        return json.dumps({"format": "json", "command": command, "ok": True, "data": data} | ({"truncated": True} if cut else {}), indent=2)
    return json.dumps({"f": FORMATS[form], "c": command, "o": True, "d": data} | ({"t": True} if cut else {}), separators=(",", ":"))


def error(command: str, message: str, form: str = "json") -> str:
    if form == "json":
        return json.dumps({"format": "json", "command": command, "ok": False, "error": message}, indent=2)
    return json.dumps({"f": FORMATS[form], "c": command, "o": False, "e": message}, separators=(",", ":"))

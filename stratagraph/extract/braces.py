"""Symbols, references and imports of brace languages (JavaScript, Rust, Go).

A lexer blanks comments and strings, keeping every offset; declarations are then found by pattern,
and their extent by brace depth. What a declaration lies inside decides its container.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .model import Extraction, module_name

_SKIP = {
    "js": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|r#\".*?\"#|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.[^']*|[^'\\\n])'", re.S),
}
# Words followed by ( that call nothing.
_NOT_CALLS = {
    "js": frozenset("if for while switch catch return function else await typeof new import super async let const var in of with yield delete void do".split()),
    "rust": frozenset("if for while match loop fn return else await let in impl where struct enum trait use mod move unsafe as".split()),
    "go": frozenset("if for switch return func else select go defer type struct interface import range case var const map chan".split()),
}

_CONTAINERS = {
    "js": re.compile(r"\bclass\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<base>[\w$.]+))?"),
    "rust": re.compile(r"\b(?:struct|enum|trait)\s+(?P<name>\w+)"),
    "go": re.compile(r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)\b"),
}
_CALLABLES = {
    "js": (re.compile(r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?P<sig>\([^)]*\))"), re.compile(r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s+)?(?P<sig>\([^)]*\)|[\w$]+)\s*=>"), re.compile(r"(?:^|[;{}\n])\s*(?:static\s+|async\s+|get\s+|set\s+)*(?P<name>[\w$]+)\s*(?P<sig>\([^)]*\))\s*\{")),
    "rust": (re.compile(r"\bfn\s+(?P<name>\w+)\s*(?:<[^>{]*>)?\s*(?P<sig>\([^{;]*?)(?=\s*[{;])"),),
    "go": (re.compile(r"\bfunc\s+(?:\([^)]*?\*?(?P<owner>\w+)\s*\)\s*)?(?P<name>\w+)\s*(?P<sig>\([^{]*?)(?=\s*\{)"),),
}
_VALUES = {
    "js": re.compile(r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*=(?!\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>)", re.M),
    "rust": re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:", re.M),
    "go": re.compile(r"^(?:const|var)\s+(?P<name>\w+)", re.M),
}
_CALL = re.compile(r"(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*!?\s*\(")


def blank(content: str, language: str) -> str:
    """Comments and strings as spaces; line ends stay."""
    return _SKIP[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


def close(code: str, start: int) -> int:
    """End of the braces that open first at or after ``start``; the line's end where none open before a ``;``."""
    at = re.compile(r"[{;]").search(code, start)
    if at is None or at[0] == ";":
        end = code.find("\n", start)
        return len(code) if end < 0 else end
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at.start()):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _imports(content: str, code: str, language: str, out: Extraction, line_of) -> None:
    if language == "js":
        for m in re.finditer(r"\bimport\s+(?:(?P<what>[^'\"`;]*?)\s+from\s+)?['\"](?P<ns>[^'\"]+)['\"]|\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*require\(\s*['\"](?P<req>[^'\"]+)['\"]", content):
            if m["req"]:
                out.import_(m["req"], m["name"], line_of(m.start()))
                continue
            what = (m["what"] or "").strip()
            named = re.search(r"\{([^}]*)\}", what)
            aliases = [re.split(r"\s+as\s+", p.strip())[-1] for p in named[1].split(",") if p.strip()] if named else []
            head = re.sub(r"\{[^}]*\}", "", what).strip(" ,")
            aliases += [head.split()[-1]] if head else []
            for alias in aliases or [None]:
                out.import_(m["ns"], alias, line_of(m.start()))
    elif language == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", code):
            base, brace, rest = m[1].partition("{")
            items = rest.rstrip("} \n").split(",") if brace else [""]
            for item in items:
                full, _, alias = (base + item.strip()).strip().partition(" as ")
                if full.strip(": "):
                    out.import_(full.strip().replace("::", ".").rstrip("."), alias.strip() or None, line_of(m.start()))
    else:
        for m in re.finditer(r"\bimport\s*(?:\((?P<many>[^)]*)\)|(?P<one>(?:\w+\s+)?\"[^\"]+\"))", content):
            for n in re.finditer(r"(?:(?P<alias>[\w.]+)[ \t]+)?\"(?P<ns>[^\"]+)\"", m["many"] or m["one"]):
                out.import_(n["ns"].replace("/", "."), n["alias"], line_of(m.start()))


def parse(language: str, repo: str, path: str, content: str) -> Extraction:
    code = blank(content, language)
    ends = [m.start() for m in re.finditer("\n", content)]
    line_of = lambda at: bisect_right(ends, at - 1) + 1
    out = Extraction(repo, path)
    namespace = out.symbol("namespace", module_name(path), 1, len(ends) + 1)
    boxes: list[tuple[int, int, str]] = []
    by_name: dict[str, str] = {}
    for m in _CONTAINERS[language].finditer(code):
        end = close(code, m.end())
        uri = out.symbol("container", m["name"], line_of(m.start()), line_of(end), content[m.start() : end], None, None, namespace)
        boxes.append((m.start(), end, uri))
        by_name.setdefault(m["name"], uri)
        if language == "js" and m["base"]:
            out.reference(uri, m["base"], line_of(m.start()), "inherits")
    if language == "rust":
        for m in re.finditer(r"\bimpl\b(?:\s*<[^>{]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<name>\w+)", code):
            if (uri := by_name.get(m["name"])) is not None:
                boxes.append((m.start(), close(code, m.end()), uri))
                if m["trait"]:
                    out.reference(uri, m["trait"].replace("::", "."), line_of(m.start()), "inherits")
    bodies: list[tuple[int, int, str]] = []
    taken: set[int] = set()
    for pattern in _CALLABLES[language]:
        for m in pattern.finditer(code):
            at = m.start("name")
            if at in taken or m["name"] in _NOT_CALLS[language]:
                continue
            taken.add(at)
            first = max(code.rfind("\n", 0, at) + 1, m.start())
            end = close(code, m.end("sig"))
            owner = by_name.get(m["owner"] or "") if language == "go" else next((u for s, e, u in sorted(boxes, reverse=True) if s < at < e), None)
            uri = out.symbol("callable", m["name"], line_of(at), line_of(max(end - 1, at)), content[first:end], None, " ".join(m["sig"].split()), owner or namespace, owner is not None)
            bodies.append((at, end, uri))
    for m in _VALUES[language].finditer(code):
        out.symbol("value", m["name"], line_of(m.start()), line_of(m.start()), content[m.start() : close(code, m.end())], None, None, namespace)
    bodies.sort()
    for m in _CALL.finditer(code):
        at = m.start("name")
        name = m["name"].replace("::", ".")
        if at in taken or name in _NOT_CALLS[language]:
            continue
        inside = [u for s, e, u in bodies if s < at < e]
        out.reference(inside[-1] if inside else namespace, name, line_of(at))
    _imports(content, code, language, out, line_of)
    return out

"""Settings of an index: a TOML file with defaults, and the paths it implies."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field

# What is left out where nothing else is said.
EXCLUDES = (".git/", "node_modules/", "target/", "dist/", "build/", ".venv/", "__pycache__/")
FOLDER, FILE = ".stratagraph", "config.toml"


@dataclass
class Config:
    database: str | None = None
    repo: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDES))


def default_path(base: str) -> str:
    return os.path.join(base, FOLDER, FILE)


def load(path: str) -> Config:
    """The file's settings; defaults where there is no file. Unknown keys are errors."""
    try:
        with open(path, "rb") as f:
            return Config(**tomllib.load(f))
    except FileNotFoundError:
        return Config()


def dump(config: Config) -> str:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"{k} = {quote(v)}" for k, v in (("database", config.database), ("repo", config.repo)) if v is not None]
    lines += [f"{k} = [{', '.join(map(quote, v))}]" for k, v in (("include", config.include), ("exclude", config.exclude))]
    return "\n".join(lines) + "\n"


def write(path: str, config: Config, force: bool = False) -> bool:
    """False where a file is there already and ``force`` is not set."""
    if os.path.exists(path) and not force:
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(dump(config))
    return True


def keep_out_of_git(base: str) -> bool:
    """Add the index folder to .gitignore once."""
    path = os.path.join(base, ".gitignore")
    held = open(path).read() if os.path.exists(path) else ""  # noqa: SIM115
    if any(line.strip().strip("/") == FOLDER for line in held.splitlines()):
        return False
    with open(path, "a") as f:
        f.write(("" if not held or held.endswith("\n") else "\n") + FOLDER + "/\n")
    return True


def mcp_entry(command: str, args: list[str], held: str = "", name: str = "stratagraph") -> str:
    """The JSON of a client's list of tool servers (``held``, may be empty) with ours added or replaced."""
    found = json.loads(held) if held.strip() else {}
    found.setdefault("mcpServers", {})[name] = {"command": command, "args": args}
    return json.dumps(found, indent=2) + "\n"


def resolve_database(given: str | None, config: Config, base: str) -> str:
    return given or config.database or os.path.join(base, FOLDER, "index")


def resolve_repo(given: str | None, config: Config, base: str) -> str:
    return given or config.repo or os.path.basename(os.path.abspath(base)) or "repo"

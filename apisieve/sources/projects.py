"""Project files: which sources a tsconfig selects, over ``extends`` and ``references``.

Configuration files are few and small, so the driver reads them; the result is glob
patterns that filter the distributed file scan.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import included

DEFAULT_EXCLUDE = ("node_modules/**", "**/node_modules/**")


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas, as JSON."""
    text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r",(\s*[}\]])", r"\1", text)


@dataclass
class Selection:
    """Files and patterns relative to the project's root, and what went wrong."""

    files: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    problems: list[tuple[str, str]] = field(default_factory=list)


def _strings(value) -> list[str] | None:
    return value if isinstance(value, list) and all(isinstance(x, str) for x in value) else None


def _effective(path: str, read: Callable[[str], str | None], problems: list, trail: tuple[str, ...] = ()) -> dict | None:
    """The configuration with what it extends; own fields win."""
    if path in trail:
        problems.append((path, "extends cycle"))
        return None
    text = read(path)
    try:
        own = json.loads(without_comments(text)) if text is not None else None
    except ValueError:
        own = None
    if not isinstance(own, dict):
        problems.append((path, "unreadable configuration"))
        return None
    base: dict = {}
    here = posixpath.dirname(path)
    for parent in [own["extends"]] if isinstance(own.get("extends"), str) else own.get("extends") or []:
        if not parent.startswith("."):
            problems.append((path, f"package configuration {parent} is not followed"))
            continue
        target = posixpath.normpath(posixpath.join(here, parent))
        base |= _effective(target if target.endswith(".json") else target + ".json", read, problems, (*trail, path)) or {}
    for name in ("files", "include", "exclude"):
        if name in own:
            values = _strings(own[name])
            if values is None:
                problems.append((path, f"invalid {name}"))
                return {"files": [], "include": [], "exclude": []}
            base[name] = [posixpath.normpath(posixpath.join(here, v)) for v in values]
    if "references" in own:
        base["references"] = [posixpath.normpath(posixpath.join(here, r["path"])) for r in own["references"] if isinstance(r, dict) and isinstance(r.get("path"), str)]
    return base


def discover(path: str, read: Callable[[str], str | None]) -> Selection:
    """What a tsconfig and the projects it references select; ``read`` gives a file's text or None."""
    out, seen = Selection(), set()
    todo: list[tuple[str, tuple[str, ...]]] = [(path, ())]  # each with the projects on the way to it
    while todo:
        now, way = todo.pop(0)
        if now in way:
            out.problems.append((now, "reference cycle"))
            continue
        if now in seen:  # shared by several projects
            continue
        seen.add(now)
        config = _effective(now, read, out.problems)
        if config is None:
            continue
        here = posixpath.dirname(now)
        out.files += config.get("files", [])
        out.include += config.get("include", [] if "files" in config else [posixpath.join(here, "**") if here else "**"])
        out.exclude += config.get("exclude", [posixpath.join(here, e) for e in DEFAULT_EXCLUDE])
        for r in config.get("references", []):
            todo.append((r if r.endswith(".json") else posixpath.join(r, "tsconfig.json"), (*way, now)))
    return out


def select_sources(files: DataFrame, selection: Selection) -> DataFrame:
    """The scanned files that a selection names; a folder pattern takes what lies below it."""
    globs = selection.include + [g.rstrip("/") + "/**" for g in selection.include if "*" not in g]
    listed = F.col("path").isin(*selection.files) if selection.files else F.lit(False)
    return files.filter(listed | included(F.col("path"), globs, selection.exclude))

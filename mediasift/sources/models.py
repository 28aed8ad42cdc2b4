"""Where a detector's weights are: candidate paths, pointers in place of files, names that mean nothing."""

from __future__ import annotations

import sys
from collections.abc import Mapping
from pathlib import Path

# The first words of a large-file pointer, names that stand for no model, variables that name one.
POINTER = "git-lfs.github.com/spec"
PLACEHOLDERS = frozenset(("yolo-world", "yolo_world"))
WEAPON_VARIABLES = ("YOLO_WORLD_MODEL", "YOLO_WEAPON_MODEL", "YOLO_WEAPONS_WEIGHTS")


def candidates(name: str, root: Path, with_prefix: bool = False) -> list[Path]:
    """Paths to try in order, each once: an absolute one as it is, else below root, the working folder and, if asked, the interpreter's."""
    path = Path(name).expanduser()
    if path.is_absolute():
        return [path]
    bases = [root, Path.cwd(), *([Path(sys.prefix)] if with_prefix else [])]
    return list({(b / path).resolve(): b / path for b in reversed(bases)}.values())[::-1]


def is_pointer(path: Path) -> bool:
    """A small text file that only points to the weights."""
    return path.is_file() and path.stat().st_size <= 1024 and POINTER in path.read_text(errors="replace")[:200]


def resolve(name: str, root: Path, with_prefix: bool = False) -> tuple[Path | None, str | None]:
    """(the first candidate that exists, or None; what is wrong with it, or None)."""
    tried = candidates(name, root, with_prefix)
    for path in tried:
        if path.exists():
            return path, "pointer" if is_pointer(path) else None
    return None, "missing: " + ", ".join(map(str, tried))


def weapon_model(env: Mapping[str, str]) -> str | None:
    """The first variable that is set decides; a placeholder means no model."""
    name = next((env[v].strip() for v in WEAPON_VARIABLES if env.get(v, "").strip()), "")
    return None if not name or name.lower() in PLACEHOLDERS else name

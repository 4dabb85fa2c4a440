"""Patterns of the ``.gitignore`` files of a tree. Negation, ``**`` and classes of characters have no meaning of their own."""

from __future__ import annotations

import os
from pathlib import Path

MAX_BYTES = 100 * 1024
# Fixed values.
COMMON_EXCLUDED = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "__pycache__", "node_modules", "venv")


def line_pattern(line: str, folder: str = "") -> str | None:
    """The pattern of a line, in front of it the folder of its file; None for blanks and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    line = line.removeprefix("/")
    return f"{folder}/{line}" if folder else line


def eligible(path: Path, root: Path) -> bool:
    """A plain UTF-8 text within the size, not in hidden or common folders nor in a linked one."""
    if not path.is_file() or path.parent.is_symlink():
        return False
    if any(p.startswith(".") or p in COMMON_EXCLUDED for p in path.parent.relative_to(root).parts):
        return False
    try:
        return path.stat().st_size <= MAX_BYTES and "\0" not in path.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError):
        return False


def load(root: str | Path) -> list[str]:
    root = Path(root)
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(x for x in folders if not x.startswith(".") and x not in COMMON_EXCLUDED)  # an ignore file in those counts for nothing
        path = Path(folder, ".gitignore")
        if ".gitignore" in names and eligible(path, root):
            base = path.parent.relative_to(root).as_posix()
            found += [p for line in path.read_text(encoding="utf-8").splitlines() if (p := line_pattern(line, "" if base == "." else base))]
    return found

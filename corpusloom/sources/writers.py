"""Output files: names, tables of contents, manifests, metrics; each written whole or not at all. Parts themselves are written by ``part_files``."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

MANIFEST, LOCK, METRICS = ".corpusloom_manifest.json", ".corpusloom_merge.lock", "metrics.json"


def write_bytes(path: str | Path, data: bytes) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(temporary)
        raise


def write_text(path: str | Path, text: str) -> None:
    write_bytes(path, text.encode("utf-8"))


def load_manifest(folder: Path) -> list[str]:
    with contextlib.suppress(OSError, ValueError):
        return [x for x in json.loads((folder / MANIFEST).read_text(encoding="utf-8")) if isinstance(x, str)]
    return []


def save_manifest(folder: Path, names: list[str]) -> None:
    write_text(folder / MANIFEST, json.dumps(names, indent=2))


def is_output(name: str, template: str) -> bool:
    return re.fullmatch(rf"{re.escape(template)}(_\d+)?\.md", name) is not None


def clean(folder: Path, template: str = "") -> list[str]:
    """Delete what the manifest names (of one template, if given) and, with a template, all numbered files of it."""
    names = {n for n in load_manifest(folder) if not template or is_output(n, template)}
    if template and folder.is_dir():
        names |= {p.name for p in folder.iterdir() if is_output(p.name, template)}
    gone = [n for n in sorted(names) if (folder / n).is_file()]
    for n in gone:
        (folder / n).unlink()
    save_manifest(folder, [n for n in load_manifest(folder) if n not in names])
    return gone


@contextlib.contextmanager
def merge_lock(folder: Path) -> Iterator[None]:
    folder.mkdir(parents=True, exist_ok=True)
    with (folder / LOCK).open("w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def next_number(folder: Path, template: str) -> int:
    found = [int(m[1]) for p in folder.glob("*.md") if (m := re.fullmatch(rf"{re.escape(template)}_(\d+)\.md", p.name))]
    return max(found, default=0) + 1


def toc_entry(name: str, parts: int = 1) -> str:
    """The last component of a path, a command whole; marked where it goes over several parts."""
    shown = name if name.startswith("pre: ") else re.split(r"[/\\]", name)[-1]
    return shown + (f" [split across {parts} parts]" if parts > 1 else "")


def toc(entries: list[str], part: int, total: int) -> str:
    return "".join([f"\nPart {part} of {total}. Files in this part:\n", *(f"\n  {e}" for e in entries), "\n\n"]) if entries else ""


def part_name(template: str, number: int) -> str:
    return f"{template}_{number}.md"


def write_lines(path: str | Path, lines: Iterable[str]) -> None:
    """As ``write_text``, but a line at a time."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines(lines)
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(temporary)
        raise


def write_metrics(folder: Path, metrics: dict) -> None:
    write_text(folder / METRICS, json.dumps(metrics, indent=2))


def manifest_report(folder: Path, project: str, profiles: list[str], count: Callable[[str], int], as_json: bool = False) -> str:
    """What the manifest names and is there, with tokens; for people, or as JSON."""
    found = [(n, count((folder / n).read_text(encoding="utf-8"))) for n in sorted(load_manifest(folder)) if (folder / n).is_file()]
    if as_json:
        return json.dumps({"project_name": project, "profiles": profiles or ["default"], "parts": [{"file": n, "tokens": t, "hash": None, "dependencies": []} for n, t in found]}, indent=2)
    return "\n".join([f"# {project}: {len(found)} file(s)", *(f"  {n}: {t} tokens" for n, t in found)]) if found else "nothing has been collected yet"

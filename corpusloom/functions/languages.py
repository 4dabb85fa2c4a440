"""Languages of paths and texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension, file name and interpreter of each language.
EXTENSIONS = {
    "py": "python", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "sh": "bash",
    "cfg": "ini", "ini": "ini", "in": "ini", "txt": "text", "js": "javascript", "jsx": "jsx", "ts": "typescript",
    "tsx": "tsx", "html": "html", "css": "css", "sql": "sql", "rs": "rust", "go": "go", "java": "java", "cpp": "cpp",
    "c": "c", "h": "c", "hpp": "cpp", "gd": "gdscript", "cs": "csharp", "swift": "swift", "kt": "kotlin", "rb": "ruby",
    "php": "php", "tf": "hcl", "dockerfile": "dockerfile", "makefile": "makefile", "gitignore": "gitignore",
    "zig": "zig", "lua": "lua", "ex": "elixir", "exs": "elixir", "hs": "haskell", "lhs": "haskell", "gleam": "gleam",
    "cmake": "cmake", "gradle": "groovy", "lock": "text", "conf": "ini", "1": "nroff",
}
FILENAMES = {"dockerfile": "dockerfile", "makefile": "makefile", ".env": "bash", "procfile": "yaml", "vagrantfile": "ruby"}
INTERPRETERS = {"python": "python", "python3": "python", "python2": "python", "bash": "bash", "sh": "bash", "zsh": "bash", "node": "javascript", "ruby": "ruby", "perl": "perl"}
C_LIKE = ("javascript", "typescript", "rust", "go", "java", "cpp", "c", "csharp", "swift", "kotlin", "php", "zig", "gleam")
SCRIPT = ("ruby", "elixir", "lua")
#: Read with the patterns of the C family though not counted to it.
C_LIKE_READ = (*C_LIKE, "gdscript")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder of a path, ``.`` where it has none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def suffix(path: Column) -> Column:
    """The extension of the last component with its dot; a leading dot alone or a trailing dot starts none."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]+)$", 1)


def lang_for_path(path: Column) -> Column:
    """The language by file name, else by extension, else empty."""
    by_name = _lookup(FILENAMES, F.lower(basename(path)))
    by_extension = _lookup(EXTENSIONS, F.lower(F.regexp_replace(suffix(path), r"^\.", "")))
    return F.coalesce(by_name, by_extension, F.lit(""))


def lang_from_shebang(text: Column) -> Column:
    """The language of the interpreter that the first line names, else empty."""
    line = F.regexp_extract(text, r"^#!\s*([^\n]*)", 1)
    first, second = F.regexp_extract(line, r"^(\S+)", 1), F.regexp_extract(line, r"^\S+\s+(\S+)", 1)
    binary = F.when(F.contains(first, F.lit("env")), second).otherwise(F.substring_index(first, "/", -1))
    return F.coalesce(_lookup(INTERPRETERS, binary), F.lit(""))


def resolve_lang(path: Column, text: Column) -> Column:
    by_path = lang_for_path(path)
    return F.when(by_path != "", by_path).otherwise(lang_from_shebang(F.coalesce(text, F.lit(""))))

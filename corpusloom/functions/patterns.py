"""Patterns that read imports, exports, signatures and blocks, their form that takes bounded steps, and its Java form."""

from __future__ import annotations

import re

#: Characters of a list in brackets or of a quoted name at most; longer ones aren't read.
LONGEST = 1 << 14

# Fixed values, in the syntax that Python and Java share; all are matched line by line.
C_LIKE_IMPORTS = (
    r"^\s*import\s+type\s+\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]",
    r"^\s*import\s+\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]",
    r"^\s*import\s+(?:type\s+)?\w+\s+from\s*['\"]([^'\"]+)['\"]",
    r"^\s*import\s+['\"]([^'\"]+)['\"]",
    r"^\s*(?:const|let|var)\s*\{([^}]*)\}\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"^\s*(?:const|let|var)\s+\w+\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"^\s*#include\s*[<\"]([^>\"]+)[>\"]",
    r"^\s*using\s+([\w\.]+)\s*;",
    r"^\s*use\s+([\w\\]+)\s*;",
)
C_LIKE_EXPORT = r"^\s*(?:export\s+)?(?:async\s+)?(?:function|def|class|interface|enum|struct|trait|impl|type\s+\w+\s+\w+|type\s+|public\s+class|public\s+static|public\s+function|fn|func)\s+(\w+)"
C_LIKE_SIGNATURE = r"^(\s*(?:export\s+)?(?:async\s+)?(?:function|def|class|interface|enum|struct|trait|impl|type\s+\w+\s+\w+|type\s+|public\s+class|public\s+static|public\s+function|fn|func)\s+[^{]*)"
SCRIPT_IMPORTS = (r"^\s*require\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"^\s*use\s+([\w\.]+)")
SCRIPT_EXPORTS = (r"^\s*def\s+(?:self\.)?(\w+[?!]?)", r"^\s*defmodule\s+([\w\.]+)", r"^\s*defp\s+(\w+)", r"^\s*function\s+(\w+)")
SCRIPT_SIGNATURES = (r"^(\s*def\s+(?:self\.)?\w+[?!]?.*)", r"^(\s*defmodule\s+[\w.]+.*)", r"^(\s*defp\s+\w+.*)", r"^(\s*function\s+\w+.*)")
SCRIPT_BLOCKS = (r"^(\s*def\s+(?:self\.)?(\w+[?!]?).*)", r"^(\s*defmodule\s+([\w.]+).*)", r"^(\s*defp\s+(\w+).*)", r"^(\s*function\s+(\w+).*)")
BLOCKS = (
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)[^{]*",
    r"^\s*def\s+(\w+)[^{]*",
    r"^\s*(?:export\s+)?(?:async\s+)?class\s+(\w+)[^{]*",
    r"^\s*(?:export\s+)?(?:async\s+)?interface\s+(\w+)[^{]*",
    r"^\s*(?:export\s+)?(?:async\s+)?enum\s+(\w+)[^{]*",
    r"^\s*(?:export\s+)?(?:async\s+)?struct\s+(\w+)[^{]*",
    r"^\s*(?:export\s+)?(?:async\s+)?trait\s+(\w+)[^{]*",
    r"^\s*(?:export\s+)?(?:async\s+)?impl\s+(\w+)[^{]*",
    r"^\s*type\s+(\w+)\s+\w+[^{]*",
    r"^\s*type\s+(\w+)[^{]*",
    r"^\s*public\s+class\s+(\w+)[^{]*",
    r"^\s*public\s+static\s+(\w+)[^{]*",
    r"^\s*public\s+function\s+(\w+)[^{]*",
    r"^\s*fn\s+(\w+)[^{]*",
    r"^\s*func\s+(\w+)[^{]*",
)
PYTHON_FROM = r"^from\s+([\w\.]+)\s+import"
PYTHON_IMPORT_LIST = r"^import\s*\(([^)]*)\)"


#: What takes steps that grow with the square of a text, and what gives the same matches without.
_BOUNDED = (
    # blank lines: all that is read starts with a character that isn't white, so the white space of its own line is enough before it
    (r"^\s*", r"^[^\S\n]*"),
    (r"^(\s*", r"^([^\S\n]*"),
    # an open list is followed up to its end once, and not for ever
    (r"([^}]*)", rf"([^}}]{{0,{LONGEST}}}+)"),
    (r"([^)]*)", rf"([^)]{{0,{LONGEST}}}+)"),
    (r"([^'\"]+)", rf"([^'\"]{{1,{LONGEST}}}+)"),
    (r"([^>\"]+)", rf"([^>\"]{{1,{LONGEST}}}+)"),
    # two runs of white space one after the other can be parted in as many ways as there are characters
    (r"type\s+|", r"type\s|"),
)


def bounded(pattern: str) -> str:
    """A pattern that matches the same, but for lists over ``LONGEST``, in steps that are in proportion to the text."""
    for plain, linear in _BOUNDED:
        pattern = pattern.replace(plain, linear)
    return pattern


def java(pattern: str) -> str:
    """The bounded pattern in Java: line by line on newlines only, with classes of all scripts."""
    return f"(?mdU){bounded(pattern)}"


def groups(pattern: str) -> int:
    """How many groups a pattern captures."""
    return re.compile(pattern).groups

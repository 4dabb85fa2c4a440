"""Blocks of JavaScript, TypeScript and Go by their scopes: functions, classes, methods, arrow functions and types, at any depth, each with its exact end.

A text is read once, token by token: strings, template literals with what stands in them, comments and regular expressions are passed over, brackets open and close scopes on a stack. What a brace
opens is told by the words in front of it, back to the end of the statement before. A block's name has the names of the blocks around it in front, parted by dots.

Defined results: a brace that never closes ends with the text; of equal names the first holds; brackets that close nothing are passed over; a text without blocks gives none.
"""

from __future__ import annotations

import dataclasses
import re

SCOPED = ("javascript", "typescript", "go")
_TOKEN = re.compile(
    r"""(?P<quiet>//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))|(?P<tick>`)|(?P<slash>/)|(?P<open>[{(\[])|(?P<close>[})\]])|(?P<end>;)|(?P<word>[\w$#]+)|(?P<line>\n)|(?P<other>[^\s])""",
    re.DOTALL,
)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?P<stop>`|\$\{)?", re.DOTALL)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_RAW = re.compile(r"`[^`]*(?:`|\Z)")
#: Words behind which a slash starts a regular expression; words that open a block of a statement and not a method.
_BEFORE_REGEX = frozenset("return typeof case in of new delete void throw do else instanceof yield await".split())
_STATEMENTS = frozenset("if for while switch catch with function return do else try finally".split())
_EXPORT = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_KINDS = tuple(
    (kind, re.compile(pattern, re.DOTALL))
    for kind, pattern in (
        ("function", rf"{_EXPORT}(?:async\s+)?function\b\s*\*?\s*(?P<name>[\w$]+)"),
        ("class", rf"{_EXPORT}(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        ("type", rf"{_EXPORT}(?:const\s+)?(?:interface|enum|namespace|module)\s+(?P<name>[\w$.]+)"),
        ("type", rf"{_EXPORT}type\s+(?P<name>[\w$]+)[^=]*=\s*\Z"),
        ("function", rf"{_EXPORT}(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]*)?=\s*(?:async\s+)?function\b"),
        ("function", rf"{_EXPORT}(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::.*)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\(.*\)|[\w$]+)\s*(?::.*)?=>\s*\Z"),
    )
)
_METHOD = re.compile(r"(?:@[\w.]+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|async|get|set|override|abstract|readonly)\s+)*\*?\s*(?P<name>[\w$#]+)\s*(?:<[^>]*>)?\s*\(.*\)\s*(?::.*)?\Z", re.DOTALL)
_FIELD = re.compile(r"(?:(?:public|private|protected|static|readonly)\s+)*(?P<name>[\w$#]+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\(.*\)|[\w$]+)\s*(?::.*)?=>\s*\Z", re.DOTALL)
_GO = tuple((kind, re.compile(pattern, re.DOTALL)) for kind, pattern in (("function", r"func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<of>\w+)[^)]*\)\s*)?(?P<name>\w+)"), ("type", r"type\s+(?P<name>\w+)[^{]*\b(?:struct|interface)\s*\Z")))


@dataclasses.dataclass
class _Scope:
    """An open bracket: what closes it, where it is, the block that it is if it is one, and where the statement that is read in it starts."""

    closes: str
    at: int
    kind: str | None
    name: str
    head: str
    start: int
    template: bool = False


def _told(head: str, around: str | None, go: bool) -> tuple[str | None, str]:
    """The kind and name of what a brace behind ``head`` opens."""
    for kind, pattern in _GO if go else _KINDS:
        if m := pattern.match(head):
            of = m["of"] if go and kind == "function" else None
            return kind, f"{of}.{m['name']}" if of else m["name"]
    if around == "class" and not go:
        for pattern in (_METHOD, _FIELD):
            if (m := pattern.match(head)) and m["name"] not in _STATEMENTS:
                return "function", m["name"]
    return None, ""


def scoped_blocks(text: str, lang: str) -> dict[str, tuple[str, str]]:
    """Head and body, braces included, of each block, by name."""
    go = lang == "go"
    stack = [_Scope("", 0, None, "", "", 0)]
    found: list[tuple[int, str, str, int, int]] = []
    at, last, template = 0, "", False
    while at < len(text):
        if template:
            m = _TEMPLATE.match(text, at)
            at, template = m.end(), False
            if m["stop"] == "${":
                stack.append(_Scope("}", at - 1, None, "", "", at, template=True))
            last = "`"
            continue
        m = _TOKEN.search(text, at)
        if m is None:
            break
        at, top = m.end(), stack[-1]
        if m["quiet"]:
            if not m[0].startswith(("//", "/*")):
                last = '"'
            elif not text[top.start : m.start()].strip():
                top.start = at  # a comment in front of a statement isn't of it
            continue
        if m["tick"]:
            if go:
                at = _RAW.match(text, m.start()).end()
            else:
                template = True
        elif m["slash"] and not go and (not last or last in _BEFORE_REGEX or not (last[-1].isalnum() or last[-1] in "_$)]}\"`")):
            at = r.end() if (r := _REGEX.match(text, m.start())) else at
        elif m["end"]:
            top.start = at
        elif m["line"]:
            if go and top.closes != ")" and last and (last[-1].isalnum() or last[-1] in "_)]}\"'`"):
                top.start = at  # a line that can end a statement does
            continue
        elif m["open"] == "{":
            head = text[top.start : m.start()].strip()
            kind, name = _told(head, top.kind, go) if top.closes in ("", "}") else (None, "")
            stack.append(_Scope("}", m.start(), kind, name, head, at))
        elif m["open"]:
            stack.append(_Scope(")" if m[0] == "(" else "]", m.start(), None, "", "", at))
        elif m["close"] and len(stack) > 1 and top.closes == m[0]:
            stack.pop()
            if top.kind:
                found.append(_block(stack, top, at))
            if top.template:
                template = True
            elif m[0] == "}" and stack[-1].closes in ("", "}") and (top.kind or not top.head.endswith(("=", "=>", ":", ",", "(", "return"))):
                stack[-1].start = at
        last = m[0]
    while len(stack) > 1:
        if (top := stack.pop()).kind:
            found.append(_block(stack, top, len(text)))
    blocks: dict[str, tuple[str, str]] = {}
    for begin, name, head, start, end in sorted(found):
        blocks.setdefault(name, (head, text[start:end]))
    return blocks


def _block(around: list[_Scope], own: _Scope, end: int) -> tuple[int, str, str, int, int]:
    return own.at, ".".join([*(s.name for s in around if s.kind), own.name]), own.head, own.at, end

"""Plain text tools for source files: blanking comments and strings, script parts, brackets and lines."""

from __future__ import annotations

import re
from bisect import bisect_right

_SCRIPT_OPEN = re.compile(r"<script\b")


def script_only(content: str, mode: str) -> str:
    """Script lines of a component file, all other lines empty, so that line numbers stay.

    ``vue`` and ``svelte`` keep what is between script tags; ``astro`` also keeps what is between ``---`` lines.
    """
    out, inside = [], False
    for line in content.split("\n"):
        s = line.strip()
        if mode == "astro" and s == "---":
            inside, line = not inside, ""
        elif _SCRIPT_OPEN.match(s):
            inside, line = True, ""
        elif s.startswith("</script"):
            inside, line = False, ""
        out.append(line if inside else "")
    return "\n".join(out)


_C_LIKE = r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
_RULES = {
    "rust": r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'",
    "go": _C_LIKE, "ruby": r"\#[^\n{][^\n]*|^=begin.*?^=end|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "php": r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
}
_COMPILED: dict[str, re.Pattern] = {}


def blanked(text: str, language: str) -> str:
    """The text with comments and the insides of strings turned to blanks; length and lines stay."""
    rule = _COMPILED.get(language)
    if rule is None:
        rule = _COMPILED[language] = re.compile(_RULES.get(language, _C_LIKE), re.DOTALL | re.MULTILINE)

    def blank(m: re.Match) -> str:
        s = m[0]
        keep = s[0] if s[0] in "\"'`" and len(s) > 1 else ""
        inner = re.sub(r"[^\n]", " ", s[len(keep):len(s) - len(keep)] if keep else s)
        return keep + inner + keep

    return rule.sub(blank, text)


class Layout:
    """Brackets and lines of a blanked text."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match: dict[int, int] = {}
        self.blocks: list[tuple[int, int]] = []  # of braces, in order of their start
        stack: list[tuple[str, int]] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", text):
            c, at = m[0], m.start()
            if c in "([{":
                stack.append((c, at))
            else:
                while stack and stack[-1][0] != pairs[c]:
                    stack.pop()
                if stack:
                    self.match[stack.pop()[1]] = at
        for o, c in self.match.items():
            if text[o] == "{":
                self.blocks.append((o, c))
        self.blocks.sort()
        # the block around each block, so that nesting is a walk upwards
        self.parent: dict[int, int | None] = {}
        open_: list[tuple[int, int]] = []
        for o, c in self.blocks:
            while open_ and open_[-1][1] < o:
                open_.pop()
            self.parent[o] = open_[-1][0] if open_ else None
            open_.append((o, c))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def around(self, at: int) -> int | None:
        """Start of the innermost block that holds a place."""
        k = bisect_right(self.blocks, (at, 1 << 60)) - 1
        o = self.blocks[k][0] if k >= 0 else None
        while o is not None and self.match[o] < at:
            o = self.parent[o]
        return o

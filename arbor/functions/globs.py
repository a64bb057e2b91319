"""Path patterns and rule files as regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Rule files that one load reads at most, includes counted.
RULE_FILES = 16


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool
    anchored: bool
    body: str

    def regex(self, whole: bool) -> str:
        """For paths without their leading slash; not whole: what lies below a
        match matches too. Java and RE2 read it alike."""
        start = "" if self.anchored else "(?:.*/)?"
        return f"(?s)^{start}{self.body}{'' if whole else '(?:/.*)?'}\\z"

    def prefix(self) -> str:
        """The literal directories that an anchored pattern begins with."""
        text = self.pattern.lstrip("!").removeprefix("/")
        literal = re.split(r"[*?]", text, maxsplit=1)[0]
        return literal.rpartition("/")[0] if self.anchored else ""


_PIECE = re.compile(r"\*\*|\*|\?|[^*?]")


def rule(line: str) -> Rule:
    """A line of a rule file: `!` negates, a slash but at the end anchors, `*`
    and `?` stay in a name, `**/` at a name's start is any directories."""
    body = line.removeprefix("!").removesuffix("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, at, directories = [], 0, True  # directories: a name could begin here
    while at < len(body):
        piece = _PIECE.match(body, at)[0]
        at += len(piece)
        if piece == "**" and directories and body.startswith("/", at):
            out.append("(?:.*/)?")
            at += 1
            continue
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.escape(piece))
        directories = piece == "/"
    return Rule(line, line.startswith("!"), anchored, "".join(out))


def load_rules(read, path: str = "/.lww", seen: set[str] | None = None) -> list[Rule]:
    """Rules of a file and of those that its %include lines name, in place.
    read gives a file's text, or None."""
    seen = set() if seen is None else seen
    if path in seen or len(seen) >= RULE_FILES:
        return []
    seen.add(path)
    out = []
    for line in (read(path) or "").split("\n"):
        line = line.strip()
        if m := re.fullmatch(r"%include\s+(\S+)", line):
            out += load_rules(read, "/" + m[1].lstrip("/"), seen)
        elif line and not line.startswith("#"):
            out.append(rule(line))
    return out

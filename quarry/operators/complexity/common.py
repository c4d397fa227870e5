"""What the analyzers share."""

from __future__ import annotations

import re

NOT_CODE = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)


def blanked(source: str) -> str:
    """Comments and literals as blanks, line ends kept."""
    return NOT_CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def comment_ratio(lines: list[str], single: str = "#", start: str = "/*", end: str = "*/") -> float:
    """Share of comment lines; a line that closes a comment still counts."""
    inside, n = False, 0
    for line in map(str.strip, lines):
        inside |= start in line
        n += inside or line.startswith(single)
        inside &= end not in line
    return n / len(lines) if lines else 0.0


def logical_operators(text: str) -> int:
    return sum(map(text.count, ("&&", "||", " and ", " or ", " not ")))


def closing(text: str, at: int, pair: str = "{}") -> int:
    """Place after the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for k in re.finditer(f"[{re.escape(pair)}]", text[at:]):
        depth += 1 if k.group() == pair[0] else -1
        if not depth:
            return at + k.end()
    return -1


def nesting_depth(node, opens, children=lambda n: n.children) -> int:
    """How deep a tree's nodes of some kinds lie in each other. opens: whether a node makes a level; children: a node's own nodes."""
    deepest, todo = 0, [(node, 0)]
    while todo:
        at, depth = todo.pop()
        depth += bool(opens(at))
        deepest = max(deepest, depth)
        todo += [(c, depth) for c in children(at)]
    return deepest

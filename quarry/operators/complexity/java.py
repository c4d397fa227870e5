"""Java sources by a lexer and bracket matching: declarations are told by the shape of what precedes a body.

Comments and literals are blanked first, so that brackets and words in them don't count. Nothing is resolved: a method is a name, a
parameter list and a block inside a type; what a statement keyword opens is nested in it.
"""

from __future__ import annotations

import re

from quarry.operators.complexity.common import blanked, closing, comment_ratio

TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
METHOD = re.compile(r"(?:^|[\s}>\])])(\w+)\s*\(")
WORD = re.compile(r"->|&&|\|\||\?(?!\s*(?:super|extends|[>,]))|[{}();:]|\.\s*\w+(?=\s*\()|\w+")
LOOPS = {"if", "for", "while", "do", "switch", "catch"}
NOT_NAMES = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "throw", "super", "this", "else", "do", "assert", "case"}
STREAMS = {"filter", "map", "flatMap", "distinct", "sorted", "peek", "limit", "skip"}


def measures(body: str) -> tuple[int, int, int]:
    """(cyclomatic, cognitive, depth) of a block with its braces."""
    cc, cost, deepest = 1, 0, 0
    stack: list[str] = []  # what each open brace belongs to
    pending: list[str] = []  # flow words whose statement has not opened its block yet
    words = [(m.group(), m.start()) for m in WORD.finditer(body)]
    parens = 0
    for k, (w, _) in enumerate(words):
        nesting = sum(s in LOOPS or s == "->" for s in stack) + len(pending)
        if w in LOOPS:
            loop_end = w == "while" and k and words[k - 1][0] == "}" and stack[-1:] != ["while"] and _ends_do(words, k)
            if loop_end:
                continue
            cc += w != "switch"
            cost += 1 + nesting
            pending.append(w)
        elif w in ("case", "default") and (w == "case" or k + 1 < len(words) and words[k + 1][0] in (":", "->")):
            cc += 1
        elif w in ("&&", "||"):
            cc += 1
            cost += 1
        elif w == "?":
            cc += 1
            cost += 1 + nesting
        elif w == "->":
            if not any(words[j][0] in ("case", "default") for j in range(max(0, k - 4), k)):
                cc += 1
                cost += 1 + nesting
                if k + 1 < len(words) and words[k + 1][0] == "{":
                    pending.append("->")
        elif w in ("break", "continue"):
            cost += 1
        elif w[0] == ".":
            cc += w[1:].strip() in STREAMS
        elif w == "(":
            parens += 1
        elif w == ")":
            parens -= 1
        elif w == "{":
            stack.append(pending.pop() if pending else "{")
            deepest = max(deepest, len(stack))
        elif w == "}":
            if stack:
                stack.pop()
        elif w == ";" and parens <= 0:
            pending.clear()
    return cc, cost, max(0, deepest - 1)


def _ends_do(words: list, k: int) -> bool:
    """Whether the while at k closes a do: its block's opening brace follows a do."""
    depth = 0
    for j in range(k - 1, -1, -1):
        depth += {"}": 1, "{": -1}.get(words[j][0], 0)
        if not depth:
            return j > 0 and words[j - 1][0] == "do"
    return False


def _types(code: str) -> list[tuple[str, int, int, int]]:
    """(name, start, body start, body end) of each type."""
    out = []
    for m in TYPE.finditer(code):
        brace = code.find("{", m.end())
        if brace < 0 or ";" in code[m.end() : brace]:
            continue
        end = closing(code, brace)
        if end > 0:
            out.append((m[2], m.start(), brace, end))
    return out


def _methods(code: str, start: int, end: int, inner: list[tuple[int, int]]) -> list[tuple[str, int, str, int, int]]:
    """(name, start, parameters, body start, body end) of what stands directly in a type's body."""
    out, at = [], start + 1
    while at < end:
        m = METHOD.search(code, at, end)
        if not m:
            break
        skip = next((b for a, b in inner if a <= m.start(1) < b), None)
        if skip:
            at = skip
            continue
        close = closing(code, m.end() - 1, "()")
        if close < 0:
            break
        tail = re.compile(r"\s*(?:throws\s+[\w.,\s]+?)?\s*\{").match(code, close, end)
        if m[1] in NOT_NAMES or not tail:
            brace = code.find("{", m.end())
            semi = code.find(";", m.end())
            at = close if brace < 0 or 0 <= semi < brace or m[1] not in NOT_NAMES else max(closing(code, brace), close)
            continue
        stop = closing(code, tail.end() - 1)
        if stop < 0:
            break
        out.append((m[1], m.start(1), code[m.end() : close - 1], tail.end() - 1, stop))
        at = stop
    return out


def _lambdas(code: str, open_at: int, stop: int) -> list[tuple[str, int, int, int, int]]:
    """(place as line:column, first line, last line, cyclomatic, cognitive) of each lambda of a method; one whose body is an expression costs 1."""
    out = []
    for m in re.finditer(r"->", code[open_at:stop]):
        at = open_at + m.start()
        head = re.search(r"(\([^()]*\)|\w+)\s*$", code[open_at:at])
        if not head or re.search(r"\b(?:case\b[^;{}]*|default\s*)$", code[open_at:at]):
            continue
        start = open_at + head.start()
        brace = re.compile(r"\s*\{").match(code, at + 2)
        end = closing(code, brace.end() - 1) if brace else at + 2
        c, g, _ = measures(code[brace.end() - 1 : end]) if brace else (1, 1, 0)
        line = code.count("\n", 0, start) + 1
        out.append((f"{line}:{start - code.rfind(chr(10), 0, start) - 1}", line, code.count("\n", 0, end) + 1, c, g))
    return out


def analyze(source: str, lambdas: bool = False) -> dict:
    """``lambdas``: with a row for each lambda, named by its type and place."""
    code = blanked(source)
    if code.count("{") != code.count("}"):
        return {"error": "Syntax error: unmatched braces"}
    types = _types(code)
    rows, groups = [], []
    for name, start, brace, end in types:
        owner = max((t for t in types if t[2] < start and end < t[3]), key=lambda t: t[2], default=None)
        depth = sum(t[2] < start and end < t[3] for t in types)
        inner = [(s, e) for _, s, b, e in types if brace < s and e < end]
        cc = []
        for method, at, params, open_at, stop in _methods(code, brace, end, inner):
            c, g, d = measures(code[open_at:stop])
            cc.append(c)
            flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", params))
            line = code.count("\n", 0, at) + 1
            rows.append({"name": f"{name}.{method}", "type": "constructor" if method == name else "method", "complexity": c, "cognitive": g, "line_start": line, "line_end": code.count("\n", 0, stop) + 1, "parameters": flat.count(",") + 1 if flat.strip() else 0, "depth": d})
            for place, first, last, lc, lg in _lambdas(code, open_at, stop) if lambdas else []:
                rows.append({"name": f"{name}.lambda@{place}", "type": "lambda", "complexity": lc, "cognitive": lg, "line_start": first, "line_end": last, "parameters": 0, "depth": 0})
        groups.append({"name": name, "parent_class": owner[0] if owner else None, "nesting_depth": depth, "line_start": code.count("\n", 0, start) + 1, "line_end": code.count("\n", 0, end) + 1, "method_count": len(cc), "total_complexity": sum(cc), "max_method_complexity": max(cc, default=0)})
    lines = source.split("\n")
    return {"lines": len(lines), "comment_ratio": comment_ratio(lines, "//"), "functions": sorted(rows, key=lambda f: f["line_start"]), "classes": groups}

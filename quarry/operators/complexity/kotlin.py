"""Kotlin sources by a lexer and bracket matching, in one pass over tokens.

Comments and literals are blanked, brackets are paired, and each declaration is read forward from its keyword: type parameters, receiver and
name, parameters, body. Measures of a body are counts over its tokens. Functions of classes count once, unless ``twice`` asks for both lists.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from quarry.operators.complexity.common import blanked, comment_ratio, logical_operators

TOKEN = re.compile(r"->|&&|\|\||\w+|[{}()\[\]<>:;=.,@?\n]")
PAIRS = {"}": "{", ")": "("}
MODIFIERS = {"public", "private", "protected", "internal", "suspend", "inline", "infix", "operator", "override", "open", "final", "abstract", "sealed", "data", "enum", "annotation", "inner", "tailrec", "external", "value", "companion", "lateinit", "const"}
DECLARES = {"fun", "class", "object", "interface", "val", "var", "typealias"}
MAX_NESTING = 20


class Source:
    """Tokens of a source with their places, the partner of each bracket (-1 if none) and the line each token is on."""

    def __init__(self, text: str):
        self.code = blanked(text)
        found = [(m.group(), m.start()) for m in TOKEN.finditer(self.code)]
        self.word = [w for w, _ in found]
        self.at = [p for _, p in found]
        self.ends = [k for k, c in enumerate(self.code) if c == "\n"]
        self.mate = [-1] * len(found)
        open_at: dict[str, list[int]] = {"{": [], "(": []}
        for k, w in enumerate(self.word):
            if w in open_at:
                open_at[w].append(k)
            elif w in PAIRS and open_at[PAIRS[w]]:
                j = open_at[PAIRS[w]].pop()
                self.mate[j], self.mate[k] = k, j

    def line(self, k: int) -> int:
        return bisect_left(self.ends, self.at[k]) + 1

    def after(self, k: int) -> int:
        """The next token that is no line end."""
        k += 1
        while k < len(self.word) and self.word[k] == "\n":
            k += 1
        return k

    def get(self, k: int) -> str:
        return self.word[k] if 0 <= k < len(self.word) else ""

    def past_angles(self, k: int) -> int:
        """Behind type parameters that open at k, or k."""
        depth = 0
        while self.get(k) in "<" or depth and k < len(self.word):
            depth += {"<": 1, ">": -1}.get(self.get(k), 0)
            k = self.after(k)
            if not depth:
                break
        return k

    def modifiers(self, k: int) -> tuple[int, set[str]]:
        """The first token of a declaration whose keyword is at k, and its modifiers."""
        found, first, j = set(), k, k - 1
        while j >= 0 and (self.word[j] in MODIFIERS or self.word[j] == "\n"):
            if self.word[j] != "\n":
                found.add(self.word[j])
                first = j
            j -= 1
        return first, found


def problem(s: Source) -> str | None:
    """Why a source is no Kotlin, if it isn't."""
    for what, mark in (("brace", "{"), ("parenthesis", "(")):
        close = "}" if mark == "{" else ")"
        if s.word.count(mark) != s.word.count(close):
            return f"Syntax error: a {what} has no partner ({s.word.count(mark)} open, {s.word.count(close)} close)"
    for k, w in enumerate(s.word):
        if w == "fun" and s.get(k + 1)[:1].isidentifier() and s.get(k + 2) == "{":
            return f"Syntax error: function {s.word[k + 1]} has no parameters"
    return None


def measures(s: Source, lo: int, hi: int) -> tuple[int, int, int, int]:
    """(cyclomatic, cognitive, brace depth, lambdas outside ``when``) of the tokens lo:hi.

    An else-if counts as a decision and as a chained one. Every arrow inside a ``when`` is a branch of it. Cognitive cost goes by lines: a line
    with a flow keyword costs one and the nesting behind its braces, one that opens a lambda with parameters likewise and one more when nested.
    """
    cc = 1 + logical_operators(s.code[s.at[lo] : s.at[hi - 1] + 1]) if hi > lo else 1
    cost = depth = deepest = lambdas = whens = nesting = 0
    owner: list[bool] = []  # of each open brace, whether it is a ``when``'s
    flow = arrow = opens = False
    change = 0
    for k in range(lo, hi + 1):
        w = s.get(k) if k < hi else "\n"
        if w == "\n":
            nesting = min(max(0, nesting + change), MAX_NESTING)
            cost += (1 + nesting) * flow + (1 + nesting + (nesting > 0)) * (arrow and opens)
            flow = arrow = opens = False
            change = 0
        elif w in ("if", "for", "while"):
            flow = True
            if s.get(s.after(k)) == "(":
                cc += 1 + (w == "if" and k > lo and s.word[k - 1] == "else")
        elif w == "when":
            flow = True
        elif w == "do":
            cc += s.get(s.after(k)) == "{"
        elif w == "->":
            arrow = True
            cc += whens
        elif w == "{":
            before = s.mate[k - 1] - 1 if s.get(k - 1) == ")" and s.mate[k - 1] > 0 else k - 1
            is_when = s.get(before) == "when" or s.get(k - 1) == "when"
            inner = s.after(k)
            lambdas += not (whens or is_when) and (s.get(k - 2) == "." or s.get(inner) == "it" or s.get(inner + 1) == "->")
            owner.append(is_when)
            whens += is_when
            opens, change, depth = True, change + 1, depth + 1
            deepest = max(deepest, depth)
        elif w == "}":
            change, depth = change - 1, max(0, depth - 1)
            if owner:
                whens -= owner.pop()
    return cc, cost, min(deepest, MAX_NESTING), lambdas


def _body(s: Source, k: int) -> tuple[int, int] | None:
    """Tokens of the body that begins at k or behind a result type: a block, or an expression up to the end of its line."""
    while k < len(s.word):
        w = s.word[k]
        if w == "{":
            return (k, s.mate[k] + 1) if s.mate[k] > k else None
        if w == "=":
            end = s.after(k)
            while end < len(s.word) and s.word[end] not in ("\n", "}"):
                end = s.mate[end] + 1 if s.word[end] in "({" and s.mate[end] > end else end + 1
            return k, end
        if w in DECLARES or w == "}" or w == ";":
            return None
        k = s.mate[k] + 1 if w == "(" and s.mate[k] > k else k + 1
    return None


def _functions(s: Source) -> list[dict]:
    """Functions with bodies: token of the keyword, name, parameters, body, modifiers."""
    out = []
    for k, w in enumerate(s.word):
        if w != "fun":
            continue
        name = s.past_angles(s.after(k))
        parts = [s.get(name)]
        opening = s.past_angles(s.after(name))
        while s.get(opening) in (".", "?"):
            if s.get(opening) == ".":
                parts.append(s.get(opening + 1))
                opening += 1
            opening = s.past_angles(s.after(opening))
        if s.get(opening) != "(" or s.mate[opening] < 0 or not parts[0][:1].isidentifier():
            continue
        body = _body(s, s.mate[opening] + 1)
        if body:
            first, marks = s.modifiers(k)
            out.append({"key": k, "first": first, "name": ".".join(parts[-2:]), "parameters": _parameters(s, opening), "body": body, "suspend": "suspend" in marks})
    return out


def _parameters(s: Source, opening: int) -> int:
    k, depth, n = opening + 1, 0, 0
    some = False
    while k < s.mate[opening]:
        w = s.word[k]
        if w in "({" and s.mate[k] > k:
            k, some = s.mate[k], True
        elif w == "," and not depth:
            n += 1
            some = False
        elif w != "\n":
            some = True
            depth += {"<": 1, ">": -1}.get(w, 0)
        k += 1
    return n + some


def _types(s: Source) -> list[dict]:
    """Classes and objects: keyword, name, supertypes, body (or None), modifiers."""
    out = []
    for k, w in enumerate(s.word):
        if w not in ("class", "object") or s.get(k - 1) in (":", "."):
            continue
        name = s.after(k)
        if not s.get(name)[:1].isidentifier():
            continue
        first, marks = s.modifiers(k)
        at, supers, heads = s.past_angles(name + 1 if s.get(name + 1) != "\n" else s.after(name)), [], False
        while at < len(s.word) and s.word[at] not in ("{", "}", ";") and s.word[at] not in DECLARES | MODIFIERS - {"private", "internal", "protected", "public"}:
            if s.word[at] == "(" and s.mate[at] > at:
                at = s.mate[at]
            elif s.word[at] == ":":
                heads = True
            elif heads and s.word[at][:1].isidentifier():
                supers.append(s.word[at])
            at += 1
        body = (at, s.mate[at] + 1) if s.get(at) == "{" and s.mate[at] > at else None
        out.append({"key": k, "kind": w, "name": s.word[name], "supers": supers, "first": first, "marks": marks, "body": body, "end": body[1] - 1 if body else name})
    return out


def _class(s: Source, c: dict, functions: list[dict], types: list[dict]) -> dict:
    lo, hi = c["body"] or (c["key"], c["key"])
    inside = lambda xs: xs[bisect_right([x["key"] for x in xs], lo) : bisect_left([x["key"] for x in xs], hi)] if c["body"] else []
    cc = [measures(s, *f["body"])[0] for f in inside(functions)]
    total = sum(cc)
    if "data" in c["marks"]:
        total = max(1, total)
    if "sealed" in c["marks"]:
        total += max(1, sum(c["name"] in x["supers"] or "data" in x["marks"] for x in inside(types)))
    return {"name": c["name"], "parent_class": None, "nesting_depth": 0, "line_start": s.line(c["first"]), "line_end": s.line(c["end"]), "method_count": len(cc), "total_complexity": total, "max_method_complexity": max(cc, default=0)}


def _function(s: Source, f: dict) -> dict:
    lo, hi = f["body"]
    cc, cost, depth, lambdas = measures(s, lo, hi)
    more = 2 * f["suspend"]
    kind = "suspend_function" if f["suspend"] else "function"
    return {"name": f["name"], "type": kind, "complexity": cc + more + lambdas, "cognitive": cost + more, "line_start": s.line(f["first"]), "line_end": s.line(hi - 1), "parameters": f["parameters"], "depth": depth}


def analyze(source: str, twice: bool = False) -> dict:
    s = Source(source)
    if error := problem(s):
        return {"error": error}
    functions, types = _functions(s), _types(s)
    rows = [_function(s, f) for f in functions]
    if twice:
        owned = [f for c in types if c["kind"] == "class" and c["body"] for f in functions if c["body"][0] < f["key"] < c["body"][1]]
        rows += [_function(s, f) | {"type": "method"} for f in owned]
    else:
        rows = [*{(f["name"], f["line_start"]): f for f in rows}.values()]
    lines = source.split("\n")
    groups = [_class(s, c, functions, types) for c in types if c["kind"] == "class"]
    return {"lines": len(lines), "comment_ratio": comment_ratio(lines, "//"), "functions": sorted(rows, key=lambda f: -f["complexity"]), "classes": groups}

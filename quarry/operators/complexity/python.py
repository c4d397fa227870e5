"""Python sources by their syntax trees."""

from __future__ import annotations

import ast

from quarry.operators.complexity.common import comment_ratio

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
#: What makes an else branch count.
WEIGHTY = (ast.If, ast.While, ast.For, ast.Try, ast.With)


def cyclomatic(root: ast.AST, variant: str = "full") -> int:
    """1 and its decision points. The plain variant counts assertions and leaves out comprehensions and lambdas."""
    def points(x: ast.AST) -> int:
        match x:
            case ast.If() | ast.While() | ast.For() | ast.ExceptHandler() | ast.With():
                return 1
            case ast.BoolOp():
                return len(x.values) - 1
            case ast.Assert():
                return int(variant == "plain")
            case ast.Lambda():
                return int(variant == "full")
            case ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp() if variant == "full":
                return 1 + sum(len(g.ifs) for g in x.generators)
        return 0

    return 1 + sum(map(points, ast.walk(root)))


def cognitive(nodes, nesting: int = 0) -> int:
    """Flow breaks cost one and their nesting; an elif costs one; an else costs one only around further flow."""
    return sum(_cognitive(x, nesting) for x in nodes)


def _cognitive(x: ast.AST, nesting: int, chained: bool = False) -> int:
    match x:
        case ast.If():
            cost = 1 + (0 if chained else nesting) + cognitive(x.body, nesting + 1)
            if len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If):
                return cost + _cognitive(x.orelse[0], nesting, chained=True)
            return cost + any(isinstance(c, WEIGHTY) for c in x.orelse) + cognitive(x.orelse, nesting + 1)
        case ast.While() | ast.For():
            return 1 + nesting + cognitive([*x.body, *x.orelse], nesting + 1)
        case ast.ExceptHandler():
            return 1 + nesting + cognitive(x.body, nesting + 1)
        case ast.With():
            return 1 + cognitive(x.body, nesting + 1)
        case ast.BoolOp():
            return len(x.values) - 1
    return cognitive(ast.iter_child_nodes(x), nesting)


def cognitive_plain(x: ast.AST, nesting: int = 0) -> int:
    """Another count: an elif costs as an if of its level does, and operators inside operators count too."""
    inner, cost, children = nesting, 0, None
    if isinstance(x, (ast.If, ast.While, ast.For)):
        chain = len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If)
        cost = 1 + nesting + sum(cognitive_plain(c, nesting + 1) for c in x.body) + (not chain and any(isinstance(c, WEIGHTY) for c in x.orelse))
        inner, children = nesting + (not chain), x.orelse
    elif isinstance(x, ast.ExceptHandler):
        cost, inner = 1 + nesting, nesting + 1
    elif isinstance(x, ast.BoolOp):
        cost = len(x.values) - 1
    elif isinstance(x, ast.With):
        cost, inner = 1, nesting + 1
    return cost + sum(cognitive_plain(c, inner) for c in (ast.iter_child_nodes(x) if children is None else children))


def indentation_depth(source: str, first: int, last: int) -> int:
    """Deepest indentation of the lines, in steps of four spaces, from that of the first."""
    lines = [x for x in source.split("\n")[first - 1 : last] if x.strip()]
    level = lambda x: (len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip())) // 4
    return max((level(x) for x in lines), default=0) - (level(lines[0]) if lines else 0)


def _function(f: ast.AST, depth: int, in_class: bool, variant: str = "full") -> dict:
    inside = [*ast.walk(f)]
    is_async = isinstance(f, ast.AsyncFunctionDef)
    of = lambda *kinds: sum(isinstance(x, kinds) for x in inside)
    if variant == "plain":
        cc, cost = 1 if is_async else cyclomatic(f, "plain"), cognitive_plain(f)
    else:
        cc, cost = cyclomatic(f) + is_async, cognitive(f.body) + is_async
    return {
        "name": f.name, "type": ("async_" if is_async else "") + ("method" if in_class else "function"), "complexity": cc, "cognitive": cost,
        "line_start": f.lineno, "line_end": f.end_lineno or f.lineno, "parameters": len(f.args.args), "depth": depth, "decorator_count": len(f.decorator_list),
        "exception_handlers_count": of(ast.ExceptHandler), "lambda_count": of(ast.Lambda, *COMPREHENSIONS), "uses_context_managers": of(ast.With) > 0, "is_generator": of(ast.Yield, ast.YieldFrom) > 0,
        "uses_walrus_operator": of(ast.NamedExpr) > 0, "uses_pattern_matching": of(ast.Match) > 0, "has_type_annotations": any(a.annotation for a in f.args.args) or f.returns is not None,
        "is_recursive": any(isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == f.name for x in inside),
    }


def analyze(source: str, last_of_name: bool = False, variant: str = "full", indentation: bool = False) -> dict:
    """``last_of_name``: of functions with one name only the last counts. ``variant`` "plain": the measures without comprehensions, lambdas and
    asynchronous functions. ``indentation``: depth is that of a function's deepest line instead of the functions around it."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"error": f"Syntax error: {e}"}
    found: list[dict] = []
    groups: list[dict] = []

    def walk(node: ast.AST, depth: int, owners: tuple[str, ...], parent_is_class: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, FUNCTIONS):
                found.append(_function(x, depth, bool(owners), variant))
                walk(x, depth + 1, owners, False)
            elif isinstance(x, ast.ClassDef):
                own = [_function(m, 0, True, variant) for m in x.body if isinstance(m, FUNCTIONS)]
                cc = [m["complexity"] for m in own]
                groups.append({"name": x.name, "parent_class": owners[-1] if owners else None, "nesting_depth": len(owners), "line_start": x.lineno, "line_end": x.end_lineno or x.lineno, "method_count": len(own), "total_complexity": sum(cc), "max_method_complexity": max(cc, default=0)})
                walk(x, depth, (*owners, x.name), True)
            else:
                walk(x, depth, owners, parent_is_class)

    try:
        walk(tree, 0, (), False)
    except RecursionError:
        return {"error": "Syntax error: nested too deeply"}
    if indentation:
        found = [f | {"depth": indentation_depth(source, f["line_start"], f["line_end"])} for f in found]
    if last_of_name:
        found = [*{f["name"]: f for f in found}.values()]
    lines = source.split("\n")
    return {"lines": len(lines), "comment_ratio": comment_ratio(lines), "functions": sorted(found, key=lambda f: f["line_start"]), "classes": groups}

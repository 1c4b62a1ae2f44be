"""Programs from Python: expressions, facts and actions without program text.

    e = Engine(spark)
    x, y, z = vars("x y z")
    edge, path = relation(e, "edge", "i64 i64"), relation(e, "path", "i64 i64")
    rule(e, [edge(x, y)], [path(x, y)])
    rule(e, [path(x, y), edge(y, z)], [path(x, z)])
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from rulespark.engine import Engine
from rulespark.functions.sorts import BOOL, F64, I64, STRING
from rulespark.plans.rules import Rule
from rulespark.plans.syntax import Call, Lit, Var


def vars(names: str) -> list[Var]:  # noqa: A001
    return [Var(n) for n in names.split()]


def expr(x: Any) -> Any:
    """A Python value as an expression."""
    match x:
        case bool():
            return Lit(x, BOOL)
        case int():
            return Lit(x, I64)
        case float():
            return Lit(x, F64)
        case str():
            return Lit(x, STRING)
    return x


def op(name: str) -> Callable[..., Call]:
    """A function, constructor, relation or primitive, to be called in expressions."""
    return lambda *args: Call(name, tuple(map(expr, args)))


def sort(engine: Engine, name: str, kind: str = "", *of: str) -> str:
    engine.declare_sort(name, (kind, list(of)) if kind else None)
    return name


def constructor(engine: Engine, name: str, takes: str, out: str, cost: int = 1, extractable: bool = True) -> Callable[..., Call]:
    engine.declare(name, takes.split(), out, "constructor", None, cost, extractable)
    return op(name)


def relation(engine: Engine, name: str, takes: str) -> Callable[..., Call]:
    engine.relation(name, takes.split())
    return op(name)


def function(engine: Engine, name: str, takes: str, out: str, merge: Any = None) -> Callable[..., Call]:
    """merge: an expression over the variables old and new; None is an error if values differ."""
    engine.declare(name, takes.split(), out, "custom", merge)
    return op(name)


def eq(a: Any, b: Any) -> tuple:
    return "=", expr(a), expr(b)


def _facts(facts: list) -> list[tuple]:
    return [f if isinstance(f, tuple) else ("holds", f) for f in facts]


def _actions(actions: list) -> list[tuple]:
    return [a if isinstance(a, tuple) else ("do", a) for a in actions]


def let(name: str, e: Any) -> tuple:
    return "let", name, expr(e)


def set_(call: Call, value: Any) -> tuple:
    return "set", call.op, list(call.args), expr(value)


def union(a: Any, b: Any) -> tuple:
    return "union", expr(a), expr(b)


def delete(call: Call) -> tuple:
    return "delete", call.op, list(call.args)


def subsume(call: Call) -> tuple:
    return "subsume", call.op, list(call.args)


def panic(message: str) -> tuple:
    return "panic", message


def rule(engine: Engine, facts: list, actions: list, name: str = "", ruleset: str = "", **options: bool) -> Rule:
    return engine.add_rule(_facts(facts), _actions(actions), name, ruleset, **options)


def rewrite(engine: Engine, left: Call, right: Any, when: list | None = None, ruleset: str = "", subsumes: bool = False) -> Rule:
    v = Var("_rewritten")
    actions = [union(v, right), *([subsume(left)] if subsumes else [])]
    return rule(engine, [eq(v, left), *(when or [])], actions, ruleset=ruleset)


def act(engine: Engine, *actions: Any) -> None:
    """Run actions now."""
    for a in _actions(list(actions)):
        engine.action(a)


def holds(engine: Engine, *facts: Any) -> bool:
    return engine.check(_facts(list(facts)))

"""Function values: made with some arguments, applied or mapped later.

A value is the target's name and its first arguments as JSON. Where one is applied, each target that the program has ever
named for that sort is a branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.primitives import multiset_sum, null
from rulespark.functions.sorts import Sort
from rulespark.plans.syntax import ProgramError


def overload(engine, name: str, takes: tuple[Sort, ...], out: Sort):
    for p in engine.prims.get(name, ()):
        if not p.same and p.out == out and (p.args == takes or p.variadic and len(takes) % len(p.args) == 0 and p.args * (len(takes) // len(p.args)) == takes):
            return p
    return None


def target_sorts(engine, name: str, given: int, sort: Sort) -> tuple[Sort, ...]:
    """Sorts of the arguments that are given when a function value of this sort is made from a target."""
    if (t := engine.tables.get(name)) is not None:
        if t.takes[given:] != sort.takes or t.out != sort.of[-1]:
            raise ProgramError(f"{name} doesn't fit {sort}")
        return t.takes[:given]
    for p in engine.prims.get(name, ()):
        n = given + len(sort.takes)
        takes = p.args if not p.variadic else p.args * (n // max(1, len(p.args)))
        if not p.same and len(takes) == n and takes[given:] == sort.takes and p.out == sort.of[-1]:
            return takes[:given]
    raise ProgramError(f"{name} doesn't fit {sort}")


def apply_functional(engine, e, args: list[Column], builder) -> Column:
    """The value of a call that makes, applies or maps a function; builder: where new terms are staged (None in queries)."""
    if e.name == "unstable-fn":
        name = e.args[0].value
        sorts = tuple(a.sort for a in e.args[1:])
        engine.state.setdefault(("targets", e.sort.name), {})[(name, sorts)] = None
        own = F.to_json(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args[1:])])) if sorts else F.lit("{}")
        return F.struct(F.lit(name).alias("name"), own.alias("args"))
    f, s = args[0], e.args[0].sort
    targets = list(engine.state.get(("targets", s.name), {}))

    def call(*xs: Column) -> Column:
        out = null(s.of[-1].ddl)
        for name, sorts in targets:
            given = F.from_json(f["args"], ", ".join(f"a{i} {t.ddl}" for i, t in enumerate(sorts))) if sorts else None
            every = [*[given[f"a{i}"] for i in range(len(sorts))], *xs]
            if (p := overload(engine, name, (*sorts, *s.takes), s.of[-1])) is not None:
                value = p.make(*every)
            elif (t := engine.tables.get(name)) is not None and t.kind == "constructor":
                value = F.xxhash64(F.lit(name), *every)
                if builder is None:
                    raise ProgramError(f"{name}: a query can't make terms")
            else:
                raise ProgramError(f"{name}: functions can't be applied as values")
            out = F.when(f["name"] == name, value).otherwise(out)
        return out

    def maker(name: str, sorts: tuple[Sort, ...]):
        given = F.from_json(f["args"], ", ".join(f"a{i} {x.ddl}" for i, x in enumerate(sorts))) if sorts else None

        def row(x: Column) -> Column:
            every = [*[given[f"a{i}"] for i in range(len(sorts))], x]
            return F.struct(*[a.alias(f"c{i}") for i, a in enumerate(every)], F.xxhash64(F.lit(name), *every).alias("out"))

        return row

    def stage(values: Column) -> None:
        """Stage the terms that constructors make of the elements of an array of arguments."""
        for name, sorts in targets:
            t = engine.tables.get(name)
            if t is None or t.kind != "constructor":
                continue
            rows = F.transform(values, maker(name, sorts))
            builder.out.append(("terms", name, builder.keep(F.when(f["name"] == name, rows))))

    if e.name == "unstable-app":
        if len(args) == 2 and builder is not None:
            stage(F.array(args[1]))
        elif builder is not None:
            for name, sorts in targets:
                t = engine.tables.get(name)
                if t is not None and t.kind == "constructor":
                    given = F.from_json(f["args"], ", ".join(f"a{i} {x.ddl}" for i, x in enumerate(sorts))) if sorts else None
                    every = [*[given[f"a{i}"] for i in range(len(sorts))], *args[1:]]
                    row = F.struct(*[a.alias(f"c{i}") for i, a in enumerate(every)], F.xxhash64(F.lit(name), *every).alias("out"))
                    builder.out.append(("terms", name, builder.keep(F.when(f["name"] == name, F.array(row)))))
        return call(*args[1:])
    if e.name == "unstable-vec-map":
        if builder is not None:
            stage(args[1])
        return F.transform(args[1], lambda x: call(x))
    values = F.transform(args[1], lambda p: p["v"]) if "reduce" not in e.name else None
    if builder is not None and values is not None:
        stage(values)
    if e.name == "unstable-multiset-map":
        return multiset_sum(F.transform(args[1], lambda p: F.struct(call(p["v"]).alias("v"), p["n"].alias("n"))))
    if e.name == "unstable-multiset-flat-map":
        return multiset_sum(F.flatten(F.transform(args[1], lambda p: F.transform(call(p["v"]), lambda q: F.struct(q["v"].alias("v"), (q["n"] * p["n"]).alias("n"))))))
    if e.name in ("unstable-multiset-filter", "unstable-multiset-filter-not"):
        holds = lambda p: F.coalesce(call(p["v"]).cast("boolean"), F.lit(False))
        return F.filter(args[1], holds if e.name == "unstable-multiset-filter" else lambda p: ~holds(p))
    # reduce: the first element starts the fold; the initial value stands for an empty multiset only
    flat = F.flatten(F.transform(args[2], lambda p: F.array_repeat(p["v"], p["n"].cast("int"))))
    return F.coalesce(F.aggregate(F.slice(flat, 2, 1 << 30), F.get(flat, F.lit(0)), lambda a, x: call(a, x)), args[1])

"""Extraction: for each id the cheapest term of its class, by relaxation over the rows of constructors.

A row costs its constructor's cost and its arguments': an id's best cost so far, 1 for a base value, the sum of its
elements for a container. Each round sums all rows whose arguments have costs, and takes the least for each id; rounds end
when none improves. An id keeps the row that gave its last improvement; that row's ids had their costs before, so
following rows always ends, also through constructors of cost 0.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.functions.sorts import Sort
from rulespark.operators.storage import LOCAL_ROWS, settle
from rulespark.plans.syntax import ProgramError, Var
from rulespark.plans.typing import Typer

MOST = 2**63 - 1


def plus(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(MOST))


def size_cost(c: Column, s: Sort) -> Column | None:
    """Cost of a value without ids; None if it has some."""
    if s.has_ids:
        return None
    long = lambda x: x.cast("long")
    add = lambda a, x: plus(a, x)
    zero = F.lit(0).cast("long")
    match s.kind:
        case "base" | "UnstableFn":
            return F.lit(1).cast("long")
        case "Vec" | "Set":
            return F.aggregate(c, zero, lambda a, x: add(a, size_cost(x, s.of[0])))
        case "Map":
            return F.aggregate(c, zero, lambda a, p: add(a, plus(size_cost(p["k"], s.of[0]), size_cost(p["v"], s.of[1]))))
        case "MultiSet":
            return F.aggregate(c, zero, lambda a, p: add(a, long(size_cost(p["v"], s.of[0]) * p["n"])))
        case "Pair":
            return plus(size_cost(c["first"], s.of[0]), size_cost(c["second"], s.of[1]))
    raise ValueError(s.kind)


def ids_in(c: Column, s: Sort) -> Column:
    """All ids in a container, as an array in which they repeat as often as they count."""
    none = F.array().cast("array<bigint>")
    if s.kind == "eq":
        return F.array(c)
    if not s.has_ids:
        return none
    match s.kind:
        case "Vec" | "Set":
            return F.flatten(F.transform(c, lambda x: ids_in(x, s.of[0])))
        case "Map":
            return F.flatten(F.transform(c, lambda p: F.concat(ids_in(p["k"], s.of[0]), ids_in(p["v"], s.of[1]))))
        case "MultiSet":
            return F.flatten(F.transform(c, lambda p: F.flatten(F.array_repeat(ids_in(p["v"], s.of[0]), p["n"].cast("int")))))
        case "Pair":
            return F.concat(ids_in(c["first"], s.of[0]), ids_in(c["second"], s.of[1]))
    return none


def nodes(engine) -> dict[str, DataFrame]:
    """Rows of each extractable constructor: keys and out."""
    out = {}
    for t in engine.tables.values():
        if t.kind == "constructor" and t.extractable and t.n:
            out[t.name] = t.df(engine.spark).where(~F.col("sub")).select(*t.keys, "out")
    return out


def priced(engine, name: str, df: DataFrame, best: DataFrame, small: bool, model=None) -> DataFrame:
    """Rows of a constructor whose ids all have costs, with their cost."""
    t = engine.tables[name]
    cost = (F.lit(t.cost) if model is None else model(name, t.cost, [F.col(c) for c in t.keys])).cast("long")
    best = best.select("id", F.col("cost").alias("price"))
    best = F.broadcast(best) if small else best
    for c, s in zip(t.keys, t.takes, strict=True):
        if s.kind == "eq":
            df = df.join(best.select(F.col("id").alias(c), F.col("price").alias(f"p_{c}")), c)
            cost = plus(cost, F.col(f"p_{c}"))
        elif not s.has_ids:
            cost = plus(cost, size_cost(F.col(c), s))
        else:  # prices of a container's elements, summed by row; a row with an element without price waits
            one = df.withColumn("row", F.xxhash64(*t.keys, "out")).withColumn("e", F.explode_outer(ids_in(F.col(c), s)))
            sums = one.join(best.select(F.col("id").alias("e"), "price"), "e", "left").groupBy("row").agg(F.sum("price").alias(f"p_{c}"), F.count("price").alias("known"), F.count("e").alias("all"))
            df = df.withColumn("row", F.xxhash64(*t.keys, "out")).join(sums.where("known = all").select("row", f"p_{c}"), "row").drop("row")
            cost = plus(cost, F.coalesce(F.col(f"p_{c}"), F.lit(0)))
    return df.select(F.col("out").alias("id"), cost.alias("cost"), F.lit(name).alias("fn"), F.to_json(F.struct(*t.keys) if t.keys else F.struct(F.lit(0).alias("_"))).alias("args"))


def costs(engine, model=None) -> DataFrame:
    """(id, cost, fn, args as JSON) of the cheapest row of each id that has a term.

    model: a function of a constructor's name, declared cost and argument columns that gives what a row costs beside its
    arguments, as a column that is 0 or more.
    """
    engine.flush()
    tables = nodes(engine)
    best = engine.spark.createDataFrame([], "id long, cost long, fn string, args string")
    n = 0
    while tables:
        found = reduce(DataFrame.unionByName, [priced(engine, f, df, best, n <= 100_000, model) for f, df in tables.items()])
        least = found.groupBy("id").agg(F.min(F.struct("cost", "fn", "args")).alias("x")).select("id", "x.*")
        old = best.select("id", F.col("cost").alias("was"), F.col("fn").alias("wfn"), F.col("args").alias("wargs"))
        both = least.join(old, "id", "left").withColumn("better", F.col("was").isNull() | (F.col("cost") < F.col("was")))
        kept = [F.when(F.col("better"), F.col(c)).otherwise(F.col(w)).alias(c) for c, w in (("cost", "was"), ("fn", "wfn"), ("args", "wargs"))]
        done, n = settle(both.select("id", *kept, "better"), expect_large=n > LOCAL_ROWS)
        more = not done.where("better").isEmpty()
        best = done.drop("better")
        if not more:
            break
    return best


def text_of(v: Any, s: Sort, term) -> str:
    """A value as text; term: an id's text."""
    match s.kind:
        case "eq":
            return term(v)
        case "Vec" | "Set":
            return f"({s.kind.lower()}-of{''.join(' ' + text_of(x, s.of[0], term) for x in v)})" if v else f"({s.kind.lower()}-empty)"
        case "Map":
            out = "(map-empty)"
            for p in v:
                out = f"(map-insert {out} {text_of(p['k'], s.of[0], term)} {text_of(p['v'], s.of[1], term)})"
            return out
        case "MultiSet":
            return "(multiset-of" + "".join((" " + text_of(p["v"], s.of[0], term)) * p["n"] for p in v) + ")"
        case "Pair":
            return f"(pair {text_of(v['first'], s.of[0], term)} {text_of(v['second'], s.of[1], term)})"
        case "UnstableFn":
            return f'(unstable-fn "{v["name"]}")'
    match s.name:
        case "String":
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
        case "bool":
            return "true" if v else "false"
        case "Unit":
            return "()"
        case "f64":
            return f64_text(float(v))
        case "BigInt":
            return f'(from-string "{v}")'
        case "BigRat":
            n, d = v.split("/")
            return f'(bigrat (from-string "{n}") (from-string "{d}"))'
    return str(v)


def f64_text(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x != 0 and (abs(x) >= 1e16 or abs(x) < 1e-4):
        mantissa, exp = f"{x!r}".split("e") if "e" in repr(x) else f"{x:e}".split("e")
        return f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa else mantissa}e{int(exp)}"
    out = f"{x!r}"
    if "e" in out:
        from decimal import Decimal

        out = f"{Decimal(out):f}"
    return out if "." in out else f"{out}.0"


class Terms:
    """Texts of ids, from the cheapest rows, which are fetched as they are needed."""

    def __init__(self, engine, best: DataFrame):
        self.engine, self.best, self.rows, self.known = engine, best, {}, {}

    def fetch(self, ids: set[int]) -> None:
        """The rows reachable from ids, level by level; a level is a query with a list of ids."""
        want = {i for i in ids if i not in self.rows}
        while want:
            found = self.best.where(F.col("id").isin(*want)).collect()
            self.rows |= {r.id: (r.fn, json.loads(r.args)) for r in found}
            if missing := want - set(self.rows):
                raise ProgramError(f"no term: {len(missing)} ids can't be extracted")
            want = {i for r in found for i in self.children(r.fn, json.loads(r.args)) if i not in self.rows}

    def children(self, fn: str, args: dict) -> list[int]:
        t = self.engine.tables[fn]
        return [i for c, s in zip(t.keys, t.takes, strict=True) for i in _ids(args.get(c), s)]

    def text(self, id_: int) -> str:
        self.fetch({id_})
        stack = [id_]
        while stack:  # without recursion: terms can be deep
            top = stack[-1]
            fn, args = self.rows[top]
            if left := [i for i in self.children(fn, args) if i not in self.known]:
                stack += left
                continue
            t = self.engine.tables[fn]
            own = "".join(" " + text_of(args.get(c), s, self.known.__getitem__) for c, s in zip(t.keys, t.takes, strict=True))
            self.known[top] = f"({fn}{own})"
            stack.pop()
        return self.known[id_]


def _ids(v: Any, s: Sort) -> list[int]:
    if s.kind == "eq":
        return [v]
    if not s.has_ids or v is None:
        return []
    match s.kind:
        case "Vec" | "Set":
            return [i for x in v for i in _ids(x, s.of[0])]
        case "Map":
            return [i for p in v for i in _ids(p["k"], s.of[0]) + _ids(p["v"], s.of[1])]
        case "MultiSet":
            return [i for p in v for i in _ids(p["v"], s.of[0])]
        case "Pair":
            return _ids(v["first"], s.of[0]) + _ids(v["second"], s.of[1])
    return []


def value_of(engine, e: Any) -> tuple[Any, Sort]:
    """An expression's value, as a row's JSON holds it, and its sort. Terms that don't exist are made."""
    typer = Typer(engine)
    v = typer.visit(e)
    typer.solve()
    sort = typer.typed(v).sort
    name = f"$extract{engine.ts}"
    engine.action(("let", name, e))
    engine.flush()
    row = engine.tables[name].df(engine.spark).select(F.to_json(F.struct(F.col("out").alias("v"))).alias("j")).head()
    del engine.tables[name]
    return json.loads(row.j).get("v"), sort


def extract(engine, e: Any, n: int, model=None) -> list[tuple[int, str]]:
    """(cost, text) of the cheapest term equal to e; with n, of the n cheapest rows of its class."""
    if isinstance(e, str):
        e = Var(e)
    value, sort = value_of(engine, e)
    best = costs(engine, model)
    terms = Terms(engine, best)
    if n and sort.kind == "eq":
        tables = {f: df.where(F.col("out") == value) for f, df in nodes(engine).items()}
        if not tables:
            return []
        found = reduce(DataFrame.unionByName, [priced(engine, f, df, best, False, model) for f, df in tables.items()]).orderBy("cost", "fn", "args").limit(n).collect()
        out = []
        for r in found:
            args, t = json.loads(r.args), engine.tables[r.fn]
            for i in terms.children(r.fn, args):
                terms.text(i)
            out.append((r.cost, f"({r.fn}" + "".join(" " + text_of(args.get(c), s, terms.known.__getitem__) for c, s in zip(t.keys, t.takes, strict=True)) + ")"))
        return out
    ids = _ids(value, sort)
    for i in ids:
        terms.text(i)
    prices = {r.id: r.cost for r in best.where(F.col("id").isin(*ids)).select("id", "cost").collect()} if ids else {}
    cost = prices[value] if sort.kind == "eq" else sum(prices[i] for i in ids) if ids else 1
    return [(cost, text_of(value, sort, terms.known.__getitem__))]

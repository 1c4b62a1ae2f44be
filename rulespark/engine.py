"""The engine: tables, rules, schedules, and the loop that runs rules to a fixpoint.

In an iteration all rules match against the same tables; what they stage is applied afterwards: deletions, then rows with
merges, then flags, then unions, whose consequences (rebuilding) are followed until nothing changes. A rule's matches are
seminaive: of n atoms, the i-th variant takes rows changed since the rule last ran for atom i, older rows for those before
it, and all rows for those after; a variant without changed rows costs no job.

Ids of terms are 64-bit hashes of their constructor and arguments, so rules agree on new terms without coordination, and a
task that runs again makes the same ids. A union maps ids to the least of their class. Rows that a union changes get the
new id, and rows of a constructor that meet with different ids unite those (congruence).
"""

from __future__ import annotations

import copy
import json
import struct as _struct
import time
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions.functionals import apply_functional, target_sorts
from rulespark.functions.primitives import Prim, containers, multiset_sum, scalars
from rulespark.functions.sorts import BASE_SORTS, BOOL, F64, I64, KINDS, STRING, UNIT, Sort
from rulespark.operators.components import components, forest
from rulespark.operators.storage import LOCAL_ROWS, settle, written
from rulespark.operators.tables import BROADCAST_ROWS, Part, Table
from rulespark.plans.rules import SPREAD_ROWS, Rule, columns, flatten, literal, plan, scan
from rulespark.plans.separable import Separable, following, separable
from rulespark.plans.syntax import Call, Command, Lit, Parser, ProgramError, Var
from rulespark.plans.typing import FUNCTIONALS, Typed, Typer

#: Edges of a union that are solved on the driver; more go through distributed components.
LOCAL_EDGES = 50_000
#: Changes of a separable relation beyond this are followed by value, if a value has this many rows on average.
FOLLOW_ROWS, FOLLOW_SHARE = BROADCAST_ROWS, 16
SORT_OF = {"bigint": I64, "int": I64, "smallint": I64, "double": F64, "float": F64, "string": STRING, "boolean": BOOL}


def term_id(name: str, values: Iterable[tuple[Any, Sort]]) -> int:
    """The id of a term, as F.xxhash64(name, arguments) gives it."""
    h = xxhash.xxh64_intdigest(name.encode(), 42)
    for v, s in values:
        if s.kind == "eq" or s == I64:
            h = xxhash.xxh64_intdigest(_struct.pack("<q", v), h)
        elif s == F64:
            h = xxhash.xxh64_intdigest(_struct.pack("<d", 0.0 if v == 0 else v), h)
        elif s == STRING:
            h = xxhash.xxh64_intdigest(v.encode(), h)
        else:
            raise KeyError(s.name)
    return h - (1 << 64) if h >= 1 << 63 else h


class Stage:
    """What the rules of an iteration want: rows, deletions, flags, pairs of ids, and errors."""

    def __init__(self) -> None:
        self.rows: dict[str, list[DataFrame]] = {}
        self.deletes: dict[str, list[DataFrame]] = {}
        self.subsumes: dict[str, list[DataFrame]] = {}
        self.unions: list[DataFrame] = []
        self.panics: list[tuple[DataFrame, str]] = []
        # by relation, for each frame of rows: its literals by position, and whether its rows are many and never repeat
        self.known: dict[str, list[tuple[dict[int, Any], bool]]] = {}
        # functions with a frame of rows whose keys don't repeat, and constructors whose rows take ids from unions
        self.unique: set[str] = set()
        self.given: set[str] = set()


class Builder:
    """Evaluates the actions of a head over the matches of a body."""

    def __init__(self, engine: Engine, df: DataFrame, env: dict[str, Column]):
        self.engine, self.df, self.env, self.n = engine, df, env, 0
        self.out: list[tuple] = []
        self.cheap = False  # whether matches are a scan of a table, which costs less than to write them
        self.apart: set[str] | None = None  # flat variables that tell matches apart, if some are known to
        self.flat: dict[str, str] = {}  # flat variables by variables of the body, and then by columns

    def keep(self, value: Column) -> str:
        self.n += 1
        name = f"t{self.n}"
        self.df = self.df.withColumn(name, value)
        return name

    def argument(self, e: Typed) -> str:
        name = self.keep(self.value(e))
        if e.what == "var" and e.name in self.flat:
            self.flat[name] = self.flat[e.name]
        return name

    def value(self, e: Typed) -> Column:
        if e.what == "lit":
            return literal(e)
        if e.what == "var":
            return self.env[e.name]
        if e.what == "prim":
            args = [self.value(a) for a in e.args]
            if e.name in FUNCTIONALS:
                return self.checked(apply_functional(self.engine, e, args, self), e)
            if e.prim.unions is not None:
                self.out.append(("pairs", self.keep(e.prim.unions(*args))))
            value = e.prim.make(*args)
            return self.checked(value, e) if e.prim.partial else value
        t = self.engine.tables[e.name]
        names = [self.argument(a) for a in e.args]
        if t.kind == "relation":
            self.out.append(("row", t.name, names, None))
            return F.lit(True)
        if t.kind == "constructor":
            return self.term(t, names)
        self.cheap = False
        own = t.df(self.engine.spark).select(*[F.col(c).alias(n) for c, n in zip(t.keys, names, strict=True)], F.col("out").alias(f"o{self.n}"))
        self.df = self.df.join(own, names, "left") if names else self.df.crossJoin(own) if t.n else self.df.withColumn(f"o{self.n}", F.lit(None).cast(t.out.ddl))
        return self.checked(F.col(f"o{self.n}"), e, "lookup")

    def term(self, t: Table, names: list[str]) -> Column:
        made = F.xxhash64(F.lit(t.name), *[F.col(n) for n in names])
        if t.moved and t.n:  # an older row may have another id by now
            self.n, self.cheap = self.n + 1, False
            own = t.df(self.engine.spark).select(*[F.col(c).alias(n) for c, n in zip(t.keys, names, strict=True)], F.col("out").alias(f"o{self.n}"))
            self.df = self.df.join(F.broadcast(own) if t.n <= BROADCAST_ROWS else own, names, "left") if names else self.df.crossJoin(own)
            made = F.coalesce(F.col(f"o{self.n}"), made)
        id_ = self.keep(made)
        self.out.append(("row", t.name, names, id_))
        return F.col(id_)

    def given(self, x: Typed, y: Typed) -> bool:
        """A union of a variable and a term: the term's row takes the variable's id, so a new term needs no union. If it has
        another id, or other rows give it one, the table's insertion unites these."""
        for v, e in ((x, y), (y, x)):
            if v.what == "var" and e.what == "table" and e.args and self.engine.tables[e.name].kind == "constructor":
                names = [self.argument(a) for a in e.args]
                self.out.append(("given", e.name, names, self.keep(self.value(v))))
                return True
        return False

    def checked(self, value: Column, e: Typed, what: str = "call of primitive") -> Column:
        return F.when(value.isNull(), F.raise_error(F.lit(f"{what} {e.name} failed")).cast(e.sort.ddl)).otherwise(value)

    def run(self, head: list[tuple]) -> None:
        for a in head:
            match a:
                case ("let", name, e):
                    self.env[name] = F.col(self.keep(self.value(e)))
                    self.flat.pop(name, None)
                case ("do", e):
                    value = self.value(e)
                    if e.what == "prim":
                        self.out.append(("value", self.keep(value)))
                case ("set", f, args, e):
                    names = [self.keep(self.value(x)) for x in args]
                    value = self.value(e)
                    self.out.append(("row", f, names, None if self.engine.tables[f].kind == "relation" else self.keep(value)))
                case ("union", x, y):
                    if not self.given(x, y):
                        self.out.append(("union", self.keep(self.value(x)), self.keep(self.value(y))))
                case ("delete" | "subsume", f, args):
                    names = [self.keep(self.value(x)) for x in args]
                    if a[0] == "subsume":
                        t = self.engine.tables[f]
                        self.term(t, names) if t.kind == "constructor" else self.out.append(("row", f, names, None))
                    self.out.append((a[0], f, names))
                case ("panic", message):
                    self.out.append(("panic", message))

    def stage(self, stage: Stage) -> None:
        """Stage what the actions said. Matches that several of them use are computed once."""
        df = self.df
        if len(self.out) > 1 and not self.cheap:
            df, n = self.engine.settled(df)
            if not n:
                return
        for o in self.out:
            match o:
                case ("row" | "given" as what, f, names, out):
                    t = self.engine.tables[f]
                    if self.apart is not None and self.apart <= {self.flat.get(n) for n in names}:
                        stage.unique.add(f)
                    if what == "given":
                        stage.given.add(f)
                    stage.rows.setdefault(f, []).append(df.select(*[F.col(n).alias(c) for n, c in zip(names, t.keys, strict=True)], *([F.col(out).alias("out")] if out else [])))
                case ("union", a, b):
                    stage.unions.append(df.select(F.col(a).alias("a"), F.col(b).alias("b")))
                case ("pairs", p):
                    stage.unions.append(df.select(F.explode(p).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b")))
                case ("terms", f, name):
                    stage.rows.setdefault(f, []).append(df.select(F.explode(name).alias("x")).select("x.*"))
                case ("delete", f, names):
                    stage.deletes.setdefault(f, []).append(df.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)]))
                case ("subsume", f, names):
                    stage.subsumes.setdefault(f, []).append(df.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)]))
                case ("panic", message):
                    stage.panics.append((df, message))
                case ("value", name):  # evaluated for its errors
                    df.where(F.col(name).isNull()).isEmpty()


class Engine:
    """A database of functions, with rules over them. seminaive=False matches all rows in each iteration."""

    def __init__(self, spark: SparkSession, fact_directory: str = "", seminaive: bool = True):
        self.spark, self.fact_directory, self.seminaive = spark, fact_directory, seminaive
        self.parser = Parser()
        self.sorts: dict[str, Sort] = dict(BASE_SORTS)
        self.tables: dict[str, Table] = {}
        self.prims: dict[str, list[Prim]] = {}
        self.rules: list[Rule] = []
        self.rulesets: dict[str, list[str] | None] = {"": None}
        self.outputs: list[str] = []
        self.report: dict[str, dict[str, float]] = {}
        self.commands: dict[str, Callable] = {}
        self.state: dict[str, Any] = {}
        self.ts = 1
        self.moved_ids: DataFrame | None = None  # (id, leader)
        self.stack: list[tuple] = []
        self.largest = 0  # rows of the largest table that this iteration's rules read
        self.pending = Pending(self)
        self.one_row = spark.range(1)
        for p in scalars():
            self.register(p)

    # ---- declarations

    def register(self, prim: Prim) -> None:
        """Add a primitive: a function on columns, or anything that gives a Column, such as a pandas UDF."""
        self.prims.setdefault(prim.name, []).append(prim)

    def declare_sort(self, name: str, of: tuple[str, list] | None = None, unionable: bool = True) -> Sort:
        self.new_name(name)
        if of is None:
            sort = Sort(name, "eq", unionable=unionable)
        else:
            kind, args = of
            if kind not in KINDS:
                raise ProgramError(f"no container {kind}")
            if kind == "UnstableFn":
                takes = tuple(map(self.sort, args[0]))
                sort = Sort(name, kind, (self.sort(args[1]),), takes=takes)
            else:
                if len(args) != KINDS[kind]:
                    raise ProgramError(f"{kind} takes {KINDS[kind]} sorts")
                sort = Sort(name, kind, tuple(map(self.sort, args)))
        self.sorts[name] = sort
        if of is not None:
            for p in containers(sort):
                self.register(p)
        return sort

    def sort(self, name: str) -> Sort:
        if name not in self.sorts:
            raise ProgramError(f"no sort {name}")
        return self.sorts[name]

    def new_name(self, name: str) -> None:
        if name in self.sorts or name in self.tables or name in self.prims:
            raise ProgramError(f"{name} is already bound")

    def declare(self, name: str, takes: Iterable[str], out: str, kind: str, merge: Any = None, cost: int = 1, extractable: bool = True) -> Table:
        self.new_name(name)
        t = Table(name, tuple(map(self.sort, takes)), self.sort(out), kind, None, cost, extractable)
        if kind == "constructor" and t.out.kind != "eq":
            raise ProgramError(f"constructor {name} must give a declared sort")
        if kind == "custom" and merge is not None:
            typer = Typer(self, {"old": t.out, "new": t.out})
            v = typer.visit(merge)
            typer.give(v[1], t.out, merge)
            typer.solve()
            t.merge = typer.typed(v)
        self.tables[name] = t
        return t

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ProgramError(f"no function {name}")
        return self.tables[name]

    def relation(self, name: str, takes: Iterable[str]) -> Table:
        return self.declare(name, takes, "Unit", "relation", extractable=False)

    def bind(self, name: str, df: DataFrame, out: str | None = None, unique: bool = False, size: int | None = None, nulls: str = "leave out") -> Table:
        """A relation, or by out a function, of a DataFrame's rows. unique: no row (for a function, no key) repeats.

        Columns become keys in their order; integers are i64, floats f64. Rows with a null aren't bound; nulls="error"
        raises if there is one. Nothing is copied if rows are unique: scans go to the source, with their filters and
        columns. Else distinct rows are written once. size: the number of unique rows without nulls, if known.
        """
        keys = [c for c in df.columns if c != out]
        kind = {c: SORT_OF.get(t) for c, t in df.dtypes}
        if bad := [c for c in df.columns if kind[c] is None]:
            raise ProgramError(f"no sort for columns {bad}")
        t = self.declare(name, [kind[c].name for c in keys], kind[out].name if out else "Unit", "custom" if out else "relation")
        own = df.dropna().select(*[F.col(f"`{c}`").cast(kind[c].ddl).alias(f"c{i}") for i, c in enumerate(keys)], *([F.col(f"`{out}`").cast(kind[out].ddl).alias("out")] if out else []))
        if nulls == "error" and not df.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in df.columns], F.lit(False))).isEmpty():
            raise ProgramError(f"{name}: a row has a null")
        stamped = lambda x: x.withColumn("ts", F.lit(self.ts).cast("long")).withColumn("sub", F.lit(False))
        if unique:
            own, t.sure = stamped(own), False
            n = size if size is not None else own.count()
        else:
            large = (rows := df.count()) > LOCAL_ROWS
            # Rows that seldom repeat are dealt by ranges, so that rows of near keys stay together.
            if large and t.keys and 2 * own.agg(F.approx_count_distinct(F.xxhash64(*t.keys))).head()[0] > rows:
                own = own.repartitionByRange(*t.keys)
            own, n = settle(stamped(own.dropDuplicates(t.keys)), expect_large=large)
        if n:
            t.parts = [Part(own, n, self.ts, self.ts)]
        self.ts += 1
        return t

    def add_rule(self, body: list[tuple], head: list[tuple], name: str = "", ruleset: str = "", naive: bool = False, subsumed: bool = False) -> Rule:
        if ruleset not in self.rulesets or self.rulesets[ruleset] is not None:
            raise ProgramError(f"no ruleset {ruleset}")
        facts, actions = Typer(self).check(body, head)
        if not naive:
            for a in actions:
                for e in a[1:]:
                    for x in e if isinstance(e, tuple | list) else [e]:
                        if isinstance(x, Typed) and (f := self.looks_up(x)):
                            raise ProgramError(f"lookup of function {f} in an action needs :naive")
        rule = flatten(facts, actions, self.tables, name=name, ruleset=ruleset, naive=naive, subsumed=subsumed)
        self.rules.append(rule)
        return rule

    def looks_up(self, e: Typed) -> str | None:
        if e.what == "table" and self.tables[e.name].kind == "custom" and not self.tables[e.name].hidden:
            return e.name
        return next((f for a in e.args if (f := self.looks_up(a))), None)

    # ---- matching

    def settled(self, df: DataFrame) -> tuple[DataFrame, int]:
        """settle(), straight to a written table if the rules of this iteration read large tables."""
        return settle(df, expect_large=self.largest > 5 * LOCAL_ROWS)

    def evaluate(self, call: Typed, args: list[Column]) -> Column:
        if call.name in FUNCTIONALS:
            return apply_functional(self, call, args, None)
        return call.prim.make(*args)

    def target_sorts(self, name: str, given: int, sort: Sort) -> tuple[Sort, ...]:
        return target_sorts(self, name, given, sort)

    def visible(self, t: Table, df: DataFrame, subsumed: bool) -> DataFrame:
        return df if subsumed or t.kind == "custom" or not self.state.get("subsumed", False) else df.where(~F.col("sub"))

    def matches(self, rule: Rule, everything: bool = False) -> list[DataFrame]:
        """DataFrames that together hold the matches that are new since the rule last ran."""
        tables, last = [self.tables[a.table] for a in rule.atoms], 0 if everything or rule.naive or not self.seminaive else rule.last_run
        distinct = any(a[0] == "set" and (t := self.tables[a[1]]).kind == "custom" and merge_kind(t.merge) in ("sum", "fold", "const") for a in rule.head)
        if not tables:
            return [plan(rule, [], self.evaluate, self.one_row)] if not rule.last_run or everything else []
        out = []
        for i, t in enumerate(tables):
            if last == 0 and i > 0:
                break
            new, n = t.since(self.spark, last)
            if n == 0:
                continue
            versions = []
            for j, u in enumerate(tables):
                df, size = (new, n) if j == i else u.before(self.spark, last) if j < i else (u.df(self.spark), u.n)
                versions.append((self.visible(u, df, rule.subsumed), size))
            if any(size == 0 for _, size in versions):
                continue
            self.largest = max(self.largest, *(size for _, size in versions))
            out.append(plan(rule, versions, self.evaluate, self.one_row, distinct, self.values(rule, [size for _, size in versions]), BROADCAST_ROWS))
        if last == 0 and any(t.n == 0 for t in tables):
            return []
        if distinct and len(out) > 1:  # a match may have new rows for several atoms, but never in two variants
            out = [reduce(DataFrame.unionByName, out).distinct()]
        return out

    def values(self, rule: Rule, sizes: list[int]) -> list[dict[str, int]] | None:
        """About how many values the columns have that join atoms, or are compared with literals, if that can matter: of
        more than LOCAL_ROWS rows, unless there are two atoms and one's keys are all joined."""
        if len(sizes) < 2 or max(sizes) <= LOCAL_ROWS:
            return None
        of = [[(c, t.name) for c, t in columns(a)] for a in rule.atoms]
        in_atoms = [{v for _, v in own if v} for own in of]
        shared = [[(c, v) for c, v in own if not v or any(v in o for j, o in enumerate(in_atoms) if j != i)] for i, own in enumerate(of)]
        keyed = lambda i: {c for c, _ in of[i]} - {"out"} <= {c for c, _ in shared[i]}
        if len(sizes) == 2 and any(keyed(i) for i in range(2)):
            return None
        return [{c: min(n, k) for c, k in self.tables[a.table].values_of(self.spark, [c for c, _ in own]).items()} if own else {} for a, own, n in zip(rule.atoms, shared, sizes, strict=True)]

    def one_each(self, rule: Rule, names: set[str]) -> bool:
        """Whether these variables' values tell matches apart, by the rows there are: each atom has at most one row for what
        is known by then. Asked only of joins that have many more rows than their tables."""
        sizes = [self.tables[a.table].n for a in rule.atoms]
        if rule.about is None or rule.about <= max(SPREAD_ROWS, 4 * sum(sizes)):
            return False
        known, left, steps, tried = set(names), list(rule.atoms), list(rule.steps), set()
        while left:
            for x in steps:
                if x.out is not None and all(not t.name or t.name in known for t in x.args):
                    known.add(x.out.name)
            for a in left:
                own = {t.name for _, t in columns(a) if t.name}
                some = tuple(sorted(own & known))
                if not some or (id(a), some) in tried:
                    continue
                tried.add((id(a), some))
                rows = scan(self.visible(t := self.tables[a.table], t.df(self.spark), rule.subsumed), a, set(some))
                if rows.groupBy(*some).count().where("count > 1").isEmpty():
                    known |= own
                    left.remove(a)
                    break
            else:
                return False
        return True

    def act(self, rule: Rule, df: DataFrame, stage: Stage, only: bool = False) -> None:
        """only: df holds all matches there are."""
        env = {v: F.col(t.name) if t.name else literal(t) for v, t in rule.names.items()}
        b = Builder(self, df, env)
        b.flat = {v: t.name for v, t in rule.names.items() if t.name}
        b.apart = self.apart(rule)
        b.cheap = b.apart is not None and len(rule.atoms) == 1 and not rule.steps and not any(p.gone for p in self.tables[rule.atoms[0].table].parts)
        b.run(rule.head)
        b.stage(stage)
        match rule.head:
            case [("do", Typed(what="table") as e)] if self.tables[e.name].kind == "relation" and all(a.what in ("lit", "var") for a in e.args):
                sure = only and not self.tables[e.name].n and not self.is_read(e.name) and self.one_each(rule, rule.needed)
                stage.known.setdefault(e.name, []).append(({i: a.value for i, a in enumerate(e.args) if a.what == "lit"}, sure))

    def apart(self, rule: Rule) -> set[str] | None:
        """Flat variables that tell a rule's matches apart: all in keys of atoms, if the tables are known to have each key once."""
        if not rule.atoms or not all(self.tables[a.table].sure for a in rule.atoms):
            return None
        return {t.name for a in rule.atoms for t in a.keys if t.name}

    def is_read(self, name: str) -> bool:
        return any(a.table == name for r in self.rules for a in r.atoms)

    def rules_of(self, ruleset: str) -> list[Rule]:
        if ruleset not in self.rulesets:
            raise ProgramError(f"no ruleset {ruleset}")
        of = self.rulesets[ruleset]
        if of is None:
            return [r for r in self.rules if r.ruleset == ruleset]
        return [r for s in of for r in self.rules_of(s)]

    def step(self, ruleset: str = "") -> bool:
        """One iteration; whether it changed anything."""
        self.flush()
        began, stage = time.time(), Stage()
        now, self.largest = self.ts, 0
        for rule in self.rules_of(ruleset):
            found = self.matches(rule)
            if rule.waiting is not None:  # left by a scheduler
                found, rule.waiting = [reduce(DataFrame.unionByName, [*found, rule.waiting]).distinct()], None
            for df in found:
                rule.matches += 1
                self.act(rule, df, stage, only=len(found) == 1)
            rule.last_run = now
        changed = self.apply(stage)
        r = self.report.setdefault(ruleset, {"iterations": 0, "seconds": 0.0, "changed": 0})
        r["iterations"] += 1
        r["seconds"] += time.time() - began
        r["changed"] += changed
        return changed

    def follow(self, s: Separable) -> bool:
        """Add all rows that a separable relation's rules make of its many changes: what each followed value leads to is found
        once, by rounds over such values, and joined with the rows. False: values are too many for that to be less work."""
        self.flush()
        t, last = self.tables[s.relation], s.rules[0].last_run
        if any(r.last_run != last or r.waiting is not None for r in s.rules) or self.state.get("subsumed", False):
            return True
        if any(self.tables[a.table].since(self.spark, last)[1] for r in s.rules for a in r.atoms if last and a.table != s.relation):
            return True  # older rows match anew
        rows, n = t.since(self.spark, last)
        if n <= FOLLOW_ROWS:
            return True
        values = [f"c{i}" for i in s.followed]
        if FOLLOW_SHARE * rows.agg(F.approx_count_distinct(F.xxhash64(*values))).head()[0] > n:
            return False
        began, k = time.time(), len(values)
        inner = copy.copy(self)
        reach = Table(f"{s.relation} from", tuple(t.takes[i] for i in s.followed) * 2, UNIT, "relation")
        inner.tables, inner.rulesets, inner.report, inner.pending = {**self.tables, reach.name: reach}, {"": None}, {}, Pending(inner)
        inner.rules = following(s, reach.name, self.tables)
        start = rows.select(*values).distinct()
        reach.add(*settle(start.select(*[F.col(c).alias(f"c{i + j * k}") for j in range(2) for i, c in enumerate(values)], F.lit(self.ts).cast("long").alias("ts"), F.lit(False).alias("sub"))), self.ts)
        inner.ts += 1
        while inner.step():
            pass
        # Rows that lead to themselves are there.
        steps = reach.df(self.spark).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(values)], *[F.col(f"c{i + k}").alias(f"to_{c}") for i, c in enumerate(values)])
        steps = steps.where(reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"to_{c}")) for c in values]))
        made = rows.select(*t.keys).join(F.broadcast(steps) if reach.n <= BROADCAST_ROWS else steps, values)
        self.largest = n
        changed, _ = self.insert(t, made.select(*[F.col(f"to_{c}").alias(c) if c in values else F.col(c) for c in t.keys]), self.ts)
        self.ts, self.largest = self.ts + 1, 0
        for r in s.rules:
            r.last_run = self.ts
        r = self.report.setdefault(s.rules[0].ruleset, {"iterations": 0, "seconds": 0.0, "changed": 0})
        r["seconds"] += time.time() - began
        r["changed"] += changed
        return True

    # ---- applying

    def apply(self, stage: Stage) -> bool:
        for df, message in stage.panics:
            if not df.isEmpty():
                raise ProgramError(f"panic: {message}")
        now = self.ts
        for f, dfs in stage.deletes.items():
            t = self.tables[f]
            if t.n:
                if not t.keys:
                    if any(not d.isEmpty() for d in dfs):
                        t.clear()
                    continue
                t.remove(*settle(t.df(self.spark).select(*t.keys).join(reduce(DataFrame.unionByName, dfs).distinct(), t.keys, "left_semi")))
        changed, edges = False, list(stage.unions)
        for f, dfs in stage.rows.items():
            views, dfs = self.views(dfs, stage.known.get(f, []))
            if dfs:
                if f in stage.given:
                    self.tables[f].moved = True
                own, more = self.insert(self.tables[f], reduce(DataFrame.unionByName, dfs), now, unique=f in stage.unique and len(stage.rows[f]) == 1)
                changed |= own
                edges += more
            for df in views:
                t = self.tables[f]
                df = df.withColumn("ts", F.lit(now).cast("long")).withColumn("sub", F.lit(False))
                n = df.count()
                t.add(df, n, now)
                changed |= n > 0
        for f, dfs in stage.subsumes.items():
            changed |= self.subsume(self.tables[f], reduce(DataFrame.unionByName, dfs), now)
        if edges:
            changed |= self.rebuild(edges, now)
        self.ts += 1
        self.largest = 0
        return changed

    @staticmethod
    def views(dfs: list[DataFrame], known: list[tuple[dict[int, Any], bool]]) -> tuple[list[DataFrame], list[DataFrame]]:
        """Frames of rows that never repeat and that other frames can't have, as some literal differs, and the others. Such
        a frame, of a relation that no rule reads, stays a join of the tables it was made of, and isn't written."""
        if len(known) != len(dfs):
            return [], dfs
        apart = lambda a, b: any(a[i] != b[i] for i in a.keys() & b.keys())
        view = [sure and all(apart(own, other) for j, (other, _) in enumerate(known) if j != i) for i, (own, sure) in enumerate(known)]
        return [d for d, v in zip(dfs, view, strict=True) if v], [d for d, v in zip(dfs, view, strict=True) if not v]

    def insert(self, t: Table, rows: DataFrame, now: int, unique: bool = False, few: bool = False) -> tuple[bool, list[DataFrame]]:
        """Insert or merge rows (keys, result, and maybe the flag sub); whether that changed the table, and edges of unions.
        unique: no key repeats in rows; few: rows are a table without lineage that can be broadcast."""
        flag = "sub" in rows.columns
        old = t.df(self.spark)
        if few and t.keys:  # else all of the old rows are shuffled
            old = old.join(F.broadcast(rows.select(*t.keys).distinct()), t.keys, "left_semi").select(*old.columns)
        stamp = lambda df: df.withColumn("ts", F.lit(now).cast("long")).withColumn("sub", F.col("sub") if flag else F.lit(False))
        agg = [F.bool_or("sub").alias("sub")] if flag else []
        if t.kind != "custom" and (t.kind == "relation" or not t.moved) and not flag:
            new = rows if unique else rows.dropDuplicates(t.keys) if t.keys else rows.limit(1)
            if t.n:
                new = new.join(old.select(*t.keys), t.keys, "left_anti") if t.keys else new.limit(0)
            df, n = self.settled(stamp(new).select(*old.columns))
            t.add(df, n, now)
            return n > 0, []
        if t.kind == "relation":
            agg = agg or [F.lit(False).alias("sub")]
            new = rows.groupBy(*t.keys).agg(*agg)
            if t.n:
                new = new.join(old.select(*t.keys), t.keys, "left_anti")
            df, n = self.settled(stamp(new).select(*old.columns))
            t.add(df, n, now)
            return n > 0, []
        if t.kind == "constructor":
            found = rows.withColumn("most", F.col("out")) if unique and not flag else rows.groupBy(*t.keys).agg(F.min("out").alias("out"), F.max("out").alias("most"), *agg)
            found = self.with_old(t, found, old)
            found, n = self.settled(stamp(found))
            if not n:
                return False, []
            new = found.where(F.col("old").isNull()).select(*old.columns)
            m = new.count() if t.n else n
            if n <= LOCAL_ROWS or 2 * m < n:  # else new rows are a scan of what is written
                new, m = self.settled(new)
            t.add(new, m, now)
            edges = []
            if m < n:
                edges.append(found.where(F.col("old").isNotNull() & (F.col("old") != F.col("out"))).select(F.col("out").alias("a"), F.col("old").alias("b")))
            if t.moved:  # ids between the least and the greatest: all of a key's ids meet in one class
                if not unique and not found.where("out <> most").isEmpty():
                    every = rows.join(found.where("out <> most").select(*t.keys, F.col("out").alias("least")), t.keys) if t.keys else rows.crossJoin(found.where("out <> most").select(F.col("out").alias("least")))
                    edges.append(every.where("out <> least").select(F.col("out").alias("a"), F.col("least").alias("b")))
                if flag and m < n:
                    self.subsume(t, found.where(F.col("old").isNotNull() & F.col("sub")).select(*t.keys), now)
            return m > 0, edges
        return self.merge(t, rows, old, now)

    @staticmethod
    def with_old(t: Table, found: DataFrame, old: DataFrame) -> DataFrame:
        """found with the result of the table's row of the same keys."""
        if not t.n:
            return found.withColumn("old", F.lit(None).cast(t.out.ddl))
        own = old.select(*t.keys, F.col("out").alias("old"))
        return found.join(own, t.keys, "left") if t.keys else found.crossJoin(own)

    def merge(self, t: Table, rows: DataFrame, old: DataFrame, now: int) -> tuple[bool, list[DataFrame]]:
        kind, edges = merge_kind(t.merge), []
        aggregate = {
            "none": F.min("out"), "min": F.min("out"), "max": F.max("out"), "old": F.min("out"), "new": F.max("out"), "const": F.min("out"), "sum": F.sum("out") if t.out in (I64, F64) else None,
            "and": F.bool_and("out") if t.out == BOOL else None, "or": F.bool_or("out") if t.out == BOOL else None,
            "set-union": F.sort_array(F.array_distinct(F.flatten(F.collect_set("out")))) if t.out.kind == "Set" else None, "fold": F.sort_array(F.collect_list("out")),
        }[kind]
        found = rows.groupBy(*t.keys).agg(aggregate.alias("one"), F.max("out").alias("most"), F.min("out").alias("least"), F.count(F.lit(1)).alias("times"))
        found = found.where("times > 0")
        found = self.with_old(t, found, old)
        was, one = F.col("old"), F.col("one")
        if kind == "none":
            found, n = self.settled(found)
            if not found.where("least <> most OR (old IS NOT NULL AND NOT old <=> one)").isEmpty():
                raise ProgramError(f"illegal merge: different values for {t.name}")
            merged, terms = one, None
        elif kind == "fold":
            merged, terms = self.fold(t, was, one)
        else:
            const = literal(t.merge) if kind == "const" else None
            both = {"min": F.least, "max": F.greatest, "old": lambda a, b: a, "new": lambda a, b: b, "sum": lambda a, b: a + b, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "set-union": lambda a, b: F.sort_array(F.array_union(a, b)), "const": lambda a, b: const}[kind]
            merged, terms = F.when(was.isNull(), F.when(F.col("times") > 1, const).otherwise(one) if kind == "const" else one).otherwise(F.when(was.eqNullSafe(one) & F.lit(kind not in ("sum", "const")), was).otherwise(both(was, one))), None
        done = found.withColumn("out", merged)
        if terms is not None:
            done, _ = self.settled(done.withColumn("terms", terms))
            made = done.select(F.explode("terms").alias("x")).select("x.*")
            _, more = self.insert(self.tables[t.merge.name], made, now)
            edges += more
        changed = done.where(was.isNull() | ~F.col("out").eqNullSafe(was)).withColumn("ts", F.lit(now).cast("long")).withColumn("sub", F.lit(False))
        df, n = self.settled(changed.select(*old.columns, was.isNotNull().alias("again")))
        if n:
            if t.n and t.keys:
                again = df.where("again").select(*t.keys)
                t.remove(again, again.count())
            elif t.n:
                t.clear()
            t.add(df.drop("again"), n, now)
        return n > 0, edges

    def fold(self, t: Table, was: Column, values: Column) -> tuple[Column, Column | None]:
        """A general merge, over the old result and the new ones in ascending order."""
        e = t.merge
        start = F.coalesce(was, F.get(values, F.lit(0)))
        rest = F.when(was.isNull(), F.slice(values, 2, 1 << 30)).otherwise(values)
        if e.what == "table" and self.tables[e.name].kind == "constructor":
            c = self.tables[e.name]
            fields = ",".join(f"c{i}:{s.ddl}" for i, s in enumerate(c.takes))
            empty = F.array().cast(f"array<struct<{fields},out:bigint>>")

            def add(acc: Column, new: Column) -> Column:
                args = [self.merge_value(a, {"old": acc["v"], "new": new}) for a in e.args]
                made = F.xxhash64(F.lit(c.name), *args)
                row = F.struct(*[a.alias(f"c{i}") for i, a in enumerate(args)], made.alias("out"))
                equal = acc["v"] == new
                return F.struct(F.when(equal, acc["v"]).otherwise(made).alias("v"), F.when(equal, acc["rows"]).otherwise(F.array_append(acc["rows"], row)).alias("rows"))

            done = F.aggregate(rest, F.struct(start.alias("v"), empty.alias("rows")), add)
            return done["v"], done["rows"]
        return F.aggregate(rest, start, lambda o, n: F.when(o.eqNullSafe(n), o).otherwise(self.merge_value(e, {"old": o, "new": n}))), None

    def merge_value(self, e: Typed, env: dict[str, Column]) -> Column:
        if e.what == "var":
            return env[e.name]
        if e.what == "lit":
            return literal(e)
        if e.what == "prim":
            value = self.evaluate(e, [self.merge_value(a, env) for a in e.args])
            return F.when(value.isNull(), F.raise_error(F.lit(f"call of primitive {e.name} failed")).cast(e.sort.ddl)).otherwise(value) if e.prim is None or e.prim.partial else value
        t = self.tables[e.name]
        if t.keys or t.kind != "custom":
            raise ProgramError(f"{e.name}: a merge can look up functions without arguments, or make one term")
        row = t.df(self.spark).select("out").head()
        return F.raise_error(F.lit(f"lookup of {e.name} failed")).cast(t.out.ddl) if row is None else F.lit(row.out).cast(t.out.ddl)

    def subsume(self, t: Table, keys: DataFrame, now: int) -> bool:
        own = t.df(self.spark).where(~F.col("sub"))
        hit = own.join(keys.distinct(), t.keys, "left_semi") if t.keys else own
        df, n = settle(hit.withColumn("sub", F.lit(True)).withColumn("ts", F.lit(now).cast("long")))
        if n:
            if t.keys:
                t.remove(df.select(*t.keys), n)
            else:
                t.clear()
            t.add(df, n, now)
            self.state["subsumed"] = True
        return n > 0

    # ---- equality

    def rebuild(self, edges: list[DataFrame], now: int) -> bool:
        """Unite ids, and follow what that changes until nothing does."""
        changed = False
        while edges:
            some, n = settle(reduce(DataFrame.unionByName, [e.select("a", "b") for e in edges]).where("a <> b"), large=forest)
            edges = []
            if not n:
                break
            if self.moved_ids is not None:  # ids that went before are named by their leaders
                m = F.broadcast(self.moved_ids) if self.state["n_moved"] <= BROADCAST_ROWS else self.moved_ids
                for c in ("a", "b"):
                    some = some.join(m.select(F.col("id").alias(c), "leader"), c, "left").withColumn(c, F.coalesce("leader", c)).drop("leader")
            delta, n = settle(components(some.where("a <> b"), written, LOCAL_EDGES).where("id <> root"), expect_large=n > LOCAL_EDGES)
            stale = some.where("a = b").isEmpty() is False
            if not n and not stale:
                break
            if n:
                changed = True
                moved = delta.select("id", F.col("root").alias("leader"))
                if self.moved_ids is not None:
                    again = self.moved_ids.join(delta.select(F.col("id").alias("leader"), "root"), "leader", "left").select("id", F.coalesce("root", "leader").alias("leader"))
                    moved = again.unionByName(moved)
                self.moved_ids, self.state["n_moved"] = settle(moved, expect_large=self.state.get("n_moved", 0) > 20_000)
            # Older rows may hold ids that moved now; those of this iteration also ids that moved earlier.
            every = self.moved_ids.select("id", F.col("leader").alias("root"))
            for t in list(self.tables.values()):
                if t.n and (t.out.has_ids or any(s.has_ids for s in t.takes)):
                    edges += self.canonicalize(t, (delta, n), (every, self.state["n_moved"]), now)
            self.pending.globals.clear()
        return changed

    def canonicalize(self, t: Table, delta: tuple[DataFrame, int], every: tuple[DataFrame, int], now: int) -> list[DataFrame]:
        """Rename ids in a table's rows, older ones by what moved now, new ones by all that ever moved; rows that then meet
        are merged. Returns edges of unions."""
        sorts = dict(zip([*t.keys, *t.values], [*t.takes, t.out], strict=False))
        own = [c for c, s in sorts.items() if s.has_ids]
        sides = [(rows, moves) for (rows, n), moves in ((t.before(self.spark, now), delta), (t.since(self.spark, now), every)) if n and moves[1]]
        if not sides:
            return []
        hits = [self.hit(rows.select(*t.keys, *t.values, "sub"), sorts, own, *moves) for rows, moves in sides]
        df = reduce(DataFrame.unionByName, hits)
        new = {c: F.col(f"new_{c}") for c in own}
        was = [F.col(c).alias(f"was_{c}") for c in t.keys]
        df, m = settle(df.select(*was, *[new.get(c, F.col(c)).alias(c) for c in sorts if c in [*t.keys, *t.values]], "sub"))
        if not m:
            return []
        if t.keys:
            t.remove(df.select(*[F.col(f"was_{c}").alias(c) for c in t.keys]), m)
        else:
            t.clear()
        t.moved = True
        rows = df.select(*t.keys, *t.values, *(["sub"] if t.kind != "custom" else []))
        return self.insert(t, rows, now, few=m <= BROADCAST_ROWS)[1]

    def hit(self, df: DataFrame, sorts: dict[str, Sort], own: list[str], moves: DataFrame, n: int) -> DataFrame:
        """The rows of df that hold an id that moved, with new_ columns of what its columns become."""
        d = F.broadcast(moves) if n <= BROADCAST_ROWS else moves
        if all(sorts[c].kind == "eq" for c in own):
            for c in own:
                df = df.join(d.select(F.col("id").alias(c), F.col("root").alias(f"r_{c}")), c, "left")
            some = df.where(reduce(lambda a, b: a | b, [F.col(f"r_{c}").isNotNull() for c in own]))
            return some.select(*sorts, "sub", *[F.coalesce(f"r_{c}", c).alias(f"new_{c}") for c in own])
        # containers: the moved ids of each row, joined one by one, are gathered for that row only
        from rulespark.operators.extract import ids_in

        ids = F.array_distinct(F.concat(*[ids_in(F.col(c), sorts[c]) for c in own]))
        some = df.withColumn("id", F.explode(ids)).join(d.select("id", "root"), "id").groupBy(*sorts, "sub").agg(F.map_from_entries(F.collect_list(F.struct("id", "root"))).alias("m"))
        return some.select(*sorts, "sub", *[renamed(F.col(c), sorts[c], F.col("m")).alias(f"new_{c}") for c in own])

    # ---- commands

    def run(self, program: str) -> list[str]:
        """Run a program's commands one after the other; returns what they print."""
        start = len(self.outputs)
        for c in self.parser.program(program):
            self.command(c)
        self.flush()
        return self.outputs[start:]

    def flush(self) -> None:
        self.pending.flush()

    def command(self, c: Command) -> None:
        if c.kind == "action":
            self.action(c.of)
            return
        self.flush()
        match c.kind:
            case "sort":
                self.declare_sort(c.name, c.of)
            case "function":
                self.declare(c.name, c.takes, c.out, c.__dict__["args"]["kind"], c.merge, c.cost, c.extractable)
            case "ruleset":
                if c.name in self.rulesets:
                    raise ProgramError(f"{c.name} is already bound")
                for r in c.of or []:
                    if r not in self.rulesets:
                        raise ProgramError(f"no ruleset {r}")
                self.rulesets[c.name] = c.of
            case "rule":
                self.add_rule(c.body, c.head, c.name, c.ruleset, c.naive, c.subsumed)
            case "schedule":
                for s in c.steps:
                    self.schedule(s)
            case "check":
                if not self.check(c.facts):
                    raise ProgramError("check failed")
            case "fail":
                before = self.snapshot()
                try:
                    for x in c.of:
                        self.command(x)
                    self.flush()
                except Exception:  # noqa: BLE001  whatever goes wrong is what is asked for
                    self.restore(before)
                    self.pending = Pending(self)
                else:
                    raise ProgramError("command should have failed")
            case "push":
                self.stack += [self.snapshot() for _ in range(c.n)]
            case "pop":
                for _ in range(c.n):
                    if not self.stack:
                        raise ProgramError("pop without push")
                    self.restore(self.stack.pop())
            case "extract":
                self.outputs += self.extract(c.of, c.n)
            case "input":
                from rulespark.sources.facts import input_facts

                input_facts(self, c.name, c.file)
            case "output":
                from rulespark.sources.facts import append_lines

                append_lines(self.path(c.file), [t for e in c.of for t in self.extract(e)])
            case "include":
                with open(c.file) as f:
                    self.run(f.read())
            case "print-function":
                from rulespark.sources.facts import print_function

                print_function(self, c.name, c.n, c.file, c.mode)
            case "print-size":
                self.outputs.append(self.print_size(c.name))
            case "print-stats":
                text = json.dumps(self.report)
                if c.file:
                    with open(c.file, "w") as f:
                        f.write(text)
                else:
                    self.outputs.append(text)
            case _:
                self.commands[c.kind](self, c)

    def path(self, file: str) -> str:
        return f"{self.fact_directory.rstrip('/')}/{file}" if self.fact_directory else file

    def action(self, a: tuple) -> None:
        """A top-level action. Facts without functions to evaluate are gathered; others run as a rule without body."""
        if a[0] == "let":
            typer = Typer(self)
            v = typer.visit(a[2])
            typer.solve()
            e = typer.typed(v)
            self.new_name(a[1])
            t = Table(a[1], (), e.sort, "custom", Typed("var", e.sort, "old"), hidden=True)
            a = ("set", a[1], [], a[2])
            self.tables[t.name] = t
            try:
                self.action(a)
            except Exception:
                del self.tables[t.name]
                raise
            return
        _, (typed,) = Typer(self).check([], [a])
        if self.pending.take(typed):
            return
        self.flush()
        rule = flatten([], [typed], self.tables, name="", ruleset="", naive=True)
        stage = Stage()
        self.act(rule, self.one_row.select(F.lit(1).alias("one")), stage)
        self.apply(stage)

    def schedule(self, s: tuple) -> tuple[bool, bool]:
        """Run a schedule; whether it changed anything, and whether an :until fact stopped it."""
        match s:
            case ("run", ruleset, until):
                if until and self.check(until):
                    return False, True
                return self.step(ruleset), False
            case ("repeat", n, *rest):
                changed, rest = False, rest[0]
                for _ in range(n):
                    own = [self.schedule(x) for x in rest]
                    changed |= any(c for c, _ in own)
                    if not any(c for c, _ in own) or any(stop for _, stop in own):
                        break
                return changed, False
            case ("saturate", rest):
                changed = False
                alone = rest[0][1] if len(rest) == 1 and rest[0][0] == "run" and not rest[0][2] and self.seminaive else None
                apart = separable(self.rules_of(alone), self.tables) if alone is not None else []
                while True:
                    apart = [s for s in apart if self.follow(s)]
                    own = [self.schedule(x) for x in rest]
                    changed |= any(c for c, _ in own)
                    if not any(c for c, _ in own):
                        return changed, False
            case ("seq", rest):
                own = [self.schedule(x) for x in rest]
                return any(c for c, _ in own), any(stop for _, stop in own)
        raise ProgramError(f"no schedule {s}")

    def run_ruleset(self, n: int = 1, ruleset: str = "", until: str = "") -> bool:
        """(run n ruleset :until facts)."""
        from rulespark.plans.syntax import read

        facts = self.parser.facts(read(until)) if until else []
        return self.schedule(("repeat", n, [("run", ruleset, facts)]))[0]

    def saturate(self, ruleset: str = "") -> bool:
        return self.schedule(("saturate", [("run", ruleset, [])]))[0]

    # ---- queries

    def matching(self, facts: list[tuple], names: list[str] | None = None, distinct: bool = False) -> DataFrame:
        typed, _ = Typer(self).check(facts, [])
        rule = flatten(typed, [], self.tables, name="", ruleset="", subsumed=True)
        rule.head = [("do", Typed("var", rule.names[v].sort, v)) for v in names or []]
        found = self.matches(rule, everything=True)
        if not found:
            return self.spark.createDataFrame([], ", ".join(f"`{v}` {rule.names[v].sort.ddl}" for v in names or []) or "one int")
        env = {v: F.col(t.name) if t.name else literal(t) for v, t in rule.names.items()}
        out = found[0].select(*[env[v].alias(v) for v in names]) if names else found[0]
        own = {rule.names[v].name for v in names or []} - {""}
        if distinct and (apart := self.apart(rule)) is not None and apart <= own:
            return out
        return out.distinct() if distinct and not self.one_each(rule, own) else out

    def query(self, names: list[str] | str, facts: str) -> DataFrame:
        """The distinct values of variables for which facts hold, as a DataFrame."""
        from rulespark.plans.syntax import read

        self.flush()
        names = names.split() if isinstance(names, str) else names
        return self.matching(self.parser.facts(read(facts)), names, distinct=True)

    def check(self, facts: list[tuple]) -> bool:
        self.flush()
        return not self.matching(facts).limit(1).isEmpty()

    def rows(self, name: str) -> DataFrame:
        """A function's rows: keys c0, c1, ..., and out."""
        self.flush()
        t = self.table(name)
        return t.df(self.spark).select(*t.keys, *t.values)

    def size(self, name: str) -> int:
        self.flush()
        return self.table(name).n

    def print_size(self, name: str | None = None) -> str:
        if name:
            return str(self.table(name).n)
        return "(" + "\n ".join(f"({t.name} {t.n})" for t in sorted(self.tables.values(), key=lambda t: t.name) if not t.hidden) + ")"

    def clear(self, name: str) -> None:
        """Drop all rows of a function."""
        self.flush()
        self.table(name).clear()

    def insert_rows(self, name: str, df: DataFrame) -> bool:
        """Insert rows of a DataFrame (columns in order: keys, then a custom function's result), with merges."""
        self.flush()
        t = self.table(name)
        df = df.toDF(*t.keys, *(["out"] if t.kind == "custom" else []))
        if t.kind == "constructor":
            df = df.withColumn("out", F.xxhash64(F.lit(t.name), *t.keys))
        stage = Stage()
        stage.rows[name] = [df.select(*[F.col(c).cast(s.ddl).alias(c) for c, s in zip(df.columns, [*t.takes, t.out], strict=False)])]
        return self.apply(stage)

    def python_rule(self, facts: str, names: list[str], act: Callable[[Engine, DataFrame], None]) -> None:
        """Call act with the current matches of facts; it may insert rows."""
        act(self, self.query(names, facts))

    def extract(self, e: Any, n: int = 0, model: Callable | None = None) -> list[str]:
        """The cheapest term equal to an expression, or n of its class, as text. model: as of operators.extract.costs."""
        from rulespark.operators.extract import extract

        return [t for _, t in extract(self, e, n, model)]

    def extract_cost(self, e: str | Any, model: Callable | None = None) -> int:
        from rulespark.operators.extract import extract
        from rulespark.plans.syntax import read

        return extract(self, self.parser.expr(read(e)[0]) if isinstance(e, str) else e, 0, model)[0][0]

    def add_command(self, name: str, run: Callable[[Engine, list], None]) -> None:
        """A command of programs: run gets the engine and what follows the name, as read."""
        self.parser.commands.add(name)
        self.commands[name] = lambda engine, c: run(engine, c.of)

    # ---- snapshots

    def snapshot(self) -> tuple:
        self.flush()
        return {k: t.copy() for k, t in self.tables.items()}, dict(self.sorts), {k: list(v) for k, v in self.prims.items()}, [copy.copy(r) for r in self.rules], dict(self.rulesets), self.moved_ids, dict(self.state), self.ts

    def restore(self, s: tuple) -> None:
        self.tables, self.sorts, self.prims, self.rules, self.rulesets, self.moved_ids, self.state, self.ts = s
        self.pending.globals.clear()


def merge_kind(e: Typed | None) -> str:
    if e is None:
        return "none"
    if e.what == "lit":
        return "const"
    if e.what == "var":
        return e.name
    if e.what == "prim" and len(e.args) == 2 and {(a.what, a.name) for a in e.args} == {("var", "old"), ("var", "new")}:
        if e.name in ("min", "max") and e.sort in (I64, F64) or e.name in ("and", "or"):
            return e.name
        if e.name == "+" and e.sort in (I64, F64):
            return "sum"
        if e.name == "set-union":
            return "set-union"
    return "fold"


def renamed(v: Column, s: Sort, m: Column) -> Column:
    """A value with its ids renamed by a map."""
    if not s.has_ids:
        return v
    match s.kind:
        case "eq":
            return F.coalesce(F.try_element_at(m, v), v)
        case "Vec":
            return F.transform(v, lambda x: renamed(x, s.of[0], m))
        case "Set":
            return F.sort_array(F.array_distinct(F.transform(v, lambda x: renamed(x, s.of[0], m))))
        case "Map":
            return F.sort_array(F.array_distinct(F.transform(v, lambda p: F.struct(renamed(p["k"], s.of[0], m).alias("k"), renamed(p["v"], s.of[1], m).alias("v")))))
        case "MultiSet":
            return multiset_sum(F.transform(v, lambda p: F.struct(renamed(p["v"], s.of[0], m).alias("v"), p["n"].alias("n"))))
        case "Pair":
            return F.struct(renamed(v["first"], s.of[0], m).alias("first"), renamed(v["second"], s.of[1], m).alias("second"))
    return v


class Pending:
    """Top-level facts that need nothing but literals and constructors, gathered to be applied by one stage."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.rows: dict[str, dict[tuple, None]] = {}
        self.unions: list[tuple[int, int]] = []
        self.globals: dict[str, Any] = {}

    def ground(self, e: Typed) -> Any:
        if e.what == "lit" and e.sort in (I64, F64, STRING, BOOL):
            return e.value
        if e.what == "table":
            t = self.engine.tables[e.name]
            if t.hidden and t.name in self.globals:
                return self.globals[t.name]
            if t.kind == "constructor":
                values = [self.ground(a) for a in e.args]
                id_ = term_id(t.name, zip(values, t.takes, strict=True))
                self.rows.setdefault(t.name, {})[(*values, id_)] = None
                return id_
        raise KeyError(e.name)

    def take(self, a: tuple) -> bool:
        unions = len(self.unions)
        try:
            match a:
                case ("do", Typed(what="table") as e) if self.engine.tables[e.name].kind == "relation":
                    self.rows.setdefault(e.name, {})[tuple(self.ground(x) for x in e.args)] = None
                case ("do", Typed(what="table") as e):
                    self.ground(e)
                case ("set", f, args, e):
                    t = self.engine.tables[f]
                    key = tuple(self.ground(x) for x in args)
                    if t.kind == "relation":
                        self.rows.setdefault(f, {})[key] = None
                    else:
                        value = self.ground(e)
                        if any(r[:-1] == key for r in self.rows.get(f, ())):  # writes to one key go one by one
                            return False
                        self.rows.setdefault(f, {})[(*key, value)] = None
                        if t.hidden:
                            self.globals[f] = value
                case ("union", x, y):
                    self.unions.append((self.ground(x), self.ground(y)))
                case _:
                    return False
        except KeyError:
            del self.unions[unions:]
            return False
        return True

    def flush(self) -> None:
        if not self.rows and not self.unions:
            return
        rows, unions, spark = self.rows, self.unions, self.engine.spark
        self.engine.largest = 0
        self.rows, self.unions = {}, []
        stage = Stage()
        for f, own in rows.items():
            t = self.engine.tables[f]
            schema = ", ".join([*[f"c{i} {s.ddl}" for i, s in enumerate(t.takes)], *([f"out {t.out.ddl}"] if t.values else [])])
            stage.rows[f] = [spark.createDataFrame([tuple(r) for r in own], schema) if schema else self.engine.one_row.select()]
        if unions:
            stage.unions.append(spark.createDataFrame(unions, "a long, b long"))
        self.engine.apply(stage)


__all__ = ["Engine", "ProgramError", "Prim", "Call", "Lit", "Var", "UNIT"]

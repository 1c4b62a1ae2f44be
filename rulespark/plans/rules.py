"""Rules as flat queries: atoms over tables and primitives over variables, and the join plans they become.

A body is flattened to atoms with fresh variables for nested calls. Equalities are substituted away; atoms of one table
with equal keys are one atom. A plan joins atoms by shared variables, smallest known size first, starting from the changed
rows; a primitive runs as soon as its inputs are bound, so that what it computes can be a join key. An atom that binds
nothing that is still needed becomes a semi-join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.functions.sorts import BIGINT, BIGRAT, UNIT, Sort
from rulespark.plans.syntax import ProgramError
from rulespark.plans.typing import Typed


@dataclass(frozen=True)
class Term:
    """A variable, or a literal (name is empty)."""

    sort: Sort
    name: str = ""
    value: object = None


@dataclass
class Atom:
    table: str
    keys: list[Term]
    out: Term | None


@dataclass
class Step:
    """A primitive: its call, arguments and result; result None for a condition."""

    call: Typed
    args: list[Term]
    out: Term | None


@dataclass
class Rule:
    name: str
    ruleset: str
    atoms: list[Atom]
    steps: list[Step]
    equal: list[tuple[Term, Term]]  # literals that must be equal
    names: dict[str, Term]  # what each variable of the program has become
    head: list[tuple]
    naive: bool = False
    subsumed: bool = False
    last_run: int = 0
    matches: int = 0
    source: str = ""
    waiting: DataFrame | None = None  # matches that a scheduler holds
    about: float | None = None  # about how many matches the last plan has, if values were counted

    @property
    def needed(self) -> set[str]:
        """Flat variables that the head uses."""
        out: set[str] = set()
        for a in self.head:
            for e in a[1:]:
                for x in e if isinstance(e, tuple | list) else [e]:
                    if isinstance(x, Typed):
                        out |= variables(x)
        return {t.name for v in out if (t := self.names.get(v)) is not None and t.name}


def variables(e: Typed) -> set[str]:
    if e.what == "var":
        return {e.name}
    return set().union(*map(variables, e.args)) if e.args else set()


class Flat:
    """Flattens typed facts."""

    def __init__(self, tables):
        self.tables, self.n = tables, 0
        self.atoms: list[Atom] = []
        self.steps: list[Step] = []
        self.of: dict[str, Term] = {}
        self.equal: list[tuple[Term, Term]] = []

    def fresh(self, sort: Sort) -> Term:
        self.n += 1
        return Term(sort, f"v{self.n}")

    def root(self, t: Term) -> Term:
        while t.name and t.name in self.of and self.of[t.name] != t:
            t = self.of[t.name]
        return t

    def unify(self, a: Term, b: Term) -> None:
        a, b = self.root(a), self.root(b)
        if a == b:
            return
        if a.name:
            self.of[a.name] = b
        elif b.name:
            self.of[b.name] = a
        else:
            self.equal.append((a, b))

    def term(self, e: Typed, names: dict[str, Term]) -> Term:
        if e.what == "lit":
            return Term(e.sort, "", e.value)
        if e.what == "var":
            if e.name not in names:
                names[e.name] = self.fresh(e.sort)
            return names[e.name]
        args = [self.term(a, names) for a in e.args]
        out = None if e.sort == UNIT else self.fresh(e.sort)
        if e.what == "table":
            self.atoms.append(Atom(e.name, args, out))
        else:
            self.steps.append(Step(e, args, out))
        return out or Term(UNIT, "", True)

    def close(self) -> None:
        """Apply substitutions, and merge atoms with the same keys, until nothing changes."""
        while True:
            seen: dict[tuple, Atom] = {}
            kept, changed = [], False
            for a in self.atoms:
                a.keys = [self.root(t) for t in a.keys]
                a.out = a.out and self.root(a.out)
                key = (a.table, *[(t.name, repr(t.value), t.sort) for t in a.keys])
                if key in seen:
                    if a.out and seen[key].out:
                        self.unify(a.out, seen[key].out)
                    changed = True
                else:
                    seen[key] = a
                    kept.append(a)
            self.atoms = kept
            if not changed:
                break
        for s in self.steps:
            s.args = [self.root(t) for t in s.args]
            s.out = s.out and self.root(s.out)


def flatten(facts: list[tuple], head: list[tuple], tables, **options) -> Rule:
    flat, names = Flat(tables), {}
    for f in facts:
        if f[0] == "=":
            flat.unify(flat.term(f[1], names), flat.term(f[2], names))
        else:
            t = flat.term(f[1], names)
            if f[1].what in ("var", "lit") and f[1].sort == UNIT:
                continue
            if f[1].what == "lit":
                flat.equal.append((t, Term(t.sort, "", True)))
    flat.close()
    rule = Rule(options.pop("name"), options.pop("ruleset"), flat.atoms, flat.steps, flat.equal, {k: flat.root(t) for k, t in names.items()}, head, **options)
    bound = {t.name for a in rule.atoms for t in (*a.keys, a.out) if t is not None and t.name}
    left = list(rule.steps)
    while left:
        ready = [s for s in left if all(not t.name or t.name in bound for t in s.args)]
        if not ready:
            raise ProgramError(f"ungrounded: no fact binds the arguments of {left[0].call.name}")
        bound |= {s.out.name for s in ready if s.out and s.out.name}
        left = [s for s in left if s not in ready]
    local = {a[1] for a in head if a[0] == "let"}
    used = set().union(*[variables(x) for a in head for e in a[1:] for x in (e if isinstance(e, tuple | list) else [e]) if isinstance(x, Typed)], set())
    for v in {*used, *names}:
        t = rule.names.get(v)
        if t is None and v not in local or t is not None and t.name and t.name not in bound:
            raise ProgramError(f"ungrounded: no fact binds {v}")
    return rule


def literal(t: Term | Typed) -> Column:
    return F.lit(t.value).cast(t.sort.ddl)


def column(t: Term) -> Column:
    return F.col(t.name) if t.name else literal(t)


def columns(atom: Atom) -> list[tuple[str, Term]]:
    return [(f"c{i}", t) for i, t in enumerate(atom.keys)] + ([("out", atom.out)] if atom.out is not None else [])


def scan(table: DataFrame, atom: Atom, keep: set[str]) -> DataFrame:
    """An atom's rows, as columns named by its variables: constants and repeated variables become filters."""
    terms = columns(atom)
    first: dict[str, str] = {}
    for c, t in terms:
        if not t.name:
            table = table.where(F.col(c).eqNullSafe(literal(t)))
        elif t.name in first:
            table = table.where(F.col(c).eqNullSafe(F.col(first[t.name])))
        else:
            first[t.name] = c
    return table.select(*[F.col(c).alias(v) for v, c in first.items() if v in keep] or [F.lit(1).alias("any")])


def join_size(rows: float, seen: dict[str, int], atom: Atom, n: float, values: dict[str, int]) -> float:
    """About how many rows a join has: of rows with so many seen values of variables, and an atom of n with values by column."""
    size, own = rows * n, {}
    for c, t in columns(atom):
        if not t.name:
            size /= max(1, values.get(c, 1))
        elif t.name in seen:
            own[t.name] = max(own.get(t.name, 1), seen[t.name], values.get(c, 1))
    for v in own.values():
        size /= v
    return min(size, rows) if atom.out is not None and all(not t.name or t.name in seen for t in atom.keys) else size


def pairs(many: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """A join with a side that is broadcast. If that has one other column, a key's values are one array: to read it takes less
    than to look up row by row."""
    other = [c for c in some.columns if c not in on]
    if len(other) != 1:
        return many.join(F.broadcast(some), on)
    held = some.groupBy(*on).agg(F.collect_list(*other).alias("held"))
    return many.join(F.broadcast(held), on).select(*many.columns, F.explode("held").alias(*other))


def spread(out: DataFrame, rows: DataFrame, on: list[str], about: float, n_out: float, n_rows: float, few: int) -> DataFrame:
    """A join with far more rows than its sides, in tasks that don't depend on how many keys there are: one side is broadcast
    if it has few rows, else repeated for each of several shares of the other."""
    tasks = int(min(4000, max(4 * out.sparkSession.sparkContext.defaultParallelism, about // (1 << 24))))
    if n_rows <= few:
        return pairs(out.repartition(tasks, *out.columns), rows, on)
    if n_out <= few:
        return pairs(rows.repartition(tasks, *rows.columns), out, on)
    shares = int(min(64, max(2, about // 10_000_000)))
    a = out.withColumn("share", F.pmod(F.xxhash64(*out.columns), F.lit(shares)).cast("int")).repartition(tasks, *on, "share")
    b = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, *on, "share")
    return a.join(b, [*on, "share"]).drop("share")


#: A join is spread if it has more rows than this, and four times those of its sides.
SPREAD_ROWS = 2_000_000


def plan(rule: Rule, versions: list[tuple[DataFrame, int | None]], evaluate, one_row: DataFrame, distinct: bool = False, values: list[dict[str, int]] | None = None, few: int = 0) -> DataFrame:
    """The matches of a rule: columns named by the flat variables that its head needs.

    versions: rows and (known) size of each atom's table; evaluate(call, columns): a primitive's column; distinct:
    whether each match counts once; values: about how many values the columns of each atom have. With them the next atom
    is the one that leaves the fewest rows, else the smallest; few: rows that can be broadcast.
    """
    needed = rule.needed
    atoms = list(zip(rule.atoms, versions, values or [{}] * len(versions), strict=True))
    atoms = [(a, (df, n, v)) for a, (df, n), v in atoms]
    seen: dict[str, int] = {}
    size = 1.0
    steps, bound = list(rule.steps), set()
    out: DataFrame | None = None

    def later(atom: Atom | None) -> set[str]:
        """Variables that the head, other atoms left, or steps left use."""
        some = set(needed)
        for a, _ in atoms:
            if a is not atom:
                some |= {t.name for t in (*a.keys, a.out) if t is not None and t.name}
        for s in steps:
            some |= {t.name for t in (*s.args, s.out) if t is not None and t.name}
        return some

    def own(atom: Atom) -> set[str]:
        return {t.name for t in (*atom.keys, atom.out) if t is not None and t.name}

    def run_steps(df: DataFrame) -> DataFrame:
        while ready := next((s for s in steps if all(not t.name or t.name in bound for t in s.args)), None):
            steps.remove(ready)
            value = evaluate(ready.call, [column(t) for t in ready.args])
            if ready.out is None:
                df = df.where(value)
            elif not ready.out.name or ready.out.name in bound:
                df = df.where(value == column(ready.out))
            else:
                bound.add(ready.out.name)
                # What is made of or from containers, or by Python, is computed once: Spark would copy it into each later
                # filter and use.
                held = any(t.sort.kind in ("MultiSet", "Set", "Map", "Vec") or t.sort in (BIGINT, BIGRAT) for t in (*ready.args, ready.out))
                df = df.select("*", F.explode(F.array(value)).alias(ready.out.name)) if held else df.withColumn(ready.out.name, value)
                if ready.call.prim is None or ready.call.prim.partial:
                    df = df.where(F.col(ready.out.name).isNotNull())
        return df

    big = 1 << 60
    if not atoms:
        out = one_row.select(F.lit(1).alias("one"))
    while atoms:
        # The smallest atom first; then those that share variables, smallest first; unconnected ones come last.
        sizes = [big if n is None else n for _, (_, n, _) in atoms]
        results = [join_size(size, seen, a, sizes[k], v) if values and seen else 0 for k, (a, (_, _, v)) in enumerate(atoms)]
        i = min(range(len(atoms)), key=lambda k: (bool(bound) and not own(atoms[k][0]) & bound, results[k], sizes[k]))
        atom, (df, _, counted) = atoms.pop(i)
        before, size = size, join_size(size, seen, atom, sizes[i], counted) if values else size
        seen |= {t.name: min(seen.get(t.name, big), counted.get(c, sizes[i]), sizes[i]) for c, t in columns(atom) if t.name}
        keep = later(atom) | bound
        rows = scan(df, atom, keep & own(atom))
        if out is None:
            out = rows
        else:
            on = sorted(own(atom) & bound)
            new = (own(atom) & later(atom)) - bound
            if on and not new:
                out, size = out.join(rows.select(*on), on, "left_semi"), min(size, before)
            elif on:
                grows = values and size > max(SPREAD_ROWS, 4 * (before + sizes[i]))
                out = spread(out, rows, on, size, before, sizes[i], few) if grows else out.join(rows, on)
            elif new:
                out = out.crossJoin(rows)  # atoms without shared variables, as the program says
            else:
                out = out.join(rows.limit(1), F.lit(True), "left_semi")
        bound |= own(atom) & keep
        out = run_steps(out)
        use = later(None) & set(out.columns)
        out = out.select(*sorted(use)) if use else out.select(F.lit(1).alias("one"))
    out = run_steps(out)
    for a, b in rule.equal:
        out = out.where(literal(a).eqNullSafe(literal(b)))
    rule.about = size if values else None
    use = sorted(needed & set(out.columns))
    out = out.select(*use) if use else out.limit(1).select(F.lit(1).alias("one")) if rule.head else out.select(F.lit(1).alias("one"))
    return out.distinct() if distinct and use else out

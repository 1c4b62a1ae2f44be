"""Registry of primitives: a name has overloads, each with argument sorts, a result sort and a function on columns.

A primitive without a result for some arguments is partial, and gives NULL there; in a query such a match is dropped, in
an action it is an error. A primitive that returns Unit is a condition. Arguments are never NULL: results are checked as
soon as they are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.sorts import BASE_SORTS, BIGINT, BIGRAT, BOOL, F64, I64, STRING, UNIT, Sort

MIN, MAX = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Prim:
    """One overload. variadic: the last argument sort may repeat, from zero times on. same: all arguments have one sort."""

    name: str
    args: tuple[Sort, ...]
    out: Sort | None  # None: the arguments' sort
    make: Callable[..., Column]
    partial: bool = False
    variadic: bool = False
    same: bool = False
    apply: Sort | None = None  # the function sort, for primitives that apply one
    unions: Callable[..., Column] | None = None  # pairs of ids that the primitive unions


def null(ddl: str) -> Column:
    return F.lit(None).cast(ddl)


def fold(f: Callable[[Column, Column], Column], start: Column) -> Callable[..., Column]:
    def make(*xs: Column) -> Column:
        out = start if not xs else xs[0]
        for x in xs[1:]:
            out = f(out, x)
        return out

    return make


def _f64_string(a: Column) -> Column:
    """Shortest digits; plain from 1e-4 up to 1e16, else with an exponent."""
    text = F.abs(a).cast("string")
    parts = F.split(text, "E")
    digits = F.regexp_replace(F.replace(parts[0], F.lit("."), F.lit("")), r"(?<=.)0+$", "")
    exp = F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0))
    zeros = F.greatest(exp + 1, F.length(digits))
    large = F.concat(F.rpad(digits, zeros, F.lit("0")).substr(F.lit(1), exp + 1), F.lit("."), F.when(F.length(digits) > exp + 1, digits.substr(exp + 2, F.length(digits))).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exp - 1, F.lit(0))), digits)
    rest = digits.substr(F.lit(2), F.length(digits))
    science = F.concat(digits.substr(1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), exp.cast("string"))
    plain = F.when(~text.contains("E"), text).when((F.abs(a) >= 1e16) | (F.abs(a) < 1e-4), science).when(exp >= 0, large).otherwise(small)
    signed = F.concat(F.when((a < 0) | (F.lit(1.0) / F.when(a == 0, None).otherwise(a) < 0), "-").otherwise(""), plain)
    return F.when(F.isnan(a), "NaN").when(a == float("inf"), "inf").when(a == float("-inf"), "-inf").otherwise(signed)


def _count(a: Column, b: Column) -> Column:
    n = (F.length(a) - F.length(F.replace(a, b, F.lit("")))) / F.greatest(F.length(b), F.lit(1))
    return F.when(b == "", F.length(a) + 1).otherwise(n).cast("long")


def _replace(a: Column, b: Column, c: Column) -> Column:
    """An empty pattern matches between all characters, and at both ends."""
    between = F.concat(c, F.array_join(F.split(a, ""), "\0"), F.when(a == "", "").otherwise(c))
    return F.when(b == "", F.replace(between, F.lit("\0"), c)).otherwise(F.replace(a, b, c))


def _python(f: Callable, out: str) -> Callable[..., Column]:
    """A primitive on numbers beyond Spark's types: Arrow batches of their texts."""

    def make(*xs: Column) -> Column:
        import pandas as pd

        def each(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

        def one(a: pd.Series) -> pd.Series:
            return each(a)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return each(a, b)

        run = one if len(xs) == 1 else two
        run.__annotations__ = dict.fromkeys(run.__annotations__, pd.Series)
        return F.pandas_udf(run, out)(*xs)

    return make


def _big(f: Callable) -> Callable:
    return lambda *xs: None if (r := f(*[int(x) if isinstance(x, str) else int(x) for x in xs])) is None else str(r)


def _rat(f: Callable) -> Callable:
    from fractions import Fraction

    def parsed(x: str) -> Fraction:
        n, _, d = x.partition("/")  # Fraction's own parser is some times slower
        return Fraction(int(n), int(d or 1))

    def run(*xs):
        r = f(*[parsed(x) if isinstance(x, str) else x for x in xs])
        return None if r is None else f"{r.numerator}/{r.denominator}" if isinstance(r, Fraction) else str(r) if isinstance(r, int) else r

    return run


def _quotient(a: int, b: int) -> int:
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def _power(a, b):
    if b.denominator != 1 or a == 0 and b < 0:
        return None
    return a ** int(b)


def _root(a):
    from fractions import Fraction
    from math import isqrt

    if a <= 0:
        return None
    n, d = isqrt(a.numerator), isqrt(a.denominator)
    return Fraction(n, d) if n * n == a.numerator and d * d == a.denominator else None


def _to_i64(a: Column) -> Column:
    """Towards zero; what is beyond goes to the nearest i64, NaN to 0."""
    inside = ~F.isnan(a) & (a < 2.0**63) & (a > -(2.0**63))
    return F.when(F.isnan(a), F.lit(0).cast("long")).when(a >= 2.0**63, F.lit(MAX)).when(a <= -(2.0**63), F.lit(MIN)).otherwise(F.when(inside, a).otherwise(0.0).cast("long"))


def scalars() -> list[Prim]:
    out: list[Prim] = []

    def add(name: str, args: str, result: Sort, make: Callable[..., Column], **flags) -> None:
        out.append(Prim(name, tuple(BASE_SORTS[a] for a in args.split()), result, make, **flags))

    call = F.call_function
    b0 = lambda b, x: F.when(b != 0, x)
    for name, f in (("+", F.try_add), ("-", F.try_subtract), ("*", F.try_multiply)):
        add(name, "i64 i64", I64, f, partial=True)
    add("/", "i64 i64", I64, lambda a, b: F.when((b != 0) & ~((a == MIN) & (b == -1)), call("div", a, F.when(b == 0, 1).otherwise(b))), partial=True)
    add("%", "i64 i64", I64, lambda a, b: F.when(b == -1, F.when(a == MIN, None).otherwise(0)).when(b != 0, a % F.when(b == 0, 1).otherwise(b)), partial=True)
    add("&", "i64 i64", I64, lambda a, b: a.bitwiseAND(b))
    add("|", "i64 i64", I64, lambda a, b: a.bitwiseOR(b))
    add("^", "i64 i64", I64, lambda a, b: a.bitwiseXOR(b))
    for name, f in (("<<", "shiftleft"), (">>", "shiftright")):
        add(name, "i64 i64", I64, lambda a, b, f=f: F.when((b >= 0) & (b < 64), call(f, a, F.when((b >= 0) & (b < 64), b).otherwise(0).cast("int"))), partial=True)
    add("not-i64", "i64", I64, F.bitwise_not)
    add("log2", "i64", I64, lambda a: F.when(a > 0, (F.length(F.bin(a)) - 1).cast("long")), partial=True)
    add("abs", "i64", I64, lambda a: F.when(a != MIN, F.abs(F.when(a == MIN, 0).otherwise(a))), partial=True)
    for s in (I64, F64):
        for name, f in (("<", lambda a, b: a < b), (">", lambda a, b: a > b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b)):
            add(name, f"{s} {s}", UNIT, f, partial=True)
        add("min", f"{s} {s}", s, F.least)
        add("max", f"{s} {s}", s, F.greatest)
    for name, f in (("bool-=", lambda a, b: a == b), ("bool-<", lambda a, b: a < b), ("bool->", lambda a, b: a > b), ("bool-<=", lambda a, b: a <= b), ("bool->=", lambda a, b: a >= b)):
        add(name, "i64 i64", BOOL, f)
    add("to-string", "i64", STRING, lambda a: a.cast("string"))
    add("count-matches", "String String", I64, _count)

    for name, f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("^", F.pow)):
        add(name, "f64 f64", F64, f)
    add("/", "f64 f64", F64, lambda a, b: b0(b, a / F.when(b == 0, 1.0).otherwise(b)), partial=True)
    add("%", "f64 f64", F64, lambda a, b: b0(b, a % F.when(b == 0, 1.0).otherwise(b)), partial=True)
    add("neg", "f64", F64, lambda a: -a)
    add("abs", "f64", F64, F.abs)
    add("exp", "f64", F64, F.exp)
    add("log", "f64", F64, lambda a: F.when(a > 0, F.ln(a)), partial=True)
    add("sqrt", "f64", F64, lambda a: F.when(a >= 0, F.sqrt(a)), partial=True)
    add("to-f64", "i64", F64, lambda a: a.cast("double"))
    add("to-i64", "f64", I64, _to_i64)
    add("to-string", "f64", STRING, _f64_string)

    add("not", "bool", BOOL, lambda a: ~a)
    add("and", "bool bool", BOOL, lambda a, b: a & b)
    add("or", "bool", BOOL, fold(lambda a, b: a | b, F.lit(False)), variadic=True)
    add("xor", "bool bool", BOOL, lambda a, b: a != b)
    add("=>", "bool bool", BOOL, lambda a, b: ~a | b)
    add("guard", "bool", UNIT, lambda a: a, partial=True)

    add("+", "String", STRING, lambda *xs: F.concat(F.lit(""), *xs), variadic=True)
    add("replace", "String String String", STRING, _replace)

    z = BIGINT
    add("bigint", "i64", z, lambda a: a.cast("string"))
    for name, f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("&", lambda a, b: a & b), ("|", lambda a, b: a | b), ("^", lambda a, b: a ^ b), ("min", min), ("max", max)):
        add(name, "BigInt BigInt", z, _python(_big(f), "string"))
    add("/", "BigInt BigInt", z, _python(_big(lambda a, b: None if b == 0 else _quotient(a, b)), "string"), partial=True)
    add("%", "BigInt BigInt", z, _python(_big(lambda a, b: None if b == 0 else a - b * _quotient(a, b)), "string"), partial=True)
    add("<<", "BigInt i64", z, _python(_big(lambda a, n: None if n < 0 else a << n), "string"), partial=True)
    add(">>", "BigInt i64", z, _python(_big(lambda a, n: None if n < 0 else a >> n), "string"), partial=True)
    add("not-Z", "BigInt", z, _python(_big(lambda a: ~a), "string"))
    add("bits", "BigInt", z, _python(_big(lambda a: a.bit_length()), "string"))
    for name, f in (("<", lambda a, b: int(a) < int(b)), (">", lambda a, b: int(a) > int(b)), ("<=", lambda a, b: int(a) <= int(b)), (">=", lambda a, b: int(a) >= int(b))):
        add(name, "BigInt BigInt", UNIT, _python(f, "boolean"), partial=True)
        add(f"bool-{name}", "BigInt BigInt", BOOL, _python(f, "boolean"))
    add("bool-=", "BigInt BigInt", BOOL, lambda a, b: a == b)
    add("to-string", "BigInt", STRING, lambda a: a)
    add("from-string", "String", z, lambda a: F.when(a.rlike(r"^[+-]?[0-9]+$"), F.regexp_replace(F.regexp_replace(a, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")), partial=True)

    q = BIGRAT
    for name, f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("/", lambda a, b: None if b == 0 else a / b), ("min", min), ("max", max), ("pow", _power)):
        add(name, "BigRat BigRat", q, _python(_rat(f), "string"), partial=name in ("+", "-", "*", "/", "pow"))
    from math import ceil, floor

    def rounded(a):
        from fractions import Fraction

        return Fraction((1 if a >= 0 else -1) * floor(abs(a) + Fraction(1, 2)))

    def whole(f):
        from fractions import Fraction

        return lambda a: Fraction(f(a))

    for name, f in (("neg", lambda a: -a), ("abs", abs), ("floor", whole(floor)), ("ceil", whole(ceil)), ("round", rounded)):
        add(name, "BigRat", q, _python(_rat(f), "string"))
    add("sqrt", "BigRat", q, _python(_rat(_root), "string"), partial=True)
    for name in ("log", "cbrt"):  # no result but for 1
        add(name, "BigRat", q, _python(_rat(lambda a, name=name: None if a != 1 else a - 1 if name == "log" else a), "string"), partial=True)
    add("bigrat", "BigInt BigInt", q, _python(_rat(lambda a, b: None if b == 0 else a / b), "string"), partial=True)
    add("numer", "BigRat", z, lambda a: F.split(a, "/")[0])
    add("denom", "BigRat", z, lambda a: F.split(a, "/")[1])
    add("to-f64", "BigRat", F64, _python(_rat(lambda a: float(a)), "double"))
    add("to-i64", "BigRat", I64, _python(lambda a: (lambda v: v if MIN <= v <= MAX else None)((lambda f: _quotient(f.numerator, f.denominator))((lambda n, _, d: __import__("fractions").Fraction(int(n), int(d or 1)))(*a.partition("/")))), "long"), partial=True)
    for name, f in (("<", lambda a, b: a < b), (">", lambda a, b: a > b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b)):
        add(name, "BigRat BigRat", UNIT, _python(_rat(f), "boolean"), partial=True)

    out.append(Prim("!=", (), UNIT, lambda a, b: ~a.eqNullSafe(b), partial=True, same=True))
    out.append(Prim("value-eq", (), UNIT, lambda a, b: a.eqNullSafe(b), partial=True, same=True))
    out.append(Prim("bool-!=", (), BOOL, lambda a, b: ~a.eqNullSafe(b), same=True))
    out.append(Prim("ordering-min", (), None, lambda a, b: F.least(a, b), same=True))
    out.append(Prim("ordering-max", (), None, lambda a, b: F.greatest(a, b), same=True))
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count_of(m: Column, v: Column) -> Column:
    return F.coalesce(F.get(F.transform(F.filter(m, lambda x: x["v"].eqNullSafe(v)), lambda x: x["n"]), F.lit(0)), F.lit(0).cast("long"))


def multiset(values: Column) -> Column:
    """Sorted pairs of value and count, from an array of values."""
    return F.transform(F.sort_array(F.array_distinct(values)), lambda v: F.struct(v.alias("v"), F.size(F.filter(values, lambda x: x.eqNullSafe(v))).cast("long").alias("n")))


def multiset_sum(both: Column) -> Column:
    """From an array of pairs of value and count, in which values may repeat; counts of 0 go."""
    keys = F.sort_array(F.array_distinct(F.transform(both, lambda x: x["v"])))
    total = lambda v: F.aggregate(F.filter(both, lambda x: x["v"].eqNullSafe(v)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return F.filter(F.transform(keys, lambda v: F.struct(v.alias("v"), total(v).alias("n"))), lambda x: x["n"] > 0)


def containers(s: Sort) -> list[Prim]:
    """The primitives of one container sort."""
    out: list[Prim] = []

    def add(name: str, args: tuple[Sort, ...], result: Sort, make: Callable[..., Column], **flags) -> None:
        out.append(Prim(name, args, result, make, **flags))

    typed = lambda c: c.cast(s.ddl)
    if s.kind == "Vec":
        (e,) = s.of
        add("vec-empty", (), s, lambda: typed(F.array()))
        add("vec-of", (e,), s, lambda *xs: typed(F.array(*xs)), variadic=True)
        add("vec-append", (s,), s, lambda *xs: F.concat(typed(F.array()), *xs), variadic=True)
        add("vec-push", (s, e), s, F.array_append)
        add("vec-pop", (s,), s, lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        add("vec-length", (s,), I64, lambda a: F.size(a).cast("long"))
        add("vec-contains", (s, e), UNIT, lambda a, x: F.exists(a, lambda y: y.eqNullSafe(x)), partial=True)
        add("vec-not-contains", (s, e), UNIT, lambda a, x: ~F.exists(a, lambda y: y.eqNullSafe(x)), partial=True)
        inside = lambda a, i: (i >= 0) & (i < F.size(a))
        at = lambda a, i: F.when(inside(a, i), i).otherwise(0).cast("int")
        add("vec-get", (s, I64), e, lambda a, i: F.when(inside(a, i), F.get(a, at(a, i))), partial=True)
        add("vec-set", (s, I64, e), s, lambda a, i, x: F.when(inside(a, i), F.transform(a, lambda y, j: F.when(j == i, x).otherwise(y))), partial=True)
        add("vec-remove", (s, I64), s, lambda a, i: F.when(inside(a, i), F.concat(F.slice(a, F.lit(1), at(a, i)), F.slice(a, at(a, i) + 2, F.size(a)))), partial=True)
        if e.name == "i64":
            add("vec-range", (I64,), s, lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")))).otherwise(typed(F.array())))
        if e.kind == "eq":
            add("vec-union", (s, s), s, lambda a, b: F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.least(x, y))), partial=True, unions=lambda a, b: F.arrays_zip(a.alias("a"), b.alias("b")))
    elif s.kind == "Set":
        (e,) = s.of
        new = lambda a: F.sort_array(F.array_distinct(a))
        has = lambda a, x: F.exists(a, lambda y: y.eqNullSafe(x))

        def by_value(a: Column) -> Column:
            """i64 in the order of their representation: from 0 to 2^31 - 1, then the others."""
            if e.name != "i64":
                return a
            keyed = F.transform(a, lambda x: F.struct(((x < 0) | (x >= 2**31)).alias("far"), x.alias("x")))
            return F.transform(F.sort_array(keyed), lambda y: y["x"])

        add("set-empty", (), s, lambda: typed(F.array()))
        add("set-of", (e,), s, lambda *xs: new(typed(F.array(*xs))), variadic=True)
        add("set-get", (s, I64), e, lambda a, i: F.when((i >= 0) & (i < F.size(a)), F.get(by_value(a), F.when((i >= 0) & (i < F.size(a)), i).otherwise(0).cast("int"))), partial=True)
        add("set-insert", (s, e), s, lambda a, x: new(F.array_append(a, x)))
        add("set-remove", (s, e), s, lambda a, x: F.filter(a, lambda y: ~y.eqNullSafe(x)))
        add("set-length", (s,), I64, lambda a: F.size(a).cast("long"))
        add("set-contains", (s, e), UNIT, has, partial=True)
        add("set-not-contains", (s, e), UNIT, lambda a, x: ~has(a, x), partial=True)
        add("set-union", (s, s), s, lambda a, b: new(F.concat(a, b)))
        add("set-diff", (s, s), s, lambda a, b: new(F.array_except(a, b)))
        add("set-intersect", (s, s), s, lambda a, b: new(F.array_intersect(a, b)))
    elif s.kind == "Map":
        k, v = s.of
        gone = lambda m, x: F.filter(m, lambda p: ~p["k"].eqNullSafe(x))
        put = lambda m, x, y: F.sort_array(F.array_append(gone(m, x), F.struct(x.alias("k"), y.alias("v"))))

        def of(*xs: Column) -> Column:
            out = typed(F.array())
            for x, y in zip(xs[::2], xs[1::2], strict=True):
                out = put(out, x, y)
            return out

        add("map-empty", (), s, lambda: typed(F.array()))
        add("map-of", (k, v), s, of, variadic=True)
        add("map-get", (s, k), v, lambda m, x: F.get(F.filter(m, lambda p: p["k"].eqNullSafe(x)), F.lit(0))["v"], partial=True)
        add("map-insert", (s, k, v), s, put)
        add("map-remove", (s, k), s, gone)
        add("map-length", (s,), I64, lambda m: F.size(m).cast("long"))
        add("map-contains", (s, k), UNIT, lambda m, x: F.exists(m, lambda p: p["k"].eqNullSafe(x)), partial=True)
        add("map-not-contains", (s, k), UNIT, lambda m, x: ~F.exists(m, lambda p: p["k"].eqNullSafe(x)), partial=True)
    elif s.kind == "Pair":
        a, b = s.of
        add("pair", (a, b), s, lambda x, y: F.struct(x.alias("first"), y.alias("second")))
        add("pair-first", (s,), a, lambda p: p["first"])
        add("pair-second", (s,), b, lambda p: p["second"])
    elif s.kind == "MultiSet":
        (e,) = s.of
        one = lambda x, n=1: typed(F.array(F.struct(x.alias("v"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("n"))))
        less = lambda m, o: multiset_sum(F.concat(m, F.transform(o, lambda p: F.struct(p["v"].alias("v"), (-p["n"]).alias("n")))))
        within = lambda o, m: F.forall(o, lambda p: _count_of(m, p["v"]) >= p["n"])
        has = lambda m, x: F.exists(m, lambda p: p["v"].eqNullSafe(x))
        add("multiset-of", (e,), s, lambda *xs: multiset(F.array(*xs).cast(f"array<{e.ddl}>")), variadic=True)
        add("multiset-single", (e, I64), s, lambda x, n: F.when(n > 0, one(x, n)).when(n == 0, typed(F.array())), partial=True)
        add("multiset-pick", (s,), e, lambda m: F.get(m, F.lit(0))["v"], partial=True)
        most = lambda m: F.array_max(F.transform(m, lambda p: p["n"]))
        add("multiset-pick-max", (s,), e, lambda m: F.get(F.reverse(F.filter(m, lambda p: p["n"] == most(m))), F.lit(0))["v"], partial=True)
        add("multiset-insert", (s, e), s, lambda m, x: multiset_sum(F.concat(m, one(x))))
        add("multiset-remove", (s, e), s, lambda m, x: F.when(has(m, x), less(m, one(x))), partial=True)
        add("multiset-remove-swapped", (e, s), s, lambda x, m: F.when(has(m, x), less(m, one(x))), partial=True)
        add("multiset-subtract", (s, s), s, lambda m, o: F.when(within(o, m), less(m, o)), partial=True)
        add("multiset-subtract-swapped", (s, s), s, lambda o, m: F.when(within(o, m), less(m, o)), partial=True)
        add("multiset-length", (s,), I64, lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda a, p: a + p["n"]))
        add("multiset-contains", (s, e), UNIT, has, partial=True)
        add("multiset-not-contains", (s, e), UNIT, lambda m, x: ~has(m, x), partial=True)
        add("multiset-contains-swapped", (e, s), UNIT, lambda x, m: has(m, x), partial=True)
        add("multiset-not-contains-swapped", (e, s), UNIT, lambda x, m: ~has(m, x), partial=True)
        add("multiset-intersection", (s, s), s, lambda m, o: F.filter(F.transform(m, lambda p: F.struct(p["v"].alias("v"), F.least(p["n"], _count_of(o, p["v"])).alias("n"))), lambda p: p["n"] > 0))
        add("multiset-sum", (s, s), s, lambda m, o: multiset_sum(F.concat(m, o)))
        add("multiset-reset-counts", (s,), s, lambda m: F.transform(m, lambda p: F.struct(p["v"].alias("v"), F.lit(1).cast("long").alias("n"))))
        add("multiset-count", (s, e), I64, _count_of)
        if e.kind == "MultiSet":
            scaled = lambda m: F.flatten(F.transform(m, lambda p: F.transform(p["v"], lambda q: F.struct(q["v"].alias("v"), (q["n"] * p["n"]).alias("n")))))
            add("multiset-sum-multisets", (s,), e, lambda m: multiset_sum(scaled(m)))
        if e.kind == "eq":
            least = lambda m: F.array_min(F.transform(m, lambda p: p["v"]))
            add("multiset-union-values", (s,), e, least, partial=True, unions=lambda m: F.transform(m, lambda p: F.struct(p["v"].alias("a"), least(m).alias("b"))))
    return out

"""Builder, schedulers, streams, command line, components, and random programs against a plain interpreter."""

import random

import pytest
from pyspark.sql import functions as F

from rulespark import builder as b
from rulespark.engine import Engine
from rulespark.operators.components import components, union_find
from rulespark.operators.storage import cut
from rulespark.schedulers import Backoff, first, run_with


def closure(spark, **options):
    e = Engine(spark, **options)
    x, y, z = b.vars("x y z")
    edge, path = b.relation(e, "edge", "i64 i64"), b.relation(e, "path", "i64 i64")
    b.rule(e, [edge(x, y)], [path(x, y)])
    b.rule(e, [path(x, y), edge(y, z)], [path(x, z)])
    return e, edge, path


def test_builder(spark):
    e, edge, path = closure(spark)
    b.act(e, edge(1, 2), edge(2, 3))
    e.saturate()
    assert b.holds(e, path(1, 3)) and not b.holds(e, path(3, 1))
    assert sorted(tuple(r) for r in e.query("y", "(path 1 y)").collect()) == [(2,), (3,)]
    b.sort(e, "T")
    leaf, node = b.constructor(e, "Leaf", "i64", "T"), b.constructor(e, "Node", "T T", "T", cost=3)
    x, y = b.vars("x y")
    b.rewrite(e, node(x, y), node(y, x))
    b.act(e, b.let("$t", node(leaf(1), leaf(2))), b.union(leaf(1), leaf(2)))
    e.run_ruleset(2)
    assert e.extract_cost("$t") == 7
    n = b.function(e, "n", "i64", "i64", b.op("max")(b.Var("old"), b.Var("new")))
    b.act(e, b.set_(n(1), 4), b.set_(n(1), 2), b.delete(edge(1, 2)))
    assert b.holds(e, b.eq(n(1), 4)) and e.size("edge") == 1


def test_own_primitive_and_macro(spark):
    from rulespark.functions.primitives import Prim
    from rulespark.functions.sorts import I64

    e = Engine(spark)
    e.register(Prim("twice", (I64,), I64, lambda a: a * 2))
    e.parser.macros["facts-up-to"] = lambda x: [[x[1], str(i)] for i in range(int(x[2]))]
    e.run("(relation n (i64)) (facts-up-to n 4) (check (n 3)) (check (= (twice 4) 8))")
    assert e.size("n") == 4


def test_schedulers(spark):
    e, edge, path = closure(spark)
    b.act(e, *[edge(i, i + 1) for i in range(6)])
    run_with(e, first(3), 60)
    assert e.size("path") == 21
    e, edge, path = closure(spark)
    b.act(e, *[edge(i, i + 1) for i in range(6)])
    run_with(e, Backoff(limit=2, ban=1), 60)
    assert e.size("path") == 21


def test_stream(spark, tmp_path):
    from rulespark.streaming.feed import feed

    for i in range(3):
        spark.createDataFrame([(i, i + 1)], "a long, b long").write.mode("append").parquet(str(tmp_path / "in"))
    e, edge, path = closure(spark)
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    sizes = []
    q = feed(e, "edge", stream, after=lambda e, n: sizes.append(e.size("path")), checkpointLocation=str(tmp_path / "cp"), availableNow="true")
    q.awaitTermination(120)
    assert q.exception() is None and e.size("path") == 6 and sizes[-1] == 6


def test_cli(spark, tmp_path, capsys):
    from rulespark.cli import main

    (tmp_path / "p.rules").write_text("(datatype T (A i64)) (A 1) (print-size)")
    assert main([str(tmp_path / "p.rules"), "--to-json"]) == 0
    assert "(A 1)" in capsys.readouterr().out and (tmp_path / "p.rules.json").exists()
    (tmp_path / "bad.rules").write_text("(check (= 1 2))")
    assert main([str(tmp_path / "bad.rules")]) == 1


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (7, 7), (7, 7)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.root for r in components(df, cut).collect()}
    assert found == union_find(edges)


def interpret(edges, unions, steps):
    """Paths over a graph whose nodes are united, as plain sets."""
    of = union_find([*unions, *[(x, x) for e in edges for x in e]])
    edge = {(of[x], of[y]) for x, y in edges}
    path = set()
    for _ in range(steps):
        path |= edge | {(x, z) for x, y in path for w, z in edge if y == w}
    return len(edge), len(path)


def saturated(edges, unions):
    return interpret(edges, unions, 20)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_modulo_equality(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(8), rng.randrange(8)) for _ in range(7)]
    unions = [(rng.randrange(8), rng.randrange(8)) for _ in range(3)]
    program = "(datatype N (n i64)) (relation edge (N N)) (relation path (N N)) (rule ((edge x y)) ((path x y))) (rule ((path x y) (edge y z)) ((path x z)))"
    program += "".join(f"(edge (n {x}) (n {y}))" for x, y in edges) + "".join(f"(union (n {x}) (n {y}))" for x, y in unions) + "(run 4)"
    sizes = set()
    for seminaive in (True, False):
        e = Engine(spark, seminaive=seminaive)
        e.run(program)
        sizes.add((e.size("edge"), e.size("path")))
    # naive and seminaive see edges in the same iterations
    assert len(sizes) == 1 and sizes.pop()[0] == interpret(edges, unions, 4)[0]
    e.run("(run-schedule (saturate (run)))")
    assert (e.size("edge"), e.size("path")) == saturated(edges, unions)


def test_large_tables_are_written(spark, monkeypatch):
    from rulespark.operators import storage

    monkeypatch.setattr(storage, "LOCAL_ROWS", 3)
    e, edge, path = closure(spark)
    b.act(e, *[edge(i, i + 1) for i in range(6)])
    e.saturate()
    assert e.size("path") == 21
    e.insert_rows("edge", spark.range(10, 20).select("id", (F.col("id") + 1).alias("to")))
    e.saturate()
    assert e.size("path") == 21 + 55

"""Queries over whole tables, against brute force on small tables."""

import pytest

from rulespark import queries


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables, each from its columns and rows."""

    def go(**made):
        for name, (columns, rows) in made.items():
            spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return go


def ask(spark, name, folder, names):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, folder).select(*names.split()).collect())


def test_same_generation(spark, tables):
    nations, customers, suppliers = [(0, 0), (1, 0), (2, 1)], [(1, 0), (49, 1), (50, 1), (1_999_500, 2), (5_000_000, 0)], [(1, 0), (50, 1), (7_000_000, 2)]
    folder = tables(nation=("n_nationkey long, n_regionkey long", nations), customer=("c_custkey long, c_nationkey long", customers), supplier=("s_suppkey long, s_nationkey long", suppliers))
    want = [("nation", a, "nation", b) for a, r in nations for b, s in nations if a != b and r == s]
    want += [("customer", c, "supplier", s) for c, n in customers for s, m in suppliers if n == m]
    assert ask(spark, "same_generation", folder, "a_is a b_is b") == sorted(want)


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double"
#: Two components, one a chain of 12 hops; few lines have a high quantity and discount.
CHAIN = [(k, (k + 1) // 2 + 1, k // 2 + 1, 50.0 if k % 5 == 0 else 3.0, 0.1 if k == 5 else 0.0) for k in range(12)] + [(90, 40, 41, 1.0, 0.0), (91, 44, 41, 1.0, 0.0), (92, 44, 41, 2.0, 0.0)]


def test_components_chain(spark, tables):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, p, s, *_ in CHAIN:
        a, b = sorted((find(("part", p)), find(("supplier", s))))
        root[b] = a  # parts come first, so the least part names its component
    want = sorted((*x, find(x)[1]) for x in list(root))
    assert ask(spark, "components_chain", tables(lineitem=(LINES, CHAIN)), "x_is x root") == want


def test_rewrite_commute(spark, tables):
    assert ask(spark, "rewrite_commute", tables(lineitem=(LINES, CHAIN)), "a b") == sorted({tuple(sorted((p, s))) for _, p, s, *_ in CHAIN})


def test_shortest_hops(spark, tables):
    hops, edge = {(0, 1): 0}, [(0, 1)]
    for n, v in edge:  # breadth first; grows as it goes
        for _, p, s, *_ in CHAIN:
            if (s if n == 0 else p) == v and (to := (1 - n, p if n == 0 else s)) not in hops:
                hops[to] = hops[n, v] + 1
                edge.append(to)
    assert max(hops.values()) > 4
    assert ask(spark, "shortest_hops", tables(lineitem=(LINES, CHAIN)), "n v hops") == sorted((*x, k) for x, k in hops.items())


def test_prim_bigint(spark, tables):
    rows = [(1, 7, 1, 49.0, 0.0), (2, 3, 1, 48.0, 0.0), (2, 3, 2, 1.0, 0.0), (9_000_000_000, 8_000_000_000, 1, 1.0, 0.0), (5, 0, 1, 50.0, 0.0)]
    want = {(o, p, str(o * p * p * 1000003), str(o * 7 // p)) for o, p, *_ in rows if p}
    assert ask(spark, "prim_bigint", tables(lineitem=(LINES, rows)), "o p m q") == sorted(want)

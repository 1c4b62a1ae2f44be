"""Programs of the rule language, with the sizes, checks and costs that they must give."""

import pytest
from pyspark.sql import functions as F

from rulespark.engine import Engine, ProgramError, term_id
from rulespark.functions.sorts import F64, I64, STRING

PATH = "(relation edge (i64 i64)) (relation path (i64 i64)) (rule ((edge x y)) ((path x y))) (rule ((path x y) (edge y z)) ((path x z)))"
MATH = '(datatype Math (Num i64) (Var String) (Add Math Math) (Mul Math Math))'


@pytest.fixture
def run(spark):
    def go(program, **options):
        e = Engine(spark, **options)
        e.run(program)
        return e

    return go


def test_ids_are_spark_hashes(spark):
    made = spark.range(1).select(F.xxhash64(F.lit("C"), F.lit(5).cast("long"), F.lit("é"), F.lit(-0.0)).alias("h")).head().h
    assert made == term_id("C", [(5, I64), ("é", STRING), (-0.0, F64)])


def test_closure(run):
    e = run(PATH + "(edge 1 2) (edge 2 3) (edge 3 4) (run 3) (check (path 1 4)) (fail (check (path 4 1)))")
    assert (e.size("edge"), e.size("path")) == (3, 6)


@pytest.mark.parametrize("seminaive", [True, False])
def test_closure_of_a_cycle(run, seminaive):
    e = run(PATH + "(edge 1 2) (edge 2 3) (edge 3 1) (run-schedule (saturate (run)))", seminaive=seminaive)
    assert e.size("path") == 9


def test_reachability_modulo_equality(run):
    """Rivers that meet: a mouth that is also a spring joins two courses."""
    e = run(
        "(datatype Place (Spring String) (Mouth String)) (relation flows (Place Place)) (relation reaches (Place Place i64))"
        "(rule ((flows a b)) ((reaches a b 1))) (rule ((reaches a b k) (flows b c) (< k 9)) ((reaches a c (+ k 1))))"
        '(flows (Spring "Iller") (Mouth "Iller")) (flows (Spring "Danube") (Mouth "Danube")) (flows (Spring "Lech") (Mouth "Lech"))'
        '(union (Mouth "Iller") (Spring "Danube")) (run-schedule (saturate (run)))'
        '(check (reaches (Spring "Iller") (Mouth "Danube") 2)) (fail (check (reaches (Spring "Iller") (Mouth "Lech") 2)))'
    )
    assert (e.size("flows"), e.size("Spring"), e.size("Mouth"), e.size("reaches")) == (3, 3, 3, 4)


def test_function_without_merge(run):
    """Triangular numbers, each from the one before."""
    e = run("(function tri (i64) i64 :no-merge) (set (tri 1) 1) (rule ((= s (tri n)) (< n 40)) ((set (tri (+ n 1)) (+ s (+ n 1))))) (run 12)")
    assert sorted(tuple(r) for r in e.rows("tri").collect()) == [(n, n * (n + 1) // 2) for n in range(1, 14)]
    e.run("(set (tri 13) 91)")  # the same value again is no conflict
    with pytest.raises(ProgramError, match="illegal merge"):
        e.run("(set (tri 13) 92)")


def test_rewrites_and_extraction(run):
    e = run(
        MATH + "(rewrite (Add a b) (Add b a)) (rewrite (Mul a (Add b c)) (Add (Mul a b) (Mul a c))) (rewrite (Mul (Num a) (Num b)) (Num (* a b)))"
        '(let $a (Mul (Num 2) (Add (Var "x") (Num 3)))) (let $b (Add (Num 6) (Mul (Num 2) (Var "x")))) (run 4) (check (= $a $b))'
    )
    assert e.extract_cost("$a") == 8
    assert len(e.run("(extract $a 2)")) == 2


def test_congruence(run):
    run(MATH + '(let $x (Add (Var "a") (Num 1))) (let $y (Add (Var "b") (Num 1))) (fail (check (= $x $y))) (union (Var "a") (Var "b")) (check (= $x $y))')


def test_zero_cost_cycle_extracts(run):
    e = run('(datatype T (Leaf i64) (Wrap T :cost 0)) (let $t (Leaf 1)) (union $t (Wrap $t)) (run 1)')
    assert e.run("(extract $t)") == ["(Leaf 1)"]


def test_costs(run):
    e = run("(datatype T (A i64 :cost 5) (B T)) (constructor H () T :unextractable) (let $t (B (A 1))) (union $t (H))")
    assert e.extract_cost("$t") == 7 and e.run("(extract (H))") == ["(B (A 1))"]


def test_lattice_merges(run):
    e = run(
        "(function lo (i64) i64 :merge (min old new)) (function hi (i64) i64 :merge (max old new)) (function any (i64) bool :merge (or old new)) (sort S (Set i64))"
        "(function all (i64) S :merge (set-union old new)) (relation r (i64 i64)) (r 1 5) (r 1 3) (r 1 9) (r 2 4)"
        "(rule ((r k v)) ((set (lo k) v) (set (hi k) v) (set (any k) (bool-> v 8)) (set (all k) (set-of v)))) (run 2)"
        "(check (= (lo 1) 3) (= (hi 1) 9) (= (any 1) true) (= (any 2) false) (= (all 1) (set-of 9 5 3)))"
    )
    assert e.step() is False


def test_merge_by_term(run):
    run(MATH + '(function f () Math :merge (Add old new)) (set (f) (Num 1)) (set (f) (Num 2)) (check (= (f) (Add (Num 1) (Num 2))))')


def test_merge_reads_function(run):
    e = run("(function foo () i64 :no-merge) (function bar () i64 :merge (foo)) (set (bar) 1)")
    with pytest.raises(Exception, match="lookup of foo failed"):
        e.run("(set (bar) 2)")


def test_counting_merge(run):
    run("(relation r (i64 i64)) (r 1 1) (r 1 2) (r 2 7) (function n (i64) i64 :merge (+ old new)) (rule ((r k v)) ((let w v) (set (n k) 1))) (run 3) (check (= (n 1) 2) (= (n 2) 1))")


def test_delete_then_insert_survives(run):
    e = run("(relation r (i64)) (relation s (i64)) (r 1) (r 2) (s 1) (rule ((s x)) ((delete (r x)))) (run 1)")
    assert e.size("r") == 1
    e.run("(ruleset both) (s 2) (rule ((s 2)) ((delete (r 2)) (r 2)) :ruleset both) (run both 1) (check (r 2))")


def test_subsume(run):
    e = run(MATH + "(rewrite (Add a b) (Num 1) :subsume) (relation seen (Math)) (ruleset look) (rule ((= e (Add a b))) ((seen e)) :ruleset look) (let $a (Add (Num 3) (Num 4))) (run 2) (run look 1)")
    e.run("(check (= $a (Num 1))) (check (Add (Num 3) (Num 4)))")
    assert e.size("seen") == 0 and e.run("(extract $a)") == ["(Num 1)"]


def test_push_pop_fail(run):
    """Popping gives back tables, rules, names and classes; a failed command leaves nothing behind."""
    e = run('(datatype T (K String)) (function best (String) i64 :merge (max old new)) (relation r (i64)) (set (best "a") 7) (K "x") (K "y")')
    e.run('(push 2) (set (best "a") 9) (set (best "b") 1) (union (K "x") (K "y")) (rule ((r n)) ((r (+ n 1)))) (r 0) (run 3) (sort Other)')
    assert (e.size("best"), e.size("r"), len(e.rules)) == (2, 4, 1)
    e.run('(check (= (K "x") (K "y"))) (pop) (check (= (best "a") 7)) (fail (check (= (K "x") (K "y")))) (sort Other)')
    assert (e.size("best"), e.size("r"), len(e.rules)) == (1, 0, 0)
    e.run('(fail (set (best "a") 30) (panic "stop")) (check (= (best "a") 7)) (pop)')
    with pytest.raises(ProgramError, match="should have failed"):
        e.run('(fail (check (= (best "a") 7)))')
    with pytest.raises(ProgramError, match="pop"):
        e.run("(pop)")


def plain_schedule(rounds, up, down):
    """A counter that `up` raises by one a step and `down` halves until it is odd."""
    seen, steps = {0}, 0
    for _ in range(rounds):
        for _ in range(up):
            new = {n + 1 for n in seen} - seen
            seen |= new
            steps += bool(new)
        for _ in range(down):
            new = {n // 2 for n in seen if n % 2 == 0} | {n * 5 for n in seen if n % 4 == 3 and n < 60}
            if new <= seen:
                break
            seen |= new
    return seen


@pytest.mark.parametrize(("rounds", "up"), [(1, 3), (3, 2), (4, 1)])
def test_schedules(run, rounds, up):
    e = run(
        "(relation n (i64)) (n 0) (ruleset up) (ruleset down) (rule ((n x)) ((n (+ x 1))) :ruleset up)"
        "(rule ((n x) (= 0 (% x 2))) ((n (/ x 2))) :ruleset down) (rule ((n x) (= 3 (% x 4)) (< x 60)) ((n (* x 5))) :ruleset down)"
        f"(run-schedule (repeat {rounds} (seq (repeat {up} up) (saturate down))))"
    )
    assert {r.c0 for r in e.rows("n").collect()} == plain_schedule(rounds, up, 99)


def test_until_and_combined_rulesets(run):
    e = run("(relation n (i64)) (ruleset a) (ruleset b) (unstable-combined-ruleset ab a b) (rule ((n x)) ((n (+ x 1))) :ruleset a) (n 0) (run ab 100 :until (n 4))")
    assert e.size("n") == 5


def test_panic_and_partial_primitives(run):
    e = run("(relation n (i64)) (n 0) (n 2) (relation q (i64 i64)) (rule ((n x) (= y (/ 10 x))) ((q x y))) (run 1)")
    assert e.size("q") == 1
    with pytest.raises(ProgramError, match="panic: no"):
        e.run('(rule ((n 2)) ((panic "no"))) (run 1)')
    with pytest.raises(Exception, match="call of primitive / failed"):
        e.run("(ruleset z) (rule ((n x)) ((q x (/ 1 x))) :ruleset z) (run z 1)")


@pytest.mark.parametrize(
    "check",
    [
        "(= (+ 9223372036854775806 1) 9223372036854775807)", "(= (/ -7 2) -3)", "(= (% -7 2) -1)", "(= (<< 1 62) 4611686018427387904)", "(= (log2 1025) 10)", "(= (not-i64 0) -1)", "(= (^ 6 3) 5)",
        '(= (to-string 1.0) "1.0")', '(= (to-string 1e16) "1e16")', '(= (to-string 12345678.5) "12345678.5")', '(= (to-string 0.0005) "0.0005")', '(= (to-string 1.5e-7) "1.5e-7")', "(= (to-i64 -2.9) -2)",
        "(= (to-i64 1e300) 9223372036854775807)", "(= (min 1.0 NaN) 1.0)", '(= (+ "a" "b" "c") "abc")', '(= (replace "aXbX" "X" "--") "a--b--")', '(= (replace "ab" "" "-") "-a-b-")', '(= (count-matches "abab" "ab") 2)',
        '(= (count-matches "abc" "") 4)', "(= (or false false true) true)", "(= (=> true false) false)", "(= (xor true false) true)", "(guard true)", "(!= 1 2)", "(= (bool-!= 1 1) false)",
        '(= (* (bigint 9223372036854775807) (bigint 10)) (from-string "92233720368547758070"))', '(= (to-string (<< (bigint 1) 70)) "1180591620717411303424")', "(= (/ (bigint -7) (bigint 2)) (bigint -3))",
        "(= (bigrat (bigint 2) (bigint 4)) (bigrat (bigint 1) (bigint 2)))", "(= (floor (bigrat (bigint -1) (bigint 2))) (bigrat (bigint -1) (bigint 1)))", "(= (sqrt (bigrat (bigint 4) (bigint 9))) (bigrat (bigint 2) (bigint 3)))",
    ],
)
def test_primitives(run, check):
    run(f"(check {check})")


@pytest.mark.parametrize(
    "check",
    ["(= (+ 9223372036854775807 1) 0)", "(= (/ 1 0) 0)", "(= (% 1 0) 0)", "(= (<< 1 64) 1)", "(= (log2 0) 0)", "(= (abs -9223372036854775808) 1)", "(= (/ 1.0 0.0) 0.0)", "(= (log 0.0) 0.0)", "(guard false)", "(< 2 1)", "(!= 1 1)"],
)
def test_primitives_without_result(run, check):
    run(f"(fail (check {check}))")


CONTAINERS = "(sort V (Vec i64)) (sort S (Set i64)) (sort M (Map i64 String)) (sort P (Pair i64 String)) (sort B (MultiSet i64)) (sort F (UnstableFn (i64) i64))"


@pytest.mark.parametrize(
    "check",
    [
        "(= (vec-get (vec-of 1 2 3) 1) 2)", "(= (vec-push (vec-of 1) 2) (vec-append (vec-of 1) (vec-of 2)))", "(= (vec-pop (vec-empty)) (vec-empty))", "(= (vec-set (vec-of 1 2) 0 5) (vec-of 5 2))", "(= (vec-remove (vec-of 1 2 3) 1) (vec-of 1 3))",
        "(vec-contains (vec-of 1 2) 2)", "(vec-not-contains (vec-of 1 2) 3)", "(= (vec-range 3) (vec-of 0 1 2))", "(= (vec-length (vec-range 0)) 0)", "(= (set-get (set-of 1 -1 2 4 1) 3) -1)", "(= (set-insert (set-of 2) 1) (set-of 1 2))",
        "(= (set-diff (set-of 1 2) (set-of 2)) (set-of 1))", "(= (set-intersect (set-of 1 2) (set-of 2 3)) (set-of 2))", '(= (map-get (map-insert (map-empty) 1 "a") 1) "a")', '(= (map-of 1 "a" 1 "b") (map-insert (map-empty) 1 "b"))',
        '(= (map-remove (map-of 1 "a" 2 "b") 1) (map-of 2 "b"))', '(= (pair-second (pair 1 "a")) "a")', "(= (multiset-count (multiset-of 1 1 2) 1) 2)", "(= (multiset-remove (multiset-of 1 1) 1) (multiset-of 1))",
        "(= (multiset-sum (multiset-of 1) (multiset-of 1 2)) (multiset-of 1 1 2))", "(= (multiset-intersection (multiset-of 1 1 2) (multiset-of 1 2 2)) (multiset-of 1 2))", "(= (multiset-pick-max (multiset-of 1 2 2)) 2)",
        "(= (multiset-reset-counts (multiset-of 1 1)) (multiset-of 1))", "(= (multiset-subtract (multiset-of 1 1 2) (multiset-of 1)) (multiset-of 1 2))", '(= (unstable-app (unstable-fn "+" 1) 2) 3)', '(= (unstable-vec-map (unstable-fn "*" 2) (vec-of 1 2)) (vec-of 2 4))',
    ],
)
def test_containers(run, check):
    run(f"{CONTAINERS} (check {check})")


def test_containers_are_rebuilt(run):
    run(MATH + '(sort MV (Vec Math)) (relation has (MV)) (has (vec-of (Var "a") (Num 1))) (union (Var "a") (Var "b")) (check (has (vec-of (Var "b") (Num 1)))) (check (= (vec-of (Var "a")) (vec-of (Var "b"))))')


def test_functions_make_terms(run):
    run(MATH + '(sort MV (Vec Math)) (sort F (UnstableFn (Math) Math)) (relation out (MV)) (rule ((= e (Var x))) ((out (unstable-vec-map (unstable-fn "Add" (Num 1)) (vec-of e))))) (Var "q") (run 1) (check (out (vec-of (Add (Num 1) (Var "q")))))')


@pytest.mark.parametrize(
    ("program", "message"),
    [
        ("(check (= (+ 1 1.0) 2))", "no \\+ takes"), ("(relation r (i64)) (r 1.0)", "expected"), ("(relation r (i64)) (r 1 2)", "takes 1"), ("(check (nope 1))", "unknown"), ("(function f () i64)", "needs :merge"),
        ("(relation r (i64)) (rule ((r x)) ((r y)))", "ungrounded|inferred"), ("(union 1 2)", "can't be united"), ("(datatype T (A)) (set (A) (A))", "set of constructor"), ("(constructor C () i64)", "declared sort"),
        ("(sort S) (sort S)", "already bound"), ("(relation r (i64)) (rule ((r x)) ((let x 1)))", "already bound"), ("(run nope 1)", "no ruleset"), ("(check", "missing"), ("(function f () i64 :merge old) (rule ((= 1 1)) ((set (f) (f))))", "needs :naive"),
        ("(relation r (i64)) (rule ((< x 3)) ((r x)))", "ungrounded"),
    ],
)
def test_errors(run, program, message):
    with pytest.raises(ProgramError, match=message):
        run(program)


def test_files(run, tmp_path):
    (tmp_path / "edges.tsv").write_text("1\t 2\n2\t3\n")
    e = run(PATH + f'(input edge "{tmp_path}/edges.tsv") (run 5) (print-function path 10 :mode csv) (print-size path)')
    assert e.outputs[1] == "3" and sorted(e.outputs[0].splitlines())[0].startswith("path,1,2")
    e.run(MATH + f'(output "{tmp_path}/terms" (Num 1) (Add (Num 1) (Var "a")))')
    assert (tmp_path / "terms").read_text() == '(Num 1)\n(Add (Num 1) (Var "a"))\n'
    (tmp_path / "bad.tsv").write_text("1\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        e.run(f'(input edge "{tmp_path}/bad.tsv")')


def test_tables_as_relations(run, spark):
    e = Engine(spark)
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (1, "a", 2.0), (3, "c", 0.5)], "k int, s string, x double")
    e.bind("t", df)
    assert e.size("t") == e.rows("t").count() == e.query("k s x", "(t k s x)").count() == 2 and e.print_size("t") == "2"
    assert [tuple(r) for r in e.query("k s", "(t k s x) (> x 1.0)").collect()] == [(1, "a")]
    e.bind("u", df.distinct(), unique=True)
    assert e.size("u") == 2 and "(t 2)" in e.print_size() and "(u 2)" in e.print_size()
    with pytest.raises(ProgramError, match="null"):
        e.bind("v", df, nulls="error")


def test_changes_are_written_not_tables(run, spark):
    """A few changed rows of a large function: what is written grows with them; scans leave the older rows out."""
    e = run("(function f (i64) i64 :merge (max old new))")
    e.insert_rows("f", spark.range(30_000).select("id", (F.col("id") % 7).alias("v")))
    base = e.tables["f"].parts[0]
    for k in range(3):
        e.insert_rows("f", spark.createDataFrame([(k, 100), (k + 1, 50), (40_000 + k, 1)], "id long, v long"))
    t = e.tables["f"]
    assert t.parts[0].df is base.df and sum(p.n for p in t.parts[1:]) + sum(n for _, n in t.parts[0].gone) < 30
    want = {i: i % 7 for i in range(30_000)} | {40_000: 1, 40_001: 1, 40_002: 1}
    for k in range(3):
        want[k], want[k + 1] = max(want[k], 100), max(want[k + 1], 50)
    assert e.size("f") == len(want) and {r.c0: r.out for r in e.rows("f").collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_rebuilding_with_containers_equals_plain_classes(run, seed):
    """Vectors and sets of terms, pairs united one after the other: rows are those of the classes."""
    import random

    from rulespark.operators.components import union_find

    rng = random.Random(seed)
    vectors = [[rng.randrange(9) for _ in range(rng.randrange(1, 4))] for _ in range(8)]
    e = run("(datatype T (K i64)) (sort V (Vec T)) (sort S (Set T)) (relation v (V)) (relation s (S)) (relation p (T T))")
    for own in vectors:
        terms = " ".join(f"(K {i})" for i in own)
        e.run(f"(v (vec-of {terms})) (s (set-of {terms})) (p (K {own[0]}) (K {own[-1]}))")
    edges = [(i, i) for i in range(9)]
    for _ in range(4):
        a, b = rng.randrange(9), rng.randrange(9)
        edges.append((a, b))
        e.run(f"(union (K {a}) (K {b}))")
        of = union_find(edges)
        assert e.size("v") == len({tuple(of[i] for i in own) for own in vectors}) and e.size("s") == len({frozenset(of[i] for i in own) for own in vectors})
        assert e.size("p") == len({(of[own[0]], of[own[-1]]) for own in vectors})
        own = rng.choice(vectors)
        e.run(f"(check (v (vec-of {' '.join(f'(K {of[i]})' for i in own)})))")


def test_cost_models(run):
    e = run('(datatype T (Short i64) (Long String :cost 3) (Both T T)) (let $t (Both (Long "abc") (Short 5))) (union (Long "abc") (Short 9))')
    assert e.extract_cost("$t") == 5 and e.run("(extract $t)") == ["(Both (Short 9) (Short 5))"]

    def model(name, cost, args):
        return args[0] * 10 if name == "Short" else F.length(args[0]) if name == "Long" else F.lit(cost)

    assert e.extract_cost("$t", model) == 1 + (3 + 1) + (50 + 1) and e.extract(e.parser.expr("$t"), model=model) == ['(Both (Long "abc") (Short 5))']


def test_own_commands(run, spark):
    e, said = Engine(spark), []
    e.add_command("say", lambda engine, args: said.append((args, engine.size("r"))))
    e.run('(relation r (i64)) (r 1) (say hello 2) (r 2) (say)')
    assert [n for _, n in said] == [1, 2] and len(said[0][0]) == 2


def test_graph_export(run, tmp_path):
    import json

    from rulespark.sources.facts import write_graph

    e = run(MATH + "(Add (Num 1) (Num 2))")
    write_graph(e, f"{tmp_path}/g.json")
    write_graph(e, f"{tmp_path}/g.dot")
    nodes = json.loads((tmp_path / "g.json").read_text())["nodes"]
    assert sum(n["op"] == "Num" for n in nodes.values()) == 2 and "digraph" in (tmp_path / "g.dot").read_text()

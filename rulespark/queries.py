"""Queries over the test tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulespark.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Data], DataFrame]], Callable]:
    """Register a query, by its name; it gets the tables of a folder."""

    def register(f: Callable[[Data], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class Data:
    """An engine, and the tables of a folder as its relations."""

    def __init__(self, spark: SparkSession, sf_dir: str, **options):
        self.spark, self.sf_dir = spark, sf_dir
        self.engine = Engine(spark, **options)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def bind(self, relation: str, table: str, columns: str, out: str | None = None, unique: bool = True) -> Data:
        """Columns of a table as a relation or function. unique: the columns hold a key of the table."""
        self.engine.bind(relation, self.table(table).select(*columns.split()), out, unique)
        return self

    def run(self, program: str) -> Data:
        self.engine.run(program)
        return self

    def ask(self, names: str, facts: str) -> DataFrame:
        return self.engine.query(names, facts)

    def rows(self, function: str, names: str) -> DataFrame:
        return self.engine.rows(function).toDF(*names.split())


# ---- scans, filters and joins


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::BIGINT AS r FROM nation")
def scan_relation(d: Data) -> DataFrame:
    return d.bind("nation", "nation", "n_nationkey n_name n_regionkey").ask("k name r", "(nation k name r)")


@query("SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderstatus = 'F'")
def filter_const(d: Data) -> DataFrame:
    return d.bind("orders", "orders", "o_orderkey o_custkey o_orderstatus").ask("o c", '(orders o c "F")')


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation WHERE n_nationkey = n_regionkey")
def filter_repeat_var(d: Data) -> DataFrame:
    return d.bind("nation", "nation", "n_nationkey n_name n_regionkey").ask("k name", "(nation k name k)")


@query("SELECT c_custkey AS c, c_mktsegment AS m, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey")
def join_2way(d: Data) -> DataFrame:
    d.bind("customer", "customer", "c_custkey c_mktsegment").bind("orders", "orders", "o_orderkey o_custkey")
    return d.ask("c m o", "(customer c m) (orders o c)")


@query("SELECT c_custkey AS c, o_orderkey AS o, l_linenumber::BIGINT AS n, l_partkey AS p FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def join_3way(d: Data) -> DataFrame:
    d.bind("customer", "customer", "c_custkey c_mktsegment").bind("orders", "orders", "o_orderkey o_custkey").bind("line", "lineitem", "l_orderkey l_linenumber l_partkey", unique=False)
    return d.ask("c o n p", '(customer c "BUILDING") (orders o c) (line o n p)')


@query("SELECT c_custkey AS c, p_brand AS b FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def join_4way(d: Data) -> DataFrame:
    d.bind("customer", "customer", "c_custkey").bind("orders", "orders", "o_orderkey o_custkey")
    d.bind("line", "lineitem", "l_orderkey l_partkey", unique=False).bind("part", "part", "p_partkey p_brand")
    return d.ask("c b", "(customer c) (orders o c) (line o p) (part p b)")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta(d: Data) -> DataFrame:
    return d.bind("supplier", "supplier", "s_suppkey s_nationkey s_acctbal").ask("a b", "(supplier a n x) (supplier b n y) (< x y)")


@query("SELECT a.conv_id AS c, a.turn AS t, a.role AS r, b.role AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY ALL")
def join_computed_key(d: Data) -> DataFrame:
    return d.bind("turn", "conversations", "conv_id turn role", unique=False).ask("c t r s", "(turn c t r) (turn c (+ t 1) s)")


@query("SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey")
def join_triangle_cyclic(d: Data) -> DataFrame:
    d.bind("customer", "customer", "c_custkey c_nationkey").bind("orders", "orders", "o_orderkey o_custkey")
    d.bind("line", "lineitem", "l_orderkey l_suppkey", unique=False).bind("supplier", "supplier", "s_suppkey s_nationkey")
    return d.ask("c s", "(customer c n) (orders o c) (line o s) (supplier s n)")


@query("SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_existential(d: Data) -> DataFrame:
    return d.bind("customer", "customer", "c_custkey").bind("orders", "orders", "o_orderkey o_custkey").ask("c", "(customer c) (orders _ c)")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def cross_small(d: Data) -> DataFrame:
    return d.bind("region", "region", "r_regionkey r_name").ask("a b", "(region x a) (region y b)")


@query("SELECT c_nationkey::BIGINT AS n FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier")
def union_rules(d: Data) -> DataFrame:
    d.bind("customer", "customer", "c_custkey c_nationkey").bind("supplier", "supplier", "s_suppkey s_nationkey")
    d.run("(relation place (i64)) (rule ((customer c n)) ((place n))) (rule ((supplier s n)) ((place n))) (run 1)")
    return d.rows("place", "n")


@query("SELECT c_nationkey::BIGINT AS n FROM customer WHERE c_mktsegment = 'MACHINERY' INTERSECT SELECT s_nationkey::BIGINT FROM supplier WHERE s_acctbal > 5000")
def intersect_rel(d: Data) -> DataFrame:
    d.bind("customer", "customer", "c_custkey c_nationkey c_mktsegment").bind("supplier", "supplier", "s_suppkey s_nationkey s_acctbal")
    return d.ask("n", '(customer c n "MACHINERY") (supplier s n b) (> b 5000.0)')


# ---- merges


def _merged(d: Data, merge: str, value: str, sort: str = "f64") -> DataFrame:
    d.bind("orders", "orders", "o_orderkey o_custkey o_totalprice o_orderstatus")
    d.run(f"(function f (i64) {sort} :merge {merge}) (rule ((orders o c p s)) ((let k o) (set (f c) {value}))) (run 1)")
    return d.rows("f", "c v")


@query("SELECT o_custkey AS c, min(o_totalprice) AS v FROM orders GROUP BY 1")
def merge_min(d: Data) -> DataFrame:
    return _merged(d, "(min old new)", "p")


@query("SELECT o_custkey AS c, max(o_totalprice) AS v FROM orders GROUP BY 1")
def merge_max(d: Data) -> DataFrame:
    return _merged(d, "(max old new)", "p")


@query("SELECT o_custkey AS c, bool_or(o_totalprice > 300000) AS v FROM orders GROUP BY 1")
def merge_or(d: Data) -> DataFrame:
    return _merged_bool(d, "or")


@query("SELECT o_custkey AS c, bool_and(o_totalprice > 100000) AS v FROM orders GROUP BY 1")
def merge_and(d: Data) -> DataFrame:
    return _merged_bool(d, "and")


def _merged_bool(d: Data, op: str) -> DataFrame:
    bound = {"or": 300000.0, "and": 100000.0}[op]
    d.bind("orders", "orders", "o_orderkey o_custkey o_totalprice")
    d.run(
        f"(function f (i64) bool :merge ({op} old new)) (rule ((orders o c p) (> p {bound})) ((set (f c) true))) (rule ((orders o c p) (<= p {bound})) ((set (f c) false))) (run 1)"
    )
    return d.rows("f", "c v")


@query("SELECT o_custkey AS c, count(*)::BIGINT AS v FROM orders GROUP BY 1")
def merge_sum(d: Data) -> DataFrame:
    return _merged(d, "(+ old new)", "1", "i64")


@query("SELECT o_custkey AS c, count(DISTINCT o_orderstatus)::BIGINT AS n, min(o_orderstatus) AS least FROM orders GROUP BY 1")
def merge_set_union(d: Data) -> DataFrame:
    d.bind("orders", "orders", "o_orderkey o_custkey o_orderstatus")
    d.run("(sort Set1 (Set String)) (function f (i64) Set1 :merge (set-union old new)) (rule ((orders o c s)) ((set (f c) (set-of s)))) (run 1)")
    return d.ask("c n least", "(= s (f c)) (= n (set-length s)) (= least (set-get s 0))")


@query("SELECT o_custkey AS c, greatest(100000.0::DOUBLE, least(200000.0::DOUBLE, max(o_totalprice))) AS v FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY 1 HAVING count(*) = 1")
def merge_general_fold(d: Data) -> DataFrame:
    return _merged(d, "(max 100000.0 (min 200000.0 (max old new)))", "p")


@query("SELECT o_custkey AS c, CASE WHEN count(*) > 1 THEN 0 ELSE 1 END::BIGINT AS v FROM orders GROUP BY 1")
def merge_const(d: Data) -> DataFrame:
    d.bind("orders", "orders", "o_orderkey o_custkey o_orderstatus")
    d.run("(function f (i64) i64 :merge 0) (rule ((orders o c s)) ((let k o) (set (f c) 1))) (run 1)")
    return d.rows("f", "c v")


# ---- deletions and flags


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderstatus <> 'P'")
def delete_rows(d: Data) -> DataFrame:
    d.bind("orders", "orders", "o_orderkey o_orderstatus")
    d.run('(relation live (i64)) (ruleset fill) (ruleset drop) (rule ((orders o s)) ((live o)) :ruleset fill) (rule ((orders o "P")) ((delete (live o))) :ruleset drop) (run-schedule fill drop)')
    return d.rows("live", "o")


@query("SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey <> 1")
def subsume_rows(d: Data) -> DataFrame:
    d.bind("nation", "nation", "n_nationkey n_regionkey")
    d.run(
        "(datatype Place (N i64)) (relation seen (i64)) (ruleset make) (ruleset hide) (ruleset see) (rule ((nation k r)) ((N k)) :ruleset make)"
        "(rule ((nation k 1)) ((subsume (N k))) :ruleset hide) (rule ((= p (N k))) ((seen k)) :ruleset see) (run-schedule make hide see)"
    )
    return d.rows("seen", "k")


# ---- recursion

_CLOSURE = """
WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id AS c, a.turn AS x, b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
p AS (SELECT c, x, y FROM e UNION SELECT p.c, p.x, e.y FROM p JOIN e ON e.c = p.c AND e.x = p.y)
"""
_PATHS = """
(relation edge (i64 i64 i64)) (relation path (i64 i64 i64)) (ruleset start)
(rule ((turn c t) (= u (+ t 1)) (turn c u)) ((edge c t u)) :ruleset start)
(rule ((edge c x y)) ((path c x y)))
(rule ((path c x y) (edge c y z)) ((path c x z)))
(run start 1)
"""


def _turns(d: Data) -> Data:
    return d.bind("turn", "conversations", "conv_id turn", unique=False).run(_PATHS)


@query(_CLOSURE + "SELECT * FROM p")
def tc_conversation(d: Data) -> DataFrame:
    return _turns(d).run("(run-schedule (saturate (run)))").rows("path", "c x y")


@query(_CLOSURE + "SELECT c, x, y, 2::BIGINT AS times FROM p")
def tc_seminaive_eq_naive(d: Data) -> DataFrame:
    """Each path, and in how many of a seminaive and a naive run it is."""
    fast, plain = (_turns(Data(d.spark, d.sf_dir, seminaive=s)).run("(run-schedule (saturate (run)))").rows("path", "c x y") for s in (True, False))
    return fast.unionAll(plain).groupBy("c", "x", "y").agg(F.count(F.lit(1)).alias("times"))


@query(_CLOSURE + "SELECT * FROM p WHERE y - x <= 2")
def bounded_run(d: Data) -> DataFrame:
    return _turns(d).run("(run 2)").rows("path", "c x y")


@query(_CLOSURE + "SELECT * FROM p WHERE y - x <= 3")
def run_until(d: Data) -> DataFrame:
    return _turns(d).run("(run 100 :until (path c x y) (= y (+ x 3)))").rows("path", "c x y")


@query("SELECT 'nation' AS a_is, a.n_nationkey::BIGINT AS a, 'nation' AS b_is, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey UNION SELECT 'customer', c_custkey, 'supplier', s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def same_generation(d: Data) -> DataFrame:
    """Nations of one region, and customers and suppliers of one nation; a tag tells them apart."""
    d.bind("nation", "nation", "n_nationkey n_regionkey").bind("customer", "customer", "c_custkey c_nationkey").bind("supplier", "supplier", "s_suppkey s_nationkey")
    d.run(
        "(relation parent (String i64 String i64)) (relation sg (String i64 String i64)) (ruleset start)"
        '(rule ((nation k r)) ((parent "nation" k "region" r)) :ruleset start)'
        '(rule ((customer c n)) ((parent "customer" c "nation" n)) :ruleset start) (rule ((supplier s n)) ((parent "supplier" s "nation" n)) :ruleset start)'
        '(rule ((parent "nation" x k p) (parent "nation" y k p) (!= x y)) ((sg "nation" x "nation" y))) (rule ((parent "customer" x k p) (parent "supplier" y k p)) ((sg "customer" x "supplier" y)))'
        "(run start 1) (run-schedule (saturate (run)))"
    )
    return d.rows("sg", "a_is a b_is b")


#: Breadth first, by levels; no graph of these tables is as deep as the bound, which only ends the recursion.
@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), r AS (SELECT 0::BIGINT AS n, min(s) AS v, 0::BIGINT AS k FROM e UNION SELECT 1 - n, CASE WHEN n = 0 THEN e.p ELSE e.s END, k + 1 FROM r JOIN e ON (n = 0 AND e.s = r.v OR n = 1 AND e.p = r.v) WHERE k < 40) SELECT n, v, min(k) AS hops FROM r GROUP BY ALL")
def shortest_hops(d: Data) -> DataFrame:
    """Hops from the least supplier to all parts (n = 1) and suppliers (n = 0) that it reaches over all lines."""
    d.bind("e", "lineitem", "l_partkey l_suppkey", unique=False)
    first = d.table("lineitem").agg(F.min("l_suppkey")).head()[0]
    start = "" if first is None else f"(set (hops 0 {first}) 0)"
    d.run(
        f"(function hops (i64 i64) i64 :merge (min old new)) {start}"
        "(rule ((= k (hops 0 s)) (e p s)) ((set (hops 1 p) (+ k 1)))) (rule ((= k (hops 1 p)) (e p s)) ((set (hops 0 s) (+ k 1)))) (run-schedule (saturate (run)))"
    )
    return d.rows("hops", "n v hops")


@query("SELECT r_name AS r, count(DISTINCT c_custkey)::BIGINT AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1")
def stratified_two_rulesets(d: Data) -> DataFrame:
    d.bind("region", "region", "r_regionkey r_name").bind("nation", "nation", "n_nationkey n_regionkey").bind("customer", "customer", "c_custkey c_nationkey").bind("orders", "orders", "o_orderkey o_custkey o_orderstatus")
    d.run(
        "(relation partial (i64)) (function n (String) i64 :merge (+ old new)) (ruleset first) (ruleset second)"
        '(rule ((orders o c "P")) ((partial c)) :ruleset first)'
        "(rule ((partial c) (customer c k) (nation k r) (region r name)) ((let x c) (set (n name) 1)) :ruleset second) (run-schedule (seq (saturate first) (run second)))"
    )
    return d.rows("n", "r n")


# ---- equality


@query("SELECT doc_id AS d, min(doc_id) OVER (PARTITION BY text) AS least FROM documents")
def components_minid(d: Data) -> DataFrame:
    docs = d.table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    d.engine.bind("doc", docs, unique=True)
    d.run(
        "(datatype Doc (D i64)) (function least (Doc) i64 :merge (min old new)) (ruleset make) (ruleset join) (ruleset name)"
        "(constructor C (String) Doc) (rule ((doc i h)) ((union (D i) (C h))) :ruleset make) (rule ((= x (D i))) ((set (least x) i)) :ruleset name) (run-schedule make name)"
    )
    return d.ask("d least", "(= x (D d)) (= least (least x))")


#: Suppliers that share a part, and the closure of that; a part's component is that of its suppliers.
@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), b AS (SELECT DISTINCT a.s AS x, c.s AS y FROM e a JOIN e c ON a.p = c.p), r AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y), c AS (SELECT r.x AS s, min(e.p) AS root FROM r JOIN e ON e.s = r.y GROUP BY 1) SELECT 'supplier' AS x_is, s AS x, root FROM c UNION ALL SELECT DISTINCT 'part', e.p, c.root FROM e JOIN c ON c.s = e.s")
def components_chain(d: Data) -> DataFrame:
    """The component of each part and supplier, over all lines, named by its least part."""
    d.bind("e", "lineitem", "l_partkey l_suppkey", unique=False)
    d.run("(datatype V (P i64) (S i64)) (function root (V) i64 :merge (min old new)) (ruleset name) (rule ((e p s)) ((union (P p) (S s)))) (rule ((= v (P i))) ((set (root v) i)) :ruleset name) (run 1) (run name 1)")
    parts, suppliers = (d.ask("x root", f"(= v ({kind} x)) (= root (root v))").select(F.lit(name).alias("x_is"), "x", "root") for kind, name in (("P", "part"), ("S", "supplier")))
    return parts.unionAll(suppliers)


@query("SELECT a.c_custkey AS a, min(b.c_custkey) AS least FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY 1")
def congruence(d: Data) -> DataFrame:
    """Customers whose terms F(N(k)) are one once the N(k) of a nation are; each with the least of its class."""
    d.bind("customer", "customer", "c_custkey c_nationkey")
    d.run("(datatype V (N i64) (R i64) (F V)) (function least (V) i64 :merge (min old new)) (ruleset unite) (ruleset name) (rule ((customer k r)) ((F (N k)))) (run 1)")
    d.run("(rule ((customer k r)) ((union (N k) (R r))) :ruleset unite) (rule ((customer k r) (= f (F v)) (= v (R r))) ((set (least f) k)) :ruleset name) (run unite 1) (run name 1)")
    return d.ask("a least", "(customer a r) (= v (N a)) (= f (F v)) (= least (least f))")


@query("SELECT count(*)::BIGINT AS terms, count(DISTINCT p_brand)::BIGINT AS brands FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def mint_ids_count(d: Data) -> DataFrame:
    d.bind("part", "part", "p_partkey p_brand p_type")
    d.run("(datatype Kind (K String String)) (rule ((part p b t)) ((K b t))) (run 1)")
    return d.ask("k b", "(= k (K b t))").agg(F.countDistinct("k").alias("terms"), F.countDistinct("b").alias("brands"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def rewrite_commute(d: Data) -> DataFrame:
    d.bind("e", "lineitem", "l_partkey l_suppkey", unique=False)
    d.run("(datatype V (Pair2 i64 i64)) (rewrite (Pair2 a b) (Pair2 b a)) (rule ((e p s)) ((Pair2 p s))) (run 2)")
    return d.ask("a b", "(= v (Pair2 a b)) (= v (Pair2 b a)) (<= a b)")


@query("SELECT p_brand AS b, min(CASE WHEN p_size < 10 THEN 2 WHEN p_size < 30 THEN 5 ELSE 9 END + 2)::BIGINT AS cost FROM part GROUP BY 1")
def extract_cost(d: Data) -> DataFrame:
    """The cost of each brand's cheapest term: a constructor by the size of one of its parts, over the part's brand and type."""
    from rulespark.operators.extract import costs

    d.bind("part", "part", "p_partkey p_brand p_type p_size")
    d.run(
        "(datatype V (T String) (Cheap V :cost 2) (Mid V :cost 5) (Dear V :cost 9)) (constructor Brand (String) V :unextractable)"
        "(rule ((part p b t n) (< n 10)) ((union (Brand b) (Cheap (T (+ b t)))))) (rule ((part p b t n) (>= n 10) (< n 30)) ((union (Brand b) (Mid (T (+ b t))))))"
        "(rule ((part p b t n) (>= n 30)) ((union (Brand b) (Dear (T (+ b t)))))) (run 1)"
    )
    best = costs(d.engine).select(F.col("id").alias("v"), "cost")
    return d.ask("v b", "(= v (Brand b))").join(best, "v").select("b", "cost")


@query("SELECT r, b, n FROM (SELECT row_number() OVER (PARTITION BY b ORDER BY n) AS r, b, n FROM (SELECT DISTINCT p_brand AS b, p_size::BIGINT AS n FROM part)) WHERE r <= 3")
def extract_topk(d: Data) -> DataFrame:
    """The 3 cheapest rows of each brand's class, one for each size."""
    d.bind("part", "part", "p_partkey p_brand p_size")
    d.run("(datatype V (Brand String) (Size i64 V)) (rule ((part p b n)) ((Size n (Brand b)))) (run 1)")
    found = d.ask("v n b", "(= v (Size n w)) (= w (Brand b))")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("n")).cast("long")).where("r <= 3").select("r", "b", "n")


# ---- primitives


def _lines(d: Data) -> Data:
    return d.bind("line", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", unique=False)


@query("SELECT DISTINCT l_orderkey AS o, l_linenumber::BIGINT AS n, l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS s, l_orderkey * l_partkey AS m, l_orderkey // l_partkey AS q, l_orderkey % l_partkey AS r, abs(l_orderkey - l_partkey) AS b FROM lineitem WHERE l_partkey <> 0")
def prim_i64_arith(d: Data) -> DataFrame:
    return _lines(d).ask("o n a s m q r b", "(line o n p z) (= a (+ o p)) (= s (- o p)) (= m (* o p)) (= q (/ o p)) (= r (% o p)) (= b (abs s))")


@query("SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_orderkey & l_partkey AS a, l_orderkey | l_partkey AS b, xor(l_orderkey, l_partkey) AS x, ~l_orderkey AS n FROM lineitem")
def prim_i64_bits(d: Data) -> DataFrame:
    return _lines(d).ask("o p a b x n", "(line o k p z) (= a (& o p)) (= b (| o p)) (= x (^ o p)) (= n (not-i64 o))")


@query("SELECT DISTINCT l_orderkey AS o, l_linenumber::BIGINT AS n, l_orderkey << l_linenumber AS a, l_orderkey >> l_linenumber AS b, floor(log2(l_orderkey))::BIGINT AS g FROM lineitem WHERE l_orderkey > 0")
def prim_i64_shift(d: Data) -> DataFrame:
    return _lines(d).ask("o n a b g", "(line o n p z) (= a (<< o n)) (= b (>> o n)) (= g (log2 o))")


@query("SELECT DISTINCT l_orderkey AS o, l_partkey AS p, least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b, l_orderkey < l_partkey AS c, l_orderkey::VARCHAR AS s FROM lineitem WHERE l_orderkey >= l_partkey")
def prim_i64_cmp(d: Data) -> DataFrame:
    return _lines(d).ask("o p a b c s", "(line o n p z) (>= o p) (= a (min o p)) (= b (max o p)) (= c (bool-< o p)) (= s (to-string o))")


@query("SELECT o_orderkey AS o, o_totalprice * 2.0::DOUBLE AS a, o_totalprice / 3.0::DOUBLE AS b, round(sqrt(o_totalprice), 6) AS c, -o_totalprice AS n, least(o_totalprice, 1000.0::DOUBLE) AS m, trunc(o_totalprice)::BIGINT AS i FROM orders")
def prim_f64(d: Data) -> DataFrame:
    found = d.bind("orders", "orders", "o_orderkey o_totalprice").ask("o a b c n m i", "(orders o p) (= a (* p 2.0)) (= b (/ p 3.0)) (= c (sqrt p)) (= n (neg p)) (= m (min p 1000.0)) (= i (to-i64 p))")
    return found.withColumn("c", F.round("c", 6))


@query("SELECT o_orderkey AS o, o_totalprice > 200000 AND o_orderstatus = 'F' AS a, o_totalprice > 200000 OR o_orderstatus = 'F' AS b, (o_totalprice > 200000) <> (o_orderstatus = 'F') AS x, NOT o_totalprice > 200000 OR o_orderstatus = 'F' AS i FROM orders")
def prim_bool(d: Data) -> DataFrame:
    d.engine.bind("flags", d.table("orders").select("o_orderkey", (F.col("o_totalprice") > 200000).alias("p"), (F.col("o_orderstatus") == "F").alias("q")), unique=True)
    return d.ask("o a b x i", "(flags o p q) (= a (and p q)) (= b (or p q)) (= x (xor p q)) (= i (=> p q))")


@query("SELECT doc_id AS d, md5(replace(text, 'the', 'a')) AS h, ((length(text) - length(replace(text, 'the', ''))) / 3)::BIGINT AS k, source || ':' || lang AS s FROM documents")
def prim_string(d: Data) -> DataFrame:
    found = d.bind("doc", "documents", "doc_id text source lang").ask("d r k s", '(doc d t o l) (= r (replace t "the" "a")) (= k (count-matches t "the")) (= s (+ o ":" l))')
    return found.select("d", F.md5("r").alias("h"), "k", "s")


@query("SELECT DISTINCT l_orderkey AS o, l_partkey AS p, (l_orderkey::HUGEINT * l_partkey * l_partkey * 1000003)::VARCHAR AS m, ((l_orderkey * 7)::HUGEINT // l_partkey)::VARCHAR AS q FROM lineitem WHERE l_partkey <> 0")
def prim_bigint(d: Data) -> DataFrame:
    d.bind("line", "lineitem", "l_orderkey l_partkey", unique=False)
    return d.ask("o p m q", "(line o p) (= b (bigint p)) (= m1 (* (* (* (bigint o) b) b) (bigint 1000003))) (= m (to-string m1)) (= q1 (/ (* (bigint o) (bigint 7)) b)) (= q (to-string q1))")


@query("SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r, ((n_nationkey + 1) // gcd(n_nationkey + 1, n_regionkey + 1))::VARCHAR AS n FROM nation")
def prim_bigrat(d: Data) -> DataFrame:
    return d.bind("nation", "nation", "n_nationkey n_regionkey").ask("k r n", "(nation k r) (= q (bigrat (bigint (+ k 1)) (bigint (+ r 1)))) (= n (to-string (numer q)))")


# ---- containers


def _events(d: Data, sort: str) -> Data:
    return d.bind("event", "events", "event_id user_id event_type").run(sort)


@query("SELECT event_id AS e, 3::BIGINT AS n, user_id AS a, user_id + 1 AS b, 2::BIGINT AS p FROM events")
def vec_ops(d: Data) -> DataFrame:
    _events(d, "(sort V (Vec i64))")
    return d.ask("e n a b p", "(event e u t) (= v (vec-push (vec-of e u) (+ u 1))) (= n (vec-length v)) (= a (vec-get v 1)) (= b (vec-get (vec-remove (vec-set v 0 7) 1) 1)) (= p (vec-length (vec-pop v))) (vec-contains v e)")


@query("SELECT user_id AS u, count(DISTINCT event_type)::BIGINT AS n, min(event_type) AS a FROM events GROUP BY 1")
def set_ops(d: Data) -> DataFrame:
    _events(d, "(sort S (Set String)) (function kinds (i64) S :merge (set-union old new)) (rule ((event e u t)) ((set (kinds u) (set-of t)))) (run 1)")
    return d.ask("u n a", "(= s (kinds u)) (= n (set-length s)) (= a (set-get s 0)) (set-contains (set-insert s a) a)")


@query("SELECT event_id AS e, user_id + 1 AS v, 2::BIGINT AS n FROM events WHERE event_id <> user_id")
def map_ops(d: Data) -> DataFrame:
    _events(d, "(sort M (Map i64 i64))")
    return d.ask("e v n", "(event e u t) (!= e u) (= m (map-insert (map-insert (map-empty) e u) u (+ u 1))) (= v (map-get m u)) (= n (map-length m)) (map-not-contains (map-remove m e) e)")


@query("SELECT event_id AS e, user_id AS u, event_type AS t FROM events")
def pair_ops(d: Data) -> DataFrame:
    _events(d, "(sort P (Pair i64 String))")
    return d.ask("e u t", "(event e u0 t0) (= p (pair u0 t0)) (= u (pair-first p)) (= t (pair-second p))")


@query("SELECT event_id AS e, CASE WHEN event_id = user_id THEN 3 ELSE 2 END::BIGINT AS c, 4::BIGINT AS n FROM events")
def multiset_ops(d: Data) -> DataFrame:
    _events(d, "(sort B (MultiSet i64))")
    return d.ask("e c n", "(event e u t) (= m (multiset-of e u e)) (= c (multiset-count m e)) (= n (multiset-length (multiset-insert m 7)))")


@query("SELECT event_id AS e, user_id * 3 AS a FROM events")
def fn_map(d: Data) -> DataFrame:
    _events(d, '(sort V (Vec i64)) (sort F1 (UnstableFn (i64) i64)) (relation out (i64 i64)) (rule ((event e u t)) ((let v (unstable-vec-map (unstable-fn "*" 3) (vec-of u e))) (out e (vec-get v 0)))) (run 1)')
    return d.rows("out", "e a")


# ---- more of each kind


@query("SELECT o_orderkey AS o, round(ln(o_totalprice), 6) AS l, round(exp(o_totalprice / 1000000.0::DOUBLE), 6) AS e, round(pow(o_totalprice / 1000.0::DOUBLE, 2.0), 4) AS q, abs(-o_totalprice) AS a, greatest(o_totalprice, 90000.5::DOUBLE) AS m, o_totalprice % 7.0::DOUBLE AS r, o_custkey::DOUBLE AS f, o_totalprice::VARCHAR AS s FROM orders WHERE o_totalprice > 1000.0 AND o_totalprice <= 400000.0")
def prim_f64_functions(d: Data) -> DataFrame:
    found = d.bind("orders", "orders", "o_orderkey o_custkey o_totalprice").ask(
        "o l e q a m r f s",
        "(orders o c p) (> p 1000.0) (<= p 400000.0) (= l (log p)) (= e (exp (/ p 1000000.0))) (= q (^ (/ p 1000.0) 2.0)) (= a (abs (neg p))) (= m (max p 90000.5)) (= r (% p 7.0)) (= f (to-f64 c)) (= s (to-string p))",
    )
    return found.withColumns({"l": F.round("l", 6), "e": F.round("e", 6), "q": F.round("q", 4)})


@query("SELECT o_orderkey AS o, (o_orderkey::HUGEINT & o_custkey)::VARCHAR AS a, (o_orderkey::HUGEINT | o_custkey)::VARCHAR AS b, xor(o_orderkey, o_custkey)::VARCHAR AS x, (-o_orderkey::HUGEINT - 1)::VARCHAR AS n, (o_orderkey::HUGEINT * 1099511627776)::VARCHAR AS l, (o_orderkey // 4)::VARCHAR AS r, length(ltrim(bin(o_orderkey), '0'))::VARCHAR AS w, least(o_orderkey, o_custkey)::VARCHAR AS m, o_orderkey <= o_custkey AS c FROM orders WHERE o_orderkey > 0")
def prim_bigint_bits(d: Data) -> DataFrame:
    return d.bind("orders", "orders", "o_orderkey o_custkey").ask(
        "o a b x n l r w m c",
        "(orders o k) (= i (bigint o)) (= j (bigint k)) (> i (bigint 0)) (= a (to-string (& i j))) (= b (to-string (| i j))) (= x (to-string (^ i j))) (= n (to-string (not-Z i)))"
        "(= l (to-string (<< i 40))) (= r (to-string (>> i 2))) (= w (to-string (bits i))) (= m (to-string (min i j))) (= c (bool-<= i j)) (= i (from-string (to-string i)))",
    )


_RATIONAL = "SELECT o_orderkey AS o, (o_orderkey + 1)::HUGEINT AS a, (o_custkey + 2)::HUGEINT AS b FROM orders"


@query(
    f"SELECT o, ((2 * a + b) // gcd(2 * a + b, 2 * b))::VARCHAR AS sn, (2 * b // gcd(2 * a + b, 2 * b))::VARCHAR AS sd, ((2 * a - b) // gcd(abs(2 * a - b), 2 * b))::VARCHAR AS dn, (3 * a // gcd(3 * a, b))::VARCHAR AS pn, (a // gcd(a, 3 * b))::VARCHAR AS qn,"
    f" (a // b)::VARCHAR AS f, ((a + b - 1) // b)::VARCHAR AS c, ((2 * a + b) // (2 * b))::VARCHAR AS r, (-(a // gcd(a, b)))::VARCHAR AS g, (a * a // gcd(a * a, b * b))::VARCHAR AS w, round(a::DOUBLE / b::DOUBLE, 6) AS t, (a // b)::BIGINT AS i FROM ({_RATIONAL}) WHERE a > b"
)
def prim_bigrat_arith(d: Data) -> DataFrame:
    found = d.bind("orders", "orders", "o_orderkey o_custkey").ask(
        "o sn sd dn pn qn f c r g w t i",
        "(orders o k) (= one (bigrat (bigint 1) (bigint 1))) (= q (bigrat (bigint (+ o 1)) (bigint (+ k 2)))) (> q one) (= half (bigrat (bigint 1) (bigint 2))) (= three (bigrat (bigint 3) (bigint 1))) (= two (bigrat (bigint 2) (bigint 1)))"
        "(= s (+ q half)) (= sn (to-string (numer s))) (= sd (to-string (denom s))) (= dn (to-string (numer (- q half)))) (= pn (to-string (numer (* q three)))) (= qn (to-string (numer (/ q three))))"
        "(= f (to-string (numer (floor q)))) (= c (to-string (numer (ceil q)))) (= r (to-string (numer (round q)))) (= g (to-string (numer (neg (abs q))))) (= w (to-string (numer (pow q two)))) (= t (to-f64 q)) (= i (to-i64 q))",
    )
    return found.withColumn("t", F.round("t", 6))


@query("SELECT o_orderkey AS o, NOT (o_totalprice > 200000) AS n, least(o_orderkey, o_custkey) AS a, greatest(o_orderstatus, 'G') AS b FROM orders WHERE o_totalprice > 100000 AND o_orderkey <> o_custkey")
def prim_guard_ordering(d: Data) -> DataFrame:
    d.engine.bind("flags", d.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") > 200000).alias("p"), (F.col("o_totalprice") > 100000).alias("q")), unique=True)
    return d.ask("o n a b", '(flags o c s p q) (guard q) (= n (not p)) (= a (ordering-min o c)) (= b (ordering-max s "G")) (!= o c) (value-eq o o)')


@query("SELECT event_id AS e, 5::BIGINT AS n, user_id AS x, 3::BIGINT AS r, 2::BIGINT AS l FROM events WHERE user_id <> event_id")
def vec_more(d: Data) -> DataFrame:
    _events(d, "(sort V (Vec i64))")
    return d.ask("e n x r l", "(event e u t) (= v (vec-append (vec-of e u) (vec-range 3))) (= n (vec-length v)) (= x (vec-get v 1)) (= r (vec-length (vec-range 3))) (= l (vec-get v 4)) (vec-contains v u) (vec-not-contains (vec-of e) u)")


@query("SELECT event_id AS e, CASE WHEN user_id = 1 THEN 2 ELSE 3 END::BIGINT AS n, CASE WHEN user_id = 1 THEN 1 ELSE 0 END::BIGINT AS i, CASE WHEN user_id = 1 THEN 1 ELSE 2 END::BIGINT AS d FROM events WHERE user_id <> 7 AND user_id <> 2")
def set_more(d: Data) -> DataFrame:
    _events(d, "(sort S (Set i64))")
    return d.ask("e n i d", "(event e u t) (= s (set-of 1 2)) (= o (set-of u)) (= n (set-length (set-union s o))) (= i (set-length (set-intersect s o))) (= d (set-length (set-diff s o))) (set-not-contains (set-remove s 1) 1) (set-not-contains o 7) (!= u 2)")


@query("SELECT event_id AS e, CASE WHEN event_id = user_id THEN 'b' ELSE 'a' END AS a, CASE WHEN event_id = user_id THEN 1 ELSE 2 END::BIGINT AS n FROM events")
def map_of_pairs(d: Data) -> DataFrame:
    _events(d, "(sort M (Map i64 String))")
    return d.ask("e a n", '(event e u t) (= m (map-of e "a" u "b")) (= a (map-get m e)) (= n (map-length m)) (map-contains m u)')


@query("SELECT event_id AS e, 5::BIGINT AS n, CASE WHEN user_id = 3 THEN 4 ELSE 2 END::BIGINT AS c, 2::BIGINT AS i, CASE WHEN user_id = 3 THEN 1 ELSE 2 END::BIGINT AS k, CASE WHEN user_id = 3 THEN 2 ELSE 1 END::BIGINT AS r, CASE WHEN user_id < 3 THEN user_id ELSE 3 END AS p FROM events")
def multiset_more(d: Data) -> DataFrame:
    _events(d, "(sort B (MultiSet i64))")
    return d.ask(
        "e n c i k r p",
        "(event e u t) (= a (multiset-of 3 3 u)) (= b (multiset-of u 9)) (= s (multiset-sum a b)) (= n (multiset-length s)) (= c (multiset-count s 3)) (= i (multiset-length (multiset-intersection a (multiset-of u 3))))"
        "(= k (multiset-length (multiset-reset-counts a))) (= r (multiset-count (multiset-remove a 3) 3)) (= p (multiset-pick a)) (multiset-contains s 9) (= (multiset-subtract s b) a)",
    )


@query("SELECT event_id AS e, 2 * user_id + 10 AS s, CASE WHEN user_id > 50 THEN 1 ELSE 0 END::BIGINT AS n, 2::BIGINT AS c FROM events WHERE user_id <> 5")
def multiset_functions(d: Data) -> DataFrame:
    _events(d, "(sort B (MultiSet i64)) (sort F1 (UnstableFn (i64) i64)) (sort F2 (UnstableFn (i64 i64) i64)) (sort P1 (UnstableFn (i64) bool)) (relation fns (F1 F2 P1)) (relation out (i64 i64 i64 i64))")
    d.run(
        '(fns (unstable-fn "*" 2) (unstable-fn "+") (unstable-fn "bool-<" 50))'
        "(rule ((event e u t) (!= u 5) (fns f g h)) ((let m (unstable-multiset-map f (multiset-of u 5))) (out e (unstable-multiset-reduce g 0 m) (multiset-length (unstable-multiset-filter h (multiset-of u))) (multiset-length m)))) (run 1)"
    )
    return d.rows("out", "e s n c")


@query("SELECT o_custkey AS c, 1::BIGINT AS first, 2::BIGINT AS last FROM orders GROUP BY 1")
def merge_old_new(d: Data) -> DataFrame:
    """What was written first, and what last, by two rulesets after each other."""
    d.bind("orders", "orders", "o_orderkey o_custkey")
    d.run("(function a (i64) i64 :merge old) (function b (i64) i64 :merge new) (ruleset one) (ruleset two) (rule ((orders o c)) ((set (a c) 1) (set (b c) 1)) :ruleset one) (rule ((orders o c)) ((set (a c) 2) (set (b c) 2)) :ruleset two) (run-schedule one two)")
    return d.ask("c first last", "(= first (a c)) (= last (b c))")


@query("SELECT c, count(*)::BIGINT AS n, sum(p)::BIGINT AS total FROM (SELECT DISTINCT o_custkey AS c, floor(o_totalprice / 50000)::BIGINT AS p FROM orders) GROUP BY 1")
def merge_by_terms(d: Data) -> DataFrame:
    """Values that meet become a term (Both old new); its leaves are the distinct values."""
    d.engine.bind("orders", d.table("orders").select("o_custkey", F.floor(F.col("o_totalprice") / 50000).alias("p")))
    d.run(
        "(datatype T (Leaf i64) (Both T T)) (function f (i64) T :merge (Both old new)) (relation in (i64 T)) (relation leaf (i64 i64)) (ruleset down)"
        "(rule ((orders c p)) ((set (f c) (Leaf p)))) (rule ((= t (f c))) ((in c t)) :ruleset down) (rule ((in c t) (= t (Both a b))) ((in c a) (in c b)) :ruleset down) (rule ((in c t) (= t (Leaf p))) ((leaf c p)) :ruleset down)"
        "(run 1) (run-schedule (saturate (run down)))"
    )
    return d.rows("leaf", "c p").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))


@query("SELECT DISTINCT p_brand AS b, p_size::BIGINT AS n FROM part")
def birewrite_both_ways(d: Data) -> DataFrame:
    """Terms of either form have one of the other form in their class."""
    d.bind("part", "part", "p_partkey p_brand p_size")
    d.run("(datatype V (A String i64) (B i64 String)) (birewrite (A x y) (B y x)) (ruleset fill) (rule ((part p b n) (< n 25)) ((A b n)) :ruleset fill) (rule ((part p b n) (>= n 25)) ((B n b)) :ruleset fill) (run fill 1) (run 2)")
    return d.ask("b n", "(= v (A b n)) (= v (B n b))")


@query("SELECT c_custkey AS c, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def lookup_in_head(d: Data) -> DataFrame:
    """A rule's action looks a function up for each match."""
    d.bind("customer", "customer", "c_custkey c_nationkey").bind("name-of", "nation", "n_nationkey n_name", out="n_name")
    d.run("(relation lives (i64 String)) (rule ((customer c n)) ((lives c (name-of n))) :naive) (run 1)")
    return d.rows("lives", "c name")


@query("SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem")
def insert_rows_in_bulk(d: Data) -> DataFrame:
    """Rows of a table, most of them repeated, inserted into a relation in two parts."""
    d.run("(relation sold (i64 i64))")
    lines = d.table("lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    for few in (True, False):
        d.engine.insert_rows("sold", lines.where((F.col("l_linenumber") <= 2) == few).drop("l_linenumber"))
    return d.rows("sold", "p s")


@query("SELECT DISTINCT o_custkey AS c FROM orders WHERE o_totalprice > 200000 ORDER BY 1")
def backoff_schedule(d: Data) -> DataFrame:
    """A rule that a scheduler holds back and lets run again until nothing is left."""
    from rulespark.schedulers import Backoff, run_with

    d.bind("orders", "orders", "o_orderkey o_custkey o_totalprice")
    d.run("(relation good (i64)) (rule ((orders o c p) (> p 200000.0)) ((good c)))")
    backoff = Backoff(limit=100, ban=1)
    while run_with(d.engine, backoff, 30):  # true while matches wait
        pass
    return d.rows("good", "c")


@query("SELECT 'role' AS name, count(DISTINCT role)::BIGINT AS n FROM conversations UNION ALL SELECT 'said', count(*) FROM (SELECT DISTINCT conv_id, role FROM conversations) UNION ALL SELECT 'status', count(DISTINCT nullif(o_orderstatus, 'P')) FROM orders")
def print_size_distinct(d: Data) -> DataFrame:
    """Sizes of relations of columns that repeat, and that hold nulls."""
    d.bind("role", "conversations", "role", unique=False).bind("said", "conversations", "conv_id role", unique=False)
    d.engine.bind("status", d.table("orders").select(F.expr("nullif(o_orderstatus, 'P')").alias("s")))
    return d.spark.createDataFrame([(n, int(d.engine.print_size(n))) for n in ("role", "said", "status")], "name string, n long")


@query("SELECT s_suppkey AS s, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'fair' END AS k, (CASE WHEN s_acctbal < 0 THEN 2 ELSE 3 END)::BIGINT AS cost FROM supplier")
def extract_container_cost(d: Data) -> DataFrame:
    """Costs of terms over vectors: a row's constructor, and the sum of its elements; a name costs its constructor and 1."""
    from rulespark.operators.extract import costs

    d.bind("supplier", "supplier", "s_suppkey s_acctbal")
    d.run(
        '(datatype* (T (Name String) (Row V)) (sort V (Vec T)) (Tag (Of i64 T)))'
        '(rule ((supplier s b) (< b 0.0)) ((Of s (Row (vec-of (Name "debt")))) (union (Of s (Row (vec-of (Name "debt")))) (Of s (Name "debt"))))) (rule ((supplier s b) (>= b 0.0)) ((Of s (Row (vec-of (Name "fair")))))) (run 1)'
    )
    best = costs(d.engine).select(F.col("id").alias("t"), "cost")
    found = d.ask("s t k", "(= x (Of s t)) (= t (Name k))").unionAll(d.ask("s t k", "(= x (Of s t)) (= t (Row v)) (= n (vec-get v 0)) (= n (Name k))"))
    return found.join(best, "t").groupBy("s", "k").agg(F.min("cost").alias("cost"))


# ---- output


@query("SELECT 'customer' AS name, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def print_size_all(d: Data) -> DataFrame:
    d.bind("customer", "customer", "c_custkey").bind("nation", "nation", "n_nationkey").bind("orders", "orders", "o_orderkey")
    lines = [x.strip("() ").split() for x in d.engine.print_size().splitlines()]
    return d.spark.createDataFrame([(name, int(n)) for name, n in lines], "name string, n long")


@query("SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 10")
def topk_limit(d: Data) -> DataFrame:
    return d.bind("orders", "orders", "o_orderkey o_totalprice").rows("orders", "o p").orderBy(F.col("p").desc(), "o").limit(10)

"""The registered queries of the rule engine and their SQL twins.

Each shows one feature on the driver's tables: helper relations are plain selections, written
once for Spark and once as common tables for the SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lubm
from .ast import Program
from .durable import shared_folder
from .engine import Engine
from .owl import meta_rules, ontology_rules
from .rdf import parse_triples
from .sources.files import write_ntriples, write_tsv
from .sources.triples import input_rules
from .sparql import parse_query, translate

# --------------------------------------------------------------------------- helper relations


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs_of(table: str, *columns: str, distinct: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table).selectExpr(*columns)
        return df.distinct() if distinct else df

    return load


def parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").filter("p_partkey > 1").selectExpr("p_partkey AS x", "p_partkey div 2 AS y")


def turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    after = t.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"))
    return t.join(after, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).selectExpr("conv_id * 1000 + turn AS a", "conv_id * 1000 + turn + 1 AS b")


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p")).distinct()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of all tables that have some."""
    out = None
    for table, columns in FACT_PARTS:
        part = _table(spark, sf_dir, table).selectExpr(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def _fact(table: str, s: str, p: str, o: str) -> tuple[str, tuple[str, str, str]]:
    return table, (f"{s} AS s", f"'{p}' AS p", f"{o} AS o")


FACT_PARTS = [
    _fact("region", "concat('ex:region', r_regionkey)", "rdf:type", "'ex:Region'"),
    _fact("region", "concat('ex:region', r_regionkey)", "ex:name", "r_name"),
    _fact("nation", "concat('ex:nation', n_nationkey)", "rdf:type", "'ex:Nation'"),
    _fact("nation", "concat('ex:nation', n_nationkey)", "ex:name", "n_name"),
    _fact("nation", "concat('ex:nation', n_nationkey)", "ex:inRegion", "concat('ex:region', n_regionkey)"),
    _fact("supplier", "concat('ex:supplier', s_suppkey)", "rdf:type", "'ex:Supplier'"),
    _fact("supplier", "concat('ex:supplier', s_suppkey)", "ex:inNation", "concat('ex:nation', s_nationkey)"),
    _fact("customer", "concat('ex:customer', c_custkey)", "rdf:type", "'ex:Customer'"),
    _fact("customer", "concat('ex:customer', c_custkey)", "ex:inNation", "concat('ex:nation', c_nationkey)"),
    _fact("customer", "concat('ex:customer', c_custkey)", "ex:segment", "c_mktsegment"),
]

#: Relation name: (loader, SQL of the same rows with the same column names).
INPUTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "region": (_pairs_of("region", "r_regionkey", "r_name"), "SELECT r_regionkey, r_name FROM region"),
    "nation": (_pairs_of("nation", "n_nationkey", "n_name", "n_regionkey"), ""),
    "customer": (_pairs_of("customer", "c_custkey", "c_name", "c_nationkey"), ""),
    "supplier": (_pairs_of("supplier", "s_suppkey", "s_nationkey"), ""),
    "orders": (_pairs_of("orders", "o_orderkey", "o_custkey"), ""),
    "part": (_pairs_of("part", "p_partkey"), ""),
    "parent": (parent, "SELECT p_partkey AS x, p_partkey // 2 AS y FROM part WHERE p_partkey > 1"),
    "turn": (turn, "SELECT DISTINCT s.conv_id * 1000 + s.turn AS a, s.conv_id * 1000 + s.turn + 1 AS b FROM conversations s JOIN conversations n ON s.conv_id = n.conv_id AND n.turn = s.turn + 1"),
    "supplies": (_pairs_of("lineitem", "l_suppkey AS s", "l_partkey AS p", distinct=True), "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem"),
    "bought": (bought, "SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "did": (_pairs_of("events", "user_id AS u", "event_type AS e", distinct=True), "SELECT DISTINCT user_id AS u, event_type AS e FROM events"),
    "natpair": (_pairs_of("nation", "n_nationkey", "n_regionkey"), ""),
    "facts": (facts, " UNION ALL ".join(f"SELECT {', '.join(c)} FROM {t}" for t, c in FACT_PARTS)),
}


def _with(names: list[str], body: str, recursive: bool = False) -> str:
    parts = [f"{n} AS ({INPUTS[n][1]})" for n in names if INPUTS[n][1] and not (n == "region")]
    own = body.strip()
    if recursive:
        return "WITH RECURSIVE " + ", ".join([*parts, own])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + own


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine_with(spark: SparkSession, sf_dir: str, inputs: list[str], **options: object) -> Engine:
    engine = Engine(spark, **options)
    for n in inputs:
        engine.register(n, INPUTS[n][0](spark, sf_dir))
    return engine


def rules(name: str, inputs: str, program: str, columns: str, sql: str, query: str | None = None, recursive: bool = False) -> None:
    """Register a query of a rule program.  ``inputs`` and ``columns`` are lists in one text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_with(spark, sf_dir, inputs.split()).add(program).query(query).toDF(*columns.split())

    QUERIES[name] = run
    ORACLES[name] = _with(inputs.split(), sql, recursive)


# --------------------------------------------------------------------------- selection and projection

rules("copy", "nation", "o(K, N) :- nation(K, N, _).", "k n", "SELECT DISTINCT n_nationkey AS k, n_name AS n FROM nation")
rules("filter_const_text", "did", 'o(U) :- did(U, "purchase").', "u", "SELECT DISTINCT u FROM did WHERE e = 'purchase'")
rules("filter_const_number", "nation", "o(K, N) :- nation(K, N, 1).", "k n", "SELECT DISTINCT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey = 1")
rules("filter_same_var", "natpair", "o(N) :- natpair(N, N).", "n", "SELECT DISTINCT n_nationkey AS n FROM nation WHERE n_nationkey = n_regionkey")
rules("project_const", "region", 'o(K, "x", K) :- region(K, _).', "k x k2", "SELECT DISTINCT r_regionkey AS k, 'x' AS x, r_regionkey AS k2 FROM region")
rules("project_dup", "region", "o(K, K, N) :- region(K, N).", "k k2 n", "SELECT DISTINCT r_regionkey AS k, r_regionkey AS k2, r_name AS n FROM region")

# --------------------------------------------------------------------------- joins

rules("join_1key", "nation region", "o(N, R) :- nation(_, N, K), region(K, R).", "n r", "SELECT DISTINCT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
rules("join_2key", "supplies bought", "both(X, P) :- supplies(X, P), bought(X, P).", "x p", "SELECT DISTINCT s AS x, supplies.p FROM supplies JOIN bought ON s = c AND supplies.p = bought.p")
rules("join_3way", "customer nation region", "o(C, R) :- customer(C, _, N), nation(N, _, K), region(K, R).", "c r", "SELECT DISTINCT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
rules("self_join", "supplier", "o(A, B) :- supplier(A, N), supplier(B, N).", "a b", "SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey")
rules("cross", "region", "o(A, B) :- region(A, _), region(B, _).", "a b", "SELECT DISTINCT x.r_regionkey AS a, y.r_regionkey AS b FROM region x CROSS JOIN region y")
rules("semi", "customer orders", "o(C, N) :- customer(C, N, _), orders(_, C).", "c n", "SELECT DISTINCT c_custkey AS c, c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")

# --------------------------------------------------------------------------- negation

rules("anti_1", "customer supplier", "o(C) :- customer(C, _, _), not supplier(C, _).", "c", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
rules("anti_2", "supplies bought", "o(X, P) :- supplies(X, P), not bought(X, P).", "x p", "SELECT DISTINCT s AS x, p FROM supplies WHERE NOT EXISTS (SELECT 1 FROM bought WHERE c = s AND bought.p = supplies.p)")
rules("anti_two", "part supplies bought", "o(P) :- not supplies(3, P), part(P), not bought(5, P).", "p", "SELECT DISTINCT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM supplies WHERE s = 3 AND p = p_partkey) AND NOT EXISTS (SELECT 1 FROM bought WHERE c = 5 AND p = p_partkey)")
rules("anti_exist", "customer supplier", "o(C) :- customer(C, _, _), not supplier(_, C).", "c", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_custkey)")
rules("anti_bool", "region nation", "none() :- nation(_, _, 99). o(R) :- region(R, _), not none().", "r", "SELECT DISTINCT r_regionkey AS r FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 99)")

# --------------------------------------------------------------------------- set operations, facts

rules("union", "did", 'o(U) :- did(U, "purchase"). o(U) :- did(U, "signup").', "u", "SELECT u FROM did WHERE e = 'purchase' UNION SELECT u FROM did WHERE e = 'signup'")
rules("intersect", "did", 'a(U) :- did(U, "purchase"). b(U) :- did(U, "error"). o(U) :- a(U), b(U).', "u", "SELECT u FROM did WHERE e = 'purchase' INTERSECT SELECT u FROM did WHERE e = 'error'")
rules("except", "bought supplies", "a(P) :- bought(1, P). b(P) :- supplies(2, P). o(P) :- a(P), not b(P).", "p", "SELECT p FROM bought WHERE c = 1 EXCEPT SELECT p FROM supplies WHERE s = 2")
rules("facts", "", 'label("0", "south"). label("1", "west"). label("1", "west"). label(2, "it\'\'s").'.replace("''", "'"), "k v", "SELECT * FROM (VALUES ('0', 'south'), ('1', 'west'), ('2', 'it''s')) AS t(k, v)")
rules("facts_join", "region", 'label("0", "south"). label("1", "west"). o(N, L) :- region(K, N), label(K, L).', "n l", "SELECT DISTINCT r_name AS n, l FROM region JOIN (VALUES ('0', 'south'), ('1', 'west')) AS t(k, l) ON CAST(r_regionkey AS VARCHAR) = k")
rules("empty_pred", "region", "o(K) :- region(K, _), nowhere(K).", "k", "SELECT CAST(r_regionkey AS VARCHAR) AS k FROM region WHERE 1 = 0")
rules("zero_arity", "nation region", 'any() :- nation(_, _, 1). o("yes") :- any(), region(_, _).', "v", "SELECT DISTINCT 'yes' AS v FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1)")

# --------------------------------------------------------------------------- recursion

CLOSURE = "c(x, y) AS (SELECT x, y FROM parent UNION SELECT c.x, p.y FROM c JOIN parent p ON c.y = p.x)"
LINEAR = "anc(X, Y) :- parent(X, Y). anc(X, Z) :- anc(X, Y), parent(Y, Z). "
rules("tc_linear", "parent", LINEAR, "x y", f"{CLOSURE} SELECT x, y FROM c", recursive=True)
rules("tc_nonlinear", "parent", "anc(X, Y) :- parent(X, Y). anc(X, Z) :- anc(X, Y), anc(Y, Z).", "x y", f"{CLOSURE} SELECT x, y FROM c", recursive=True)
rules("tc_bound_source", "parent", LINEAR, "y", f"{CLOSURE} SELECT DISTINCT y FROM c WHERE x = 199", query="anc(199, Y)", recursive=True)
rules("tc_bound_target", "parent", LINEAR, "x", f"{CLOSURE} SELECT DISTINCT x FROM c WHERE y = 5", query="anc(X, 5)", recursive=True)
START = "s AS (SELECT DISTINCT a AS x FROM turn WHERE a NOT IN (SELECT b FROM turn))"
rules("mutual_even_odd", "turn", "inner(Y) :- turn(_, Y). first(X) :- turn(X, _), not inner(X). even(X) :- first(X). even(Y) :- odd(X), turn(X, Y). odd(Y) :- even(X), turn(X, Y).", "x", f"{START}, r(x, n) AS (SELECT x, 0 FROM s UNION SELECT b, 1 - n FROM r JOIN turn ON x = a) SELECT DISTINCT x FROM r WHERE n = 1", query="odd", recursive=True)
rules("mutual_3way", "turn", "inner(Y) :- turn(_, Y). p0(X) :- turn(X, _), not inner(X). p0(Y) :- p2(X), turn(X, Y). p1(Y) :- p0(X), turn(X, Y). p2(Y) :- p1(X), turn(X, Y).", "x", f"{START}, r(x, n) AS (SELECT x, 0 FROM s UNION SELECT b, (n + 1) % 3 FROM r JOIN turn ON x = a) SELECT DISTINCT x FROM r WHERE n = 2", query="p2", recursive=True)
rules("cyclic_copy", "natpair", "a(X, Y) :- natpair(X, Y). a(X, Y) :- b(X, Y). b(X, Y) :- a(X, Y). b(X, Y) :- b(X, Y), a(X, Y).", "x y", "SELECT DISTINCT n_nationkey AS x, n_regionkey AS y FROM nation", query="b")
rules("facts_and_rules", "parent", 'goal("7"). goal("9"). goal(Y) :- goal(X), parent(X, Y).', "g", "g(k) AS (SELECT * FROM (VALUES ('7'), ('9')) AS t(k) UNION SELECT CAST(y AS VARCHAR) FROM g JOIN parent ON CAST(x AS VARCHAR) = k) SELECT k AS g FROM g", recursive=True)
rules("recursion_then_negation", "parent part", "below(X) :- parent(X, 3). below(X) :- parent(X, Y), below(Y). o(X) :- part(X), not below(X).", "x", "b(x) AS (SELECT x FROM parent WHERE y = 3 UNION SELECT p.x FROM parent p JOIN b ON p.y = b.x) SELECT DISTINCT p_partkey AS x FROM part WHERE p_partkey NOT IN (SELECT x FROM b)", query="o", recursive=True)
rules("input_and_rules", "parent", "parent(X, Y) :- parent(Y, X). o(X) :- parent(X, 1).", "x", "SELECT x FROM parent WHERE y = 1 UNION SELECT y FROM parent WHERE x = 1")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS x", "concat('n', s_nationkey) AS y")
    return suppliers.union(_table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))


INPUTS["up"] = (hierarchy, "SELECT 's' || s_suppkey AS x, 'n' || s_nationkey AS y FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
rules("same_generation", "up", "sg(X, X) :- up(_, X). sg(X, Y) :- up(X, A), sg(A, B), up(Y, B).", "x y", "sg(x, y) AS (SELECT y, y FROM up UNION SELECT a.x, b.x FROM sg JOIN up a ON a.y = sg.x JOIN up b ON b.y = sg.y) SELECT x, y FROM sg", recursive=True)

# --------------------------------------------------------------------------- sources and sinks


def _written(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def source(name: str, sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


NATIONS = "SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS k, n_name AS n FROM nation"


@source("tsv_source", NATIONS)
def tsv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "tsv")
    write_tsv(INPUTS["nation"][0](spark, sf_dir), path)
    return Engine(spark).add(f"n(K, N, R) :~ cat '{path}'\no(K, N) :- n(K, N, _).").query("o").toDF("k", "n")


@source("glob_source", NATIONS)
def glob_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "tsv")
    write_tsv(INPUTS["nation"][0](spark, sf_dir), f"{path}/a")
    return Engine(spark).add(f"n(K, N, R) :~ cat {path}/*/part-*\no(K, N) :- n(K, N, _).").query("o").toDF("k", "n")


@source("param_source", NATIONS)
def param_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "tsv")
    write_tsv(INPUTS["nation"][0](spark, sf_dir), path)
    return Engine(spark, params=[path]).add("n(K, N, R) :~ cat $1\no(K, N) :- n(K, N, _).").query("o").toDF("k", "n")


@source("alias_source", "SELECT DISTINCT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation")
def alias_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_with(spark, sf_dir, ["nation"]).add("o(K, N, R) :~ cat !nation").query("o").toDF("k", "n", "r")


@source("ntriples_source", "SELECT DISTINCT '<u:n' || n_nationkey || '>' AS s, '<u:in>' AS p, '<u:r' || n_regionkey || '>' AS o FROM nation")
def ntriples_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "nt")
    n = _table(spark, sf_dir, "nation").selectExpr("concat('<u:n', n_nationkey, '>')", "'<u:in>'", "concat('<u:r', n_regionkey, '>')")
    write_ntriples(n, path)
    return Engine(spark).add(f"t(S, P, O) :~ read_ntriples {path}").query("t").toDF("s", "p", "o")


@source("triple_partition", _with(["facts"], "SELECT DISTINCT s AS x, o AS y FROM facts WHERE p = 'ex:inNation' AND s IN (SELECT s FROM facts WHERE p = 'rdf:type' AND o = 'ex:Supplier')"))
def triple_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_with(spark, sf_dir, ["facts"])
    e.add("o(X, Y) :- ex:inNation(X, Y), ex:Supplier(X).").add_triple_rules()
    return e.query("o").toDF("x", "y")


@source("shell_rule", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events")
def shell_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_with(spark, sf_dir, ["did"], allow_shell=True)
    return e.add("o(U) :~ cut -f1 !did | sort -u").query("o").toDF("u")


@source("function_rule", "SELECT DISTINCT upper(n_name) AS n FROM nation")
def function_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_with(spark, sf_dir, ["nation"])
    e.register_function("shout", 1, lambda df: df.select(F.upper("c1")), ["nation/3"])
    return e.add("o(N) :- shout(N).").query("o").toDF("n")


@source("to_sql_roundtrip", "SELECT DISTINCT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey = 1)")
def to_sql_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    for n in ("nation", "region", "supplier"):
        df = INPUTS[n][0](spark, sf_dir)
        df.createOrReplaceTempView(f"hs_{n}")
        e.register(f"hs_{n}", df)
    e.add("o(N, R) :- hs_nation(K, N, G), hs_region(G, R), not hs_supplier(1, K), not same(N, R). same(N, N) :- hs_region(_, N).")
    return spark.sql(e.to_sql("o")).toDF("n", "r")


# --------------------------------------------------------------------------- one scan, several uses

rules("multi_filter", "did", 'o(U, "buyer") :- did(U, "purchase"). o(U, "buyer") :- did(U, "signup"). o(U, "other") :- did(U, "view"). o(U, "other") :- did(U, "error").', "u k", "SELECT u, 'buyer' AS k FROM did WHERE e IN ('purchase', 'signup') UNION SELECT u, 'other' FROM did WHERE e IN ('view', 'error')")
rules("shared_subplan", "supplies bought", "hot(P) :- supplies(S, P), bought(S, P). o(X) :- supplies(X, P), hot(P). o(X) :- bought(X, P), hot(P).", "x", "SELECT s AS x FROM supplies WHERE p IN (SELECT a.p FROM supplies a JOIN bought b ON a.s = b.c AND a.p = b.p) UNION SELECT c FROM bought WHERE p IN (SELECT a.p FROM supplies a JOIN bought b ON a.s = b.c AND a.p = b.p)", query="o")


@source("multi_output", _with(["did"], "SELECT 'a' AS k, u FROM did WHERE e = 'purchase' UNION SELECT 'b', u FROM did WHERE e = 'error'"))
def multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_with(spark, sf_dir, ["did"]).evaluate('a(U) :- did(U, "purchase"). b(U) :- did(U, "error").')
    return found["a/1"].select(F.lit("a").alias("k"), F.col("c0").alias("u")).union(found["b/1"].select(F.lit("b"), "c0"))


# --------------------------------------------------------------------------- SPARQL

EX = "PREFIX ex: <http://example.org/> "
NAMES = {"ex": "http://example.org/"}


def sparql(name: str, query: str, columns: str, sql: str, recursive: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        program, answer = translate(parse_query(EX + query))
        return engine_with(spark, sf_dir, ["facts"]).add(program).query(answer).toDF(*columns.split())

    QUERIES[name] = run
    ORACLES[name] = _with(["facts"], sql, recursive)


F_ = "SELECT s, o FROM facts WHERE p = "
sparql("sparql_bgp", "SELECT ?s ?r WHERE { ?s a ex:Supplier ; ex:inNation ?n . ?n ex:inRegion ?r }", "s r", f"SELECT DISTINCT a.s, r.o AS r FROM ({F_}'rdf:type') a JOIN ({F_}'ex:inNation') n ON a.s = n.s JOIN ({F_}'ex:inRegion') r ON n.o = r.s WHERE a.o = 'ex:Supplier'")
sparql("sparql_optional", "SELECT ?x ?m WHERE { ?x ex:inNation ?n OPTIONAL { ?x ex:segment ?m } }", "x m", f"SELECT DISTINCT n.s AS x, coalesce(g.o, 'NULL') AS m FROM ({F_}'ex:inNation') n LEFT JOIN ({F_}'ex:segment') g ON n.s = g.s")
sparql("sparql_union", "SELECT ?x WHERE { { ?x a ex:Region } UNION { ?x a ex:Nation } }", "x", "SELECT DISTINCT s AS x FROM facts WHERE p = 'rdf:type' AND o IN ('ex:Region', 'ex:Nation')")
sparql("sparql_minus", "SELECT ?x WHERE { ?x ex:inNation ?n MINUS { ?x a ex:Customer } }", "x", f"SELECT DISTINCT s AS x FROM ({F_}'ex:inNation') n WHERE s NOT IN (SELECT s FROM facts WHERE p = 'rdf:type' AND o = 'ex:Customer')")
REACH = f"e AS ({F_}'ex:inNation' UNION {F_}'ex:inRegion'), r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s)"
sparql("sparql_path_plus", "SELECT ?x ?y WHERE { ?x (ex:inNation|ex:inRegion)+ ?y }", "x y", f"{REACH} SELECT s AS x, o AS y FROM r", recursive=True)
sparql("sparql_path_star", "SELECT ?x WHERE { ?x (ex:inNation|ex:inRegion)* ex:region1 }", "x", f"{REACH} SELECT s AS x FROM r WHERE o = 'ex:region1' UNION SELECT 'ex:region1'", recursive=True)
sparql("sparql_path_const", "SELECT ?y WHERE { ex:customer7 (ex:inNation|ex:inRegion)+ ?y }", "y", f"{REACH} SELECT DISTINCT o AS y FROM r WHERE s = 'ex:customer7'", recursive=True)
sparql("sparql_path_sequence", "SELECT ?x ?n WHERE { ?x ex:inNation/^ex:inNation/ex:segment ?n . ?x a ex:Supplier }", "x n", f"SELECT DISTINCT a.s AS x, g.o AS n FROM ({F_}'ex:inNation') a JOIN ({F_}'ex:inNation') b ON a.o = b.o JOIN ({F_}'ex:segment') g ON b.s = g.s WHERE a.s IN (SELECT s FROM facts WHERE p = 'rdf:type' AND o = 'ex:Supplier')")
sparql("sparql_bind", "SELECT ?x ?k WHERE { ?x a ex:Region BIND('area' AS ?k) }", "x k", "SELECT DISTINCT s AS x, 'area' AS k FROM facts WHERE p = 'rdf:type' AND o = 'ex:Region'")
sparql("sparql_zero", "SELECT ?x ?y WHERE { ?x ex:inRegion? ?y . ?x a ex:Nation }", "x y", f"SELECT s AS x, o AS y FROM ({F_}'ex:inRegion') t UNION SELECT s, s FROM facts WHERE p = 'rdf:type' AND o = 'ex:Nation'")

# --------------------------------------------------------------------------- ontologies

PROLOGUE = "@prefix ex: <http://example.org/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . "


def owl(name: str, ontology: str, relation: str, columns: str, sql: str, recursive: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples, prefixes = parse_triples(PROLOGUE + ontology)
        program = ontology_rules(triples, prefixes).program
        program = program + input_rules(program, {("false", 0)}, defined_too=True)
        out = engine_with(spark, sf_dir, ["facts"]).add(program).query(relation)
        return out.toDF(*columns.split()) if columns else out.select(F.lit("inconsistent").alias("v"))

    QUERIES[name] = run
    ORACLES[name] = _with(["facts"], sql, recursive)


TYPED = "SELECT s FROM facts WHERE p = 'rdf:type' AND o = "
owl("owl_subclass", "ex:Customer rdfs:subClassOf ex:Party . ex:Supplier rdfs:subClassOf ex:Party .", "ex:Party/1", "x", "SELECT DISTINCT s AS x FROM facts WHERE p = 'rdf:type' AND o IN ('ex:Customer', 'ex:Supplier')")
owl("owl_domain", "ex:inNation rdfs:domain ex:Resident .", "ex:Resident/1", "x", f"SELECT DISTINCT s AS x FROM ({F_}'ex:inNation') t")
owl("owl_range", "ex:inNation rdfs:range ex:Home .", "ex:Home/1", "x", f"SELECT DISTINCT o AS x FROM ({F_}'ex:inNation') t")
owl("owl_symmetric", "ex:inRegion a owl:SymmetricProperty .", "ex:inRegion/2", "x y", f"{F_.replace('s, o', 's AS x, o AS y')}'ex:inRegion' UNION SELECT o, s FROM facts WHERE p = 'ex:inRegion'")
owl("owl_transitive", "ex:within a owl:TransitiveProperty . ex:inNation rdfs:subPropertyOf ex:within . ex:inRegion rdfs:subPropertyOf ex:within .", "ex:within/2", "x y", f"{REACH} SELECT s AS x, o AS y FROM r", recursive=True)
owl("owl_inverse", "ex:hosts owl:inverseOf ex:inNation .", "ex:hosts/2", "x y", f"SELECT DISTINCT o AS x, s AS y FROM ({F_}'ex:inNation') t")
owl("owl_subprop", "ex:inNation rdfs:subPropertyOf ex:linked . ex:inRegion rdfs:subPropertyOf ex:linked .", "ex:linked/2", "x y", "SELECT DISTINCT s AS x, o AS y FROM facts WHERE p IN ('ex:inNation', 'ex:inRegion')")
owl("owl_equiv", "ex:Area owl:equivalentClass ex:Region . ex:label owl:equivalentProperty ex:name .", "ex:label/2", "x y", f"SELECT DISTINCT s AS x, o AS y FROM ({F_}'ex:name') t")
owl("owl_intersection", "ex:Local owl:equivalentClass [ owl:intersectionOf ( ex:Customer [ owl:onProperty ex:inNation ; owl:hasValue ex:nation3 ] ) ] .", "ex:Local/1", "x", f"SELECT DISTINCT s AS x FROM ({F_}'ex:inNation') t WHERE o = 'ex:nation3' AND s IN ({TYPED}'ex:Customer')")
owl("owl_somevalues", "[ owl:onProperty ex:inNation ; owl:someValuesFrom ex:Nation ] rdfs:subClassOf ex:Settled .", "ex:Settled/1", "x", f"SELECT DISTINCT s AS x FROM ({F_}'ex:inNation') t WHERE o IN ({TYPED}'ex:Nation')")
owl("owl_allvalues", "ex:Customer rdfs:subClassOf [ owl:onProperty ex:inNation ; owl:allValuesFrom ex:Market ] .", "ex:Market/1", "x", f"SELECT DISTINCT o AS x FROM ({F_}'ex:inNation') t WHERE s IN ({TYPED}'ex:Customer')")
owl("owl_hasvalue", "ex:Region rdfs:subClassOf [ owl:onProperty ex:scale ; owl:hasValue 'large' ] .", "ex:scale/2", "x y", f"SELECT DISTINCT s AS x, 'large' AS y FROM ({TYPED}'ex:Region') t")
owl("owl_union", "ex:Place owl:equivalentClass [ owl:unionOf ( ex:Region ex:Nation ) ] .", "ex:Place/1", "x", "SELECT DISTINCT s AS x FROM facts WHERE p = 'rdf:type' AND o IN ('ex:Region', 'ex:Nation')")
owl("owl_oneof", "[ owl:oneOf ( ex:nation1 ex:nation2 ) ] rdfs:subClassOf ex:Chosen .", "ex:Chosen/1", "x", "SELECT * FROM (VALUES ('ex:nation1'), ('ex:nation2')) AS t(x)")
owl("owl_disjoint", "ex:Resident owl:disjointWith ex:Home . ex:inNation rdfs:domain ex:Resident . ex:inRegion rdfs:domain ex:Home . ex:inRegion rdfs:domain ex:Resident .", "false/0", "", f"SELECT DISTINCT 'inconsistent' AS v FROM ({F_}'ex:inRegion') t")


def owl_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that follow from a small ontology and all facts, by the general rules."""
    triples, prefixes = parse_triples(PROLOGUE + "ex:Nation rdfs:subClassOf ex:Place . ex:inRegion rdfs:range ex:Region ; rdfs:domain ex:Place .")
    return Engine(spark).register("facts", facts(spark, sf_dir)).add(meta_rules(triples, prefixes)).query('facts(X, "rdf:type", C)').toDF("x", "c")


QUERIES["owl_meta"] = owl_meta
ORACLES["owl_meta"] = _with(
    ["facts"],
    f"SELECT DISTINCT s AS x, o AS c FROM facts WHERE p = 'rdf:type' UNION SELECT s, 'ex:Place' FROM ({TYPED}'ex:Nation') t UNION SELECT s, 'ex:Place' FROM ({F_}'ex:inRegion') t"
    f" UNION SELECT o, 'ex:Region' FROM ({F_}'ex:inRegion') t UNION SELECT * FROM (VALUES ('owl:Thing', 'owl:Class'), ('owl:Nothing', 'owl:Class')) AS v(x, c)",
)

# --------------------------------------------------------------------------- university benchmark


def lubm_engine(spark: SparkSession, universities: int = 1, departments: tuple[int, int] = lubm.DEPARTMENTS) -> Engine:
    """The benchmark's data of so many whole universities, and its rules."""
    rows = pa.table(list(zip(*lubm.generate(universities, 0, departments), strict=True)), names=["s", "p", "o"])
    return Engine(spark).register("allFacts", spark.createDataFrame(rows)).add(lubm.program())


def _lubm(number: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: lubm_engine(spark).query(f"query{number}")


for _i in range(1, 15):
    QUERIES[f"lubm_q{_i}"] = _lubm(_i)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tc_linear"](spark, sf_dir)


def programs() -> dict[str, Program]:
    """The rule programs that have no table inputs, for display."""
    return {"lubm": lubm.program()}

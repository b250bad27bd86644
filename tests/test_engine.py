import itertools
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornspark.ast import Program, Rule
from hornspark.engine import Engine
from hornspark.operators import fixpoint, product
from hornspark.operators.fixpoint import IterationLimit
from hornspark.parser import parse
from hornspark.plans import rewrite
from hornspark.plans.analysis import StratificationError, UnsafeRuleError, components


def rows(spark, program, facts=None, query=None, **options):
    engine = Engine(spark, **options).add(program)
    for name, values in (facts or {}).items():
        engine.register(name, values)
    return sorted(tuple(r) for r in engine.query(query).collect())


CHAIN = {"parent": [("a", "b"), ("b", "c"), ("c", "d")]}
LINEAR = "anc(X, Y) :- parent(X, Y). anc(X, Z) :- anc(X, Y), parent(Y, Z)."
CLOSED = sorted((x, y) for x, y in itertools.combinations("abcd", 2))


def test_copy(spark):
    assert rows(spark, "o(X, Y) :- parent(X, Y).", {"parent": [("a", "b")]}) == [("a", "b")]


def test_repeated_variable_and_no_columns(spark):
    assert rows(spark, "bad() :- parent(X, X).", CHAIN) == []
    assert rows(spark, "bad() :- parent(X, X).", {"parent": [("a", "a"), ("b", "b")]}) == [()]


def test_self_join_and_constants(spark):
    people = {"parent": [("a", "p"), ("b", "p"), ("c", "q")]}
    assert len(rows(spark, "o(X, Y) :- parent(X, P), parent(Y, P).", people)) == 5
    assert rows(spark, 'o(X) :- parent(X, "q").', people) == [("c",)]
    assert rows(spark, "o(X) :- parent(X, X).", people) == []


def test_facts(spark):
    assert rows(spark, 't("x", "A"). t("y", "A"). t("z", 7). o(X) :- t(X, "A").') == [("x",), ("y",)]
    assert rows(spark, 't("z", 7). o(X) :- t(X, 7).') == [("z",)]


@pytest.mark.parametrize("doubling", [True, False])
@pytest.mark.parametrize("program", [LINEAR, "anc(X, Y) :- parent(X, Y). anc(X, Z) :- anc(X, Y), anc(Y, Z).", "anc(X, Y) :- parent(X, Y). anc(X, Z) :- parent(X, Y), anc(Y, Z)."])
def test_closures(spark, program, doubling):
    assert rows(spark, program, CHAIN, doubling=doubling) == CLOSED
    assert rows(spark, program, CHAIN, 'anc("b", X)', doubling=doubling) == [("c",), ("d",)]
    assert rows(spark, program, CHAIN, 'anc(X, "b")', doubling=doubling) == [("a",)]
    assert rows(spark, program, CHAIN, 'anc("a", "d")', doubling=doubling) == [()]


def test_mutual_recursion(spark):
    chain = {"foo": [(str(i), str(i + 1)) for i in range(4)]}
    assert rows(spark, 'even("0"). even(Y) :- odd(X), foo(X, Y). odd(Y) :- even(X), foo(X, Y).', chain, "even") == [("0",), ("2",), ("4",)]


def test_three_way_recursion(spark):
    # facts of an inner relation found early are joined with what an outer one finds late
    p = "a(X, Y) :- in(X, Y). a(X, Y) :- c(X, Y). b(X, Y) :- a(X, Y). b(X, Z) :- b(X, Y), b(Y, Z). c(X, Y) :- b(X, Y)."
    assert rows(spark, p, {"in": [("1", "2"), ("2", "3"), ("3", "4")]}, "c") == sorted((str(i), str(j)) for i in range(1, 5) for j in range(i + 1, 5))


def test_cycles_end(spark):
    assert rows(spark, "a(X, Y) :- b(X, Y). b(X, Y) :- a(X, Y).", {"a": [("1", "2")]}, "b") == [("1", "2")]
    assert rows(spark, 'a("1", "2"). a(X, Y) :- a(X, Y).') == [("1", "2")]
    ring = {"e": [("1", "2"), ("2", "3"), ("3", "1")]}
    assert len(rows(spark, "t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z).", ring)) == 9


def test_loop_that_adds_nothing(spark):
    assert rows(spark, "c(X) :- a(X). c(X) :- b(X). c(X) :- c(X), a(X).", {"a": [("1",)], "b": [("2",)]}) == [("1",), ("2",)]


def test_loop_without_start(spark):
    assert rows(spark, "p(X) :- q(X). q(X) :- p(X).") == []


def test_negation(spark):
    b, c, d = [("1", "2"), ("2", "3")], [("1", "3")], [("3",)]
    assert rows(spark, "a(X) :- not c(X), b(X, _).", {"b": b, "c": [("1",)]}) == [("2",)]
    assert rows(spark, "a(X, Y) :- b(X, Y), not c(X, Y).", {"b": b, "c": [("2", "3")]}) == [("1", "2")]
    assert rows(spark, "a(X) :- b(X, Y), not c(X, _), not d(Y).", {"b": [*b, ("3", "4")], "c": c, "d": d}) == [("3",)]
    assert rows(spark, "a(X) :- not c(X, Z), b(X, Y).", {"b": b, "c": c}) == [("2",)]
    assert rows(spark, "a(X) :- b(X, _), not nowhere().", {"b": b}) == [("1",), ("2",)]
    assert rows(spark, 'yes(). a(X) :- b(X, _), not yes().', {"b": b}) == []


def test_negation_over_a_finished_loop(spark):
    p = LINEAR + "node(X) :- parent(X, _). node(X) :- parent(_, X). o(X) :- node(X), not anc(_, X)."
    assert rows(spark, p, CHAIN) == [("a",)]


def test_bad_programs(spark):
    with pytest.raises(StratificationError):
        rows(spark, "p(X) :- q(X), not p(X).", {"q": [("a",)]})
    for text in ("p(X, Y) :- q(X).", "p(X) :- not q(X).", "p(X).", "p(X) :- q(Z), not r(X)."):
        with pytest.raises(UnsafeRuleError):
            rows(spark, text)


def test_round_limit(spark):
    long = {"e": [(str(i), str(i + 1)) for i in range(9)]}
    with pytest.raises(IterationLimit):
        rows(spark, "r(Y) :- e(_, Y), start(Y). r(Y) :- r(X), e(X, Y). start(\"1\").", long, "r", max_rounds=3)


def test_many_rounds_are_compacted(spark):
    long = {"e": [(str(i), str(i + 1)) for i in range(14)]}
    assert len(rows(spark, 'r("0"). r(Y) :- r(X), e(X, Y).', long)) == 15


def test_loops_over_many_known_rows(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "LARGE_ROWS", 0)
    for most in (0, 10**6):
        monkeypatch.setattr(fixpoint, "BROADCAST_VALUES", most)
        assert rows(spark, LINEAR, CHAIN, doubling=False) == CLOSED
        assert rows(spark, "a() :- p(X, X). a() :- a(), p(X, _).", {"p": [("1", "1")]}) == [()]


SAME = "sg(X, X) :- up(_, X). sg(X, Y) :- up(X, A), sg(A, B), up(Y, B)."


def test_products_are_not_stored(spark):
    """The pairs of leaves, nearly all rows, are neither written nor shuffled before the sink."""
    up = [(f"s{i}", f"n{i % 3}") for i in range(900)] + [(f"n{i}", "r") for i in range(3)]
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    written = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    before = written()
    out = Engine(spark).register("up", up).add(SAME).query("sg")
    assert written() - before < 1_000_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Anti" not in plan
    assert out.count() == out.distinct().count() == 900 * 900 + 9 + 1


def generations(up, found):
    while new := {(x, y) for x, a in up for y, b in up if a is not None and b is not None and (a, b) in found} - found:
        found |= new
    return found


@pytest.mark.parametrize("sizes", [{"PART_ROWS": 2}, {"SIDE_VALUES": 0, "SQUARE_ROWS": 2, "PART_ROWS": 3}])
def test_products_of_any_graph(spark, monkeypatch, sizes):
    """Several parents, cycles, nulls, and rows to begin with that follow too or lead nowhere."""
    for name, value in sizes.items():
        monkeypatch.setattr(product, name, value)
    up = [("a", "p"), ("b", "p"), ("b", "q"), ("c", "q"), ("d", "r"), ("d", "r"), (None, "p"), ("a", None), ("p", "t"), ("q", "t"), ("r", "u"), ("u", "r"), ("e", "a"), ("f", "c"), ("g", "b")]
    pairs = [("t", "t"), ("r", "u"), ("a", "b"), ("z", "z"), (None, None), (None, "b"), ("e", None), ("d", "d")]
    program = "sg(X, Y) :- flat(X, Y). sg(X, Y) :- up(X, A), sg(A, B), up(Y, B)."
    for text, start in ((SAME, {(y, y) for _, y in up}), (program, set(pairs))):
        got = [tuple(r) for r in Engine(spark).register("up", up).register("flat", pairs).add(text).query("sg").collect()]
        assert len(got) == len(set(got)) and set(got) == generations(up, start)


def test_products_that_others_read(spark):
    up = [("a", "p"), ("b", "p"), ("c", "q"), ("p", "t"), ("q", "u")]
    assert rows(spark, SAME + ' o(X) :- sg(X, "b"), sg("a", X).', {"up": up}, "o") == [("a",), ("b",)]


def test_products_of_other_types_are_compared_as_texts(spark):
    up = spark.createDataFrame([(1, 7), (2, 7)], "x int, y int")
    assert rows(spark, 'sg("7", "7"). sg(X, Y) :- up(X, A), sg(A, B), up(Y, B).', {"up": up}) == [("1", "1"), ("1", "2"), ("2", "1"), ("2", "2"), ("7", "7")]
    assert rows(spark, "sg(X, X) :- up(_, X). sg(X, Y) :- up(X, A), sg(A, B), up(Y, B).", {"up": up}) == [(1, 1), (1, 2), (2, 1), (2, 2), (7, 7)]


def test_products():
    """Only rules of two sides that nothing but the loop links."""
    found = lambda text: rewrite.as_product(parse(text).rules, ("sg", 2))
    p = found("sg(X, Y) :- up(X, A), sg(A, B), up(Y, B).")
    assert [[str(x) for x in side] for side in (p.left, p.right)] == [["up(X, A)"], ["up(Y, B)"]]
    assert sorted(p.readers()) == [0, 1]
    p = found("sg(X, Y) :- e(X, K), f(K, B), sg(A, B), up(Y, A).")
    assert [[str(x) for x in side] for side in (p.left, p.right)] == [["e(X, K)", "f(K, B)"], ["up(Y, A)"]]
    for other in ("sg(X, Z) :- sg(X, Y), e(Y, Z).", "sg(X, Y) :- up(X, A), sg(A, B), up(Y, B), e(X, Y).", "sg(X, Y) :- up(X, A), sg(A, B), up(Y, A).", "sg(X, Y) :- sg(A, B), up(X, Y).", "sg(X, Y) :- up(X, A), sg(A, B), up(Y, B), not e(X)."):
        assert found(other) is None
    assert found("sg(X, Y) :- up(X, A), sg(A, B), up(Y, B). sg(X, Y) :- sg(Y, X).") is None


def test_nulls_end_a_loop(spark):
    df = spark.createDataFrame([("a", "b"), ("b", None)], "x string, y string")
    out = Engine(spark).register("e", df).add("t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z). t(Y, X) :- t(X, Y).").query()
    assert {tuple(r) for r in out.collect()} >= {("a", "b"), ("b", None), (None, "b"), ("a", None)}


def test_typed_columns(spark):
    df = spark.range(5).select("id", (F.col("id") % 2).alias("m"))
    e = Engine(spark).register("n", df).register("t", [("1", "one"), ("3", "three")])
    assert sorted(r[0] for r in e.add("o(X) :- n(X, 1).").query().collect()) == [1, 3]
    assert sorted(map(tuple, e.add("w(X, W) :- n(X, _), t(X, W).").query().collect())) == [("1", "one"), ("3", "three")]
    plan = e.explain("o", spark_plan=True)
    assert "loop" not in plan and "o(X)" in plan


def test_arities_are_relations_of_their_own(spark):
    assert rows(spark, 'p("a"). p("a", "b"). o(X) :- p(X), p(X, _).') == [("a",)]


def test_bound_arguments_of_relations_with_rows(spark):
    p = "anc(X, Y) :- parent(X, Y). anc(X, Z) :- anc(X, Y), parent(Y, Z)."
    given = {**CHAIN, "anc": [("z", "a"), ("y", "c")]}
    assert rows(spark, p, given, 'anc("z", X)') == [("a",), ("b",), ("c",), ("d",)]
    assert rows(spark, p, given, 'anc("y", X)') == [("c",), ("d",)]
    assert rows(spark, p + 'o(X) :- anc("y", X), not anc("b", X).', given, "o") == []
    assert rows(spark, p + 'o(X) :- anc("z", X), not anc("b", X).', given, "o") == [("a",), ("b",)]


def test_unknown_relations_are_empty(spark, caplog):
    assert rows(spark, "o(X) :- nowhere(X).") == []
    assert "nowhere/1" in caplog.text


def test_evaluate_several(spark):
    out = Engine(spark).evaluate(LINEAR + "root(X) :- anc(X, _), not anc(_, X).", CHAIN, ["anc", "root"])
    assert out["anc/2"].count() == 6 and [tuple(r) for r in out["root/1"].collect()] == [("a",)]


def test_functions(spark):
    e = Engine(spark).register("w", [("a",), ("b",)]).register_function("up", 1, lambda df: df.select(F.upper("c0")), ["w/1"])
    assert sorted(r[0] for r in e.add("o(X) :- up(X).").query().collect()) == ["A", "B"]


def test_rewrites():
    merged = rewrite.merge_constants([r for r in parse('o(X) :- e(X, "a"). o(Y) :- e(Y, "b"). o(X) :- e("c", X). o(X) :- f(X, "a").').rules])
    assert sorted(map(str, merged)) == ['o(X) :- e("c", X).', 'o(X) :- e(X, {"a", "b"}).', 'o(X) :- f(X, "a").']
    kept = rewrite.merge_constants(parse('o(X, "a") :- e(X, "a"). o(X, "b") :- e(X, "b").').rules)
    assert len(kept) == 2
    assert rewrite.drop_copies(parse("p(X) :- p(X), q(X). p(X) :- q(X). p(X) :- q(X).")).rules == parse("p(X) :- q(X).").rules
    linear = parse(LINEAR)
    assert rewrite.invariant_places(linear, ("anc", 2)) == {0}
    bound = rewrite.bind_arguments(linear + parse('o(X) :- anc("a", X).'), set())
    assert any(isinstance(r, Rule) and r.head.name == "anc__0" for r in bound)
    assert str(rewrite.as_closure(linear.rules, ("anc", 2))[1]) == "anc(X, Z) :- anc(X, Y), anc(Y, Z)."
    assert rewrite.as_closure(parse("a(X, Y) :- b(X, Y). a(X, Z) :- a(X, Y), c(Y, Z).").rules, ("a", 2)) is None


def test_components_come_after_what_they_need():
    needs = {("a", 1): {("b", 1)}, ("b", 1): {("c", 1), ("a", 1)}, ("c", 1): {("d", 1)}, ("d", 1): set()}
    assert components(needs) == [[("d", 1)], [("c", 1)], [("a", 1), ("b", 1)]]
    deep = {(f"p{i}", 0): {(f"p{i + 1}", 0)} for i in range(5000)}
    assert len(components(deep)) == 5001


edges = st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), min_size=1, max_size=10)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges)
def test_closure_of_any_graph(spark, pairs):
    known = set(pairs)
    while True:
        more = {(a, d) for a, b in known for c, d in known if b == c} | known
        if more == known:
            break
        known = more
    assert rows(spark, "t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z).", {"e": pairs}) == sorted(known)


def test_program_sum():
    assert len((parse("a(\"x\").") + Program()).rules) == 1


def test_one_scan_for_several_conclusions(spark, tmp_path):
    """Conclusions that filter a relation share a scan that deals its rows; joins of one are read again from there."""
    path = str(tmp_path / "facts")
    triples = [(f"s{i}", f"p{i % 5}", i) for i in range(100)] + [("s1", "p1", None)]
    spark.createDataFrame(triples, "s string, p string, o int").write.parquet(path)
    program = 'a(X, Y) :- facts(X, "p1", Y). b(X) :- facts(X, "p2", _). b(X) :- facts(X, "p3", _). c(X, "k") :- facts(X, "p4", X). d(X, Y) :- facts(X, "p1", 1), a(X, Y).'
    e = Engine(spark).register("facts", spark.read.parquet(path))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("/facts]")
    out = e.evaluate(program, relations=["a/2", "b/1", "c/2", "d/2"])
    assert [scans(out[k]) for k in ("a/2", "b/1", "c/2", "d/2")] == [0, 0, 0, 1]  # the dealt rows are stored; d joins, and reads its own constants
    for key, expected in {"a/2": {(s, o) for s, p, o in triples if p == "p1"}, "b/1": {(s,) for s, p, _ in triples if p in ("p2", "p3")}, "c/2": set(), "d/2": {("s1", 1), ("s1", None)}}.items():
        assert {tuple(r) for r in out[key].collect()} == expected, key
    plain = Engine(spark, reuse=False).register("facts", spark.read.parquet(path)).evaluate(program, relations=["a/2", "b/1", "c/2", "d/2"])
    assert scans(plain["a/2"]) == 1 and all(sorted(map(str, plain[k].collect())) == sorted(map(str, out[k].collect())) for k in out)


def test_one_scan_for_several_rules(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 1)], "x string, y int").write.parquet(path)
    e = Engine(spark).register("e", spark.read.parquet(path)).add('o(X, Y) :- e(X, 1), e(X, Y). q(X, "one") :- e(X, 1). q(X, "low") :- e(X, 1). q(X, "two") :- e(X, 2). q(Y, "b") :- e("b", Y).')
    df = e.query("q")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [("a", "one"), ("a", "low"), (None, "one"), (None, "low"), ("b", "two"), ("2", "b")]))
    assert sorted(tuple(r) for r in e.query("o").collect()) == [("a", 1)]


def test_shared_joins_are_computed_once(spark):
    """A join that two literals read is stored; its inputs are not in the plan of what reads it."""
    e = Engine(spark).register("e", [("a", "b"), ("b", "c"), ("c", "d")])
    e.add("hot(X, Z) :- e(X, Y), e(Y, Z). o(X) :- hot(X, _), e(X, _). o(X) :- hot(_, X), e(_, X).")
    prepared = e.prepare("o")
    assert prepared.kept == {("hot", 2)} and prepared.levels() == [[[("hot", 2)]]]
    df = prepared.rows()
    assert sorted(r[0] for r in df.collect()) == ["a", "b", "c", "d"]
    assert ("hot", 2) in prepared.done and "Scan ExistingRDD" in prepared.done["hot", 2].df._jdf.queryExecution().executedPlan().toString()
    assert Engine(spark, reuse=False).register("e", [("a", "b")]).add("h(X, Z) :- e(X, Y), e(Y, Z). o(X) :- h(X, _). o(X) :- h(_, X).").prepare("o").kept == set()


def test_independent_loops_are_one_level(spark):
    program = "t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z). u(X, Y) :- f(X, Y). u(X, Z) :- u(X, Y), f(Y, Z). w(X) :- t(X, Y), u(Y, X). v(X) :- w(X). v(Y) :- v(X), t(X, Y). bad() :- v(X), v(Y), not w(X)."
    e = Engine(spark).register("e", [("a", "b"), ("b", "c")]).register("f", [("c", "b"), ("b", "a")]).add(program)
    prepared = e.prepare("v")
    assert [sorted(g[0][0] for g in level) for level in prepared.levels()] == [["t", "u"], ["v"]]
    assert sorted(r[0] for r in prepared.rows().collect()) == ["a", "b", "c"]


def test_rules_take_part_only_where_they_can(spark):
    """A rule whose literals fit nothing is left out of a round, and taken in as soon as they do."""
    chain = {"e": [(str(i), str(i + 1)) for i in range(6)]}
    p = 'f("0", "on"). f(Y, "on") :- f(X, "on"), e(X, Y). f(X, "late") :- f(X, "on"), f("5", "on"). f(X, "never") :- f(X, "odd"), f(X, "on"). f(X, "last") :- f(X, "late"), f(X, "on").'
    expected = sorted((str(i), k) for i in range(7) for k in ("on", "late", "last"))
    assert rows(spark, p, chain, "f") == expected
    loop = fixpoint.Loop(spark, [("f", 2)], [r for r in parse(p).rules if r.body], lambda x: None, 10)
    size, now = loop.looked_at(spark.createDataFrame([(0, "5", "on")], "tag int, c0 string, c1 string"))
    assert size == 1 and {str(x) for x in now} == {str(fixpoint.shape(x)) for r in loop.rules for x in r.body if x.key == ("f", 2) and str(x.args[1]).strip('"') == "on"}


def test_no_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from hornspark import durable

    made = []
    context = lambda master: SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    session = lambda master, told=None: SimpleNamespace(sparkContext=context(master), conf=SimpleNamespace(get=lambda _, default: told or default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_folder(session("spark://host:7077"))
    assert not made and durable.shared_folder(session("yarn", "s3://b/c")) == "s3://b/c"
    made.clear()
    assert durable.shared_folder(session("local[4]")) == made[-1]

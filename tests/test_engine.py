"""Semantics of rules, queries and changes, including the traps of the data model."""

import random

import pytest
from row_sets import rows

from rulespan.engine import Engine
from rulespan.errors import RuleError


def ask(engine, text, query):
    engine.execute(text)
    return rows(engine.query(query))


def test_set_semantics(engine):
    assert ask(engine, "+a[(1, 2), (1, 2), (2, 3)]\n+a(1, 2)\n+p(X) <- a(X, _)\n+p(Y) <- a(_, Y)", "?p(X)") == [(1,), (2,), (3,)]


def test_wildcards_are_fresh(engine):
    assert ask(engine, "+s[(1, 10), (2, 20), (3, 30)]\n+r(A, count<B>) <- s(A, _), s(B, _), B <= A", "?r(A, N)") == [(1, 1), (2, 2), (3, 3)]


def test_global_aggregate_over_nothing_has_no_row(engine):
    assert ask(engine, "+a(1)\n+r(count<X>, sum<X>) <- a(X), X > 5", "?r(N, S)") == []


def test_division_by_zero_is_null_and_null_passes_not_equal(engine):
    engine.execute("+n[(10), (20), (0)]\n+q(X, Y) <- n(X), Y = 100 / X")
    assert rows(engine.query("?q(X, Y)")) == [(0, None), (10, 10.0), (20, 5.0)]
    engine.execute("+r(X) <- q(X, Y), Y != 5")
    assert rows(engine.query("?r(X)")) == [(0,), (10,)]


def test_nulls_in_aggregates(engine):
    engine.execute("+n[(10), (20), (0)]\n+q(X, Y) <- n(X), Y = 100 / X\n+r(count<Y>, count_distinct<Y>, sum<Y>, min<Y>, max<Y>, avg<Y>) <- q(X, Y)")
    assert rows(engine.query("?r(A, B, C, D, E, F)")) == [(3, 3, 15.0, None, 10.0, 5.0)]


def test_nulls_join(engine):
    engine.execute("+n[(1), (0)]\n+q(X, Y) <- n(X), Y = 1 / X\n+r(A, B) <- q(A, Y), q(B, Y)")
    assert rows(engine.query("?r(A, B)")) == [(0, 0), (1, 1)]


def test_arithmetic_types(engine):
    engine.execute("+n[(7, 2)]\n+r(A, B, C, D, E) <- n(X, Y), A = X / Y, B = X % Y, C = X * Y, D = X - 2.5, N = 0 - X, E = N % 3")
    assert rows(engine.query("?r(A, B, C, D, E)")) == [(3.5, 1, 14, 4.5, -1)]


def test_overflow_is_null(engine):
    engine.execute("+n(9223372036854775807)\n+r(Y) <- n(X), Y = X + 1")
    assert rows(engine.query("?r(Y)")) == [(None,)]


def test_float_constants_have_tolerance(engine):
    assert ask(engine, "+n[(0.1), (0.30000000000000004), (0.3)]\n+r(X) <- n(X), X = 0.3", "?r(X)") == [(0.3,), (0.30000000000000004,)]


def test_sum_keeps_its_type(engine):
    assert ask(engine, "+m[(1, 3.14), (2, 2.71), (3, 1.41), (4, 0.0), (5, -1.5)]\n+s(sum<V>) <- m(_, V)", "?s(X)")[0][0] == pytest.approx(5.76)


def test_ranking(engine):
    engine.execute("+s[(1, 100), (2, 100), (3, 90), (4, 90), (5, 80)]\n+t(top_k<3, I, S:desc>) <- s(I, S)\n+h(top_k_threshold<2, 90, I, S:asc>) <- s(I, S)\n+w(within_radius<90, I, S:asc>) <- s(I, S)\n+one(top_k<2, S>) <- s(_, S)")
    assert rows(engine.query("?t(I, S)")) == [(1, 100), (2, 100), (3, 90)]
    assert rows(engine.query("?h(I, S)")) == [(3, 90), (5, 80)]
    assert rows(engine.query("?w(I, S)")) == [(3, 90), (4, 90), (5, 80)]
    assert rows(engine.query("?one(S)")) == [(90,), (100,)]


def test_goal_columns(engine):
    engine.execute('+p[(1, "a", 25), (2, "b", 30)]')
    df = engine.query("?p(Id, _, 25), Y = Id + 1")
    assert df.columns == ["Id", "_p1", "_c2", "Y"] and rows(df) == [(1, "a", 25, 2)]
    engine.execute("+e(emp: int, name: string)\n+e(1, \"x\")")
    assert engine.query("?e(A, B)").columns == ["emp", "name"]


def test_order_limit_offset(engine):
    engine.execute("+n[(3, 1), (1, 2), (2, 3), (5, 4)]")
    assert [tuple(r) for r in engine.query("?n(X:desc, Y), limit(2, 1)").collect()] == [(3, 1), (2, 3)]


@pytest.mark.parametrize("text", [
    "+r(X, Y) <- a(X)", "+r(X) <- a(X), !b(X, Y)", "+r(X) <- a(X), !r(X)", "+__r(X) <- a(X)", "+r(X) <- a(X), Z > 1",
    "+p(X) <- a(X), !q(X)\n+q(X) <- a(X), !p(X)", "+r(X) <- a(X)\n+r(X, Y) <- b(X, Y)", "+r(X) <- a(X)\n+r(1)", "+r(X, count<X>, top_k<1, X>) <- a(X)",
    "+r(top_k<1, X>) <- a(X)\n+r(top_k<2, X>) <- a(X)", "+a(1)\n+a(1, 2)", '+a(1)\n+a("x")', "+r(Y) <- a(X), Y = nofunction(X)\n?r(Y)",
])
def test_refused(engine, text):
    engine.execute("+a(1)\n+b(1, 2)")
    with pytest.raises(RuleError):
        for found in engine.execute(text):
            getattr(found, "collect", lambda: None)()


def closure(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


FORMS = {"left": "reach(X, Y), edge(Y, Z)", "right": "edge(X, Y), reach(Y, Z)", "double": "reach(X, Y), reach(Y, Z)"}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("local", [True, False])
def test_closure_against_brute_force(engine, form, local, monkeypatch):
    if not local:
        monkeypatch.setattr("rulespan.operators.fixpoint.small_fixpoint", lambda *a: None)
    rng = random.Random(form)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(22)})
    engine.graph.insert("edge", edges)
    engine.execute(f"+reach(X, Y) <- edge(X, Y)\n+reach(X, Z) <- {FORMS[form]}")
    want = closure(edges)
    assert set(rows(engine.query("?reach(X, Y)"))) == want
    for goal, keep in (("?reach(3, Y)", lambda p: p[0] == 3), ("?reach(X, 5)", lambda p: p[1] == 5), ("?reach(3, 5)", lambda p: p == (3, 5))):
        assert set(rows(engine.query(goal))) == {p for p in want if keep(p)}, goal


def test_bound_goals_leave_other_readers_alone(engine):
    engine.execute("+edge[(1, 2), (2, 3), (7, 8)]\n+reach(X, Y) <- edge(X, Y)\n+reach(X, Z) <- edge(X, Y), reach(Y, Z)\n+both(X, Y) <- reach(1, X), reach(7, Y)\n+n(count<X>) <- reach(X, _)")
    assert rows(engine.query("?both(X, Y)")) == [(2, 8), (3, 8)]
    assert rows(engine.query("?reach(1, Y), n(N)")) == [(1, 2, 4), (1, 3, 4)]


@pytest.mark.parametrize("local", [True, False])
def test_mutual_recursion(engine, local, monkeypatch):
    if not local:
        monkeypatch.setattr("rulespan.operators.fixpoint.small_fixpoint", lambda *a: None)
    engine.execute("+z(0)\n+s[(0, 1), (1, 2), (2, 3), (3, 4)]\n+even(X) <- z(X)\n+even(Y) <- odd(X), s(X, Y)\n+odd(Y) <- even(X), s(X, Y)")
    assert rows(engine.query("?even(X)")) == [(0,), (2,), (4,)] and rows(engine.query("?odd(X)")) == [(1,), (3,)]


def test_min_in_recursion(engine):
    engine.execute("+e[(1, 2, 5), (2, 3, 1), (1, 3, 9), (3, 1, 1)]\n+d(X, Y, min<L>) <- e(X, Y, L)\n+d(X, Z, min<L>) <- d(X, Y, A), e(Y, Z, B), L = A + B")
    assert rows(engine.query("?d(1, Y, L)")) == [(1, 1, 7), (1, 2, 5), (1, 3, 6)]


def test_facts_under_rules_count(engine):
    engine.execute("+r[(1, 9)]")
    engine.graph.rules = []
    engine.execute("+e(9, 10)\n+r(X, Z) <- r(X, Y), e(Y, Z)")
    assert rows(engine.query("?r(1, Y)")) == [(1, 9), (1, 10)] or set(rows(engine.query("?r(1, Y)"))) == {(1, 9), (1, 10)}


def test_changes(engine):
    engine.execute("+c[(1, 0), (2, 10), (3, 20)]\n-c(1, 0)\n+c(1, 5)\n-c(X, Y), +c(X, Z) <- c(X, Y), Y >= 10, Z = Y + 1\n-c(X, Y) <- c(X, Y), X = 3")
    assert rows(engine.query("?c(X, Y)")) == [(1, 5), (2, 11)]


def test_sessions_are_apart(engine):
    engine.execute("+a(1)")
    one, two = engine.session(), engine.session()
    one.execute("a(2)\nr(X) <- a(X)")
    assert rows(one.query("?r(X)")) == [(1,), (2,)] and rows(two.query("?a(X)")) == [(1,)]
    assert rows(one.tagged("?a(X)")) == [(1, "persistent"), (2, "ephemeral")]


def test_graphs_and_meta(engine):
    engine.execute(".kg create other\n+a(1)\n+r(X) <- a(X)\n.kg use default")
    assert engine.execute(".kg list") == [["default", "other"]] and rows(engine.query("?a(X)")) == []
    engine.execute(".kg use other")
    assert engine.execute(".rule def r") == [["r(X) <- a(X)"]] and engine.execute(".rel a") == [[("col0", "long")]]
    engine.execute(".rule drop r\n.clear prefix a")
    assert engine.execute(".rule list\n.rel") == [[], []]
    with pytest.raises(RuleError):
        engine.execute(".kg drop other")


def test_schema_checks(engine):
    engine.execute("+e(id: int, name: string, v: vector[2])\n+e(1, \"a\", [1, 2])")
    for bad in ('+e("x", "a", [1, 2])', '+e(1, "a", [1])', '+e(1, "a")'):
        with pytest.raises(RuleError):
            engine.execute(bad)


def test_why_and_why_not(engine):
    engine.execute("+e[(1, 2), (2, 3), (3, 1)]\n+r(X, Y) <- e(X, Y)\n+r(X, Z) <- r(X, Y), e(Y, Z)\n+lone(X) <- e(X, _), !r(X, 9)\n+n(X, count<Y>) <- r(X, Y)")
    proof = engine.execute(".why ?r(1, 3)")[0][0]
    assert proof.kind == "rule" and "e(2, 3) [fact]" in str(proof)
    assert "[negation]" in str(engine.execute(".why ?lone(1)")[0][0])
    assert engine.execute(".why ?n(1, N)")[0][0].kind == "aggregate"
    assert [b.kind for b in engine.execute(".why_not ?r(1, 9)")[0]] == ["body_atom_failed", "body_atom_failed"]
    engine.execute("+e(1, 9)")
    assert engine.execute(".why_not ?lone(1)")[0][0].kind == "negation_succeeded"


def test_notifications(engine):
    seen = []
    engine.execute("+a(1)")
    engine.subscribe(seen.append, since=0)
    engine.execute("+r(X) <- a(X)")
    assert [(c.kind, c.name) for c in seen] == [("rows", "a"), ("rule", "r")] and seen[1].seq == seen[0].seq + 1


def test_insert_into_a_table(spark, engine):
    engine.register("t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string"))
    assert engine.execute('+t[(2, "b"), (3, "c")]') == ["Inserted 1 fact(s) into 't'."]
    engine.execute('-t(1, "a")')
    assert rows(engine.query("?t(K, S)")) == [(2, "b"), (3, "c")]


def test_closure_patterns():
    from rulespan.operators.closure import closure as fast, edge_relation
    from rulespan.plans.parser import parse_program

    def rules(text):
        return [s.rule for s in parse_program(text)]

    base = "r(X, Y) <- e(X, Y)\n"
    for step in ("r(X, Z) <- r(X, Y), e(Y, Z)", "r(X, Z) <- e(X, Y), r(Y, Z)", "r(A, C) <- r(A, B), r(B, C)", "r(X, Z) <- e(Y, Z), r(X, Y)"):
        assert edge_relation("r", rules(base + step)) == "e", step
    for other in ("r(X, Z) <- r(X, Y), f(Y, Z)", "r(X, Z) <- r(Y, X), e(Y, Z)", "r(X, Z) <- r(X, Y), e(Z, Y)", "r(X, Z) <- r(X, Y), e(Y, Z), X < Z", "r(X, X) <- r(X, Y), e(Y, X)", "r(X, Z) <- r(X, Z), e(Z, X)"):
        assert edge_relation("r", rules(base + other)) is None, other
    rng = random.Random(0)
    for n, m in ((1, 1), (5, 4), (12, 14), (12, 30)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        nodes, a, b = fast(edges)
        assert {(nodes[i], nodes[j]) for i, j in zip(a, b)} == closure(edges)


def test_why_proves_every_answer(engine):
    engine.execute("+e[" + ", ".join(f"({i},)" for i in range(103)) + "]")
    assert len(engine.execute(".why ?e(X)")[0]) == 103
    engine.execute("+n(count<X>) <- e(X), X < 15")
    assert len(engine.execute(".why full ?n(N)")[0][0].children) == 15

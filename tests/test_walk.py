"""Recursion along edges: no rounds of jobs, and the rows that brute force finds."""

import heapq
import random

import pytest

from row_sets import rows


def reachable(edges, first):
    seen, todo = set(first), list(first)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def closure(edges):
    return sorted((x, z) for x in {a for a, _ in edges} for z in reachable(edges, {b for a, b in edges if a == x}))


@pytest.fixture
def no_rounds(monkeypatch):
    def stop(*a):
        raise AssertionError("a round of jobs")

    monkeypatch.setattr("rulespan.operators.fixpoint.small_fixpoint", lambda *a: None)
    monkeypatch.setattr("rulespan.operators.fixpoint.Known.add", stop)


def graph(spark, engine, n=60, m=75, seed=5):
    r = random.Random(seed)
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
    engine.register("e", spark.createDataFrame(edges, "a bigint, b bigint"), non_null=True, is_set=True)
    return edges


FORMS = ["reach(X, Y), e(Y, Z)", "e(X, Y), reach(Y, Z)", "reach(X, Y), reach(Y, Z)"]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("starts", [0, 1000])
def test_closure(spark, engine, no_rounds, monkeypatch, form, starts):
    monkeypatch.setattr("rulespan.operators.walk.STARTS", starts)
    monkeypatch.setattr("rulespan.operators.walk.ROWS", 50)
    edges = graph(spark, engine)
    engine.execute(f"+reach(X, Y) <- e(X, Y)\n+reach(X, Z) <- {form}")
    assert rows(engine.query("?reach(X, Y)")) == closure(edges)


@pytest.mark.parametrize("form", FORMS)
def test_bound_closure_walks_from_its_constant(spark, engine, no_rounds, form):
    edges = graph(spark, engine)
    engine.execute(f"+reach(X, Y) <- e(X, Y)\n+reach(X, Z) <- {form}")
    want = closure(edges)
    c = want[len(want) // 2][0]
    assert rows(engine.query(f"?reach({c}, Y)")) == [x for x in want if x[0] == c]
    assert rows(engine.query(f"?reach(X, {c})")) == [x for x in want if x[1] == c]
    assert rows(engine.query(f"?reach({c}, {c})")) == [x for x in want if x == (c, c)]


def test_long_chain_of_one_column(spark, engine, no_rounds):
    engine.register("e", spark.createDataFrame([(i, i + 1) for i in range(3000)], "a bigint, b bigint"), non_null=True, is_set=True)
    engine.execute("+seen(Y) <- e(1000, Y)\n+seen(Z) <- seen(Y), e(Y, Z)")
    assert rows(engine.query("?seen(Y)")) == [(i,) for i in range(1001, 3001)]


@pytest.mark.parametrize("step", [1, 4])
def test_least_steps(spark, engine, no_rounds, step):
    edges = graph(spark, engine, m=110)
    engine.register("s", spark.createDataFrame([(0, 7), (3, -2), (9, 40), (3, 5)], "y bigint, v bigint"), non_null=True, is_set=True)
    engine.execute(f"+d(Y, min<L>) <- s(Y, V), L = V + 0\n+d(Z, min<L>) <- d(Y, K), e(Y, Z), L = K + {step}")
    best, todo = {}, [(7, 0), (-2, 3), (40, 9), (5, 3)]
    heapq.heapify(todo)
    while todo:
        v, x = heapq.heappop(todo)
        if x not in best:
            best[x] = v
            for a, b in edges:
                if a == x:
                    heapq.heappush(todo, (v + step, b))
    assert rows(engine.query("?d(Y, L)")) == sorted(best.items())

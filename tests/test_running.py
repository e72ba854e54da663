"""Running totals by windows, and all pairs of two tables without a distinct over them."""

import random

import pytest

from row_sets import rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


OPS = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("size", [7, 50_000])
def test_totals_up_to_a_value(spark, engine, monkeypatch, op, size):
    monkeypatch.setattr("rulespan.operators.running.RANGE", size)
    r = random.Random(op)
    left = sorted({(r.randrange(-20, 20), r.randrange(2), r.randrange(3)) for _ in range(40)})
    right = sorted({(r.randrange(-15, 25), r.randrange(2), r.randrange(4)) for _ in range(60)})
    engine.register("l", spark.createDataFrame(left, "k bigint, g bigint, x bigint"), is_set=True)
    engine.register("r", spark.createDataFrame(right, "j bigint, g bigint, b bigint"), is_set=True)
    engine.execute(f"+one(K, sum<B>) <- l(K, _, _), r(J, _, B), J {op} K")
    engine.execute(f"+two(G, K, count<J>) <- l(K, G, _), r(J, G, _), K {op} J")
    one, two = {}, {}
    for k, g, _ in left:
        for j, h, b in right:
            if OPS[op](j, k):
                one[k] = one.get(k, 0) + b
            if g == h and OPS[op](k, j):
                two[g, k] = two.get((g, k), 0) + 1
    found = engine.query("?one(K, S)")
    assert "<" not in plan(found).split("Window")[0] and "Window" in plan(found)
    assert rows(found) == sorted(one.items())
    assert rows(engine.query("?two(G, K, N)")) == sorted((*k, n) for k, n in two.items())


def test_null_is_on_neither_side(spark, engine):
    engine.register("l", spark.createDataFrame([(None, 1), (3, 2), (1, 1)], "k bigint, x bigint"), is_set=True)
    engine.register("r", spark.createDataFrame([(None, 5.0), (2, None), (1, 0.5), (3, 4.0)], "j bigint, b double"), is_set=True)
    engine.execute("+t(K, sum<B>) <- l(K, _), r(J, B), J <= K")
    assert rows(engine.query("?t(K, S)")) == [(1, 0.5), (3, 4.5)]


def test_pairs_of_keys_need_no_distinct(spark, engine):
    engine.register("s", spark.createDataFrame([(i, float(i % 3)) for i in range(9)], "k bigint, v double"), is_set=True)
    engine.register("p", spark.createDataFrame([(i, float(i % 4)) for i in range(8)], "k bigint, v double"), is_set=True)
    engine.execute("+r(A, B) <- s(A, X), p(B, Y), X < Y")
    found = engine.query("?r(A, B)")
    assert "Aggregate" not in plan(found)
    assert rows(found) == sorted((a, b) for a in range(9) for b in range(8) if a % 3 < b % 4)


def test_pairs_of_repeated_values_stay_a_set(spark, engine, monkeypatch):
    monkeypatch.setattr("rulespan.plans.compiler.PAIRS", 10)
    engine.register("s", spark.createDataFrame([(i % 5, float(i)) for i in range(9)], "k bigint, v double"), is_set=True)
    engine.register("p", spark.createDataFrame([(i, float(i)) for i in range(8)], "k bigint, v double"), is_set=True)
    engine.execute("+r(A, B) <- s(A, X), p(B, Y), X < Y")
    assert rows(engine.query("?r(A, B)")) == sorted({(i % 5, b) for i in range(9) for b in range(8) if i < b})

"""Distances in tiles against plain loops: the same doubles, the same neighbours, ties to the smaller id."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rulespan.functions.quantize import quantize_linear, quantize_symmetric
from rulespan.functions.vectors import normalize
from rulespan.operators import knn, pairs
from rulespan.workloads import WORKLOADS


def euclidean(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def vectors(spark, monkeypatch):
    """Few distinct vectors, so that many distances are equal; blocks of a handful of rows."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    r = random.Random(3)
    some = [[r.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(5)] for _ in range(12)]
    rows = [(i, some[r.randrange(12)], i % 3) for i in range(90)]
    return rows, spark.createDataFrame(rows, "id bigint, v array<float>, g bigint")


def test_nearest_each_keeps_small_ids_of_ties(vectors):
    rows, df = vectors
    found = knn.nearest_each(df.where("id % 2 = 0"), df, "id", "v", 4, "euclidean")
    assert "MapInArrow" in plan(found)
    got = {(r["query"], r["rank"]): (r["distance"], r["id"]) for r in found.collect()}
    want = {}
    for i, v, _ in rows[::2]:
        for n, x in enumerate(sorted((euclidean(v, w), j) for j, w, _ in rows if j != i)[:4]):
            want[i, n + 1] = x
    assert got == want


def test_unequal_lengths_and_nulls_take_the_plain_join(spark):
    rows = [(i, None if i == 3 else [1.0] * (2 + (i == 5)), 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>, g bigint")
    found = knn.nearest_each(df.where("id = 5"), df, "id", "v", 1, "euclidean")
    assert "MapInArrow" not in plan(found)
    assert [(r["query"], r["id"]) for r in found.collect()] == [(5, 3)]


def test_rules_work_in_tiles(engine, vectors):
    rows, df = vectors
    engine.register("e", df, is_set=True)
    engine.execute("+r(I, J, D) <- e(I, V, G), e(J, W, G), I < J, D = euclidean(V, W)")
    found = engine.query("?r(I, J, D)")
    assert "MapInArrow" in plan(found) and "Aggregate [v" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert {tuple(r) for r in found.collect()} == {(i, j, euclidean(v, w)) for i, v, g in rows for j, w, h in rows if g == h and i < j}
    engine.execute("+t(I, top_k<3, J, D:asc>) <- e(I, V, _), e(J, W, _), I != J, D = euclidean(V, W)")
    found = engine.query("?t(I, J, D)")
    assert "MapInArrow" in plan(found)
    assert {tuple(r) for r in found.collect()} == {(i, j, d) for i, v, _ in rows for d, j in sorted((euclidean(v, w), j) for j, w, _ in rows if j != i)[:3]}


def test_ids_that_repeat_stay_a_set(engine, vectors):
    rows, df = vectors
    engine.register("e", df.withColumn("id", F.col("id") % 40), is_set=True)
    engine.execute("+r(I, J, D) <- e(I, V, G), e(J, W, G), D = euclidean(V, W)")
    want = {(i % 40, j % 40, euclidean(v, w)) for i, v, g in rows for j, w, h in rows if g == h}
    got = [tuple(r) for r in engine.query("?r(I, J, D)").collect()]
    assert len(got) == len(want) and set(got) == want


def test_index_search_by_rows(engine, vectors):
    rows, df = vectors
    engine.register("e", df.select("id", "v"), is_set=True, names=True)
    engine.execute(".index create near on e(v) metric euclidean")
    engine.execute('+r(I, J, D) <- e(I, V), hnsw_nearest("near", V, 2, J, D)')
    found = engine.query("?r(I, J, D)")
    assert "MapInArrow" in plan(found)
    assert {tuple(r) for r in found.collect()} == {(i, j, d) for i, v, _ in rows for d, j in sorted((euclidean(v, w), j) for j, w, _ in rows)[:2]}


def test_int8_distances_reads_every_row(spark):
    program, _, sql, _ = WORKLOADS["int8_distances"]
    assert "%" not in program + sql


@pytest.mark.parametrize("f, costly", [(quantize_symmetric, "array_max"), (quantize_linear, "array_max"), (normalize, "SQRT")])
def test_bounds_are_worked_out_once(spark, f, costly):
    df = spark.createDataFrame([([1.0, -2.0, 0.5],), ([0.0, 0.0, 0.0],), (None,)], "v array<float>").select(f(F.col("v")).alias("q"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count(costly.lower() + "(") <= 1
    assert df.collect()[2]["q"] is None and list(df.collect()[1]["q"]) == [0, 0, 0]

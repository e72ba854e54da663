import math

import pytest
from row_sets import rows
from pyspark.sql import functions as F

from rulespan.functions.registry import REGISTRY

CASES = {
    "abs(-3)": 3, "abs(-2.5)": 2.5, "abs_int64(-7)": 7, "sqrt(-1)": None, "sqrt(9)": 3.0, "pow(2, 3)": 8.0, "log(0)": None, "exp(0)": 1.0, "floor(-1.5)": -2, "ceil(1.2)": 2, "sign(-2)": -1, "sign(0)": 0,
    "min_val(1, 2.5)": 1.0, 'max_val("a", "b")': "b", 'min_val("a", 1)': None, "to_int(-2.9)": -2, 'to_int("3")': None, "to_float(2)": 2.0,
    'len("é")': 2, 'upper("aé")': "AÉ", 'trim("  a\\t ")': "a", 'substr("hello", 1, 3)': "ell", 'substr("hello", -1, 3)': "", 'substr("hello", 9, 3)': "", 'replace("aXbX", "X", "")': "ab", 'concat("a", 1, 2.0)': "a12", "len(3)": None,
    "time_diff(5, 2)": 3, "time_add(9223372036854775807, 1)": 9223372036854775807, "time_decay(0, 10, 10)": 0.5, "time_decay(5, 0, 10)": 1.0, "time_decay(0, 5, 0)": 0.0, "time_decay_linear(0, 5, 10)": 0.5, "within_last(5, 10, 5)": True,
    "within_last(11, 10, 5)": False, "intervals_overlap(1, 3, 3, 5)": True, "interval_contains(1, 9, 2, 3)": True, "interval_duration(5, 3)": -2, "point_in_interval(3, 1, 3)": True, "time_between(4, 1, 3)": False,
    "euclidean([0, 3], [4, 0])": 5.0, "euclidean([1], [1, 2])": math.inf, "cosine([1, 0], [0, 1])": 1.0, "cosine([0, 0], [1, 1])": 0.0, "dot([1, 2], [3, 4])": 11.0, "dot([1], [1, 2])": 0.0, "manhattan([1, 2], [3, 5])": 5.0,
    "normalize([0, 0])": [0.0, 0.0], "vec_dim([1, 2, 3])": 3, "vec_add([1], [2])": [3.0], "vec_add([1], [1, 2])": None, "vec_scale([1, 2], 2)": [2.0, 4.0], 'euclidean("a", [1])': None, "hamming(5, 2)": 3,
    "quantize_linear([1, 0.5, -0.5, -1])": [127, 63, -64, -128], "quantize_linear([2, 2])": [0, 0], "quantize_symmetric([1, -1, 0])": [127, -127, 0],
}


def test_values(engine):
    engine.execute("+one(1)")
    body = ", ".join(f"R{i} = {text}" for i, text in enumerate(CASES))
    found = engine.query(f"?one(X), {body}").collect()[0]
    for i, (text, want) in enumerate(CASES.items()):
        got = found[f"R{i}"]
        assert got == want if not isinstance(want, float) else got == pytest.approx(want), text


def test_nested(engine):
    engine.execute("+one(1)")
    q = "?one(X), Q = quantize_symmetric([3, 4]), D = dequantize(Q), S = dequantize_scaled(Q, 0.5), A = cosine_int8(Q, Q), Z = quantize_linear([1, 1]), B = cosine_int8(Q, Z), C = dot_int8(Q, Q)"
    r = engine.query(q).collect()[0]
    assert r["D"] == [95.0, 127.0] and r["S"] == [47.5, 63.5] and r["A"] == pytest.approx(0) and r["B"] == 1.0 and r["C"] == 95 * 95 + 127 * 127


def test_lsh_structure(engine):
    engine.execute("+v[(1, [0.3, -0.2, 0.9]), (2, [0.3, -0.2, 0.9]), (3, [-0.3, 0.2, -0.9])]\n+b(I, B, P, M) <- v(I, V), B = lsh_bucket(V, 0, 8), P = lsh_probes(B, 8, 40), M = lsh_multi_probe(V, 0, 8, 9)")
    got = {r.I: r for r in engine.query("?b(I, B, P, M)").collect()}
    assert got[1].B == got[2].B and 0 <= got[1].B < 256 and got[1].B != got[3].B
    distances = [bin(int(p) ^ got[1].B).count("1") for p in got[1].P]
    assert distances == sorted(distances) and distances[:10] == [0] + [1] * 8 + [2] and len(set(got[1].P)) == 40
    assert got[1].M[0] == got[1].B and len(set(got[1].M)) == 9


def test_all_have_arity():
    assert len(REGISTRY) >= 57
    for least, most, _ in REGISTRY.values():
        assert least >= 0 and (most is None or most >= least)


def test_unicode_trim(spark):
    from rulespan.functions.registry import Typed, call

    df = spark.createDataFrame([(" x ",)], "s string")
    assert rows(df.select(call("trim", [Typed(F.col("s"), "string")]).column)) == [("x",)]

import pytest
from hypothesis import given, strategies as st

from rulespan import functions  # noqa: F401
from rulespan.errors import SyntaxProblem
from rulespan.plans.ast import AddRule, Agg, Arith, Atom, Compare, Const, Delete, DropName, Insert, Meta, Query, Schema, Update, Var, Wild
from rulespan.plans.parser import parse_program, parse_statement, split_statements


def test_statement_kinds():
    kinds = [type(x) for x in parse_program('+a(1)\n+a[(1, 2), (3, 4)]\nb(1)\n-a(1)\n-a\n+r(X) <- a(X)\nr(X) <- a(X)\n?r(X)\n+s(x: int, y: string)\n-a(X), +a(Y) <- a(X), Y = X + 1\n.kg list')]
    assert kinds == [Insert, Insert, Insert, Delete, DropName, AddRule, AddRule, Query, Schema, Update, Meta]


def test_terms():
    q = parse_statement('?r(X, _, -3, 2.5e1, "a\\"b", true, [1, -2.5])')
    assert q.goal.args == (Var("X"), Wild(), Const(-3), Const(25.0), Const('a"b'), Const(True), Const((1.0, -2.5)))


def test_precedence_and_brackets():
    rule = parse_statement("r(X, Y) <- a(X), Y = X + 2 * (X - 1)").rule
    assert rule.body[1] == Compare("=", Var("Y"), Arith("+", Var("X"), Arith("*", Const(2), Arith("-", Var("X"), Const(1)))))


def test_aggregates():
    rule = parse_statement("r(K, top_k<3, N, S:asc>) <- a(K, N, S)").rule
    assert rule.head.args[1] == Agg("top_k", (Var("N"), Var("S")), (3,), "S", False)
    assert parse_statement("r(top_k<3, S>) <- a(S)").rule.head.args[0].descending
    with pytest.raises(SyntaxProblem):
        parse_statement("r(top_k<3, A, B>) <- a(A, B)")


def test_rules_over_lines_and_comments():
    text = '+r(X) <-\n    a(X), // first\n    b(X) /* and\n more */\n?r(X)\n+u("http://x")'
    assert len(split_statements(text)) == 3
    assert parse_program(text)[2].rows == (("http://x",),)


def test_limit_and_order():
    q = parse_statement("?r(X:desc, Y:asc), X > 1, limit(5, 2)")
    assert (q.order, q.limit, q.offset) == (((0, True), (1, False)), 5, 2)


@pytest.mark.parametrize("text", ["+r(X)", "?r(X) <- a(X)", "+r(X) <-", "r(abc) <- a(X)", "+a(1,", "?", "+a(1) 2"])
def test_errors(text):
    with pytest.raises(SyntaxProblem):
        parse_statement(text)


@given(st.text(max_size=60))
def test_any_text_parses_or_is_refused(text):
    try:
        parse_program(text)
    except SyntaxProblem:
        pass


@given(st.recursive(st.integers(0, 99).map(Const) | st.sampled_from("XYZ").map(Var), lambda t: st.builds(Arith, st.sampled_from("+-*/%"), t, t), max_leaves=8))
def test_terms_print_and_parse_back(term):
    found = parse_statement(f"r(A) <- a(X, Y, Z), A = {term}").rule.body[1].right
    assert str(found) == str(term)


def test_negated_atom_and_not_equal():
    rule = parse_statement("r(X) <- a(X), !b(X, _), X != 3").rule
    assert rule.body[1:] == (Atom("b", (Var("X"), Wild()), True), Compare("!=", Var("X"), Const(3)))

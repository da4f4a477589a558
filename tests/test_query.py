import pytest

from sparrowdex.operators import query as q


def test_match_all():
    assert all(isinstance(q.parse(t), q.MatchAll) for t in (None, "", "  ", "*"))


def test_default_operator_is_or():
    assert q.parse("a b") == q.Bool(should=(q.Term(text="a"), q.Term(text="b")))


def test_boolean_words_and_signs():
    assert q.parse("a AND b") == q.Bool(must=(q.Term(text="a"), q.Term(text="b")))
    assert q.parse("a NOT b") == q.Bool(should=(q.Term(text="a"),), must_not=(q.Term(text="b"),))
    assert q.parse("+a -b c") == q.Bool(must=(q.Term(text="a"),), should=(q.Term(text="c"),), must_not=(q.Term(text="b"),))
    assert q.parse("(a OR b) AND c").must[0] == q.Bool(should=(q.Term(text="a"), q.Term(text="b")))


def test_leaves():
    assert q.parse('"A b"~2^3') == q.Phrase(3.0, "text", ("a", "b"), 2)
    assert q.parse("lang:en^2") == q.Term(2.0, "lang", "en")
    assert q.parse("Vertr*") == q.Prefix(1.0, "text", "vertr")
    assert q.parse("*trag") == q.Wildcard(1.0, "text", "*trag")
    assert q.parse("haus~1") == q.Fuzzy(1.0, "text", "haus", 1)
    assert q.parse("haus~") == q.Fuzzy(1.0, "text", "haus", 2)
    assert q.parse("n_chars:[5 TO *]") == q.Range(1.0, "n_chars", "5", None, (True, True))


def test_errors():
    for bad in ("(a", "a)", 'a "b'):
        with pytest.raises(q.ParseError):
            q.parse(bad)


def test_simple_mode_is_literal():
    assert q.parse("a AND (b*", simple=True) == q.Bool(should=(q.Term(text="a"), q.Term(text="and"), q.Term(text="b")))


def test_rewrites():
    r = q.rewrite(q.parse('x AND "a b"'))
    assert r.must[1] == q.Bool(should=(q.Phrase(2.0, "text", ("a", "b"), 0), q.Phrase(1.0, "text", ("a", "b"), 3)))
    assert q.rewrite(q.parse("vert*")).scored and not q.rewrite(q.parse("ver*")).scored
    assert q.rewrite(q.parse('"a b"~1')).slop == 1
    assert q.query_terms(r) == ["x", "a", "b"]

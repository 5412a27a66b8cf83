import pytest

from siftwell.errors import InvalidQueryError
from siftwell.plans.query import All, Any, Not, Term, analyse, parse, positive_words, relax, summary, validate


def t(*words, prefix=False):
    return Term(words, prefix)


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("ruby", t("ruby")),
        ("machine learning", Any((t("machine"), t("learning")))),
        ("a AND b", All((t("a"), t("b")))),
        ("a and b or c", Any((All((t("a"), t("b"))), t("c")))),
        ("a NOT b", All((t("a"), Not(t("b"))))),
        ("a OR NOT b", Any((t("a"), Not(t("b"))))),
        ("NOT NOT a", Not(Not(t("a")))),
        ('"Deep Learning" x', All((t("deep", "learning"), t("x")))),
        ('"a b" OR "c d"', Any((t("a", "b"), t("c", "d")))),
        ("(a OR b) AND c", All((Any((t("a"), t("b"))), t("c")))),
        ("a b AND c", All((t("a"), t("b"), t("c")))),
        ("AND a OR", t("a")),
        ("a AND", t("a")),
        ("NOT", None),
        ("", None),
        ("!!", None),
        ('"say \\"hi\\" now"', t("say", "hi", "now")),
        ('"open', t("open")),
        ("pre:*", t("pre", prefix=True)),
        ("a) b", All((t("a"), t("b")))),
        ("机器学习", t("机器", "器学", "学习")),
    ],
)
def test_trees(query, tree):
    assert parse(query) == tree


def test_words_that_rank():
    assert positive_words(parse('a AND "b c" NOT d AND a')) == ["a", "b", "c"]
    assert positive_words(None) == []


def test_analysis():
    assert analyse("Don't STOP_me 42 é") == ["don", "t", "stop_me", "42", "é"]
    assert analyse("中文 ab中") == ["中文", "ab", "中"]


def test_summary_and_relaxing():
    s = summary('foo "bar baz" AND qux')
    assert s["phrases"] == ["bar baz"] and s["has_boolean"] and s["has_phrases"] and s["tokens"] == ["foo", "AND", "qux"]
    assert summary(None)["tokens"] == []
    assert relax('"a b" AND (c OR not d)') == "a b c d"


@pytest.mark.parametrize("bad", [None, "", "  ", "x", "y" * 1001])
def test_validation(bad):
    with pytest.raises(InvalidQueryError):
        validate(bad)
    assert validate("  ok ") == "ok"

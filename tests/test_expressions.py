import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillon.expr import Expr, Float32, Int8, Int32, Int64, Span, Symbol, atom, build, same, to_text
from quillon.plans.pattern import Rules, matches
from quillon.reader import IncompleteInput, read, read_all, read_url, write


def test_equality_minds_the_type():
    assert same(Int32(5), atom(5)) and not same(Int32(5), Int64(5)) and not same(5.0, Float32(5))
    assert not same(Symbol("a"), "a") and Symbol("a") != "a" and "a" != Symbol("a")
    assert not same(True, Int32(1))
    assert Expr("A", 1) != Expr("B", 1) and Expr("A", 1) != Expr("A", 1, 2) and Expr("A", 1) == Expr("A", 1)
    assert type(atom(2**31)) is Int64 and type(atom(2**31 - 1)) is Int32 and type(atom(-(2**31))) is Int32
    with pytest.raises(OverflowError):
        atom(200, Int8)


def test_spans_read_as_their_elements():
    assert Expr("L", Span([1, 2, 3], Int64)) == Expr("L", Int64(1), Int64(2), Int64(3))
    assert Expr("L", np.array([1, 2], dtype="int32")) == Expr("L", 1, 2)
    assert Expr("L", pa.array([1.5, 2.5])) == Expr("L", 1.5, 2.5)
    s = Span(range(10))
    assert list(s.subspan(2, 3)) == [2, 3, 4] and len(s.subspan(8)) == 2
    with pytest.raises(IndexError):
        s.subspan(8, 5)
    with pytest.raises(TypeError):
        Span([1, 2.5])


def test_printing():
    assert to_text(Expr("H")) == "(H)"
    assert to_text(build("Plus")(1, 2.5, "x y", Symbol("s"), True)) == '(Plus 1 2.5 "x y" s True)'
    assert repr(Symbol("a") + Symbol("b")) == "(Plus a b)"
    big = "a" * 204_800
    assert to_text(Expr(big, big)) == f'({big} "{big}")'


@pytest.mark.parametrize("text", ["42", "3000000000", "3.14", '"hello"', "mySymbol", "#t", "#f", "(Head)", "(Plus 1)", "(Plus 1 2)", "(Select (From staff) (Where (Less years 7)))", '(Load "staff.csv")', '(Insert "staff" 7 0.5)', "(Greater |sum(q)| 3)", '(|a b| "c\\"d\\\\")'])
def test_reader_round_trip(text):
    assert write(read(text)) == text


def test_reader_details():
    assert read("'LINEITEM") == Symbol("LINEITEM") and read("(a ; no\n #| no |# [b 1])") == Expr("a", Expr("b", 1))
    assert [type(x) for x in read_all("1 2.0 .5 -3 1e3 +")] == [Int32, float, float, Int32, float, Symbol]
    assert read("((1 2) 3)") == Expr("List", Expr("List", 1, 2), 3)
    assert read('("file name" 1)') == Expr("file name", 1)
    for bad in ("(a", '"a', "(a (b)"):
        with pytest.raises(IncompleteInput):
            read(bad)
    with pytest.raises(ValueError, match="too many"):
        read("a)")
    with pytest.raises(ValueError, match="found 2"):
        read("a b")


atoms = st.one_of(st.booleans(), st.integers(-(2**63), 2**63 - 1).map(atom), st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(exclude_categories=["Cs"]), max_size=8), st.text("abcXYZ ()'#;9", min_size=1, max_size=6).map(Symbol))
trees = st.recursive(atoms, lambda t: st.builds(lambda h, a: Expr(h, *a), st.text("abcXYZ()9 ", min_size=1, max_size=5), st.lists(t, max_size=4)), max_leaves=12)


@given(trees)
def test_write_then_read_is_the_same(x):
    assert same(read(write(x)), x)


def test_url():
    assert read_url("/People/:/Project/:/As/Short/Nick") == read("(Project People (As Short Nick))")
    assert read_url("/t/:/Filter/:/Greater/a/1/::/::/Schema") == read("(Schema (Filter t (Greater a 1)))")
    assert read_url("/t/:/Filter/:/Greater/a/1/:::/Top/2") == read("(Top (Filter t (Greater a 1)) 2)")


def test_patterns():
    assert matches(read("(F Any_ Integer_)"), read("(F x 3)")) and not matches(read("(F Any_ Integer_)"), read("(F x 3 4)"))
    assert matches(read("(F AnySequence_)"), read("(F)")) and matches(read("(F AnySequence_ String_ AnySequence_)"), read('(F 1 2 "s" 3)'))
    assert not matches(read("(F AnySequence_ String_)"), read('(F "s" 3)'))
    assert matches(read("(F Symbol_)"), read("(F x)")) and not matches(read("(F Symbol_)"), read('(F "x")'))
    assert matches(read("(F (G Any_) 2)"), read("(F (G 1) 2)")) and matches(Symbol("Any_"), read("7"))
    assert matches(read("(F 1 2)"), Expr("F", Span([1, 2])))
    rules = Rules()
    rules.on(read("(Inc Integer_)"), lambda n: atom(n + 1), recurse=lambda e: rules(e)).on(read("(Inc Any_)"), lambda n: atom(n + 1) if isinstance(n, int) else n, recurse=lambda e: rules(e))
    assert rules(read("(Inc 1)")) == 2 and rules(read("(Inc (Inc 1))")) == 3 and rules(read("(Other 1)")) == read("(Other 1)")

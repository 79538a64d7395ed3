import random

import pytest

from quillon.expr import Expr, Float32, Int32, Int64, Span, Symbol, build, same
from quillon.plans.dialect import CATALOGUE, RELATIONAL, infer
from quillon.plans.relation import PlanError
from quillon.reader import read
from quillon.session import Session

PEOPLE = '(Table (ID (List 1 2 3)) (FirstName (List "Ann" "Bo" "Cleo")) (LastName (List "Marsh" "Hill" "Field")) (BirthYear (List 1931 1980 1942)) (Country (List "USA" "USA" "USA")))'


def ev(session, text):
    return repr(session.evaluate(text))


def test_atoms_and_arithmetic(session):
    assert same(session.evaluate("9"), Int32(9))
    for text in ("(Plus 5 4)", "(Plus 5 2 2)", "(Plus (Plus 2 3) 2 2)", "(Plus (Plus 3 2) 2 2)", "(Minus 11 2)", "(Times 3 3)", "(Add 4 5)"):
        assert same(session.evaluate(text), Int32(9))
    plus = build("Plus")
    assert same(session.evaluate(plus(Float32(2.5), Float32(2.5))), Float32(5.0))
    assert same(session.evaluate(plus(2.5, 2.5)), 5.0)
    assert same(session.evaluate(plus(Int64(2), Int32(3))), Int64(5))
    assert session.evaluate("(Greater 5 2)") is True and session.evaluate("(Greater 2 5)") is False
    assert session.evaluate('(StringJoin "howdie" " " "world")') == "howdie world"
    assert same(session.evaluate('(Symbol "x")'), Symbol("x"))
    assert session.evaluate(Expr("Undefined", 9)) == Expr("Undefined", 9)
    assert session.evaluate("(Not (And #t (Or #f #f)))") is True


@pytest.mark.parametrize("kind", [Int32, Int64, Float32, float])
@pytest.mark.parametrize("size", [5, 50])
def test_sum_of_a_span(session, kind, size):
    r = random.Random(size)
    values = [kind(r.randint(1, 1000)) for _ in range(size)]
    assert same(session.evaluate(Expr("Plus", Span(values, kind))), kind(sum(values)))


def test_kernel_operators(session):
    with pytest.raises(TypeError, match='expected and actual type mismatch in expression "9", expected string'):
        session.evaluate("(EvaluateInEngines (List 9) 5)")
    session.register_stage("twice", lambda x: Expr("Plus", x, x))
    assert session.evaluate('(EvaluateInEngines (List "twice" "spark") 1 4)') == 8
    assert session.evaluate('(EvaluateInEngines (List "spark") (EvaluateInEngines (List "twice" "spark") 4))') == 8
    assert session.evaluate('(SetDefaultEnginePipeline "twice")') == "okay"
    assert session.evaluate('(SetDefaultEnginePipeline "spark")') == "okay"
    assert session.pipeline == ["twice", "spark"] and session.evaluate("21") == 42
    assert session.evaluate("(ResetEngines)") == "okay" and session.pipeline == ["twice", "spark"]
    out = session.call("(EvaluateInEngines (List 9) 5)")
    assert out.head == Symbol("ErrorWhenEvaluatingExpression") and len(out.args) == 2


def test_selection_and_projection(session):
    ints = "(Table (Value (List 10 20 30 40 50)))"
    assert ev(session, "(Select (Table (Value (List 2 3 1 4 1))) (Where (Greater Value 3)))") == "(Table (Value (List 4)))"
    assert ev(session, f"(Project {ints} (As Result (Plus Value Value)))") == "(Table (Result (List 20 40 60 80 100)))"
    assert ev(session, f"(Project {ints} (As Result (Greater Value 25)))") == "(Table (Result (List False False True True True)))"
    assert ev(session, f"(Project {ints} (As Result (Greater 45 Value)))") == "(Table (Result (List True True True True False)))"
    assert ev(session, f"(Project {ints} (As Result (And (Greater Value 25) (Greater 45 Value))))") == "(Table (Result (List False False True True False)))"
    assert ev(session, f"(Select {PEOPLE} (Function #t))") == repr(read(PEOPLE))
    assert ev(session, f"(Select {PEOPLE} (Function #f))") == "(Table (ID (List)) (FirstName (List)) (LastName (List)) (BirthYear (List)) (Country (List)))"
    assert ev(session, "(Select (Table (ID (List)) (Name (List))) (Function #t))") == "(Table (ID (List)) (Name (List)))"
    assert ev(session, f'(Select {PEOPLE} (Where (StringContainsQ LastName "Hill")))') == '(Table (ID (List 2)) (FirstName (List "Bo")) (LastName (List "Hill")) (BirthYear (List 1980)) (Country (List "USA")))'
    assert ev(session, f"(Project (Select {PEOPLE} (Where (Equal ID 3))) (As FirstName FirstName LastName LastName))") == '(Table (FirstName (List "Cleo")) (LastName (List "Field")))'
    assert ev(session, f"(Project (Select {PEOPLE} (Where (Equal BirthYear 0))) (As ID ID))") == "(Table (ID (List)))"


def test_sorting_and_grouping(session):
    assert ev(session, f"(Sort (Select {PEOPLE} (Function #t)) (By ID))") == repr(read(PEOPLE))
    assert ev(session, f"(Project (Sort {PEOPLE} (By LastName)) (As ID ID))") == "(Table (ID (List 3 2 1)))"
    assert ev(session, f"(Project (Order {PEOPLE} (By Country BirthYear desc)) (As ID ID))") == "(Table (ID (List 2 3 1)))"
    assert ev(session, f"(Project (Top {PEOPLE} (By BirthYear desc) 2) (As ID ID))") == "(Table (ID (List 2 3)))"
    assert ev(session, f"(Group {PEOPLE} (Function 0) Count)") == "(Table (Count (List 3)) (Function (List 0)))"
    assert ev(session, f"(Group {PEOPLE} Count)") == "(Table (Count (List 3)))"
    assert ev(session, f'(Group (Select {PEOPLE} (Where (StringContainsQ LastName "Hill"))) (Function 0) Count)') == "(Table (Count (List 1)) (Function (List 0)))"
    # a key that differs in case is found where only a column fits; in a value it is a string
    assert ev(session, f"(Group {PEOPLE} (By country) (As n (Count *) y (Sum birthyear)))") == '(Table (Country (List "USA")) (n (List 3)) (y (List 5853)))'
    assert ev(session, f"(Group (Select {PEOPLE} (Where (Equal Country country))) Count)") == "(Table (Count (List 0)))"


def test_join_of_spans(session):
    n = range(10)
    a = Expr("Table", Expr("From", Expr("List", Span(n, Int64))), Expr("To", Expr("List", Span(range(10, 20), Int64))))
    b = Expr("Table", Expr("From2", Expr("List", Span(range(10, 20), Int64))), Expr("To2", Expr("List", Span(n, Int64))))
    out = session.evaluate(Expr("Join", a, b, read("(Where (Equal To From2))")))
    assert len(out.args) == 4 and len(out.args[0].args[0].args) == 10


def test_dates(session):
    t = '(Table (d (List (DateObject "1998-01-24") (DateObject "1992-05-01"))) (x (List 1 2)))'
    assert ev(session, f'(Project (Select {t} (Where (Greater d (DateObject "1995-01-01")))) (As d d))') == '(Table (d (List (DateObject "1998-01-24"))))'
    assert ev(session, f'(Filter {t} (Greater d "1995-01-01"))') == '(Table (d (DateObject "1998-01-24")) (x 1))'
    assert ev(session, '(Filter (Table (s "1995-01-02" "x")) (Equal s "1995-01-02"))') == '(Table (s "1995-01-02"))'


def test_symbols_and_nulls(session):
    assert ev(session, "(Table (A 1 NULL 3) (B x NULL y) (C NULL NULL NULL))") == "(Table (A 1 NULL 3) (B x NULL y) (C NULL NULL NULL))"
    assert ev(session, "(GroupBy (Table (s a b a)) (CountAll) s)") in ("(Table (s a b) (count_all() 2 1))", "(Table (s b a) (count_all() 1 2))")
    assert ev(session, "(Union (Table (s \"p\")) (Table (s a)))") == '(Table (s "p" "a"))'
    assert ev(session, "(Union (Table (a 1) (b 2)) (Table (b 3) (c 4)))") == "(Table (a 1 NULL) (b 2 3) (c NULL 4))"
    assert ev(session, "(Table (x 1 2.5))") == "(Table (x 1.0 2.5))"


def test_joins(session):
    l, r = "(Table (k 1 2 NULL) (v 10 20 30))", "(Table (k 2 3 NULL) (v 200 300 400))"  # noqa: E741
    assert ev(session, f"(Join {l} {r} (Equal k k))") == "(Table (k_l 2) (v_l 20) (k_r 2) (v_r 200))"
    assert ev(session, f"(OrderBy (LeftJoin {l} {r} (Equal k k)) (keys v_l))") == "(Table (k_l 1 2 NULL) (v_l 10 20 30) (k_r NULL 2 NULL) (v_r NULL 200 NULL))"
    assert ev(session, f"(OrderBy (AntiJoin {l} {r} (Equal k k)) (keys v))") == "(Table (k 1 NULL) (v 10 30))"
    # a residual that fails keeps the left row
    assert ev(session, f"(OrderBy (LeftJoin {l} (Project {r} (As k j) (As v w)) (Equal k j) (Greater w 500)) (keys v))") == "(Table (k 1 2 NULL) (v 10 20 30) (j NULL NULL NULL) (w NULL NULL NULL))"
    assert ev(session, "(OrderBy (Join (Table (p 1 7 30)) (Table (lo 0 5) (hi 9 8) (n a b)) (Between p lo hi)) (keys p n))") == "(Table (p 1 7 7) (lo 0 0 5) (hi 9 9 8) (n a a b))"
    session.evaluate(f"(Name {l} t)")
    assert ev(session, "(OrderBy (Join (ByName t) (ByName t) (Equal k k)) (keys k_l))") == "(Table (k_l 1 2) (v_l 10 20) (k_r 1 2) (v_r 10 20))"


def test_range_join_by_buckets(session, monkeypatch):
    from quillon.operators import joins

    r = random.Random(2)
    left = "(Table (p " + " ".join(str(r.randint(-50, 50)) for _ in range(60)) + "))"
    right = "(Table (lo " + " ".join(str(x := r.randint(-50, 50)) for _ in range(30)) + ") (hi " + " ".join(str(r.randint(-50, 60)) for _ in range(30)) + "))"
    q = f"(OrderBy (Join {left} {right} (Between p lo hi)) (keys p lo hi))"
    want = ev(session, q)
    monkeypatch.setattr(joins, "SMALL", -1)
    for width in (None, 1.0, 7.5, 500.0):
        session.range_width = width
        assert ev(session, q) == want
        assert "bucket" in session.relation(q).df._jdf.queryExecution().toString()


@pytest.mark.parametrize("head", ["LeftJoin", "AntiJoin"])
def test_left_and_anti_range_joins_by_buckets(session, monkeypatch, head):
    """Values and ranges on the left, of one length and of many, empty and null ones among them: all as a broadcast has it."""
    from quillon.operators import joins

    r = random.Random(5)
    values = "(Table (p NULL " + " ".join(str(r.randint(-500, 500)) for _ in range(60)) + "))"
    lows = [r.randint(-500, 500) for _ in range(24)]
    spans = lambda lengths: "(Table (lo NULL " + " ".join(map(str, lows)) + ") (hi 3 " + " ".join(str(x + n) for x, n in zip(lows, lengths)) + "))"
    for lengths in ([r.choice([0, 1, 2, -40]) for _ in lows], [r.choice([0, 0, 1, 5, -9]) if i else 400 for i in range(24)], [-1] * 24):
        for a, b, keys in ((values, spans(lengths), "p"), (spans(lengths), values, "lo hi")):
            q = f"(OrderBy ({head} {a} {b} (Between p lo hi)) (keys {keys if head == 'AntiJoin' else 'p lo hi'}))"
            for width in (None, 1.0):
                session.range_width = width
                monkeypatch.setattr(joins, "SMALL", 1 << 63)  # a literal's estimate is the largest long
                want = ev(session, q)
                monkeypatch.setattr(joins, "SMALL", -1)
                assert ev(session, q) == want


@pytest.mark.parametrize("head", ["LeftJoin", "AntiJoin"])
def test_empty_ranges_neither_copy_values_nor_gather_rows(session, monkeypatch, head):
    """One level of buckets: each value of the left side goes to one bucket, and no window or aggregate follows."""
    from quillon.operators import joins

    monkeypatch.setattr(joins, "SMALL", -1)
    plan = session.relation(f"({head} (Table (p 1 7 30)) (Table (lo 0 5 900) (hi 9 8 3)) (Between p lo hi))").df._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and "Window" not in plan and "Aggregate" not in plan
    assert plan.count("level, 0, at") == 2 and "level, 1, at" not in plan


@pytest.mark.parametrize("name", ["join_left_range", "join_left_range_large", "join_anti_range", "join_anti_range_large"])
def test_orders_go_to_one_bucket_each(spark, name):
    """Days against three ranges, one of which holds nothing: each order once, no window over its copies."""
    from quillon import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("level, 0, at") == 2 and "level, 1, at" not in plan and "Window" not in plan


def test_few_or_long_ranges_deal_values_to_many_buckets():
    """The longest of a few ranges, and each range of a wider level, touches 64 buckets at least and 1,025 at most."""
    from quillon.operators import joins

    width, ends = joins.scale(3, 862.0, 2556.0, 10591.0)  # the seasons, in days
    assert not ends and 64 <= 2556 / width <= 1024
    width, ends = joins.scale(10**6, 2.0, 10**6, 10**9)
    assert width == 0.5 and len(ends) == 3
    for i, (shortest, longest) in enumerate(zip([0, *ends], [*ends, 10**6])):
        at = width * joins.WIDER**i
        assert (not i or shortest / at >= 64) and longest / at <= 1024
    assert 2e18 / joins.scale(2, 1.0, 1.0, 2e18)[0] < 2**62  # bounds that are ids of 64 bits don't fall into one bucket


@pytest.mark.parametrize("head", ["Join", "LeftJoin", "AntiJoin"])
def test_measured_buckets_of_many_levels(session, monkeypatch, head):
    """Ranges of very different lengths by the measured width, values and ranges on the left: all as a broadcast has it."""
    from quillon.operators import joins

    r = random.Random(8)
    values = "(Table (p NULL " + " ".join(str(r.randint(-9000, 90000)) for _ in range(90)) + "))"
    spans = [(x, x + n) for x, n in ((r.randint(-9000, 90000), r.choice([0, 1, 2, -3])) for _ in range(450))] + [(-500, 5000), (7, 80000)]
    ranges = "(Table (lo NULL " + " ".join(str(x) for x, _ in spans) + ") (hi 3 " + " ".join(str(y) for _, y in spans) + "))"
    for a, b, keys in ((values, ranges, "p"), (ranges, values, "lo hi")):
        q = f"(OrderBy ({head} {a} {b} (Between p lo hi)) (keys {keys if head == 'AntiJoin' else 'p lo hi'}))"
        monkeypatch.setattr(joins, "SMALL", 1 << 63)
        want = ev(session, q)
        monkeypatch.setattr(joins, "SMALL", -1)
        assert ev(session, q) == want
        assert "level, 1, at" in session.relation(q).df._jdf.queryExecution().optimizedPlan().toString()


def test_sliding(session):
    assert ev(session, "(Cumulate (Table (v 1 NULL 3)) (Sum v))") == "(Table (v 1 NULL 3) (sum(v) 1 1 4))"
    # ties stand one by one, in the order they came
    assert ev(session, "(Cumulate (OrderBy (Table (k 1 1 0) (v 1 2 4)) (keys k)) (Sum v))") == "(Table (k 0 1 1) (v 4 1 2) (sum(v) 4 5 7))"
    assert ev(session, "(Pairwise (Table (v 1 4 9 16)) d v 2)") == "(Table (v 1 4 9 16) (d NULL NULL 8 12))"
    with pytest.raises(PlanError, match="needs an ordered table"):
        session.evaluate("(Cumulate (GroupBy (Table (k 1 2)) k) (Sum k))")
    assert ev(session, "(Slice (Table (v 1 4 9 16)) 1 2)") == "(Table (v 4 9))"


@pytest.mark.parametrize("head", ["Sum", "Mean", "Min", "Max", "Count"])
def test_sliding_by_ranges_is_the_same(spark, session, head):
    r = random.Random(7)
    rows = [(i, r.choice([None, *range(20)]), r.choice([None, *range(-9, 9)])) for i in range(300)]
    session.register_table("t", spark.createDataFrame(rows, "id long, k long, v long").repartition(3, "id"))
    for keys in ("k id", "(Desc k) id", "id"):
        plans = [f"(Cumulate (OrderBy t (keys {keys})) ({head} v))", f"(Pairwise (OrderBy t (keys {keys})) d v 5)"]
        want = [ev(session, p) for p in plans]
        for n in (2, 16):
            session.window_ranges = n
            assert [ev(session, p) for p in plans] == want
        session.window_ranges = None
    session.window_ranges = 4
    scan = session.evaluate("(Cumulate (Filter t (Greater id 3)) (Count id))")
    assert [int(x) for x in scan.args[-1].args] == list(range(1, 297))


def test_interpolate_and_inserts(session):
    for y0, y2 in ((3, 9), (101, 7)):
        t = f"(Table (x (List 1 5 77)) (y (List {y0} (Interpolate x) {y2})))"
        assert ev(session, f"(Project {t} (As y y))") == f"(Table (y (List {y0} {(y0 + y2) // 2} {y2})))"
    assert ev(session, "(Table (y (List (Interpolate y) 1 (Interpolate y) (Interpolate y) 4.0)))") == "(Table (y (List NULL 1.0 2.5 2.5 4.0)))"
    session.evaluate("(CreateTable t id:INTEGER name:VARCHAR:10 price:DECIMAL:152)")
    assert ev(session, "(Schema t)") == "(Table (Columns id name price))"
    session.evaluate('(InsertInto t 1 "a" 2.5)')
    assert ev(session, "(Project t id name)") == '(Table (id 1) (name "a"))'
    with pytest.raises(PlanError, match="3 columns"):
        session.evaluate("(InsertInto t 1)")


def test_names(session):
    session.evaluate("(Name (GroupBy (Table (v 4 2 3)) (Min v)) least)")
    assert ev(session, "(Filter (Table (v 4 2 3)) (Equal v (ByName least)))") == "(Table (v 2))"
    assert ev(session, "(Project (Table (v 4 2)) v (As (Subtract v (ByName least)) over))") == "(Table (v 4 2) (over 2 0))"
    session.evaluate("(Name (Table (v 4 2 3)) many)")
    assert "more than one row" in repr(session.call("(Filter (Table (v 4 2 3)) (Equal v (ByName many)))"))
    assert "no table is bound" in repr(session.call("(Filter (ByName nothing) #t)"))
    assert ev(session, "(Materialize (Filter (ByName many) (Greater v 2)))") == "(Table (v 4 3))"
    session.evaluate("(ResetEngines)")
    assert "no table is bound" in repr(session.call("(ByName many)"))


def test_dialects(session):
    assert infer(read("(Filter t (Equal a 1))")) == CATALOGUE and infer(read("(Select t (Where (Equal a 1)))")) == RELATIONAL
    assert infer(read("(Project t (As a (Add b c) d e))")) == RELATIONAL and infer(read("(Project t (As (Add b c) a))")) == CATALOGUE
    assert infer(read("(Project t (As a b))")) == CATALOGUE and infer(read("(Project t (As a b))"), RELATIONAL) == RELATIONAL
    assert infer(read("(Join t u (Where (Equal a b)))")) == RELATIONAL
    with pytest.raises(PlanError, match="mixes vocabularies"):
        infer(read("(Filter (Select t (Where #t)) (Equal a 1))"))
    t = "(Table (x (List 1 2 3)))"
    assert ev(session, f"(Project {t} (As y x))") == "(Table (y (List 1 2 3)))"
    mixed = Session(session.spark, dialect=CATALOGUE)
    assert repr(mixed.evaluate(f"(Filter (Sort {t} (By x)) (Greater x 1))")) == "(Table (x 2 3))"


def test_errors_and_limits(spark, session):
    assert "no column z" in repr(session.call("(Project (Table (a 1)) z)"))
    assert "named twice" in repr(session.call("(Project (Table (a 1)) a (As a a))"))
    assert "no table t" in repr(session.call("(Filter t (Equal a 1))"))
    small = Session(spark, cap=2)
    assert "more than 2 rows" in repr(small.call("(Table (a 1 2 3))")) and repr(small.call("(ToStatus (Table (a 1 2 3)))")) == "'OK'"
    assert repr(session.evaluate("(Unknown (Plus 1 2) (Table (a 1)))")) == "(Unknown 3 (Table (a 1)))"
    assert "Pairwise" in session.evaluate("(GetEngineDescription)")


def test_extension(spark, session):
    from pyspark.sql import functions as F

    session.register_scalar("Shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    session.register_aggregate("Spread", lambda c: F.max(c) - F.min(c))
    session.register_operator("Head", lambda c, args: c.relation(read(f"(Slice {args[0]!r} 0 {args[1]})")))
    assert ev(session, '(Project (Table (a "x")) (As (Shout a) b))') == '(Table (b "X!"))'
    assert ev(session, "(GroupBy (Table (a 1 9 4)) (Spread a))") == "(Table (spread(a) 8))"
    assert ev(session, "(Head (Table (a 1 9 4)) 2)") == "(Table (a 1 9))"


def test_plans_push_down(spark, session):
    session.register_table("lineitem", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    plan = session.dataframe('(Project (Filter lineitem (Greater l_shipdate "1998-01-01")) l_orderkey)')._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_shipdate" in plan and "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan
    plan = session.dataframe("(Top (Project lineitem (As l_orderkey l_orderkey)) (By l_orderkey) 3)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_algebra(spark, session):
    session.register_table("customer", spark.read.parquet("/root/testdata/sf0.001/customer.parquet"))
    session.register_table("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    n = lambda q: session.dataframe(q).count()
    p, q = "(Greater c_acctbal 0.0)", "(Less c_nationkey 9)"
    assert n(f"(Filter (Filter customer {p}) {q})") == n(f"(Filter customer (And {p} {q}))")
    assert n("(Union customer customer customer)") == 3 * n("customer")
    some = "(Filter orders (Greater o_totalprice 300000.0))"
    keys = "(Equal c_custkey o_custkey)"
    matched = n(f"(GroupBy (Join customer {some} {keys}) c_custkey)")
    assert n(f"(AntiJoin customer {some} {keys})") + matched == n("customer") and n(f"(LeftJoin customer {some} {keys})") >= n("customer")
    last = session.evaluate("(Slice (OrderBy (Cumulate (OrderBy orders (keys o_orderkey)) (Max o_totalprice)) (keys (Desc o_orderkey))) 0 1)")
    assert last.args[-1].args[0] == session.evaluate("(GroupBy orders (Max o_totalprice))").args[0].args[0]


def test_kept_results_go_with_their_call(session):
    session.evaluate("(Materialize (Table (a 1 2)))")
    assert session._kept == []
    session.evaluate("(Name (Materialize (Table (a 1 2))) kept)")
    assert len(session._kept) == 1 and repr(session.evaluate("(ByName kept)")) == "(Table (a 1 2))"
    session.evaluate("(Materialize (Table (a 3)))")
    assert len(session._kept) == 1
    session.evaluate("(ResetEngines)")
    assert session._kept == []

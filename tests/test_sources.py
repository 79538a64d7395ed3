import pytest

from quillon.expr import Expr
from quillon.session import Session


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    (d / "a b.csv").write_text("id,x\n1,one\n2,two\n")
    (d / "c.csv").write_text("x,id,z\nthree,3,2.5\n")
    (d / "note.txt").write_text("no table")
    return d


def ev(session, text):
    return repr(session.evaluate(text))


def test_csv(session, folder):
    assert ev(session, f'(Load "{folder}/a b.csv")') == '(Table (id 1 2) (x "one" "two"))'
    assert ev(session, f'(Load "{folder}/a b.csv" x)') == '(Table (x "one" "two"))'
    assert ev(session, f'(Load "{folder}/a b.csv" y)').startswith("'Load::error: ")
    assert ev(session, f'(Load "{folder}/none.csv")').startswith("'Load::error: ")
    assert ev(session, f'(Filter (Load "{folder}/none.csv") #t)').startswith("'Load::error: ")


def test_ragged_rows_are_padded(session, tmp_path):
    (tmp_path / "r.csv").write_text("a,b,c\n1,2,3\n4\n5,6\n")
    assert ev(session, f'(Load "{tmp_path}/r.csv")') == "(Table (a 1 4 5) (b 2 NULL 6) (c 3 NULL NULL))"


def test_directory(session, folder, tmp_path):
    assert ev(session, f'(Load "{folder}")') == '(Table (id 1 2 3) (x "one" "two" "three") (z NULL NULL 2.5) (file name |a b.csv| |a b.csv| c.csv))'.replace("|", "")
    assert ev(session, f'(Load "{folder}/" z id)') == "(Table (z NULL NULL 2.5) (id 1 2 3) (file name a b.csv a b.csv c.csv))"
    assert ev(session, f'(GroupBy (Load "{folder}") (CountAll) |file name|)') in ("(Table (file name a b.csv c.csv) (count_all() 2 1))", "(Table (file name c.csv a b.csv) (count_all() 1 2))")
    (tmp_path / "empty").mkdir()
    out = session.evaluate(f'(Load "{tmp_path}/empty")')
    assert out == Expr("Table", Expr("file name"))


def test_tbl(session, tmp_path):
    (tmp_path / "t.tbl").write_text("a|b|\n1|x|\n2|y|\n")
    assert ev(session, f'(Load "{tmp_path}/t.tbl")') == '(Table (a 1 2) (b "x" "y"))'
    assert ev(session, f'(Load "{tmp_path}/t.tbl" b)') == '(Table (b "x" "y"))'
    (tmp_path / "region.tbl").write_text("0|AFRICA|none|\n1|ASIA|none|\n")
    assert ev(session, f'(Load "{tmp_path}/region.tbl" r_regionkey r_name)') == '(Table (r_regionkey 0 1) (r_name "AFRICA" "ASIA"))'
    (tmp_path / "u.tbl").write_text("0|z|\n")
    assert ev(session, f'(Load "{tmp_path}/u.tbl")') == '(Table (_c0 0) (_c1 "z"))'


def test_formats_and_binding(spark, session, tmp_path):
    spark.createDataFrame([(1, "a")], "k long, v string").write.parquet(f"{tmp_path}/p.parquet")
    spark.createDataFrame([(1, "a")], "k long, v string").write.json(f"{tmp_path}/j.json")
    assert ev(session, f'(Load "{tmp_path}/p.parquet" v)') == '(Table (v "a"))'
    assert ev(session, f'(Load "{tmp_path}/j.json")') == '(Table (k 1) (v "a"))'
    session.evaluate(f'(Load rel "{tmp_path}/p.parquet")')
    assert ev(session, "(Project rel k)") == "(Table (k 1))"
    session.evaluate('(InsertInto rel 2 "b")')
    session.evaluate('(InsertInto rel 3 "c")')
    assert ev(session, "(Project rel k v)") == '(Table (k 1 2 3) (v "a" "b" "c"))'


def test_loaders_own_leave_or_share(spark, folder):
    from quillon.plans.relation import Relation
    from quillon.sources.load import leaves_alone

    session = Session(spark)
    session.register_loader(leaves_alone(".xyz"))
    assert ev(session, '(Load "a.xyz" (flag 1))') == '(Load "a.xyz" (flag 1))'
    assert ev(session, '(Filter (Load "a.xyz") (Equal a 1))') == '(Filter (Load "a.xyz") (Equal a 1))'
    session.register_loader(lambda s, path, args: Relation(spark.range(3).toDF("n"), natural=True) if path.startswith("range:") else None)
    assert ev(session, '(Load "range:3")') == "(Table (n 0 1 2))"
    session.register_loader(lambda s, path, args: Expr("Union", Expr("Load", f"{folder}/c.csv"), Expr("Table", Expr("id", 9))) if path == "mixed" else None)
    assert ev(session, '(Project (Load "mixed") id)') == "(Table (id 3 9))"


def test_parser_flags(session, tmp_path):
    (tmp_path / "f.csv").write_text("1;2\n3;4\n")
    assert ev(session, f'(Load "{tmp_path}/f.csv" (header 0) (separator ";"))') == "(Table (_c0 1 3) (_c1 2 4))"
    assert ev(session, f'(Load "{tmp_path}/f.csv" (header 0) (separator ";") (unknown 1))') == "(Table (_c0 1 3) (_c1 2 4))"


def test_malformed_parquet(session, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    assert ev(session, f'(Load "{tmp_path}/x.parquet")').startswith("'Load::error: ")


def test_command_line(spark, tmp_path, capsys):
    from quillon.__main__ import main

    (tmp_path / "q.scm").write_text('(Plus 1 2) ; three\n(StringJoin "a" "b")')
    assert main(["-e", "(Plus 1 1)", "-p", "(Greater 2 1)", str(tmp_path / "q.scm")]) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["#t", "3", '"ab"']
    assert main(["--raw", "-p", "(Filter (Table (a 1 2)) (Greater a 1))"]) == 0
    assert capsys.readouterr().out == "(Table (a 2))\n"


def test_database(session):
    """Over JDBC, by the database that comes with Spark: columns, options and errors."""
    url = "jdbc:derby:memory:quillon;create=true"
    df = session.spark.createDataFrame([(1, "one"), (2, None)], "id int, name string")
    df.write.format("jdbc").options(url=url, dbtable="t").mode("overwrite").save()
    assert sorted(tuple(r) for r in session.dataframe(f'(Load "{url}" (table t) id name)').collect()) == [(1, "one"), (2, None)]
    assert [tuple(r) for r in session.dataframe(f'(Load "{url}" (query "SELECT * FROM t") id)').collect()] == [(1,), (2,)]
    assert ev(session, f'(Load "{url}" id)').startswith("'Load::error: ")
    plan = session.dataframe(f'(Project (Filter (Load "{url}" (table t)) (Greater id 1)) id)')._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,1)]" in plan and "ReadSchema: struct<id:int>" in plan


def test_csv_types_without_reading_all_rows(session, folder):
    assert ev(session, f'(Load "{folder}/a b.csv" (schema "id int, x string"))') == '(Table (id 1 2) (x "one" "two"))'
    assert ev(session, f'(Load "{folder}/a b.csv" (sample 0.5) x)') == '(Table (x "one" "two"))'


def test_pieces_are_files_of_bounded_size_in_order(spark, session, tmp_path, monkeypatch):
    """The files of slice_files and its like: several, each with few rows, small ones between large ones; read back in order."""
    from pyspark.sql import functions as F

    from quillon import queries

    monkeypatch.setattr(queries, "PIECE", 500)
    ids = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id") * 3).alias("event_id"), F.col("id").cast("double").alias("value"))
    ids.repartition(5, "value").write.parquet(f"{tmp_path}/events.parquet")
    queries.pieces(spark, str(tmp_path), f"{tmp_path}/out")
    table = spark.read.parquet(f"{tmp_path}/out/events.parquet").groupBy(F.input_file_name().alias("file"))
    sizes = [r.n for r in table.agg(F.count("*").alias("n")).orderBy("file").collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 600 and len(sizes) >= 12
    assert 1 in sizes[1:-1] and min(sizes[sizes.index(1) - 1], sizes[sizes.index(1) + 1]) > 100
    out = session.dataframe(f'(Slice (Load "{tmp_path}/out/events.parquet") 0 5000)').collect()
    assert [r.event_id for r in out] == [*range(3, 15000, 3), None]


def test_short_names_of_files_sort_like_their_paths(spark):
    import random

    from pyspark.sql import functions as F

    from quillon.plans.relation import short

    r = random.Random(3)
    for depth in (1, 2):
        files = list({"file:///a b/" + "/".join("p" + "".join(r.choice("0-_é") for _ in range(r.randint(0, 6))) for _ in range(depth)) for _ in range(60)})
        df = spark.createDataFrame([(f.replace("///", "/"),) for f in files], "f string")
        rows = [tuple(x) for x in df.select("f", short(F.col("f"), files)).collect()]
        assert len({s for _, s in rows}) == len(files)
        utf8 = lambda s: s.encode()
        assert [f for f, _ in sorted(rows, key=lambda x: utf8(x[1]))] == sorted((f for f, _ in rows), key=utf8)
    assert spark.range(1).select(short(F.lit("file:/a/b/c"), ["file:///a/b/c", "file:///a/d"])).first()[0] == "file:/a/b/c"


@pytest.mark.parametrize("name", ["slice_files", "cumulate_files", "pairwise_files"])
def test_queries_over_files_meet_several(spark, name):
    """Their order goes by file, and Cumulate and Pairwise cut into ranges of files give what one task does."""
    from quillon import queries
    from quillon.operators import sliding

    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "__order_file" in df._jdf.queryExecution().toString()
    kept, sliding.ALONE = sliding.ALONE, -1
    try:
        ranged = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    finally:
        sliding.ALONE = kept
    assert ("__range" in ranged._jdf.queryExecution().toString()) == (name != "slice_files")
    assert sorted(map(str, df.collect())) == sorted(map(str, ranged.collect()))

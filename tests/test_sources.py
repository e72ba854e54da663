import os

import pyarrow as pa
from row_sets import rows

from rulespan.engine import Engine
from rulespan.sources.changes import ChangeTable, consolidate
from rulespan.sources.files import from_arrow, read_csv, read_parquet, to_arrow, write_csv, write_parquet
from rulespan.streaming.feed import Feed


def test_csv_types_and_nulls(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x,s,b\n1,1.5,a,true\n2,NA,,false\n-3,2,null,true\n")
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "boolean"]
    assert rows(df) == [(-3, 2.0, None, True), (1, 1.5, "a", True), (2, None, None, False)]
    write_csv(df, str(tmp_path / "out"))
    assert rows(read_csv(spark, str(tmp_path / "out"))) == rows(df)


def test_parquet_and_arrow(spark, tmp_path):
    table = pa.table({"k": [1, 2], "v": [[1.0, 2.0], [3.0, 4.0]]})
    write_parquet(from_arrow(spark, table), str(tmp_path / "p"))
    assert to_arrow(read_parquet(spark, str(tmp_path / "p")).orderBy("k")).to_pydict() == table.to_pydict()


def test_change_table(spark, tmp_path):
    t = ChangeTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,), (2,)], "k long")
    t.append(df, 1, 1)
    t.append(df.where("k = 2"), -1, 2)
    t.append(df.where("k = 1"), 1, 3)
    assert rows(t.state()) == [(1,)] and rows(t.state(until=1)) == [(1,), (2,)]
    assert rows(consolidate(t.read())) == [(1, 2)] and rows(t.read(since=2).select("k")) == [(1,)]
    t.compact(2)
    assert rows(t.state()) == [(1,)] and t.read().count() == 2
    t.compact(3)
    assert rows(t.state()) == [(1,)] and t.read().count() == 1 and len(os.listdir(tmp_path / "t")) == 2


def test_a_batch_cut_short_does_not_count(spark, tmp_path):
    t = ChangeTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,), (2,)], "k long")
    t.append(df)
    t.append(df)
    done = next((tmp_path / "t").glob("batch-*1/rows/_SUCCESS"))
    done.unlink()
    assert t.read().count() == 2
    t.append(df.where("k = 1"))  # takes the place of what was cut short
    assert t.read().count() == 3
    t.compact(0)
    next((tmp_path / "t").glob("base-*/rows/_SUCCESS")).unlink()
    assert t.read().count() == 3
    t.compact(0)
    assert rows(t.read().select("k", "_diff")) == [(1, 2), (2, 1)]


def test_a_batch_counts_once_over_restarts(spark, tmp_path):
    batch = lambda *rs: spark.createDataFrame(list(rs), "k long, _diff long")
    feed = lambda: Feed(Engine(spark), "e", str(tmp_path / "t"))
    feed().apply(batch((1, 1)), 0)
    second = feed()  # a new process; the last batch is played again
    assert rows(second.engine.query("?e(K)")) == [(1,)]
    second.apply(batch((1, 1)), 0)
    second.table.compact(0)
    third = feed()
    third.apply(batch((1, 1)), 0)
    third.apply(batch((1, -1), (2, 1)), 1)
    assert rows(third.engine.query("?e(K)")) == [(2,)]


def test_feed_with_retractions(spark, tmp_path):
    engine = Engine(spark)
    feed = Feed(engine, "e", str(tmp_path / "t"))
    engine.execute("+n(U, count<K>) <- e(K, U)")
    seen = []
    feed.view("v", "?n(U, N)", lambda came, went: seen.append((rows(came), rows(went))))
    batch = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1)], "k long, u string, _diff long")
    feed.apply(batch, 0)
    feed.apply(batch, 0)  # the same batch again
    feed.apply(spark.createDataFrame([(3, "b", -1), (1, "a", -1)], "k long, u string, _diff long"), 1)
    assert seen == [([("a", 2), ("b", 1)], []), ([("a", 1)], [("a", 2), ("b", 1)])]


def test_feed_from_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a")], "k long, u string").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    feed = Feed(engine, "e", str(tmp_path / "t"))
    stream = spark.readStream.schema("k long, u string").parquet(str(tmp_path / "in"))
    feed.start(stream, str(tmp_path / "c")).awaitTermination()
    assert rows(engine.query("?e(K, U)")) == [(1, "a"), (2, "a")]


def test_builder(spark):
    from rulespan import builder as B

    class Emp(B.Rel):
        id: int
        name: str
        dept: str
        pay: float

    kg = B.Knowledge(Engine(spark))
    kg.define(Emp)
    kg.insert(Emp, [(1, "a", "x", 3.0), (2, "b", "x", 5.0), (3, "c", "y", 1.0)])
    assert [tuple(r) for r in kg.query(Emp.name, where=(Emp.pay > 4) | (Emp.dept == "y"), order_by=Emp.name.desc()).collect()] == [("c",), ("b",)]
    assert rows(kg.query(Emp.dept, total=B.sum_(Emp.pay))) == [("x", 8.0), ("y", 1.0)]
    other = Emp.as_("other")
    assert rows(kg.query(Emp.name, other.name, where=(Emp.dept == other.dept) & (Emp.id < other.id))) == [("a", "b")]
    kg.rule("rich", Emp.name, where=~(Emp.pay < 4))
    assert rows(kg.ask("?rich(N)")) == [("b",)]
    assert rows(kg.query(Emp.name, double=Emp.pay * 2, limit=1)) == [("a", 6.0)]

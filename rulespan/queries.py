"""The registered engine queries: workloads by text, and a few by the Python interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import knn
from .plans.ast import AddRule
from .plans.parser import parse_program
from .sources.changes import ChangeTable
from .sources.scratch import Scratch
from .streaming.feed import Feed
from .workloads import WORKLOADS, tables_of


def engine_over(spark: SparkSession, sf_dir: str, tables: list[str]) -> Engine:
    """An engine with test tables; they hold no null and no repeated row (FIXTURES.md), so those promises are made."""
    engine = Engine(spark)
    for t in tables:
        engine.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), non_null=True, is_set=True)
    return engine


def finished(df: DataFrame, digits: int = 4) -> DataFrame:
    """Lower-case names; doubles rounded, as sums differ in their last bits by order."""
    out = [F.round(F.col(f"`{f.name}`"), digits).alias(f.name.lower()) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`").alias(f.name.lower()) for f in df.schema.fields]
    return df.select(*out)


def _workload(name: str) -> Callable[[SparkSession, str], DataFrame]:
    program, goal, _, digits = WORKLOADS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_over(spark, sf_dir, tables_of(program, goal))
        if program:
            for s in parse_program(program):
                engine.add_rule(s.rule) if isinstance(s, AddRule) else engine.run(s)
        return finished(engine.query(goal), digits)

    run.__name__ = name
    return run


def provenance_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows tagged by whether the graph alone gives them."""
    engine = engine_over(spark, sf_dir, ["region"])
    engine.execute('region(300, "SEA")')
    return finished(engine.tagged("?region(K, N)"))


def why_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the proofs that nations belong to their regions' groups, one for each nation."""
    engine = engine_over(spark, sf_dir, ["region", "nation"])
    engine.execute("+within(N, P) <- nation(N, _, R), region(R, P)")
    proofs = engine.execute(".why ?within(N, P)")[0]
    lines = [(i, line) for i, line in enumerate(x for p in proofs for x in p.lines())]
    return spark.createDataFrame(lines, "line bigint, text string")


def change_feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a change table: all come, errors are taken back, the table is compacted."""
    table = ChangeTable(spark, f"{Scratch(spark).root}/events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    table.append(events, 1, 1)
    table.append(events.where("event_type = 'error'"), -1, 2)
    table.append(events.where("event_type = 'error' AND user_id < 10"), 1, 3)
    table.compact(2)
    return table.state()


def feed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over a relation that a stream feeds, after the stream has ended."""
    engine = Engine(spark)
    root = Scratch(spark).root
    feed = Feed(engine, "event", f"{root}/table")
    engine.execute("+active(U, count<E>) <- event(E, U, K)")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(f"{sf_dir}/" if not sf_dir.startswith("viewfs") else sf_dir)
    feed.start(stream.select("event_id", "user_id", "event_type"), f"{root}/checkpoint").awaitTermination()
    return finished(engine.query("?active(U, N)"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by ten-minute event-time windows."""
    from .streaming.feed import windowed_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = windowed_counts(events, "ts", ["event_type"], "10 minutes")
    start = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("window.start").cast("timestamp_ntz"))
    return out.select(start.alias("start_ms"), "event_type", "n")


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hnsw_nearest by rule, for every stored vector whose id is divisible by 20."""
    engine = Engine(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    engine.register("vectors", vectors, non_null=True, is_set=True, names=True)
    engine.execute(".index create near on vectors(embedding) metric euclidean")
    engine.execute('+r(I, J, D) <- vectors(I, V), M = I % 20, M = 0, hnsw_nearest("near", V, 4, J, D)')
    return finished(engine.query("?r(I, J, D)"))


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest rows of every row whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = knn.nearest_each(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 3, "cosine")
    return finished(found.select("query", "id", F.col("rank").cast("bigint").alias("rank")))


def builder_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed Python interface: a join, a disjunction, an aggregate."""
    from . import builder as B

    class Customer(B.Rel):
        c_custkey: int
        c_name: str
        c_nationkey: int
        c_acctbal: float
        c_mktsegment: str

    class Nation(B.Rel):
        n_nationkey: int
        n_name: str
        n_regionkey: int

    engine = engine_over(spark, sf_dir, ["customer", "nation"])
    where = (Customer.c_nationkey == Nation.n_nationkey) & ((Customer.c_mktsegment == "BUILDING") | (Customer.c_acctbal > 9000.0))
    kg = B.Knowledge(engine)
    kg.rule("rich", Nation.n_name, Customer.c_custkey, where=where)
    return finished(engine.query("?rich(N, C)"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read back with inferred types."""
    from .sources.files import read_csv, write_csv

    path = f"{Scratch(spark).root}/customer.csv"
    write_csv(spark.read.parquet(f"{sf_dir}/customer.parquet"), path)
    engine = Engine(spark)
    engine.register("c", read_csv(spark, path), is_set=True)
    return finished(engine.query("?c(K, Name, N, B, S)"), 2)


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "provenance_tags": (provenance_tags, "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS n, 'persistent' AS provenance FROM region UNION SELECT 300, 'SEA', 'ephemeral'"),
    "why_facts": (why_facts, None),
    "change_feed_replay": (change_feed_replay, "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' OR user_id < 10"),
    "feed_view": (feed_view, "SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1"),
    "event_windows": (event_windows, "SELECT epoch_ms(time_bucket(INTERVAL '10 minutes', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "index_search": (index_search, "SELECT x.vec_id AS i, y.vec_id AS j, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS d FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), y.vec_id) <= 4"),
    "knn_join": (knn_join, "SELECT x.vec_id AS query, y.vec_id AS id, row_number() OVER (PARTITION BY x.vec_id ORDER BY 1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), y.vec_id) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id QUALIFY rank <= 3"),
    "builder_query": (builder_query, "SELECT DISTINCT n_name AS n, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000"),
    "csv_round_trip": (csv_round_trip, "SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS BIGINT) AS n, round(c_acctbal, 2) AS b, c_mktsegment AS s FROM customer"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _workload(name) for name in WORKLOADS} | {k: f for k, (f, _) in EXTRA.items()}
ORACLE_SQL: dict[str, str] = {name: w[2] for name, w in WORKLOADS.items()} | {k: sql for k, (_, sql) in EXTRA.items() if sql}

"""The catalogue: one query for each operator over the test tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.reducers import reducers
from millrace.operators.collection import Collection
from millrace.operators.keyed import Keyed, reduce_by_key_ordered
from millrace.sources.frames import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    return read(spark, f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, d: str, value: str = "o_orderkey") -> Keyed:
    return _t(spark, d, "orders").key_by(F.col("o_custkey"), F.col(value))


def _named(c: Collection, *names: str) -> DataFrame:
    return c.df.toDF(*names)


@query(
    "SELECT l_returnflag || '/' || l_linestatus AS status, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem "
    "WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1"
)
def revenue_by_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    pairs = rows.key_by(F.concat_ws("/", "l_returnflag", "l_linestatus"), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return _named(pairs.reduce_by_key(reducers.sum).map_values(lambda v: F.round(v, 2)).sort_by("k"), "status", "revenue")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_collect(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").df


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def map_net_price(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").map(F.col("l_orderkey"), F.col("l_linenumber"), net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).df


@query("SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_urgent_orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").df


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def flatmap_words(spark: SparkSession, d: str) -> DataFrame:
    words = _t(spark, d, "documents").flat_map(F.split("text", " ", -1), "word")
    return _named(words.key_by(F.col("word"), F.lit(1)).reduce_by_key(reducers.sum), "word", "n")


def _sum_batches(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    total = 0
    for b in batches:
        total += pc.sum(b.column(0)).as_py() or 0
    yield pa.RecordBatch.from_pydict({"part": pa.array([total], pa.int64())})


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def map_partitions_sum(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "lineitem").map(n=F.col("l_linenumber").cast("long")).map_partitions_py(_sum_batches, "part long")
    return parts.reduced(F.col("part"), reducers.sum, "total").df


@query("SELECT o_custkey FROM orders")
def keys_custkey(spark: SparkSession, d: str) -> DataFrame:
    return _named(_orders(spark, d).keys(), "o_custkey")


@query("SELECT o_totalprice FROM orders")
def values_price(spark: SparkSession, d: str) -> DataFrame:
    return _named(_orders(spark, d, "o_totalprice").values(), "o_totalprice")


@query("SELECT l_orderkey, round(l_tax * 100, 4) AS tax FROM lineitem")
def map_values_tax(spark: SparkSession, d: str) -> DataFrame:
    return _named(_t(spark, d, "lineitem").key_by(F.col("l_orderkey"), F.col("l_tax")).map_values(lambda v: F.round(v * 100, 4)), "l_orderkey", "tax")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flat_map_values(spark: SparkSession, d: str) -> DataFrame:
    return _named(_t(spark, d, "part").key_by(F.col("p_partkey"), F.col("p_name")).flat_map_values(lambda v: F.split(v, " ", -1)), "p_partkey", "word")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 50")
def filter_keys_range(spark: SparkSession, d: str) -> DataFrame:
    return _named(_orders(spark, d).filter_keys(lambda k: k.between(10, 50)), "o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def filter_values_price(spark: SparkSession, d: str) -> DataFrame:
    return _named(_orders(spark, d, "o_totalprice").filter_values(lambda v: v > 200000), "o_custkey", "o_totalprice")


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def union_all_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").map(name=F.col("c_name")).union(_t(spark, d, "supplier").map(name=F.col("s_name"))).df


@query("SELECT upper(name) AS name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier) WHERE name LIKE '%1%'")
def union_then_map(spark: SparkSession, d: str) -> DataFrame:
    both = _t(spark, d, "customer").map(name=F.col("c_name")).union(_t(spark, d, "supplier").map(name=F.col("s_name")))
    return both.filter(F.col("name").contains("1")).map(name=F.upper("name")).df


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct_multi_partition(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").map(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_suppkey")).distinct().df


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def group_by_key_orders(spark: SparkSession, d: str) -> DataFrame:
    return _named(_orders(spark, d).group_by_key(), "o_custkey", "orders")


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def reduce_by_key_sum(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "lineitem").key_by(F.col("l_suppkey"), F.col("l_quantity"))
    return _named(pairs.reduce_by_key(reducers.sum).map_values(lambda v: F.round(v, 2)), "l_suppkey", "quantity")


@query("SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1")
def reduce_by_key_max(spark: SparkSession, d: str) -> DataFrame:
    return _named(_orders(spark, d, "o_totalprice").reduce_by_key(reducers.max), "o_custkey", "most")


@query("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY 1")
def reduce_by_key_concat(spark: SparkSession, d: str) -> DataFrame:
    out = reduce_by_key_ordered(_t(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderkey"), lambda a, b: F.concat(a, F.lit(","), b))
    return _named(out, "o_custkey", "priorities")


_COUNTS = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1"


@query(_COUNTS)
def partition_by_then_reduce(spark: SparkSession, d: str) -> DataFrame:
    return _named(_orders(spark, d).map_values(lambda v: F.lit(1)).partition_by_key(7).reduce_by_key(reducers.sum), "o_custkey", "n")


@query("SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1")
def rekey_then_group(spark: SparkSession, d: str) -> DataFrame:
    keyed = _orders(spark, d).partition_by_key(4).map(k=F.col("k") % 10, v=F.lit(1))
    return _named(Keyed(keyed.df).reduce_by_key(reducers.sum), "k", "n")


@query("SELECT * FROM nation")
def repartition_same_n(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").repartition(4).repartition(4).df


@query("SELECT * FROM customer")
def repartition_up(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").repartition(13).df


@query("SELECT * FROM customer")
def coalesce_down(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").repartition(8).coalesce(2).df


def _sides(spark: SparkSession, d: str) -> tuple[Keyed, Keyed]:
    return _orders(spark, d), _t(spark, d, "customer").key_by(F.col("c_custkey"), F.col("c_mktsegment"))


_JOIN = "SELECT o_custkey AS custkey, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"
_JOINED = ("custkey", "o_orderkey", "c_mktsegment")


@query(_JOIN)
def join_auto(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _named(a.join(b), *_JOINED)


@query(_JOIN)
def join_by_rows(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _named(a.join_by_rows(b), *_JOINED)


@query(_JOIN)
def join_shuffle_hash(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _named(a.shuffle_hash_join(b), *_JOINED)


@query(_JOIN)
def join_sort_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _named(a.sort_merge_join(b), *_JOINED)


@query(_JOIN)
def join_broadcast(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _named(a.broadcast_join(b), *_JOINED)


@query("SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id GROUP BY 1")
def join_many_to_many(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").key_by(F.col("user_id"), F.col("event_id"))
    pairs = events.join(Keyed(events.df)).key_by(F.col("k"), F.lit(1))
    return _named(pairs.reduce_by_key(reducers.sum), "user_id", "pairs")


@query(_JOIN + " WHERE o_orderkey < 0")
def join_empty_side(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _named(a.filter_values(lambda v: v < 0).join(b), *_JOINED)


@query(
    "WITH c AS (SELECT c_nationkey AS k, list(c_custkey ORDER BY c_custkey) AS v FROM customer WHERE c_nationkey > 3 GROUP BY 1), "
    "s AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS w FROM supplier WHERE s_nationkey < 20 GROUP BY 1) "
    "SELECT coalesce(c.k, s.k) AS nationkey, coalesce(v, []) AS customers, coalesce(w, []) AS suppliers FROM c FULL JOIN s ON c.k = s.k"
)
def cogroup_customer_supplier(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").key_by(F.col("c_nationkey"), F.col("c_custkey")).filter_keys(lambda k: k > 3)
    s = _t(spark, d, "supplier").key_by(F.col("s_nationkey"), F.col("s_suppkey")).filter_keys(lambda k: k < 20)
    return _named(c.cogroup(s), "nationkey", "customers", "suppliers")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def sort_by_price_desc(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").map(F.col("o_orderkey"), F.col("o_totalprice")).sort_by(F.desc("o_totalprice"), F.col("o_orderkey")).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k_orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").map(F.col("o_orderkey"), F.col("o_totalprice")).top(10, F.desc("o_totalprice"), F.col("o_orderkey")).df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def take_n(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").map(F.col("o_orderkey")).sort_by("o_orderkey").limit(25).df


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_order(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").map(F.col("o_orderkey"), F.col("o_orderdate")).top(1, "o_orderdate", "o_orderkey").df


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").aggregated(n=F.count("*")).df


@query("SELECT CAST(max(l_orderkey) AS BIGINT) AS most FROM lineitem")
def reduce_global(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").reduced(F.col("l_orderkey"), reducers.max, "most").df


@query("SELECT CAST(10 + sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def fold_global(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").folded(F.col("l_linenumber").cast("long"), F.lit(10).cast("long"), reducers.sum, "total").df


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n FROM lineitem")
def aggregate_sum_count(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").aggregated(total=F.sum(F.col("l_linenumber").cast("long")), n=F.count("*")).df


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def reduce_by_key_action(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "orders").key_by(F.col("o_orderstatus"), F.lit(1).cast("long"))
    found = pairs.reduce_by_key_action(reducers.sum)
    return spark.createDataFrame(list(found.items()), "status string, n long")


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1")
def group_by_key_action(spark: SparkSession, d: str) -> DataFrame:
    found = _t(spark, d, "nation").key_by(F.col("n_regionkey"), F.col("n_nationkey")).group_by_key_action()
    return spark.createDataFrame(list(found.items()), "n_regionkey int, nations array<int>")


@query(
    "WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), "
    "j AS (SELECT o_custkey, r.n FROM r JOIN orders ON o_orderkey = r.k) "
    "SELECT o_custkey, CAST(sum(n) AS BIGINT) AS items, count(*) AS orders FROM j GROUP BY 1"
)
def multi_shuffle_pipeline(spark: SparkSession, d: str) -> DataFrame:
    per_order = _t(spark, d, "lineitem").key_by(F.col("l_orderkey"), F.lit(1)).reduce_by_key(reducers.sum)
    orders = _t(spark, d, "orders").key_by(F.col("o_orderkey"), F.col("o_custkey"))
    of_customer = per_order.join(orders)
    items = of_customer.key_by(F.col("w"), F.struct(F.col("v").cast("long").alias("items"), F.lit(1).cast("long").alias("orders")))
    sums = items.reduce_by_key(reducers.sums("items", "orders"))
    return sums.map(F.col("k").alias("o_custkey"), items=F.col("v.items"), orders=F.col("v.orders")).df

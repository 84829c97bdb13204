"""The collection operators on small literal inputs, with one and several partitions."""

import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.operators import joins
from millrace.operators.keyed import Keyed, reduce_by_key_ordered
from millrace.plans import inspect

x, k, v = F.col("x"), F.col("k"), F.col("v")


def ints(spark, values, parts):
    return m.from_rows(spark, values, "x int", parts)


def pairs(spark, rows, parts=3, schema="k string, v int"):
    return Keyed(m.from_rows(spark, rows, schema, parts).df)


def got(c):
    return sorted((tuple(r) if len(r) > 1 else r[0] for r in c.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_elements(spark, parts):
    c = ints(spark, [1, 2, 3, 4, 5], parts)
    assert [r[0] for r in c.collect()] == [1, 2, 3, 4, 5] and [r[0] for r in c.take(3)] == [1, 2, 3] and c.first()[0] == 1 and c.count() == 5
    assert got(c.map(y=x * 2)) == [10, 2, 4, 6, 8]
    assert got(c.filter(x % 2 == 0)) == [2, 4]
    assert sorted(got(c.flat_map(F.array(x, x * 2)))) == [1, 2, 2, 3, 4, 4, 5, 6, 8, 10]
    assert c.reduce(x, m.reducers.sum) == 15 and c.fold(x, F.lit(10), m.reducers.sum) == 25
    assert tuple(c.aggregate(s=F.sum("x"), n=F.count("*"))) == (15, 5)
    seen = []
    c.foreach(lambda r: seen.append(r[0]))
    assert seen == [1, 2, 3, 4, 5]
    assert sorted(got(c.map_py(lambda r: (r[0] + 1,), "y int"))) == [2, 3, 4, 5, 6]


def test_distinct_is_global(spark):
    c = m.from_partitions(spark, [[1, 1, 2], [2, 3], [1, 3]], "x int")
    assert got(c.distinct()) == [1, 2, 3]
    assert got(c.distinct_within_partitions()) == [1, 1, 2, 2, 3, 3]


def test_union_then_narrow_and_repartition(spark):
    u = ints(spark, [1, 2], 1).union(ints(spark, [3], 1))
    assert got(u.map(x=x + 1).filter(x > 0).distinct()) == [2, 3, 4]
    r = u.repartition(3).repartition(3)
    assert r.num_partitions == 3 and got(r) == [1, 2, 3] and got(r.coalesce(2)) == [1, 2, 3]


def test_empty(spark):
    c = ints(spark, [], 2)
    assert c.collect() == [] and c.count() == 0 and c.fold(x, F.lit(7), m.reducers.sum) == 7
    with pytest.raises(LookupError):
        c.first()
    with pytest.raises(LookupError):
        c.reduce(x, m.reducers.sum)


def test_pairs(spark):
    p = pairs(spark, [(1, "one"), (2, "two")], 2, "k int, v string")
    assert got(p.keys()) == [1, 2] and got(p.values()) == ["one", "two"]
    assert got(p.map_values(lambda s: F.concat(s, F.lit("!")))) == [(1, "one!"), (2, "two!")]
    assert got(p.filter_keys(lambda q: q % 2 == 0)) == [(2, "two")] and got(p.filter_values(lambda s: s == "one")) == [(1, "one")]
    assert got(p.flat_map_values(lambda s: F.split(s, ""))) == sorted([(1, "o"), (1, "n"), (1, "e"), (2, "t"), (2, "w"), (2, "o")], key=repr)


def test_groups(spark):
    p = pairs(spark, [("x", 10), ("y", 20), ("x", 30), ("y", None), (None, 1), (None, 2)])
    assert p.group_by_key_action() == {"x": [10, 30], "y": [None, 20], None: [1, 2]}
    assert p.reduce_by_key_action(m.reducers.sum) == {"x": 40, "y": 20, None: 3}
    rows = m.from_rows(spark, [("a", "3", 3), ("a", "1", 1), ("b", "9", 1), ("a", "2", 2)], "k string, v string, o int", 3)
    assert got(reduce_by_key_ordered(rows, k, v, F.col("o"), lambda a, b: F.concat(a, b))) == [("a", "123"), ("b", "9")]
    assert rows.reduce_ordered(v, F.col("o"), lambda a, b: F.concat(a, b)) == "1923"


def test_partition_by_key_then_group(spark):
    p = pairs(spark, [("a", i) for i in range(9)] + [("b", 1)])
    kept = p.partition_by_key(4).reduce_by_key(m.reducers.sum)
    assert got(kept) == [("a", 36), ("b", 1)] and inspect.exchanges(kept.df) == 1
    moved = Keyed(p.partition_by_key(4).map(k=v % 2, v=v).df).reduce_by_key(m.reducers.sum)
    assert got(moved) == [(0, 20), (1, 17)] and inspect.exchanges(moved.df) == 2


def test_sort(spark):
    c = ints(spark, [3, 1, 4, 1, 5, 9, 2, 6], 3)
    assert [r[0] for r in c.sort_by("x").collect()] == [1, 1, 2, 3, 4, 5, 6, 9]
    assert [r[0] for r in c.top(2, F.desc("x")).collect()] == [9, 6]


L, R = [("a", 1), ("b", 2), ("c", 3), ("a", 4), (None, 0)], [("a", 10), ("b", 20), ("d", 40), ("a", 50), (None, 0)]
JOINED = [("a", 1, 10), ("a", 1, 50), ("a", 4, 10), ("a", 4, 50), ("b", 2, 20)]


def test_joins_agree(spark):
    a, b = pairs(spark, L), pairs(spark, R)
    for made, node in ((a.broadcast_join(b), "BroadcastHashJoin"), (a.shuffle_hash_join(b), "ShuffledHashJoin"), (a.sort_merge_join(b), "SortMergeJoin")):
        assert got(made) == JOINED and inspect.join_strategy(made.df) == node
    assert got(a.join(b)) == JOINED and got(a.filter(v > 99).key_by(k, v).join(b)) == []
    assert inspect.join_strategy(a.join_by_rows(b, 5).df) == "BroadcastHashJoin"
    assert inspect.join_strategy(a.join_by_rows(b, 4).df) == "SortMergeJoin"
    assert inspect.join_strategy(a.join_by_rows(b, 4, False).df) == "ShuffledHashJoin"
    assert joins.choose(3, 9, 3, True) == "broadcast" and joins.choose(4, 9, 3, True) == "merge"


def test_cogroup(spark):
    rows = got(pairs(spark, [("a", 1), ("b", 2), (None, 5)]).cogroup(pairs(spark, [("a", 3), ("c", 4), (None, 6)])))
    assert rows == sorted([("a", [1], [3]), ("b", [2], []), ("c", [], [4]), (None, [5], [6])], key=repr)


def test_retry_policy():
    p = m.RetryPolicy()
    assert [p.delay_ms(i) for i in (1, 2, 3, 4)] == [1000, 2000, 4000, 8000] and p.delay_ms(500) == 30000
    assert p.should_retry(3, ValueError()) and not p.should_retry(4, ValueError())
    assert not m.RetryPolicy(exceptions=(OSError,)).should_retry(1, ValueError()) and m.RetryPolicy(exceptions=(OSError,)).should_retry(1, FileNotFoundError())
    for bad in ((-1, 1, 1), (1, 0, 1), (1, 5, 1)):
        with pytest.raises(ValueError):
            m.RetryPolicy(*bad)
    tries = []

    def job():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return "done"

    assert m.run_with_retry(job, p, lambda s: None) == "done" and len(tries) == 3


def test_conf():
    c = m.EngineConf(max_task_retries=5)
    assert c.spark_conf()["spark.task.maxFailures"] == "6" and c.spark_conf()["spark.sql.shuffle.partitions"] == "4" and c.local_master() == "local[4,6]"


@pytest.mark.parametrize("parts", [1, 3])
def test_ordered_reduce_and_skewed_sort(spark, parts):
    letters = m.from_rows(spark, [(0, "a"), (1, "b"), (2, "c")], "i int, s string", parts)
    assert letters.reduce_ordered(F.col("s"), F.col("i"), lambda a, b: F.concat(a, b)) == "abc"
    values = [0] * 500 + list(range(1, 1001)) + [1000] * 300 + list(range(200, 401))
    assert [r[0] for r in ints(spark, values, parts).sort_by("x").collect()] == sorted(values) and len(values) == 2001


@pytest.mark.parametrize("parts", [1, 3])
def test_struct_values_and_unrelated_shuffle(spark, parts):
    people = pairs(spark, [("d1", ("Alice", 25)), ("d2", ("Bob", 30)), ("d1", ("Charlie", 35)), ("d2", ("Diana", 28))], parts, "k string, v struct<name:string,age:int>")
    found = {r["k"]: [tuple(p) for p in r["v"]] for r in people.group_by_key().collect()}
    assert found == {"d1": [("Alice", 25), ("Charlie", 35)], "d2": [("Bob", 30), ("Diana", 28)]}
    other = pairs(spark, [("z", 1), ("z", 2)], parts).group_by_key().map(k, F.get("v", F.lit(0)).alias("v"), F.get("v", F.lit(1)).alias("w"))
    both = other.union(pairs(spark, [("a", 1)], parts).join(pairs(spark, [("a", 2)], parts)))
    assert got(both).count(("a", 1, 2)) == 1 and both.count() == 2


@pytest.mark.parametrize("parts", [1, 3])
def test_partition_chains(spark, parts):
    import pyarrow as pa

    def total(batches):
        yield pa.RecordBatch.from_pydict({"x": pa.array([sum(sum(b.column(0).to_pylist()) for b in batches)], pa.int32())})

    assert sum(got(ints(spark, range(1, 6), 1).map_partitions_py(total, "x int"))) == 15
    c = ints(spark, [1, 2, 3, 4, 5], parts)
    assert got(c.repartition(3)) == got(c.coalesce(3)) == [1, 2, 3, 4, 5]
    assert sum(got(ints(spark, range(1, 31), parts).map_partitions_py(total, "x int").repartition(7).coalesce(3))) == 465


def test_partition_by_id_and_distinct_within(spark):
    c = ints(spark, [0, 1, 2, 3, 4, 5, 6, 7, -1], 3).partition_by_id(4, x)
    rows = c.df.select("x", F.spark_partition_id().alias("p")).collect()
    assert c.num_partitions == 4 and all(r["p"] == r["x"] % 4 for r in rows)
    twice = m.from_partitions(spark, [[1, 1, 2], [1, 2, 2]], "x int").distinct_within_partitions()
    assert got(twice) == [1, 1, 2, 2]


def test_shared_value_and_limits(spark):
    shared = m.share(spark, {1: "one"})
    assert got(ints(spark, [1], 1).map_py(lambda r: (shared.value[r[0]],), "y string")) == ["one"]
    shared.destroy()
    with pytest.raises(ValueError):
        m.share(spark, "x" * 100, max_bytes=50)
    assert m.run_with_limit(spark, lambda: spark.range(10).count(), 60000) == 10
    with pytest.raises(TimeoutError):
        m.run_with_limit(spark, lambda: spark.range(4).select(F.udf(lambda i: __import__("time").sleep(20) or 1, "int")("id")).collect(), 1500)


def test_conf_builds_a_policy_and_isolated_sessions(spark):
    conf = m.EngineConf(max_task_retries=2, base_retry_delay_ms=5, max_retry_delay_ms=9, default_shuffle_partitions=3)
    assert conf.retry_policy() == m.RetryPolicy(2, 5, 9) and "spark.network.timeout" not in conf.spark_conf()
    own = m.isolated(spark, conf)
    assert own.conf.get("spark.sql.shuffle.partitions") == "3" != spark.conf.get("spark.sql.shuffle.partitions")


def test_broadcast_goes_by_bytes_too(spark):
    a, b = pairs(spark, [("a", 1)]), pairs(spark, [("a", 2)])
    assert inspect.join_strategy(joins.broadcast_smaller(a.df, b.df, 10)) == "BroadcastHashJoin"
    assert joins.rows_up_to(spark.range(100), 7) == 8
    wide = joins.broadcast_smaller(a.df, b.df, 10, max_bytes=1)
    assert "merge" in wide._jdf.queryExecution().analyzed().toString() and got(m.from_frame(wide)) == [("a", 1, 2)]

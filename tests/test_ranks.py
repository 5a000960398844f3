import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.operators import bitmaps
from marginalia.operators.ranks import as_of_join, dense_ids, grouped_quantiles, range_running_sum, value_ranks


def test_running_sum_of_a_group_that_spans_partitions(spark):
    random.seed(1)
    rows = [("a" if i % 3 else None, i, random.randrange(5)) for i in range(600)]
    random.shuffle(rows)
    got = {(r[0], r[1]): r["n_before"] for r in range_running_sum(spark.createDataFrame(rows, "g string, k int, w long"), ["g"], ["k"], "w").collect()}
    for g in ("a", None):
        total = 0
        for _, k, w in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[g, k] == total
            total += w


def test_running_sum_of_nothing(spark):
    assert range_running_sum(spark.createDataFrame([], "g string, k int, w long"), ["g"], ["k"], "w").count() == 0


def test_value_ranks_count_equal_values_once(spark):
    df = spark.createDataFrame([("x", 1.0)] * 5 + [("x", 2.0), ("y", 0.0)], "g string, v double")
    assert {(r.g, r.v): (r.n, r.n_before) for r in value_ranks(df, ["g"], "v").collect()} == {("x", 1.0): (5, 0), ("x", 2.0): (1, 5), ("y", 0.0): (1, 0)}
    assert {(r.g, r.v): r.n_before for r in value_ranks(df, ["g"], "v", descending=True).collect()} == {("x", 1.0): 1, ("x", 2.0): 0, ("y", 0.0): 0}


def test_dense_ids_follow_key_order(spark):
    keys = [f"k{i:03d}" for i in range(50)]
    got = {r.key: r.id for r in dense_ids(spark.createDataFrame([(k,) for k in keys * 3 + [None]], "key string"), "key").collect()}
    assert got == {k: i for i, k in enumerate(keys)}
    assert dense_ids(spark.createDataFrame([], "key string"), "key").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=50), st.booleans())
def test_containers_hold_their_set(values, many):
    values = values | set(range(0, 60000, 7)) if many else values
    assert bitmaps.decode(bitmaps.words(bitmaps.encode(list(values)))).tolist() == sorted(values)


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 65536])
def test_container_sizes(n):
    c = bitmaps.encode(range(n))
    assert len(c) <= 8193 and bitmaps.decode(bitmaps.words(c)).tolist() == list(range(n))


def test_as_of_join(spark):
    random.seed(2)
    right = sorted({(random.choice("aab"), random.randrange(60)) for _ in range(40)})
    left = [(i, random.choice(["a", "a", "b", "c", None]), random.choice([*range(60), None])) for i in range(200)]
    got = as_of_join(spark.createDataFrame(left, "id long, k string, t int").repartition(4), spark.createDataFrame([(k, t, f"{k}{t}") for k, t in right], "k string, t int, v string"), "k", "t").collect()
    want = {i: max((rt for rk, rt in right if k is not None and t is not None and rk == k and rt <= t), default=None) for i, k, t in left}
    assert len(got) == 200 and all((r.right.t if r.right else None) == want[r.id] and (r.right is None or r.right.v == f"{r.k}{r.right.t}") for r in got)
    empty = spark.createDataFrame([], "k string, t int, v string")
    assert all(r.right is None for r in as_of_join(spark.createDataFrame(left, "id long, k string, t int"), empty, "k", "t").collect())


def test_grouped_quantiles(spark):
    random.seed(3)
    rows = [("x", float(random.randrange(20))) for _ in range(101)] + [("y", 5.0), ("z", None)]
    got = {r.g: r for r in grouped_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", (0.0, 0.37, 0.95, 1.0)).collect()}
    want = np.quantile([v for g, v in rows if g == "x"], [0.0, 0.37, 0.95, 1.0])
    assert got.keys() == {"x", "y"} and np.allclose([got["x"][f"q{k}"] for k in range(4)], want) and got["y"].q2 == 5.0 and got["x"].n == 101

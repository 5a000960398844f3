import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.top_hits import LoserTree, merge_top, top_n
from marginalia.llm.top_hits_queries import query_key


def brute(rows, n):
    out = {}
    for g, *order in {r[:4] for r in rows if None not in r[:4]}:
        out.setdefault(g, []).append(tuple(order))
    return sorted((g, *o, i) for g, os in out.items() for i, o in enumerate(sorted(os)[:n], 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9))), max_size=7), st.integers(1, 4))
def test_merge_of_any_runs(runs, n):
    runs = [sorted(r) for r in runs]
    parts = [([g for g, _ in r], [k for _, k in r]) for r in runs]
    got = [(runs[r][i][0], runs[r][i][1], p) for r, i, p in merge_top(parts, n)]
    want = [(g, k, p) for g in "abc" for p, k in enumerate(sorted({k for r in runs for x, k in r if x == g})[:n], 1)]
    assert got == want


def test_tree_of_one_and_none():
    assert LoserTree([]).winner() == 0 and LoserTree([(1, 2)]).winner() == 0


def test_hot_group_repeats_nulls_and_clashing_names(spark):
    random.seed(3)
    rows = [("hot" if i % 3 else f"g{i % 50}", random.randrange(9), random.choice(["é", "z", "Z", "𝄞", "～"]), i // 2, "x", 1) for i in range(5000)]
    rows += [(None, 1, "a", 1, "", 1), ("g", None, "a", 1, "", 1), ("g", 1, None, 1, "", 1)]
    df = spark.createDataFrame(rows, "g string, rank int, c string, hit int, _run string, place int").repartition(7)
    for n in (0, 1, 5):
        assert sorted(map(tuple, top_n(df, "g", ["rank", "c", "hit"], n).collect())) == brute(rows, n)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, k int"), "g", ["k"], 3).count() == 0


def test_query_keys(spark):
    texts = [" A \t b\t", "a b", " ", None, "", "A  B"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "q string").select(query_key("q")).collect()]
    assert got == ["a b", "a b", None, None, None, "a b"]

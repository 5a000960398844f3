import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.containers import _Stock, count_tokens, fill_containers, number_within, plan
from marginalia.llm.tokens import PATTERN, TOKENIZER_DIR, VOCABULARY, counter


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_uses_every_item_and_fills_no_container_over(counts):
    used = Counter()
    for i, s in enumerate(steps := plan(counts, 64)):
        assert sum(x * k for x, k in s.lengths.items()) <= 64 and s.times > 0
        assert s.first == sum(x.times for x in steps[:i])
        for x, k in s.lengths.items():
            used[x] += k * s.times
    assert used == Counter(counts)


def test_plan_is_close_to_full_and_small():
    random.seed(5)
    counts = Counter(min(4096, max(1, int(random.lognormvariate(5.7, 0.9)))) for _ in range(20000))
    steps = plan(counts)
    tokens = sum(x * n for x, n in counts.items())
    assert sum(s.times for s in steps) <= tokens / 4096 * 1.002 + 1
    assert len(plan({x: n * 10**9 for x, n in counts.items()})) <= 3 * len(counts)
    assert plan({}) == [] and [s.times for s in plan({4096: 3})] == [3]
    assert [dict(s.lengths) for s in plan({3000: 1, 1000: 1, 96: 1, 900: 1}, 4096)][0] == {3000: 1, 1000: 1, 96: 1}


def test_filling(spark):
    random.seed(7)
    rows = [(i, random.choice([1, 30, 500, 501, 4095, 4096, 4097, 9000, 0, None]), "x") for i in range(400)] + [(None, 77, "x"), (1, 30, "x")]
    df = spark.createDataFrame(rows, "id long, tokens long, container string").repartition(5)
    got = fill_containers(df).collect()
    used, whole = Counter(), defaultdict(int)
    for r in got:
        if r.container is None:
            assert not r.tokens and r.piece_tokens == 0
        else:
            used[r.container] += r.piece_tokens
            assert r.pieces == -(-r.tokens // 4096)
        whole[r.id] += r.piece_tokens
    assert max(used.values()) == 4096 and sorted(used) == list(range(len(used)))
    want = Counter()
    for i, n, _ in rows:
        want[i] += n or 0
    assert Counter(whole) == want
    assert len(used) <= sum(used.values()) / 4096 * 1.02 + 1
    assert fill_containers(spark.createDataFrame([], "id long, tokens long")).count() == 0


def test_numbers_are_a_permutation(spark):
    df = spark.createDataFrame([(i % 3 or None, i) for i in range(100)], "k int, v int").repartition(6)
    got = defaultdict(list)
    for r in number_within(df, ["k"]).filter("k IS NOT NULL").collect():
        got[r.k].append(r.n_before)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def tiktoken_count():
    import base64

    import tiktoken

    with open(f"{TOKENIZER_DIR}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encode():
    return tiktoken_count()


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab 1.'s\n\t  é我", max_size=60))
def test_counts_are_exact(encode, text):
    assert counter()(text) == len(encode(text))


def test_count_column(spark):
    got = count_tokens(spark.createDataFrame([(1, "a b", "s"), (2, None, "s"), (3, "", None)], "d long, t string, s string"), "d", "t", keep=("s",)).collect()
    assert [(r.id, r.s, r.tokens) for r in got] == [(1, "s", 2), (2, "s", None), (3, None, 0)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=8), st.lists(st.integers(0, 7), max_size=6), st.integers(1, 30))
def test_complements_against_all_combinations(counts, taken, gap):
    """After some lengths have run out the index still finds a combination if and only if there is one."""
    stock = _Stock(counts, 30)
    for i in taken:
        x = sorted(counts)[i % len(counts)]
        stock.left[x] = max(0, stock.left[x] - 1)
        stock.complement(gap)
    items = [x for x in range(31) for _ in range(int(stock.left[x]))]
    exists = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(items, k))
    got = stock.complement(gap)
    assert (got is not None) == exists
    assert got is None or (sum(got) == gap and not Counter(got) - Counter(items))
